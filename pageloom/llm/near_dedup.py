"""Near-duplicates: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, linked exactly.

Every document has a SimHash fingerprint of PRINT_BITS bits and a sample of its smallest shingle hashes. Documents meet
where they share one of a few sampled shingles; shingles that very many documents have serve only those that consist of
little else. Pairs that meet must pass the pigeonring filter: of 16 segments of the fingerprints' difference on a ring,
some chain of four has, for every length l, at most l/16 of the allowed distance in its first l segments. Those then take
the full Hamming check, and what passes is verified on the whole shingle sets, so no pair below the threshold links.

A key's documents are compared in parts of bounded size. Where a key has several parts, some of its documents stand in
each of them, and afterwards whoever is outside the key's largest component visits every part: no pair goes untested
unless it is linked already. Groups in which nearly all pairs pass the filter are linked breadth first on shingle sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, components, free_name, give_back, is_small, join_counted, per_document, text_digest, text_or_empty, write_table
from .simhash import fingerprint, shingle_hashes

PRINT_BITS, SEGMENTS, CHAIN = 256, 16, 4
#: Shingles sampled of a document, and how many of them are keys.
SAMPLE, KEYS = 24, 6
#: A sampled shingle of more documents than this is common.
COMMON = 256
#: Documents and shingles of one part of a key's documents; documents that stand in all parts of a key.
PART_DOCS, PART_SHINGLES, SHARED_DOCS = 512, 1 << 21, 16
#: Candidate pairs for each document of a part up to which the pairs themselves are handed on.
PAIRS_EACH = 8


class Chain:
    """Pigeonring filter for fingerprints that differ in at most `distance` of PRINT_BITS bits.

    At a quarter of the bits a pair at Jaccard 0.8 is missed about once in 10,000 (bits differ with probability 0.15), at
    sets of four and five shingles once in 250; verification follows, so the distance only has to be wide enough.
    """

    def __init__(self, distance: int = 64):
        self.distance = distance
        self.budgets = [distance * k // SEGMENTS for k in range(SEGMENTS + 1)]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which rows of a and b (64-bit words) are within the distance: the chains first, then all bits."""
        part = np.bitwise_count((a ^ b).view(np.uint16))
        run, ok = part.copy(), part <= self.budgets[1]
        for k in range(2, CHAIN + 1):
            run += np.roll(part, 1 - k, 1)
            ok &= run <= self.budgets[k]
        out = ok.any(1)
        alive = np.flatnonzero(out)
        out[alive] = part[alive].sum(1, dtype=np.int64) <= self.distance
        return out


def shingle_set(text: str, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def _sizes_fit(n: np.ndarray, m: np.ndarray, ratio: tuple[int, int]) -> np.ndarray:
    return ratio[1] * np.minimum(n, m) >= ratio[0] * np.maximum(n, m)


def _part_pairs(n: np.ndarray, prints: np.ndarray, chain: Chain, ratio: tuple[int, int], guest: np.ndarray | None, label: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one part that pass all filters: each pair once, or, with guests, of a guest and a row of another label."""
    out_a, out_b = [], []
    rows = np.arange(len(n)) if guest is None else np.flatnonzero(guest)
    for at in range(0, len(rows), 64):
        mine = rows[at : at + 64]
        a, b = np.repeat(mine, len(n)), np.tile(np.arange(len(n)), len(mine))
        ok = (a < b) if guest is None else (label[a] != label[b])
        ok &= _sizes_fit(n[a], n[b], ratio)
        a, b = a[ok], b[ok]
        if len(a):
            ok = chain.near(prints[a], prints[b])
            out_a.append(a[ok])
            out_b.append(b[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _parts(batches, keys: int):
    """Tables of whole parts from batches that are sorted by their first `keys` columns."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        last = held.slice(held.num_rows - 1)
        other = None
        for i in range(keys):
            differs = pc.not_equal(held.column(i), last.column(i)[0])
            other = differs if other is None else pc.or_(other, differs)
        cut = int(pc.sum(other).as_py() or 0)  # sorted: the last part is at the end
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()
    give_back()


def _cuts(table, keys: int) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for i in range(keys):
        v = table.column(i).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def _candidates(chain: Chain, ratio: tuple[int, int], visits: bool, pairs_each: int = PAIRS_EACH):
    """Of sorted rows (key, part, node, n, fp[, label, guest]): candidate pairs (a, b), or, where a part has very many, its members that are in one (key, part, a)."""

    def run(batches):
        import pyarrow as pa

        for table in _parts(batches, 2):
            cuts = _cuts(table, 2)
            if not visits and (np.diff(cuts) < 2).all():
                continue
            n = table.column(3).to_numpy().astype(np.int64)
            prints = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint64).reshape(len(n), -1)
            nodes = table.column(2).combine_chunks()
            label = np.unique(np.array(table.column(5).to_pylist(), "S16"), return_inverse=True)[1] if visits else None
            guest = table.column(6).to_numpy(zero_copy_only=False).astype(bool) if visits else None
            pair_a, pair_b, flat = [], [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hi - lo < 2:
                    continue
                a, b = _part_pairs(n[lo:hi], prints[lo:hi], chain, ratio, guest[lo:hi] if visits else None, label[lo:hi] if visits else None)
                if visits or len(a) > pairs_each * (hi - lo):
                    flat.append(lo + np.unique(np.concatenate([a, b])))
                else:
                    pair_a.append(a + lo)
                    pair_b.append(b + lo)
            for a, b in ((np.concatenate(pair_a), np.concatenate(pair_b)),) if pair_a else ():
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()), nodes.take(pa.array(a)), nodes.take(pa.array(b))], names=["key", "part", "a", "b"])
            for at in (np.concatenate(flat),) if flat else ():
                i = pa.array(at)
                yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks().take(i), table.column(1).combine_chunks().take(i), nodes.take(i), pa.nulls(len(at), pa.binary())], names=["key", "part", "a", "b"])

    return run


class Overlaps:
    """Sizes of the intersections of one set of a part with all others."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.end = np.cumsum(self.size)
        values, self.member = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), bool)

    def similar(self, x: int, ratio: tuple[int, int]) -> np.ndarray:
        """Whether each set is at or above the similarity to set x. Sets are not empty here, or all sets are."""
        mine = self.member[self.end[x] - self.size[x] : self.end[x]]
        self.mark[mine] = True
        hits = np.concatenate([[0], np.cumsum(self.mark[self.member], dtype=np.int64)])
        self.mark[mine] = False
        both = hits[self.end] - hits[self.end - self.size]
        return both * (ratio[0] + ratio[1]) >= ratio[0] * (self.size + self.size[x])


def linked_rows(sets: list[np.ndarray], ratio: tuple[int, int]) -> np.ndarray:
    """Each row's component's first row under all links of a part. Who is reached is compared no more, so a tight group takes few passes."""
    over, n = Overlaps(sets), len(sets)
    root, free = np.arange(n), np.ones(n, bool)
    for first in range(n):
        if not free[first]:
            continue
        free[first], queue = False, [first]
        while queue and free.any():
            reached = np.flatnonzero(over.similar(queue.pop(), ratio) & free)
            free[reached] = False
            root[reached] = first
            queue.extend(reached.tolist())
    return root


def _links(ratio: tuple[int, int], visits: bool):
    """Of sorted rows (key, part, node, set[, label, guest]): verified links (a, b), at most one a row and, for a guest, one a label."""

    def run(batches):
        import pyarrow as pa

        for table in _parts(batches, 2):
            cuts = _cuts(table, 2)
            nodes = table.column(2).combine_chunks()
            column = table.column(3).combine_chunks()
            out_a, out_b = [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = column.slice(lo, hi - lo)
                flat, at = part.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.diff(part.offsets.to_numpy()))])
                sets = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
                if not visits:
                    root = linked_rows(sets, ratio)
                    rows = np.flatnonzero(root != np.arange(hi - lo))
                    out_a += (rows + lo).tolist()
                    out_b += (root[rows] + lo).tolist()
                    continue
                label = np.array(table.column(4).slice(lo, hi - lo).to_pylist(), "S16")
                over = Overlaps(sets)
                for x in np.flatnonzero(table.column(5).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)).tolist():
                    hit = np.flatnonzero(over.similar(x, ratio) & (label != label[x]))
                    some = hit[np.unique(label[hit], return_index=True)[1]]
                    out_a += [x + lo] * len(some)
                    out_b += (some + lo).tolist()
            if out_a:
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(out_a)), nodes.take(pa.array(out_b))], names=["a", "b"])

    return run


def _with_parts(posts: DataFrame, large: DataFrame) -> DataFrame:
    """posts with parts, the number of parts of their key (1 for keys that are not in large), and n_docs."""
    if large.isEmpty():
        return posts.withColumn("parts", F.lit(1)).withColumn("n_docs", F.lit(0).cast("long"))
    if is_small(large):
        met = posts.join(F.broadcast(large), "key", "left")
    else:
        met = join_counted(posts, large, "key", "n_docs")
    return met.select(*posts.columns, F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"))


def similar_nodes(docs: DataFrame, shingle: int = 5, ratio: tuple[int, int] = (4, 5), chain: Chain | None = None, common: int = COMMON, part_docs: int = PART_DOCS, pairs_each: int = PAIRS_EACH) -> DataFrame:
    """(node, root) for every distinct text that is linked to another: root is its component's smallest node (see text_digest).

    Two texts link when their sets of `shingle`-word shingles (A-Z lower-cased; fewer words: the whole sequence; none: one
    empty sequence, equal to any other) have a Jaccard similarity of ratio[0]/ratio[1] or more.
    """
    chain = chain or Chain()
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def prints_of(texts):
        n, prints, sample = [], [], []
        for t in texts:
            h = shingle_set(t, shingle)
            n.append(len(h))
            prints.append(fingerprint(h, PRINT_BITS // 64))
            sample.append(h[:SAMPLE].view(np.int64))
        return n, prints, sample

    source = docs.select(text_digest().alias("node"), text_or_empty().alias("text"))
    prints = per_document(source, prints_of, "n int, fp binary, sample array<long>", carry=("node",))
    # equal texts: one of them; texts without words have no shingle and are all alike
    prints = write_table(prints, "prints")
    wordless = prints.filter("n = 0").select("node").distinct()
    nodes = write_table(prints.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sample").alias("sample")), "near-nodes")
    sampled = nodes.select("node", F.explode("sample").alias("h"))
    often = write_table(sampled.groupBy("h").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > common), "common-shingles")
    met = sampled.join(F.broadcast(often.select("h")), "h") if is_small(often) else join_counted(sampled, often, "h", "n_docs").filter("n_docs IS NOT NULL")
    hits = write_table(met.groupBy("node").agg(F.array_sort(F.collect_list("h")).alias("common")), "common-hits")
    chosen = nodes.join(broadcast_if_small(hits), "node", "left").withColumn("rare", F.coalesce(F.array_except("sample", "common"), F.col("sample")))
    mostly = 10 * F.size("rare") < 3 * F.size("sample")
    keys = F.when(mostly, F.concat(F.slice("rare", 1, KEYS), F.slice("common", 1, KEYS))).otherwise(F.slice("rare", 1, KEYS))
    posts = write_table(chosen.select("node", "n", "fp", keys.alias("keys")), "near-keys").select(F.explode("keys").alias("key"), "node", "n", "fp")

    sizes = posts.groupBy("key").agg(F.count("*").alias("n_docs"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("n_docs") / part_docs), F.ceil(F.col("shingles") / PART_SHINGLES)).cast("int")
    large = write_table(sizes.filter((F.col("n_docs") > part_docs) | (F.col("shingles") > PART_SHINGLES)).select("key", "n_docs", parts.alias("parts")), "large-keys")
    dealt = _with_parts(posts, large)
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    everywhere = F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("n_docs") / SHARED_DOCS)) == 0
    dealt = dealt.withColumn("part", F.explode(F.when((F.col("parts") > 1) & everywhere, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))))
    columns = "key part node n fp".split()
    ready = dealt.select(*columns).repartition(n_parts, "key", "part").sortWithinPartitions("key", "part")
    found = write_table(ready.mapInArrow(_candidates(chain, ratio, False, pairs_each), "key long, part int, a binary, b binary"), "candidates")
    pairs = write_table(found.filter("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    dense = found.filter("b IS NULL").select("key", "part", F.col("a").alias("node"))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(dense.select("node"))

    def sets_of(needed: DataFrame) -> DataFrame:
        needed = write_table(needed.distinct(), "needed")
        texts = source.join(broadcast_if_small(needed), "node").groupBy("node").agg(F.min("text").alias("text"))
        return write_table(per_document(texts, lambda ts: [[shingle_set(t, shingle).view(np.int64) for t in ts]], "shingles array<long>", carry=("node",)), "shingle-sets")

    sets = sets_of(needed)
    sides = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    links = sides.filter(inter * (ratio[0] + ratio[1]) >= ratio[0] * (F.size("sa") + F.size("sb"))).select("a", "b")
    if not dense.isEmpty():
        by_part = dense.join(sets, "node").select("key", "part", "node", "shingles").repartition(n_parts, "key", "part").sortWithinPartitions("key", "part")
        links = links.unionByName(by_part.mapInArrow(_links(ratio, False), "a binary, b binary"))
    links = write_table(links, "near-links")
    roots = write_table(components(links), "near-roots")
    if not large.isEmpty():
        more = _visits(posts, large, roots, sets_of, chain, ratio, n_parts)
        if not more.isEmpty():
            roots = write_table(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "near-roots")
    # wordless texts are alike: stars around the smallest; alone it is linked to itself, which does no harm
    first = wordless.agg(F.min("node").alias("root"))
    return roots.unionByName(wordless.join(F.broadcast(first), F.col("root").isNotNull()).select("node", "root"))


def _visits(posts: DataFrame, large: DataFrame, roots: DataFrame, sets_of, chain: Chain, ratio: tuple[int, int], n_parts: int) -> DataFrame:
    """Links that the parts of large keys hide from each other: every document outside its key's largest component visits all parts."""
    rows = write_table(_with_parts(posts, large).filter("parts > 1"), "large-posts")
    rows = write_table(rows.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "large-labels")
    main = rows.groupBy("key", "label").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    main = write_table(large.join(main, "key").select("key", "main", F.col("n_docs").alias("m_docs")), "large-main")
    met = rows.join(F.broadcast(main), "key") if is_small(main) else join_counted(rows, main, "key", "m_docs")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    outside = F.col("label") != F.col("main")
    met = met.withColumn("part", F.explode(F.when(outside, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own)))).withColumn("guest", outside)
    columns = "key part node n fp label guest".split()
    met = write_table(met.select(*columns), "visits")
    found = met.repartition(n_parts, "key", "part").sortWithinPartitions("key", "part").mapInArrow(_candidates(chain, ratio, True), "key long, part int, a binary, b binary")
    found = write_table(found.select("key", "part", F.col("a").alias("node")), "visit-candidates")
    sets = sets_of(found.select("node"))
    rows = found.join(sets, "node").join(met.select("key", "part", "node", "label", "guest"), ["key", "part", "node"])
    rows = rows.select("key", "part", "node", "shingles", "label", "guest").repartition(n_parts, "key", "part").sortWithinPartitions("key", "part")
    return write_table(rows.mapInArrow(_links(ratio, True), "a binary, b binary"), "visit-links")


def near_leads(docs: DataFrame, shingle: int = 5, ratio: tuple[int, int] = (4, 5), **options) -> DataFrame:
    """(node, n_rows, lead_id, lead_node, n_lead) for every text that several rows have or that is linked to another: the row
    that stays of its group is the one with lead_id (null: none has an id) and lead_node, and there are n_lead such rows."""
    roots = write_table(similar_nodes(docs, shingle, ratio, **options), "near-roots")
    rows = write_table(docs.select(text_digest().alias("node"), "doc_id").groupBy("node", "doc_id").agg(F.count("*").alias("n")), "near-rows")
    per_node = rows.groupBy("node").agg(F.sum("n").alias("n_rows"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "n")).alias("first"))
    per_node = per_node.join(roots, "node", "left")
    per_node = write_table(per_node.filter("n_rows > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "node")), "near-groups")
    best = write_table(per_node.groupBy("root").agg(F.min(F.struct("first.none", "first.id", "node", "first.n")).alias("best"), F.count("*").alias("k")), "near-best")
    return join_counted(per_node, best, "root", "k").select("node", "n_rows", F.col("best.id").alias("lead_id"), F.col("best.node").alias("lead_node"), F.col("best.n").alias("n_lead"))


def drop_near(docs: DataFrame, shingle: int = 5, ratio: tuple[int, int] = (4, 5), **options) -> DataFrame:
    """docs, all columns, with one row of each group of near-duplicates: the one with the smallest doc_id.

    Groups are the components of links between texts of a similarity of ratio or more, and equal texts. Null doc_ids come
    last; ties in doc_id go to the text with the smaller digest, and of rows that agree in doc_id and text any one stays.
    Texts without words (null, empty, white space) are one group. An empty table gives an empty table. Columns of docs
    may have any names.
    """
    leads = write_table(near_leads(docs.select("doc_id", "text"), shingle, ratio, **options), "near-leads")
    node, lead = free_name(docs, "_node"), free_name(docs, "_lead")
    tagged = docs.withColumn(node, text_digest())
    found = leads.select(F.col("node").alias(node), F.struct("lead_id", "lead_node", "n_lead").alias(lead), "n_rows")
    if is_small(leads):
        met = tagged.join(F.broadcast(found.drop("n_rows")), node, "left")
    else:
        count = free_name(docs, "_n_rows")
        met = join_counted(tagged, found.withColumnRenamed("n_rows", count), node, count)
    stays = F.col(lead).isNull() | (F.col(f"{lead}.lead_node") == F.col(node)) & F.col(f"{lead}.lead_id").eqNullSafe(F.col("doc_id"))
    kept = met.filter(stays)
    several = F.coalesce(F.col(f"{lead}.n_lead") > 1, F.lit(False))
    if leads.filter("n_lead > 1").isEmpty():
        return kept.select(*_quoted(docs))
    return kept.filter(~several).unionByName(kept.filter(several).dropDuplicates([node])).select(*_quoted(docs))


def _quoted(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns]
