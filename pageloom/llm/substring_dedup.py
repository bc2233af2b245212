"""Removal of repeated passages: every window of WINDOW words that an earlier document has as well goes.

Equal windows share the content of their smallest ANCHOR-word hash, so windows are dealt by that anchor: consecutive
windows of a document with one anchor are a segment. An anchor that one document alone has is done with. The segments of
the others are told apart by 128 bits of the BLAKE2b of their words, which stands for the words: of equal segments one is needed, with
their smallest document. Where an anchor has several distinct segments, these are sharded by anchor, and each shard is a
compressed FM-index over words: a wavelet matrix of the Burrows-Wheeler transform, packed bits with block counts, and for
each run of suffixes that agree in a whole window the smallest document; the suffix array is not kept. Segments are
streamed through it by backward search, all in step, and where the matching length reaches the window, the interval of
suffixes names that document. An anchor whose distinct segments outgrow one index is resolved by the digests of its
windows instead, which says the same and may be spread over any number of tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, documents, join_counted, text_digest, text_or_empty, write_table

WINDOW, ANCHOR = 50, 4
#: Words that fill an FM-index, complete anchors at a time, and of the widest anchor that goes into one.
SHARD_WORDS, ANCHOR_WORDS = 400_000, 200_000
NEVER = (1 << 63) - 1  # after all documents
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode().split()  # exactly the white space of the contract


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def segments(counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document's index, first word in it, number of words, anchor) of all segments of documents that have `counts` words each,
    their word hashes one after the other."""
    ends = np.cumsum(counts)
    windows = np.maximum(counts - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(counts)), windows)
    first = (ends - counts)[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    if not len(doc):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    key = np.zeros(len(hashes) - ANCHOR + 1, np.uint64)
    for k in range(ANCHOR):  # order counts
        key = _mix(key * _P + hashes[k : k + len(key)])
    at = np.arange(len(key))
    span, best = WINDOW - ANCHOR + 1, at
    step = 1
    while 2 * step <= span:  # leftmost smallest of 2 * step from each place
        left, right = best[:-step], best[step:]
        best = np.where(key[left] <= key[right], left, right)
        step *= 2
    left, right = best[first], best[first + span - step]
    anchor = np.where(key[left] <= key[right], left, right)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    begin = np.flatnonzero(new)
    last = np.concatenate([begin[1:], [len(doc)]]) - 1
    a, b = first[begin], first[last] + WINDOW
    d = doc[begin]
    return d, a - (ends - counts)[d], b - a, key[anchor[begin]].astype(np.int64)


class BitRank:
    """Packed bits with a count before each 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Number of set bits before each place."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))


class FMIndex:
    """Of sequences of symbols 1..sigma, with a value for each place of them and their ends. A sequence's end sorts before all
    symbols, ends in the order of sequences."""

    def __init__(self, sequences: list[np.ndarray], sigma: int, values: np.ndarray, window: int = WINDOW):
        m, longest = len(sequences), max(map(len, sequences))
        parts = []
        for j, s in enumerate(sequences):
            parts += [s + (m - 1), [j]]
        text = np.concatenate(parts).astype(np.int64)  # ends are 0..m-1, symbols from m
        n = self.n = len(text)
        rank, k, part = text, 1, None
        largest = 1 << (window.bit_length() - 1)
        while True:  # prefix doubling; ends differ, so the longest sequence bounds it
            if k == largest:
                part = rank
            after = np.full(n, -1, np.int64)
            after[:-k] = rank[k:]
            key = rank * (n + m + sigma + 2) + after + 1
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            fresh = np.empty(n, np.int64)
            fresh[order] = np.cumsum(np.concatenate([[0], (sorted_[1:] != sorted_[:-1]).astype(np.int64)]))
            rank, k = fresh, 2 * k
            if k > longest and k > largest:
                break
        before = np.concatenate([text[-1:], text[:-1]])[order]
        bwt = np.where(before < m, 0, before - m + 1)
        self.first = np.searchsorted(np.sort(bwt), np.arange(sigma + 2))
        # the runs of suffixes that agree in a whole window
        i, j, rest = order[1:], order[:-1], window - largest
        at = lambda x: part[np.minimum(x + rest, n - 1)]
        same = (part[i] == part[j]) & (at(i) == at(j)) & (np.maximum(i, j) + rest < n)
        runs = np.concatenate([[True], ~same])
        self.run_rank = BitRank(runs)
        self.minima = np.minimum.reduceat(values[order], np.flatnonzero(runs))
        # wavelet matrix
        self.levels, self.zeros, value = [], [], bwt
        for b in range(int(sigma).bit_length() - 1, -1, -1):
            bit = value >> b & 1
            self.levels.append((b, BitRank(bit)))
            self.zeros.append(int((bit == 0).sum()))
            value = np.concatenate([value[bit == 0], value[bit == 1]])
        symbols = np.arange(sigma + 1)
        self.base = self._descend(symbols, np.zeros(sigma + 1, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for (b, bits), zeros in zip(self.levels, self.zeros):
            ones = bits.ones(i)
            i = np.where(c >> b & 1, zeros + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals [low, high) of what each interval's strings are with symbol c before them; empty if there are none."""
        base, first = self.base[c], self.first[c]
        return first + self._descend(c, low) - base, first + self._descend(c, high) - base

    def window_minima(self, queries: list[np.ndarray], window: int = WINDOW) -> list[np.ndarray]:
        """For each window of each query (whose symbols all occur) the smallest value among suffixes that begin with it."""
        order = sorted(range(len(queries)), key=lambda q: -len(queries[q]))
        size = np.array([len(queries[q]) for q in order])
        width = int(size[0])
        grid = np.zeros((len(order), width), np.int64)  # right-aligned
        for row, q in enumerate(order):
            grid[row, width - len(queries[q]) :] = queries[q]
        low, high = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64)
        found = np.full((len(order), width), NEVER, np.int64)
        for t in range(width):
            live = int(np.searchsorted(-size, -t, "left"))  # those longer than t
            low[:live], high[:live] = self.extend(grid[:live, width - 1 - t], low[:live], high[:live])
            if t + 1 >= window:  # the matching statistic is above the threshold
                hit = np.flatnonzero(high[:live] > low[:live])
                found[hit, width - 1 - t] = self.minima[self.run_rank.ones(low[hit] + 1) - 1]
        out: list = [None] * len(queries)
        for row, q in enumerate(order):
            n = len(queries[q])
            out[q] = found[row, width - n : width - window + 1] if n >= window else np.zeros(0, np.int64)
        return out


def shard_minima(texts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each window of each segment (words joined by spaces) the smallest of docs among segments that have it."""
    ids: dict[bytes, int] = {}
    sequences = [np.array([ids.setdefault(w, len(ids) + 1) for w in t.split(b" ")], np.int64) for t in texts]
    index = FMIndex(sequences, len(ids), np.repeat(docs, [len(s) + 1 for s in sequences]))
    return index.window_minima(sequences)


def _chunks(batch, column: int, least: int = 1 << 21):
    """(from, to) of row groups with about that many bytes of text."""
    import pyarrow.compute as pc

    sizes = [v or 0 for v in pc.binary_length(batch.column(column)).to_pylist()]
    at = 0
    while at < len(sizes):
        end, total = at, 0
        while end < len(sizes) and (end == at or total + sizes[end] <= least):
            total += sizes[end]
            end += 1
        yield at, end
        at = end


def digest(words: list[bytes]) -> bytes:
    """Words have no spaces, so equal digests mean equal words."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _to_segments(batches):
    import pyarrow as pa

    for batch in batches:
        for a, b in _chunks(batch, 2):
            words = [words_of(t) for t in batch.column(2).slice(a, b - a).to_pylist()]
            counts = np.array([len(w) for w in words], np.int64)
            doc, start, n, anchor = segments(counts, hash_words([x for w in words for x in w]))
            if len(doc):
                at = pa.array(doc + a)
                content = [digest(words[i][x : x + m]) for i, x, m in zip(doc.tolist(), start.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(content, pa.binary())],
                    names=["d", "tkey", "start", "n", "anchor", "content"],
                )


def _to_words(batches):
    """Of (d, text, places): (anchor, content, low, words) of each place."""
    import pyarrow as pa

    for batch in batches:
        for d, text, places in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = words_of(text)
            parts = [b" ".join(words[p["start"] : p["start"] + p["n"]]) for p in places]
            content = [hashlib.blake2b(p, digest_size=16).digest() for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([p["anchor"] for p in places]), pa.array(content, pa.binary()), pa.array([d] * len(places)), pa.array(parts, pa.binary())], names=["anchor", "content", "low", "words"])


def _to_minima(batches):
    """Of sorted (anchor, content, low, words): (content, minima), by an FM-index for each SHARD_WORDS words of whole anchors."""
    import pyarrow as pa

    def solve(anchor, content, docs, texts):
        minima = shard_minima(texts, np.array(docs, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(content, pa.binary()), pa.array(minima, pa.list_(pa.int64()))], names=["content", "minima"])

    held: list[tuple] = []
    total = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if total >= SHARD_WORDS and row[0] != held[-1][0]:
                yield solve(*zip(*held))
                held, total = [], 0
            held.append(row)
            total += row[3].count(b" ") + 1
    if held:
        yield solve(*zip(*held))


def _to_windows(batches):
    """Of (content, low, words): a row for each window, with its place and digest."""
    import pyarrow as pa

    for batch in batches:
        for content, low, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = text.split(b" ")
            m = len(words) - WINDOW + 1
            windows = [digest(words[i : i + WINDOW]) for i in range(m)]
            yield pa.RecordBatch.from_arrays([pa.array([content] * m, pa.binary()), pa.array([low] * m, pa.int64()), pa.array(np.arange(m, dtype=np.int32)), pa.array(windows, pa.binary())], names=["content", "low", "place", "window"])


def _once(docs: DataFrame) -> DataFrame:
    """docs without repeated rows of (d, tkey)."""
    keys = docs.groupBy("d", "tkey").agg(F.count("*").alias("k")).filter("k > 1")
    keys = write_table(keys, "repeated-rows")
    if keys.isEmpty():
        return docs
    again = broadcast_if_small(keys.select("d", "tkey"))
    first = docs.join(again, ["d", "tkey"], "left_semi").groupBy("d", "tkey").agg(F.min("text").alias("text"))
    return docs.join(again, ["d", "tkey"], "left_anti").unionByName(first)


def repeated_ranges(docs: DataFrame, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """(d, tkey, ranges array<struct<a, b>>): words [a, b) of documents that windows of earlier documents cover, in order and
    apart. From a table keyed by _keyed()."""
    docs = _once(docs)
    seg = write_table(docs.mapInArrow(_to_segments, "d long, tkey binary, start int, n int, anchor long, content binary"), "segments")
    anchors = seg.groupBy("anchor").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("k"))
    anchors = write_table(anchors.filter("low < high").select("anchor", "k"), "anchors")
    shared = write_table(join_counted(seg, anchors, "anchor", "k").filter("k IS NOT NULL").drop("k"), "shared")
    first = F.min(F.struct("d", "tkey", "start", "n")).alias("p")
    contents = write_table(shared.groupBy("anchor", "content").agg(first, F.count("*").alias("m")), "contents")
    kinds = write_table(contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("p.n").alias("total")).filter("kinds > 1"), "kinds")
    several = join_counted(contents.select("anchor", "content", "p"), kinds, "anchor", "kinds").filter("kinds IS NOT NULL")
    several = write_table(several.select("anchor", "content", "p.*", (F.col("total") > anchor_words).alias("wide")), "several")
    # the words of distinct segments come from their smallest document
    wanted = write_table(several.groupBy("d", "tkey").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("places")), "wanted")
    texts = docs.join(broadcast_if_small(wanted), ["d", "tkey"]).select("d", "text", "places")
    texts = write_table(texts.mapInArrow(_to_words, "anchor long, content binary, low long, words binary"), "segment-words")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide_ones = write_table(several.filter("wide").select("anchor").distinct(), "wide-anchors")
    narrow, minima = texts, None
    if not wide_ones.isEmpty():
        side = broadcast_if_small(wide_ones)
        narrow = texts.join(side, "anchor", "left_anti")
        windows = texts.join(side, "anchor", "left_semi").select("content", "low", "words").mapInArrow(_to_windows, "content binary, low long, place int, window binary")
        windows = write_table(windows, "windows")
        least = write_table(windows.groupBy("window").agg(F.min("low").alias("least"), F.count("*").alias("k")), "window-minima")
        back = join_counted(windows.select("content", "place", "window"), least, "window", "k").groupBy("content").agg(F.array_sort(F.collect_list(F.struct("place", "least"))).alias("w"))
        minima = back.select("content", F.col("w.least").alias("minima"))
    found = narrow.repartition(parts, "anchor").sortWithinPartitions("anchor", "content").mapInArrow(_to_minima, "content binary, minima array<long>")
    minima = write_table(found if minima is None else found.unionByName(minima), "minima")
    # only contents of which some document's words go are joined back
    known = contents.select("content", F.col("p.d").alias("low"), F.col("m")).join(minima, "content", "left")
    known = write_table(known.filter("minima IS NOT NULL OR m > 1"), "known")
    rows = join_counted(shared.select("d", "tkey", "start", "n", "content"), known, "content", "m").filter("low IS NOT NULL")
    # of a lone content all windows have its smallest document; windows of one segment that are hit overlap, so the words between are covered too
    alone = F.when(F.col("low") < F.col("d"), F.array(F.lit(0), F.col("n") - WINDOW))
    w = F.coalesce(F.when(F.col("minima").isNull(), alone).otherwise(F.expr("filter(transform(minima, (m, i) -> IF(m < d, i, -1)), i -> i >= 0)")), F.array().cast("array<int>"))
    hits = rows.select("d", "tkey", "start", w.alias("w")).filter("size(w) > 0")
    hits = hits.select("d", "tkey", F.struct((F.col("start") + F.element_at("w", 1)).alias("a"), (F.col("start") + F.element_at("w", -1) + WINDOW).alias("b")).alias("r"))
    return hits.groupBy("d", "tkey").agg(F.collect_set("r").alias("r")).select("d", "tkey", F.expr(_UNITED).alias("ranges"))


_UNITED = """aggregate(array_sort(r), CAST(array() AS array<struct<a: int, b: int>>), (u, x) ->
  IF(size(u) > 0 AND element_at(u, -1).b >= x.a, concat(slice(u, 1, size(u) - 1), array(named_struct('a', element_at(u, -1).a, 'b', greatest(element_at(u, -1).b, x.b)))), concat(u, array(x))))"""


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """d, tkey, text: d orders documents as doc_id does, null last (of all numbers only the two smallest 64-bit ones share a d);
    tkey is a digest of the text."""
    d = F.col("doc_id").cast("long")
    order = F.when(d.isNull(), NEVER).when(d > -(1 << 63), d - 1).otherwise(d)
    return docs.select(order.alias("d"), text_digest().alias("tkey"), text_or_empty().alias("text"), *more)


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text, the words that stay joined by single spaces.

    A word goes if a window of 50 words that covers it also starts in a document with a smaller doc_id. Null texts have no
    words; a text of fewer than 50 words has no window and keeps all. A null doc_id counts as larger than every other, and
    rows with the same doc_id are not earlier than each other. Only doc_id and text are read.
    """
    return _apply(docs, "n_words long, n_removed long, kept_text string", lambda kept: kept.decode(), **options)


def _apply(docs: DataFrame, fields: str, last, **options) -> DataFrame:
    ranges = write_table(repeated_ranges(_keyed(docs), **options), "ranges")
    out = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(fields).fields])
    names = [f.name for f in out.fields]

    def cut(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for batch in batches:
            for a, b in _chunks(batch, 1):
                rows = []
                for text, spans in zip(batch.column(1).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_pylist()):
                    words = words_of(text)
                    gone = 0
                    kept = words
                    if spans:
                        kept, at = [], 0
                        for s in sorted((s["a"], s["b"]) for s in spans):
                            kept += words[at : max(at, s[0])]
                            gone += max(0, s[1] - max(at, s[0]))
                            at = max(at, s[1])
                        kept += words[at:]
                    rows.append((len(words), gone, last(b" ".join(kept))))
                cols = [batch.column(0).slice(a, b - a), *(pa.array(c, schema.field(i + 1).type) for i, c in enumerate(zip(*rows)))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    joined = _keyed(docs, "doc_id").join(broadcast_if_small(ranges), ["d", "tkey"], "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(cut, out)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, removed words and digest of what stays. Null texts have no words, null doc_ids come after all others,
    rows with the same doc_id (ties, repeats) are not earlier than each other; an empty table gives no rows; further columns
    are not read."""
    return _apply(documents(spark, sf_dir), "n_words long, n_removed long, kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT rid, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
gone AS (SELECT DISTINCT rid, unnest(generate_series(i, i + 49)) AS j
   FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS low FROM win) WHERE low IS NOT NULL AND (doc_id IS NULL OR low < doc_id)),
words AS (SELECT rid, unnest(w) AS word, unnest(generate_series(1, len(w))) AS j FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY j) AS body FROM (SELECT * FROM words ANTI JOIN gone USING (rid, j)) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""
