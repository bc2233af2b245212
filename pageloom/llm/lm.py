"""Language-model scores: context-tree weighting over bytes, each byte decomposed into eight binary decisions.

A node is a context (the last d bytes, d from 0 to the depth) and the bits of the next byte so far. It holds how often a 0
and a 1 followed in training, and so a Krichevsky-Trofimov estimate. A node's weighted probability is half its own
estimate's and half the product of its children's; that fixes how much of a prediction each depth gives.

Every byte string of a context and its next byte that occurs in any document is counted, with a count of 0 if only
held-out documents have it, so no node that scoring meets is missing. Weights go up the tree a depth a stage: the two
deepest where a context's counts lie (at most 65,536 a context), the others as grouped sums. What the upper depths give to
a prediction then goes down as three coefficients a node, which yields the probability of every byte string in double
precision. The most frequent strings, a fixed number, are looked up in the scoring workers; all others are joined.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, per_document, write_table

DEPTH = 5
END = b"\xff"  # no byte of UTF-8
#: Strings and words whose values every scoring worker holds. Fixed, whatever the corpus has.
TOP_GRAMS, TOP_WORDS = 1 << 20, 200_000
_LOG_HALF = float(np.log(0.5))


def normal_form(text: str) -> list[bytes]:
    """The text's words, A-Z lower-cased; the model sees them joined by single spaces, then an end mark."""
    return text.encode().lower().split()


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings of depth context bytes and the next one, as integers, for every position and the end mark of each text;
    and from where to where they stand for each text. Those between belong to none."""
    buf = np.frombuffer(b"".join(END * depth + t + END for t in texts), np.uint8).astype(np.int64)
    n = len(buf) - depth
    out = np.zeros(n, np.int64)
    for k in range(depth + 1):
        out = out << 8 | buf[k : n + k]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begin = np.concatenate([[0], np.cumsum(size + depth)[:-1]])
    return out, begin, begin + size


def _own(values: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Which places belong to a text."""
    keep = np.ones(len(values), bool)
    for k in range(depth):
        at = end + k
        keep[at[at < len(values)]] = False
    return keep


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For positive x."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of n0 zeros and n1 ones in any order under the Krichevsky-Trofimov estimator."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1.0)


def log_weighted(n0: np.ndarray, n1: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Log weighted probability of nodes above the deepest; children: the sum of theirs."""
    return np.logaddexp(log_kt(n0, n1), children) + _LOG_HALF


def own_share(n0: np.ndarray, n1: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The share of a prediction that is a node's own, from its log weighted probability."""
    return np.exp(np.minimum(log_kt(n0, n1) + _LOG_HALF - total, 0.0))


def _group(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return (k[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in columns))


def deep_nodes(gram: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, n0, n1, log weighted) of the nodes one above the deepest, from all strings under complete contexts of that depth.
    A key is the context, eight bits further up, and the bits so far after a leading 1."""
    ctx, x = gram >> 8, gram & 255
    keys = np.concatenate([ctx << 8 | 1 << k | x >> (8 - k) for k in range(8)])
    bit = np.concatenate([x >> (7 - k) & 1 for k in range(8)])
    c = np.tile(n, 8).astype(float)
    keys, n0, n1 = _group(keys, c * (1 - bit), c * bit)
    keys, n0, n1, low = _group(keys & ((1 << 8 * depth) - 1), n0, n1, log_kt(n0, n1))
    return keys, n0, n1, log_weighted(n0, n1, low)


def in_training() -> F.Column:
    """Texts are learned from unless they are held out: crc32 of doc_id mod 10 is 0. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(True))


def gather(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, word, n) over all texts of docs (learn boolean, text): gram is a string of depth+1 bytes as an integer, or else
    word a word (empty: the end token); n counts those of texts to learn from, so grams may have 0. A written table."""

    def count(batches):
        import pyarrow as pa

        words: Counter = Counter()
        seen, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows(words, seen, n):
            for at in range(0, len(seen), 1 << 18):
                g = pa.array(seen[at : at + (1 << 18)])
                yield pa.RecordBatch.from_arrays([g, pa.nulls(len(g), pa.binary()), pa.array(n[at : at + (1 << 18)])], names=["gram", "word", "n"])
            items = list(words.items())
            for at in range(0, len(items), 100_000):
                part = items[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], names=["gram", "word", "n"])

        for batch in batches:
            learn, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            chunk: list[list[bytes]] = [[], []]
            size = 0
            for i, (y, t) in enumerate(zip(learn, texts)):
                w = normal_form(t or "")
                if y:
                    words.update(w)
                    words[b""] += 1
                chunk[y].append(b" ".join(w))
                size += len(chunk[y][-1])
                if size > 1 << 20 or i == len(texts) - 1:
                    parts = [(seen, n)]
                    for y_, plain in enumerate(chunk):
                        if plain:
                            g, _, end = grams(plain, depth)
                            g, c = np.unique(g[_own(g, end, depth)], return_counts=True)
                            parts.append((g, c * y_))
                    seen, n = _group(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                    chunk, size = [[], []], 0
            if len(words) > 600_000 or len(seen) > 2_000_000:  # a task's memory is bounded; the sum is the same
                yield from rows(words, seen, n)
                words, seen, n = Counter(), seen[:0], n[:0]
        yield from rows(words, seen, n)
        give_back()

    counted = docs.select("learn", "text").mapInArrow(count, "gram long, word binary, n long")
    return write_table(counted.groupBy("gram", "word").agg(F.sum("n").alias("n")), "lm-counts")


def _lists(flat: list[np.ndarray], size: np.ndarray):
    import pyarrow as pa

    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in flat]


_CONTEXTS = "low long, gram array<long>, n array<long>, node array<int>, n0 array<double>, n1 array<double>, total array<double>"


def _contexts(counts: DataFrame, depth: int) -> DataFrame:
    """A row for each context one shorter than the deepest: the strings under it with their counts, and its nodes."""
    mask = (1 << 8 * (depth - 1)) - 1
    rows = counts.filter("gram IS NOT NULL").select(F.expr(f"(gram >> 8) & {mask}L").alias("low"), "gram", "n")

    def build(batches):
        import pyarrow as pa

        def emit(low, gram, n):
            first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            keys, n0, n1, total = deep_nodes(gram, n, depth)
            at = np.searchsorted(keys >> 8, low[first])
            per_low = np.diff(np.append(at, len(keys)))
            columns = [pa.array(low[first]), *_lists([gram, n], np.diff(np.append(first, len(low)))), *_lists([(keys & 255).astype(np.int32), n0, n1, total], per_low)]
            yield from pa.Table.from_arrays(columns, names=["low", "gram", "n", "node", "n0", "n1", "total"]).to_batches(max_chunksize=4096)

        low, gram, n = (np.zeros(0, np.int64) for _ in range(3))
        for b in batches:
            parts = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            low, gram, n = (np.concatenate(x) for x in zip((low, gram, n), parts))
            if len(low) > 100_000 and (cut := int(np.searchsorted(low, low[-1]))):  # whole contexts only
                yield from emit(low[:cut], gram[:cut], n[:cut])
                low, gram, n = low[cut:], gram[cut:], n[cut:]
        if len(low):
            yield from emit(low, gram, n)

    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return write_table(rows.repartition(parts, "low").sortWithinPartitions("low", "gram").mapInArrow(build, _CONTEXTS), "lm-contexts")


def _level(children: DataFrame, depth: int) -> DataFrame:
    """Nodes (ctx, node, n0, n1, own, total) of a depth, from (ctx, node, n0, n1, total) of the one below it. A written table."""
    mask = (1 << 8 * depth) - 1
    summed = children.groupBy(F.expr(f"ctx & {mask}L").alias("ctx"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("total").alias("low"))

    def weigh(batches):
        import pyarrow as pa

        for b in batches:
            n0, n1, low = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            total = log_weighted(n0, n1, low)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(own_share(n0, n1, total)), pa.array(total)], names=["ctx", "node", "n0", "n1", "own", "total"])

    return write_table(summed.mapInArrow(weigh, "ctx long, node int, n0 double, n1 double, own double, total double"), "lm-level")


def gram_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, n, logp) of every string of counts: log10 of its last byte's probability after the others. A written table."""
    contexts = _contexts(counts, depth)
    nodes = contexts.select(F.col("low").alias("ctx"), F.explode(F.arrays_zip("node", "n0", "n1", "total")).alias("x")).select("ctx", "x.*")
    levels = []
    for d in range(depth - 2, -1, -1):
        levels.append(_level(nodes if not levels else levels[-1].select("ctx", "node", "n0", "n1", "total"), d))
    # p of a bit = a0 or a1 + b * p at the next depth; down from the root
    given = "{a} + {b} * own * ({n} + 0.5) / (n0 + n1 + 1) AS {name}"
    whole = levels[-1].selectExpr("ctx", "node", given.format(a="0D", b="1D", n="n0", name="a0"), given.format(a="0D", b="1D", n="n1", name="a1"), "1 - own AS b")
    for d in range(1, depth - 1):
        level = levels[-1 - d].withColumn("up", F.expr(f"ctx & {(1 << 8 * (d - 1)) - 1}L"))
        met = level.join(whole.withColumnRenamed("ctx", "up"), ["up", "node"])
        whole = met.selectExpr("ctx", "node", given.format(a="a0", b="b", n="n0", name="a0"), given.format(a="a1", b="b", n="n1", name="a1"), "b * (1 - own) AS b")
        whole = write_table(whole, "lm-shares")
    packed = whole.groupBy(F.col("ctx").alias("up")).agg(*(F.collect_list(c).alias(f"up_{c}") for c in ("node", "a0", "a1", "b")))  # at most 255 a context
    asked = contexts.withColumn("up", F.expr(f"low & {(1 << 8 * (depth - 2)) - 1}L"))
    met = asked.join(packed, "up").select("gram", "n", "node", "n0", "n1", "total", "up_node", "up_a0", "up_a1", "up_b")

    def flat(column, a, b):
        part = column.slice(a, b - a)
        return part.flatten().to_numpy(zero_copy_only=False), np.diff(part.offsets.to_numpy())

    def predict(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            cuts = np.unique(np.append(np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), 1 << 17), "right"), batch.num_rows)) if len(sizes) else ()
            for a, b in zip(cuts[:-1], cuts[1:]):
                a, b = int(a), int(b)
                gram, k = flat(batch.column(0), a, b)
                n = flat(batch.column(1), a, b)[0].astype(float)
                node, k_node = flat(batch.column(2), a, b)
                n0, n1, total = (flat(batch.column(i), a, b)[0] for i in (3, 4, 5))
                up, k_up = flat(batch.column(6), a, b)
                a0, a1, share = (flat(batch.column(i), a, b)[0] for i in (7, 8, 9))
                row = np.repeat(np.arange(b - a), k)
                own = own_share(n0, n1, total)
                here, above = np.zeros((b - a) * 256, np.int64), np.zeros((b - a) * 256, np.int64)
                here[np.repeat(np.arange(b - a), k_node) * 256 + node] = np.arange(len(node))
                above[np.repeat(np.arange(b - a), k_up) * 256 + up] = np.arange(len(up))
                x, out = gram & 255, np.zeros(len(gram))
                for j in range(8):
                    bits, bit = 1 << j | x >> (8 - j), (x >> (7 - j) & 1).astype(bool)
                    i, u = here[row * 256 + bits], above[row * 256 + bits]
                    prefix = gram >> (8 - j)  # strings are sorted in a row, so those of a deepest node stand together
                    new = np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (row[1:] != row[:-1])])
                    first, which = np.flatnonzero(new), np.cumsum(new) - 1
                    both, ones = np.add.reduceat(n, first)[which], np.add.reduceat(n * bit, first)[which]
                    p = (np.where(bit, ones, both - ones) + 0.5) / (both + 1)
                    p = own[i] * (np.where(bit, n1[i], n0[i]) + 0.5) / (n0[i] + n1[i] + 1) + (1 - own[i]) * p
                    out += np.log10(np.where(bit, a1[u], a0[u]) + share[u] * p)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64)), pa.array(out)], names=["gram", "n", "logp"])

    return write_table(met.mapInArrow(predict, "gram long, n long, logp double"), "lm-grams")


def most_frequent(scores: DataFrame, top: int = TOP_GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(gram, logp) of the strings seen most often: at most top, those at or above one count."""
    bins = scores.filter("n > 0").groupBy(F.floor(F.log2("n") * 64).alias("bin")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()  # at most 64 * 64
    least, total = None, 0
    for r in bins:
        total += r.k
        if total > top:
            break
        least = r.least
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0)
    got = scores.filter(F.col("n") >= least).select("gram", "logp").toArrow()  # at most top rows
    return got.column("gram").to_numpy(), got.column("logp").to_numpy()


class Table:
    """Vectorised look-up of 64-bit keys: open addressing in two slots a key and more."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) - 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            empty = self.keys[at] == -1
            self.keys[at[empty]] = keys[left[empty]]
            placed = self.keys[at] == keys[left]
            self.values[at[placed]] = values[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 where there is none; whether there is one)."""
        at = self._slot(keys)
        got = self.keys[at]
        found = got == keys
        out = np.where(found, self.values[at], 0.0)
        left = np.flatnonzero(~found & (got != -1))
        while len(left):
            at_left = (at[left] + 1) & ((1 << self.bits) - 1)
            at[left] = at_left
            got = self.keys[at_left]
            hit = got == keys[left]
            out[left[hit]] = self.values[at_left[hit]]
            found[left[hit]] = True
            left = left[~hit & (got != -1)]
        return out, found


_tables: dict = {}


def score_documents(docs: DataFrame, depth: int = DEPTH, top_words: int = TOP_WORDS, top_grams: int = TOP_GRAMS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Null and empty texts are the end token alone. Without training texts every token is unknown, base scores are those of
    zero counts (log10 of 0.1/0.1 = 0) and the model is uniform over bits. Repeated rows count and are scored as often as
    they are there. The most frequent words and strings (a fixed number of each) are looked up in the workers; all
    others, none of which can be a hot key then, are joined. An empty table gives no rows; only doc_id and text are read.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", in_training().alias("learn"))
    counts = gather(docs, depth)
    words = counts.filter("word IS NOT NULL").select("word", F.col("n").alias("c"))
    n_all, v_all = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    floor = n_all + 0.1 * (v_all + 1)
    table = words.orderBy(F.desc("c"), "word").limit(top_words).toArrow()
    known = dict(zip(table.column("word").to_pylist(), table.column("c").to_pylist()))
    scores = gram_scores(counts, depth)
    run = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((*most_frequent(scores, top_grams), known))

    def compute(texts):
        keys, values, known = shared.value
        if run not in _tables:  # once a worker
            _tables.clear()
            _tables[run] = Table(keys, values)
        out = ([], [], [], [], [], [])
        tokens = [normal_form(t) for t in texts]
        plain = [b" ".join(w) for w in tokens]
        get = known.get
        for w, p in zip(tokens, plain):
            n_known, base = 0, 0.0
            seen = Counter(w)
            seen[b""] = 1
            pairs = [(k, c, get(k)) for k, c in seen.items()]
            hit = [(c, f) for _, c, f in pairs if f is not None]
            if hit:
                a = np.array(hit, float)
                base, n_known = float(a[:, 0] @ np.log10((a[:, 1] + 0.1) / floor)), int(a[:, 0].sum())
            rest = [(k, c) for k, c, f in pairs if f is None]
            for col, v in zip(out, (len(w) + 1, n_known, base, len(p) + 1, [k for k, _ in rest], [c for _, c in rest])):
                col.append(v)
        g, begin, end = grams(plain, depth)
        value, found = _tables[run].find(g)
        cuts = np.stack([begin, end], 1).ravel()[:-1]
        score = np.add.reduceat(value, cuts)[::2]
        miss = np.flatnonzero(~found & _own(g, end, depth))
        which = np.searchsorted(begin, miss, "right") - 1
        order = np.lexsort((g[miss], which))
        which, rare = which[order], g[miss][order]
        first = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (rare[1:] != rare[:-1])])) if len(rare) else np.zeros(0, np.int64)
        k = np.diff(np.append(first, len(rare)))
        at = np.searchsorted(which[first], np.arange(len(texts) + 1))
        spans = list(zip(at[:-1].tolist(), at[1:].tolist()))
        return [*out[:4], score, *out[4:], [rare[first[a:b]] for a, b in spans], [k[a:b] for a, b in spans]]

    fields = "n_tokens long, n_top long, base_top double, n_bytes long, score_top double, rest array<binary>, rest_n array<int>, rare array<long>, rare_n array<int>"
    scored = write_table(per_document(docs, compute, fields, chunk_chars=1 << 19, carry=("doc_id", "learn")).withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
    none = F.lit(None).cast("double")
    rest = scored.select("_row", F.explode(F.arrays_zip("rest", "rest_n")).alias("r")).select("_row", F.col("r.rest").alias("word"), F.col("r.rest_n").alias("k"))
    by_word = rest.join(words, "word", "left").select(
        "_row", (F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(floor))).alias("b"), F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0).cast("long").alias("kn"), none.alias("s")
    )
    rare = scored.select("_row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("_row", F.col("r.rare").alias("gram"), F.col("r.rare_n").alias("k"))
    by_gram = rare.join(scores.select("gram", "logp"), "gram").select("_row", none.alias("b"), F.lit(0).cast("long").alias("kn"), (F.col("k") * F.col("logp")).alias("s"))
    kind = scored.select("_row", F.col("base_top").alias("b"), F.col("n_top").alias("kn"), F.col("score_top").alias("s"), F.struct("doc_id", "learn", "n_tokens", "n_bytes").alias("d"))
    both = by_word.unionByName(by_gram).withColumn("d", F.lit(None).cast(kind.schema["d"].dataType)).unionByName(kind)
    out = both.groupBy("_row").agg(F.sum("b").alias("base_score"), F.sum("kn").alias("n_known"), F.sum("s").alias("score"), F.first("d", ignorenulls=True).alias("d"))
    return out.select(
        "d.doc_id", (~F.col("d.learn")).alias("held_out"), "d.n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", "d.n_bytes",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.col("d.n_bytes")).alias("bits_per_byte"),
    )


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and model score. Null texts are empty; ties and repeated rows are scored alike, each once a row;
    null doc_ids are learned from; an empty table gives no rows; further columns are not read."""
    return score_documents(documents(spark, sf_dir))
