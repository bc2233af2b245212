"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes are signs of centred vectors under rotations learned by alternating between codes and the best rotation to them,
on a bounded sample. They are split into substrings of 16 bits, and in a shard of rows every substring has a directory
from value to rows. Two codes within radius r differ in at most r // m bits in one of m substrings (and, since not all can
reach that, in one bit less in those after the first r % m + 1), so probing those values finds every code in the radius.
Most of a query's neighbours lie beyond it, but agree well in some substring, and are found as well: the radius is the
smallest that reaches the wanted share of the sample's own neighbours. Floats rerank all that is found.

Rows are dealt to shards once, and a shard's index is built once; all queries stream past it. Nothing but a shard's best
leaves it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import write_table

#: Rows of a shard: its vectors, codes and directories are held by one worker.
SHARD_ROWS = 1 << 17
WIDTH = 16
_FLIPS = np.argsort(np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint32)), kind="stable").astype(np.uint16)
_UPTO = np.cumsum(np.bincount(np.bitwise_count(_FLIPS), minlength=WIDTH + 1))


def radii(radius: int, m: int) -> np.ndarray:
    """How many bits each of m substrings may differ for all codes within the radius to be found; -1: not probed."""
    a, b = divmod(radius, m)
    return np.where(np.arange(m) <= b, a, a - 1)


@dataclass
class Codebook:
    """Learned on the driver: centre, rotations (dim x bits), and the radius that reaches the wanted share of the sample's own neighbours."""

    centre: np.ndarray
    rotation: np.ndarray
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Rows x substrings, 16 bits each."""
        return np.packbits((x - self.centre) @ self.rotation > 0, axis=1).view(np.uint16)


def learn(sample: np.ndarray, bits: int = 1024, k: int = 10, inside: float = 0.93, rounds: int = 15, seed: int = 7) -> Codebook:
    """From a bounded sample (rows x dim). The radius reaches the share `inside` of the sample's k nearest neighbours; a larger
    corpus has nearer ones, so its recall is no lower. bits is a multiple of 16."""
    n, dim = sample.shape
    rng, centre = np.random.default_rng(seed), sample.mean(0) if n else np.zeros(dim)
    x, parts = sample - centre, []
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds if n > 1 else 0):
            u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ vt).T
        parts.append(r)
    book = Codebook(centre, np.concatenate(parts, 1)[:, :bits], bits)
    if n > 1:
        ask = sample[: min(n, 512)]
        d = (ask**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * ask @ sample.T
        d[np.arange(len(ask)), np.arange(len(ask))] = np.inf
        near = np.argpartition(d, min(k, n - 1) - 1, 1)[:, : min(k, n - 1)]
        c = book.codes(sample)
        m = c.shape[1]
        apart = np.bitwise_count(c[: len(ask), None] ^ c[near]).astype(np.int64)
        needed = (apart * m + np.arange(m)).min(2)  # the least radius at which some substring finds it
        book.radius = int(np.quantile(needed, inside, method="higher"))
    return book


class Shard:
    """The multi-index of some rows: for each substring the rows in order of its value, and where each value begins."""

    def __init__(self, book: Codebook, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")  # ties in distance then go to the smaller id
        self.book, self.ids, self.x = book, ids[order], x[order]
        self.code = np.concatenate([book.codes(part) for part in np.array_split(self.x, 1 + len(self.x) // 4096)])
        self.m = self.code.shape[1]
        self.rows = [np.argsort(self.code[:, t], kind="stable").astype(np.int32) for t in range(self.m)]
        self.begin = [np.searchsorted(self.code[self.rows[t], t], np.arange((1 << WIDTH) + 1)).astype(np.int32) for t in range(self.m)]

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows that some substring finds, every one within the radius among them."""
        seen = np.zeros(len(self.ids), bool)
        for t, r in enumerate(radii(radius, self.m).tolist()):
            if r < 0:
                break
            want = (code[t] ^ _FLIPS[: _UPTO[min(r, WIDTH)]]).astype(np.int64)
            a = self.begin[t][want]
            n = self.begin[t][want + 1] - a
            some = n > 0
            a, n = a[some], n[some]
            if len(n):
                seen[self.rows[t][np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]] = True
        return np.flatnonzero(seen)

    def nearest(self, vec_id: int, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest rows of this shard that are found, the query's own row left out. The radius doubles
        while it holds fewer than k."""
        code, radius, bits = self.book.codes(v[None])[0], self.book.radius, self.m * WIDTH
        lo, hi = np.searchsorted(self.ids, vec_id), np.searchsorted(self.ids, vec_id, "right")
        same = lo + np.flatnonzero((self.x[lo:hi] == v).all(1))
        least = min(k, len(self.ids) - min(1, len(same)))
        while True:
            at = self.probe(code, radius)
            at = at[at != same[0]] if len(same) else at
            if len(at) >= least:
                break
            radius = min(2 * radius + 1, bits)
        d = np.sqrt(((self.x[at] - v) ** 2).sum(1))
        if len(d) > k:
            some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
            at, d = at[some], d[some]
        best = np.argsort(d, kind="stable")[:k]
        return self.ids[at[best]], d[best]


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part: an id, and a vector of the table's most common length that
    is not zero and has only finite numbers."""
    x = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    x = x.filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity')) AND exists(embedding, e -> e <> 0)")
    dim = x.select(F.mode(F.size("embedding"), True)).first()[0]
    return x.filter(F.size("embedding") == (dim or 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int = 1024, sample_values: int = 1 << 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest vectors by Euclidean distance, ties to smaller vec_id.

    Both tables have (vec_id, embedding). A query's own row, one with its vec_id and vector, is no candidate; other rows
    with its vec_id are. A vec_id that several queries have is asked once, with the smallest of their vectors; a repeated
    candidate counts as often as it is there. Invalid vectors (see valid_vectors) take no part; without candidates or
    queries there are no rows. The codes are learned on the first sample_values / dim vectors by a hash of vec_id; every
    vector is indexed.
    """
    spark = vectors.sparkSession
    x = write_table(valid_vectors(vectors), "vectors")
    first = x.first()
    schema = "query_id long, rank int, vec_id long, score double"
    if first is None:
        return spark.createDataFrame([], schema)
    dim = len(first.embedding)
    sample = x.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(max(64, sample_values // dim)).collect()  # bounded
    book = spark.sparkContext.broadcast(learn(np.array([r.embedding for r in sample]), bits, k))
    asked = valid_vectors(queries).filter(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    shards = -(-x.count() // SHARD_ROWS)
    dealt = x.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "embedding")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "embedding")

    def search(batches):
        import pyarrow as pa

        index, at, held = None, None, []
        for batch in batches:
            numbers, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            ids, flat = batch.column(2).to_numpy(), batch.column(3).flatten().to_numpy().reshape(-1, dim)
            change = np.flatnonzero((numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(ids)]):
                if a == b:
                    continue
                if numbers[a] != at:  # a shard's vectors come first
                    index, at, held = None, numbers[a], []
                if not asks[a]:
                    held.append((ids[a:b].copy(), flat[a:b].copy()))
                    continue
                if index is None:
                    if not held:
                        continue
                    index, held = Shard(book.value, *(np.concatenate(c) for c in zip(*held))), []
                found = [index.nearest(int(i), v, k) for i, v in zip(ids[a:b], flat[a:b])]
                n = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:b], n)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], names=["query_id", "vec_id", "score"])

    both = dealt.unionByName(asked).repartition(max(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard").sortWithinPartitions("shard", "asks")
    best = both.mapInArrow(search, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose vec_id is divisible by 100. Ties go to the smaller vec_id; null, zero and not finite
    vectors and null ids take no part; repeated rows are candidates each; an empty table gives no rows."""
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(x, x.filter("vec_id % 100 = 0"))
