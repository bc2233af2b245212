"""SimHash near-duplicates, found by pigeonring filtering.

Cut a fingerprint into m segments on a ring. If two differ in at most t bits, some start has, for every l, at most l*t/m
differing bits in its first l segments. With m = 4t the first three segments from that start are then equal and the next
four differ in one bit at most, so two adjacent ones of them are equal as well: five equal segments, in 2m layouts. Those
are the index keys. Candidates of a key must pass the chain of budgets before the full Hamming check.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, documents, join_counted, per_document, smallest_labels, write_table

_SALTS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `size` words, A-Z lower-cased, repeats included; fewer words: of them all; none: empty."""
    words = text.encode().lower().split()
    hash64, n = xxhash.xxh64_intdigest, len(words) - size + 1
    if not words:
        return np.zeros(0, np.uint64)
    if n <= 1:
        return np.array([hash64(b" ".join(words), 42)], np.uint64)
    return np.fromiter((hash64(b" ".join(words[i : i + size]), 42) for i in range(n)), np.uint64, n)


def fingerprint(hashes: np.ndarray, views: int = 1) -> bytes:
    """views times 64 bits, big-endian. A bit is set if it is in over half the hashes. View 0 takes the hashes as they are, others mix them anew."""
    if not len(hashes):
        return bytes(8 * views)
    out = []
    for v in range(views):
        h = hashes
        if v:
            h = (h ^ _SALTS[v]) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            h ^= h >> np.uint64(29)
        bits = np.unpackbits(h.byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        out.append(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(h)).tobytes())
    return b"".join(out)


class Ring:
    """Exact search at up to `distance` (1 to 4) bits in 64-bit fingerprints."""

    def __init__(self, distance: int = 2):
        if not 1 <= distance <= 4:
            raise ValueError("distance must be 1 to 4")
        self.distance, self.width, budget = distance, 8, max(distance, 2)
        m = self.m = 4 * budget
        cuts = [64 * i // m for i in range(m + 1)]
        seg = [sum(1 << (63 - b) for b in range(cuts[i], cuts[i + 1])) for i in range(m)]
        self.segments = np.array(seg, np.uint64)
        self.budgets = np.array([budget * (k + 1) // m for k in range(m)])
        self.masks = [sum(seg[(i + k) % m] for k in (0, 1, 2, *tail)) for i in range(m) for tail in ((3, 4), (5, 6))]

    def keys(self, prints: np.ndarray) -> np.ndarray:
        """A row a fingerprint, a column a layout; 64-bit keys mixed with the layout's number (a clash is only one more candidate)."""
        x = prints[:, 0]
        out = np.stack([(x & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15) for mask in self.masks], 1)
        out ^= out >> np.uint64(31)
        return (out & np.uint64((1 << 58) - 1)) | (np.arange(len(self.masks), dtype=np.uint64) << np.uint64(58))

    def near(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of the same key link: the chain of budgets from the key's start first, then the whole distance."""
        x = a[:, 0] ^ b[:, 0]
        start = (keys >> np.uint64(58)).astype(np.int64) // 2
        alive, run = np.arange(len(x)), np.zeros(len(x), np.int64)
        for k in range(self.m):
            part = x[alive] & self.segments[(start[alive] + k) % self.m]
            run = run + np.bitwise_count(part)
            ok = run <= self.budgets[k]
            alive, run = alive[ok], run[ok]
            if not len(alive):
                break
        out = np.zeros(len(x), bool)
        out[alive] = np.bitwise_count(x[alive]) <= self.distance
        return out

    def free_masks(self, key: int) -> list[int]:
        """Every difference of up to `distance` bits outside a key's segments: what a large bucket is probed with, in time linear in its size."""
        fixed = self.masks[key >> 58]
        free = [1 << b for b in range(64) if not fixed >> b & 1]
        return [sum(c) for k in range(1, self.distance + 1) for c in combinations(free, k)]


SMALL, LARGE = 16, 4096


def link_bucket(index, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys, as (row, row of its component's first): at most one a row, none lost."""
    n = len(keys)
    a_all, b_all = [], []
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    size = np.diff(cuts)
    small = np.repeat(size <= SMALL, size)
    for d in range(1, min(SMALL, n)):
        a = np.flatnonzero(small[:-d] & (keys[:-d] == keys[d:]))
        if not len(a):
            break
        ok = index.near(keys[a], prints[a], prints[a + d])
        a_all.append(a[ok])
        b_all.append(a[ok] + d)
    for k in np.flatnonzero(size > SMALL):
        lo, hi = int(cuts[k]), int(cuts[k + 1])
        if hi - lo > LARGE and hasattr(index, "free_masks"):
            order = np.argsort(prints[lo:hi, 0], kind="stable")
            sorted_ = prints[lo:hi, 0][order]
            for mask in index.free_masks(int(keys[lo])):
                want = sorted_ ^ np.uint64(mask)
                at = np.minimum(np.searchsorted(sorted_, want), len(sorted_) - 1)
                hit = np.flatnonzero((sorted_[at] == want) & (want > sorted_))
                a_all.append(order[hit] + lo)
                b_all.append(order[at[hit]] + lo)
            continue
        # breadth first: who is reached is compared no more, so a tight group costs a few passes
        left = np.arange(lo, hi)
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                x = queue.pop()
                ok = index.near(keys[left], np.broadcast_to(prints[x], (len(left), prints.shape[1])), prints[left])
                reached, left = left[ok], left[~ok]
                if len(reached):
                    a_all.append(np.full(len(reached), x))
                    b_all.append(reached)
                    queue.extend(reached.tolist())
    if not a_all:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = smallest_labels(n, np.concatenate(a_all), np.concatenate(b_all))
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def _unpack(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, width // 8)


def link_prints(prints: DataFrame, index) -> DataFrame:
    """(node, root) for each of the distinct fingerprints (fp, hex) that links with another."""
    width = index.width

    def to_keys(batches):
        import pyarrow as pa

        for batch in batches:
            step = max(1, (1 << 20) // width)
            for at in range(0, batch.num_rows, step):
                part = batch.column(0).slice(at, step)
                keys = index.keys(_unpack(part, width)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.take(pa.array(np.repeat(np.arange(len(part)), keys.shape[1])))], names=["key", "raw"])

    def to_links(batches):
        import pyarrow as pa

        def links(keys, prints, raw):
            rows, first = link_bucket(index, keys, prints)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([raw[i] for i in rows.tolist()], pa.binary()), pa.array([raw[i] for i in first.tolist()], pa.binary())], names=["a", "b"])

        keys, raw = np.zeros(0, np.uint64), []
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
            raw += batch.column(1).to_pylist()
            cut = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1])) if len(keys) else 0  # the last key may go on
            if cut:
                yield from links(keys[:cut], _unpack_list(raw[:cut], width), raw[:cut])
                keys, raw = keys[cut:], raw[cut:]
        if raw:
            yield from links(keys, _unpack_list(raw, width), raw)

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = prints.select(F.unhex("fp").alias("raw")).mapInArrow(to_keys, "key long, raw binary")
    links = keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(to_links, "a binary, b binary")
    return components(links.select(F.lower(F.hex("a")).alias("a"), F.lower(F.hex("b")).alias("b")))


def _unpack_list(raw: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(-1, width // 8)


def near_groups(docs: DataFrame, shingle: int = 3, index=None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the carried columns, fp (hex) and component_id, the smallest doc_id reachable over links.

    Texts without words (null, empty, white space) have the fingerprint zero and link like any other. Repeated rows are
    linked. Null doc_ids are never smallest; where a component has no other, component_id is null. No rows give no rows.
    """
    index = index or Ring()
    views = index.width // 8
    prints = per_document(docs, lambda texts: [[fingerprint(shingle_hashes(t, shingle), views).hex() for t in texts]], "fp string", carry=carry)
    prints = write_table(prints, "prints")
    nodes = write_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = write_table(link_prints(nodes, index), "roots")
    rooted = write_table(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = write_table(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("k")), "least")
    named = write_table(join_counted(rooted, least, "root", "k").select("fp", "n", "component_id"), "named")
    return join_counted(prints, named, "fp").drop("n")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and group. Null texts and texts without words have the fingerprint zero; repeated rows and ties
    are linked; null doc_ids are never smallest; an empty table gives no rows; further columns are not read."""
    return near_groups(documents(spark, sf_dir)).select("doc_id", F.col("fp").alias("fingerprint"), "component_id")
