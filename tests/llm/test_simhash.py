import random

import numpy as np
import pytest
import xxhash
from pageloom.llm import simhash as s
from pageloom.llm.common import smallest_labels


def brute(rows, distance=2):
    def fp(text):
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= distance:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def test_groups_equal_brute_force(spark):
    rnd = random.Random(1)
    base = [[rnd.choice("abcdefghij") * rnd.randrange(1, 4) for _ in range(rnd.randrange(0, 60))] for _ in range(12)]
    rows = []
    for i in range(70):
        w = list(rnd.choice(base))
        if w and rnd.random() < 0.5:
            w[rnd.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w)))
    rows += [(None, None), (200, ""), (201, " \t"), (3, rows[3][1]), (300, "One"), (301, "one\n"), (302, "one two")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in s.near_groups(df).collect()), key=str)
    assert got == brute(rows)
    assert s.near_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("distance", [1, 2, 3])
@pytest.mark.parametrize("large", [4096, 20])
def test_ring_loses_no_link(distance, large, monkeypatch):
    monkeypatch.setattr(s, "LARGE", large)
    rng = np.random.default_rng(distance)
    x = rng.integers(0, 2**63, 40, dtype=np.uint64)
    for _ in range(12):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False)) for _ in range(len(x))], np.uint64)
        x = np.unique(np.concatenate([x, x[rng.random(len(x)) < 0.4] ^ flips[: int((rng.random(len(x)) < 0.4).sum())][:1]]))
    ring = s.Ring(distance)
    keys = ring.keys(x[:, None])
    k, who = keys.ravel(), np.repeat(np.arange(len(x)), keys.shape[1])
    order = np.argsort(k, kind="stable")
    a, b = s.link_bucket(ring, k[order], x[who[order]][:, None])
    got = smallest_labels(len(x), who[order][a], who[order][b])
    d = np.bitwise_count(x[:, None] ^ x[None])
    i, j = np.nonzero(d <= distance)
    assert (got == smallest_labels(len(x), i, j)).all()


def test_long_text_and_clashing_columns(spark):
    long = " ".join(f"w{i % 9000}" for i in range(120_000))
    rows = [(1, long), (2, long + " x"), (3, "other words here"), (None, long)]
    df = spark.createDataFrame([(d, t, "m", "m", 1, 1) for d, t in rows], "doc_id long, text string, component_id string, node string, n int, k int")
    got = {(r.doc_id, r.component_id) for r in s.near_groups(df).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (3, 3)}
