import math

import numpy as np
import pytest
from pageloom.llm import neighbours as nb


def exact(ids, x, qid, q, k=10):
    d = np.sqrt(((x - q) ** 2).sum(1))
    rows = sorted((s, i) for s, i in zip(d.tolist(), ids.tolist()) if i != qid)
    return rows[:k]


@pytest.mark.parametrize("kind", ["sphere", "clusters"])
def test_recall_and_scores(spark, kind, monkeypatch):
    monkeypatch.setattr(nb, "SHARD_ROWS", 700)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 32)) if kind == "sphere" else rng.normal(size=(20, 32)).repeat(100, 0) + 0.2 * rng.normal(size=(2000, 32))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in nb.nearest(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    xd, ids, hits = x.astype(np.float64), np.arange(2000), 0
    assert len(got) == 40
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [r[2] for r in rows] == sorted(r[2] for r in rows)
        want = exact(ids, xd, q, xd[q])
        hits += len({r[1] for r in rows} & {i for _, i in want})
        for _, i, s in rows:
            assert s == pytest.approx(np.sqrt(((xd[i] - xd[q]) ** 2).sum()), rel=1e-12)
    assert hits / 400 >= 0.93


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 16))
    book = nb.learn(x, bits=64)
    shard = nb.Shard(book, np.arange(500), x)
    for r in (0, 1, 2, 5, 11, 20, 40):
        for q in range(0, 500, 50):
            want = np.flatnonzero(np.bitwise_count(shard.code ^ shard.code[q]).sum(1) <= r)
            assert set(want) <= set(shard.probe(shard.code[q], r))


def test_probing_reaches_a_small_share_of_rows():
    """Even where nothing clusters: points all over a sphere of 64 dimensions."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    shard = nb.Shard(nb.learn(x[:16_384]), np.arange(len(x)), x)
    reached, hits = [], 0
    for q in range(0, len(x), 400):
        at = shard.probe(shard.code[q], shard.book.radius)
        reached.append(len(at) / len(x))
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & set(at.tolist()))
    assert np.mean(reached) < 0.25 and hits / (10 * len(reached)) >= 0.93


def test_wide_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3000)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert nb.nearest(df, df.filter("vec_id = 7")).count() == 10


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [2.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (9, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", nb.F.lit("x"))
    out = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nb.nearest(df, df.filter("vec_id % 100 = 0")).collect())
    assert [o[:3] for o in out if o[0] == 0] == [(0, 1, 1), (0, 2, 8), (0, 3, 7), (0, 4, 100), (0, 5, 100)]
    assert [(o[2], o[3]) for o in out if o[0] == 100] == [(100, 0.0), (0, math.sqrt(2)), (1, math.sqrt(2)), (8, math.sqrt(2)), (7, math.sqrt(5))]
    assert nb.nearest(df.limit(0), df).count() == 0
    assert nb.nearest(df.filter("vec_id = 0"), df.filter("vec_id = 0")).count() == 0
