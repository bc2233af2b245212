import random

import numpy as np
import pytest
from pageloom.llm import substring_dedup as sd


def brute(rows):
    order = lambda d: sd.NEVER if d is None else d
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, sd.NEVER), order(d))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < order(d):
                gone.update(range(i, i + 50))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(60))
    passages = [[word() for _ in range(rnd.choice([49, 50, 55, 80, 200]))] for _ in range(6)] + [["la"] * 70, ["a", "b"] * 40]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rnd.randrange(0, 4)):
            w += [word() for _ in range(rnd.randrange(0, 60))] + rnd.choice(passages)
        if rows and rnd.random() < 0.2:
            w = rnd.choice(rows)[1].split()
            if w and rnd.random() < 0.7:
                w[rnd.randrange(len(w))] = "changed"
        rows.append((rnd.randrange(1000), rnd.choice([" ", "\n", "  "]).join(w)))
    return rows + [(None, rows[5][1]), (None, rows[5][1]), (2000, None), (2001, ""), (rows[3][0], rows[3][1])]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {}), (3, {"anchor_words": 150}), (4, {"anchor_words": 0})])
def test_equals_brute_force(spark, seed, options):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, words string")
    assert sorted((tuple(r) for r in sd.remove_repeats(df, **options).collect()), key=str) == brute(rows)


def test_largest_and_smallest_ids_and_nulls(spark):
    top, passage = (1 << 63) - 1, " ".join(f"w{i}" for i in range(60))
    rows = [(top, passage), (None, passage + " tail"), (-(1 << 63), "head " + passage), (top - 1, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in sd.remove_repeats(df).collect()} == {top: 60, None: 60, -(1 << 63): 0, top - 1: 60}
    assert {r.doc_id: r.n_removed for r in sd.remove_repeats(df.filter("doc_id > 0 OR doc_id IS NULL")).collect()} == {top: 60, None: 60, top - 1: 0}


def test_long_text_and_many_repeated_rows(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(150_000))
    rows = [(1, long, 0, ""), (2, long + " more", 0, ""), *[(3, " ".join(f"w{i}" for i in range(500, 600)), 0, "")] * 200, (4, "x " * 100, 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, d int, tkey string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in sd.remove_repeats(df).collect())
    assert got == [(1, 150_000, 0), (2, 150_001, 150_000), *[(3, 100, 100)] * 200, (4, 100, 0)]


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fm_index_counts_and_minima():
    rng = np.random.default_rng(5)
    seqs = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(40)]
    value = rng.integers(0, 100, 40)
    fm = sd.FMIndex(seqs, 3, np.repeat(value, [len(s) + 1 for s in seqs]), window=5)
    flat = [s.tolist() for s in seqs]
    for _ in range(200):
        p = rng.integers(1, 4, rng.integers(1, 6)).tolist()
        low, high = np.array([0]), np.array([fm.n])
        for c in reversed(p):
            low, high = fm.extend(np.array([c]), low, high)
        assert max(0, int((high - low)[0])) == sum(s[i : i + len(p)] == p for s in flat for i in range(len(s)))
    got = fm.window_minima(seqs, window=5)
    for s, g in zip(flat, got):
        want = [min(int(value[j]) for j, t in enumerate(flat) if any(t[k : k + 5] == s[i : i + 5] for k in range(len(t)))) for i in range(len(s) - 4)]
        assert g.tolist() == want
