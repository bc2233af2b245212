"""Near-duplicates against brute-force Jaccard links and plain components."""

import random

import numpy as np
import pytest
from pageloom.llm import near_dedup as nd


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows):
    """doc_ids that stay, in order; rows are (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=str)


def corpus(seed, groups=25, each=8):
    """Copies with few to many edits, so that similarities lie on both sides of the threshold; a passage that most texts share."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(40)]
    rows = []
    for g in range(groups):
        w = [word() for _ in range(rnd.choice([6, 30, 120, 300]))]
        if g % 2:
            w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
        for c in range(each):
            v = list(w)
            for _ in range(rnd.randrange(0, max(2, len(w) // 40))):
                v[rnd.randrange(len(v))] = word()
            rows.append((g * 100 + c, " ".join(v)))
    for k in range(6):  # little but the passage
        rows.append((9000 + k, " ".join([*passage, word()])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"common": 3}, {"common": 3, "part_docs": 4}])
def test_groups_equal_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(nd, "SHARED_DOCS", 1)
    rows = corpus(5)
    rows += [(None, "only here and without any id"), (7000, None), (7001, ""), (7002, " \n"), (None, None), (None, rows[0][1]), rows[1], rows[1]]
    df = spark.createDataFrame([(d, t, "s", 1, 2) for d, t in rows], "doc_id long, text string, _node string, _lead int, node int")
    out = nd.drop_near(df, **options)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("limit", [8, 0])
def test_one_large_group_of_near_copies(spark, limit, monkeypatch):
    """A chain and a cloud of copies around one text: parts see but some of them, and visits link the rest."""
    monkeypatch.setattr(nd, "SHARED_DOCS", 1)
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        v = list(base)
        v[rnd.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(v)))
    step = list(base)
    for i in range(60, 90):  # each one word further from the text, so only neighbours link
        step[(7 * i) % 100] = f"y{i}"
        rows.append((i, " ".join(step)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part_docs in (2048, 7):
        assert sorted(r.doc_id for r in nd.drop_near(df, common=20, part_docs=part_docs, pairs_each=limit).collect()) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert nd.drop_near(df).count() == 0


def test_chain_passes_all_within_the_distance_and_nothing_beyond():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, (4000, 4), dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(256, int(rng.integers(0, 100)), replace=False):
            b[i, bit // 64] ^= np.uint64(1 << int(bit % 64))
    d = np.bitwise_count(a ^ b).sum(1)
    assert (nd.Chain(64).near(a, b) == (d <= 64)).all()


def test_long_text_and_repeated_words(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, long), (2, long + " tail"), (3, "a " * 30_000), (4, "a a a a a"), (5, "a a a a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in nd.drop_near(df).collect()) == brute(rows)
