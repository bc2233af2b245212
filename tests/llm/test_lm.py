import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pageloom.llm import lm


def brute_ctw(train, texts):
    """Context-tree weighting node by node, in plain Python."""
    counts = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)

    def steps(text):
        b = lm.END * lm.DEPTH + text + lm.END
        for i in range(lm.DEPTH, len(b)):
            for k in range(8):
                yield b[i - lm.DEPTH : i], 1 << k | b[i] >> (8 - k), b[i] >> (7 - k) & 1

    for t in train:
        for c, bits, bit in steps(t):
            for d in range(lm.DEPTH + 1):
                counts[c[lm.DEPTH - d :], bits][bit] += 1
                if d:
                    kids[c[lm.DEPTH - d + 1 :], bits].add((c[lm.DEPTH - d :], bits))

    def kt(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1)

    memo = {}

    def total(node):
        if node not in memo:
            own = kt(*counts[node])
            memo[node] = own if len(node[0]) == lm.DEPTH else math.log(0.5) + np.logaddexp(own, sum(total(k) for k in kids[node]))
        return memo[node]

    out = []
    for t in texts:
        s = 0.0
        for c, bits, bit in steps(t):
            p = None
            for d in range(lm.DEPTH, -1, -1):
                node = (c[lm.DEPTH - d :], bits)
                n0, n1 = counts.get(node, (0, 0))
                est = (n1 + 0.5) / (n0 + n1 + 1)
                own = 1.0 if d == lm.DEPTH else math.exp(math.log(0.5) + kt(n0, n1) - (total(node) if node in counts else 0.0))
                p = est if p is None else own * est + (1 - own) * p
            s += math.log10(p if bit else 1 - p)
        out.append(s)
    return out


@pytest.mark.parametrize("top", [0, 40, 1 << 20])
def test_scores_equal_brute_force(spark, top):
    rnd = random.Random(3)
    voc = ["the", "there", "then", "Ünder", "a", "b"]
    rows = [(i, " ".join(rnd.choice(voc) for _ in range(rnd.randrange(0, 25))) + rnd.choice(["", "\n", "  x"])) for i in range(60)]
    rows += [(7, rows[7][1]), (None, "then THE"), (500, None), (501, "")]
    df = spark.createDataFrame([(a, b, "s", 1) for a, b in rows], "doc_id long, text string, score string, learn int")
    out = sorted(lm.score_documents(df, top_words=3, top_grams=top).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    form = lambda t: (t or "").encode().lower().split()
    train = [form(t) for d, t in rows if not held(d)]
    c = Counter(w for t in train for w in t)
    c["end"] = len(train)
    n, v = sum(c.values()), len(c)
    rows.sort(key=lambda r: (str(r[0]), len(form(r[1]))))
    model = brute_ctw([b" ".join(t) for t in train], [b" ".join(form(t)) for _, t in rows])
    assert len(out) == len(rows) and any(r.held_out for r in out)
    for r, (d, t), m in zip(out, rows, model):
        toks = [*form(t), "end"]
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d, held(d), len(toks), sum(c[x] > 0 for x in toks), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in toks), rel=1e-9)
        assert r.score == pytest.approx(m, rel=1e-9)


def test_probabilities_add_up_to_one(spark):
    """Over all next bytes after seen and unseen contexts."""
    texts = [f"some words {i} and more {i * i}" for i in range(50)]
    asked = [ctx + bytes([x]) for ctx in (lm.END * lm.DEPTH, b" some", b"qqqqq", b"words", b"rds 1") for x in range(256)]
    rows = [(1, t, True) for t in texts]
    counts = lm.gather(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"))
    more = spark.createDataFrame([(int.from_bytes(a, "big"), None, 0) for a in asked], counts.schema)
    both = counts.unionByName(more).groupBy("gram", "word").sum("n").withColumnRenamed("sum(n)", "n")
    got = {r.gram: r.logp for r in lm.gram_scores(both).collect()}
    for at in range(0, len(asked), 256):
        assert sum(10 ** got[int.from_bytes(a, "big")] for a in asked[at : at + 256]) == pytest.approx(1, rel=1e-12)


def test_counts_of_a_hundred_million_keep_rare_bytes_possible(spark):
    g = lambda s: int.from_bytes(s, "big")
    rows = [(g(b"aaaaaa"), None, 10**8), (g(b"aaaaab"), None, 0), (g(b"aaaabz"), None, 10**12), (g(b"qaaaaa"), None, 1)]
    got = {r.gram: r.logp for r in lm.gram_scores(spark.createDataFrame(rows, "gram long, word binary, n long")).collect()}
    assert all(math.isfinite(v) and v <= 0 for v in got.values()) and got[rows[0][0]] > -1e-6 and -30 < got[rows[1][0]] < -5


def test_very_long_text_and_repeats(spark):
    long = "ab " * 400_000
    df = spark.createDataFrame([(1, long), (2, "ab ab"), (2, "ab ab"), (3, "ab ab")], "doc_id long, text string")
    out = {(r.doc_id, r.n_tokens): r for r in lm.score_documents(df, top_grams=2).collect()}
    assert out[1, 400_001].n_bytes == 1_200_000 and math.isfinite(out[1, 400_001].score)
    assert out[2, 3].score == pytest.approx(out[3, 3].score)


def test_empty_table_and_no_training_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(df).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm.score_documents(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert (r.n_known, r.train_tokens) == (0, 0) and r.score == pytest.approx(3 * 8 * math.log10(0.5)) and r.base_score == pytest.approx(0)
