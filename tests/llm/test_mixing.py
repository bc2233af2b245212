import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pageloom.llm.mixing import apply_mix, mix, source_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fill(sizes, cap=3, weights=(1, 2, 3)):
    """Targets by resharing again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 900, "c": 90}, {"a": 1000, "b": 1, "c": 1, "d": 1, None: 5}, {"B": 5, "a": 0, "é": 7, "Z": 3}, {"x": 4}, {"a": 5, "b": 5, "c": 5, "d": 5, "e": 1000, "f": 2, "g": 3}])
def test_targets_reshare_what_is_above_the_cap(spark, sizes):
    got = source_targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()
    want = fill(sizes)
    assert {r.source: r.target for r in got} == pytest.approx(want)
    assert sum(r.target for r in got) == pytest.approx(sum(sizes.values()))
    assert [r.source for r in sorted(got, key=lambda r: r.ord)] == sorted(s for s in sizes if s is not None) + [None] * (None in sizes)


def corpus(n=3000, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.choices(["web", "wiki", "code", "news", None], [60, 10, 5, 24, 1])[0]
        out.append((i, " ".join("w" * rng.randint(1, 3) for _ in range(min(3000, int(rng.lognormvariate(3, 1.2))))), "en", s, 1))
    return [*out, (-1, None, None, "web", None), (-2, "", None, "wiki", None), (-3, " \n\t", None, None, None), (-4, "long " * 40_000, None, "news", None)]


def test_taken_words_come_near_the_targets(spark):
    data = corpus()
    docs = spark.createDataFrame(data, SCHEMA)
    got = mix(docs).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in data)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    targets = fill({s: sum(r.size for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert rs[0].source_size == sum(r.size for r in rs) and rs[0].target == pytest.approx(targets[s])
        assert abs(sum(r.taken for r in rs) - targets[s]) <= max(r.size for r in rs) / 2 + 1e-6
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    again = mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def expected_copies(sizes, target, cap=3):
    """Of each size: the cap or a common factor times the weight, found by bisection."""
    w = {z: 16 + len(f"{z:b}") for z in set(sizes)}
    low, high = 0.0, 1e9
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cap, mid * w[z]) * z for z in sizes) < target else (low, mid)
    return {z: min(cap, high * w[z]) for z in w}


def test_inclusion_is_unequal_and_as_the_weights_say(spark):
    """Whole copies are certain; over many seeds a document's mean number of copies is its expected one."""
    lengths = [1, 4, 9, 25, 64, 2000]
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.expr(f"repeat('w ', element_at(array({', '.join(map(str, lengths))}), CAST(id % 6 AS int) + 1))").alias("text"), F.when(F.col("id") % 5 < 3, "a").otherwise("b").alias("source")
    )
    seen = defaultdict(list)
    for seed in "abcdefghij":  # few long documents move the cut, so a mean takes several draws
        for r in mix(docs, seed=seed).collect():
            seen[r.source, r.size].append(r.copies)
    target = {r.source: r.target for r in mix(docs).select("source", "target").distinct().collect()}
    for source in "ab":
        sizes = [z for (s, z), c in seen.items() if s == source for _ in range(len(c) // 10)]
        for z, e in expected_copies(sizes, target[source]).items():
            got = seen[source, z]
            assert math.floor(e) <= min(got) and max(got) <= math.ceil(e)
            assert abs(sum(got) / len(got) - e) < 0.05, (source, z, e)
    assert all(max(c) - min(c) > 0.2 for c in ([sum(v) / len(v) for (s, _), v in seen.items() if s == source] for source in "ab"))  # unequal


def test_pareto_ranks_decide(spark):
    """The documents that get the copy beyond the whole ones are those of the smallest random odds over inclusion odds."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 1 + CAST(id % 40 AS int))").alias("text"), F.lit("s").alias("source"))
    docs = docs.unionByName(spark.range(500, 900).select(F.col("id").alias("doc_id"), F.expr("repeat('v ', 1 + CAST(id % 40 AS int))").alias("text"), F.lit("t").alias("source")))
    got = [r for r in mix(docs).collect() if r.source == "s"]
    e = expected_copies([r.size for r in got], got[0].target)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rank = {}
    for r in got:
        u = (int(hashlib.md5(f"{r.doc_id}:{hashlib.md5(texts[r.doc_id].encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        rest = e[r.size] - math.floor(e[r.size])
        rank[r.doc_id] = (u / (1 - u)) / (rest / (1 - rest))
    more = [rank[r.doc_id] for r in got if r.copies > math.floor(e[r.size])]
    less = [rank[r.doc_id] for r in got if r.copies == math.floor(e[r.size])]
    assert more and less and max(more) < min(less)


def test_apply_repeats_whole_rows(spark):
    data = corpus(400, 5)
    docs = spark.createDataFrame(data, SCHEMA).withColumn("copies", F.lit("mine")).withColumn("size", F.lit("mine"))
    for c in ("_size", "_n", "_copy", "_mix_n", "_mix_own", "digest", "one", "part"):
        docs = docs.withColumn(c, F.lit("mine"))
    plan = {r.doc_id: r.copies for r in mix(docs).collect() if r.taken}
    out = apply_mix(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {k: v for k, v in plan.items() if v}


def test_ties_nulls_and_empty_tables(spark):
    same = [(4, "a b c", None, "s", None)] * 5 + [(None, "d e", None, "s", None)] * 3 + [(None, None, None, None, None)]
    got = mix(spark.createDataFrame(same, SCHEMA)).collect()
    assert len(got) == 9 and sum(r.taken for r in got) == pytest.approx(21, abs=1.5)
    assert apply_mix(spark.createDataFrame(same, SCHEMA)).count() == sum(r.copies for r in got if r.size)
    none = spark.createDataFrame([], SCHEMA)
    assert mix(none).collect() == [] and apply_mix(none).collect() == []
    blank = spark.createDataFrame([(1, None, None, "a", 0), (2, " ", None, None, 0)], SCHEMA)
    assert [(r.size, r.taken, r.target) for r in mix(blank).collect()] == [(0, 0, 0.0)] * 2
