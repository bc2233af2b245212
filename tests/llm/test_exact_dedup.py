import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pageloom.llm.exact_dedup import DigestIndex, drop_copies, exact_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(*pairs):
    return [(i, t, None, "s", None) for i, t in pairs]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(data):
    """(doc_id, keep_id, group_size, text_sha256) of each row, and the number of rows kept of each text."""
    groups = defaultdict(list)
    for i, t in data:
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return out, len(groups)


def order(x):
    return sorted(x, key=str)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_groups_match_brute_force_also_when_digests_collide(spark, digest_bytes):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(300)]
    data = [(i, rng.choice(pool).replace(" ", rng.choice([" ", "  ", "\t", "\n\r ", "\x0b"]))) for i in rng.sample(range(10_000), 500)]
    data += [(-5, None), (20_000, ""), (20_001, " "), (20_002, " "), (20_003, "x" * 300_000), (20_004, "x" * 300_000), (None, "a b"), (None, "only here"), (None, "only here")]
    got = exact_groups(spark.createDataFrame(rows(*data), SCHEMA).repartition(5), digest_bytes).collect()
    want, groups = brute(data)
    assert order((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == order(want)
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_repeated_rows_keep_exactly_one(spark):
    data = [(7, "same words"), (7, "same  words"), (7, "same words"), (3, "other")]
    got = exact_groups(spark.createDataFrame(rows(*data), SCHEMA)).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(3, True), (7, False), (7, False), (7, True)]
    left = drop_copies(spark.createDataFrame(rows(*data), SCHEMA)).collect()
    assert sorted(r.doc_id for r in left) == [3, 7]


def test_a_hot_text_and_clashing_columns(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the hot one").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    for c in ("digest", "sha", "body", "row", "run", "n", "first", "_copy_key", "kept"):
        docs = docs.withColumn(c, F.lit("mine"))
    got = exact_groups(docs)
    assert got.filter("kept").count() == 2001
    assert {(r.keep_id, r.group_size) for r in got.filter("doc_id % 3 = 0").collect()} == {(0, 1000)}
    docs = docs.withColumn("raw", F.lit("mine")).withColumn("_copy_verdict", F.lit("mine"))
    left = drop_copies(docs)
    assert left.columns == docs.columns and left.filter("_copy_key <> 'mine'").isEmpty() and left.count() == 2001 and left.filter("body <> 'mine'").isEmpty()


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_groups(docs).collect() == [] and drop_copies(docs).collect() == []


def test_the_index_takes_several_batches(spark):
    index = DigestIndex(spark, memtables=2, fanout=3)
    want = defaultdict(list)
    rng = random.Random(5)
    for batch in range(4):
        data = [(1000 * (4 - batch) + i, rng.choice([f"text {rng.randrange(60)}", f"own {batch} {i}"])) for i in range(80)]
        for i, t in data:
            want[t].append(i)
        index.flush(spark.createDataFrame(rows(*data), SCHEMA).repartition(4))
        got = {(r["first"].doc_id, r.n) for r in index.groups().collect()}
        assert got == {(min(ids), len(ids)) for ids in want.values() if len(ids) > 1}
    assert [len(x) for x in index.levels] == [1, 1] and index.entries().count() == 320  # three batches became one run
    merged = spark.read.parquet(index.levels[1][0].runs)
    assert merged.select("run").distinct().count() == 1 and merged.select("digest").distinct().count() == merged.count()
    for level in (x for k in index.levels for x in k):  # sorted runs
        for name in {r.f for r in spark.read.parquet(level.runs).select(F.input_file_name().alias("f")).collect()}:
            digests = [(r.run, bytes(r.digest)) for r in spark.read.parquet(name).collect()]
            assert digests == sorted(digests)


def test_filters_are_read_and_prune(spark):
    """Hits are all digests that runs share and few others; an emptied filter makes hits of other runs vanish."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") % 10 == 0, F.floor(F.col("id") / 20)).otherwise(F.col("id") + 10_000)).alias("text")).repartition(8)
    index = DigestIndex(spark)
    index.flush(docs)
    runs = index._runs(index.levels[0])
    shared = runs.groupBy("digest").agg(F.countDistinct("run").alias("k"), F.sum("n").alias("n"))
    assert index.groups().count() == shared.filter("n > 1").count() == 200
    hits = index.hits().count()
    assert hits < 0.45 * runs.count()
    level = index.levels[0][0]
    spark.read.parquet(level.filters).limit(0).write.mode("overwrite").parquet(level.filters + "-none")
    level.filters += "-none"
    assert index.hits().count() == runs.filter("n > 1").count() < hits
