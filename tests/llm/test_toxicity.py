import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm.toxicity import FEATURES, Boosted, Lexicon, drop_toxic, features, isotonic, op7_toxicity, score_documents, train

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLEAN = "the report says that rain fell on the quiet valley and people went home early after work in summer".split()
RUDE = "blorp snarg you idiot trash vexling".split()


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.25)
        words = [rng.choice(CLEAN) for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(rng.randint(3, 8)):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        docs.append((i, " ".join(words), "en", "web", None))
        if rng.random() < 0.8:
            labels.append((i, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, SCHEMA).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


@pytest.fixture(scope="module")
def model(tables):
    return train(*tables)


def test_held_out_rows_are_told_apart(tables, model):
    docs, labels = tables
    got = score_documents(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 60 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in held]) > 0.95


def test_labels_of_held_out_rows_are_not_learned(tables, model):
    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = train(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("toxic")), flipped)
    texts = [r.text for r in docs.limit(40).collect()]
    assert np.allclose(again.score(texts), model.score(texts))


def test_odd_inputs_get_scores(spark, model):
    rows = [(1, None, None, None, None), (2, "", None, None, None), (2, "", None, None, None), (None, "you idiot " * 5, None, None, None), (4, "rain " * 200_000, None, None, None), (5, "\x00 ??? 🙂", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("mine")).withColumn("label", F.lit(1))
    got = score_documents(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert score_documents(docs.limit(0), model).collect() == []


def test_drop_toxic_keeps_clean_rows_whole(spark, tables):
    docs, labels = tables
    marked = docs.withColumn("score", F.lit("mine"))
    left = drop_toxic(marked, labels)
    assert left.columns == marked.columns
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    clean = {r.doc_id for r in labels.filter("toxic = 0").collect()}
    ids = {r.doc_id for r in left.collect()}
    assert len(ids & toxic) < 0.1 * len(toxic) and len(ids & clean) > 0.97 * len(clean)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1), (1, 0, 0), (None, 1, 1), (2, None, None)]])
def test_without_enough_labels_everything_has_a_score(spark, labels):
    docs = spark.createDataFrame([(i, f"text {i}", None, None, None) for i in range(4)], SCHEMA)
    m = train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = score_documents(docs, m).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)


def test_isotonic_is_the_least_squares_rising_fit():
    rng = np.random.default_rng(0)
    s, y = np.round(rng.normal(size=60), 1), rng.integers(0, 2, 60).astype(float)
    x, v = isotonic(s, y)
    fit = np.interp(s, x, v)
    assert (np.diff(v) >= 0).all()
    best = np.array([max(min(y[(s >= a) & (s <= b)].mean() for b in np.unique(s) if b >= z) for a in np.unique(s) if a <= z) for z in s])  # max-min formula
    assert np.allclose(fit, best)


def test_boosting_fits_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) & (x[:, 3] > 0)).astype(float)
    m = Boosted().fit(x[:600], y[:600]).margin(x[600:])
    assert ((m > 0) == y[600:]).mean() > 0.93


def test_features():
    lex = Lexicon({"blorp": 3.0}, {"snarg": 2.0})
    f = dict(zip(FEATURES, features("You BLORP blorp!! y0u id1ot i d i o t rain", lex)))
    assert f["word_log"] == pytest.approx(np.log1p(2)) and f["near_second"] > 0 and f["bang_density"] > 0 and f["shout_share"] > 0
    assert f["hidden_hits"] >= 2
    assert set(features("", lex)) == {0.0}


def test_registered_query(spark, tmp_path):
    docs, labels = corpus(120, 9)
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op7_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 120
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)


def test_equal_texts_score_alike(spark):
    from pageloom.llm import toxicity as tox

    rows = [(i, "you stupid idiot go away" if i % 3 == 0 else f"a fine day number {i}") for i in range(300)]
    df = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    both = df.unionByName(df)
    got = tox.score_documents(both, tox.train(both, labels)).collect()
    by = {}
    for r in got:
        by.setdefault(rows[r.doc_id][1], set()).add(r.score)
    assert len(got) == 600 and all(len(x) == 1 for x in by.values())
