"""Each stage against a brute-force version on a small corpus with planted cases."""

import hashlib
import random
from collections import Counter

import corpus_pipeline as p
import pytest
from pageloom.llm import bpe


def word(rnd):
    return "".join(rnd.choice("abcdefghijklmnopqrs") for _ in range(rnd.randrange(4, 9)))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        w = [word(rnd) for _ in range(rnd.randrange(60, 160))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(6):
                w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "moron", "stupid", "scum"]))
        rows.append((i, " ".join(w), "en", f"s{i % 4}" if i % 7 else None, 0))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 8]
    copies = [(1000 + k, clean[k][1].replace(" ", "  ", 3) + "", "en", "s1", 0) for k in range(20)]
    near = []
    for k in range(30, 50):
        w = clean[k][1].split(" ")
        w[len(w) // 2] = "changed"
        near.append((2000 + k, " ".join(w), "en", "s2", 0))
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows + copies + near + [(3000, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, {r[0]: r[1] for r in rows + copies + near}, {c[0] for c in copies}, {n[0] for n in near}


def test_stages_do_what_they_say(spark, corpus):
    d, texts, copies, near = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in p.STAGES[:-1]:
        out = p.write_table(stage(spark, docs, d), "t")
        assert out.columns == docs.columns
        seen.append([r.doc_id for r in out.collect()])
        docs = out
    toxic = {i for i in range(400) if i % 8 == 0}
    assert len(toxic & set(seen[0])) <= 2 and len(set(texts) - toxic - set(seen[0])) <= 2
    assert not copies & set(seen[1]) and set(seen[0]) - copies == set(seen[1])
    assert not near & set(seen[2]) and len(set(seen[1]) - near - set(seen[2])) == 0
    kept = Counter(seen[3])
    assert set(kept) <= set(seen[2]) and max(kept.values()) <= 3
    by_source = Counter()
    for r in docs.collect():
        by_source[r.source] += len((r.text or "").split())
    total = sum(len((texts.get(i) or "").split()) for i in seen[2])
    assert abs(sum(by_source.values()) - total) < 0.02 * total
    c = bpe.codec(bpe.vocabulary())
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in p.STAGES[-1][1](spark, docs, d).collect())
    want = []
    for r in docs.collect():
        b = c.encode([r.text])[0]
        want.append((r.doc_id, len(b) // 4, hashlib.sha256(b).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert got == sorted(want)


def test_names_and_order():
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "source mixing", "byte-level bpe"]


def test_odd_rows_pass_through_every_stage(spark, corpus, tmp_path):
    """Null ids and texts, repeated rows, columns with names that the stages use, and an empty table."""
    d, texts, *_ = corpus
    labels = spark.read.parquet(f"{d}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    base = spark.read.parquet(f"{d}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (None, "only here, without any id", "en", None, None), (3001, "", "en", "s1", 0), (1, texts[1], "en", "s1", 0), (1, texts[1], "en", "s1", 0)], base.schema)
    docs = base.unionByName(odd)
    for c in ("_copy_key", "_copy_verdict", "_node", "_lead", "_mix_n", "_mix_own", "size", "score", "part", "raw"):
        docs = docs.withColumn(c, p.mixing.F.lit("mine"))
    empty = docs.limit(0)
    for name, stage in p.STAGES:
        out, none = p.write_table(stage(spark, docs, str(tmp_path)), "odd"), p.write_table(stage(spark, empty, str(tmp_path)), "none")
        assert none.count() == 0
        if name == "byte-level bpe":
            assert out.count() == docs.count() and out.filter("n_tokens > 0").count() > 300
            continue
        assert out.columns == docs.columns and out.filter("_copy_key <> 'mine' OR _node <> 'mine' OR size <> 'mine'").isEmpty()
        if name != "toxicity":
            assert out.filter("doc_id = 1").count() <= (3 if name == "source mixing" else 1)
        docs, empty = out, none
    assert docs.filter("text LIKE 'only here%'").count() in (0, 1, 2, 3)


def test_run_leaves_only_the_last_table(spark, corpus):
    from pageloom.llm import common

    before = common.mark()
    out = p.run(spark, corpus[0])
    assert out.count() > 0 and len(common._made) - before == len(p.STAGES)
