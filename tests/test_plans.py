"""Plans, payloads, sources, sinks, the resumable queue and the driver contract."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from pageloom.operators import semi
from pageloom.plans import model
from pageloom.sources import readers, sinks
from pageloom.streaming import resume


def test_plans():
    p = model.fallback_plan("http://s", ["title", "odd"], 7)
    assert p.names == ["title", "odd"] and p.fields[0].selector and p.fields[1].selector == ""
    q = p.with_answers(3, ("odd", "new"))
    assert q.names == ["title", "odd", "new"] and (q.max_pages, p.max_pages) == (3, 7)
    good = {"target_url": "u", "crawler_config": {"max_pages": 2}, "extraction_config": {"fields": {"a": {"selector": ".a", "other": 1}}}}
    assert model.plan_is_valid(good) and model.plan_from_json(good).fields[0].selector == ".a"
    for broken in (None, {}, {**good, "target_url": ""}, {**good, "crawler_config": {"max_pages": 0}}, {**good, "extraction_config": {"fields": {}}}):
        assert not model.plan_is_valid(broken)
    assert model.choose_strategy(True, model.CrawlPlan("multilevel", ({},))) == "single" and model.choose_strategy(False, model.CrawlPlan("multilevel", ({},))) == "multilevel"
    assert [model.should_checkpoint(*a) for a in ((True, 10, 0), (True, 1, 30), (True, 9, 29), (False, 99, 99), (False, 0, 0, True))] == [True, True, False, False, True]
    assert model.preview({"estimated_time": 5, "confidence": "HIGH"})["estimated_time"] == "5 minutes"


def test_data_arrays():
    rows = [{"n": i} for i in range(6)]
    assert semi.has_data_array({"a": {"b": rows}}) and not semi.has_data_array({"a": rows[:4]}) and not semi.has_data_array([1, 2, 3, 4, 5])
    deep = rows
    for _ in range(7):
        deep = {"x": deep}
    assert not semi.has_data_array(deep)
    assert semi.longest_array({"a": rows, "b": {"c": rows * 2}}) == rows * 2 and semi.dig({"a": {"b": 1}}, "a.b") == 1 and semi.dig([1], "0") is None


def test_payloads(spark):
    body = json.dumps({"data": {"items": [{"n": f"x{i}", "p": {"q": i}} for i in range(5)]}})
    df = spark.createDataFrame([(1, 200, "http://s/api", "application/json", body), (2, 404, "http://s/api2", "application/json", body), (3, 200, "http://s/page", "text/html", body), (4, 200, "http://s/api", "application/json", "{broken"), (5, 200, "http://s/api", None, None)], "seq int, status int, url string, content_type string, body string")
    assert [r.url for r in semi.api_candidates(df).collect()] == ["http://s/api"]
    items = semi.project(semi.resolve_records(df.filter("seq IN (1, 4, 5)").select("seq", "body")), {"name": "n", "q": "p.q", "none": "z"})
    assert [tuple(r) for r in items.orderBy("item_ord").collect()] == [(1, i, f"x{i}", str(i), "") for i in range(5)]
    texts = spark.createDataFrame([('{"a": 1}',), ('so: {"a": 2} ok',), ("```json\n{\"a\": 3}\n```",), ("nothing",), ("",), (None,)], "s string")
    assert [r[0] for r in texts.select(semi.lenient_json("s")).collect()] == ['{"a":1}', '{"a":2}', '{"a":3}', None, None, None]


def test_sources(spark, tmp_path):
    (tmp_path / "in.json").write_text('[{"url": "a"}, {"url": "b"}]')
    (tmp_path / "bad.json").write_text("{oops")
    (tmp_path / "none.json").write_text("")
    at = lambda n: f"file://{tmp_path}/{n}"
    assert [r.url for r in readers.input_records(spark, at("in.json"), "url string", 1).collect()] == ["a"]
    assert readers.input_records(spark, at("gone"), "url string", missing_ok=True).collect() == []
    with pytest.raises(FileNotFoundError):
        readers.input_records(spark, at("gone"), "url string")
    assert [readers.tolerant_json(spark, at(n), "url string").count() for n in ("bad.json", "none.json", "gone", "in.json")] == [0, 0, 0, 2]
    assert readers.tolerant_csv(spark, at("gone"), ["a"]).columns == ["a"]
    assert [r.url for r in readers.page_sequence(spark, "u", {"type": "page_numbers", "url_template": "u?p={page_num}", "first_page": 2}, 2).collect()] == ["u?p=2", "u?p=3"]
    assert readers.page_sequence(spark, "u", None, 9).count() == 1
    dim = spark.createDataFrame([("1", "", "x", 1), ("1", "new", "y", 2), (" ", "z", "z", 3)], "id string, brand_name string, name string, o int")
    assert [tuple(r) for r in readers.lookup_table(dim, "id", ["brand_name", "name"], "o").collect()] == [("1", "new")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b\"\nc", None, "é/")], "x string, y string, z string")
    got = sinks.export(df, f"file://{tmp_path}/out", ["z", "x", "y"], text="report", one_file=True)
    assert got["status"] == "success" and got["records_extracted"] == 1
    back = spark.read.csv(got["files"]["csv"], header=True, multiLine=True, escape='"')
    assert back.columns == ["z", "x", "y"] and back.first().x == 'a,"b"\nc'
    text = open(got["files"]["json"].removeprefix("file://"), encoding="utf-8").read()
    assert json.loads(text)[0]["z"] == "é/" and text.startswith('[\n  {\n    "z": "é/"') and text.endswith("}\n]\n")
    assert sinks.export(df.limit(0), f"file://{tmp_path}/empty", ["x"]) == {"status": "failed", "records_extracted": 0} and not (tmp_path / "empty").exists()
    with pytest.raises(ValueError):
        sinks.write_csv(df, f"file://{tmp_path}/strict", ["x"], strict=True)


def test_the_queue_resumes(spark, tmp_path):
    """What a second run adds is what one run over everything gives; done URLs are not processed again."""
    calls = []

    def process(df):
        calls.append([r.url for r in df.collect()])
        bad = F.col("url").startswith("bad")
        return df.select("url", F.when(bad, "failed").otherwise("ok").alias("status"), F.lit("why").alias("reason"), F.lit(1).cast("long").alias("ts"), F.array(F.struct(F.substring("url", 1, 1).alias("id"), F.col("url").alias("v"))).alias("records"))

    def put(n, *urls):
        spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")

    def run(store, name):
        stream = spark.readStream.schema("url string").option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        resume.run_queue(stream, process, store, "id", f"file://{tmp_path}/{name}").awaitTermination()

    store = resume.StateStore(spark, f"file://{tmp_path}/store")
    put(1, "a1", "bad", "a2", "c1")
    run(store, "cp")
    put(2, "a1", "d1", "c1")
    run(store, "cp")
    assert [sorted(c) for c in calls] == [["a1", "a2", "bad", "c1"], ["d1"]]
    ids = [r.id for r in store.read("records", "id string, v string").collect()]
    assert sorted(ids) == ["a", "c", "d"] and store.read("rows", "id string").count() == 4
    assert [r.url for r in resume.latest(store, "failed").collect()] == ["bad"]
    m = resume.metrics(store, 2.0).first()
    assert (m.ok, m.failed) == (4, 1)


def test_the_contract_without_the_corpus_package(tmp_path):
    """The entry module imports, with its other queries, where the corpus package and pipeline are gone; other import errors show."""
    import pathlib
    import shutil

    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root / "pageloom", tmp_path / "pageloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'list_records' in q and set(e.oracle_sql()) <= set(q); assert not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert got.returncode == 0, got.stderr
    assert int(got.stdout) > 60
