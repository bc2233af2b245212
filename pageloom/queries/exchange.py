"""Queries over sources, sinks and rules that the page and table queries do not touch: what is written is read back and compared."""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import checks, records, semi
from ..plans import engine, model
from ..sources import readers, sinks
from ..sources.readers import read_table
from ..sources.staging import shared_folder
from . import registry

QUERIES, ORACLE_SQL, query = registry()


def _folder(spark) -> str:
    return posixpath.join(shared_folder(spark), f"pageloom-exchange-{uuid.uuid4().hex}")


@query("SELECT c_custkey, c_name, c_mktsegment AS note FROM customer")
def json_list_round_trip(spark, d):
    """One indented list, read again as input records and tolerantly."""
    c = read_table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("note"))
    path = sinks.write_json_list(c, posixpath.join(_folder(spark), "list.json"))
    strict = readers.input_records(spark, path, c.schema)
    lenient = readers.tolerant_json(spark, path, c.schema)
    broken = readers.tolerant_json(spark, path + ".none", c.schema)
    return strict.join(lenient.unionByName(broken).select("c_custkey"), "c_custkey", "left_semi")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || '; \"big\", ' || chr(10) || p_type AS p_name, '' AS absent FROM part")
def csv_round_trip(spark, d):
    """Columns in order, quotes and line feeds inside cells, an absent column; a missing file gives no rows."""
    p = read_table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit('; "big", \n'), "p_type").alias("p_name"), F.lit("left out").alias("more"))
    folder = _folder(spark)
    sinks.write_csv(p, posixpath.join(folder, "csv"), ["p_partkey", "p_name", "absent"])
    got = readers.tolerant_csv(spark, posixpath.join(folder, "csv"))
    none = readers.tolerant_csv(spark, posixpath.join(folder, "gone"), ["p_partkey", "p_name", "absent"])
    return got.unionByName(none).select("p_partkey", "p_name", F.coalesce("absent", F.lit("")).alias("absent"))


@query("SELECT s AS status, n AS extracted, r AS read_back FROM (SELECT 'success' AS s, count(*) AS n, count(*) AS r FROM supplier UNION ALL SELECT 'failed', 0, 0)")
def export_formats(spark, d):
    """K1, K2, K5, K7: an export and its report read back; one without rows fails and writes nothing."""
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_name")
    text = sinks.report("http://x", 3, s.count(), 1, 2, ["s_suppkey", "s_name"], "pageloom")
    out = []
    for df in (s, s.limit(0)):
        folder = _folder(spark)
        got = sinks.export(df, folder, df.columns, ("csv", "json"), text)
        back = 0
        if got["files"] if "files" in got else None:
            both = [spark.read.csv(got["files"]["csv"], header=True).count(), spark.read.json(got["files"]["json"]).count()]
            said = "\n".join(r.value for r in spark.read.text(got["files"]["report"]).collect())
            back = both[0] if both[0] == both[1] and said == text.rstrip("\n") and "Removed: 3 (1 junk, 2 duplicates)" in said else -1
        out.append((got["status"], got["records_extracted"], back))
    return spark.createDataFrame(out, "status string, extracted long, read_back long")


@query("SELECT n_nationkey, n_name AS title, true AS indented FROM nation")
def profile_files(spark, d):
    """K6: a profile a nation as indented JSON, and a description that names its fields."""
    folder, rows = _folder(spark), read_table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("title")).collect()  # 25 nations
    schema = {"fields": [{"name": "title", "type_hint": "str", "required": True, "source": "h1"}], "rules": [{"field": "title", "rule": "required_non_empty"}]}
    out = []
    for r in rows:
        text = "\n".join(x.value for x in spark.read.text(sinks.save_profile(spark, r, posixpath.join(folder, f"{r.n_nationkey}.json"))).collect())
        told = sinks.describe_adapter(r.title, {"page_type": "listing"}, schema)
        out.append((r.n_nationkey, json.loads(text)["title"] if f"# Adapter: {r.title}" in told and "| title | str | yes | h1 |" in told else "", text.startswith('{\n  "')))
    return spark.createDataFrame(out, "n_nationkey int, title string, indented boolean")


@query("SELECT c_custkey, trim('  ' || c_name || chr(9), ' ' || chr(9)) AS cleaned, lower(c_mktsegment) AS lowered, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS DOUBLE) + 0.5 END AS number, CASE WHEN c_custkey % 3 = 0 THEN 'http://from' ELSE 'own' END AS page FROM customer")
def cell_rules(spark, d):
    """Cleaned cells, transform hints, and a value carried forward where the input has one."""
    k = F.col("c_custkey")
    c = read_table(spark, d, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit("\t")).alias("raw"), "c_mktsegment", F.when(k % 2 == 0, F.concat(F.lit("EUR "), k, F.lit(".5"))).otherwise("none").alias("amount"), F.lit("own").alias("page"), F.when(k % 3 == 0, "http://from").otherwise("").alias("source"))
    c = records.carry_forward(c, {"page": "source"}).filter(F.col("scraped_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$"))
    return c.select("c_custkey", tx.clean("raw").alias("cleaned"), tx.transformed("c_mktsegment", "lowercase").alias("lowered"), tx.transformed("amount", "to_number").alias("number"), "page")


@query("SELECT o_orderkey, 'import os' || chr(10) || 'x = ' || o_orderkey AS code FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'no program ' || o_orderkey FROM orders WHERE o_orderkey % 2 <> 0")
def cleaned_code(spark, d):
    """F26."""
    k = F.col("o_orderkey")
    raw = F.when(k % 2 == 0, F.concat(F.lit("Sure:\n```python\nimport os\nx = "), k, F.lit("\n```\n"))).otherwise(F.concat(F.lit(" no program "), k))
    return read_table(spark, d, "orders").select("o_orderkey", tx.clean_code(raw).alias("code"))


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS url, CASE o_orderkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'failed' WHEN 3 THEN 'flagged' WHEN 4 THEN 'failed' ELSE 'pending' END AS status,
 CASE o_orderkey % 6 WHEN 2 THEN 'max_retries_exhausted' WHEN 3 THEN 'zero_anchors_after_harvest' WHEN 4 THEN 'zero_engines_with_specs' ELSE '' END AS reason,
 CAST(CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 3 ELSE 2 END AS INT) AS attempt, CASE o_orderkey % 6 WHEN 0 THEN 0.0::DOUBLE WHEN 3 THEN 0.0::DOUBLE WHEN 5 THEN 2.0::DOUBLE ELSE 6.0::DOUBLE END AS waited FROM orders"""
)
def retry_outcomes(spark, d):
    """Pages that settle at once, with fewer anchors than expected, after errors, without anchors, without engines, and not yet."""
    kind = F.col("o_orderkey") % 6
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("url"), kind.alias("kind"), F.explode(F.sequence(F.lit(1), F.when(kind == 5, 2).otherwise(3))).alias("attempt"))
    m = F.col("kind")
    return checks.attempt_outcomes(
        o.select(
            "url", "attempt", F.when(m.isin(2, 5), "timeout").alias("error"), F.when(m == 1, 2).when(m == 3, F.lit(None)).otherwise(1).cast("int").alias("expected"), F.lit(0).alias("labels"),
            F.when(m == 3, 0).otherwise(1).alias("anchors"), F.when(m == 4, 0).otherwise(1).alias("engines"),
        )
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def limited_inputs(spark, d):
    """L1, L3: the first hundred in an order; limits of None and (if asked) 0 are none."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    order = [F.desc("o_totalprice"), "o_orderkey"]
    return records.limited(records.limited(records.limited(o, order, None), order, 0, zero_is_all=True), order, 100)


@query("SELECT event_type || '/' || (event_id % 7) AS url, min(event_id) AS event_id FROM events GROUP BY ALL ORDER BY event_id LIMIT 20")
def candidate_responses(spark, d):
    """U8: the first of each URL and body start, twenty in order."""
    e = read_table(spark, d, "events").select("event_id", F.concat_ws("/", "event_type", (F.col("event_id") % 7).cast("string")).alias("url"), F.concat(F.repeat(F.lit("x"), 120), F.col("event_id").cast("string")).alias("body"))
    return records.dedup_candidates(e, ["event_id"]).select("url", "event_id")


@query("SELECT 'http://api/' || n_regionkey AS url, count(*) AS n FROM nation GROUP BY n_regionkey HAVING n_regionkey = 3")
def chosen_response(spark, d):
    """X6 by rule: of five responses the one whose objects name the wanted fields."""
    n = read_table(spark, d, "nation")
    name = F.when(F.col("n_regionkey") == 3, "title").otherwise("other")
    r = n.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.create_map(name, "n_name", F.lit("id"), F.col("n_nationkey").cast("string")))).alias("body"), F.count("*").alias("n"))
    return semi.choose_response(r.select(F.concat(F.lit("http://api/"), "n_regionkey").alias("url"), "body", "n"), ["title", "id"]).select("url", "n")


@query("SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'multilevel' ELSE 'single' END AS strategy, r_regionkey > 1 AS valid, CASE WHEN r_regionkey > 2 THEN r_regionkey || ' minutes' ELSE 'unknown' END AS minutes, r_regionkey >= 2 AS saves FROM region")
def plan_rules(spark, d):
    """Rules over plans, a case a region."""
    out = []
    for (k,) in read_table(spark, d, "region").select("r_regionkey").collect():  # 5 regions
        crawl_plan = model.CrawlPlan("multilevel", ({"entity": "makes"},))
        plan = {"target_url": "http://x", "crawler_config": {"max_pages": 5 if k > 1 else 0}, "extraction_config": {"fields": {"a": {}}}}
        said = model.preview({"estimated_time": k} if k > 2 else {})["estimated_time"]
        out.append((k, model.choose_strategy(k % 2 == 1, crawl_plan), model.plan_is_valid(plan), said, model.should_checkpoint(True, 5 * k, 0.0)))
    return spark.createDataFrame(out, "r_regionkey int, strategy string, valid boolean, minutes string, saves boolean")


@query("SELECT CAST(n_nationkey AS INT) AS done, CASE WHEN n_nationkey > 0 THEN n_nationkey / 2.0::DOUBLE ELSE 0.0::DOUBLE END AS rate, CASE WHEN n_nationkey > 0 THEN (25 - n_nationkey) / (n_nationkey / 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS eta FROM nation")
def run_progress(spark, d):
    """W6."""
    rows = [(k, *(records.progress(k, 25, 2.0)[x] for x in ("rate", "eta"))) for (k,) in read_table(spark, d, "nation").select("n_nationkey").collect()]  # 25 nations
    return spark.createDataFrame(rows, "done int, rate double, eta double")


@query("SELECT 'success' AS status, count(*) AS kept, CAST(100 AS INT) AS progress, 'parse,analysed,extract,export,success' AS steps, true AS refused FROM nation")
def session_run(spark, d):
    """Analyse, clarify and extract through the facade, with a planner and an extractor of one's own."""
    n = read_table(spark, d, "nation")
    pages = n.select(F.col("n_nationkey").cast("long").alias("page_id"), F.concat(F.lit("http://n/"), "n_nationkey").alias("url"), F.concat(F.lit("<h1>Land of "), "n_name", F.lit("</h1><p>in it</p>")).alias("html"))
    steps: list[str] = []
    own = lambda nodes, pages, fields: nodes.filter("tag = 'h1'").select("page_id", F.lit(1).alias("item_ord"), F.col("text").alias("title"), F.lit("http://x").alias("link"))
    s = engine.Session(spark, planner=lambda u, f, m: model.fallback_plan(u, f, m), progress=lambda job, pct, step, k: steps.append(step))
    job = s.analyze(pages, "http://n", ["title"])
    s.clarify(job.id, more_fields=("link",))
    done = s.extract(job.id, pages, _folder(spark), own=own)
    try:
        refused = bool(s.result(done.id, "xml"))
    except ValueError:
        refused = spark.read.json(s.result(done.id, "json")).count() == done.value["kept"]
    return spark.createDataFrame([(s.status(done.id).status, done.value["kept"], done.progress, ",".join(steps), refused)], "status string, kept long, progress int, steps string, refused boolean")
