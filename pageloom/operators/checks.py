"""Joins that enrich and joins that check; validation reports and run metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, free_name, is_blank
from ..functions.values import failure_status, retry_wait


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, name: str, miss: str = "") -> DataFrame:
    """Df with the dimension's value as name; `miss` where there is none. The dimension has a key once. Whether it is sent to all
    is the optimiser's choice, by size."""
    dk, dv = free_name(df.columns, "_dk"), free_name(df.columns, "_dv")
    d = dim.select(F.col(key).alias(dk), F.col(value).cast("string").alias(dv))
    return df.join(d, F.col(key) == F.col(dk), "left").withColumn(name, F.coalesce(dv, F.lit(miss))).drop(dk, dv)


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Children whose key is not blank and not among the parents' keys that are not blank."""
    k, own = free_name(child.columns, "_pk"), free_name(child.columns, "_fk")
    p = parent.select(clean(F.col(pk)).alias(k)).filter(F.col(k) != "").distinct()
    c = child.withColumn(own, clean(F.col(fk))).filter(F.col(own) != "")
    return c.join(p, F.col(own) == F.col(k), "left_anti").drop(own)


def orphan_issue(child: DataFrame, fk: str, parent: DataFrame, pk: str, label: str) -> DataFrame:
    return orphans(child, fk, parent, pk).agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(f"{label}_orphan").alias("category"), "n")


def pending(records: DataFrame, done: DataFrame, url: str = "url") -> DataFrame:
    """Records whose URL is not done."""
    return records.join(done.select(url).distinct(), url, "left_anti")


def missing_required(df: DataFrame, fields: list[str], kind: str) -> DataFrame:
    """A5, A4: (category, n), a count for each blank cell of a required field; a column that is absent is blank in every row."""
    cell = lambda f: is_blank(F.col(f)) if f in df.columns else F.lit(True)
    each = F.filter(F.array(*(F.when(cell(f), F.lit(f"missing_{kind}_{f}")) for f in fields)), lambda x: x.isNotNull())
    return df.select(F.explode(each).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, id_: str) -> DataFrame:
    """(id, n) of ids that occur more than once."""
    return df.groupBy(F.col(id_).alias("id")).agg(F.count("*").alias("n")).filter("id IS NOT NULL AND n > 1")


def duplicate_issue(df: DataFrame, id_: str, label: str) -> DataFrame:
    return duplicates(df, id_).agg(F.sum(F.col("n") - 1).alias("n")).filter("n > 0").select(F.lit(f"{label}_detected").alias("category"), "n")


def range_issues(df: DataFrame, price: str, rating: str) -> DataFrame:
    """(category, n): prices below 0 or above 10000, and ratings of digits only outside 1 to 5."""
    p, r = F.col(price).try_cast("double"), F.col(rating).cast("string")
    counts = df.agg(F.count_if((p < 0) | (p > 10000)).alias("price_out_of_range"), F.count_if(r.rlike(r"^\d+$") & ~r.try_cast("int").between(1, 5)).alias("rating_out_of_range"))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in counts.columns))).alias("i")).select("i.*").filter("n > 0")


def flag_missing(df: DataFrame, fields: list[str], name: str = "missing") -> DataFrame:
    """The names of each record's blank cells, in order; its status is no worse for them."""
    return df.withColumn(name, F.filter(F.array(*(F.when(is_blank(F.col(f)), F.lit(f)) for f in fields)), lambda x: x.isNotNull()))


def merged_issues(*issues: DataFrame) -> DataFrame:
    """Counts by category, sorted."""
    return reduce(lambda a, b: a.unionByName(b), issues).groupBy("category").agg(F.sum("n").alias("n")).orderBy("category")


def run_metrics(results: DataFrame, elapsed: float | Column = 0.0, by: list[str] | None = None) -> DataFrame:
    """A3: from (status, n_records, n_rows): ok, failed, flagged, processed, records, csv_rows, success_rate, records_per_second (pages
    over seconds); rates are 0 where they are undefined."""
    e = elapsed if isinstance(elapsed, Column) else F.lit(float(elapsed))
    ok, failed, flagged = (F.count_if(F.col("status") == s) for s in ("ok", "failed", "flagged"))
    out = results.groupBy(*(by or [])).agg(ok.alias("ok"), failed.alias("failed"), flagged.alias("flagged"), F.coalesce(F.sum("n_records"), F.lit(0)).alias("records"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("csv_rows"), *([F.max(e).alias("_e")] if isinstance(elapsed, Column) else []))
    out = out.withColumn("processed", F.col("ok") + F.col("failed") + F.col("flagged"))
    took = F.col("_e") if isinstance(elapsed, Column) else e
    return out.withColumn("success_rate", F.coalesce(F.try_divide("ok", "processed"), F.lit(0.0))).withColumn("records_per_second", F.coalesce(F.try_divide(F.col("processed").cast("double"), took), F.lit(0.0))).drop("_e")


def attempt_outcomes(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(url, status, reason, attempt, waited) of pages that are tried up to `most` times. From (url, attempt from 1, error, expected,
    labels, anchors, engines): what each attempt met, if it was made.

    The first attempt that settles the page counts. An error, fewer anchors than expected, or anchors without engines ask for
    another attempt while there is one; no anchors at all do so only where something says that there are some. waited is the
    time spent before the settling attempt, without jitter.
    """
    n = F.col("attempt")
    left = n < most
    expected, anchors = F.coalesce("expected", F.lit(0)), F.coalesce("anchors", F.lit(0))
    bare = failure_status("expected", "labels", "anchors")
    verdict = (
        F.when(F.coalesce("error", F.lit("")) != "", F.when(left, F.lit(None)).otherwise(F.struct(F.lit("failed").alias("status"), F.lit("max_retries_exhausted").alias("reason"))))
        .when(anchors == 0, F.when(left & (bare == "failed"), F.lit(None)).otherwise(F.struct(bare.alias("status"), F.lit("zero_anchors_after_harvest").alias("reason"))))
        .when((anchors < expected) & left, F.lit(None))
        .when(F.coalesce("engines", F.lit(0)) == 0, F.when(left, F.lit(None)).otherwise(F.struct(F.lit("failed").alias("status"), F.lit("zero_engines_with_specs").alias("reason"))))
        .otherwise(F.struct(F.lit("ok").alias("status"), F.lit("").alias("reason")))
    )
    judged = attempts.filter(n <= most).select("url", "attempt", verdict.alias("v"))
    settled = F.min_by(F.struct("attempt", "v"), F.when(F.col("v").isNotNull(), F.col("attempt"))).alias("s")
    out = judged.groupBy("url").agg(settled, F.max("attempt").alias("last"))
    # pages whose attempts all asked for one more are pending
    at = F.coalesce("s.attempt", "last")
    waits = F.aggregate(F.sequence(F.lit(1), at.cast("int")), F.lit(0.0), lambda a, k: a + retry_wait(k))
    return out.select("url", F.coalesce("s.v.status", F.lit("pending")).alias("status"), F.coalesce("s.v.reason", F.lit("")).alias("reason"), at.cast("int").alias("attempt"), waits.alias("waited"))
