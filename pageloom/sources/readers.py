"""Sources: page tables, JSON and CSV inputs that may be missing or broken, lookups, page sequences."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import urls

HTML_CAP = 80_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_scan(pages: DataFrame, html_cap: int = HTML_CAP) -> DataFrame:
    """(page_id, url, html, title, final_url, js_heavy, domain), the HTML cut at html_cap characters."""
    html = F.left(F.coalesce("html", F.lit("")), F.lit(html_cap))
    title = tx.collapse(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select("page_id", "url", html.alias("html")).select("page_id", "url", "html", title.alias("title"), F.col("url").alias("final_url"), urls.js_heavy("html").alias("js_heavy"), urls.domain("url").alias("domain"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and (fs.getFileStatus(p).isDirectory() or fs.getFileStatus(p).getLen() > 0)


def input_records(spark: SparkSession, path: str, schema: T.StructType | str, limit: int | None = None, missing_ok: bool = False, zero_is_all: bool = False) -> DataFrame:
    """S3, L1: a JSON list of records, in the file's order, the first `limit`. A missing file is an error, or no rows if missing_ok."""
    if not _exists(spark, path):
        if missing_ok:
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(path)
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df if limit is None or (zero_is_all and limit == 0) else df.limit(limit)


def tolerant_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON file; none if it is missing, empty or broken throughout."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path, multiLine=True)
    return df.dropna("all")


def tolerant_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header, all strings; no rows if it is missing or empty."""
    empty = T.StructType([T.StructField(c, T.StringType()) for c in columns or []])
    try:
        return spark.read.csv(path, header=True, multiLine=True, escape='"') if _exists(spark, path) else spark.createDataFrame([], empty)
    except AnalysisException:
        return spark.createDataFrame([], empty)


def lookup_table(df: DataFrame, id_: str, names: list[str], order: str) -> DataFrame:
    """(id, name): the first of the name columns that is not blank; of rows with one id the last in order counts."""
    first = F.coalesce(*(F.nullif(tx.strip(F.col(c)), F.lit("")) for c in names if c in df.columns), F.lit(""))
    return df.filter(~tx.is_blank(F.col(id_))).groupBy(F.col(id_).alias("id")).agg(F.max_by(first, order).alias("name"))


def page_sequence(spark: SparkSession, url: str, pagination: dict | None, max_pages: int) -> DataFrame:
    """(page_num, url) of a site's pages: numbered by its template, or the seed alone."""
    p = pagination or {}
    t = p.get("url_template", "")
    if p.get("type") in ("url_increment", "page_numbers") and t:
        first = int(p.get("first_page", 1))
        return spark.range(first, first + max_pages).select(F.col("id").cast("int").alias("page_num"), F.replace(F.lit(t), F.lit("{page_num}"), F.col("id").cast("string")).alias("url"))
    return spark.range(1, 2).select(F.col("id").cast("int").alias("page_num"), F.lit(url).alias("url"))


def with_order(df: DataFrame, order: list[str | Column], name: str = "ord") -> DataFrame:
    """An explicit ordinal, where a source has only an implied order. One window over all rows: for small sources."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
