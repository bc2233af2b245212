"""The checkpointed work queue as a stream: done URLs, records, failures and flat rows in tables that a rerun resumes from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, records


def dedup_stream(events: DataFrame, id_: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """The first of each id within the watermark; state of older ids is let go."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_])


#: Folders over which done URLs and known ids are dealt; a batch reads only those that its own keys fall into.
BUCKETS = 256


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


class StateStore:
    """Tables under one folder: records, rows, failed, flagged, done, and the keys that later batches look up. Each batch is a
    folder named by its number and is written once more when it is tried again, so reruns after a failure add nothing twice (G6)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}") if self._exists(name) else self.spark.createDataFrame([], schema)

    def write(self, name: str, batch: int, df: DataFrame) -> DataFrame:
        """The batch's part of a table, as it stands in the store."""
        path = f"{self.folder}/{name}/batch={batch:010d}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_keys(self, name: str, batch: int, df: DataFrame, key: str) -> None:
        """The batch's keys, by bucket."""
        keys = df.select(F.col(key).cast("string").alias("key")).distinct().withColumn("bucket", _bucket("key"))
        keys.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/keys-{name}/batch={batch:010d}")

    def known(self, name: str, batch: int, asked: DataFrame, key: str) -> DataFrame:
        """(key) of those of asked's keys that batches before this one wrote. Only the folders of asked's buckets are read."""
        at = f"{self.folder}/keys-{name}"
        if not self._exists(f"keys-{name}"):
            return self.spark.createDataFrame([], f"{key} string")
        buckets = [r.b for r in asked.select(_bucket(key).alias("b")).distinct().collect()]  # at most BUCKETS
        every = self.spark.read.option("basePath", at).parquet(at)
        return every.filter((F.col("batch").cast("long") < batch) & F.col("bucket").isin(buckets)).select(F.col("key").alias(key)).distinct()


def run_queue(inputs: DataFrame, process: Callable[[DataFrame], DataFrame], store: StateStore, id_: str, checkpoint: str, url: str = "url", per_trigger: int | None = None):
    """Streams input files of (url, ...); pending URLs are processed to (url, status, reason, ts, records array<struct>);
    records with new ids are added, rows of all ok results are, failures and flags are kept by URL, done URLs are remembered.
    Results are a written table before anything is made of them, so process runs once a batch. Returns the query, which ends
    when all that is there is done."""

    def batch(df: DataFrame, number: int) -> None:
        asked = df.dropDuplicates([url])
        todo = checks.pending(asked, store.known("done", number, asked, url), url)
        got = store.write("results", number, process(todo))
        ok = got.filter("status = 'ok'").select(url, F.posexplode("records").alias("_i", "r")).select(url, "_i", "r.*")
        fields = [f for f in ok.columns if f not in (url, "_i")]
        known = store.known("records", number, ok, id_)
        fresh = store.write("records", number, records.add_records(known, ok.withColumn(id_, F.col(id_).cast("string")), id_, [url, "_i"]).select(*fields))
        store.write_keys("records", number, fresh.filter(F.coalesce(F.col(id_), F.lit("")) != ""), id_)
        store.write("rows", number, ok.select(*fields))
        for s in ("failed", "flagged"):
            store.write(s, number, got.filter(F.col("status") == s).select(url, "reason", "ts"))
        done = store.write("done", number, got.filter("status <> 'failed'").select(url))
        store.write_keys("done", number, done, url)

    writer = inputs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.start()


def latest(store: StateStore, name: str, url: str = "url") -> DataFrame:
    """U4: the last entry of each URL in failed or flagged; a failed URL that is done since is left out."""
    every = store.read(name, f"{url} string, reason string, ts long")
    last = records.upsert(every.limit(0), every, url, "ts")
    return checks.pending(last, store.read("done", f"{url} string"), url) if name == "failed" else last


def metrics(store: StateStore, elapsed: float, url: str = "url") -> DataFrame:
    """A3 over the store."""
    schema = f"{url} string"
    part = lambda name, status: store.read(name, schema).select(F.lit(status).alias("status"))
    flagged = store.read("flagged", schema).select(url).distinct()
    ok = checks.pending(store.read("done", schema), flagged, url).select(F.lit("ok").alias("status"))
    every = ok.unionByName(part("flagged", "flagged")).unionByName(part("failed", "failed"))
    return checks.run_metrics(every.withColumns({"n_records": F.lit(0), "n_rows": F.lit(0)}), elapsed)
