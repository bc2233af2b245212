"""Exact deduplication over a log-structured merge index of text digests. DataFrame and SQL functions only.

A batch of documents fills memtables, one for each scan task modulo MEMTABLES. Each is flushed as a run: its distinct
digests in order, with the smallest identifier and the number of rows of each, and a filter, a Bloom bitmap of the digests.
A digest is a hit when its own run has it several times or another run's filter may have it; only hits are merged across
runs, so digests of one row, most of all, leave their run no more. Compaction merges the runs of a level into one of the
next and keeps the smallest identifiers. The bytes of all hits are verified before a digest counts as a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, documents, free_name, join_counted, new_folder, text_or_empty, write_table

#: Memtables that a batch fills, runs of a level that compaction merges, and bits of a filter for each digest.
MEMTABLES, FANOUT, FILTER_BITS = 4, 8, 16
_PAGE = 32_768  # bits of one page of a filter


def normalised(c: str | Column = "text") -> Column:
    """The text with every white-space run as one space. A single space is no match, which saves most replacements."""
    return F.regexp_replace(text_or_empty(c), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


@dataclass
class Level:
    """Runs that were written together: a table of (run, digest, first, n), and its filters (run, page, bits) of `size` bits."""

    runs: str
    filters: str
    size: int


class DigestIndex:
    """Levels of runs in the shared folder; batches of documents come by flush().

    digest_bytes shortens the SHA-256 that is the key; short ones collide, and byte verification sets that right.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, digest_bytes: int = 32, memtables: int = MEMTABLES, fanout: int = FANOUT):
        self.spark, self.digest_bytes, self.memtables, self.fanout = spark, digest_bytes, memtables, fanout
        self.path = path or new_folder(spark, "digests")
        self.batches: list[str] = []
        self.levels: list[list[Level]] = [[]]
        self._written = 0

    def keyed(self, docs: DataFrame) -> DataFrame:
        sha = docs.select("doc_id", normalised().alias("body"), raw_key()).withColumn("sha", F.unhex(F.sha2("body", 256)))
        return sha.withColumn("digest", F.substring("sha", 1, self.digest_bytes))

    def _write_level(self, runs: DataFrame) -> Level:
        self._written += 1
        at = f"{self.path}/level-{self._written:05d}"
        runs.sortWithinPartitions("run", "digest").write.option("compression", "zstd").parquet(f"{at}/runs")
        runs = self.spark.read.parquet(f"{at}/runs")
        most = runs.groupBy("run").count().agg(F.max("count")).first()[0] or 0
        size = _PAGE
        while size < FILTER_BITS * most:
            size *= 2
        place = runs.select("run", _place(size).alias("place"))
        bits = place.groupBy("run", F.expr(f"place div {_PAGE}").alias("page")).agg(F.expr(f"bitmap_construct_agg(place % {_PAGE})").alias("bits"))
        bits.write.parquet(f"{at}/filters")
        return Level(f"{at}/runs", f"{at}/filters", size)

    def flush(self, docs: DataFrame) -> None:
        """Adds a batch. Its rows (digest, sha, doc_id, raw, run, row) are written once, and texts are read no more."""
        first_run = len(self.batches) * self.memtables
        path = f"{self.path}/batch-{len(self.batches):05d}"
        rows = self.keyed(docs).select("digest", "sha", "doc_id", "raw").withColumn("row", F.monotonically_increasing_id())
        rows = rows.withColumn("run", F.lit(first_run) + F.spark_partition_id() % self.memtables)
        rows.write.option("compression", "zstd").parquet(path)
        self.batches.append(path)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "run", "row")).alias("first")
        self.levels[0].append(self._write_level(self.spark.read.parquet(path).groupBy("run", "digest").agg(first, F.count("*").alias("n"))))
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                self.compact(k)

    def compact(self, k: int = 0) -> None:
        """Merges the runs of level k into one run of the next: of each digest the smallest identifier and all its rows."""
        merged = self._runs(self.levels[k]).groupBy("digest").agg(F.min("run").alias("run"), F.min("first").alias("first"), F.sum("n").alias("n"))
        low = self._runs(self.levels[k]).agg(F.min("run")).first()[0] or 0
        if k + 1 == len(self.levels):
            self.levels.append([])
        self.levels[k + 1].append(self._write_level(merged.withColumn("run", F.lit(low))))
        self.levels[k] = []

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(*self.batches)

    def _runs(self, levels: list[Level]) -> DataFrame:
        return self.spark.read.parquet(*[x.runs for x in levels]).select("run", "digest", "first", "n")

    def hits(self) -> DataFrame:
        """(run, digest, first, n) of digests that are repeated in their run or that another run's filter may have."""
        every = [x for level in self.levels for x in level]
        runs, maybe = self._runs(every), F.col("n") > 1
        for i, level in enumerate(every):
            pages = self.spark.read.parquet(level.filters).groupBy("page").agg(F.collect_list(F.struct("run", "bits")).alias(f"pages_{i}"))  # a page of each run
            pages = write_table(pages.withColumnRenamed("page", f"page_{i}"), "filter-pages")
            place = _place(level.size)
            runs = runs.withColumn(f"place_{i}", place).join(broadcast_if_small(pages), F.expr(f"place_{i} div {_PAGE}") == F.col(f"page_{i}"), "left")
            byte = f"substring(p.bits, CAST((place_{i} % {_PAGE}) div 8 AS int) + 1, 1)"
            maybe = maybe | F.expr(f"coalesce(exists(pages_{i}, p -> p.run <> run AND (shiftright(CAST(conv(hex({byte}), 16, 10) AS int), CAST(place_{i} % 8 AS int)) & 1) = 1), false)")
        return runs.filter(maybe).select("run", "digest", "first", "n")

    def groups(self) -> DataFrame:
        """(digest, first, n) of the digests that several rows share, from the hits alone. A written table."""
        merged = self.hits().groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        return write_table(merged.filter("n > 1"), "digest-groups")


def _place(size: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(size))


def raw_key() -> Column:
    """A cheap key of a row's text as it stands: it finds rows again, and is trusted for nothing else."""
    return F.concat_ws(":", F.hex(F.xxhash64(text_or_empty())), F.octet_length(text_or_empty())).alias("raw")


def _with_groups(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """entries with first and n (null where a digest has one row)."""
    return join_counted(entries, groups, "digest").select("digest", "sha", "doc_id", "raw", "run", "row", "first", F.coalesce("n", F.lit(1)).alias("n"))


def _verdict(df: DataFrame) -> DataFrame:
    """From (sha, doc_id, raw, run, row, first, n); a digest of one row has no first."""
    stays = F.coalesce((F.col("first.run") == F.col("run")) & (F.col("first.row") == F.col("row")), F.lit(True))
    keep = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return df.select("doc_id", keep.alias("keep_id"), F.col("n").cast("long").alias("group_size"), stays.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "raw")


def _verdicts(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """exact_groups() with the raw key of each row."""
    index = DigestIndex(docs.sparkSession, digest_bytes=digest_bytes)
    index.flush(docs)
    groups, entries = index.groups(), index.entries()
    # byte verification: hits are found again by their raw keys, so only their texts are normalised and hashed once more. A
    # digest's texts are the same if the smallest is the largest; a hot group shrinks to a row per task before the shuffle
    raws = join_counted(entries, groups.select("digest", "n"), "digest").filter("n IS NOT NULL").select("raw").distinct()
    texts = docs.select("doc_id", "text", raw_key()).join(broadcast_if_small(write_table(raws, "hit-keys")), "raw", "left_semi")
    hits = index.keyed(texts).join(broadcast_if_small(groups.select("digest")), "digest", "left_semi")
    collided = write_table(hits.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high")).filter("low <> high").select("digest"), "collided")
    if collided.isEmpty():
        return _verdict(_with_groups(entries, groups))
    # different texts under one digest: those rows are grouped by their bytes
    clean = _with_groups(entries.join(collided, "digest", "left_anti"), groups.join(collided, "digest", "left_anti"))
    rows = hits.join(collided, "digest", "left_semi").select("body", "sha", "doc_id", "raw", F.lit(0).alias("run"), F.monotonically_increasing_id().alias("row"))
    rows = write_table(rows, "collided-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "run", "row")).alias("first")
    exact = rows.groupBy("body").agg(first, F.count("*").alias("n"))
    return _verdict(clean).unionByName(_verdict(rows.join(exact, "body")))


def exact_groups(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of [\x20\\x09-\\x0D] became one space; null is the empty text, and all
    empty texts are one group. Of equal texts the smallest doc_id stays; null doc_ids come last. Of repeated rows (same
    doc_id and text) exactly one has kept = true. An empty table gives no rows; other columns of docs are not read.
    """
    return _verdicts(docs, digest_bytes).drop("raw")


def drop_copies(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """docs, all columns, without the rows that exact_groups does not keep. Of rows that repeat in doc_id and text any one stays.
    Columns may have any names."""
    of_row = F.concat_ws(":", "raw", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    verdicts = _verdicts(docs.select("doc_id", "text"), digest_bytes).filter("group_size > 1")
    keys = write_table(verdicts.groupBy(of_row.alias("key")).agg(F.max("kept").alias("stays"), F.count("*").alias("n")), "copy-keys")
    name, verdict = free_name(docs, "_copy_key"), free_name(docs, "_copy_verdict")
    tagged = docs.withColumn(name, F.concat_ws(":", raw_key(), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    found = keys.select(F.col("key").alias(name), F.struct("stays", "n").alias(verdict))
    met = tagged.join(broadcast_if_small(found), name, "left")
    kept = met.filter(F.coalesce(F.col(f"{verdict}.stays"), F.lit(True)))
    columns = [f"`{c}`" for c in docs.columns]
    if keys.filter("stays AND n > 1").isEmpty():
        return kept.select(*columns)
    several = F.coalesce(F.col(f"{verdict}.n") > 1, F.lit(False))
    return kept.filter(~several).unionByName(kept.filter(several).dropDuplicates([name])).select(*columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its group of equal texts. Nulls are empty texts and null doc_ids come last; of repeated rows one is kept;
    an empty table gives no rows; further columns are not read."""
    return exact_groups(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body)
"""
