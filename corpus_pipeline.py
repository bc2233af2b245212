"""The corpus pipeline: raw documents to token digests of a clean, deduplicated, mixed corpus.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns documents' columns; the last
returns one row per document of the mix (repeated as often as the mix takes it). Stages are cut by Parquet tables, and what
a stage wrote for itself is removed when its own table stands.

In every stage a null text is an empty one, null doc_ids come after all others, an empty table gives an empty one, and further
columns of any name pass through (the last stage returns its own columns alone).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from pageloom.llm.common import mark, release, write_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores at 0.5 or more go. Repeated rows score alike, and stay or go together."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays; of rows that repeat in doc_id and text, one."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) the smallest doc_id stays; ties go to the
    smaller digest of the text. Texts without words are one group."""
    return near_dedup.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weights: each document as often as the mix takes it. Documents without words go; a null source is a source;
    repeated rows share the copies that the mix gives them."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoding of every document of the mix, and of what it decodes to. A row per row."""
    return bpe.digest_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("byte-level bpe", encode),
]

#: The model's scores and the similarity groups are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        since = mark()
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, since, keep=1)
    return docs
