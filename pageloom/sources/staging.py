"""Stage tables: where a long plan is cut, the rows go to the folder that all executors share and come back as a scan."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session that names none gets a temporary folder; on a cluster that would not be shared."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='pageloom-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """df as a written table; it lasts as long as the driver."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pageloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)
