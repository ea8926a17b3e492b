"""Tables that cut lineage: written to the shared checkpoint folder and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a folder of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: executors and driver need a shared folder")
    own = "file://" + tempfile.mkdtemp(prefix="hypnoframe-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hypnoframe-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    passing(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._hypnoframe_path = path
    return out


def _filed(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def passing(spark: SparkSession, path: str) -> None:
    """Remove ``path`` when the application ends: later plans may read it until then."""
    fs, where = _filed(spark, path)
    fs.deleteOnExit(where)


def discard(df: DataFrame | None) -> None:
    """Remove a settled table that no later plan reads."""
    path = getattr(df, "_hypnoframe_path", None)
    if path:
        fs, where = _filed(df.sparkSession, path)
        fs.delete(where, True)
        fs.cancelDeleteOnExit(where)


def narrow_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB and 2000 rows, so that a worker's memory doesn't follow the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
