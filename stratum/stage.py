"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_leaving: set[str] = set()


def stage_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only for a local master without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="stages-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and fixes row placement, whatever executors are lost later. What `discard` doesn't delete goes when the session's JVM ends."""
    spark = df.sparkSession
    folder = f"{stage_root(spark)}/stages-{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if folder not in _leaving:
        fs, where = _at(spark, folder)
        fs.deleteOnExit(where)
        _leaving.add(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def delete(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        fs, where = _at(table.sparkSession, table.stage_path)
        fs.delete(where, True)


def discard(*tables: DataFrame) -> None:
    """The same, and let Spark delete the shuffle files that nothing refers to."""
    delete(*tables)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()
