"""A graph kept between scans: its tables as parquet beside a manifest of what they were made from. A hit needs the same files with the same content, settings and version; anything else is a miss, never an error."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.score import content_hashes, snapshot_diff_hashes

VERSION = "1"


def fingerprint(settings: dict) -> str:
    return hashlib.sha256(json.dumps([VERSION, settings], sort_keys=True).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, texts: DataFrame, settings: dict, build: Callable[[], dict[str, DataFrame]]) -> tuple[dict[str, DataFrame], bool]:
    """(tables, whether they were kept): those in folder if they are of texts(file, text) and settings, else what build gives, which is kept. Contents are compared by Spark; only one line of settings reaches the driver."""
    now, mark = content_hashes(texts), fingerprint(settings)
    kept = _kept(spark, folder, mark)
    if kept is not None and snapshot_diff_hashes(spark.read.parquet(f"{folder}/{mark}/manifest"), now).isEmpty():
        return {name: spark.read.parquet(f"{folder}/{mark}/{name}") for name in kept}, True
    tables = build()
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{mark}/{name}")
    now.write.mode("overwrite").parquet(f"{folder}/{mark}/manifest")
    spark.createDataFrame([(n,) for n in tables], "name string").write.mode("overwrite").parquet(f"{folder}/{mark}/names")  # last, so that a broken run is a miss
    return {name: spark.read.parquet(f"{folder}/{mark}/{name}") for name in tables}, False


def _kept(spark: SparkSession, folder: str, mark: str) -> list[str] | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{mark}/names/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return [r["name"] for r in spark.read.parquet(f"{folder}/{mark}/names").orderBy(F.col("name")).collect()]
