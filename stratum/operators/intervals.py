"""Ranges of lines: merging, overlaps, the innermost one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ahead(ranges: DataFrame, key: str, start: str, stop: str) -> DataFrame:
    """ranges with `reach`: the furthest end of those before."""
    w = Window.partitionBy(key).orderBy(start, stop)
    return ranges.withColumn("reach", F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1)))


def merge_ranges(ranges: DataFrame, key: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """key, start, stop: ranges merged where the next begins at most one after the end."""
    w = Window.partitionBy(key).orderBy(start, stop).rowsBetween(Window.unboundedPreceding, 0)
    r = _ahead(ranges, key, start, stop).withColumn("part", F.sum(F.when(F.col(start) <= F.col("reach") + 1, 0).otherwise(1)).over(w))
    return r.groupBy(key, "part").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("part")


def overlaps(ranges: DataFrame, key: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """key, overlaps: how many ranges begin inside an earlier one; keys without any are left out."""
    return _ahead(ranges, key, start, stop).where(F.col("reach") >= F.col(start)).groupBy(key).agg(F.count("*").alias("overlaps"))


def innermost(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points(file, line, ...) with unit: index of the smallest range(file, start, stop, idx) around the line, the least index of equals, -1 if none."""
    key = points.columns
    r = ranges.select(F.col("file").alias("rf"), "start", "stop", "idx")
    met = points.join(r, (points.file == r.rf) & points.line.between(r.start, r.stop), "left")
    best = met.groupBy(*key).agg(F.min(F.when(F.col("idx").isNotNull(), F.struct((F.col("stop") - F.col("start")).alias("span"), "idx"))).alias("m"))
    return best.select(*key, F.coalesce("m.idx", F.lit(-1)).alias("unit"))
