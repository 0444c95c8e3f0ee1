"""Scoring: confusion matrices, rates, runs, changed snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(cases: DataFrame, truth: str = "truth", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, prec, rec, f1 of two boolean columns; precision is 1 without positives said, recall 1 without positives there, f1 0 if both are 0."""
    t, p = F.col(truth), F.col(predicted)
    c = cases.groupBy(*(by or [])).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    c = c.withColumn("prec", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(1.0)))
    c = c.withColumn("rec", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(1.0)))
    return c.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")), F.lit(0.0)))


def over_runs(runs: DataFrame, metric: str) -> DataFrame:
    return runs.agg(F.min(metric).alias("least"), F.avg(metric).alias("mean"), F.max(metric).alias("most"))


def run_summary(runs: DataFrame, metric: str, counted: str) -> DataFrame:
    """least, mean, most of a metric over runs(metric, counted), and the mean count, halves rounded up."""
    return over_runs(runs, metric).crossJoin(runs.agg(F.floor(F.avg(counted) + 0.5).cast("long").alias(counted)))  # one row each


def class_balance(cases: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """truth, n, missed: cases of each class and how many of them were said wrong."""
    return cases.groupBy(truth).agg(F.count("*").alias("n"), F.count_if(F.col(truth) != F.col(predicted)).alias("missed"))


def first_seen(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """keys, n, first_seen of groups without null in the first key, in order of appearance."""
    return rows.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(ordinal).alias("first_seen")).orderBy("first_seen")


def resolution_rate(candidates: DataFrame, resolved: str = "resolved") -> DataFrame:
    """rate, candidates: the share that is resolved, 0 without any."""
    return candidates.agg(F.coalesce(F.try_divide(F.count_if(resolved), F.count("*")), F.lit(0.0)).alias("rate"), F.count("*").alias("candidates"))


def content_hashes(texts: DataFrame, key: str = "file", content: str = "text") -> DataFrame:
    return texts.select(key, F.sha2(content, 256).alias("hash"))


def pass_rate(cases: DataFrame, passed: str = "passed", by: list[str] | None = None) -> DataFrame:
    """1 without cases."""
    return cases.groupBy(*(by or [])).agg(F.coalesce(F.avg(F.col(passed).cast("double")), F.lit(1.0)).alias("rate"), F.count(passed).alias("n"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """key, state: added, removed or changed."""
    a, b = before.select(key, F.sha2(content, 256).alias("a")), after.select(key, F.sha2(content, 256).alias("b"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, key, "full").select(key, state.alias("state")).where("state IS NOT NULL")


def snapshot_diff_hashes(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, state of two tables of content_hashes."""
    a, b = before.withColumnRenamed("hash", "a"), after.withColumnRenamed("hash", "b")
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "file", "full").select("file", state.alias("state")).where("state IS NOT NULL")


def predictions(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """cases(file, symbol, ...) with predicted: whether a finding calls the symbol dead, likely or certainly."""
    said = findings.where("reachability = 'dead' AND tier IN ('likely', 'certain')").select("file", F.col("name").alias("symbol")).distinct().withColumn("predicted", F.lit(True))
    return cases.join(said, ["file", "symbol"], "left").withColumn("predicted", F.coalesce("predicted", F.lit(False)))


def meets(scores: DataFrame, least: dict[str, float]) -> bool:
    """Whether a row of scores reaches every given threshold."""
    row = scores.first()
    return all(row[k] is not None and row[k] >= v for k, v in least.items())


def upsert(carried: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    return fresh.unionByName(carried.join(fresh, key, "left_anti"))


def multisets(a: DataFrame, b: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """group, equal: whether both sides have the same rows of keys, as often."""
    x, y = (t.groupBy(group, *keys).agg(F.count("*").alias(n)) for t, n in ((a, "x"), (b, "y")))
    same = F.coalesce("x", F.lit(0)) == F.coalesce("y", F.lit(0))
    return x.join(y, [group, *keys], "full").groupBy(group).agg(F.every(same).alias("equal"))


def same_multiset(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    x = a.groupBy(*keys).agg(F.count("*").alias("n"))
    y = b.groupBy(*keys).agg(F.count("*").alias("n"))
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def suppress(findings: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """findings that the baseline doesn't have."""
    return findings.join(baseline.select(*keys).distinct(), keys, "left_anti")


def suppress_marked(findings: DataFrame, texts: DataFrame, marker: str) -> DataFrame:
    """findings(file, line, ...) whose line and the line above don't hold the marker. Only the numbers of marked lines leave the texts."""
    marked = texts.where(F.col("text").contains(marker)).select("file", F.posexplode(F.split("text", "\n")).alias("at", "content")).where(F.col("content").contains(marker))
    lines = marked.select("file", F.explode(F.array(F.col("at") + 1, F.col("at") + 2)).alias("line")).distinct()
    return findings.join(lines, ["file", "line"], "left_anti").select(*findings.columns)
