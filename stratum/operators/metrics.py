"""Complexity of code units: metrics, findings over thresholds, coverage, hotspots.

units(name, file, line, loc, params, control array<struct<category, depth, nests>>); hits(file, line, hits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import crap, risk


def unit_metrics(units: DataFrame) -> DataFrame:
    """units with nesting (deepest nesting node), cognitive (1 a node, more if it nests deeper) and cyclomatic (1 + nodes)."""
    nesting = F.aggregate("control", F.lit(0), lambda a, x: F.greatest(a, F.when(x["nests"], x["depth"] + 1).otherwise(0)))
    cognitive = F.aggregate("control", F.lit(0), lambda a, x: a + F.when(x["nests"], x["depth"] + 1).otherwise(1))
    return units.withColumn("nesting", nesting).withColumn("cognitive", cognitive).withColumn("cyclomatic", F.size("control") + 1)


def complexity_findings(metrics: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """detector, file, line, name, value, threshold, message; strictly above the threshold, worst ratio first."""
    t = {k: F.lit(v) for k, v in thresholds.items()}

    def finding(detector, value, limit, message):
        return F.struct(F.lit(detector).alias("detector"), value.cast("long").alias("value"), limit.cast("long").alias("threshold"), message.alias("message"))

    c = F.col
    long_, wide = c("loc") > t["loc"], c("params") > t["params"]
    reasons = F.concat_ws(", ", F.when(long_, F.concat(c("loc").cast("string"), F.lit(" lines"))), F.when(wide, F.concat(c("params").cast("string"), F.lit(" parameters"))))
    found = [F.when(c(m) > t[m], finding(d, c(m), t[m], F.concat(F.lit(m + " "), c(m).cast("string")))) for d, m in (("deep-nesting", "nesting"), ("cyclomatic-complexity", "cyclomatic"), ("cognitive-complexity", "cognitive"))]
    found.append(F.when(long_ | wide, finding("god-function", F.when(long_, c("loc")).otherwise(c("params")), F.when(long_, t["loc"]).otherwise(t["params"]), reasons)))
    rows = metrics.select("file", "line", "name", F.inline(F.array_compact(F.array(*found))))
    return rows.orderBy(F.try_divide("value", "threshold").desc_nulls_first(), "file", "line", "detector")


def god_functions(findings: DataFrame, most: int = 1) -> DataFrame:
    """The worst god functions among complexity findings, as they are ordered."""
    return findings.where("detector = 'god-function'").limit(most)


def last_hits(records: DataFrame, order: list[str]) -> DataFrame:
    """file, line, hits: the last record of a line wins, in the given order."""
    w = Window.partitionBy("file", "line").orderBy(*[F.desc(c) for c in order])
    return records.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("file", "line", "hits")


def coverage_ratio(units: DataFrame, hits: DataFrame) -> DataFrame:
    """units with coverage: covered of the instrumented lines in the unit; null if none is instrumented. Equal files first, so the range is checked within a file only."""
    h = hits.select(F.col("file").alias("hf"), F.col("line").alias("hl"), "hits")
    inside = (units.file == h.hf) & h.hl.between(units.line, units.line + units["loc"] - 1)
    sums = units.join(h, inside).groupBy("file", "line", "name").agg((F.count_if(F.col("hits") > 0) / F.count("*")).alias("coverage"))
    return units.join(sums, ["file", "line", "name"], "left")


def coverage_status(symbols: DataFrame, functions: DataFrame, hits: DataFrame) -> DataFrame:
    """id, status: by the function's record (name and line; of several the first `ordinal`), else by its line's hits, else unavailable."""
    one = functions.groupBy("file", "name", "line").agg(F.min_by("hits", "ordinal").alias("fn"))
    rows = symbols.join(one, ["file", "name", "line"], "left").join(hits.select("file", "line", F.col("hits").alias("ln")), ["file", "line"], "left")
    n = F.coalesce("fn", "ln")
    return rows.select("id", F.when(n.isNull(), "unavailable").when(n > 0, "hit").otherwise("miss").alias("status"), n.alias("hits"))


def match_reports(files: DataFrame, reports: DataFrame) -> DataFrame:
    """file, report: the report of the same path, else the first (by ordinal) whose path ends in the file's or the other way round, at a path separator.

    Whole paths of one side meet suffixes of the other by equality, and of reports that share a suffix only the first is kept, so nothing is compared with everything and a suffix that many paths share is one row.
    """
    def suffixes(df: DataFrame, path: str) -> DataFrame:
        parts = F.split(path, "/")
        ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))
        return df.withColumn("suffix", F.explode(ends))

    f = files.select("file").distinct()
    r = reports.groupBy("report").agg(F.min("ordinal").alias("ordinal"))
    by_end = suffixes(r, "report").groupBy("suffix").agg(F.min(F.struct("ordinal", "report")).alias("best"))
    longer = f.join(by_end, f.file == by_end.suffix).select("file", F.lit(1).alias("rank"), "best.*")
    shorter = suffixes(f, "file").join(r, F.col("suffix") == F.col("report")).select("file", F.when(F.col("file") == F.col("report"), 0).otherwise(1).alias("rank"), "ordinal", "report")
    return longer.unionByName(shorter).groupBy("file").agg(F.min(F.struct("rank", "ordinal", "report")).alias("best")).select("file", "best.report")


def hotspots(metrics: DataFrame, churn: DataFrame | None, top: int | None = 10) -> DataFrame:
    """name, file, line, complexity, coverage, crap, churn, risk; riskiest first. metrics has cyclomatic and may have coverage."""
    rows = metrics if "coverage" in metrics.columns else metrics.withColumn("coverage", F.lit(None).cast("double"))
    rows = rows.join(churn, "file", "left") if churn is not None else rows.withColumn("churn", F.lit(None).cast("long"))
    rows = rows.withColumn("complexity", F.col("cyclomatic")).withColumn("crap", crap(F.col("complexity"), F.col("coverage")))
    rows = rows.withColumn("risk", risk(F.col("complexity"), F.col("crap"), F.col("churn"))).select("name", "file", "line", "complexity", "coverage", "crap", "churn", "risk")
    rows = rows.orderBy(F.desc("risk"), "file", "line", "name")
    return rows if top is None else rows.limit(top)
