"""Findings: tiers in a fixed order of reasons, evidence, summaries, severity, report rows.

facts(id, file, line, exported, public, effect, coverage, hits, python): effect pure, effectful or unknown; coverage hit, miss or unavailable. verdicts(id, reachability); tainted(file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tier(collapsed: bool = False) -> Column:
    """The first reason that applies decides; Python symbols are never certain."""
    col = F.col
    if collapsed:
        return F.lit("maybe")
    return (
        F.when(col("reachability") == "test-only", "maybe")
        .when(col("coverage") == "hit", "maybe")
        .when(col("tainted") | col("public"), "maybe")
        .when(col("exported"), "likely")
        .when(col("effect") == "effectful", "likely")
        .when(col("python"), "likely")
        .otherwise("certain")
    )


def tiers(facts: DataFrame, verdicts: DataFrame, tainted: DataFrame, collapsed: bool = False) -> DataFrame:
    """A finding per symbol that isn't alive; with no entry found (collapsed) everything is maybe and nothing fixable."""
    return judged(facts.join(verdicts, "id"), tainted, collapsed)


def judged(facts: DataFrame, tainted: DataFrame, collapsed: bool = False) -> DataFrame:
    """The same of facts that have their reachability."""
    marks = tainted.select("file").distinct().withColumn("tainted", F.lit(True))
    rows = facts.where("reachability <> 'alive'").join(marks, "file", "left").withColumn("tainted", F.coalesce("tainted", F.lit(False)))
    rows = rows.withColumn("tier", tier(collapsed)).withColumn("collapsed", F.lit(collapsed))
    return rows.withColumn("fixable", (F.col("tier") == "certain") & (F.col("reachability") != "test-only"))


def evidence(findings: DataFrame) -> DataFrame:
    """id, ordinal, ok (true: speaks for removal, false: against, null: not checked), text: five signals of a dead symbol, behind the collapse's if entries did; three of one that tests reach."""
    c, none = F.col, F.lit(None).cast("boolean")

    def signal(ok, text):
        return F.struct(ok.alias("ok"), text.alias("text"))

    yes, no, t = F.lit(True), F.lit(False), F.lit
    hits = F.concat(c("hits").cast("string"), t(" coverage hits"))
    missed = F.when(c("coverage") == "miss", t("0 coverage hits")).otherwise(t("coverage: not available"))
    dead = [
        signal(yes, t("no static references")),
        signal(F.when(c("coverage") == "hit", no).when(c("coverage") == "miss", yes), F.when(c("coverage") == "hit", F.concat(hits, t(" without a static reference"))).otherwise(missed)),
        signal(~c("public"), F.when(c("public"), "part of the public surface").otherwise("not part of the public surface")),
        signal(~c("tainted"), F.when(c("tainted"), "dynamic access in file").otherwise("no dynamic access in file")),
        signal(F.when(c("effect") == "effectful", no).when(c("effect") == "pure", yes), F.concat(t("initializer: "), F.when(c("effect") == "unknown", "not checked").otherwise(c("effect")))),
    ]
    tested = [
        signal(yes, t("no production references")),
        signal(no, t("referenced in tests only")),
        signal(F.when(c("coverage") == "miss", yes).otherwise(none), F.when(c("coverage") == "hit", hits).otherwise(missed)),
    ]
    unseeded = signal(no, t("no production entry was found, so nothing is known to be reached"))
    signals = F.when(c("reachability") == "test-only", F.array(*tested)).when(c("collapsed"), F.array(unseeded, *dead)).otherwise(F.array(*dead))
    return findings.select("id", F.posexplode(signals).alias("at", "s")).select("id", (F.col("at") + 1).cast("long").alias("ordinal"), "s.ok", "s.text")


def summary(findings: DataFrame) -> DataFrame:
    bucket = F.when(F.col("reachability") == "test-only", "test-only").otherwise(F.col("tier"))
    return findings.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def worst_first(findings: DataFrame) -> DataFrame:
    """certain, likely, maybe, test-only; then file and line."""
    rank = F.when(F.col("reachability") == "test-only", 3).when(F.col("tier") == "certain", 0).when(F.col("tier") == "likely", 1).otherwise(2)
    return findings.orderBy(rank, "file", "line", "id")


def maybe_cap(findings: DataFrame, most: int) -> DataFrame:
    return findings.where("tier = 'maybe'").orderBy("file", "line", "id").limit(most)


SEVERITY = {"high": 3, "medium": 2, "low": 1}


def severity() -> Column:
    """Of a finding: low if only tests reach it, else by its tier."""
    return F.when(F.col("reachability") == "test-only", "low").when(F.col("tier") == "certain", "high").when(F.col("tier") == "likely", "medium").otherwise("low")


def gate(findings: DataFrame, hotspots: DataFrame, complexity: DataFrame | None = None, duplication: DataFrame | None = None) -> DataFrame:
    """threshold, fails, n: whether any finding is at least that severe; complexity counts as medium, hotspots and duplication as low."""
    found = findings.select(severity().alias("s"))
    for rows, s in ((hotspots, "low"), (complexity, "medium"), (duplication, "low")):
        found = found if rows is None else found.unionByName(rows.select(F.lit(s).alias("s")))
    rank = F.when(F.col("s") == "high", 3).when(F.col("s") == "medium", 2).otherwise(1)
    counts = found.agg(*[F.count_if(rank >= k).alias(name) for name, k in SEVERITY.items()])
    return counts.select(F.expr("stack(3, 'high', high, 'medium', medium, 'low', low) AS (threshold, n)")).select("threshold", (F.col("n") > 0).alias("fails"), "n")


LEVEL = {"high": "error", "medium": "warning", "low": "note"}


def sarif_rows(findings: DataFrame, hotspots: DataFrame, complexity: DataFrame | None = None, duplication: DataFrame | None = None) -> DataFrame:
    """rule, level, uri, line, message, related array<struct<uri, line>> of every result. hotspots(file, line, name), complexity(detector, file, line, name, message), duplication(tokens, members); a clone is told at its first member, the others are related."""
    level = F.when(severity() == "high", LEVEL["high"]).when(severity() == "medium", LEVEL["medium"]).otherwise(LEVEL["low"])
    none = F.array().cast("array<struct<uri:string,line:bigint>>")

    def rows(df, rule, level, uri, line, message, related=none):
        return df.select(rule.alias("rule"), level.alias("level"), uri.cast("string").alias("uri"), line.cast("long").alias("line"), message.alias("message"), related.alias("related"))

    c, t = F.col, F.lit
    tag = F.when(c("reachability") == "test-only", "test-only").otherwise(c("tier"))
    name = c("name") if "name" in findings.columns else c("id")
    out = rows(findings, t("dead-code"), level, c("file"), c("line"), F.concat(name, t(" ("), tag, t(")")))
    out = out.unionByName(rows(hotspots, t("hotspot"), t(LEVEL["low"]), c("file"), c("line"), c("name").cast("string")))
    if complexity is not None:
        out = out.unionByName(rows(complexity, c("detector"), t(LEVEL["medium"]), c("file"), c("line"), F.concat(c("name"), t(": "), c("message"))))
    if duplication is not None:
        others = F.transform(F.slice("members", F.lit(2), F.size("members")), lambda m: F.struct(m["file"].cast("string").alias("uri"), m["start_line"].cast("long").alias("line")))
        text = F.concat(c("tokens").cast("string"), t(" tokens in "), F.size("members").cast("string"), t(" places"))
        out = out.unionByName(rows(duplication, t("duplication"), t(LEVEL["low"]), c("members")[0]["file"], c("members")[0]["start_line"], text, others))
    return out
