"""Why a symbol has its verdict: lookup of a query, the way there, or who refers to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reach


def matches(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query, id of what each query(query) means: an id; else the name after its last colon in a file that ends in what is before; else, without a colon, a bare name."""
    exact = queries.join(nodes.select("id"), F.col("query") == F.col("id")).select("query", "id")
    rest = queries.join(exact.select("query").distinct(), "query", "left_anti")
    hint, last = F.regexp_extract("query", "^(.*):[^:]*$", 1), F.regexp_extract("query", "([^:]*)$", 1)
    rest = rest.select("query", F.when(F.col("query").contains(":"), hint).alias("hint"), last.alias("wanted"))
    named = rest.join(nodes.select("id", "name", "file"), F.col("wanted") == F.col("name")).where(F.col("hint").isNull() | F.expr("endswith(file, hint)"))
    return exact.unionByName(named.select("query", "id"))


def lookup(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query, status (found, ambiguous, not-found), matches, first_id."""
    told = matches(queries, nodes).groupBy("query").agg(F.count("*").alias("matches"), F.min("id").alias("first_id"))
    rows = queries.select("query").distinct().join(told, "query", "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))
    return rows.withColumn("status", F.when(F.col("matches") == 0, "not-found").when(F.col("matches") == 1, "found").otherwise("ambiguous")).select("query", "matches", "status", "first_id")


def explain(query: str, nodes: DataFrame, edges: DataFrame, seeds: DataFrame, verdicts: DataFrame, tainted: DataFrame) -> dict:
    """status; of one symbol its verdict, whether its file is tainted, the witness path (production only for one that is alive) and, for a dead one, its referrers with their verdicts; of several the candidates."""
    spark = nodes.sparkSession
    asked = spark.createDataFrame([(query,)], "query string")
    found = [r["id"] for r in matches(asked, nodes).orderBy("id").collect()]
    if len(found) != 1:
        return {"query": query, "status": "ambiguous" if found else "not-found", "candidates": found}
    node = nodes.where(F.col("id") == found[0]).first()
    verdict = verdicts.where(F.col("id") == node["id"]).first()["reachability"]
    out = {"query": query, "status": "resolved", "id": node["id"], "file": node["file"], "line": node["line"], "reachability": verdict, "witness": None, "inbound": []}
    out["tainted"] = not tainted.where(F.col("file") == node["file"]).isEmpty()
    if verdict == "alive":
        out["witness"] = reach.witness_path(edges.where("kind = 'prod'"), seeds.where("color = 'prod'"), node["id"])
    elif verdict == "test-only":
        out["witness"] = reach.witness_path(edges, seeds, node["id"])
    else:
        refs = reach.inbound_refs(verdicts.where(F.col("id") == node["id"]), edges)
        told = refs.select("id", "referrer").join(verdicts.select(F.col("id").alias("referrer"), "reachability"), "referrer", "left")
        out["inbound"] = sorted((r["referrer"], r["reachability"]) for r in told.toLocalIterator())
    return out
