"""The registry of queries, and the surrogate relations of the benchmark tables that they start from.

A query (metric.py, text.py, graph.py) calls the operators over these relations; its SQL says the same without them, for DuckDB. Surrogates are views in SQL, one text for both engines unless the dialects differ.

Suppliers S<k>, parts P<k>, orders O<k> and customers C<k> are symbols; every lineitem and every order is a reference. Orders are code units; lineitems are their control nodes and coverage hits, with duplicate records (the last by ship date wins); documents and pages are source texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# Views that queries may start from, per dialect where they differ.
VIEWS: dict[str, tuple[str, str]] = {}


def _view(name: str, spark: str, duck: str | None = None) -> None:
    VIEWS[name] = (spark, duck or spark)


_LAST = "l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC"
_view("hits", f"SELECT l_orderkey AS file, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_quantity END AS hits FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LAST}) AS rn FROM lineitem) t WHERE rn = 1")
_view("ratio", "SELECT o_orderkey AS file, o_custkey AS owner, sum(CASE WHEN hits > 0 THEN 1 ELSE 0 END) / nullif(CAST(count(line) AS DOUBLE), 0) AS coverage FROM orders LEFT JOIN hits ON file = o_orderkey GROUP BY o_orderkey, o_custkey")
_view("size", "SELECT l_orderkey AS file, count(*) AS n FROM lineitem GROUP BY l_orderkey")
_view("churn", "SELECT o_custkey AS owner, count(*) AS churn FROM orders GROUP BY o_custkey")
_view(
    "hot",
    "SELECT file, owner, complexity, coverage, crap, churn, coalesce(crap, complexity) * coalesce(churn, 1) AS risk FROM (SELECT ratio.file, ratio.owner, CAST(1 + coalesce(n, 0) AS DOUBLE) AS complexity, coverage, CAST(1 + coalesce(n, 0) AS DOUBLE) * CAST(1 + coalesce(n, 0) AS DOUBLE) * ((1 - coverage) * (1 - coverage) * (1 - coverage)) + CAST(1 + coalesce(n, 0) AS DOUBLE) AS crap, churn FROM ratio LEFT JOIN size ON ratio.file = size.file LEFT JOIN churn ON ratio.owner = churn.owner) t",
)
_view(
    "nodes",
    "SELECT concat('S', CAST(s_suppkey AS VARCHAR(20))) AS id, concat('nation:', CAST(s_nationkey AS VARCHAR(20))) AS file, s_suppkey AS line, s_acctbal > 0 AS exported, s_name AS name FROM supplier UNION ALL SELECT concat('P', CAST(p_partkey AS VARCHAR(20))), concat('brand:', p_brand), p_partkey, p_size % 2 = 0, p_name FROM part UNION ALL SELECT concat('O', CAST(o_orderkey AS VARCHAR(20))), concat('customer:', CAST(o_custkey AS VARCHAR(20))), o_orderkey, o_totalprice > 250000, o_orderstatus FROM orders UNION ALL SELECT concat('C', CAST(c_custkey AS VARCHAR(20))), concat('segment:', c_mktsegment), c_custkey, c_acctbal > 5000, c_name FROM customer",
)
# Suppliers refer to parts that they sold in bulk (in tests, if accepted), parts to suppliers of small open lines; other lines lead from orders to suppliers (returned) and parts (open), and in tests from parts to orders (accepted); customers refer to their orders.
_S, _P, _O = ("concat('S', CAST(l_suppkey AS VARCHAR(20)))", "concat('P', CAST(l_partkey AS VARCHAR(20)))", "concat('O', CAST(l_orderkey AS VARCHAR(20)))")
_view(
    "edges",
    f"SELECT CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_quantity <= 2 THEN {_P} ELSE {_O} END WHEN l_quantity >= 49 THEN {_S} WHEN l_returnflag = 'R' THEN {_O} ELSE {_P} END AS src, CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_quantity <= 2 THEN {_S} ELSE {_P} END WHEN l_quantity >= 49 THEN {_P} WHEN l_returnflag = 'R' THEN {_S} ELSE {_O} END AS dst, CASE WHEN l_returnflag = 'A' THEN 'test' ELSE 'prod' END AS kind FROM lineitem UNION ALL SELECT concat('C', CAST(o_custkey AS VARCHAR(20))), concat('O', CAST(o_orderkey AS VARCHAR(20))), 'prod' FROM orders",
)
_view("seeds", "SELECT 'S1' AS id, 'prod' AS color UNION ALL SELECT 'S2', 'test'")
_view("lines", "SELECT doc_id, lang, source, CAST(at + 1 AS BIGINT) AS pos, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) x AS at, line", "SELECT doc_id, lang, source, CAST(generate_subscripts(a, 1) AS BIGINT) AS pos, unnest(a) AS line FROM (SELECT *, string_split(text, chr(10)) AS a FROM documents) t")
_view(
    "words",
    "SELECT doc_id, lang, CAST(at AS BIGINT) AS pos, word FROM (SELECT doc_id, lang, filter(split(text, '[ \\t\\n\\r]+'), x -> x <> '') AS w FROM documents) t LATERAL VIEW posexplode(w) x AS at, word",
    "SELECT doc_id, lang, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS pos, unnest(w) AS word FROM (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents) t",
)
_view("paths", "SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[?#].*$', '') AS path FROM pages")
_view("control", "SELECT l_orderkey AS unit, l_linenumber - 1 AS depth, l_returnflag <> 'N' AS nests FROM lineitem")
_view(
    "metrics",
    "SELECT unit, CAST(max(CASE WHEN nests THEN depth + 1 ELSE 0 END) AS BIGINT) AS nesting, CAST(sum(CASE WHEN nests THEN 1 + depth ELSE 1 END) AS BIGINT) AS cognitive, CAST(1 + count(*) AS BIGINT) AS cyclomatic FROM control GROUP BY unit",
)
_view("spans", "SELECT l_orderkey AS file, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS INT) % 12 AS b FROM lineitem")
_view("rated", "SELECT documents.doc_id, quality, toxic, n_chars < 500 AS said FROM documents JOIN labels ON labels.doc_id = documents.doc_id")
_view("tainted", "SELECT DISTINCT concat('customer:', CAST(page_id AS VARCHAR(20))) AS file FROM pages WHERE regexp_like(html, 'spam|track[(]1[0-9]*[)]')")

_USES = {v: [w for w in VIEWS if w != v and re.search(rf"\b(FROM|JOIN) {w}\b", t[0])] for v, t in VIEWS.items()}


def _needed(text: str) -> list[str]:
    """Views that a text uses, each after those that it uses itself."""
    out: list[str] = []

    def add(v: str) -> None:
        for w in _USES[v]:
            add(w)
        if v not in out:
            out.append(v)

    for v in VIEWS:
        if re.search(rf"\b(FROM|JOIN) {v}\b", text):
            add(v)
    return out


def _with(text: str, side: int, recursive: bool = False) -> str:
    views = [f"{v} AS ({VIEWS[v][side]})" for v in _needed(text)]
    own = text.strip()
    if own.upper().startswith("WITH "):
        own = own[5:]
        own = own[10:] if own.upper().startswith("RECURSIVE ") else own
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([*views, own])}"
    return f"WITH {', '.join(views)} {own}" if views else own


def _duck(text: str) -> str:
    return text.replace("regexp_like(", "regexp_matches(")


def read(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if os.path.exists(f"{sf_dir}/{t}.parquet") or "://" in sf_dir}


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The text over the tables of sf_dir; the plan is fixed here, so later calls with another folder don't disturb it."""
    full = _with(text, 0)
    for t in TABLES:
        if re.search(rf"\b{t}\b", full):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(full)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def built(name: str, run: Callable[[SparkSession, str], DataFrame], duck: str | None) -> None:
    """Register a query and, if there is one, its SQL."""
    QUERIES[name] = run
    if duck is not None:
        SQL[name] = _duck(_with(duck, 1, recursive=True))
