"""Graph and classification queries: the operators over the surrogate graph, beside recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import entries, explain, reach
from .catalog import built, run_sql


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = run_sql(spark, sf_dir, "SELECT * FROM nodes")
    edges = run_sql(spark, sf_dir, "SELECT * FROM edges")
    return nodes, edges, run_sql(spark, sf_dir, "SELECT * FROM seeds")


_REACH = """p(id) AS (SELECT id FROM seeds WHERE color = 'prod' UNION SELECT dst FROM p JOIN edges ON src = p.id WHERE kind = 'prod'),
a(id) AS (SELECT id FROM seeds UNION SELECT dst FROM a JOIN edges ON src = a.id),
v AS (SELECT nodes.id, nodes.file, nodes.line, nodes.exported, CASE WHEN p.id IS NOT NULL THEN 'alive' WHEN a.id IS NOT NULL THEN 'test-only' ELSE 'dead' END AS reachability FROM nodes LEFT JOIN p ON p.id = nodes.id LEFT JOIN a ON a.id = nodes.id)"""


def _two_color(spark, sf_dir):
    return reach.two_color(*_graph(spark, sf_dir))


built("two_color_reach", _two_color, f"WITH {_REACH} SELECT id, reachability FROM v")
built(
    "witness_path",
    lambda spark, sf_dir: reach.witness_depths(*_graph(spark, sf_dir)),
    "WITH w(id, depth) AS (SELECT DISTINCT id, 0 FROM seeds UNION SELECT dst, depth + 1 FROM w JOIN (SELECT DISTINCT src, dst FROM edges) e ON src = w.id WHERE depth < 64) SELECT nodes.id, CAST(min(depth) AS BIGINT) AS depth FROM w JOIN nodes ON nodes.id = w.id GROUP BY nodes.id",
)


def _edge_assembly(spark, sf_dir):
    nodes, edges, _ = _graph(spark, sf_dir)
    return reach.assembled(edges, nodes)


built("edge_assembly", _edge_assembly, "WITH k AS (SELECT 'prod' AS kind UNION ALL SELECT 'test') SELECT src, dst, kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT src, dst, kind FROM edges UNION ALL SELECT id, file, kind FROM nodes CROSS JOIN k) t GROUP BY src, dst, kind")


def _seed_build(spark, sf_dir):
    nodes, _, seeds = _graph(spark, sf_dir)
    files = run_sql(spark, sf_dir, "SELECT concat('nation:', CAST(n_nationkey AS VARCHAR(20))) AS file FROM nation WHERE n_regionkey = 1")
    return seeds.unionByName(entries.exported_seeds(nodes, files, "prod")).unionByName(entries.file_seeds(files, "prod")).distinct()


built("seed_build", _seed_build, "WITH e AS (SELECT DISTINCT concat('nation:', CAST(n_nationkey AS VARCHAR(20))) AS file FROM nation WHERE n_regionkey = 1) SELECT id, 'prod' AS color FROM nodes WHERE exported AND file IN (SELECT file FROM e) UNION SELECT file, 'prod' FROM e UNION SELECT id, color FROM seeds")
_ASKED = "SELECT s_name AS query FROM supplier UNION ALL SELECT 'S1' UNION ALL SELECT 'brand:Brand#2:red widget' UNION ALL SELECT '#2:red widget' UNION ALL SELECT 'brand:Brand#2:nothing' UNION ALL SELECT 'small ring' UNION ALL SELECT 'nothing'"


def _lookup(spark, sf_dir):
    return explain.lookup(run_sql(spark, sf_dir, _ASKED), _graph(spark, sf_dir)[0])


built(
    "symbol_lookup",
    _lookup,
    f"WITH q AS ({_ASKED}), e AS (SELECT query, id FROM q JOIN nodes ON id = query), m AS (SELECT * FROM e UNION ALL SELECT query, id FROM q JOIN nodes ON query = name WHERE NOT contains(query, ':') AND query NOT IN (SELECT query FROM e) UNION ALL SELECT query, id FROM q JOIN nodes ON ends_with(concat(file, ':', name), query) AND ends_with(query, concat(':', name)) WHERE contains(query, ':') AND query NOT IN (SELECT query FROM e)) SELECT q.query, CAST(count(m.id) AS BIGINT) AS matches, CASE WHEN count(m.id) = 0 THEN 'not-found' WHEN count(m.id) = 1 THEN 'found' ELSE 'ambiguous' END AS status, min(m.id) AS first_id FROM q LEFT JOIN m ON m.query = q.query GROUP BY q.query",
)


def _inbound(spark, sf_dir):
    nodes, edges, seeds = _graph(spark, sf_dir)
    return reach.inbound_refs(reach.two_color(nodes, edges, seeds), edges)


built("inbound_refs", _inbound, f"WITH {_REACH} SELECT DISTINCT d.id, src AS referrer, r.reachability AS referrer_verdict FROM v d JOIN edges ON dst = d.id LEFT JOIN v r ON r.id = src WHERE d.reachability = 'dead' AND src <> dst")


_LINKS = "SELECT concat('customer:', CAST(c_custkey AS VARCHAR(20))) AS src, concat('customer:', CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS VARCHAR(20))) AS dst FROM customer"
_ENTRIES = "SELECT concat('customer:', CAST(c_custkey AS VARCHAR(20))) AS file FROM customer WHERE c_acctbal > 9900"


def _public(spark, sf_dir):
    """Customers' files give on what the file of half their number does."""
    nodes = _graph(spark, sf_dir)[0]
    return entries.public_symbols(nodes, run_sql(spark, sf_dir, _LINKS), run_sql(spark, sf_dir, _ENTRIES))


built("public_api_closure", _public, f"WITH l AS ({_LINKS}), c(file) AS (SELECT file FROM ({_ENTRIES}) e UNION SELECT dst FROM c JOIN l ON src = c.file) SELECT id FROM nodes WHERE exported AND file IN (SELECT file FROM c)")


def _chase(spark, sf_dir):
    links = run_sql(spark, sf_dir, "SELECT c_custkey AS src, (c_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS dst FROM customer")
    declared = run_sql(spark, sf_dir, "SELECT c_custkey AS id FROM customer WHERE c_nationkey < 12")
    starts = run_sql(spark, sf_dir, "SELECT c_custkey AS id FROM customer")
    return reach.chase(links, declared, starts)


built(
    "reexport_chase",
    _chase,
    "WITH d AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey < 12), n AS (SELECT count(*) AS n FROM customer), w(start, cur, seen, hit) AS (SELECT c_custkey, c_custkey, [c_custkey], c_nationkey < 12 FROM customer UNION ALL SELECT start, (cur * 7 + 3) % n, list_append(seen, (cur * 7 + 3) % n), ((cur * 7 + 3) % n) IN (SELECT id FROM d) FROM w, n WHERE NOT hit AND NOT list_contains(seen, (cur * 7 + 3) % n)) SELECT start, max(CASE WHEN hit THEN cur END) AS target FROM w GROUP BY start",
)

_TIER = """t AS (SELECT v.id, v.file, v.line, v.exported, v.reachability, tainted.file IS NOT NULL AS tainted, v.line % 11 = 0 AS public, CASE v.line % 7 WHEN 0 THEN 'effectful' WHEN 1 THEN 'pure' ELSE 'unknown' END AS effect, CASE WHEN v.line % 5 = 0 THEN 'hit' WHEN v.line % 5 = 1 THEN 'miss' ELSE 'unavailable' END AS coverage, v.line % 3 = 0 AS python FROM v LEFT JOIN tainted ON tainted.file = v.file),
f AS (SELECT *, CASE WHEN reachability = 'test-only' THEN 'maybe' WHEN coverage = 'hit' THEN 'maybe' WHEN tainted OR public THEN 'maybe' WHEN exported THEN 'likely' WHEN effect = 'effectful' THEN 'likely' WHEN python THEN 'likely' ELSE 'certain' END AS tier FROM t WHERE reachability <> 'alive')"""


def _findings(spark, sf_dir):
    nodes, edges, seeds = _graph(spark, sf_dir)
    line = F.col("line")
    effect = F.when(line % 7 == 0, "effectful").when(line % 7 == 1, "pure").otherwise("unknown")
    coverage = F.when(line % 5 == 0, "hit").when(line % 5 == 1, "miss").otherwise("unavailable")
    facts = nodes.select("id", "file", "line", "exported", (line % 11 == 0).alias("public"), effect.alias("effect"), coverage.alias("coverage"), (line + 1).alias("hits"), (line % 3 == 0).alias("python"))
    return C.judged(reach.coloured(facts, edges, seeds), run_sql(spark, sf_dir, "SELECT file FROM tainted"))


_FIND = f"WITH {_REACH}, {_TIER}"
built("tier_classify", lambda s, d: _findings(s, d).select("id", "reachability", "tier", "fixable"), f"{_FIND} SELECT id, reachability, tier, reachability <> 'test-only' AND tier = 'certain' AS fixable FROM f")
built(
    "evidence_array",
    lambda s, d: C.evidence(_findings(s, d)),
    f"""{_FIND}, d AS (SELECT * FROM f WHERE reachability = 'dead'), n AS (SELECT * FROM f WHERE reachability <> 'dead'), e AS (
SELECT id, 1 AS ordinal, true AS ok, 'no static references' AS text FROM d
UNION ALL SELECT id, 2, CASE coverage WHEN 'hit' THEN false WHEN 'miss' THEN true END, CASE coverage WHEN 'hit' THEN concat(line + 1, ' coverage hits without a static reference') WHEN 'miss' THEN '0 coverage hits' ELSE 'coverage: not available' END FROM d
UNION ALL SELECT id, 3, NOT public, CASE WHEN public THEN 'part of the public surface' ELSE 'not part of the public surface' END FROM d
UNION ALL SELECT id, 4, NOT tainted, CASE WHEN tainted THEN 'dynamic access in file' ELSE 'no dynamic access in file' END FROM d
UNION ALL SELECT id, 5, CASE effect WHEN 'effectful' THEN false WHEN 'pure' THEN true END, concat('initializer: ', CASE effect WHEN 'unknown' THEN 'not checked' ELSE effect END) FROM d
UNION ALL SELECT id, 1, true, 'no production references' FROM n
UNION ALL SELECT id, 2, false, 'referenced in tests only' FROM n
UNION ALL SELECT id, 3, CASE coverage WHEN 'miss' THEN true END, CASE coverage WHEN 'hit' THEN concat(line + 1, ' coverage hits') WHEN 'miss' THEN '0 coverage hits' ELSE 'coverage: not available' END FROM n)
SELECT id, CAST(ordinal AS BIGINT) AS ordinal, ok, text FROM e""",
)
built("tier_summary", lambda s, d: C.summary(_findings(s, d)), f"{_FIND} SELECT CASE WHEN reachability = 'test-only' THEN 'test-only' ELSE tier END AS bucket, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1")
built("maybe_cap", lambda s, d: C.maybe_cap(_findings(s, d), 25).select("id", "file", "line"), f"{_FIND} SELECT id, file, line FROM f WHERE tier = 'maybe' ORDER BY file, line, id LIMIT 25")
_LEVEL = "CASE WHEN reachability = 'test-only' THEN 'low' WHEN tier = 'certain' THEN 'high' WHEN tier = 'likely' THEN 'medium' ELSE 'low' END"
_SEV = f"s AS (SELECT CASE {_LEVEL} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS rank FROM f UNION ALL SELECT 1 FROM hot UNION ALL SELECT 2 FROM metrics WHERE cognitive > 15)"


def _hot(spark, sf_dir):
    return run_sql(spark, sf_dir, "SELECT CAST(owner AS VARCHAR(20)) AS file, file AS line, 'hotspot' AS name FROM hot")


def _complex(spark, sf_dir):
    return run_sql(spark, sf_dir, "SELECT 'cognitive-complexity' AS detector, 'orders' AS file, unit AS line, 'unit' AS name, CAST(cognitive AS STRING) AS message FROM metrics WHERE cognitive > 15")


built("severity_gate", lambda s, d: C.gate(_findings(s, d), _hot(s, d), _complex(s, d)), f"{_FIND}, {_SEV}, g AS (SELECT 'high' AS threshold, 3 AS least UNION ALL SELECT 'medium', 2 UNION ALL SELECT 'low', 1) SELECT threshold, coalesce(bool_or(rank >= least), false) AS fails, CAST(count(*) FILTER (WHERE rank >= least) AS BIGINT) AS n FROM g CROSS JOIN s GROUP BY threshold")


def _sarif(spark, sf_dir):
    clones = run_sql(spark, sf_dir, "SELECT 50 AS tokens, array_sort(collect_list(named_struct('file', CAST(l_suppkey AS STRING), 'start_line', l_linenumber, 'end_line', l_linenumber + 3))) AS members FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber FROM lineitem WHERE l_quantity = 1) GROUP BY l_orderkey")
    return C.sarif_rows(_findings(spark, sf_dir), _hot(spark, sf_dir), _complex(spark, sf_dir), clones).withColumn("related", F.size("related").cast("long"))


built(
    "sarif_rows",
    _sarif,
    f"{_FIND}, c AS (SELECT l_orderkey, count(*) AS n, min((CAST(l_suppkey AS VARCHAR), l_linenumber)) AS k FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber FROM lineitem WHERE l_quantity = 1) GROUP BY l_orderkey) SELECT 'dead-code' AS rule, CASE {_LEVEL} WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, file AS uri, CAST(line AS BIGINT) AS line, concat(id, ' (', CASE WHEN reachability = 'test-only' THEN 'test-only' ELSE tier END, ')') AS message, CAST(0 AS BIGINT) AS related FROM f UNION ALL SELECT 'hotspot', 'note', CAST(owner AS VARCHAR), file, 'hotspot', 0 FROM hot UNION ALL SELECT 'cognitive-complexity', 'warning', 'orders', unit, concat('unit: ', cognitive), 0 FROM metrics WHERE cognitive > 15 UNION ALL SELECT 'duplication', 'note', k[1], k[2], concat('50 tokens in ', n, ' places'), n - 1 FROM c",
)
