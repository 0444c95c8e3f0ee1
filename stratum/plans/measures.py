"""Queries of metrics, coverage, ranges, scores and entries: operators over the surrogate relations, beside SQL that does without them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import plugins
from ..functions.scalars import exported_python
from ..operators import effects, entries, intervals, metrics, score, triage
from ..sources import files, python_code
from .catalog import built, run_sql

_NESTS = "named_struct('category', 'branch', 'depth', CAST(l_linenumber - 1 AS INT), 'nests', l_returnflag <> 'N')"


def _units(spark, sf_dir) -> DataFrame:
    """Orders as units of ten lines in the file of their customer."""
    return run_sql(spark, sf_dir, f"SELECT CAST(o_custkey AS STRING) AS file, CAST(o_orderkey AS STRING) AS name, o_orderkey * 10 AS line, 10 AS loc, 0 AS params, coalesce(control, array()) AS control FROM orders LEFT JOIN (SELECT l_orderkey, collect_list({_NESTS}) AS control FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")


_RECENT = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_HITS = "CASE WHEN l_returnflag = 'R' THEN 0.0D ELSE l_quantity END AS hits"


def _hits(spark, sf_dir) -> DataFrame:
    rows = run_sql(spark, sf_dir, f"SELECT CAST(o_custkey AS STRING) AS file, o_orderkey * 10 + l_linenumber AS line, {_HITS}, {', '.join(_RECENT)} FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
    return metrics.last_hits(rows, _RECENT)


def _measured(spark, sf_dir) -> DataFrame:
    return metrics.unit_metrics(_units(spark, sf_dir))


def hotspot_topn(spark, sf_dir):
    churn = files.churn(run_sql(spark, sf_dir, "SELECT CAST(o_custkey AS STRING) AS file FROM orders"))
    hot = metrics.hotspots(metrics.coverage_ratio(_measured(spark, sf_dir), _hits(spark, sf_dir)), churn, 50)
    return hot.select(F.col("name").cast("long").alias("o_orderkey"), F.col("complexity").cast("double").alias("complexity"), "coverage", "crap", "churn", "risk")


built("hotspot_topn", hotspot_topn, "SELECT file AS o_orderkey, complexity, coverage, crap, CAST(churn AS BIGINT) AS churn, risk FROM hot ORDER BY risk DESC, CAST(owner AS VARCHAR), file LIMIT 50")
built("coverage_ratio_range", lambda s, d: metrics.coverage_ratio(_units(s, d), _hits(s, d)).select(F.col("name").cast("long").alias("o_orderkey"), "coverage"), "SELECT file AS o_orderkey, coverage FROM ratio")

_SYMBOLS = "SELECT DISTINCT l_orderkey AS file, l_linenumber AS line FROM lineitem UNION ALL SELECT o_orderkey, 9 FROM orders"
_FNS = f"SELECT l_orderkey AS file, l_linenumber AS line, l_quantity - 25 AS hits, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_RECENT)}) AS ordinal FROM lineitem WHERE l_returnflag = 'A'"


def coverage_status(spark, sf_dir):
    symbols = run_sql(spark, sf_dir, f"SELECT struct(file, line) AS id, file, 'f' AS name, line FROM ({_SYMBOLS})")
    functions = run_sql(spark, sf_dir, f"SELECT file, 'f' AS name, line, hits, ordinal FROM ({_FNS})")
    lines = metrics.last_hits(run_sql(spark, sf_dir, f"SELECT l_orderkey AS file, l_linenumber AS line, {_HITS}, {', '.join(_RECENT)} FROM lineitem"), _RECENT)
    return metrics.coverage_status(symbols, functions, lines).select("id.file", F.col("id.line").cast("long").alias("line"), "status", "hits")


built("coverage_status", coverage_status, f"WITH y AS ({_SYMBOLS}), f AS ({_FNS}), m AS (SELECT y.file, y.line, coalesce(f.hits, hits.hits) AS hits FROM y LEFT JOIN f ON f.file = y.file AND f.line = y.line AND ordinal = 1 LEFT JOIN hits ON hits.file = y.file AND hits.line = y.line) SELECT file, CAST(line AS BIGINT) AS line, CASE WHEN hits IS NULL THEN 'unavailable' WHEN hits > 0 THEN 'hit' ELSE 'miss' END AS status, hits FROM m")

_N = "CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS BIGINT)"


def _reports(spark, sf_dir, between: str, block: str) -> DataFrame:
    """One report a customer, with a block an order; x holds its lines in order of shipping, each as number and hits with a text between them."""
    ordered = f"sort_array(collect_list(struct(l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linenumber, l_returnflag, concat(l_linenumber, '{between}', {_N}) AS said)))"
    rows = run_sql(spark, sf_dir, f"SELECT o_custkey, o_orderkey, o_orderstatus, x.said AS x FROM orders LEFT JOIN (SELECT l_orderkey, {ordered} AS x FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
    return rows.select("o_custkey", F.expr(block).alias("block")).groupBy("o_custkey").agg(F.concat_ws("\n", F.collect_list("block")).alias("value"))


def lcov_sessionize(spark, sf_dir):
    block = "concat_ws('\\n', concat('SF:', o_orderkey), 'FN:1,main', CASE WHEN o_orderstatus = 'F' THEN concat('FNDA:', coalesce(size(x), 0), ',main') END, concat('DA:', array_join(x, '\\nDA:')), 'end_of_record')"
    return files.parsed_reports(_reports(spark, sf_dir, ",", block)).select("file", "kind", F.col("line").cast("long").alias("line"), "hits")


built("lcov_sessionize", lcov_sessionize, "SELECT CAST(file AS VARCHAR) AS file, 'line' AS kind, CAST(line AS BIGINT) AS line, CAST(hits AS BIGINT) AS hits FROM hits UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'fn', 1, CASE WHEN o_orderstatus = 'F' THEN coalesce(n, 0) ELSE 0 END FROM orders LEFT JOIN size ON file = o_orderkey")


def xml_extract_merge(spark, sf_dir):
    """A class element a record, so that every file has several."""
    start, end = "'<class name=\"c\" filename=\"', o_orderkey, '\"><line number=\"'", "'\"/></class>'"
    block = f"concat({start}, array_join(x, concat({end}, {start})), {end})"
    texts = _reports(spark, sf_dir, '" hits="', block).select(F.concat(F.lit("<coverage>"), "value", F.lit("</coverage>")).alias("value"))
    return files.parsed_reports(texts).select("file", F.col("line").cast("long").alias("line"), "hits")


built("xml_extract_merge", xml_extract_merge, "SELECT CAST(file AS VARCHAR) AS file, CAST(line AS BIGINT) AS line, CAST(hits AS BIGINT) AS hits FROM hits")


def suffix_path_join(spark, sf_dir):
    paths = run_sql(spark, sf_dir, "SELECT page_id, host, path FROM paths")
    return metrics.match_reports(paths.select(F.concat("host", F.lit("/"), "path").alias("file")), paths.select(F.col("path").alias("report"), F.col("page_id").alias("ordinal")))


built("suffix_path_join", suffix_path_join, "WITH f AS (SELECT DISTINCT concat(host, '/', path) AS file FROM paths), r AS (SELECT path AS report, min(page_id) AS ordinal FROM paths GROUP BY path), m AS (SELECT file, report, row_number() OVER (PARTITION BY file ORDER BY CASE WHEN file = report THEN 0 ELSE 1 END, ordinal) AS rn FROM f JOIN r ON file = report OR ends_with(file, concat('/', report)) OR ends_with(report, concat('/', file))) SELECT file, report FROM m WHERE rn = 1")


def innermost_interval(spark, sf_dir):
    points = run_sql(spark, sf_dir, "SELECT l_orderkey AS file, l_linenumber AS line, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber")
    ranges = run_sql(spark, sf_dir, "SELECT o_orderkey AS file, inline(from_json('[{\"start\":1,\"stop\":7,\"idx\":0},{\"start\":2,\"stop\":4,\"idx\":1},{\"start\":5,\"stop\":6,\"idx\":2}]', 'array<struct<start:int,stop:int,idx:int>>')) FROM orders WHERE o_orderstatus <> 'P'")
    return intervals.innermost(points, ranges).select(F.col("file").alias("l_orderkey"), F.col("line").cast("long").alias("line"), F.col("unit").cast("long").alias("unit"), "n")


built("innermost_interval", innermost_interval, "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(CASE WHEN o_orderkey IS NULL THEN -1 WHEN l_linenumber BETWEEN 2 AND 4 THEN 1 WHEN l_linenumber BETWEEN 5 AND 6 THEN 2 ELSE 0 END AS BIGINT) AS unit, CAST(count(*) AS BIGINT) AS n FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = l_orderkey GROUP BY ALL")
built("churn_count", lambda s, d: files.churn(run_sql(s, d, "SELECT user_id AS file FROM events")).select(F.col("file").alias("user_id"), "churn"), "SELECT user_id, CAST(count(*) AS BIGINT) AS churn FROM events GROUP BY user_id")

_MEASURES = "m AS (SELECT o_orderkey AS unit, coalesce(nesting, 0) AS nesting, coalesce(cognitive, 0) AS cognitive, coalesce(cyclomatic, 1) AS cyclomatic FROM orders LEFT JOIN metrics ON unit = o_orderkey)"
built("unit_metrics", lambda s, d: _measured(s, d).select(F.col("name").cast("long").alias("unit"), *[F.col(c).cast("long").alias(c) for c in ("nesting", "cognitive", "cyclomatic")]), f"WITH {_MEASURES} SELECT unit, nesting, cognitive, cyclomatic FROM m")


def complexity_unpivot(spark, sf_dir):
    sized = _measured(spark, sf_dir).withColumn("loc", F.col("cognitive") * 4).withColumn("params", F.col("cyclomatic") - 1)
    found = metrics.complexity_findings(sized, {"nesting": 3, "cyclomatic": 10, "cognitive": 15, "loc": 50, "params": 5})
    return found.select(F.col("name").cast("long").alias("unit"), "detector", "value", "threshold", "message", (F.col("value") / F.col("threshold")).alias("excess"))


built(
    "complexity_unpivot",
    complexity_unpivot,
    f"WITH {_MEASURES}, s AS (SELECT *, cognitive * 4 AS loc, cyclomatic - 1 AS params FROM m), f AS (SELECT unit, 'deep-nesting' AS detector, nesting AS value, 3 AS threshold, concat('nesting ', nesting) AS message FROM s WHERE nesting > 3 UNION ALL SELECT unit, 'cyclomatic-complexity', cyclomatic, 10, concat('cyclomatic ', cyclomatic) FROM s WHERE cyclomatic > 10 UNION ALL SELECT unit, 'cognitive-complexity', cognitive, 15, concat('cognitive ', cognitive) FROM s WHERE cognitive > 15 UNION ALL SELECT unit, 'god-function', CASE WHEN loc > 50 THEN loc ELSE params END, CASE WHEN loc > 50 THEN 50 ELSE 5 END, concat_ws(', ', CASE WHEN loc > 50 THEN concat(loc, ' lines') END, CASE WHEN params > 5 THEN concat(params, ' parameters') END) FROM s WHERE loc > 50 OR params > 5) SELECT unit, detector, CAST(value AS BIGINT) AS value, CAST(threshold AS BIGINT) AS threshold, message, value / CAST(threshold AS DOUBLE) AS excess FROM f",
)
built(
    "interval_merge",
    lambda s, d: intervals.merge_ranges(run_sql(s, d, "SELECT file, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line FROM spans"), "file", "start_line", "end_line"),
    "WITH r AS (SELECT file, a, b, max(b) OVER (PARTITION BY file ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans), p AS (SELECT file, a, b, sum(CASE WHEN a <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM r) SELECT file, CAST(min(a) AS BIGINT) AS start_line, CAST(max(b) AS BIGINT) AS end_line FROM p GROUP BY file, part",
)
built("interval_overlap_check", lambda s, d: intervals.overlaps(run_sql(s, d, "SELECT file, a, b FROM spans"), "file", "a", "b"), "WITH r AS (SELECT file, a, max(b) OVER (PARTITION BY file ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans) SELECT file, CAST(count(*) AS BIGINT) AS overlaps FROM r WHERE reach >= a GROUP BY file")


def exported_predicate(spark, sf_dir):
    parts = run_sql(spark, sf_dir, "SELECT p_partkey, concat(CASE p_size % 4 WHEN 0 THEN '_' WHEN 1 THEN '__' WHEN 2 THEN 'test_' ELSE '' END, replace(p_name, ' ', '_'), CASE WHEN p_size % 8 = 1 THEN '__' ELSE '' END) AS name FROM part")
    return parts.select("p_partkey", exported_python(F.col("name"), F.array(F.lit("_small_ring"), F.lit("__red_widget"))).alias("exported"))


built("exported_predicate", exported_predicate, "SELECT p_partkey, (p_size % 4 > 1 OR p_size % 8 = 1 OR (p_size % 4 = 0 AND p_name = 'small ring') OR (p_size % 4 = 1 AND p_name = 'red widget')) AS exported FROM part")
built("baseline_antijoin", lambda s, d: score.suppress(run_sql(s, d, "SELECT p_partkey, p_name FROM part"), run_sql(s, d, "SELECT p_partkey, p_name FROM part WHERE p_size < 20"), ["p_partkey", "p_name"]), "SELECT p_partkey, p_name FROM part WHERE p_size >= 20")
built(
    "confusion_matrix",
    lambda s, d: score.confusion(run_sql(s, d, "SELECT quality = 0 AS truth, said AS predicted FROM rated")),
    "WITH c AS (SELECT CAST(sum(CASE WHEN quality = 0 AND said THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN quality = 1 AND said THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN quality = 0 AND NOT said THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM rated), r AS (SELECT tp, fp, fn, CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / nullif(tp + fp, 0) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / nullif(tp + fn, 0) END AS r FROM c) SELECT tp, fp, fn, CAST(p AS DOUBLE) AS prec, CAST(r AS DOUBLE) AS rec, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / nullif(p + r, 0) END AS f1 FROM r",
)
built("class_balance", lambda s, d: score.class_balance(run_sql(s, d, "SELECT quality = 0 AS truth, said AS predicted FROM rated")), "SELECT quality = 0 AS truth, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE (quality = 0) <> said) AS BIGINT) AS missed FROM rated GROUP BY 1")


def run_variance(spark, sf_dir):
    runs = run_sql(spark, sf_dir, "SELECT doc_id % 3 AS run, avg(CAST(quality AS DOUBLE)) AS rate, CAST(sum(toxic) AS DOUBLE) AS toxic FROM labels GROUP BY doc_id % 3")
    # a sum of three has no fixed order
    return score.run_summary(runs, "rate", "toxic").withColumn("mean", F.round("mean", 9))


built("run_variance", run_variance, "WITH b AS (SELECT doc_id % 3 AS run, avg(CAST(quality AS DOUBLE)) AS rate, CAST(sum(toxic) AS DOUBLE) AS n FROM labels GROUP BY doc_id % 3) SELECT min(rate) AS least, round(avg(rate), 9) AS mean, max(rate) AS most, CAST(floor(avg(n) + 0.5) AS BIGINT) AS toxic FROM b")
built("pass_rate", lambda s, d: score.pass_rate(run_sql(s, d, "SELECT lang, quality = 1 AS passed FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id"), by=["lang"]), "SELECT lang, coalesce(avg(CAST(CASE quality WHEN 1 THEN 1 WHEN 0 THEN 0 END AS DOUBLE)), CAST(1 AS DOUBLE)) AS rate, CAST(count(quality) AS BIGINT) AS n FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id GROUP BY lang")
built("first_seen_groups", lambda s, d: score.first_seen(run_sql(s, d, "SELECT doc_id, source, lang FROM documents"), ["source", "lang"], "doc_id"), "SELECT source, lang, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_seen FROM documents WHERE source IS NOT NULL GROUP BY source, lang")
built("resolution_rate", lambda s, d: score.resolution_rate(run_sql(s, d, "SELECT o_orderkey IS NOT NULL AS resolved FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey WHERE l_returnflag <> 'A'")), "SELECT coalesce(CAST(sum(CASE WHEN o_orderkey IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0), 0.0) AS rate, CAST(count(*) AS BIGINT) AS candidates FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = l_orderkey WHERE l_returnflag <> 'A'")

# Pages as Python files: every fourth one is a package.
_FILE = "concat(regexp_replace(path, '([.]html|/)$', ''), CASE WHEN page_id % 4 = 0 THEN '/__init__.py' ELSE '.py' END)"
_PAGES = f"SELECT DISTINCT page_id, {_FILE} AS file FROM paths WHERE path <> ''"
_MODULE = "replace(regexp_replace(regexp_replace(file, '[.]py$', ''), '/__init__$', ''), '/', '.')"


def module_map(spark, sf_dir):
    return python_code.modules(run_sql(spark, sf_dir, f"SELECT DISTINCT file FROM ({_PAGES})"), ["", "en", "fr"])


built("module_map", module_map, f"WITH p AS ({_PAGES}), m AS (SELECT DISTINCT file, regexp_replace({_MODULE}, '^(en|fr)[.]', '') AS module FROM p) SELECT file, module FROM m")


def import_resolve(spark, sf_dir):
    """Each page imports a name that isn't there from itself, a neighbour from its package, and itself."""
    mods = python_code.modules(run_sql(spark, sf_dir, f"SELECT DISTINCT file FROM ({_PAGES})"), [""])
    ir = run_sql(spark, sf_dir, f"SELECT DISTINCT file, {_MODULE} AS m, page_id FROM ({_PAGES})")

    def imported(kind: str, line: int, module: str, level: int, name: str, alias: str) -> str:
        return f"named_struct('kind', '{kind}', 'line', {line}, 'module', {module}, 'level', {level}, 'name', CAST({name} AS STRING), 'alias', CAST({alias} AS STRING))"

    imports = ", ".join([imported("from", 1, "m", 0, "'x'", "NULL"), imported("from", 2, "''", 1, "page_id + 1", "'y'"), imported("import", 3, "m", 0, "NULL", "NULL")])
    return python_code.resolved_imports(ir.select("file", F.expr(f"array({imports})").alias("imports")), mods).select("file", F.col("ordinal").cast("long").alias("ordinal"), "local", "target", "whole")


built(
    "import_resolve",
    import_resolve,
    f"WITH p AS ({_PAGES}), q AS (SELECT DISTINCT file, page_id, {_MODULE} AS m FROM p), t AS (SELECT m, max(file) AS target FROM q GROUP BY m), g AS (SELECT *, CASE WHEN ends_with(file, '__init__.py') THEN m WHEN contains(m, '.') THEN regexp_replace(m, '[.][^.]*$', '') ELSE '' END AS pkg FROM q), r AS (SELECT *, concat(CASE WHEN pkg = '' THEN '' ELSE concat(pkg, '.') END, page_id + 1) AS near FROM g) SELECT r.file, CAST(0 AS BIGINT) AS ordinal, 'x' AS local, coalesce(s.target, a.target) AS target, s.target IS NOT NULL AS whole FROM r LEFT JOIN t a ON a.m = r.m LEFT JOIN t s ON s.m = concat(r.m, '.x') UNION ALL SELECT r.file, 1, 'y', coalesce(s.target, b.target), s.target IS NOT NULL FROM r LEFT JOIN t s ON s.m = near LEFT JOIN t b ON b.m = pkg UNION ALL SELECT r.file, 2, string_split(r.m, '.')[1], a.target, true FROM r LEFT JOIN t a ON a.m = r.m",
)


def entry_spec_resolve(spark, sf_dir):
    pages = run_sql(spark, sf_dir, f"SELECT page_id, file, {_MODULE} AS module FROM ({_PAGES})")
    specs = pages.select("page_id", F.concat("module", F.when(F.col("page_id") % 5 < 4, F.concat(F.lit(":f"), (F.col("page_id") % 5).cast("string"))).otherwise("")).alias("spec"))
    declared = pages.select("file", F.concat(F.lit("f"), (F.col("page_id") % 3).cast("string")).alias("name")).distinct().withColumn("id", F.concat("file", F.lit(":1:"), "name"))
    return entries.module_specs(specs, pages.select("file", "module"), declared).select("page_id", "file", "symbol")


built("entry_spec_resolve", entry_spec_resolve, f"WITH p AS (SELECT page_id, file, {_MODULE} AS module FROM ({_PAGES}) x), t AS (SELECT module, max(file) AS file FROM p GROUP BY module), d AS (SELECT DISTINCT file, page_id % 3 AS k FROM p) SELECT p.page_id, t.file, CASE WHEN d.k IS NOT NULL THEN concat(t.file, ':1:f', d.k) END AS symbol FROM p JOIN t ON t.module = p.module LEFT JOIN d ON d.file = t.file AND d.k = p.page_id % 5")


def dist_to_src(spark, sf_dir):
    """Built pages and the sources that some have."""
    pages = run_sql(spark, sf_dir, "SELECT page_id, concat('dist/', path, '.js') AS built, concat('src/', path, CASE page_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '.rs' END) AS file FROM paths")

    def candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, c, i) for k, b in zip(f["page_id"], f["built"], strict=True) for i, c in enumerate(files.source_candidates(b))]
            yield pd.DataFrame(rows, columns=["page_id", "file", "place"])

    told = pages.select("page_id", "built").mapInPandas(candidates, "page_id long, file string, place int")
    return entries.first_existing(told, pages.select("file"), ["page_id"]).select("page_id", "file", F.col("place").cast("long").alias("place"))


built("dist_to_src", dist_to_src, "WITH c AS (SELECT page_id, concat('src/', path, '.ts') AS file, 0 AS place FROM paths UNION ALL SELECT page_id, concat('src/', path, '.tsx'), 1 FROM paths), e AS (SELECT DISTINCT concat('src/', path, CASE page_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '.rs' END) AS file FROM paths), m AS (SELECT page_id, file, place, row_number() OVER (PARTITION BY page_id ORDER BY place) AS rn FROM c WHERE file IN (SELECT file FROM e)) SELECT page_id, file, CAST(place AS BIGINT) AS place FROM m WHERE rn = 1")
_FOUND = "SELECT p_partkey, 'scripts' AS source FROM part WHERE p_type = 'ECONOMY' UNION ALL SELECT p_partkey, 'manifest' FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, 'convention' FROM part WHERE p_brand IN ('Brand#1', 'Brand#7') UNION ALL SELECT p_partkey, 'mapped' FROM part WHERE p_name LIKE 'red%'"
built("entry_priority_dedup", lambda s, d: entries.first_source(entries.ranked(run_sql(s, d, _FOUND).withColumnRenamed("p_partkey", "file"))).select(F.col("file").alias("p_partkey"), "source"), "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'manifest' WHEN p_name LIKE 'red%' THEN 'mapped' WHEN p_brand IN ('Brand#1', 'Brand#7') THEN 'convention' ELSE 'scripts' END AS source FROM part WHERE p_size > 40 OR p_name LIKE 'red%' OR p_brand IN ('Brand#1', 'Brand#7') OR p_type = 'ECONOMY'")


def token_exists_semi(spark, sf_dir):
    said = run_sql(spark, sf_dir, "SELECT DISTINCT word AS token, word AS file, 0 AS place FROM words")
    return entries.first_existing(said, run_sql(spark, sf_dir, "SELECT explode(split(text, '[ \\n]+')) AS file FROM benchmark"), ["token"]).select("token")


built("token_exists_semi", token_exists_semi, "SELECT DISTINCT word AS token FROM words WHERE word IN (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) FROM benchmark)")

_MOCKED = "SELECT DISTINCT path AS file FROM paths WHERE contains(path, '/') UNION ALL SELECT DISTINCT regexp_replace(path, '([^/]+)$', '__mocks__/{}1') FROM paths WHERE contains(path, '/') AND page_id % 3 = 0 UNION ALL SELECT DISTINCT concat('__mocks__/', path) FROM paths WHERE NOT contains(path, '/')"
built("mock_selfjoin", lambda s, d: plugins.mock_edges(run_sql(s, d, _MOCKED.format("$"))).select("src", "dst"), f"WITH f AS ({_MOCKED.format(chr(92))}) SELECT DISTINCT a.file AS src, b.file AS dst FROM f a JOIN f b ON b.file = regexp_replace(a.file, '([^/]+)$', '__mocks__/{chr(92)}1') AND contains(b.file, '__mocks__/') AND a.file <> b.file")


def denylist_join(spark, sf_dir):
    declared = run_sql(spark, sf_dir, "SELECT p_partkey AS id, p_brand AS file, CASE WHEN p_size % 5 = 0 THEN 'other' ELSE 'variable' END AS kind, CASE p_size % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'function' ELSE 'expression' END AS initializer FROM part")
    calls = run_sql(spark, sf_dir, "SELECT l_partkey AS id, l_returnflag AS callee, CASE WHEN l_linestatus = 'O' THEN 'readFile' END AS member, l_linenumber - 2 AS depth, l_quantity > 10 AS constructed FROM lineitem")
    imports = run_sql(spark, sf_dir, "SELECT DISTINCT p_brand AS file, inline(from_json('[{\"local\":\"R\",\"module\":\"fs\",\"name\":\"rmSync\"},{\"local\":\"A\",\"module\":\"node:child_process\",\"name\":\"*\"},{\"local\":\"N\",\"module\":\"lodash\",\"name\":\"readFile\"}]', 'array<struct<local:string,module:string,name:string>>')) FROM part WHERE p_brand <> 'Brand#3'")
    return effects.initializer_effects(declared, calls, imports)


built("denylist_join", denylist_join, "WITH c AS (SELECT DISTINCT l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#3' AND l_linenumber <= 3 AND l_quantity <= 10 AND l_returnflag = 'R') SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'unknown' WHEN p_size % 4 <= 1 THEN 'pure' WHEN l_partkey IS NOT NULL THEN 'effectful' ELSE 'pure' END AS effect FROM part LEFT JOIN c ON l_partkey = p_partkey")


def json_leaf_paths(spark, sf_dir):
    value = "concat('{\"main\":\"./a', event_id, '.js\",\"name\":\"n\",\"exports\":{\".\":{\"import\":\"./m', user_id, '.mjs\",\"types\":\"t.d.ts\"},\"./x\":[\"./y.js\",3,null]},\"bin\":\"', event_type, '\"}')"
    return files.manifest_rows(run_sql(spark, sf_dir, f"SELECT event_id, {value} AS manifest FROM events"), "event_id", "manifest")


built("json_leaf_paths", json_leaf_paths, "SELECT event_id, CAST(o AS BIGINT) AS ordinal, p AS path FROM (SELECT event_id, 0 AS o, concat('a', event_id, '.js') AS p FROM events UNION ALL SELECT event_id, 1, event_type FROM events UNION ALL SELECT event_id, 2, concat('m', user_id, '.mjs') FROM events UNION ALL SELECT event_id, 3, 't.d.ts' FROM events UNION ALL SELECT event_id, 4, 'y.js' FROM events) x")
built(
    "nested_flatten",
    lambda s, d: files.nested_symbols(run_sql(s, d, "SELECT user_id, collect_list(named_struct('file', CAST(user_id AS STRING), 'exports', array(named_struct('name', CAST(event_id AS STRING))), 'types', array(named_struct('name', event_type), named_struct('name', 'any')))) AS issues FROM events GROUP BY user_id")),
    "SELECT CAST(user_id AS VARCHAR) AS file, CAST(event_id AS VARCHAR) AS symbol FROM events UNION ALL SELECT CAST(user_id AS VARCHAR), event_type FROM events UNION ALL SELECT CAST(user_id AS VARCHAR), 'any' FROM events",
)


def ini_section_scan(spark, sf_dir):
    text = "concat('[other]\\nz = \"a:b\"\\n', CASE p_size % 3 WHEN 0 THEN '[project.scripts]' WHEN 1 THEN '[tool.x]' ELSE '[project.entry-points.\"a.b\"]' END, '\\n# c = \"d\"\\nk', p_partkey, ' = \"', CASE WHEN p_partkey % 7 = 0 THEN 'not a spec!' ELSE concat('m', p_size, '.p:f', p_partkey) END, '\" # end\\n[last]\\ny = x\\n')"
    return files.spec_rows(run_sql(spark, sf_dir, f"SELECT p_partkey, {text} AS text FROM part"), "p_partkey", "text")


built("ini_section_scan", ini_section_scan, "SELECT p_partkey, concat('m', p_size, '.p:f', p_partkey) AS spec FROM part WHERE p_size % 3 <> 1 AND p_partkey % 7 <> 0")
built("discover_filter", lambda s, d: files.select_paths(run_sql(s, d, "SELECT page_id, path AS file FROM paths UNION ALL SELECT page_id, concat('en/node_modules/', path) FROM paths UNION ALL SELECT page_id, concat('fr/x/', path, '.d.ts') FROM paths"), ["en/**", "fr/*/**"], ["**/*7", "**/*.html"]), "SELECT page_id, path AS file FROM paths WHERE regexp_matches(path, '^(en/|fr/[^/]+/)') AND NOT regexp_matches(path, '(7|[.]html)$') AND NOT regexp_matches(path, '(^|/)(node_modules|dist|out|coverage|build)/')")
built("content_hash", lambda s, d: score.content_hashes(run_sql(s, d, "SELECT doc_id, text FROM documents"), "doc_id"), "SELECT doc_id, sha256(text) AS hash FROM documents")


def snapshot_diff(spark, sf_dir):
    before = run_sql(spark, sf_dir, "SELECT doc_id, text FROM documents WHERE lang <> 'es'")
    after = run_sql(spark, sf_dir, "SELECT doc_id, CASE WHEN lang = 'fr' THEN concat(text, ' ') ELSE text END AS text FROM documents WHERE source <> 'src3'")
    return score.snapshot_diff(before, after, "doc_id", "text")


built("snapshot_diff", snapshot_diff, "SELECT doc_id, CASE WHEN lang = 'es' THEN 'added' WHEN NOT coalesce(source <> 'src3', false) THEN 'removed' ELSE 'changed' END AS state FROM documents WHERE (lang = 'es' AND source <> 'src3') OR (lang <> 'es' AND (NOT coalesce(source <> 'src3', false) OR lang = 'fr'))")
built("upsert_by_id", lambda s, d: score.upsert(run_sql(s, d, "SELECT s_suppkey, s_name FROM supplier"), run_sql(s, d, "SELECT s_suppkey, concat(s_name, ' new') AS s_name FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT -1, 'one more'"), "s_suppkey"), "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN concat(s_name, ' new') ELSE s_name END AS s_name FROM supplier UNION ALL SELECT -1, 'one more'")
built(
    "multiset_equal",
    lambda s, d: score.multisets(*(run_sql(s, d, f"SELECT l_suppkey AS suppkey, l_linenumber AS line FROM lineitem WHERE l_returnflag = '{k}'") for k in "AR"), "suppkey", ["line"]),
    "WITH a AS (SELECT l_suppkey AS k, l_linenumber AS line, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_suppkey, l_linenumber), b AS (SELECT l_suppkey AS k, l_linenumber AS line, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey, l_linenumber) SELECT coalesce(a.k, b.k) AS suppkey, sum(CASE WHEN coalesce(a.n, 0) = coalesce(b.n, 0) THEN 0 ELSE 1 END) = 0 AS equal FROM a FULL OUTER JOIN b ON a.k = b.k AND a.line = b.line GROUP BY coalesce(a.k, b.k)",
)


def verdict_validate(spark, sf_dir):
    reply = "CASE event_id % 6 WHEN 0 THEN concat('{\"verdict\":\"likely-dead\",\"reasoning\":\"r', user_id, '\"}') WHEN 1 THEN '{\"verdict\":\"likely-alive\",\"reasoning\":\"used\"}' WHEN 2 THEN '{\"verdict\":\"likely-dead\"}' WHEN 3 THEN '{\"verdict\":\"dead\",\"reasoning\":\"odd\"}' WHEN 4 THEN concat('junk{', props) ELSE '[]' END"
    return triage.validated(run_sql(spark, sf_dir, f"SELECT event_id AS id, {reply} AS reply FROM events"))


built("verdict_validate", verdict_validate, "SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'likely-dead' WHEN 1 THEN 'likely-alive' ELSE 'unsure' END AS verdict, CASE event_id % 6 WHEN 0 THEN concat('r', user_id) WHEN 1 THEN 'used' WHEN 2 THEN 'no valid reply: {\"verdict\":\"likely-dead\"}' WHEN 3 THEN 'odd' WHEN 4 THEN concat('no valid reply: junk{', props) ELSE 'no valid reply: []' END AS reasoning FROM events")
