"""A scan of a source tree, Python and scripts, from files to findings: the analytics put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plugins
from .functions.globs import matches_any
from .functions.scalars import basename, is_python, tainted
from .operators import classify, clones, entries, metrics, reach
from .sources import files, python_code, script_code
from .stage import staged

#: Names of Python files that are run.
PY_ENTRIES = ["main.py", "app.py", "manage.py", "wsgi.py", "asgi.py"]
SCRIPTS = r"\.[cm]?[jt]sx?$"
PY_TEST = r"(^|/)(test_[^/]+|[^/]+_test)\.py$"


def _manifest_entries(spark: SparkSession, target: str, names: DataFrame) -> DataFrame:
    """base, name, source, ordinal, file of what the tree's package and those of its workspace name; a member needs a name."""
    rows = [r for base in ["", *files.workspace_members(target)] for r in files.manifest_candidates(target, base)]
    met = entries.first_existing(spark.createDataFrame(rows, files.CANDIDATES), names, ["base", "name", "source", "ordinal"]).where("base = '' OR name IS NOT NULL")
    return met.withColumn("source", F.when((F.col("source") == "manifest") & (F.col("place") > 0), "mapped").otherwise(F.col("source")))


def _packages(met: DataFrame) -> DataFrame:
    """name, file of the workspace's packages: the file that a manifest names, else a conventional one."""
    rank = F.struct(F.when(F.col("source").isin("manifest", "mapped"), 0).when(F.col("source") == "convention", 1).otherwise(2), "ordinal")
    return met.where("base <> ''").groupBy("name").agg(F.min_by("file", rank).alias("file"))


def _entry_records(spark: SparkSession, target: str, config: dict, text: DataFrame, met: DataFrame, ir: DataFrame, nodes: DataFrame, mods: DataFrame, prod_globs: list[str]) -> DataFrame:
    """file, source, symbol of every entry that any mechanism finds."""
    f, names = F.col("file"), text.select("file")
    met = met.select("file", F.when(F.col("base") != "", "workspace").otherwise(F.col("source")).alias("source"), F.lit(None).cast("string").alias("symbol"))

    def by(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("file", F.lit(name).alias("source"), F.lit(None).cast("string").alias("symbol"))

    read = lambda n: files.read_text(target, n) or ""
    specs = [(s, "pyproject-scripts") for s in files.entry_specs(read("pyproject.toml"))]
    specs += [(s, "setup-config") for s in files.entry_specs(read("setup.cfg"), "options.entry_points") + files.setup_specs(read("setup.py"))]
    last = nodes.groupBy("file", "name").agg(F.max_by("id", "line").alias("id"))
    named = entries.module_specs(spark.createDataFrame(specs, "spec string, source string"), mods, last).where("file IS NOT NULL").select("file", "source", "symbol")
    guarded = ir.where("main_guard").select("file")
    name = basename(f)
    run = names.where(is_python(f) & (name != "conftest.py")).join(guarded.withColumn("guard", F.lit(True)), "file", "left")
    run = run.select("file", F.when(name == "__main__.py", "dunder-main").when(name.isin(PY_ENTRIES), "convention").when(F.col("guard"), "dunder-main").alias("source"), F.lit(None).cast("string").alias("symbol")).where("source IS NOT NULL")
    return reduce(DataFrame.unionByName, [met, by(names.where(matches_any(f, config["entries"])), "config"), named, run, by(names.where(matches_any(f, prod_globs)), "plugin")])


def model(spark: SparkSession, target: str, config: dict) -> dict:
    """The graph and what follows from it: text, ir, nodes, edges, seeds, verdicts, tainted, public, entries, collapsed."""
    text = staged(files.source_files(spark, target, config["include"], config["ignore"]), "sources")
    code, scripts = text.where(is_python(F.col("file"))), text.where(F.col("file").rlike(SCRIPTS))
    ir = staged(python_code.lowered(code), "ir")
    script_ir = staged(script_code.lowered(scripts), "ir")
    mods = staged(python_code.modules(code, python_code.import_roots(code)), "modules")

    def symbols(ir: DataFrame) -> DataFrame:
        return ir.select("file", F.inline("symbols")).select(F.concat_ws(":", "file", "line", "name").alias("id"), "name", "file", "line", "end_line", "exported").dropDuplicates(["id"])

    py_nodes, script_nodes = staged(symbols(ir), "nodes"), staged(symbols(script_ir), "nodes")
    nodes = py_nodes.unionByName(script_nodes)
    met = staged(_manifest_entries(spark, target, text.select("file")), "manifest")
    repo = plugins.repo(target)
    found = plugins.detected(repo)
    globs = [e for p in found for e in p.entries(repo)]
    prod_globs, test_globs = ([e.glob for e in globs if e.kind == k] for k in ("prod", "test"))
    names_ = script_code.Names(script_ir, script_nodes, _packages(met))
    f = F.col("file")

    def tagged(refs: DataFrame, test) -> DataFrame:
        return refs.select("src", "dst", F.when(test, "test").otherwise("prod").alias("kind"))

    edges = tagged(python_code.references(ir, py_nodes, mods), f.rlike(PY_TEST)).unionByName(tagged(names_.references(), matches_any(f, test_globs))).unionByName(reach.own_file_edges(nodes))
    for p in found:
        more = p.edges(repo, nodes)
        edges = edges if more is None else edges.unionByName(more)
    edges = staged(edges.distinct(), "edges")
    records = staged(_entry_records(spark, target, config, text, met, ir, py_nodes, mods, prod_globs), "entries")
    names = text.select("file")
    tests = names.where(matches_any(F.col("file"), test_globs))
    seeds = entries.file_seeds(records, "prod").unionByName(records.where("symbol IS NOT NULL").select(F.col("symbol").alias("id"), F.lit("prod").alias("color")))
    seeds = seeds.unionByName(entries.exported_seeds(nodes, records.where("source = 'plugin'"), "prod")).unionByName(entries.exported_seeds(nodes, tests, "test"))
    seeds = staged(seeds.unionByName(entries.file_seeds(tests.union(names.where(basename(F.col("file")) == "conftest.py")), "test")).distinct(), "seeds")
    verdicts = staged(reach.two_color(nodes, edges, seeds), "verdicts")
    taint = text.where(tainted(F.col("text"), is_python(f))).select("file").union(ir.where("star_import").select("file")).distinct()
    public = (py_nodes.where("exported") if repo.python_library else py_nodes.limit(0)).select("id")
    if repo.published:
        public = public.unionByName(names_.public(met.where("base = '' AND source IN ('manifest', 'mapped')")))
    once = staged(entries.first_source(entries.ranked(records)), "once")
    return {"text": text, "ir": ir, "nodes": nodes, "edges": edges, "seeds": seeds, "verdicts": verdicts, "tainted": taint, "public": public.distinct(), "script_ir": script_ir, "entries": once, "collapsed": entries.collapsed(once, nodes)}


def scan(spark: SparkSession, target: str, config: dict) -> dict:
    """findings, evidence, metrics, complexity, hotspots, duplication, entries, edges, nodes of the files under target, and whether entries collapsed."""
    m = model(spark, target, config)
    nodes, ir, text = m["nodes"], m["ir"], m["text"]
    records = staged(files.coverage_records(spark, files.existing(target, config["coverage"]["reports"])), "coverage")
    # report paths may be absolute or from another folder
    path = F.regexp_replace(F.regexp_replace("file", r"\\", "/"), r"^\./", "")
    reports = records.groupBy(path.alias("report")).agg(F.min("ordinal").alias("ordinal"))
    matched = metrics.match_reports(text.select("file"), reports)
    known = records.withColumn("path", path).drop("file").join(matched, F.col("path") == F.col("report")).select("file", "kind", "name", "line", "hits", "ordinal")
    hits = metrics.last_hits(known.where("kind = 'line'"), ["ordinal"])
    status = metrics.coverage_status(nodes.select("id", "file", "name", "line"), known.where("kind = 'fn'"), hits)
    facts = nodes.join(m["public"].withColumn("public", F.lit(True)), "id", "left").withColumn("public", F.coalesce("public", F.lit(False)))
    # effects of Python initializers are not told
    facts = facts.join(script_code.effects(m["script_ir"]), "id", "left").withColumn("effect", F.coalesce("effect", F.lit("unknown"))).withColumn("python", is_python(F.col("file"))).join(status.select("id", F.col("status").alias("coverage"), "hits"), "id")
    found = staged(classify.tiers(facts, m["verdicts"], m["tainted"], m["collapsed"]), "findings")
    lowered = ir.select("file", "units", "tokens").unionByName(m["script_ir"].select("file", "units", "tokens"))
    units = staged(metrics.unit_metrics(lowered.select("file", F.inline("units"))), "units")
    covered = metrics.coverage_ratio(units, hits)
    streams = python_code.streams(lowered)
    groups = clones.clone_groups(streams, config["duplication"]["minTokens"])
    return {
        "nodes": nodes,
        "edges": m["edges"],
        "entries": m["entries"],
        "collapsed": m["collapsed"],
        "findings": classify.worst_first(found),
        "evidence": classify.evidence(found),
        "metrics": units,
        "complexity": metrics.complexity_findings(units, config["thresholds"]),
        "hotspots": metrics.hotspots(covered, files.git_churn(spark, target) if "://" not in target else None, config["hotspots"]["top"]),
        "duplication": clones.clone_lines(groups, streams.select("file", "lines")),
    }


def explain(spark: SparkSession, target: str, config: dict, query: str) -> dict:
    """Why the symbol that the query means has its verdict."""
    from .operators.explain import explain as told

    m = model(spark, target, config)
    return told(query, m["nodes"], m["edges"], m["seeds"], m["verdicts"], m["tainted"])
