"""The analytics on small hand-made relations."""

import json

import pytest
from pyspark.sql import functions as F

from stratum import config as cfg
from stratum import plugins
from stratum.engine import explain, scan
from stratum.functions.globs import glob_regex, matches_any
from stratum.functions.scalars import crap, exported_python, half_up, line_range, snippet, splice, verdict
from stratum.operators import classify, clones, effects, entries, intervals, metrics, reach, score, triage
from stratum.plans import report
from stratum.sources import files, python_code, script_code
from stratum.streaming.rolling import churn_stream


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_crap_literals(spark):
    f = lambda c, k: one(spark, crap(F.lit(c), F.lit(k)))[0]
    assert (f(10, 0.0), f(10, 1.0), f(4, 0.5)) == (110, 10, 6)
    assert f(10, None) is None
    assert one(spark, half_up(F.lit(2.25)))[0] == 2.3


def units(spark):
    control = "control array<struct<category:string,depth:int,nests:boolean>>"
    flat = [("branch", 0, True), ("loop", 1, True), ("branch", 2, True)]
    return spark.createDataFrame([("f", "a.py", 1, 60, 7, flat), ("g", "a.py", 70, 5, 1, [("boolean", 0, False)] * 3), ("h", "b.py", 1, 3, 0, [])], f"name string, file string, line int, loc int, params int, {control}")


def test_metrics_and_findings(spark):
    m = metrics.unit_metrics(units(spark))
    got = {r["name"]: (r.nesting, r.cognitive, r.cyclomatic) for r in m.collect()}
    assert got == {"f": (3, 6, 4), "g": (0, 3, 4), "h": (0, 0, 1)}
    found = metrics.complexity_findings(m, {"nesting": 2, "cyclomatic": 4, "cognitive": 5, "loc": 50, "params": 5}).collect()
    assert [(r.detector, r["name"]) for r in found] == [("deep-nesting", "f"), ("cognitive-complexity", "f"), ("god-function", "f")]
    assert found[2].value == 60 and "parameters" in found[2].message
    assert metrics.complexity_findings(m, {"nesting": 0, "cyclomatic": 9, "cognitive": 99, "loc": 99, "params": 99}).count() == 1


def test_coverage_and_hotspots(spark):
    hits = spark.createDataFrame([("a.py", 2, 1), ("a.py", 3, 0), ("a.py", 99, 5)], "file string, line int, hits long")
    m = metrics.coverage_ratio(metrics.unit_metrics(units(spark)), hits)
    assert {r["name"]: r.coverage for r in m.collect()} == {"f": 0.5, "g": None, "h": None}
    churn = spark.createDataFrame([("a.py", 4)], "file string, churn long")
    hot = metrics.hotspots(m, churn, 10).collect()
    assert [(r["name"], r.risk) for r in hot] == [("f", 24.0), ("g", 16.0), ("h", 1.0)] and hot[2].churn is None
    symbols = spark.createDataFrame([("x", "f", "a.py", 1), ("y", "k", "a.py", 3), ("z", "q", "c.py", 1)], "id string, name string, file string, line int")
    fns = spark.createDataFrame([("a.py", "f", 1, 7, 0), ("a.py", "f", 1, 0, 1)], "file string, name string, line int, hits long, ordinal int")
    assert {r.id: r.status for r in metrics.coverage_status(symbols, fns, hits).collect()} == {"x": "hit", "y": "miss", "z": "unavailable"}


def test_reports_match_by_suffix(spark):
    f = spark.createDataFrame([("/r/src/a.ts",), ("src/b.ts",), ("c.ts",)], "file string")
    r = spark.createDataFrame([("src/a.ts", 0), ("a.ts", 1), ("src/b.ts", 2), ("/x/src/b.ts", 0), ("xc.ts", 3)], "report string, ordinal int")
    assert {x.file: x.report for x in metrics.match_reports(f, r).collect()} == {"/r/src/a.ts": "src/a.ts", "src/b.ts": "src/b.ts"}


def test_innermost(spark):
    p = spark.createDataFrame([("a", 3), ("a", 9), ("a", 6)], "file string, line int")
    r = spark.createDataFrame([("a", 1, 7, 0), ("a", 2, 4, 1), ("a", 3, 5, 2)], "file string, start int, stop int, idx int")
    assert {x.line: x.unit for x in intervals.innermost(p, r).collect()} == {3: 1, 9: -1, 6: 0}


def graph(spark):
    e = [("main", "a", "prod"), ("a", "b", "prod"), ("t", "c", "test"), ("c", "d", "prod"), ("d", "c", "prod"), ("x", "y", "prod"), ("a", "c", "test")]
    return (
        spark.createDataFrame([(n,) for n in "a b c d x y main t".split()], "id string"),
        spark.createDataFrame(e, "src string, dst string, kind string"),
        spark.createDataFrame([("main", "prod"), ("t", "test"), ("ghost", "prod")], "id string, color string"),
    )


def test_two_color(spark):
    got = {r.id: r.reachability for r in reach.two_color(*graph(spark)).collect()}
    assert got == {"main": "alive", "a": "alive", "b": "alive", "t": "test-only", "c": "test-only", "d": "test-only", "x": "dead", "y": "dead"}


def test_more_edges_reach_no_less(spark):
    nodes, edges, seeds = graph(spark)
    few = {r.id for r in reach.closure(edges.where("kind = 'prod'"), seeds).collect()}
    assert few <= {r.id for r in reach.closure(edges, seeds).collect()}


def test_witness_and_inbound(spark):
    nodes, edges, seeds = graph(spark)
    assert reach.witness_path(edges, seeds, "d") in (["main", "a", "c", "d"], ["t", "c", "d"])
    assert len(reach.witness_path(edges, seeds, "d")) == 3 and reach.witness_path(edges, seeds, "t") == ["t"] and reach.witness_path(edges, seeds, "x") is None
    verdicts = reach.two_color(nodes, edges, seeds)
    assert [tuple(r) for r in reach.inbound_refs(verdicts, edges).collect()] == [("y", "x", "dead")]


def test_rounds_read_numbers(spark, monkeypatch):
    """Edges, which every round reads, are written without ids and without a shuffle, and verdicts come with their facts."""
    written = []

    def kept(df, name):
        written.append((name, {t for _, t in df.dtypes}, df._jdf.queryExecution().toString()))
        return staged(df, name)

    staged = reach.staged
    monkeypatch.setattr(reach, "staged", kept)
    nodes, edges, seeds = graph(spark)
    twice = edges.unionByName(edges)
    assert {tuple(r) for r in reach.two_color(nodes, twice, seeds).collect()} == {tuple(r) for r in reach.two_color(nodes, edges, seeds).collect()}
    assert {r.id: r.depth for r in reach.witness_depths(nodes, edges, seeds).collect()} == {r.id: r.depth for r in reach.closure(edges, seeds).join(nodes.select("id"), "id").collect()}
    of_edges = [(kinds, plan) for name, kinds, plan in written if name == "edges" and "string" not in kinds]
    assert len(of_edges) == 3 and not any("Exchange" in plan for _, plan in of_edges)
    facts = nodes.withColumn("fact", F.length("id"))
    assert {tuple(r) for r in reach.coloured(facts, edges, seeds).select("id", "reachability").collect()} == {tuple(r) for r in reach.two_color(nodes, edges, seeds).collect()}


def test_chase(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 7), (3, 1)], "src long, dst long")
    declared = spark.createDataFrame([(3,), (9,)], "id long")
    starts = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 6, 9)], "id long")
    assert {r.start: r.target for r in reach.chase(links, declared, starts).collect()} == {1: 3, 2: 3, 3: 3, 4: None, 6: None, 9: 9}
    long = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (201, 200)], "src long, dst long")
    got = reach.chase(long, spark.createDataFrame([(100,)], "id long"), spark.createDataFrame([(i,) for i in (0, 37, 99, 100, 200)], "id long"))
    assert {r.start: r.target for r in got.collect()} == {0: 100, 37: 100, 99: 100, 100: 100, 200: None}
    none = reach.chase(long.limit(0), spark.createDataFrame([], "id long"), spark.createDataFrame([(1,)], "id long")).collect()
    assert [tuple(r) for r in none] == [(1, None)]


def test_long_chains_and_random_graphs(spark):
    import random

    r = random.Random(3)
    edges = [(f"n{i}", f"n{i + 1}", "prod") for i in range(20)] + [(f"n{r.randrange(60)}", f"n{r.randrange(60)}", r.choice(["prod", "test"])) for _ in range(60)]
    seeds = [("n0", "prod"), ("n30", "test"), ("n31", "test")]

    def walked(allowed, colors):
        at, todo = set(), [i for i, c in seeds if c in colors]
        while todo:
            n = todo.pop()
            if n not in at:
                at.add(n)
                todo += [d for s, d, k in edges if s == n and k in allowed]
        return at

    prod, every = walked({"prod"}, {"prod"}), walked({"prod", "test"}, {"prod", "test"})
    df = spark.createDataFrame([(f"n{i}",) for i in range(60)], "id string"), spark.createDataFrame(edges, "src string, dst string, kind string"), spark.createDataFrame(seeds, "id string, color string")
    for row in reach.two_color(*df).collect():
        assert row.reachability == ("alive" if row.id in prod else "test-only" if row.id in every else "dead")
    path = reach.witness_path(df[1], df[2], "n20")
    assert path[-1] == "n20" and path[0] in ("n0", "n30", "n31") and all((a, b) in {(s, d) for s, d, _ in edges} for a, b in zip(path, path[1:], strict=False))
    assert len(path) - 1 == reach.closure(df[1], df[2]).where("id = 'n20'").first().depth


def by_hand(texts, k):
    """Clone groups by the rule, over whole files of one unit."""
    pos = [(f, i) for f in sorted(texts) for i in range(len(texts[f]) - k + 1)]
    at = {}
    for f, i in pos:
        at.setdefault(tuple(texts[f][i : i + k]), []).append((f, i))
    covered, out = set(), []
    for f, i in pos:
        g = at[tuple(texts[f][i : i + k])]
        if (f, i) in covered or len(g) < 2 or any(x in covered for x in g):
            continue
        n = k
        while all(j + n < len(texts[h]) for h, j in g) and len({texts[h][j + n] for h, j in g}) == 1:
            n += 1
        covered |= {(h, j + d) for h, j in g for d in range(n - k + 1)}
        out.append((n, frozenset((h, j, j + n - 1) for h, j in g)))
    return sorted(out, key=str)


def test_clone_groups(spark):
    import random

    r = random.Random(1)
    texts = {f"f{i}": [r.choice("abc") for _ in range(40)] for i in range(4)}
    texts["g"] = texts["f0"][5:30] + texts["f1"][:20]
    texts["copy"] = list(texts["g"])  # a file alike in every token
    def streams(unit):
        return spark.createDataFrame([(f, w, [unit(i) for i in range(len(w))]) for f, w in texts.items()], "file string, norms array<string>, units array<int>")

    def found(k, unit=lambda i: 0):
        return [(x.tokens, frozenset((m.file, m.start, m.stop) for m in x.members)) for x in clones.clone_groups(streams(unit), k).collect()]

    got = found(6)
    assert sorted(got, key=str) == by_hand(texts, 6) and len(got) > 3
    assert [n for n, _ in got] == sorted((n for n, _ in got), reverse=True)
    assert not found(6, lambda i: i // 5) and found(5, lambda i: i // 5)
    lines = spark.createDataFrame([(f, [i // 3 + 1 for i in range(len(w))]) for f, w in texts.items()], "file string, lines array<int>")
    told = clones.clone_lines(clones.clone_groups(streams(lambda i: 0), 6), lines).first()
    assert [(m.start_line, m.end_line) for m in told.members][0] and "tokens:" in report.duplication_text([told])
    assert clones.clone_groups(streams(lambda i: 0).limit(0), 6).count() == 0
    periodic = {"p": ["a"] * 30, "q": ["a"] * 9}
    texts = periodic
    assert sorted(found(4), key=str) == by_hand(periodic, 4)
    merged = intervals.merge_ranges(spark.createDataFrame([("a", 1, 4), ("a", 5, 6), ("a", 8, 9)], "file string, start int, stop int"), "file").collect()
    assert sorted((x.start, x.stop) for x in merged) == [(1, 6), (8, 9)]


def test_recurring_windows_go_once(spark, monkeypatch):
    """Positions meet as columns, and groups are counted without a table between."""
    streams = spark.createDataFrame([("a", list("xyzxyq"), [0] * 6), ("b", list("wxyz"), [0] * 4), ("c", list("xyzp"), [0, 0, 1, 1]), ("d", ["x"], [0])], "file string, norms array<string>, units array<int>")
    at: dict[str, set[int]] = {}
    for f, some in clones.recurring(streams, 3).collect():
        at.setdefault(f, set()).update(some)
    assert at == {"a": {0}, "b": {1}}
    monkeypatch.setattr(clones, "staged", None)
    assert [(x.n, x.first_file) for x in clones.gram_groups(streams, 3).collect()] == [(2, "a")]


def test_tiers_in_order(spark):
    facts = [("a", "f", 1, False, False, "pure", "miss", False), ("b", "f", 2, True, False, "pure", "miss", False), ("c", "f", 3, False, True, "unknown", "miss", False), ("d", "f", 4, True, True, "effectful", "hit", False), ("e", "g", 5, False, False, "pure", "miss", False), ("p", "f", 6, False, False, "unknown", "miss", True), ("t", "f", 7, False, False, "pure", "hit", False), ("x", "f", 8, False, False, "effectful", "miss", False), ("ok", "f", 9, False, False, "pure", "miss", False)]
    df = spark.createDataFrame(facts, "id string, file string, line int, exported boolean, public boolean, effect string, coverage string, python boolean").withColumn("hits", F.lit(3)).withColumn("name", F.col("id"))
    v = spark.createDataFrame([(x[0], "test-only" if x[0] == "t" else "alive" if x[0] == "ok" else "dead") for x in facts], "id string, reachability string")
    taint = spark.createDataFrame([("g",)], "file string")
    found = classify.tiers(df, v, taint)
    assert {r.id: (r.tier, r.fixable) for r in found.collect()} == {"a": ("certain", True), "b": ("likely", False), "c": ("maybe", False), "d": ("maybe", False), "e": ("maybe", False), "p": ("likely", False), "t": ("maybe", False), "x": ("likely", False)}
    assert {r.tier for r in classify.tiers(df, v, taint, collapsed=True).collect()} == {"maybe"}
    counts = {r.id: r["count"] for r in classify.evidence(found).groupBy("id").count().collect()}
    assert counts["t"] == 3 and counts["a"] == 5
    signs = {(r.id, r.ordinal): (r.ok, r.text) for r in classify.evidence(found).collect()}
    assert [signs["t", k][0] for k in (1, 2, 3)] == [True, False, None] and signs["t", 3][1] == "3 coverage hits"
    assert [signs["a", k][0] for k in range(1, 6)] == [True, True, True, True, True] and signs["x", 5][0] is False and signs["d", 2][0] is False and signs["e", 4][0] is False and signs["p", 5][0] is None
    unseeded = classify.evidence(classify.tiers(df, v, taint, collapsed=True))
    assert {r.id: r["count"] for r in unseeded.groupBy("id").count().collect()}["a"] == 6 and unseeded.where("id = 'a' AND ordinal = 1").first().ok is False
    gate = {r.threshold: r.fails for r in classify.gate(found.where("tier = 'maybe'"), spark.createDataFrame([], "file string, line int, name string")).collect()}
    assert gate == {"high": False, "medium": False, "low": True}
    assert [r.id for r in classify.worst_first(found).collect()][0] == "a" and [r.id for r in classify.worst_first(found).collect()][-1] == "t"
    doc = json.loads(report.sarif(classify.sarif_rows(found, spark.createDataFrame([], "file string, line int, name string")), "x", "1"))
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == 8
    clone = spark.createDataFrame([(60, [("f", 1, 4), ("g", 2, 5)])], "tokens int, members array<struct<file:string,start_line:int,end_line:int>>")
    doc = json.loads(report.sarif(classify.sarif_rows(found.limit(0), spark.createDataFrame([], "file string, line int, name string"), duplication=clone), "x", "1"))
    assert doc["runs"][0]["results"][0]["relatedLocations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "g"
    assert {r.threshold: r.fails for r in classify.gate(found.where("reachability = 'test-only'"), clone.limit(0), clone.withColumn("x", F.lit(1))).collect()} == {"high": False, "medium": True, "low": True}
    whole = json.loads(report.json_document({"findings": found, "summary": classify.summary(found)}).first().document)
    assert len(whole["findings"]) == 8


def test_confusion_and_flipped_labels(spark):
    rows = [(True, True)] * 8 + [(True, False)] * 2 + [(False, False)] * 10
    df = spark.createDataFrame(rows, "truth boolean, predicted boolean")
    r = score.confusion(df).first()
    assert (r.tp, r.fp, r.fn, r.prec, r.rec) == (8, 0, 2, 1.0, 0.8) and abs(r.f1 - 0.8889) < 1e-3
    assert score.confusion(df.withColumn("truth", ~F.col("truth"))).first().prec == 0.0
    none = score.confusion(df.where("NOT truth AND NOT predicted")).first()
    assert (none.prec, none.rec, none.f1) == (1.0, 1.0, 1.0)
    assert score.pass_rate(spark.createDataFrame([], "passed boolean")).first().rate == 1.0


def test_sets_and_suppression(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "w"), (4, "q")], "k int, v string")
    assert {r.k: r.state for r in score.snapshot_diff(a, b, "k", "v").collect()} == {1: "removed", 3: "changed", 4: "added"}
    assert {r.k: r.v for r in score.upsert(a, b, "k").collect()} == {1: "x", 2: "y", 3: "w", 4: "q"}
    assert score.same_multiset(a.union(a), a.union(a), ["k"]) and not score.same_multiset(a, a.union(a), ["k"])
    f = spark.createDataFrame([("f", 1), ("f", 2), ("f", 3), ("f", 4)], "file string, line int")
    t = spark.createDataFrame([("f", "a\nb // keep-ignore\nc\nd")], "file string, text string")
    assert sorted(r.line for r in score.suppress_marked(f, t, "keep-ignore").collect()) == [1, 4]
    assert score.suppress(f, f.where("line < 3"), ["file", "line"]).count() == 2


def test_globs(spark):
    import re

    for glob, yes, no in (("**/*.ts", "a.ts", "a.tsx"), ("src/*.{ts,js}", "src/a.js", "src/x/a.js"), ("src/**", "src/.x/y", "a/src"), ("a?[!b].py", "axc.py", "axb.py")):
        assert re.match(glob_regex(glob), yes) and not re.match(glob_regex(glob), no)
    paths = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/a.d.ts", "node_modules/x/a.ts", "build/b.py", "src/a.test.ts", "x.pyi")], "file string")
    assert {r.file for r in files.select_paths(paths, ["**/*.ts", "**/*.py*"], ["**/*.test.ts"]).collect()} == {"src/a.ts", "build/b.py"}
    assert "build" in files.skipped_folders(["**/*.ts"]) and paths.where(matches_any(F.col("file"), [])).count() == 0


def test_coverage_parsers(spark, tmp_path):
    lcov = "SF:a.ts\nDA:1,1\nend_of_record\nSF:a.ts\nFN:3,f\nFN:9,g\nFNDA:7,f\nDA:3,4\nDA:3,5\nend_of_record\n"
    assert sorted(files.parse_lcov(lcov), key=str) == sorted([("a.ts", "fn", "f", 3, 7), ("a.ts", "fn", "g", 9, 0), ("a.ts", "line", None, 3, 5)], key=str)
    xml = '<coverage><class name="x" filename="a.ts"><line number="1" hits="2"/></class><class filename="a.ts"><line hits="0" number="2"/></class></coverage>'
    assert files.parse_cobertura(xml) == [("a.ts", "line", None, 1, 2), ("a.ts", "line", None, 2, 0)]
    (tmp_path / "l.info").write_text(lcov)
    (tmp_path / "c.xml").write_text(xml)
    got = files.coverage_records(spark, [str(tmp_path / n) for n in ("l.info", "c.xml", "none")]).collect()
    assert {(r.line, r.hits) for r in got} == {(1, 2), (2, 0)}
    assert files.coverage_records(spark, []).count() == 0


def test_manifests(tmp_path):
    m = {"main": "./dist/a.js", "bin": {"x": "./dist/cli.js"}, "exports": {".": {"import": "./dist/m.mjs", "types": "./t.d.ts"}}, "scripts": {"s": "node './scripts/run.ts' --x", "t": "echo hi"}}
    assert files.manifest_paths(m) == ["dist/a.js", "dist/cli.js", "dist/m.mjs", "t.d.ts"] and files.script_paths(m) == ["scripts/run.ts"]
    assert files.source_candidates("lib/a.js", "./lib", "code")[0] == "code/a.ts" and "src/cli.ts" in files.source_candidates("dist/cli.js") and files.source_candidates("dist/a.mjs") == ["src/a.mts", "src/a.ts", "src/a.tsx"]
    (tmp_path / "base.json").write_text('{"compilerOptions": {"outDir": "lib", "rootDir": "r"}}')
    (tmp_path / "tsconfig.json").write_text('{"extends": "./base.json", "compilerOptions": {"rootDir": "src"}}')
    assert files.tsconfig(tmp_path / "tsconfig.json") == {"outDir": "lib", "rootDir": "src"}
    assert files.entry_specs('[project.scripts]\na = "pkg.mod:run"\nb = "not a spec!"\n[other]\nc = "x:y"\n') == ["pkg.mod:run"]
    assert files.entry_specs("[options.entry_points]\nconsole_scripts =\n    tool = pkg.cli:main\n", "options.entry_points") == ["pkg.cli:main"]
    assert files.setup_specs("from setuptools import setup\nsetup(entry_points={'console_scripts': ['t=p.q:r']})") == ["p.q:r"]
    assert files.dependency_names('[project]\ndependencies = ["requests>=2", \'rich\']', "# c\nflask==1\n-r x") == ["requests", "rich", "flask"]
    assert files.workspace_globs({"workspaces": {"packages": ["a/*"]}}, "packages:\n  - 'b/*'\nother: 1\n") == ["a/*", "b/*"]
    assert files.has_section(" [build-system]\n", "build-system")
    (tmp_path / "c.json").write_text('{"ignore": ["x"], "thresholds": {"loc": 9}}')
    c = cfg.load(tmp_path / "c.json")
    assert c["ignore"] == ["x"] and c["thresholds"]["loc"] == 9 and c["thresholds"]["nesting"] == 3 and cfg.load(None) == cfg.DEFAULTS


CODE = {
    "pkg/__init__.py": "from .core import run as go\n",
    "pkg/core.py": "import os\n\n__all__ = ['_shown']\n\ndef run(a, *b):\n    if a and b or os:\n        for x in b:\n            pass\n    elif b:\n        pass\n    return helper()\n\ndef helper():\n    return lambda: 1\n\ndef unused():\n    return [y for y in [] if y]\n\ndef _shown():\n    pass\n\ndef tested():\n    pass\n",
    "pkg/__main__.py": "from pkg.core import run\nif __name__ == '__main__':\n    run(1)\n",
    "tests/test_core.py": "import pkg.core as c\n\ndef test_x():\n    c.tested()\n",
    "bad.py": "def (:\n",
}


def planted(folder, texts):
    for name, text in texts.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)


def test_python_front_end(spark, tmp_path):
    planted(tmp_path, {**CODE, "pytest.ini": "[pytest]\n"})
    ir = python_code.lower("pkg/core.py", CODE["pkg/core.py"])
    run = next(u for u in ir["units"] if u["name"] == "run")
    assert run["params"] == 2 and run["loc"] == 7
    assert [(c["category"], c["depth"]) for c in run["control"]] == [("branch", 0), ("boolean", 1), ("boolean", 1), ("loop", 1), ("branch", 1)]
    assert {u["name"] for u in ir["units"]} == {"run", "helper", "(anonymous)", "unused", "_shown", "tested"}
    assert {s["name"]: s["exported"] for s in ir["symbols"]}["_shown"] and not python_code.lower("bad.py", CODE["bad.py"])["ok"]
    inner = [u["owner"] for u in ir["uses"] if u["name"] == "helper"]
    assert inner == ["5:run"] and not any(u["name"] == "unused" for u in ir["uses"])
    out = scan(spark, str(tmp_path), {**cfg.DEFAULTS})
    found = {r["name"]: (r.reachability, r.tier) for r in out["findings"].collect()}
    assert found["unused"] == ("dead", "likely") and found["tested"] == ("test-only", "maybe")
    assert "run" not in found and "helper" not in found
    assert {r["name"] for r in out["hotspots"].collect()} >= {"run", "unused"}
    assert "unused" in report.findings_text(out["findings"])
    texts = spark.createDataFrame(list(CODE.items()), "file string, text string")
    mods = python_code.modules(texts, [""])
    assert {r.file: r.module for r in mods.collect()}["pkg/__init__.py"] == "pkg"
    hit = {(r.file, r.name): r.target for r in python_code.resolved_imports(python_code.lowered(texts), mods).collect()}
    assert hit["pkg/__init__.py", "run"] == "pkg/core.py" and hit["tests/test_core.py", None] == "pkg/core.py" and hit["pkg/core.py", None] is None


def test_scalars(spark):
    r = one(spark, splice(F.lit("a\nb\nc\nd"), F.lit(2), F.lit(3), F.lit("X")).alias("s"), snippet(F.lit("a\nb\nc\nd"), F.lit(3), 1).alias("n"), snippet(F.lit("x\nf() {\n{\n}\n}\ny"), F.lit(2), 1).alias("m"), line_range(F.lit("a\nb\nc"), F.lit(2), F.lit(9)).alias("r"), verdict(F.lit('{"verdict":"likely-dead"}')).alias("v"), verdict(F.lit("junk{")).alias("w"), exported_python(F.lit("_x"), F.array(F.lit("_x"))).alias("e"))
    assert r.s == "a\nX\nd" and r.n == "2\tb\n3\tc\n4\td" and r.m == "1\tx\n2\tf() {\n3\t{\n4\t}\n5\t}" and r.r == "2\tb\n3\tc" and (r.v, r.w, r.e) == ("likely-dead", "unsure", True)


def test_churn_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 1L AS user_id UNION ALL SELECT timestamp'2024-01-01 00:02:00', 1L UNION ALL SELECT timestamp'2024-01-01 03:00:00', 2L").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, user_id long").parquet(f"{tmp_path}/in")
    q = churn_stream(stream).writeStream.format("memory").queryName("churned").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.user_id, r.churn) for r in spark.table("churned").collect()] == [(1, 2)]


def test_names_are_followed_through_packages(spark, tmp_path):
    """A facade that gives a name on under another one, an attribute of an imported module, a cycle of imports, a dead end."""
    planted(
        tmp_path,
        {
            "pkg/__init__.py": "from .facade import out as go\nfrom .loop import x\n",
            "pkg/facade.py": "from .core import run as out\n",
            "pkg/loop.py": "from pkg import x\n",
            "pkg/core.py": "def run():\n    return 1\n\ndef lone():\n    return lone\n\ndef member():\n    pass\n\ndef covered():\n    pass\n",
            "main.py": "from pkg import go, x, gone\nimport pkg.core\nimport pkg.core as c\ngo()\nx\ngone\nc.member()\n",
            "coverage/lcov.info": "SF:/elsewhere/pkg/core.py\nFN:10,covered\nFNDA:4,covered\nDA:4,0\nend_of_record\n",
        },
    )
    out = scan(spark, str(tmp_path), cfg.load(None))
    found = {r["name"]: (r.reachability, r.tier, r.coverage) for r in out["findings"].collect()}
    assert found == {"lone": ("dead", "likely", "miss"), "covered": ("dead", "maybe", "hit")} and not out["collapsed"]
    assert {r.file: r.source for r in out["entries"].collect()} == {"main.py": "convention"}
    told = explain(spark, str(tmp_path), cfg.load(None), "core.py:run")
    assert told["reachability"] == "alive" and told["witness"] == ["main.py", "pkg/core.py:1:run"]
    dead = explain(spark, str(tmp_path), cfg.load(None), "lone")
    assert dead["reachability"] == "dead" and dead["inbound"] == [] and explain(spark, str(tmp_path), cfg.load(None), "nobody")["status"] == "not-found"
    assert "main.py" in report.explained_text(told)


def test_entries_and_quarantine(spark, tmp_path):
    planted(
        tmp_path,
        {
            "pyproject.toml": '[build-system]\n[project]\ndependencies = ["pytest"]\n[project.scripts]\ntool = "lib.cli:start"\n',
            "setup.cfg": "[options.entry_points]\nconsole_scripts =\n    other = lib.second\n",
            "lib/cli.py": "def start():\n    used()\n\ndef used():\n    pass\n\ndef _hidden():\n    pass\n\ndef shown():\n    pass\n",
            "lib/second.py": "A = 1\n",
            "lib/guarded.py": "if '__main__' == __name__:\n    pass\n",
            "test/test_x.py": "def test_it():\n    pass\n",
            "conftest.py": "def fixture():\n    pass\n",
            "packages/a/package.json": '{"name": "a", "main": "dist/x.js"}',
            "packages/a/src/x.ts": "export const x = 1;\n",
            "package.json": '{"workspaces": ["packages/*"], "scripts": {"s": "node tool.js"}}',
            "tool.js": "1;\n",
        },
    )
    out = scan(spark, str(tmp_path), cfg.load(None))
    assert {r.file: r.source for r in out["entries"].collect()} == {"lib/cli.py": "pyproject-scripts", "lib/second.py": "setup-config", "lib/guarded.py": "dunder-main", "packages/a/src/x.ts": "workspace", "tool.js": "scripts"}
    found = {r["name"]: (r.reachability, r.tier) for r in out["findings"].collect()}
    # the library's exported symbols may be used elsewhere; conftest is an entry of tests, its functions are not
    assert found == {"_hidden": ("dead", "likely"), "shown": ("dead", "maybe"), "A": ("dead", "maybe"), "test_it": ("test-only", "maybe"), "fixture": ("dead", "maybe"), "x": ("dead", "likely")}
    (tmp_path / "lib/cli.py").unlink()
    alone = tmp_path / "alone"
    planted(alone, {"a.py": "def f():\n    pass\n"})
    out = scan(spark, str(alone), cfg.load(None))
    assert out["collapsed"] and [(r.tier, r.fixable) for r in out["findings"].collect()] == [("maybe", False)]


def test_script_front_end():
    """Against counts by hand."""
    text = """import fs, { readFile as rf, type T } from "./io.js";
import * as ns from "../lib";
import "./side";
export * from "./all";
export { a as b } from "./c";
export const x = 1, y = (p: number): string => p > 1 ? "a" : `t${p + 1}e`;
export default function main(a, b = {}) {
  if (a && b) { for (const q of b) { rf(q); } } else if (a) return /x\\/y/.test(a);
  switch (a) { case 1: return 2; default: break }
  try { ns.go() } catch (e) { helper() }
  return [1].map((v) => v || 2);
}
interface I { f: (a: string) => void; g(): number }
type U = { k: string } | null;
class K extends I {
  static async m(a: T) { while (true) x(); }
}
const { d } = x
function helper(): { a: number } {
  return { a: x, helper2: 3 };
}
export { helper as h };
"""
    ir = script_code.lower("src/m.ts", text)
    assert [(s["name"], s["line"], s["exported"]) for s in ir["symbols"]] == [("x", 6, True), ("y", 6, True), ("main", 7, True), ("I", 13, False), ("U", 14, False), ("K", 15, False), ("helper", 19, True)]
    units = {u["name"]: u for u in ir["units"]}
    assert [(c["category"], c["depth"]) for c in units["main"]["control"]] == [("branch", 0), ("boolean", 1), ("loop", 1), ("branch", 1), ("case", 0), ("catch", 0)]
    assert units["main"]["params"] == 2 and units["main"]["loc"] == 6 and [c["category"] for c in units["m"]["control"]] == ["loop"] and len(ir["units"]) == 5
    assert {(i["kind"], i["module"], i["name"], i["alias"]) for i in ir["imports"]} == {("from", "./io.js", "default", "fs"), ("from", "./io.js", "readFile", "rf"), ("from", "./io.js", "T", "T"), ("import", "../lib", None, "ns"), ("effect", "./side", None, None)}
    assert {(x["kind"], x["name"], x["alias"]) for x in ir["exports"]} == {("star", None, None), ("from", "a", "b"), ("local", "main", "default"), ("local", "helper", "h")}
    uses = {(u["name"], u["attr"], u["owner"]) for u in ir["uses"]}
    assert ("ns", "go", "7:main") in uses and ("helper", None, "7:main") in uses and ("x", None, "19:helper") in uses and not any(u[0] == "helper2" for u in uses)
    assert script_code.candidates("src/m.ts", "./io.js")[:3] == ["src/io.ts", "src/io.tsx", "src/io.js"] and script_code.candidates("src/m.ts", "fs") == []
    for odd in ("", "`${", "'", "/* x", "((({", "export", "import", "a ? b", "}" * 5, "class", "export default", "function f(", "x = /[/]/g", "<a>don't</a>"):
        script_code.lower("odd.ts", odd)


def test_scan_of_scripts(spark, tmp_path):
    planted(
        tmp_path,
        {
            "package.json": '{"name": "p", "main": "dist/index.js", "devDependencies": {"vitest": "1"}, "workspaces": ["libs/*"]}',
            "libs/a/package.json": '{"name": "@p/a", "exports": {".": "./dist/a.js"}}',
            "libs/a/src/a.ts": "export function shared() { return 1; }\nexport function unshared() { return 2; }\n",
            "src/index.ts": 'import { go } from "./barrel.js";\nimport { shared } from "@p/a";\nimport "./effect";\nexport { pub as published } from "./pub";\ngo();\nshared();\n',
            "src/barrel.ts": 'export * from "./deep/index";\n',
            "src/deep/index.ts": 'export { run as go } from "./core";\n',
            "src/deep/core.ts": 'import { readFileSync } from "fs";\nexport function run() { return local; }\nconst local = 1;\nconst lost = 2;\nconst risky = readFileSync("x");\nconst lazy = () => readFileSync("x");\nexport const tested = 3;\n',
            "src/pub.ts": "export const pub = () => 1;\n",
            "src/effect.ts": "function onload() { return 1; }\nonload();\n",
            "src/core.test.ts": 'import { tested } from "./deep/core";\ntested;\n',
        },
    )
    out = scan(spark, str(tmp_path), cfg.load(None))
    assert {r.file: r.source for r in out["entries"].collect()} == {"src/index.ts": "mapped", "libs/a/src/a.ts": "workspace"}
    found = {r["name"]: (r.reachability, r.tier, r.fixable, r.effect) for r in out["findings"].collect()}
    assert found == {
        "unshared": ("dead", "likely", False, "unknown"),
        "lost": ("dead", "certain", True, "pure"),
        "risky": ("dead", "likely", False, "effectful"),
        "lazy": ("dead", "certain", True, "pure"),
        "tested": ("test-only", "maybe", False, "pure"),
        "pub": ("dead", "maybe", False, "pure"),
    }
    assert {r["name"] for r in out["metrics"].collect()} >= {"run", "shared", "onload", "(anonymous)"}


def test_duplication_in_a_scan(spark, tmp_path):
    body = "".join(f"    a{i} = b{i} + {i}\n" for i in range(12))
    planted(tmp_path, {"a.py": f"def f():\n{body}", "b.py": f"X = 1\n\ndef g():\n{body}"})
    groups = scan(spark, str(tmp_path), cfg.load(None))["duplication"].collect()
    assert len(groups) == 1 and [(m.file, m.start_line, m.end_line) for m in groups[0].members] == [("a.py", 1, 13), ("b.py", 3, 15)]


def test_plugins(spark, tmp_path):
    planted(tmp_path, {"package.json": '{"devDependencies": {"jest": "1", "next": "2"}, "name": "n"}', "jest.config.js": 'module.exports = { testMatch: ["<r>/x/*.js", "./y.js"], setupFiles: [`./s.js`] }', "requirements.txt": "pytest==1 # c\n"})
    repo = plugins.repo(str(tmp_path))
    assert [p.name for p in plugins.detected(repo)] == ["test-runner", "nextjs", "pytest"] and repo.published and not repo.python_library
    c = plugins.test_config(repo)
    assert (c.runner, c.match, c.setup, c.configs) == ("jest", ["<r>/x/*.js", "y.js"], ["s.js"], ["jest.config.js"])
    globs = {e.glob: e.kind for e in plugins.Nextjs().entries(repo)}
    paths = spark.createDataFrame([(p,) for p in ("app/a/page.tsx", "src/pages/api/x.ts", "middleware.js", "app/a/other.tsx")], "file string")
    assert {r.file for r in paths.where(matches_any(F.col("file"), list(globs))).collect()} == {"app/a/page.tsx", "src/pages/api/x.ts", "middleware.js"}
    nodes = spark.createDataFrame([(f,) for f in ("m/a.js", "m/__mocks__/a.js", "__mocks__/b.js", "b.js", "m/__mocks__/none.js")], "file string")
    assert {(r.src, r.dst, r.kind) for r in plugins.mock_edges(nodes).collect()} == {("m/a.js", "m/__mocks__/a.js", "test"), ("b.js", "__mocks__/b.js", "test")}
    assert plugins.TestRunner().taints(repo)[0].pattern and not plugins.Pytest().taints(repo)


def test_initializer_effects(spark):
    declared = spark.createDataFrame([("a", "f", "variable", "expression"), ("b", "f", "variable", "function"), ("c", "f", "other", "none"), ("d", "f", "variable", "expression"), ("e", "f", "variable", "expression"), ("g", "f", "variable", "none")], "id string, file string, kind string, initializer string")
    calls = spark.createDataFrame([("a", "read", None, 0, False), ("b", "read", None, 0, False), ("d", "fs", "existsSync", 0, False), ("d", "fs", "rmSync", 2, False), ("d", "fs", "rmSync", 0, True), ("e", "fs", "rmSync", 1, False)], "id string, callee string, member string, depth int, constructed boolean")
    imports = spark.createDataFrame([("f", "read", "node:fs", "readFileSync"), ("f", "fs", "fs", "*")], "file string, local string, module string, name string")
    assert {r.id: r.effect for r in effects.initializer_effects(declared, calls, imports).collect()} == {"a": "effectful", "b": "pure", "c": "unknown", "d": "pure", "e": "effectful", "g": "pure"}


def test_triage(spark):
    findings = spark.createDataFrame([("f:2:g", "g", "f", 2, "dead", "maybe", False, True, False, "hit", 5, "unknown"), ("f:9:h", "h", "f", 9, "dead", "likely", False, False, False, "miss", 0, "pure")], "id string, name string, file string, line int, reachability string, tier string, collapsed boolean, public boolean, tainted boolean, coverage string, hits int, effect string")
    texts = spark.createDataFrame([("f", "x\ndef g():\n    pass\n")], "file string, text string")
    asked = triage.prompts(findings, texts, radius=1)
    row = asked.first()
    assert asked.count() == 1 and "Symbol: g (dead)" in row.user and "[-] part of the public surface" in row.user and "2\tdef g():" in row.user
    said = triage.judged(asked, lambda system, user: '{"verdict": "likely-dead", "reasoning": "r"}').first()
    assert (said.verdict, said.reasoning) == ("likely-dead", "r")

    def fails(system, user):
        raise OSError("no line")

    assert triage.judged(asked, fails).first().verdict == "unsure"
    rows = spark.createDataFrame([("a", "n", "f", 1, "likely-alive", ""), ("b", "n", "f", 2, "unsure", ""), ("c", "n", "f", 3, "likely-dead", "")], "id string, name string, file string, line int, verdict string, reasoning string")
    ordered = report.triage_order(rows).collect()
    assert [r.id for r in ordered] == ["c", "b", "a"] and "3 triaged" in report.triage_text(ordered)
    assert tuple(triage.token_totals(spark.createDataFrame([(1, 2), (3, 4)], "asked int, answered int")).first()) == (4, 6)


def test_specs_and_manifests_as_rows(spark):
    mods = spark.createDataFrame([("p/m.py", "p.m")], "file string, module string")
    declared = spark.createDataFrame([("p/m.py", "f", "p/m.py:3:f")], "file string, name string, id string")
    specs = spark.createDataFrame([("p.m:f",), ("p.m",), ("p.m:g",), ("q:f",)], "spec string")
    assert {r.spec: (r.file, r.symbol) for r in entries.module_specs(specs, mods, declared).collect()} == {"p.m:f": ("p/m.py", "p/m.py:3:f"), "p.m": ("p/m.py", None), "p.m:g": ("p/m.py", None), "q:f": (None, None)}
    rows = files.manifest_rows(spark.createDataFrame([(1, '{"main": "./a.js"}'), (2, "junk"), (3, None)], "k long, t string"), "k", "t").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "a.js")]
