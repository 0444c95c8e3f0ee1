"""Caching, evaluation and import resolution on small relations."""

import subprocess

from pyspark.sql import functions as F

from stratum.functions.scalars import import_lines, tainted
from stratum.operators import metrics, score, triage
from stratum.plans.cache import cached
from stratum.sources import files, python_code


def test_graph_cache(spark, tmp_path):
    texts = spark.createDataFrame([("a", "1"), ("b", "2")], "file string, text string")
    built = []

    def build():
        built.append(1)
        return {"nodes": spark.range(3), "edges": spark.range(2)}

    for texts_, settings, hit in ((texts, {"x": 1}, False), (texts, {"x": 1}, True), (texts, {"x": 2}, False), (texts.where("file = 'a'"), {"x": 1}, False), (texts, {"x": 1}, False), (texts, {"x": 1}, True)):
        tables, kept = cached(spark, str(tmp_path / "c"), texts_, settings, build)
        assert kept == hit and tables["nodes"].count() == 3 and tables["edges"].count() == 2
    assert len(built) == 4


def test_evaluation(spark):
    findings = spark.createDataFrame([("f", "a", "dead", "likely"), ("f", "b", "dead", "maybe"), ("f", "c", "test-only", "maybe"), ("f", "d", "dead", "certain")], "file string, name string, reachability string, tier string")
    cases = spark.createDataFrame([("f", "a", True), ("f", "b", True), ("f", "d", False), ("f", "e", False)], "file string, symbol string, truth boolean")
    told = score.predictions(cases, findings)
    assert {r.symbol: r.predicted for r in told.collect()} == {"a": True, "b": False, "d": True, "e": False}
    scores = score.confusion(told)
    assert score.meets(scores, {"prec": 0.5, "rec": 0.5}) and not score.meets(scores, {"prec": 0.6})
    assert {r.truth: (r.n, r.missed) for r in score.class_balance(told).collect()} == {True: (2, 1), False: (2, 1)}
    verdicts = spark.createDataFrame([("f:1:a", "unsure", "r")], "id string, verdict string, reasoning string")
    kept = triage.attached(spark.createDataFrame([("f:1:a", "maybe"), ("f:2:b", "maybe")], "id string, tier string"), verdicts).collect()
    assert [tuple(r) for r in kept] == [("f:1:a", "maybe", "unsure", "r")]
    worst = metrics.god_functions(spark.createDataFrame([("cyclomatic-complexity", "x"), ("god-function", "y"), ("god-function", "z")], "detector string, name string").coalesce(1)).collect()
    assert [r["name"] for r in worst] == ["y"]


def test_import_resolution_rate(spark):
    texts = spark.createDataFrame([("p/__init__.py", ""), ("p/a.py", "import os\nimport p.b\nfrom . import gone, b\nfrom .none import x\n"), ("p/b.py", "import p.zzz\n"), ("p/_vendor/v.py", "import p.nothing\n")], "file string, text string")
    ir, mods = python_code.lowered(texts), python_code.modules(texts, [""])
    rows = python_code.local_imports(ir, mods)
    assert sorted((r.file, r.line, r.resolved) for r in rows.collect()) == [("p/a.py", 2, True), ("p/a.py", 3, True), ("p/a.py", 3, True), ("p/a.py", 4, False), ("p/b.py", 1, False)]
    assert score.resolution_rate(rows).first().rate == 0.6


def test_reports_of_others(spark, tmp_path):
    (tmp_path / "prior.json").write_text('{"findings": [{"name": "a", "file": "f", "line": 3, "tier": "maybe"}]}')
    prior = files.prior_findings(spark, str(tmp_path / "prior.json")).first()
    assert (prior["name"], prior.line, prior.exported) == ("a", 3, False)
    (tmp_path / "nested.json").write_text('{"issues": [{"file": "f", "exports": [{"name": "x"}], "types": [{"name": "T"}]}]}')
    assert {tuple(r) for r in files.nested_report(spark, str(tmp_path / "nested.json")).collect()} == {("f", "x"), ("f", "T")}
    (tmp_path / "lines.txt").write_text("src/a.ts:12 - gone (used in module)\nnoise\n")
    assert [tuple(r) for r in files.line_report(spark, str(tmp_path / "lines.txt")).collect()] == [("src/a.ts", 12, "gone")]
    (tmp_path / "cases.json").write_text('[{"name": "c", "truth": "dead"}, {"name": "d", "truth": "alive"}]')
    assert [r["name"] for r in files.corpus_cases(spark, str(tmp_path / "cases.json")).orderBy("ordinal").collect()] == ["c", "d"]


def test_small_expressions(spark):
    row = spark.range(1).select(
        import_lines(F.lit("import a\n  import b from 'c'\nimport('d')\nimporter\nx")).alias("i"),
        tainted(F.lit("# getattr(x, 'y')"), F.lit(True)).alias("p"),
        tainted(F.lit("// getattr(x, 'y')"), F.lit(False)).alias("s"),
        tainted(F.lit("await import(`./${name}`)"), F.lit(False)).alias("d"),
        tainted(F.lit("handlers[ key ](1)"), F.lit(True)).alias("c"),
        tainted(F.lit("retrieval(x) values[0](1) reimport"), F.lit(False)).alias("n"),
    ).first()
    assert row.i == ["import a", "import b from 'c'"] and (row.p, row.s, row.d, row.c, row.n) == (True, False, True, True, False)


def test_churn_of_a_folder_of_a_repository(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *args], check=True, capture_output=True)

    assert files.git_churn(spark, str(tmp_path)) is None
    git("init")
    for k in range(2):
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / "sub" / "a é.py").write_text(str(k))
        (tmp_path / "b.py").write_text(str(k))
        git("add", "-A")
        git("commit", "-m", str(k))
    assert {tuple(r) for r in files.git_churn(spark, str(tmp_path)).collect()} == {("sub/a é.py", 2), ("b.py", 2)}
    assert {tuple(r) for r in files.git_churn(spark, str(tmp_path / "sub")).collect()} == {("a é.py", 2)}


def test_reports_are_parsed_once(spark):
    xml = '<coverage><class filename="a"><line number="1" hits="2"/></class><class filename="b"><line hits="3" number="1" branch="no"/></class><class name="none"><line number="7" hits="1"/></class><class filename="a"><line number="2" hits="0"/><line number="1" hits="5"/></class><class filename="c"></class></coverage>'
    left_open = '<class filename="d" <line number="1" hits="1"/><class filename="d"><line number="2" hits="4"/>'
    texts = [xml, left_open, "SF:a\nDA:9,9\nend_of_record\nSF:c\nDA:2,2\nFN:1,f\nFN:3,g\nFNDA:8,g\nend_of_record\nSF:e\nend_of_record\n"]
    found = files.parsed_reports(spark.createDataFrame([(t,) for t in texts], "value string"), most=2)
    want = {("a", "line", None, 1, 5, 1, 0), ("b", "line", None, 1, 3, 1, 1), ("a", "line", None, 2, 0, 1, 2), ("d", "line", None, 1, 1, 1, 0), ("d", "line", None, 2, 4, 1, 1), ("c", "fn", "f", 1, 0, 0, 1), ("c", "fn", "g", 3, 8, 0, 2), ("c", "line", None, 2, 2, 0, 3)}
    assert found.dtypes == spark.createDataFrame([], files.COVERAGE).dtypes and {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert found._jdf.queryExecution().sparkPlan().toString().count("MapIn") == 1


def test_lines_of_reports(spark):
    from stratum.plans import measures

    lcov = "DA:1,1\r\nSF:a\r\nDA:1,2\r\n DA: 2 , 3 ,sum\nDA:x,1\nDA:3\nDA:4,-1\nDA:5,6,sum\n\nFN:7,f,g\nFN:x,h\nFNDA:2,f,g\x0bDA:8,9\nend_of_record\nDA:9,9\nSF:b\nend_of_record"
    assert files.parse_lcov(lcov) == [("a", "fn", "f,g", 7, 2), ("a", "line", None, 1, 2), ("a", "line", None, 2, 3), ("a", "line", None, 5, 6), ("a", "line", None, 8, 9)]
    for query in (measures.lcov_sessionize, measures.xml_extract_merge):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("MapIn") == 1 and "lambda" not in plan
