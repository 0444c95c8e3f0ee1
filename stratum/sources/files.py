"""Reading source trees, coverage reports, change history and manifests into relations."""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.globs import glob_regex, matches_any

SKIPPED = ["node_modules", ".git", "dist", "out", "coverage", ".next", "__pycache__", ".venv", "venv"]
DECLARATIONS = r"\.(d\.ts|d\.mts|d\.cts|pyi)$"


def skipped_folders(include: list[str]) -> list[str]:
    """`build` holds output in one ecosystem and code in another: it is skipped unless Python files are asked for."""
    return SKIPPED if any("*.py" in g for g in include) else [*SKIPPED, "build"]


def select_paths(paths: DataFrame, include: list[str], ignore: list[str]) -> DataFrame:
    """paths(file, ...) that a glob includes and none ignores, outside skipped folders, no declaration files."""
    skip = "(^|/)(" + "|".join(re.escape(s) for s in skipped_folders(include)) + ")/"
    f = F.col("file")
    return paths.where(matches_any(f, include) & ~matches_any(f, ignore) & ~f.rlike(skip) & ~f.rlike(DECLARATIONS))


def _filesystem(target: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(target) if "://" in target else (fs.LocalFileSystem(), str(Path(target).resolve()))


def read_text(target: str, name: str) -> str | None:
    """A small file of the tree, such as a manifest; None if it isn't there."""
    system, root = _filesystem(target)
    try:
        with system.open_input_stream(f"{root.rstrip('/')}/{name}") as stream:
            return stream.read().decode("utf-8", "replace")
    except (FileNotFoundError, OSError):
        return None


def read_json(target: str, name: str) -> dict:
    """The same as JSON; empty if it isn't there or isn't an object."""
    try:
        value = json.loads(read_text(target, name) or "{}")
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def root_names(target: str) -> list[str]:
    """Names in the tree's own folder."""
    from pyarrow import fs

    system, root = _filesystem(target)
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(root)))


def listed(target: str, include: list[str]) -> list[str]:
    """Paths of all files below target, relative to it, skipped folders left out on the way. Spark's own listing hides names that begin with an underscore, which Python packages are made of."""
    from pyarrow import fs

    system, root = _filesystem(target)
    skip, out, todo = set(skipped_folders(include)), [], [root]
    while todo:
        for f in system.get_file_info(fs.FileSelector(todo.pop())):
            if f.type == fs.FileType.Directory:
                if f.base_name not in skip:
                    todo.append(f.path)
            elif f.type == fs.FileType.File:
                out.append(f.path[len(root.rstrip("/")) + 1 :])
    return sorted(out)


def source_files(spark: SparkSession, target: str, include: list[str], ignore: list[str]) -> DataFrame:
    """file (relative to target), text. The listing is filtered first, and tasks read the files that are left."""
    paths = select_paths(spark.createDataFrame([(p,) for p in listed(target, include)], "file string"), include, ignore)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _filesystem(target)
        for f in frames:
            rows = []
            for name in f["file"]:
                with system.open_input_stream(f"{root.rstrip('/')}/{name}") as stream:
                    rows.append((name, stream.read().decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["file", "text"])

    return paths.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(read, "file string, text string")


#: Records of one file that follow each other in a report: file, names of its functions, lines of functions and then others, hits of each.
Run = tuple[str, list[str], list[int], list[int]]


def _records(runs: list[Run]) -> list[tuple[str, str, str | None, int, int]]:
    return [(f, "fn", names[i], line, n) if i < len(names) else (f, "line", None, line, n) for f, names, lines, hits in runs for i, (line, n) in enumerate(zip(lines, hits, strict=True))]


#: line and hits of a plain DA line, or another line.
_DATA_OR_OTHER = re.compile(r"^(?:DA:(\d+),(\d+)|(.+))$", re.M)


def _lcov_runs(text: str) -> list[Run]:
    """A repeated file replaces what was said before, a repeated line its hits; a function without data has 0."""
    files: dict[str, tuple[dict[str, int], dict[str, int], dict[int, int]]] = {}
    here = None
    for at, count, other in _DATA_OR_OTHER.findall(text):
        if at:
            if here is not None:
                here[2][int(at)] = int(count)
            continue
        for raw in other.splitlines():
            tag, _, rest = raw.strip().partition(":")
            if tag == "SF":
                here = files[rest] = ({}, {}, {})
            elif here is None:
                continue
            elif tag == "FN":
                line, _, name = rest.partition(",")
                if line.strip().isdigit():
                    here[0].setdefault(name, int(line))
            elif tag == "FNDA":
                n, _, name = rest.partition(",")
                if n.strip().isdigit():
                    here[1][name] = int(n)
            elif tag == "DA":
                line, _, n = rest.partition(",")
                n = n.split(",")[0]
                if line.strip().isdigit() and n.strip().isdigit():
                    here[2][int(line)] = int(n)
            elif raw.strip() == "end_of_record":
                here = None
    return [(f, list(fns), [*fns.values(), *lines], [*(hits.get(x, 0) for x in fns), *lines.values()]) for f, (fns, hits, lines) in files.items() if fns or lines]


def parse_lcov(text: str) -> list[tuple[str, str, str | None, int, int]]:
    """(file, kind fn or line, name, line, hits): a repeated file replaces what was said before, a repeated line its hits; a function without data has 0."""
    return _records(_lcov_runs(text))


#: The middle branch is for lines as they are mostly written, the last for all others.
_CLASS_OR_LINE = re.compile(r"<(?:class\b(?:[^>]*\bfilename=(\"[^\"]*\"))?|line\b(?:\s+number=\"(\d+)\"\s+hits=\"(\d+)\"[^>]*+>|(?=[^>]*?\bnumber=\"(\d+)\")(?=[^>]*?\bhits=\"(\d+)\")[^>]*>))")
_CLOSED = re.compile(r"[^<]*+(?:<[^<>]*+>[^<]*+)*+")


def _cobertura_tags(text: str) -> list[tuple[str, str, str, str, str]]:
    """(quoted file, number, hits, number, hits): a class has the first, if any, a line two of the others. A whole text at once; only one with tags left open is taken apart first, so that none reaches into the next."""
    tags = _CLASS_OR_LINE.findall(text)
    if _CLOSED.fullmatch(text) and not any("<" in t[0] for t in tags):
        return tags
    out = []
    for block in re.split(r"(?=<class\b)", text):
        m = re.match(r"<class\b[^>]*\bfilename=(\"[^\"]*\")", block)
        out.append((m[1] if m else "", "", "", "", ""))
        for tag in re.findall(r"<line\b[^>]*>", block):
            number, hits = re.search(r"\bnumber=\"(\d+)\"", tag), re.search(r"\bhits=\"(\d+)\"", tag)
            if number and hits:
                out.append(("", number[1], hits[1], "", ""))
    return out


def _cobertura_runs(text: str) -> list[Run]:
    """Several blocks of one file merge, later lines win."""
    files: dict[str, dict[int, int]] = {}
    order: list[tuple[str, list[int]]] = []
    here = run = None
    for name, number, n, number_too, n_too in _cobertura_tags(text):
        if number or number_too:
            if here is not None:
                line = int(number or number_too)
                if line not in here:
                    if run is None:
                        run = []
                        order.append((file, run))
                    run.append(line)
                here[line] = int(n or n_too)
        else:
            file = name[1:-1] if name else None
            here = None if file is None else files.setdefault(file, {})
            run = order[-1][1] if order and order[-1][0] == file else None
    return [(f, [], lines, [files[f][x] for x in lines]) for f, lines in order]


def parse_cobertura(text: str) -> list[tuple[str, str, str | None, int, int]]:
    """The same of the XML format; several blocks of one file merge, later lines win."""
    return _records(_cobertura_runs(text))


COVERAGE = "file string, kind string, name string, line int, hits long, priority int, ordinal int"


def existing(target: str, names: list[str]) -> list[str]:
    """Those of the names, each a path of its own or one below target, that are there, as paths."""
    from pyarrow import fs

    out = []
    for name in names:
        path = name if "://" in name or name.startswith("/") else f"{target.rstrip('/')}/{name}"
        system, where = _filesystem(path)
        if system.get_file_info(where).type == fs.FileType.File:
            out.append(path)
    return out


def coverage_records(spark: SparkSession, reports: list[str]) -> DataFrame:
    """Records of all reports that exist; of both formats the XML one has the say over a file."""
    there = [r for r in reports if "://" in r or Path(r).exists()]
    if not there:
        return spark.createDataFrame([], COVERAGE)
    return parsed_reports(spark.read.text(there, wholetext=True))


RUNS = "file string, names array<string>, lines array<int>, hits array<long>, first int, priority int"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of RUNS as columns."""
    file, names, lines, hits, first, priority = zip(*rows, strict=True)

    def lists(column: tuple, kind: pa.DataType) -> pa.Array:
        ends = np.cumsum([0, *map(len, column)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(list(chain.from_iterable(column)), kind))

    columns = [pa.array(file, pa.string()), lists(names, pa.string()), lists(lines, pa.int32()), lists(hits, pa.int64()), pa.array(first, pa.int32()), pa.array(priority, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RUNS.split(", ")])


def parsed_reports(whole: DataFrame, most: int = 200_000) -> DataFrame:
    """Records of reports(value), whole texts of either format; of both formats the XML one has the say over a file.

    Texts are parsed once. What meets by file are runs, a row for the records of a file in a report, sent after so many records; they become rows where they have met.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for text in b.column(0).to_pylist():
                xml, first = text.lstrip().startswith("<"), 0
                for run in _cobertura_runs(text) if xml else _lcov_runs(text):
                    rows.append((*run, first, int(xml)))
                    first += len(run[2])
                held += first
                if held >= most:
                    yield _packed(rows)
                    rows, held = [], 0
            if rows:
                yield _packed(rows)

    runs = whole.select("value").mapInArrow(parse, RUNS)
    kept = runs.withColumn("best", F.max("priority").over(Window.partitionBy("file"))).where("priority = best")
    rows = kept.select("*", F.posexplode("lines").alias("i", "line"))
    kind = F.when(F.col("i") < F.size("names"), "fn").otherwise("line").alias("kind")
    return rows.select("file", kind, F.get("names", F.col("i")).alias("name"), "line", F.get("hits", F.col("i")).alias("hits"), "priority", (F.col("first") + F.col("i")).alias("ordinal"))


def churn(changes: DataFrame) -> DataFrame:
    """file, churn: how often each file is among changes(file, ...)."""
    return changes.groupBy("file").agg(F.count("*").alias("churn"))


def git_churn(spark: SparkSession, target: str, timeout: float | None = None) -> DataFrame | None:
    """file (relative to target), churn; None where there is no history. A history that takes longer than a given timeout is an error, not an absent one.

    Git names files from the repository's root; those outside target are left out and the others named from there.
    """
    try:
        prefix = subprocess.run(["git", "-C", target, "rev-parse", "--show-prefix"], capture_output=True, text=True, check=True).stdout.strip()
        log = subprocess.run(["git", "-C", target, "-c", "core.quotePath=false", "log", "--format=", "--name-only", "HEAD", "--", "."], capture_output=True, text=True, timeout=timeout, check=True).stdout
    except (OSError, subprocess.CalledProcessError):
        return None
    rows = [(x[len(prefix) :],) for x in log.splitlines() if x.startswith(prefix) and x]
    return churn(spark.createDataFrame(rows, "file string"))


def leaf_paths(value: object) -> list[str]:
    """All strings in nested JSON, in order, without a leading ./"""
    if isinstance(value, str):
        return [value[2:] if value.startswith("./") else value]
    if isinstance(value, dict):
        value = list(value.values())
    return [x for v in value for x in leaf_paths(v)] if isinstance(value, list) else []


def manifest_paths(manifest: dict) -> list[str]:
    return [p for k in ("main", "module", "bin", "exports") for p in leaf_paths(manifest.get(k))]


def _rows(df: DataFrame, key: str, text: str, schema: str, told) -> DataFrame:
    """Rows that told(text) gives for each key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *r) for k, t in zip(f[key], f[text], strict=True) for r in told(t or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return df.select(key, text).mapInPandas(run, schema)


def manifest_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, ordinal, path: the files that each manifest, a JSON text, names; one that isn't JSON names none."""

    def told(t: str) -> list[tuple]:
        try:
            value = json.loads(t)
        except ValueError:
            return []
        return list(enumerate(manifest_paths(value))) if isinstance(value, dict) else []

    return _rows(df, key, text, f"{key} {df.schema[key].dataType.simpleString()}, ordinal long, path string", told)


def spec_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, spec: the entries that each settings text declares."""
    return _rows(df, key, text, f"{key} {df.schema[key].dataType.simpleString()}, spec string", lambda t: [(s,) for s in entry_specs(t)])


def script_paths(manifest: dict) -> list[str]:
    """Files that scripts mention."""
    scripts = manifest.get("scripts")
    words = [re.sub(r"^['\"]|['\"]$", "", w) for s in (scripts.values() if isinstance(scripts, dict) else []) if isinstance(s, str) for w in s.split()]
    return [w.removeprefix("./") for w in words if re.search(r"\.[cm]?[jt]sx?$", w)]


_SWAPPED = {".js": (".ts", ".tsx"), ".jsx": (".tsx", ".ts"), ".mjs": (".mts",), ".cjs": (".cts",)}


def _trimmed(folder: str) -> str:
    return re.sub(r"/+$", "", re.sub(r"^\./?", "", folder))


def source_candidates(path: str, out_dir: str | None = None, root_dir: str | None = None) -> list[str]:
    """Sources that a built path may come from, in order of preference."""
    bases = []
    if out_dir is not None:
        o = _trimmed(out_dir)
        if not o or path.startswith(o + "/"):
            bases.append("/".join(x for x in (_trimmed(root_dir or ""), path[len(o) + 1 :] if o else path) if x))
    if swapped := re.match(r"(?:dist|build|out)/(.+)", path):
        bases.append("src/" + swapped[1])
    out = []
    for base in bases:
        stem, dot, ext = base.rpartition(".")
        stem, ext = (stem, dot + ext) if dot else (base, "")
        out += [stem + e for e in (*_SWAPPED.get(ext, ()), ".ts", ".tsx")]
    return list(dict.fromkeys(out))


def tsconfig_text(own: str | None, other) -> dict[str, str | None]:
    """outDir and rootDir of a tsconfig text, or of the one it extends (one level), read by other(name); what isn't strict JSON says nothing."""

    def parsed(text: str | None) -> dict:
        try:
            value = json.loads(text or "{}")
        except ValueError:
            return {}
        return value if isinstance(value, dict) else {}

    first = parsed(own)
    base = first.get("extends")
    second = parsed(other(base.removeprefix("./"))) if isinstance(base, str) else {}
    return {k: (first.get("compilerOptions") or {}).get(k, (second.get("compilerOptions") or {}).get(k)) for k in ("outDir", "rootDir")}


def tsconfig(path: str | Path) -> dict[str, str | None]:
    """The same of a file."""
    p = Path(path)

    def read(q: Path) -> str | None:
        return q.read_text() if q.exists() else None

    return tsconfig_text(read(p), lambda name: read(p.parent / name))


def section_pairs(text: str, *headers: str) -> list[tuple[str, str]]:
    """key = value lines under the headers and their subsections, of TOML or INI; comments and quotes dropped."""
    out, inside = [], False
    for raw in text.splitlines():
        line = raw.split("#")[0].strip()
        if m := re.fullmatch(r"\[([^\]]+)\]", line):
            name = re.sub("[\"']", "", m[1])
            inside = any(name == h or name.startswith(h + ".") for h in headers)
        elif inside and (m := re.fullmatch(r"([\w.-]+)\s*=\s*(.+)", line)):
            out.append((m[1], re.sub("^[\"']|[\"']$", "", m[2])))
    return out


def has_section(text: str, header: str) -> bool:
    return any(x.strip() == f"[{header}]" for x in text.splitlines())


_SPEC = re.compile(r"[A-Za-z_][\w.]*(?::[A-Za-z_]\w*)?")


def entry_specs(text: str, *headers: str) -> list[str]:
    """module or module:function values of script sections, by default pyproject's."""
    return [v for _, v in section_pairs(text, *(headers or ("project.scripts", "project.gui-scripts", "project.entry-points"))) if _SPEC.fullmatch(v)]


def setup_specs(text: str) -> list[str]:
    """The same of literal console_scripts in a setup(...) call."""
    import ast

    try:
        tree = ast.parse(text)
    except SyntaxError:
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and getattr(node.func, "id", getattr(node.func, "attr", "")) == "setup":
            for kw in node.keywords:
                if kw.arg == "entry_points" and isinstance(kw.value, ast.Dict):
                    for k, v in zip(kw.value.keys, kw.value.values, strict=True):
                        if isinstance(k, ast.Constant) and k.value == "console_scripts" and isinstance(v, ast.List):
                            out += [x.value.split("=")[1].strip() for x in v.elts if isinstance(x, ast.Constant) and isinstance(x.value, str) and "=" in x.value]
    return [v for v in out if _SPEC.fullmatch(v)]


def dependency_names(pyproject: str, requirements: str = "") -> list[str]:
    """Bare names of the project's declared dependencies and of requirement lines."""
    specs: list[str] = []
    project = inside = False
    for raw in pyproject.splitlines():
        line = raw.split("#")[0].strip()
        if not inside:
            if m := re.fullmatch(r"\[([^\]]+)\]", line):
                project = m[1] == "project"
            elif project and (m := re.match(r"dependencies\s*=\s*\[(.*)", line)):
                specs += [a or b for a, b in re.findall(r"\"([^\"]*)\"|'([^']*)'", m[1])]
                inside = not line.endswith("]")
        else:
            specs += [a or b for a, b in re.findall(r"\"([^\"]*)\"|'([^']*)'", line)]
            inside = not re.sub(r"\"[^\"]*\"|'[^']*'", "", line).count("]")
    specs += [x for raw in requirements.splitlines() if (x := raw.split("#")[0].strip()) and not x.startswith("-")]
    return [n[0] for s in specs if (n := re.match(r"[A-Za-z0-9][A-Za-z0-9._-]*", s.strip()))]


def workspace_globs(package_json: dict | None, pnpm_yaml: str = "") -> list[str]:
    """Member globs, of the array form, the packages form or pnpm's list."""
    w = (package_json or {}).get("workspaces")
    globs = w if isinstance(w, list) else w.get("packages", []) if isinstance(w, dict) else []
    inside = False
    for raw in pnpm_yaml.splitlines():
        if re.match(r"packages\s*:", raw):
            inside = True
        elif inside and (m := re.match(r"\s*-\s*['\"]?([^'\"#]+?)['\"]?\s*(?:#.*)?$", raw)):
            globs = [*globs, m[1]]
        elif raw.strip() and not raw.startswith((" ", "-")):
            inside = False
    return globs


_NO_MEMBERS = {"node_modules", ".git", "dist", "coverage", ".next"}


def workspace_members(target: str, depth: int = 6) -> list[str]:
    """Folders below target, at most so deep, that hold a package.json and that a workspace glob names."""
    from pyarrow import fs

    globs = [g.rstrip("/") for g in workspace_globs(read_json(target, "package.json"), read_text(target, "pnpm-workspace.yaml") or "")]
    if not globs:
        return []
    named = re.compile("|".join(f"(?:{glob_regex(g)})" for g in globs))
    system, root = _filesystem(target)
    root = root.rstrip("/")
    out, todo = [], [(root, 0)]
    while todo:
        folder, level = todo.pop()
        for f in system.get_file_info(fs.FileSelector(folder)):
            if f.type == fs.FileType.Directory and level < depth and f.base_name not in _NO_MEMBERS and not f.base_name.startswith("."):
                todo.append((f.path, level + 1))
            elif f.base_name == "package.json" and folder != root and named.match(folder[len(root) + 1 :]):
                out.append(folder[len(root) + 1 :])
    return sorted(out)


CONVENTIONAL = ["index.ts", "index.tsx", "src/index.ts", "src/index.tsx", "main.ts", "src/main.ts"]
CANDIDATES = "base string, name string, source string, ordinal int, file string, place int"


def manifest_candidates(target: str, base: str = "") -> list[tuple]:
    """Rows of CANDIDATES: the files that a package's manifest, convention and scripts may name, in order; base is its folder in the tree."""
    at = f"{base}/" if base else ""
    manifest = read_json(target, at + "package.json")
    options = tsconfig_text(read_text(target, at + "tsconfig.json"), lambda n: read_text(target, at + n))
    name = manifest.get("name") if isinstance(manifest.get("name"), str) else None
    rows = []
    for k, path in enumerate(manifest_paths(manifest)):
        rows += [(base, name, "manifest", k, at + c, i) for i, c in enumerate([path, *source_candidates(path, options["outDir"], options["rootDir"])])]
    rows += [(base, name, "convention", k, at + c, 0) for k, c in enumerate(CONVENTIONAL)]
    return rows + [(base, name, "scripts", k, at + c, 0) for k, c in enumerate(script_paths(manifest))]


def prior_findings(spark: SparkSession, path: str) -> DataFrame:
    """A JSON report of an earlier scan as rows; nothing in it counts as exported."""
    df = spark.read.json(path, multiLine=True)
    return df.select(F.explode("findings").alias("f")).select("f.*").withColumn("exported", F.lit(False))


def nested_report(spark: SparkSession, path: str) -> DataFrame:
    """file, symbol of a report with exports and types nested per file."""
    return nested_symbols(spark.read.json(path, multiLine=True))


def nested_symbols(report: DataFrame) -> DataFrame:
    """file, symbol of report(issues array<struct<file, exports, types>>), both arrays of structs with a name."""
    df = report.select(F.explode("issues").alias("i"))
    return df.select(F.col("i.file").alias("file"), F.explode(F.concat(F.transform("i.exports", lambda x: x["name"]), F.transform("i.types", lambda x: x["name"]))).alias("symbol"))


def line_report(spark: SparkSession, path: str) -> DataFrame:
    """file, line, symbol of `file:line - symbol` lines."""
    v = F.col("value")
    pattern = r"^(.+?):(\d+) - (\S+)"
    rows = spark.read.text(path).where(v.rlike(pattern))
    return rows.select(F.regexp_extract(v, pattern, 1).alias("file"), F.regexp_extract(v, pattern, 2).cast("int").alias("line"), F.regexp_extract(v, pattern, 3).alias("symbol"))


def corpus_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an evaluation corpus, a JSON array of objects, with their place in it."""
    return spark.read.json(path, multiLine=True).withColumn("ordinal", F.monotonically_increasing_id())
