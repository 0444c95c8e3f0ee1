"""Python sources as relations: one parse per file gives symbols, units, tokens, imports and uses together."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reach import chase

CONTROL = "array<struct<category:string,depth:int,nests:boolean>>"
SCHEMA = (
    "file string, ok boolean, main_guard boolean, star_import boolean, "
    "symbols array<struct<name:string,line:int,end_line:int,exported:boolean>>, "
    f"units array<struct<name:string,line:int,loc:int,params:int,control:{CONTROL}>>, "
    "tokens array<struct<norm:string,line:int,unit:int>>, "
    "imports array<struct<kind:string,line:int,module:string,level:int,name:string,alias:string>>, "
    "uses array<struct<name:string,attr:string,line:int,owner:string>>"
)
_NEST = {ast.If: "branch", ast.For: "loop", ast.AsyncFor: "loop", ast.While: "loop", ast.ExceptHandler: "catch", ast.IfExp: "ternary", ast.match_case: "case"}


def control_nodes(function: ast.AST) -> list[tuple[str, int, bool]]:
    """(category, depth, nests) of the function's own control flow; functions inside it are units of their own. What an if tests is inside it; each elif is one deeper than its if, however many there are."""
    out: list[tuple[str, int, bool]] = []

    def is_elif(child: ast.AST, parent: ast.AST) -> bool:
        return isinstance(child, ast.If) and isinstance(parent, ast.If) and parent.orelse == [child] and child.col_offset == parent.col_offset

    def visit(node: ast.AST, depth: int, chained: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
                continue
            kind = _NEST.get(type(child))
            if kind:
                linked = is_elif(child, node)
                at = depth - 1 if linked and chained else depth
                out.append((kind, at, True))
                visit(child, at + 1, linked)
            elif isinstance(child, ast.BoolOp):
                out.extend(("boolean", depth, False) for _ in child.values[1:])
                visit(child, depth, False)
            elif isinstance(child, ast.comprehension):
                out.append(("loop", depth, True))
                out.extend(("branch", depth, True) for _ in child.ifs)
                visit(child, depth, False)
            else:
                visit(child, depth, False)

    body = function.body if isinstance(function.body, list) else [function.body]
    visit(ast.Module(body=body, type_ignores=[]), 0, False)
    return out


def _tokens(text: str) -> list[tuple[str, int]]:
    """Names as ID, literals as LIT (strings between their quotes), keywords and signs as they are; comments and layout dropped."""
    import keyword

    out = []
    marks = {tokenize.FSTRING_START: "string_start", tokenize.FSTRING_MIDDLE: "LIT", tokenize.FSTRING_END: "string_end"}
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.NAME:
                out.append(("LIT" if t.string in ("True", "False") else t.string if keyword.iskeyword(t.string) else "ID", t.start[0]))
            elif t.type == tokenize.NUMBER:
                out.append(("LIT", t.start[0]))
            elif t.type == tokenize.STRING:
                empty = len(t.string.lstrip("rRbBuU").strip("\"'")) == 0
                out += [("string_start", t.start[0]), *([] if empty else [("LIT", t.start[0])]), ("string_end", t.end[0])]
            elif t.type in marks:
                out.append((marks[t.type], t.start[0]))
            elif t.type == tokenize.OP:
                out.append((t.string, t.start[0]))
    except (tokenize.TokenError, IndentationError):
        pass
    return out


def _names(node: ast.AST) -> list[str]:
    """Identifiers of a node's own: what it loads, stores, declares or binds, but for attributes and imports."""
    if isinstance(node, ast.Name):
        return [node.id]
    if isinstance(node, (ast.arg, ast.keyword)):
        return [node.arg] if node.arg else []
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.ExceptHandler, ast.MatchAs, ast.MatchStar)):
        return [node.name] if node.name else []
    return list(node.names) if isinstance(node, (ast.Global, ast.Nonlocal)) else []


def _uses(tree: ast.Module, declared: list[tuple[str, ast.AST]]) -> list[dict]:
    """Names and one-step attributes with the declaration around them (line:name; null at module level). A declaration's own name is no use of it."""
    own = {id(n.targets[0] if isinstance(n, ast.Assign) else n.target if isinstance(n, ast.AnnAssign) else n) for _, n in declared}
    spans = [(f"{n.lineno}:{name}", (n.lineno, n.col_offset), (n.end_lineno, n.end_col_offset)) for name, n in declared]
    out: list[dict] = []
    todo: list[tuple[ast.AST, str | None]] = []
    for node in tree.body:
        # decorators lie before the declaration's span
        todo += [(d, None) for d in getattr(node, "decorator_list", [])]
        at = getattr(node, "lineno", 0), getattr(node, "col_offset", 0)
        todo.append((node, next((s for s, a, z in spans if a <= at < z), None)))
    outer = {id(n) for n in tree.body}
    while todo:
        node, owner = todo.pop()
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            continue
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            out.append({"name": node.value.id, "attr": node.attr, "line": node.lineno, "owner": owner})
        if id(node) not in own:
            out += [{"name": n, "attr": None, "line": getattr(node, "lineno", 0), "owner": owner} for n in _names(node)]
        skip = {id(d) for d in getattr(node, "decorator_list", [])} if id(node) in outer else set()
        todo += [(c, owner) for c in ast.iter_child_nodes(node) if id(c) not in skip]
    return out


def lower(file: str, text: str) -> dict:
    """All relations of one file; a file that doesn't parse gives its tokens only."""
    row: dict = {"file": file, "ok": False, "main_guard": False, "star_import": False, "symbols": [], "units": [], "tokens": [{"norm": n, "line": x, "unit": -1} for n, x in _tokens(text)], "imports": [], "uses": []}
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return row
    row["ok"] = True
    shown: set[str] | None = None
    found: list[tuple[str, ast.AST]] = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            found.append((node.name, node))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            target = node.targets[0] if isinstance(node, ast.Assign) else node.target
            if isinstance(target, ast.Name) and target.id == "__all__":
                if shown is None and isinstance(node.value, (ast.List, ast.Tuple)):
                    shown = {x.value for x in node.value.elts if isinstance(x, ast.Constant) and isinstance(x.value, str)}
            elif isinstance(target, ast.Name):
                found.append((target.id, node))
        elif isinstance(node, ast.If) and isinstance(node.test, ast.Compare) and len(node.test.comparators) == 1:
            sides = [node.test.left, node.test.comparators[0]]
            row["main_guard"] |= any(isinstance(a, ast.Name) and a.id == "__name__" and isinstance(b, ast.Constant) and b.value == "__main__" for a, b in (sides, sides[::-1]))
    for name, node in found:
        public = not name.startswith("_") or name in (shown or ()) or bool(re.fullmatch(r"__\w+__", name)) or name.startswith("test_")
        row["symbols"].append({"name": name, "line": node.lineno, "end_line": node.end_lineno or node.lineno, "exported": public})
    row["uses"] = _uses(tree, found)
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
            a = node.args
            params = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
            row["units"].append({"name": getattr(node, "name", "(anonymous)"), "line": node.lineno, "loc": (node.end_lineno or node.lineno) - node.lineno + 1, "params": params, "control": [{"category": c, "depth": d, "nests": n} for c, d, n in control_nodes(node)]})
        elif isinstance(node, ast.Import):
            row["imports"] += [{"kind": "import", "line": node.lineno, "module": x.name, "level": 0, "name": None, "alias": x.asname} for x in node.names]
        elif isinstance(node, ast.ImportFrom):
            row["imports"] += [{"kind": "from", "line": node.lineno, "module": node.module or "", "level": node.level, "name": x.name, "alias": x.asname} for x in node.names]
            row["star_import"] |= any(x.name == "*" for x in node.names)
    inner: dict[int, int] = {}
    for k in sorted(range(len(row["units"])), key=lambda k: (-row["units"][k]["loc"], -k)):
        u = row["units"][k]
        inner.update(dict.fromkeys(range(u["line"], u["line"] + u["loc"]), k))
    for t in row["tokens"]:
        t["unit"] = inner.get(t["line"], -1)
    return row


def lowered(files: DataFrame) -> DataFrame:
    """file, text to all relations, nested, in one pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([lower(x, t or "") for x, t in zip(f["file"], f["text"], strict=True)], columns=[c.split()[0] for c in ("file", "ok", "main_guard", "star_import", "symbols", "units", "tokens", "imports", "uses")])

    return files.select("file", "text").mapInPandas(run, SCHEMA)


def streams(ir: DataFrame) -> DataFrame:
    """file, norms, units, lines: the tokens of each file as arrays."""
    return ir.select("file", F.col("tokens.norm").alias("norms"), F.col("tokens.unit").alias("units"), F.col("tokens.line").alias("lines"))


def import_roots(files: DataFrame) -> list[str]:
    """`src` if every Python file is below it, else the folder itself."""
    outside = files.where(F.col("file").endswith(".py") & ~F.col("file").startswith("src/"))
    return ["src"] if outside.isEmpty() and not files.where(F.col("file").startswith("src/")).isEmpty() else [""]


def modules(files: DataFrame, roots: list[str]) -> DataFrame:
    """file, module: dotted names under the longest root that holds the file; a package is its __init__, and a file under no root, or a root's own __init__, is no module."""
    f = F.col("file")
    rel = F.lit(None).cast("string")
    for root in sorted(roots, key=len):
        prefix = root.strip("/") + "/" if root.strip("/") else ""
        rel = F.when(f.startswith(prefix), F.substring(f, len(prefix) + 1, 10_000)).otherwise(rel)
    dotted = F.replace(F.regexp_replace(rel, r"\.py$", ""), F.lit("/"), F.lit("."))
    named = files.where(f.endswith(".py")).select("file", F.regexp_replace(dotted, r"(^|\.)__init__$", "").alias("module"))
    return named.where("module <> ''")


def resolved_imports(ir: DataFrame, mods: DataFrame) -> DataFrame:
    """file, ordinal, line, name, alias, local, target, whole: the submodule if there is one (whole: the local name stands for all of it), else the module; relative ones count their dots from the importing package; null if neither is here. The local name of a dotted import is its first part."""
    rows = ir.select("file", F.posexplode("imports").alias("ordinal", "i")).join(mods.select("file", F.col("module").alias("here")), "file", "left")
    package = F.coalesce(F.when(F.col("file").endswith("__init__.py"), F.col("here")).otherwise(F.regexp_replace("here", r"(^|\.)[^.]*$", "")), F.lit(""))
    parts = F.filter(F.split(package, r"\."), lambda x: x != "")
    level = F.col("i.level")
    base = F.when(level == 0, F.col("i.module")).when(level - 1 <= F.size(parts), F.concat_ws(".", F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level + 1, F.lit(0))), "."), F.when(F.col("i.module") != "", F.col("i.module"))))
    base = F.regexp_replace(base, r"^\.", "")
    named = F.col("i.name").isNotNull()
    rows = rows.withColumn("base", base).withColumn("sub", F.when(named & F.col("base").isNotNull(), F.regexp_replace(F.concat_ws(".", "base", "i.name"), r"^\.", "")))
    by = mods.groupBy("module").agg(F.max("file").alias("t"))
    out = rows.join(by.select(F.col("module").alias("sub"), F.col("t").alias("sub_file")), "sub", "left").join(by.select(F.col("module").alias("base"), F.col("t").alias("base_file")), "base", "left")
    local = F.coalesce(F.col("i.alias"), F.col("i.name"), F.element_at(F.split("i.module", r"\."), 1))
    return out.select("file", "ordinal", "i.line", "i.name", "i.alias", local.alias("local"), F.coalesce("sub_file", "base_file").alias("target"), (~named | F.col("sub_file").isNotNull()).alias("whole"))


def local_imports(ir: DataFrame, mods: DataFrame) -> DataFrame:
    """file, line, resolved of the imports that should lead into the tree: relative ones, and those whose first part is one of its modules'; nothing from vendored folders."""
    roots = mods.select(F.element_at(F.split("module", r"\."), 1).alias("root")).distinct()
    rows = ir.where(~F.col("file").rlike(r"(^|/)(_vendor|vendor)/")).select("file", F.posexplode("imports").alias("ordinal", "i")).withColumn("root", F.element_at(F.split("i.module", r"\."), 1))
    local = rows.join(roots.withColumn("known", F.lit(True)), "root", "left").where("i.level > 0 OR known").select("file", "ordinal")
    return resolved_imports(ir, mods).join(local, ["file", "ordinal"], "left_semi").select("file", "line", F.col("target").isNotNull().alias("resolved"))


def _key(file: str, name: Column) -> Column:
    return F.concat_ws("\0", file, name)


def references(ir: DataFrame, nodes: DataFrame, mods: DataFrame) -> DataFrame:
    """src, dst, file: every use of a declared symbol, from the declaration around it or else its file. Names are followed through imports and re-exports, however long, to where they are declared; of several declarations of a name in a file the last one counts, and of several imports of it too."""
    last = nodes.groupBy("file", "name").agg(F.max_by("id", "line").alias("id")).select(_key("file", F.col("name")).alias("key"), "id")
    imports = resolved_imports(ir, mods).where("local <> '*'")
    bound = imports.groupBy("file", "local").agg(F.max_by(F.struct("target", "name", "whole"), "ordinal").alias("b")).where("b.target IS NOT NULL")
    bound = bound.select("file", "local", F.col("b.target").alias("target"), F.when(F.col("b.whole"), F.col("local")).otherwise(F.col("b.name")).alias("imported"))
    links = bound.select(_key("file", F.col("local")).alias("src"), _key("target", F.col("imported")).alias("dst"))
    uses = ir.select("file", F.explode("uses").alias("u")).select("file", "u.name", "u.attr", F.concat_ws(":", "file", "u.owner").alias("src"))
    bare = uses.where("attr IS NULL").select("src", "file", _key("file", F.col("name")).alias("start"))
    through = uses.where("attr IS NOT NULL").join(bound.select(F.col("file").alias("bf"), "local", "target"), (F.col("file") == F.col("bf")) & (F.col("name") == F.col("local"))).select("src", "file", _key("target", F.col("attr")).alias("start"))
    sites = bare.unionByName(through).distinct()
    ends = chase(links, last.select(F.col("key").alias("id")), sites.select(F.col("start").alias("id")).distinct()).where("target IS NOT NULL")
    return sites.join(ends, "start").join(last, F.col("target") == F.col("key")).select("src", F.col("id").alias("dst"), "file")
