"""JavaScript and TypeScript sources as relations, in the schema of the Python front end.

There is no compiler here: texts are cut into tokens, brackets are matched, and statements are followed far enough for declarations, imports and exports, functions and their control flow. References go by name: a local variable that hides a declaration counts as a use of it, so a symbol may be thought alive that a compiler knows is not, never the other way round by this.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.effects import initializer_effects
from ..operators.entries import first_existing
from ..operators.reach import chase
from ..stage import staged
from .python_code import SCHEMA

#: Beside the relations of a Python file: what a file gives on. kind local, from or star; name as it is there, alias as it is given.
SCRIPT = SCHEMA + ", exports array<struct<kind:string,module:string,name:string,alias:string>>, variables array<struct<name:string,line:int,initializer:string>>, calls array<struct<name:string,line:int,callee:string,member:string,depth:int,constructed:boolean>>"
_WORDS = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let static async await of get set enum implements interface package private protected public abstract as declare type namespace readonly keyof infer is satisfies null true false undefined".split())
#: Words that can also be names.
_SOFT = set("let static async await of get set type namespace readonly keyof infer is satisfies as declare abstract package undefined from".split())
_TOKEN = re.compile(r"(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<id>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*|#[A-Za-z_$][\w$]*)|(?P<num>0[xXbBoO][\da-fA-F_]+n?|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?n?)|(?P<str>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<p>=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|===?|!==?|<=|>=|\*\*=?|\+\+|--|[-+*/%&|^]=|[{}()\[\];,<>=+\-*/%&|^!~?:.@`\"'#\\])", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_OPENS, _CLOSES = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")", "]", "}"}


class Tokens:
    """kind, text, line of each token, and its bracket's partner."""

    def __init__(self, text: str) -> None:
        self.kind: list[str] = []
        self.text: list[str] = []
        self.line: list[int] = []
        self.pair: dict[int, int] = {}
        line, at, open_ = 1, 0, []
        while at < len(text):
            if text[at] == "/" and self._operand() and (m := _REGEX.match(text, at)):
                self._add("regex", m[0], line)
                at = m.end()
                continue
            m = _TOKEN.match(text, at)
            if m is None:
                at += 1
                continue
            kind, word = m.lastgroup, m[0]
            at = m.end()
            if kind == "space":
                line += word.count("\n")
            elif word == "`" or (word == "}" and open_ and self.text[open_[-1]] == "${"):
                if word == "}":
                    self._close(open_, word, line)
                else:
                    self._add("p", word, line)
                at, line = self._template(text, at, line, open_)
            else:
                self._add("word" if kind == "id" and word in _WORDS else kind, word, line)
                line += word.count("\n")
                if word in _OPENS:
                    open_.append(len(self.text) - 1)
                elif word in _CLOSES:
                    self.text.pop(), self.kind.pop(), self.line.pop()
                    self._close(open_, word, line)
        for i in open_:
            self.pair[i] = len(self.text)

    def _add(self, kind: str, text: str, line: int) -> None:
        self.kind.append(kind)
        self.text.append(text)
        self.line.append(line)

    def _close(self, open_: list[int], word: str, line: int) -> None:
        self._add("p", word, line)
        if open_ and _OPENS[self.text[open_[-1]]] == word:
            i = open_.pop()
            self.pair[i], self.pair[len(self.text) - 1] = len(self.text) - 1, i

    def _operand(self) -> bool:
        """Whether a value is due, so that a slash begins a pattern."""
        if not self.text:
            return True
        last = self.text[-1]
        return last not in (")", "]", "}", "`", "this", "super", "null", "true", "false", "undefined") and self.kind[-1] in ("p", "word")

    def _template(self, text: str, at: int, line: int, open_: list[int]) -> tuple[int, int]:
        start = at
        while at < len(text) and text[at] != "`" and not text.startswith("${", at):
            at += 2 if text[at] == "\\" else 1
        if at > start:
            self._add("chars", text[start:at], line)
            line += text.count("\n", start, at)
        if text.startswith("${", at):
            self._add("p", "${", line)
            open_.append(len(self.text) - 1)
            return at + 2, line
        if at < len(text):
            self._add("p", "`", line)
        return at + 1, line

    def __len__(self) -> int:
        return len(self.text)

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.text) and (self.kind[i] == "id" or self.text[i] in _SOFT)

    def after(self, i: int) -> int:
        """Behind the bracket that opens at i, or behind i."""
        return self.pair[i] + 1 if self.text[i] in _OPENS and i in self.pair else i + 1

    def norms(self) -> list[tuple[str, int]]:
        out: list[tuple[str, int]] = []
        for k, t, n in zip(self.kind, self.text, self.line, strict=True):
            if k == "id" or t in _SOFT:
                out.append(("ID", n))
            elif k in ("num", "chars") or t in ("true", "false"):
                out.append(("LIT", n))
            elif k == "str":
                out += [(t[0], n), *([("LIT", n)] if len(t) > 2 else []), (t[0], n)]
            elif k == "regex":
                out += [("/", n), ("LIT", n), ("/", n)]
            else:
                out.append((t, n))
        return out

    def ends(self, i: int) -> bool:
        """Whether a statement may end between i - 1 and i by a line break."""
        if i >= len(self) or self.line[i] == self.line[i - 1]:
            return i >= len(self)
        before = self.kind[i - 1] in ("id", "num", "str", "regex") or self.text[i - 1] in (")", "]", "}", "`", "this", "super", "null", "true", "false", "undefined", "++", "--") or self.text[i - 1] in _SOFT
        return before and (self.kind[i] != "p" or self.text[i] in ("{", "@", "++", "--", "}", "!", "~")) and self.text[i] not in ("instanceof", "in", "of", "as", "satisfies", "extends", "implements", "is")

    def end(self, i: int, stop: int, comma: bool = False) -> int:
        """Where the statement or expression that is under way at i ends."""
        start = i
        while i < stop:
            if self.text[i] == ";" or (self.text[i] in _CLOSES and i not in self.pair) or (comma and self.text[i] == ","):
                return i
            if i > start and self.ends(i):
                return i
            i = self.after(i)
        return stop


def _functions(t: Tokens) -> list[tuple[str, int, int, int, int, int]]:
    """(name, first token, params, body begin, body end, last token) of every function with a body; a body of an expression has no brace."""
    out = []
    types = _type_spans(t)

    def params(i: int) -> int:
        n, some, at = 0, False, i + 1
        while at < t.pair[i]:
            some = True
            n += t.text[at] == ","
            at = t.after(at)
        return n + (some and t.at(t.pair[i] - 1) != ",")

    def body(i: int) -> int | None:
        """The brace behind a parameter list that closes at i, past a return type."""
        i += 1
        if t.at(i) != ":":
            return i if t.at(i) == "{" else None
        i += 1
        if t.at(i) == "{":
            i = t.after(i)
        while i < len(t) and t.text[i] != "{" and t.text[i] not in (";", "}", ")", "=>", "="):
            i = t.after(i)
        return i if t.at(i) == "{" else None

    for i in range(len(t)):
        if any(a <= i < z for a, z in types):
            continue
        word = t.text[i]
        if word == "function" and t.at(i - 1) != ".":
            j = i + 1 + (t.at(i + 1) == "*")
            name = t.text[j] if t.named(j) else "(anonymous)"
            while j < len(t) and t.text[j] not in ("(", "{", ";"):
                j += 1
            if t.at(j) == "(" and j in t.pair and (b := body(t.pair[j])) is not None and b in t.pair:
                first = i - 1 if t.at(i - 1) == "async" else i
                out.append((name, first, params(j), b + 1, t.pair[b], t.pair[b]))
        elif word == "=>":
            j, n = i - 1, 1
            if t.at(j) != ")" and not (t.named(j) and t.at(j - 1) not in (":", "|", "&", "is", ".", "<")):
                # past a return type
                while j > 0 and not (t.text[j] == ":" and t.at(j - 1) == ")") and t.text[j] not in (";", "{", "="):
                    j = t.pair[j] - 1 if t.text[j] in _CLOSES and j in t.pair else j - 1
                j -= 1
            if t.at(j) == ")" and j in t.pair:
                j = t.pair[j]
                n = params(j)
            elif not t.named(j):
                continue
            if t.at(j - 1) == ":" and _around(t, j) in ("(", "<"):
                continue  # a type
            first = j - 1 if t.at(j - 1) == "async" else j
            if t.at(i + 1) == "{" and i + 1 in t.pair:
                out.append(("(anonymous)", first, n, i + 2, t.pair[i + 1], t.pair[i + 1]))
            else:
                stop = t.end(i + 1, len(t), True)
                out.append(("(anonymous)", first, n, i + 1, stop, stop - 1))
        elif word == "(" and i in t.pair and i and (t.kind[i - 1] == "id" or t.text[i - 1] in _SOFT or t.text[i - 1] in ("delete", "default", "catch", "]")) and (b := body(t.pair[i])) is not None and b in t.pair:
            before = t.at(i - 2)
            if t.text[i - 1] == "catch" or before in ("function", "*") and t.at(i - 3) == "function" or before == "function":
                continue
            if before in ("{", "}", ";", ",", "async", "static", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "*") or t.line[i - 1] != t.line[i - 2]:
                first = i - 1
                while t.at(first - 1) in ("async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "*"):
                    first -= 1
                out.append((t.text[i - 1], first, params(i), b + 1, t.pair[b], t.pair[b]))
    return out


def _around(t: Tokens, i: int) -> str:
    """The bracket that is open at i."""
    i -= 1
    while i >= 0:
        if t.text[i] in _OPENS and t.pair.get(i, -1) != i:
            return t.text[i]
        i = t.pair[i] - 1 if t.text[i] in _CLOSES and i in t.pair else i - 1
    return ""


def _type_spans(t: Tokens) -> list[tuple[int, int]]:
    out = []
    for i in range(len(t)):
        if t.text[i] == "interface" and t.named(i + 1) and t.at(i - 1) != ".":
            j = i
            while j < len(t) and t.text[j] != "{":
                j += 1
            out.append((i, t.after(j) if j < len(t) else j))
        elif t.text[i] == "type" and t.named(i + 1) and t.at(i + 2) in ("=", "<") and t.at(i - 1) != ".":
            out.append((i, t.end(i, len(t))))
    return out


def _control(t: Tokens, lo: int, hi: int, own: dict[int, int]) -> list[tuple[str, int, bool]]:
    """(category, depth, nests) of a body's own control flow; own: the functions inside, which are left out."""
    out: list[tuple[str, int, bool]] = []

    def expression(a: int, z: int, depth: int) -> None:
        # one part between commas at a time
        i = a
        while i < z:
            j = i
            question = None
            while j < z and t.text[j] not in (",", ";"):
                if question is None and t.text[j] == "?" and t.at(j + 1) not in (":", ")", ",", "="):
                    question = j
                j = own[j] if j in own else t.after(j)
            j = min(j, z)
            if question is not None:
                out.append(("ternary", depth, True))
                expression_part(i, question, depth + 1)
                expression(question + 1, j, depth + 1)
            else:
                expression_part(i, j, depth)
            i = j + 1

    def expression_part(a: int, z: int, depth: int) -> None:
        i = a
        while i < z:
            if i in own:
                i = own[i]
                continue
            if t.text[i] in ("&&", "||", "??"):
                out.append(("boolean", depth, False))
            if t.text[i] in _OPENS and i in t.pair:
                expression(i + 1, min(t.pair[i], z), depth)
            i = t.after(i)

    def condition(i: int, depth: int) -> int:
        while i < hi and t.text[i] != "(":
            i += 1
        if i < hi and i in t.pair:
            expression(i + 1, t.pair[i], depth)
            return t.pair[i] + 1
        return i

    def statement(i: int, depth: int) -> int:
        word = t.at(i)
        if i in own and word in ("function", "async"):
            return own[i]
        if word == "{" and i in t.pair:
            statements(i + 1, t.pair[i], depth)
            return t.pair[i] + 1
        if word == "if":
            out.append(("branch", depth, True))
            i = statement(condition(i, depth + 1), depth + 1)
            i += t.at(i) == ";"
            return statement(i + 1, depth + 1) if t.at(i) == "else" else i
        if word in ("for", "while"):
            out.append(("loop", depth, True))
            return statement(condition(i, depth + 1), depth + 1)
        if word == "do":
            out.append(("loop", depth, True))
            i = statement(i + 1, depth + 1)
            i += t.at(i) == ";"
            return condition(i, depth + 1) if t.at(i) == "while" else i
        if word == "switch":
            i = condition(i, depth)
            if t.at(i) != "{" or i not in t.pair:
                return i
            stop, i = t.pair[i], i + 1
            inner = depth
            while i < stop:
                if t.text[i] in ("case", "default"):
                    inner = depth
                    j = i + 1
                    while j < stop and t.text[j] != ":":
                        j = t.after(j)
                    if t.text[i] == "case":
                        out.append(("case", depth, True))
                        inner = depth + 1
                        expression(i + 1, j, inner)
                    i = j + 1
                else:
                    i = max(statement(i, inner), i + 1)
            return stop + 1
        if word == "try":
            return statement(i + 1, depth)
        if word == "finally":
            return statement(i + 1, depth)
        if word == "catch":
            out.append(("catch", depth, True))
            return statement(t.after(i + 1) if t.at(i + 1) == "(" else i + 1, depth + 1)
        z = t.end(i, hi)
        expression(i, z, depth)
        return max(z, i) + (t.at(z) == ";")

    def statements(i: int, z: int, depth: int) -> None:
        while i < z:
            i = max(statement(i, depth), i + 1) if t.text[i] != ";" else i + 1

    braced = t.at(lo - 1) == "{"
    if braced:
        statements(lo, hi, 0)
    else:
        expression(lo, hi, 0)
    return out


def _clause(t: Tokens, i: int) -> list[tuple[str, str]]:
    """(name, alias) of a list in braces that opens at i."""
    out, j = [], i + 1
    while j < t.pair.get(i, len(t)):
        if t.at(j) == "type" and (t.named(j + 1) or t.at(j + 1) == "default") and t.at(j + 1) != "as":
            j += 1
        name = t.at(j).strip("'\"")
        alias = name
        if t.at(j + 1) == "as":
            alias, j = t.at(j + 2).strip("'\""), j + 2
        out.append((name, alias))
        while j < t.pair.get(i, len(t)) and t.text[j] != ",":
            j += 1
        j += 1
    return out


def lower(file: str, text: str) -> dict:
    """All relations of one file."""
    t = Tokens(text)
    row: dict = {"file": file, "ok": True, "main_guard": False, "star_import": False, "symbols": [], "units": [], "tokens": [], "imports": [], "uses": [], "exports": [], "variables": [], "calls": []}
    found: list[tuple[str, int, int, int, bool]] = []  # name, its token, first token, end, exported
    variables: list[tuple[str, int, int | None, int]] = []
    skip: list[tuple[int, int]] = []

    def module(i: int) -> str | None:
        return t.text[i][1:-1] if i < len(t) and t.kind[i] == "str" else None

    def add(kind: str, line: int, spec: str, name: str | None, alias: str | None) -> None:
        row["imports"].append({"kind": kind, "line": line, "module": spec, "level": 0, "name": name, "alias": alias})

    def give(kind: str, spec: str | None, name: str | None, alias: str | None) -> None:
        row["exports"].append({"kind": kind, "module": spec, "name": name, "alias": alias})

    def declaration(i: int, first: int, exported: bool, default: bool) -> int:
        j = i
        while t.at(j) in ("declare", "abstract", "async") and (t.kind[j + 1 : j + 2] or ["p"])[0] in ("word", "id"):
            j += 1
        if t.at(j) == "const" and t.at(j + 1) == "enum":
            j += 1
        word = t.at(j)
        if word == "function" or (word in ("class", "interface", "enum", "namespace") and (t.named(j + 1) or default)):
            k = j + 1 + (t.at(j + 1) == "*")
            name = t.text[k] if t.named(k) else None
            z = k
            while z < len(t) and t.text[z] not in ("{", ";") and not (word == "function" and z > k and t.ends(z) and t.text[z - 1] == ")"):
                z = t.after(z) if t.text[z] in ("(", "[") else z + 1
                if word == "function" and t.at(z) == ":" and t.at(z + 1) == "{":
                    z = t.after(z + 1)
            z = t.after(z) if z < len(t) else z
            if name and word != "namespace":
                found.append((name, k, first, z, exported))
                if default:
                    give("local", None, name, "default")
            return z
        if word == "type" and t.named(j + 1) and t.at(j + 2) in ("=", "<"):
            z = t.end(j, len(t))
            found.append((t.text[j + 1], j + 1, first, z, exported))
            return z
        if word in ("const", "let", "var") and (t.named(j + 1) or t.at(j + 1) in ("{", "[")):
            z, k = j + 1, j + 1
            while True:
                z = t.end(k, len(t), True)
                if t.named(k):
                    found.append((t.text[k], k, k, z, exported))
                    begins = next((x for x in range(k, min(z, len(t))) if t.text[x] == "="), None)
                    variables.append((t.text[k], k, None if begins is None else begins + 1, z))
                if t.at(z) != ",":
                    return z
                k = z + 1
        return t.end(i, len(t)) if not default else i

    i = 0
    while i < len(t):
        word, line = t.text[i], t.line[i]
        if word == "import" and t.at(i + 1) not in ("(", "."):
            z = t.end(i, len(t))
            spec = next((s for k in range(z - 1, i, -1) if (s := module(k)) is not None), None)
            if spec is not None:
                skip.append((i, z))
                j = i + 1 + (t.at(i + 1) == "type" and t.at(i + 2) != "from")
                if module(j) is not None:
                    add("effect", line, spec, None, None)
                if t.named(j) and t.at(j) != "from":
                    add("import" if t.at(j + 1) == "=" else "from", line, spec, None if t.at(j + 1) == "=" else "default", t.text[j])
                    j += 1 + (t.at(j + 1) == ",")
                if t.at(j) == "*":
                    add("import", line, spec, None, t.at(j + 2))
                elif t.at(j) == "{":
                    for name, alias in _clause(t, j):
                        add("from", line, spec, name, alias)
            i = z + 1 if t.at(z) == ";" else max(z, i + 1)
            continue
        if word == "export":
            j = i + 1 + (t.at(i + 1) == "type" and t.at(i + 2) in ("{", "*"))
            if t.at(j) in ("*", "{"):
                z = t.end(i, len(t))
                spec = module(z - 1)
                if spec is not None:
                    skip.append((i, z))
                if t.at(j) == "*":
                    give("star" if t.at(j + 1) != "as" else "whole", spec, None, t.at(j + 2) if t.at(j + 1) == "as" else None)
                else:
                    for name, alias in _clause(t, j):
                        give("from" if spec is not None else "local", spec, name, alias)
                i = z + (t.at(z) == ";")
                continue
            if t.at(j) == "default":
                if t.named(j + 1) and t.at(j + 2) in (";", "") or t.named(j + 1) and t.at(j + 1) not in ("async", "abstract") and t.ends(j + 2):
                    give("local", None, t.text[j + 1], "default")
                z = declaration(j + 1, i, True, True)
                i = max(z, j + 1) if z > j + 1 else max(t.end(j + 1, len(t)), j + 1)
            else:
                i = max(declaration(j, i, True, False), j)
        else:
            i = max(declaration(i, i, False, False), i + 1)
        i += t.at(i) == ";"
    given = {x["name"] for x in row["exports"] if x["kind"] == "local"}
    for name, k, _, z, exported in found:
        last = min(z, len(t)) - 1
        row["symbols"].append({"name": name, "line": t.line[k], "end_line": t.line[max(last, k)], "exported": exported or name in given})
    own_names = {k for _, k, _, _, _ in found}
    spans = [(a, z, f"{t.line[k]}:{name}") for name, k, a, z, _ in found]
    hidden = [False] * len(t)
    for a, z in skip:
        hidden[a:z] = [True] * (min(z, len(t)) - a)
    owner: list[str | None] = [None] * len(t)
    for a, z, o in spans:
        owner[a:z] = [o] * (min(z, len(t)) - a)
    for k in range(len(t)):
        if hidden[k] or k in own_names or not t.named(k) or t.at(k - 1) in (".", "?."):
            continue
        if t.at(k + 1) == ":" and t.at(k - 1) in ("{", ",") and _around(t, k) == "{":
            continue
        use = {"name": t.text[k], "attr": None, "line": t.line[k], "owner": owner[k]}
        row["uses"].append(use)
        if t.at(k + 1) in (".", "?.") and k + 2 < len(t) and t.kind[k + 2] in ("id", "word"):
            row["uses"].append({**use, "attr": t.text[k + 2]})
    functions = _functions(t)
    own = {f[1]: f[5] + 1 for f in functions}
    for name, first, n, lo, hi, last in functions:
        inner = {a: z for a, z in own.items() if lo <= a and z <= last + 1 and a != first}
        row["units"].append({"name": name, "line": t.line[first], "loc": t.line[min(last, len(t) - 1)] - t.line[first] + 1, "params": n, "control": [{"category": c, "depth": d, "nests": x} for c, d, x in _control(t, lo, hi, inner)]})
    for name, k, begins, z in variables:
        whole = begins is not None and own.get(begins) == z
        row["variables"].append({"name": name, "line": t.line[k], "initializer": "none" if begins is None else "function" if whole else "expression"})
        at = z if begins is None or whole else begins
        while at < min(z, len(t)):
            if t.text[at] == "new":  # nothing inside counts
                at += 1
                while at < z and t.text[at] != "(" and (t.named(at) or t.text[at] in (".", "<", ">", ",")):
                    at += 1
                at = t.after(at) if at < z else at
                continue
            if t.named(at) and t.at(at - 1) not in (".", "?."):
                far = at + 2 if t.at(at + 1) in (".", "?.") else at
                if t.at(far + 1) == "(":
                    depth = sum(begins <= a <= at < b for a, b in own.items())
                    row["calls"].append({"name": name, "line": t.line[k], "callee": t.text[at], "member": t.text[far] if far > at else None, "depth": depth, "constructed": False})
            at += 1
    inside: dict[int, int] = {}
    for k in sorted(range(len(row["units"])), key=lambda k: (-row["units"][k]["loc"], -k)):
        u = row["units"][k]
        inside.update(dict.fromkeys(range(u["line"], u["line"] + u["loc"]), k))
    row["tokens"] = [{"norm": n, "line": x, "unit": inside.get(x, -1)} for n, x in t.norms()]
    return row


def lowered(files: DataFrame) -> DataFrame:
    """file, text to all relations, nested, in one pass."""
    names = [c.split()[0] for c in SCRIPT.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([lower(x, t or "") for x, t in zip(f["file"], f["text"], strict=True)], columns=names)

    return files.select("file", "text").mapInPandas(run, SCRIPT)


_ENDS = ["", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
_BUILT = {".js": (".ts", ".tsx"), ".jsx": (".tsx", ".ts"), ".mjs": (".mts",), ".cjs": (".cts",)}


def candidates(file: str, module: str) -> list[str]:
    """Files that a relative module may be, in order; none for others."""
    if not module.startswith("."):
        return []
    path = posixpath.normpath(posixpath.join(posixpath.dirname(file), module)).lstrip("/")
    if path.startswith(".."):
        return []
    stem, ext = posixpath.splitext(path)
    return list(dict.fromkeys([stem + e for e in _BUILT.get(ext, ())] + [("" if path == "." else path) + e if path != "." else e.lstrip("/") for e in _ENDS]))


def targets(ir: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """file, module, target of the modules that are here; packages(name, file) are those of a workspace."""
    asked = ir.select("file", F.explode(F.array_union("imports.module", "exports.module")).alias("module")).where("module IS NOT NULL").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(a, m, c, i) for a, m in zip(f["file"], f["module"], strict=True) for i, c in enumerate(candidates(a, m))]
            yield pd.DataFrame(rows, columns=["asker", "module", "file", "place"])

    met = first_existing(asked.mapInPandas(run, "asker string, module string, file string, place int"), ir.select("file"), ["asker", "module"])
    met = met.select(F.col("asker").alias("file"), "module", F.col("file").alias("target"))
    if packages is None:
        return met
    named = asked.join(packages.select(F.col("name").alias("module"), F.col("file").alias("target")), "module").select("file", "module", "target")
    return met.unionByName(named)


def _key(file: str, name, given: bool = False):
    """A name in a file, or the one that it gives on."""
    return F.concat_ws("\0", file, F.concat(F.lit(">" if given else ""), name))


class Names:
    """Where the names of script files lead: links between names, and what files give on, star exports included. Built once for both uses."""

    def __init__(self, ir: DataFrame, nodes: DataFrame, packages: DataFrame | None = None) -> None:
        self.ir = ir
        at = staged(targets(ir, packages), "targets")
        last = nodes.groupBy("file", "name").agg(F.max_by("id", "line").alias("id"))
        self.declared = last.select(_key("file", F.col("name")).alias("key"), "id")
        self.imports = ir.select("file", F.explode("imports").alias("i")).select("file", "i.*").join(at, ["file", "module"])
        exports = ir.select("file", F.explode("exports").alias("x")).select("file", "x.*")
        onward = exports.join(at, ["file", "module"])
        own = nodes.where("exported").select("file", F.col("name").alias("alias"), F.col("name")).unionByName(exports.where("kind = 'local'").select("file", "alias", "name")).distinct()
        passed = onward.where("kind = 'from'")
        links = self.imports.where("kind = 'from'").select(_key("file", F.col("alias")).alias("src"), _key("target", F.col("name"), True).alias("dst"))
        links = links.unionByName(own.select(_key("file", F.col("alias"), True).alias("src"), _key("file", F.col("name")).alias("dst")))
        links = links.unionByName(passed.select(_key("file", F.col("alias"), True).alias("src"), _key("target", F.col("name"), True).alias("dst")))
        star = staged(onward.where("kind = 'star'").select("file", "target").distinct(), "stars")
        front = staged(own.select("file", "alias").unionByName(passed.select("file", "alias")).distinct(), "given")
        self.given = front
        while not star.isEmpty() and not front.isEmpty():
            more = star.join(front.select(F.col("file").alias("target"), "alias"), "target").where("alias <> 'default'").groupBy("file", "alias").agg(F.min("target").alias("target"))
            more = staged(more.join(self.given, ["file", "alias"], "left_anti"), "given")
            links = links.unionByName(more.select(_key("file", F.col("alias"), True).alias("src"), _key("target", F.col("alias"), True).alias("dst")))
            front = more.select("file", "alias")
            self.given = self.given.unionByName(front)
        self.links = staged(links.distinct(), "links")

    def ends(self, starts: DataFrame) -> DataFrame:
        """start, dst: the declaration that each start(start) leads to."""
        found = chase(self.links, self.declared.select(F.col("key").alias("id")), starts.select(F.col("start").alias("id")).distinct()).where("target IS NOT NULL")
        return found.join(self.declared, F.col("target") == F.col("key")).select("start", F.col("id").alias("dst"))

    def references(self) -> DataFrame:
        """src, dst, file: every use of a declared symbol by name, from the declaration around it or else its file; and imports for their effect alone, from file to file."""
        uses = self.ir.select("file", F.explode("uses").alias("u")).select("file", "u.name", "u.attr", F.concat_ws(":", "file", "u.owner").alias("src"))
        bare = uses.where("attr IS NULL").select("src", "file", _key("file", F.col("name")).alias("start"))
        whole = self.imports.where("kind = 'import'").select(F.col("file").alias("bf"), F.col("alias").alias("local"), "target")
        through = uses.where("attr IS NOT NULL").join(whole, (F.col("file") == F.col("bf")) & (F.col("name") == F.col("local"))).select("src", "file", _key("target", F.col("attr"), True).alias("start"))
        sites = staged(bare.unionByName(through).distinct(), "uses")
        refs = sites.join(self.ends(sites), "start").select("src", "dst", "file").where("src <> dst")
        return refs.unionByName(self.imports.where("kind = 'effect'").select(F.col("file").alias("src"), F.col("target").alias("dst"), "file"))

    def public(self, entries: DataFrame) -> DataFrame:
        """id of the declarations that entries(file) give on, under whatever name."""
        starts = self.given.join(entries.select("file").distinct(), "file", "left_semi").select(_key("file", F.col("alias"), True).alias("start"))
        return self.ends(starts).select(F.col("dst").alias("id")).distinct()


def effects(ir: DataFrame) -> DataFrame:
    """id, effect of every variable's initializer; other symbols have none here."""
    def symbol(x: str):
        return F.concat_ws(":", "file", f"{x}.line", f"{x}.name").alias("id")

    declared = ir.select("file", F.explode("variables").alias("v")).select(symbol("v"), "file", F.lit("variable").alias("kind"), "v.initializer").dropDuplicates(["id"])
    calls = ir.select("file", F.explode("calls").alias("c")).select(symbol("c"), "c.callee", "c.member", "c.depth", "c.constructed")
    imports = ir.select("file", F.explode("imports").alias("i")).where("i.kind <> 'effect'").select("file", F.col("i.alias").alias("local"), "i.module", F.when((F.col("i.kind") == "from") & (F.col("i.name") != "default"), F.col("i.name")).otherwise("*").alias("name"))
    return initializer_effects(declared, calls, imports)
