"""Small expressions used across analytics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crap(complexity: Column, coverage: Column) -> Column:
    """complexity squared, times the uncovered share cubed, plus complexity; null without coverage."""
    c, bare = complexity.cast("double"), 1 - coverage
    return c * c * (bare * bare * bare) + c


def risk(complexity: Column, crap_score: Column, churn: Column) -> Column:
    return F.coalesce(crap_score, complexity.cast("double")) * F.coalesce(churn, F.lit(1))


def half_up(x: Column, digits: int = 1) -> Column:
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_python(path: Column) -> Column:
    return path.endswith(".py")


def exported_python(name: Column, declared: Column) -> Column:
    """No leading underscore, or in the module's declared list, or a dunder, or a test."""
    return ~name.startswith("_") | F.coalesce(F.array_contains(declared, name), F.lit(False)) | (name.rlike(r"^__[A-Za-z0-9_]+__$")) | name.startswith("test_")


_DYNAMIC = [r"\beval\s*\(", r"\[\s*[A-Za-z_$][A-Za-z0-9_$]*\s*\]\s*\("]
_DYNAMIC_PYTHON = [r"\bgetattr\s*\(", r"\bimportlib\b", r"__getattr__", r"\bexec\s*\("]
_DYNAMIC_SCRIPT = [r"import\s*\(\s*`[^`]*\$\{", r"import\s*\(\s*[A-Za-z_$]"]


def tainted(text: Column, python: Column) -> Column:
    """Whether the text, comments included, has access that no static graph resolves: evaluation, computed calls, dynamic imports or attributes."""
    return text.rlike("|".join(_DYNAMIC)) | F.when(python, text.rlike("|".join(_DYNAMIC_PYTHON))).otherwise(text.rlike("|".join(_DYNAMIC_SCRIPT)))


def normalised(word: Column) -> Column:
    """A word of plain text as clone detection sees it: numbers LIT, names ID, both where they are part of something else."""
    mixed = F.regexp_replace(F.regexp_replace(word, "[0-9]+", "LIT"), "[A-Za-z_]+", "ID")
    return F.when(word.rlike("^[0-9]+$"), "LIT").when(word.rlike("^[A-Za-z_][A-Za-z_0-9]*$"), "ID").otherwise(mixed)


MOST_LINES = 200


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last, each behind its number and a tab; inside the text, and at most 200 of them."""
    lines = F.split(text, "\n")
    a = F.least(F.greatest(first, F.lit(1)), F.size(lines))
    b = F.least(F.greatest(last, a), F.size(lines), a + MOST_LINES - 1)
    return F.array_join(F.transform(F.slice(lines, a, b - a + 1), lambda x, i: F.concat((a + i).cast("string"), F.lit("\t"), x)), "\n")


def snippet(text: Column, line: Column, radius: int) -> Column:
    """Around a declaration: radius lines above, and below to the end of its brace block if one opens within 200 lines, else radius lines."""
    lines = F.split(text, "\n")
    decl = F.least(F.greatest(line, F.lit(1)), F.size(lines))

    def step(a, x):
        opened, closed = F.regexp_count(x, F.lit("[{]")), F.regexp_count(x, F.lit("[}]"))
        open_ = a["opened"] | (opened > 0)
        depth = a["depth"] + opened - closed
        seen = a["seen"] + F.when(a["end"] < 0, 1).otherwise(0)
        return F.struct(open_.alias("opened"), depth.alias("depth"), seen.alias("seen"), F.when((a["end"] < 0) & open_ & (depth <= 0), a["seen"]).otherwise(a["end"]).alias("end"))

    start = F.struct(F.lit(False).alias("opened"), F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(-1).alias("end"))
    below = F.aggregate(F.slice(lines, decl, F.lit(MOST_LINES)), start, step, lambda a: F.when(a["end"] >= 0, a["end"]).otherwise(radius))
    a = F.greatest(decl - radius, F.lit(1))
    b = F.least(decl + below, F.size(lines))
    return F.array_join(F.transform(F.slice(lines, a, b - a + 1), lambda x, i: F.concat((a + i).cast("string"), F.lit("\t"), x)), "\n")


def splice(text: Column, first: Column, last: Column, replacement: Column) -> Column:
    """text with its lines first..last (from 1) replaced."""
    lines = F.split(text, "\n")
    return F.array_join(F.concat(F.slice(lines, F.lit(1), first - 1), F.array(replacement), F.slice(lines, last + 1, F.greatest(F.size(lines) - last, F.lit(0)))), "\n")


def import_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("import ") & ~x.startswith("import("))


def verdict(reply: Column) -> Column:
    """The verdict of a model's JSON reply; anything else is unsure."""
    said = F.get_json_object(reply, "$.verdict")
    return F.when(said.isin("likely-dead", "likely-alive", "unsure"), said).otherwise("unsure")
