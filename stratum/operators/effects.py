"""Whether removing a variable may lose an effect: does its initializer call something that is known to do input or output?

declarations(id, file, kind, initializer): kind variable or other; initializer none, function or expression. calls(id, callee, member, depth, constructed): the calls in an initializer; callee is the name called, or the object whose member is; depth counts functions around the call within the initializer; constructed if inside a `new` expression. imports(file, local, module, name): name is the imported one, * for a whole module. denied(module, name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DISK = "readFileSync readFile writeFileSync writeFile appendFileSync appendFile unlinkSync unlink mkdirSync mkdir rmSync rm rmdirSync rmdir renameSync rename copyFileSync copyFile".split()
_PROCESSES = "execSync exec execFileSync execFile spawnSync spawn fork".split()
DENIED = [(m, n) for m in ("fs", "node:fs", "fs/promises", "node:fs/promises") for n in _DISK] + [(m, n) for m in ("child_process", "node:child_process") for n in _PROCESSES]


def initializer_effects(declarations: DataFrame, calls: DataFrame, imports: DataFrame, denied: DataFrame | None = None) -> DataFrame:
    """id, effect: unknown unless it is a variable's; pure without an initializer or if that is a function that nobody calls; effectful if a call in it, at most one function deep and in no `new`, is of a denied name by its import; else pure."""
    known = F.broadcast(declarations.sparkSession.createDataFrame(DENIED, "module string, name string"))  # a constant
    bound = imports.select(F.col("file").alias("bf"), F.col("local"), "module", F.col("name").alias("imported"))
    seen = calls.where("depth <= 1 AND NOT constructed").join(declarations.select("id", "file"), "id")
    meant = seen.join(bound, (F.col("file") == F.col("bf")) & (F.col("callee") == F.col("local"))).select("id", "module", F.coalesce("member", "imported").alias("name"))
    bad = meant.join(known if denied is None else denied.distinct(), ["module", "name"], "left_semi").select("id").distinct().withColumn("bad", F.lit(True))
    effect = F.when(F.col("kind") != "variable", "unknown").when(F.col("initializer") != "expression", "pure").when(F.col("bad"), "effectful").otherwise("pure")
    return declarations.join(bad, "id", "left").select("id", effect.alias("effect"))
