"""Entry points as relations: where production and tests begin, and what is public.

records(file, source, symbol): a file that some mechanism found, and the symbol that it named, if any. files(file, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reach import closure

#: Mechanisms, the first of which names an entry's source.
SOURCES = ["manifest", "mapped", "convention", "scripts", "config", "pyproject-scripts", "setup-config", "dunder-main", "plugin", "workspace"]


def first_existing(candidates: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """key, file, place: for each key the first candidate(key..., file, place) that exists."""
    there = candidates.join(files.select("file").distinct(), "file", "left_semi")
    return there.groupBy(*key).agg(F.min_by("file", "place").alias("file"), F.min("place").alias("place"))


def first_source(records: DataFrame, priority: str = "priority") -> DataFrame:
    """file, source: every entry once, by the mechanism of least priority."""
    return records.groupBy("file").agg(F.min_by("source", priority).alias("source"))


def ranked(records: DataFrame) -> DataFrame:
    """records with `priority`, their source's place in SOURCES."""
    return records.withColumn("priority", F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")))


def collapsed(entries: DataFrame, nodes: DataFrame) -> bool:
    """No entry was found though there are symbols: nothing can be told dead."""
    return entries.isEmpty() and not nodes.isEmpty()


def module_specs(specs: DataFrame, modules: DataFrame, declared: DataFrame) -> DataFrame:
    """specs(spec, ...) of the form module or module:function, with file (null if the module isn't here) and symbol (null if it names none, or one that isn't declared). modules(file, module), declared(file, name, id)."""
    m = modules.groupBy("module").agg(F.max("file").alias("file"))
    parts = specs.withColumn("module", F.element_at(F.split("spec", ":"), 1)).withColumn("name", F.try_element_at(F.split("spec", ":"), F.lit(2)))
    found = parts.join(m, "module", "left")
    d = declared.select(F.col("file").alias("df"), F.col("name").alias("dn"), F.col("id").alias("symbol"))
    return found.join(d, (F.col("file") == F.col("df")) & (F.col("name") == F.col("dn")), "left").select(*specs.columns, "file", "symbol")


def exported_seeds(nodes: DataFrame, files: DataFrame, color: str) -> DataFrame:
    """id, color of what files that are invoked by convention export."""
    return nodes.where("exported").join(files.select("file").distinct(), "file", "left_semi").select("id", F.lit(color).alias("color"))


def file_seeds(files: DataFrame, color: str) -> DataFrame:
    return files.select(F.col("file").alias("id"), F.lit(color).alias("color")).distinct()


def public_symbols(nodes: DataFrame, links: DataFrame, entries: DataFrame) -> DataFrame:
    """id of exported symbols in files that the entries' files give on, through links(src, dst) of re-exporting files."""
    given = closure(links, entries.select(F.col("file").alias("id"))).select(F.col("id").alias("file"))
    return nodes.where("exported").join(given, "file", "left_semi").select("id")
