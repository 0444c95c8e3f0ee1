"""Queries over texts, lines and words: operators over the surrogate relations, beside SQL that does without them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import line_range, normalised, snippet, splice, tainted
from ..operators import clones, score
from .catalog import built, run_sql


def line_splice(spark, sf_dir):
    return run_sql(spark, sf_dir, "SELECT doc_id, text FROM documents").select("doc_id", splice(F.col("text"), F.lit(2), F.lit(3), F.lit("<replaced>")).alias("text"))


built("line_splice", line_splice, "SELECT doc_id, array_to_string(list_concat(l[1:1], ['<replaced>'], l[4:]), chr(10)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) t")


def snippet_range(spark, sf_dir):
    return run_sql(spark, sf_dir, "SELECT doc_id, text FROM documents").select("doc_id", line_range(F.col("text"), F.lit(2), F.lit(400)).alias("numbered"))


built("snippet_range", snippet_range, "WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), r AS (SELECT *, least(2, len(l)) AS a FROM t) SELECT doc_id, array_to_string(list_transform(range(a, least(400, len(l), a + 199) + 1), lambda i: concat(i, chr(9), l[i])), chr(10)) AS numbered FROM r")

# Prose has no braces, so some of its endings become some.
_BRACED = "replace(replace(text, 'e.', '{'), 'n.', '}')"


def snippet_window(spark, sf_dir):
    texts = run_sql(spark, sf_dir, f"SELECT doc_id, {_BRACED} AS text FROM documents")
    return texts.select("doc_id", snippet(F.col("text"), (F.col("doc_id") % 7 + 1).cast("int"), 3).alias("snippet"))


built(
    "snippet_window",
    snippet_window,
    f"WITH t AS (SELECT doc_id, string_split({_BRACED}, chr(10)) AS l FROM documents), d AS (SELECT *, least(doc_id % 7 + 1, len(l)) AS decl FROM t), x AS (SELECT doc_id, l, unnest(range(decl, least(decl + 199, len(l)) + 1)) AS i FROM d), y AS (SELECT doc_id, i, len(l[i]) - len(replace(l[i], '{{', '')) AS o, len(l[i]) - len(replace(l[i], '}}', '')) AS c FROM x), z AS (SELECT doc_id, i, sum(o) OVER w AS opened, sum(o - c) OVER w AS depth FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY i)), e AS (SELECT doc_id, min(i) AS fin FROM z WHERE opened > 0 AND depth <= 0 GROUP BY doc_id) SELECT d.doc_id, array_to_string(list_transform(range(greatest(decl - 3, 1), least(coalesce(fin, decl + 3), len(l)) + 1), lambda i: concat(i, chr(9), l[i])), chr(10)) AS snippet FROM d LEFT JOIN e ON e.doc_id = d.doc_id",
)

_PLANTED = {0: " eval (x)", 1: " h[ k ] (1)", 2: " getattr(o", 3: " importlib", 4: " exec(", 5: " import(`./${n", 6: " import(name", 7: " __getattr__"}
_DYNAMIC = "concat(text, CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _PLANTED.items()) + " ELSE ' retrieval(x) h[1](2)' END)"


def taint_scan(spark, sf_dir):
    """Every second document counts as Python."""
    texts = run_sql(spark, sf_dir, f"SELECT doc_id, {_DYNAMIC} AS text FROM documents")
    return texts.select("doc_id", tainted(F.col("text"), F.col("doc_id") % 2 == 0).alias("tainted"))


built("taint_scan", taint_scan, "SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE doc_id % 9 < 2 OR (doc_id % 2 = 0 AND doc_id % 9 IN (2, 3, 4, 7)) OR (doc_id % 2 = 1 AND doc_id % 9 IN (5, 6)) END AS tainted FROM documents")


def ignore_antijoin(spark, sf_dir):
    findings = run_sql(spark, sf_dir, "SELECT doc_id AS file, pos AS line FROM lines")
    texts = run_sql(spark, sf_dir, "SELECT doc_id AS file, text FROM documents")
    return score.suppress_marked(findings, texts, "icense").select(F.col("file").alias("doc_id"), F.col("line").alias("pos"))


built("ignore_antijoin", ignore_antijoin, "WITH m AS (SELECT doc_id, pos, line, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS above FROM lines) SELECT doc_id, pos FROM m WHERE NOT contains(line, 'icense') AND NOT coalesce(contains(above, 'icense'), false)")
built("token_normalize", lambda s, d: run_sql(s, d, "SELECT doc_id, pos, word FROM words").select("doc_id", "pos", normalised(F.col("word")).alias("norm")), "SELECT doc_id, pos, CASE WHEN regexp_like(word, '^[0-9]+$') THEN 'LIT' WHEN regexp_like(word, '^[A-Za-z_][A-Za-z_0-9]*$') THEN 'ID' ELSE regexp_replace(regexp_replace(word, '[0-9]+', 'LIT', 'g'), '[A-Za-z_]+', 'ID', 'g') END AS norm FROM words")

_GRAM = 20


def streams(spark, sf_dir):
    """Documents as token streams of one unit."""
    words = "filter(split(text, '[ \\t\\n\\r]+'), x -> x <> '')"
    return run_sql(spark, sf_dir, f"SELECT doc_id AS file, {words} AS norms, transform({words}, x -> 0) AS units FROM documents WHERE text IS NOT NULL")


def line_streams(spark, sf_dir):
    """The same with a unit a line."""
    rows = run_sql(spark, sf_dir, "SELECT doc_id AS file, transform(split(text, '\\n'), l -> filter(split(l, '[ \\t\\r]+'), x -> x <> '')) AS w FROM documents WHERE text IS NOT NULL")
    return rows.select("file", F.flatten("w").alias("norms"), F.flatten(F.transform("w", lambda w, i: F.transform(w, lambda x: i))).alias("units"))


built(
    "kgram_groups",
    lambda s, d: clones.gram_groups(streams(s, d), _GRAM).select("gram", "n"),
    f"SELECT md5(gram) AS gram, CAST(count(*) AS BIGINT) AS n FROM (SELECT string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {_GRAM - 1} FOLLOWING) AS gram, count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {_GRAM - 1} FOLLOWING) AS k FROM words) t WHERE k = {_GRAM} GROUP BY gram HAVING count(*) > 1",
)
_LINES = "lw AS (SELECT doc_id, pos AS unit, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS idx, unnest(w) AS word FROM (SELECT doc_id, pos, list_filter(regexp_split_to_array(line, '[ \\t\\r]+'), lambda x: x <> '') AS w FROM lines) t)"
built(
    "clone_candidates",
    lambda s, d: clones.gram_groups(line_streams(s, d), 10).select("gram", "n", F.col("first_file").alias("first_doc")),
    f"WITH {_LINES} SELECT md5(gram) AS gram, CAST(count(*) AS BIGINT) AS n, CAST(min(doc_id) AS BIGINT) AS first_doc FROM (SELECT doc_id, string_agg(word, ' ') OVER w AS gram, count(*) OVER w AS k FROM lw WINDOW w AS (PARTITION BY doc_id, unit ORDER BY idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) t WHERE k = 10 GROUP BY gram HAVING count(*) > 1",
)


def clone_groups(spark, sf_dir):
    groups = clones.clone_groups(streams(spark, sf_dir), 50)
    return groups.select("tokens", F.explode("members").alias("m")).select("tokens", F.col("m.file").alias("doc_id"), F.col("m.start").alias("start"), F.col("m.stop").alias("stop"))


built("clone_groups", clone_groups, None)
