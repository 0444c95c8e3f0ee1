"""Mixing sources to target weights.

Each document gets a hash-random key; within its source documents are ordered by that key; a prefix sum of word counts over that order says which words a budget covers. Sources with a budget above their size repeat in further epochs, and the document on the boundary is cut at the exact word.

The prefix sum is distributed: the leading hexadecimal digits of the key range-partition every source into even ranges (so a hot source is as even as a small one), range sums are added up first, and only then rows within a range. Text never shuffles.

Defined cases: a null source is a source of its own; null or empty texts have no words and follow the order with a take of 0; a source without any word passes once, unchanged, and gets no budget; rows alike in doc_id and text are interchangeable and follow one another; other columns are carried along untouched by mix_documents, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SQL_WORD, WORD, columns_of, discard, staged, word_count

SEED = "17"
DIGITS = 3


def _key(seed: str, of: str = ""):
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(of + "doc_id").cast("string"), F.lit("~")), F.coalesce(F.md5(F.col(of + "text")), F.lit("~"))))


def _base(docs: DataFrame, seed: str) -> DataFrame:
    """The narrow table that all sums are made from; written once so that the texts are read once."""
    return staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("n_tokens"), _key(seed).alias("key")), "mix")


def budgets(base: DataFrame, weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """(source, total, budget): words it has, words it shall give. Without weights every source that has words gets the same share; total is by default the corpus's own size."""
    s = base.groupBy("source").agg(F.sum("n_tokens").alias("total"))
    everything = s.agg(F.sum("total").alias("corpus"), F.count_if(F.col("total") > 0).alias("sources"))
    s = s.crossJoin(everything).withColumn("corpus", F.lit(total).cast("long") if total is not None else F.col("corpus"))
    if weights is None:
        share = F.when(F.col("sources") > 0, F.expr("corpus div nullif(sources, 0)"))
    else:
        if any(w < 0 for w in weights.values()) or not sum(weights.values()) > 0:
            raise ValueError("weights must not be negative, and one must be positive")
        whole = float(sum(weights.values()))
        named = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, w / whole)])
        share = F.floor(F.col("corpus") * F.coalesce(F.try_element_at(named, F.col("source")), F.lit(0.0)))
    return s.select("source", "total", F.when(F.col("total") > 0, F.coalesce(share, F.lit(0))).otherwise(0).cast("long").alias("budget"))


def positions(base: DataFrame) -> DataFrame:
    """base with `before`: words ahead of each row within its source."""
    b = base.withColumn("range", F.substring("key", 1, DIGITS))
    sums = b.groupBy("source", "range").agg(F.sum("n_tokens").alias("words"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), ahead.alias("ahead"))
    within = Window.partitionBy("source", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = b.withColumn("upto", F.sum("n_tokens").over(within))
    return rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).select("doc_id", "source", "n_tokens", "key", "range", (F.col("ahead") + F.col("upto") - F.col("n_tokens")).alias("before"))


def mix_plan(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: str = SEED) -> DataFrame:
    """One row per document and epoch that the budgets cover: doc_id, source, epoch (from 1), n_tokens, take_tokens, start_token within the source's output."""
    base = _base(docs, seed)
    b = budgets(base, weights, total).withColumnRenamed("source", "s")
    rows = positions(base).join(b, F.col("source").eqNullSafe(F.col("s")))
    epochs = F.when(F.col("total") > 0, F.expr("budget div nullif(total, 0)")).otherwise(0)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs.cast("long"))))
    start = F.col("epoch") * F.col("total") + F.col("before")
    return rows.withColumn("start_token", start).where((F.col("start_token") < F.col("budget")) | (F.col("total") == 0)).select("doc_id", "source", (F.col("epoch") + 1).alias("epoch"), "n_tokens", F.least("n_tokens", F.col("budget") - F.col("start_token")).alias("take_tokens"), "start_token").withColumn("take_tokens", F.greatest("take_tokens", F.lit(0)).cast("long"))


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: str = SEED) -> DataFrame:
    """The mixed documents, with the columns of docs: repeated by epoch, the boundary document cut to the words that its source's budget still holds.

    Per source the plan is three numbers and a key, so the decision is made where the text lies.
    """
    base = _base(docs, seed)
    b = budgets(base, weights, total).withColumnRenamed("source", "s")
    spots = positions(base).join(b, F.col("source").eqNullSafe(F.col("s")))
    rest = F.when(F.col("total") > 0, F.expr("budget % nullif(total, 0)")).otherwise(0)
    alike = Window.partitionBy("source", "range", "key")
    spots = spots.withColumn("rest", rest).withColumn("first", F.min("before").over(alike)).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n_tokens") >= F.col("rest")))
    # the key whose words the end of the budget falls into; of rows alike in key the count starts at the first
    cut = spots.groupBy("s").agg(F.min(F.struct("key", "first", "rest")).alias("cut"))
    per = b.join(cut.withColumnRenamed("s", "cs"), F.col("s").eqNullSafe(F.col("cs")), "left").select("s", F.when(F.col("total") > 0, F.expr("budget div nullif(total, 0)")).otherwise(1).alias("full"), F.col("cut.key").alias("last"), (F.col("cut.rest") - F.col("cut.first")).alias("left"))
    per = staged(per, "mixcut")
    discard(base)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row).select("row", F.col("row.source").alias("src"), _key(seed, "row.").alias("key"))
    rows = keyed.join(per, F.col("src").eqNullSafe(F.col("s")))
    key, last = F.col("key"), F.col("last")
    copies = F.col("full") + F.when(last.isNotNull() & (key < last), 1).otherwise(0)
    whole = rows.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies.cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    # rows alike are interchangeable: they come together before they travel, and one stands for them
    edge = rows.where(key == last).groupBy("src", "key").agg(F.first("row").alias("row"), F.first("left").alias("left"), F.count("*").alias("rows")).withColumn("n", word_count(F.col("row.text")))
    edge = edge.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least("rows", F.ceil(F.col("left") / F.col("n"))) - 1))).withColumn("take", F.col("left") - F.col("i") * F.col("n")).where(F.col("take") > 0)

    @F.pandas_udf("string")
    def first_words(text: pd.Series, take: pd.Series) -> pd.Series:
        import regex

        def cut(t: str, n: int) -> str:
            end = 0
            for k, m in enumerate(regex.finditer(WORD, t)):
                if k == n:
                    return t[:end]
                end = m.end()
            return t

        return pd.Series([cut(t or "", int(n)) for t, n in zip(text, take, strict=True)])

    fits = F.col("take") >= F.col("n")
    edge = edge.withColumn("cut", F.when(~fits, first_words("row.text", "take")))
    changed = {"text": F.when(fits, F.col("row.text")).otherwise(F.col("cut"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(fits, F.col("row.n_chars")).otherwise(F.length("cut").cast(kind))
    return columns_of(whole, docs).unionByName(columns_of(edge, docs, **changed))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SQL_WORD}'))::BIGINT AS n,
         md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, '~'), coalesce(md5(text), '~'))) AS k
  FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS total FROM base GROUP BY source),
b AS (SELECT source, total, CASE WHEN total > 0 THEN (SELECT sum(total)::BIGINT // count(*) FILTER (WHERE total > 0) FROM s) ELSE 0 END AS budget FROM s),
c AS (SELECT base.doc_id, base.source, n, k, total, budget,
             (sum(n) OVER (PARTITION BY base.source ORDER BY k ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS before
      FROM base JOIN b ON base.source IS NOT DISTINCT FROM b.source),
e AS (SELECT *, unnest(range(0, 1 + CASE WHEN total > 0 THEN budget // total ELSE 0 END)) AS ep FROM c)
SELECT doc_id, source, (ep + 1)::BIGINT AS epoch, n AS n_tokens,
       greatest(least(n, budget - (ep * total + before)), 0)::BIGINT AS take_tokens, (ep * total + before)::BIGINT AS start_token
FROM e WHERE ep * total + before < budget OR total = 0
"""
