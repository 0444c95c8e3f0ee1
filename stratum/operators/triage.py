"""Rows for an outside judge, and what it says: prompts of uncertain findings, validated verdicts. No network is used here; judge is any function that is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import snippet, verdict
from .classify import evidence, maybe_cap

INSTRUCTION = (
    "A static analysis could not decide whether the symbol below is dead: it may be public, reached dynamically, or was seen to run. "
    "From its source, its place and the signals, say whether nothing uses it. Missing references beside dynamic access are no sign of death. "
    "In doubt answer unsure. Reply with JSON: verdict (likely-dead, likely-alive or unsure) and reasoning, a sentence or two."
)


def prompts(findings: DataFrame, texts: DataFrame, most: int | None = None, radius: int = 6) -> DataFrame:
    """id, system, user of the maybe findings, in order of file and line: the symbol, its signals, its source. texts(file, text)."""
    some = findings.where("tier = 'maybe'") if most is None else maybe_cap(findings, most)
    sign = F.when(F.col("ok"), "[+] ").when(~F.col("ok"), "[-] ").otherwise("[?] ")
    told = evidence(some).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.concat(sign, "text").alias("line")))).alias("signals"))
    rows = some.select("id", "name", "file", "line", "reachability").join(told, "id").join(texts.select("file", "text"), "file")
    user = F.concat_ws(
        "\n",
        F.concat(F.lit("Symbol: "), "name", F.lit(" ("), "reachability", F.lit(")")),
        F.concat(F.lit("Place: "), "file", F.lit(":"), F.col("line").cast("string")),
        F.lit("Signals:"),
        F.array_join(F.transform("signals", lambda s: s["line"]), "\n"),
        F.lit("Source:"),
        snippet(F.col("text"), F.col("line"), radius),
    )
    return rows.select("id", F.lit(INSTRUCTION).alias("system"), user.alias("user"))


def judged(asked: DataFrame, judge: Callable[[str, str], str]) -> DataFrame:
    """id, verdict, reasoning of judge(system, user)'s replies; what isn't a valid reply, or fails, is unsure."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            replies = []
            for system, user in zip(f["system"], f["user"], strict=True):
                try:
                    replies.append(judge(system, user))
                except Exception as e:  # an outside service may fail in any way
                    replies.append(f"failed: {e}")
            yield pd.DataFrame({"id": f["id"], "reply": replies})

    return validated(asked.mapInPandas(run, "id string, reply string"))


def validated(replies: DataFrame) -> DataFrame:
    """id, verdict, reasoning of replies(id, reply); a reply must be an object with a known verdict and a reasoning in text."""
    reason = F.get_json_object("reply", "$.reasoning")
    said = F.when(reason.isNotNull(), verdict(F.col("reply"))).otherwise("unsure")
    return replies.select("id", said.alias("verdict"), F.coalesce(reason, F.concat(F.lit("no valid reply: "), F.substring("reply", 1, 120))).alias("reasoning"))


def attached(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings that were judged, with verdict and reasoning; their own tier stays."""
    return findings.join(verdicts.select("id", "verdict", "reasoning"), "id")


def token_totals(usage: DataFrame) -> DataFrame:
    """asked, answered: sums over calls(asked, answered)."""
    return usage.agg(F.coalesce(F.sum("asked"), F.lit(0)).alias("asked"), F.coalesce(F.sum("answered"), F.lit(0)).alias("answered"))
