"""Sinks: JSON, SARIF, text and the baseline file. Relations stay relations until the last step."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = {"dead-code": "Symbol without production references", "deep-nesting": "Deep nesting", "cyclomatic-complexity": "High cyclomatic complexity", "cognitive-complexity": "High cognitive complexity", "god-function": "Very long function or one of many parameters", "hotspot": "Complex and often changed", "duplication": "Repeated code"}


def json_document(sections: dict[str, DataFrame]) -> DataFrame:
    """One row with one JSON text; each section is an array of its rows."""
    out = None
    for name, df in sections.items():
        one = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out.select(F.to_json(F.struct(*sections)).alias("document"))


def sarif(rows: DataFrame, tool: str, version: str) -> str:
    """A SARIF 2.1.0 document of result rows (rule, level, uri, line, message, related). Results are streamed to the driver partition by partition."""

    def place(uri: str, line: int) -> dict:
        return {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": max(1, line), "startColumn": 1}}}

    results = []
    for r in rows.orderBy("uri", "line", "rule", "message").toLocalIterator():
        result = {"ruleId": r["rule"], "level": r["level"], "message": {"text": r["message"]}, "locations": [place(r["uri"], r["line"])]}
        if r["related"]:
            result["relatedLocations"] = [place(x["uri"], x["line"]) for x in r["related"]]
        results.append(result)
    rules = [{"id": k, "shortDescription": {"text": v}} for k, v in RULES.items()]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool, "version": version, "rules": rules}}, "results": results}]})


COLORS = {"certain": 31, "likely": 33, "maybe": 36}


def colored(text: str, kind: str, on: bool) -> str:
    return f"\x1b[{COLORS[kind]}m{text}\x1b[0m" if on and kind in COLORS else text


def findings_text(findings: DataFrame, top: int | None = None, color: bool = False) -> str:
    """Findings by file, as they are ordered; the cut is on what is shown only."""
    rows = findings.limit(top).collect() if top else findings.collect()
    lines, here = [], None
    for r in rows:
        if r["file"] != here:
            here = r["file"]
            lines.append(here)
        lines.append(f"  {r['line']}: {r['name']} {colored(r['tier'], r['tier'], color)} ({r['reachability']})")
    return "\n".join(lines) or "Nothing found."


def evidence_text(rows: list) -> str:
    sign = {True: "+", False: "-", None: "?"}
    return "\n".join(f"    {sign[r['ok']]} {r['text']}" for r in sorted(rows, key=lambda r: r["ordinal"]))


def hotspots_text(rows: list) -> str:
    def cell(x, f):
        return "-" if x is None else f(x)

    return "\n".join(f"{r['risk']:.1f} {r['file']}:{r['line']} {r['name']} complexity {r['complexity']} coverage {cell(r['coverage'], lambda c: f'{c * 100:.0f}%')} churn {cell(r['churn'], str)}" for r in rows)


def complexity_text(rows: list) -> str:
    return "\n".join(f"{r['file']}:{r['line']} {r['name']}: {r['message']} (limit {r['threshold']})" for r in rows)


def duplication_text(rows: list) -> str:
    """One line a group; touching ranges of a file as one."""
    out = []
    for r in rows:
        spans: dict[str, list[list[int]]] = {}
        for m in sorted(r["members"], key=lambda m: m["start_line"]):
            of = spans.setdefault(m["file"], [])
            if of and m["start_line"] <= of[-1][1] + 1:
                of[-1][1] = max(of[-1][1], m["end_line"])
            else:
                of.append([m["start_line"], m["end_line"]])
        order = dict.fromkeys(m["file"] for m in r["members"])
        out.append(f"{r['tokens']} tokens: " + ", ".join(f"{f}:{a}-{b}" for f in order for a, b in spans[f]))
    return "\n".join(out)


def triage_order(triaged: DataFrame) -> DataFrame:
    """Likely dead first, then unsure, then likely alive; then file and line."""
    rank = F.when(F.col("verdict") == "likely-dead", 0).when(F.col("verdict") == "unsure", 1).otherwise(2)
    return triaged.orderBy(rank, "file", "line", "id")


def triage_text(rows: list) -> str:
    counts = {v: sum(r["verdict"] == v for r in rows) for v in ("likely-dead", "unsure", "likely-alive")}
    head = ", ".join(f"{n} {v}" for v, n in counts.items() if n)
    return "\n".join([f"{len(rows)} triaged ({head})" if rows else "Nothing triaged.", *(f"  {r['verdict']} {r['name']} {r['file']}:{r['line']} {r['reasoning']}" for r in rows)])


def explained_text(told: dict) -> str:
    """Of explain's result."""
    if told["status"] != "resolved":
        return "\n".join([f"{told['query']}: {told['status']}", *(f"  {c}" for c in told["candidates"])])
    lines = [f"{told['id']} is {told['reachability']}" + (", with dynamic access in its file" if told["tainted"] else "")]
    lines += [f"  -> {step}" for step in told["witness"] or []]
    return "\n".join(lines + [f"  <- {who} ({verdict or 'module level'})" for who, verdict in told["inbound"]])


def baseline_text(keys: DataFrame) -> str:
    """Sorted keys of what is accepted; the file that suppress reads again."""
    return json.dumps(sorted({"|".join(str(x) for x in r) for r in keys.toLocalIterator()}), indent=1)
