"""Reports: JSON, Markdown and SARIF, and the numbering of rules."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.constants import SARIF_LEVEL
from lodestone.functions.score import severity_order


def rule_index(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules (class, ord) that findings refer to, numbered from 0 in catalogue order, each with its worst severity."""
    worst = findings.groupBy("class").agg(F.max_by("severity", severity_order(F.col("severity"))).alias("severity"))
    used = rules.join(worst, "class")
    # as many rows as there are rules
    return used.withColumn("rule_index", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ord")) - 1)


def to_json(rows: DataFrame) -> DataFrame:
    """A JSON document for each row; nulls are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def _cell(x: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown_rows(findings: DataFrame) -> DataFrame:
    """Findings as rows of a Markdown table, with their track."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", _cell(F.col("severity")), F.format_string("%.2f", "confidence"), _cell(F.col("class")), _cell(F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"))), _cell(F.col("handler")), _cell(F.col("evidence"))), F.lit(" |"))
    return findings.select("track", line.alias("row"))


def markdown(findings: list, coverage: dict, diagnostics: list, run: dict | None = None, tracks: dict[str, list] | None = None) -> str:
    """A report of ranked findings, collected for a reader.

    A section for each track by itself (``tracks`` has their findings, by default
    those of the ranked ones that they alone report) and one for all in order,
    each with what it cites; then coverage and diagnostics.
    """
    esc = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    out = ["# Findings", ""]
    for k, v in (run or {}).items():
        out.append(f"- {k}: {'none' if v is None else v}")
    out += [""] if run else []
    parts = tracks or {t: [f for f in findings if f["track"] == t] for t in ("static", "llm")}
    for title, rows in (("Static track", parts.get("static", [])), ("Model track", parts.get("llm", [])), ("All, in order", findings)):
        out += [f"## {title} ({len(rows)})", ""]
        if not rows:
            out += ["No findings.", ""]
            continue
        out += ["| Severity | Confidence | Class | Location | Handler | Evidence |", "|---|---|---|---|---|---|"]
        out += [f"| {f['severity']} | {f['confidence']:.2f} | {esc(f['class'])} | {esc(f['file'])}:{f['line']} | {esc(f['handler'])} | {esc(f['evidence'])} |" for f in rows] + [""]
        cited = [f"- {esc(f['class'])} in {esc(f['handler'])} cites " + ", ".join(f"[{esc(c['title'])}]({c['source_url']})" for c in f["citations"]) for f in rows if f.get("citations")]
        out += cited + [""] if cited else []
    out += ["## Coverage", ""] + [f"- {k}: {v}" for k, v in coverage.items()] + [""]
    if diagnostics:
        out += ["## Diagnostics", ""] + [f"- {d['kind']} {esc(d.get('file') or '-')}: {esc(d['message'])}" for d in diagnostics] + [""]
    return "\n".join(out)


#: Diagnostics that say that code was not looked at; others are notes on code that was.
NOT_ANALYZED = ("parse", "skipped")


def sarif(findings: list, rules: list, diagnostics: list, base: str = "", tool: str = "lodestone", version: str = "1") -> str:
    """SARIF 2.1.0 of ranked findings; no clock, so equal findings give equal bytes."""
    used = [r for r in rules if any(f["class"] == r["id"] for f in findings)]
    index = {r["id"]: i for i, r in enumerate(used)}
    order = list(SARIF_LEVEL)[::-1]

    def uri(path: str) -> str:
        path, b = path.replace("\\", "/"), base.replace("\\", "/").rstrip("/")
        return path[len(b) + 1 :] if b and path.startswith(b + "/") else path

    def described(r: dict) -> dict:
        worst = max((f["severity"] for f in findings if f["class"] == r["id"]), key=order.index)
        return {"id": r["id"], "shortDescription": {"text": r["title"]}, "fullDescription": {"text": r["text"]}, "helpUri": r["help"], "properties": {"security-severity": SARIF_LEVEL[worst][1]}}

    def result(f: dict) -> dict:
        place: dict = {"artifactLocation": {"uri": uri(f["file"])}}
        if f["line"]:
            place["region"] = {"startLine": f["line"]}
        out = {
            "ruleId": f["class"], "level": SARIF_LEVEL[f["severity"]][0], "message": {"text": f["evidence"]},
            "locations": [{"physicalLocation": place, "logicalLocations": [{"name": f["handler"], "kind": "function"}]}],
            "properties": {"confidence": f["confidence"], "track": f["track"], "severity": f["severity"], "security-severity": SARIF_LEVEL[f["severity"]][1]},
        }
        if f.get("subject"):
            out["properties"]["subject"] = f["subject"]
        if f.get("absorbed_handlers"):
            out["properties"]["absorbedHandlers"] = list(f["absorbed_handlers"])
        if f.get("citations"):
            out["relatedLocations"] = [{"physicalLocation": {"artifactLocation": {"uri": c["source_url"]}}, "message": {"text": c["title"]}} for c in f["citations"]]
        if f["class"] in index:
            out["ruleIndex"] = index[f["class"]]
        if f.get("id"):
            out["partialFingerprints"] = {"findingId/v1": f["id"]}
        return out

    def noted(d: dict) -> dict:
        out: dict = {"level": "warning" if d["kind"] in NOT_ANALYZED else "note", "message": {"text": f"{d['kind']}: {d['message']}"}}
        if d.get("file"):
            out["locations"] = [{"physicalLocation": {"artifactLocation": {"uri": uri(d["file"])}}}]
        return out

    notes = [noted(d) for d in diagnostics]
    run = {"tool": {"driver": {"name": tool, "version": version, "rules": [described(r) for r in used]}}, "results": [result(f) for f in findings], "invocations": [{"executionSuccessful": True, "toolExecutionNotifications": notes}]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False)
