"""Reports: tables of units and issues to JSON, Markdown and SARIF.

Counts are aggregations; the documents themselves are made on the driver, since each is one file for people or one tool. Rows come
a partition at a time, but the report is held in memory whole: a review too large for that is read as tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitflow.functions.text import LEVELS, SEVERITIES
from unitflow.operators import lookups

POSITION = "struct<Filename: string, Offset: long, Line: long, Column: long>"
FUNCTION = f"struct<package: string, name: string, receiver: string, signature: string, position: {POSITION}>"
UNITS = f"unit_id string, ordinal int, functions array<{FUNCTION}>, purpose string, behavior string, invariants array<string>, security array<string>"
ISSUES = f"unit_id string, ord int, position {POSITION}, severity string, category string, message string, snippet string, suggestion string"


def _bounded(df: DataFrame) -> list[dict]:
    """Rows of which there are few at any input: counts by severity and pass."""
    return [r.asDict(recursive=True) for r in df.collect()]


def _rows(df: DataFrame) -> Iterator[dict]:
    """All rows in turn, a partition at a time."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def _present(values: dict, optional: Iterable[str]) -> dict:
    return {k: v for k, v in values.items() if v or k not in optional}


def summary(units: DataFrame, issues: DataFrame) -> dict:
    """Totals by severity and category, and units with a critical issue in evaluation order."""
    counts = _bounded(lookups.issue_counts(issues, "severity", "category"))
    critical = lookups.critical_units(issues.join(units.select("unit_id", "ordinal"), "unit_id", "left"), "unit_id", F.col("ordinal"))
    out = {"total_issues": sum(c["n"] for c in counts), "by_severity": {}, "by_category": {}, "critical_units": [r["unit_id"] for r in _rows(critical.orderBy("first", "unit_id"))]}
    for c in sorted(counts, key=lambda c: (c["severity"], c["category"])):
        for key, name in (("by_severity", c["severity"]), ("by_category", c["category"])):
            out[key][name] = out[key].get(name, 0) + c["n"]
    return out


def assemble(units: DataFrame, issues: DataFrame, metadata: dict) -> dict:
    """The report as one nested value; units (UNITS) and issues (ISSUES), issues of a unit by ord."""
    found: dict[str, dict] = {}
    for u in _rows(units.orderBy("unit_id")):
        told = _present({k: u[k] or ([] if k in ("invariants", "security") else "") for k in ("purpose", "behavior", "invariants", "security")}, ("invariants", "security"))
        found[u["unit_id"]] = {"functions": [_present(f, ("receiver",)) for f in u["functions"] or []], "summary": told, "issues": []}
    for i in _rows(issues.orderBy("unit_id", "ord")):
        unit = found.setdefault(i["unit_id"], {"functions": [], "summary": {"purpose": "", "behavior": ""}, "issues": []})
        unit["issues"].append(_present({k: i[k] for k in ("position", "severity", "category", "message", "snippet", "suggestion")}, ("snippet", "suggestion")))
    return {"metadata": {"total_units": len(found)} | metadata, "units": found, "summary": summary(units, issues)}


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False)


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """units and issues of a report written before; what is missing is empty."""
    text = spark.read.text(path, wholetext=True).first()
    report = json.loads(text[0]) if text else {}
    units, issues = [], []
    for k, (name, u) in enumerate((report.get("units") or {}).items()):
        told = u.get("summary") or {}
        made = [{"receiver": ""} | f for f in u.get("functions") or []]
        units.append((name, k, made, told.get("purpose", ""), told.get("behavior", ""), told.get("invariants") or [], told.get("security") or []))
        issues += [(name, j, i.get("position"), i.get("severity", ""), i.get("category", ""), i.get("message", ""), i.get("snippet", ""), i.get("suggestion", "")) for j, i in enumerate(u.get("issues") or [])]
    return spark.createDataFrame(units, UNITS), spark.createDataFrame(issues, ISSUES)


def title_case(text: str) -> str:
    """With a capital first letter; the rest as it is."""
    return text[:1].upper() + text[1:]


def to_markdown(report: dict) -> str:
    units, totals, meta = report["units"], report["summary"], report["metadata"]
    out = ["# Code Review Report\n", f"Generated: {str(meta.get('generated_at', ''))[:16].replace('T', ' ')} | Modules: {', '.join(meta.get('modules') or [])}\n", "## Summary\n", "| Severity | Count |", "|----------|-------|"]
    out += [f"| {title_case(s)} | {totals['by_severity'][s]} |" for s in SEVERITIES if totals["by_severity"].get(s)]
    out.append("")
    high = sorted(u for u, x in units.items() if any(i["severity"] == "high" for i in x["issues"]))
    for title, severity, names in (("## Critical Issues\n", "critical", totals["critical_units"]), ("## High Priority Issues\n", "high", high)):
        out += [title] if names else []
        for name in names:
            unit = units[name]
            at = [f" ({f['position']['Filename']}:{f['position']['Line']})" for f in unit["functions"][:1]]
            out.append(f"### {name}{''.join(at)}\n")
            for i in (i for i in unit["issues"] if i["severity"] == severity):
                out.append(f"**[{severity.upper()}] [{i['category']}]** {i['message']}")
                out += [f"> Suggestion: {i['suggestion']}"] if i.get("suggestion") else []
                out.append("")
            out.append("---\n")
    out.append("## All Functions\n")
    for name in sorted(units, key=str.encode):
        out.append(f"### {name}")
        out += [f"**{label}:** {units[name]['summary'][label.lower()]}" for label in ("Purpose", "Behavior") if units[name]["summary"].get(label.lower())]
        out.append("")
        if units[name]["issues"]:
            out += ["Issues:", *[f"- [{i['severity']}] {i['message']}" for i in units[name]["issues"]], ""]
    return "\n".join(out) + "\n"


def to_sarif(report: dict) -> str:
    """SARIF 2.1.0; rules sorted by name, results by unit."""
    issues = [i for name in sorted(report["units"]) for i in report["units"][name]["issues"]]
    results = []
    for i in issues:
        result, at = {"ruleId": i["category"], "level": LEVELS.get(i["severity"], "note"), "message": {"text": i["message"]}}, i.get("position") or {}
        if at.get("Filename"):
            region = _present({"startLine": at.get("Line") or 0, "startColumn": at.get("Column") or 0}, ("startColumn",))
            result["locations"] = [{"physicalLocation": {"artifactLocation": {"uri": at["Filename"]}, "region": region}}]
        if i.get("suggestion"):
            result["fixes"] = [{"description": {"text": i["suggestion"]}}]
        results.append(result)
    rules = [{"id": c, "name": c, "shortDescription": {"text": f"{c} analysis"}} for c in sorted({i["category"] for i in issues})]
    run = {"tool": {"driver": {"name": "unitflow", "version": "0.1.0", "rules": rules}}, "results": results}
    return json.dumps({"$schema": "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False)


def write_report(report: dict, form: str, paths: dict[str, str]) -> None:
    """form: json, markdown, sarif or all; formats without a path, and other forms, write nothing."""
    made = {"json": to_json, "markdown": to_markdown, "sarif": to_sarif}
    for name in made if form == "all" else [form] if form in made else []:
        if paths.get(name):
            Path(paths[name]).write_text(made[name](report), encoding="utf-8")
