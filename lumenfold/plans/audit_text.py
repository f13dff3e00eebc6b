"""An audit's products as lines of text, for people; nothing here grows with the input but
the findings and consumers that are told."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Direct consumers that are told; the rest is a number.
DIRECT_SHOWN = 25


def _place(path: str | None, line: int | None, column: int | None) -> str:
    return f"{path}:{line}:{column}" if path else "<unknown>"


def snapshot_lines(result: dict, summary: DataFrame | None = None, required: DataFrame | None = None, findings: DataFrame | None = None) -> list[str]:
    """The status, and where it is complete the counts and each finding.

    An audit that isn't complete says why and no more."""
    done = result["correlated"].agg(F.count_if(F.col("status") == "correlated").alias("n"), F.count("*").alias("all")).first()
    out = [f"audit: {result['status']}, {done['n']} of {done['all']} invocations correlated"]
    if result["reason"]:
        out.append(f"reason: {result['reason']}")
    if result["status"] != "complete":
        return out
    if required is not None:
        out.append(f"required public: {required.count()}")
    if summary is not None:
        s = summary.first()
        out += [f"can be narrowed: {s['unnecessary_public']}", f"dead public: {s['dead_public']}"]
    if findings is not None:
        out += finding_lines(findings)
    return out


def finding_lines(findings: DataFrame) -> list[str]:
    live = F.when(F.col("live_production") & F.col("live_nonproduction"), "production and others").when(F.col("live_production"), "production").when(F.col("live_nonproduction"), "others").otherwise("unreached")
    rows = findings.select("source_path", F.col("span.line").alias("line"), F.col("span.column").alias("column"), "definition_path", "kind", "finding", live.alias("live"))
    return [f"{_place(r['source_path'], r['line'], r['column'])}  {r['definition_path']}  {r['kind']}  {r['finding']}  [{r['live']}]" for r in rows.orderBy("source_path", "line", "column", "definition_path").collect()]


def impact_lines(package: str, path: str, impact: dict[str, DataFrame] | None, choices: DataFrame | None = None) -> list[str]:
    """Who depends on one item: authored consumers first, then a shortest path for each class.
    A query that fits no declaration, or several, gets what it may have meant."""
    out = [f"impact of {package}:{path}"]
    if impact is None:
        out.append("not exactly one declaration")
        if choices is not None:
            out += [f"  {r['package']}:{r['definition_path']} {_place(r['source_path'], r['line'], r['column'])}" for r in choices.collect()]
        return out
    direct, total = impact["direct"], impact["direct"].count()
    out.append(f"visibility: {impact['disposition'].first()['disposition']}")
    out.append(f"consumers: {total} direct, {impact['consumer_count'].first()['consumers']} in all")
    first = direct.orderBy(F.desc("authored"), "package", "definition_path", "line", "column", "kind").limit(DIRECT_SHOWN)
    out += [f"  {r['package']}:{r['definition_path']} by {r['kind']} [{r['class']}]" for r in first.collect()]
    if total > DIRECT_SHOWN:
        out.append(f"  and {total - DIRECT_SHOWN} more")
    if impact["witnesses"] is not None:
        out += [f"shortest path, {r['class']}: {' > '.join(r['texts'])}" for r in impact["witnesses"].orderBy("class").collect()]
    return out


def comparison_lines(before: dict, after: dict, changes: DataFrame | None) -> list[str]:
    """Both sides' status and the API's changes, or that there is nothing to compare."""
    out = [f"before: {before['status']}", f"after: {after['status']}"]
    out += [f"{side} reason: {r['reason']}" for side, r in (("before", before), ("after", after)) if r["reason"]]
    if changes is None:
        return [*out, "the public surfaces can't be compared"]
    for r in changes.collect():
        what = f"{r['path']}::{r['name']}" if r["change"].startswith("binding") else f"{r['name']} {r['path']}"
        to = f" from {r['before_target']} to {r['after_target']}" if r["change"] == "binding_retargeted" else ""
        out.append(f"{r['change']}: {r['unit']} {what}{to}")
    return out


def rerooted(rows: DataFrame, columns: list[str], old: str, new: str) -> DataFrame:
    """Paths and texts of a baseline's own folder as they are called in the working tree."""
    changed = {c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.replace(F.col(c), F.lit(old + "/"), F.lit(f"{new}/" if new else ""))) for c in columns}
    return rows.withColumns(changed)
