"""Reports as JSON documents and as tables of text.

What there is of each role is fetched; what there is of each file or message becomes
text where its row lies.  So a document is a list of parts: a text, or a DataFrame of
texts (``text``) in their order.  ``*_json`` and ``*_table`` put it together."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import METRICS
from .snapshot import ROLE_ORDER

SCHEMA_VERSION = 3
#: Shown names of the roles, in their order.
LABELS = dict(zip(ROLE_ORDER, ("Production", "Tests", "Benches", "Examples", "Build", "Conditional", "Inactive", "Orphan")))


def _ordered(rows: list) -> list:
    return sorted(rows, key=lambda r: ROLE_ORDER.index(r["role"]))


def _numbers(r) -> dict:
    return {m: r[m] for m in METRICS}


def _dumped(rows: DataFrame, shape: Callable[[dict], dict]) -> DataFrame:
    """Each row as JSON: ``shape`` of its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(shape(r), ensure_ascii=False) for r in b.to_pylist()], pa.string())], names=["text"])

    return rows.mapInArrow(run, "text string")


def _document(out: dict, lists: dict[str, DataFrame]) -> list[str | DataFrame]:
    """``out`` with each of ``lists`` where it has that key, or at its end."""
    parts: list[str | DataFrame] = [""]
    for i, (k, v) in enumerate((out | lists).items()):
        parts[-1] += f"{', ' if i else '{'}{json.dumps(k)}: "
        if k in lists:
            parts[-1] += "["
            parts += [v, "]"]
        else:
            parts[-1] += json.dumps(v, ensure_ascii=False)
    parts[-1] += "}\n"
    return parts


def _whole(parts: list[str | DataFrame], between: str) -> str:
    return "".join(p if isinstance(p, str) else between.join(r["text"] for r in p.collect()) for p in parts)


def snapshot_document(tables: dict[str, DataFrame], snapshot: str = "after", summary_only: bool = False, extra: dict | None = None) -> list[str | DataFrame]:
    mine = lambda t: tables[t].where(F.col("snapshot") == snapshot)
    total = mine("total").first()
    out = {
        "schema_version": SCHEMA_VERSION,
        "report_kind": "snapshot",
        "detail": "summary" if summary_only else "files",
        **(extra or {}),
        "file_count": total["files"] if total else 0,
        "bytes": total["bytes"] if total else 0,
        "total": _numbers(total) if total else dict.fromkeys(METRICS, 0),
        "buckets": [{"role": r["role"], "files": r["files"], **_numbers(r)} for r in _ordered(mine("project").collect())],
        "diagnostics": [],
    }
    lists = {"diagnostics": _dumped(mine("diagnostics").select("path", "message").orderBy("path", "message"), dict)}
    if not summary_only:
        per = mine("roles").groupBy("path").agg(F.collect_list(F.struct("role", "files", *METRICS)).alias("buckets"))
        rows = mine("files").select("path", "bytes", "errors").join(per, "path", "left").orderBy(F.split("path", "/"))
        lists["files"] = _dumped(rows, lambda r: {"path": r["path"], "bytes": r["bytes"], "syntax_errors": r["errors"], "buckets": _ordered(r["buckets"] or [])})
    return _document(out, lists)


def snapshot_json(tables: dict[str, DataFrame], snapshot: str = "after", summary_only: bool = False, extra: dict | None = None) -> str:
    return _whole(snapshot_document(tables, snapshot, summary_only, extra), ", ")


def _changes(r: dict) -> dict:
    return {k[6:]: {s: r[f"{s}_{k[6:]}"] for s in ("before", "after", "delta", "percent")} for k in r if k.startswith("delta_")}


def comparison_document(compared: dict[str, DataFrame], summary_only: bool = False, extra: dict | None = None) -> list[str | DataFrame]:
    out = {"schema_version": SCHEMA_VERSION, "report_kind": "comparison", "detail": "summary" if summary_only else "files", **(extra or {}), "summary": _changes(compared["summary"].first().asDict()), "roles": [{"role": r["role"], **_changes(r.asDict())} for r in _ordered(compared["roles"].collect())]}
    return _document(out, {} if summary_only else {"files": _dumped(compared["files"].orderBy("path"), lambda r: {"path": r["path"], "status": r["status"], **_changes(r)})})


def comparison_json(compared: dict[str, DataFrame], summary_only: bool = False, extra: dict | None = None) -> str:
    return _whole(comparison_document(compared, summary_only, extra), ", ")


def _table(head: list[str], rows: list[list]) -> str:
    cells = [head, *[[f"{c:,}" if isinstance(c, int) else str(c) for c in r] for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(head))]
    return "".join("  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(r, widths))).rstrip() + "\n" for r in cells)


def _lines(head: list[str], rows: DataFrame, order) -> list[str | DataFrame]:
    """``_table`` of a DataFrame whose first column is text and whose others are numbers:
    its first line, and the others as texts without their ends."""
    first, *others = rows.columns
    cells = rows.select(F.col(first), *[F.format_number(c, 0).alias(c) for c in others])
    found = cells.agg(*[F.max(F.length(c)).alias(c) for c in rows.columns]).first()
    widths = [max(len(h), found[c] or 0) for h, c in zip(head, rows.columns)]
    shown = [F.rpad(first, widths[0], " "), *[F.lpad(c, w, " ") for c, w in zip(others, widths[1:])]]
    return [_table([h.ljust(w) if i == 0 else h.rjust(w) for i, (h, w) in enumerate(zip(head, widths))], []), cells.orderBy(order).select(F.concat_ws("  ", *shown).alias("text"))]


def snapshot_text(tables: dict[str, DataFrame], snapshot: str = "after", files: bool = False) -> list[str | DataFrame]:
    """The role table; its total counts files once, as a file may stand in several roles.
    With ``files`` their table after it."""
    mine = lambda t: tables[t].where(F.col("snapshot") == snapshot)
    rows = [[LABELS[r["role"]], r["files"], *_numbers(r).values()] for r in _ordered(mine("project").collect())]
    if total := mine("total").first():
        rows.append(["Total", total["files"], *_numbers(total).values()])
    out = _table(["role", "files", *METRICS], rows)
    if not files:
        return [out]
    code = lambda *roles: F.sum(F.when(F.col("role").isin(*roles), F.col("code")).otherwise(0)).cast("long")
    per = mine("roles").groupBy("path").agg(code("production").alias("p"), code("test").alias("t"), F.sum("code").cast("long").alias("all"), F.sum(F.when(F.col("role") == "production", F.col("declared_public")).otherwise(0)).cast("long").alias("pub"))
    head, lines = _lines(["file", "production", "test", "other", "public"], per.select("path", "p", "t", (F.col("all") - F.col("p") - F.col("t")).alias("other"), "pub"), F.split("path", "/"))
    return [out + "\n" + head, lines]


def snapshot_table(tables: dict[str, DataFrame], snapshot: str = "after", files: bool = False) -> str:
    parts = snapshot_text(tables, snapshot, files)
    return _whole(parts, "\n") + ("\n" if files and parts[1].take(1) else "")


def comparison_table(compared: dict[str, DataFrame]) -> str:
    """All metrics, the roles that changed, and the ten files that moved most."""
    s = compared["summary"].first()
    shown = lambda p: "n/a" if p is None else f"{p:+.2f}%"
    names = [k[6:] for k in s.asDict() if k.startswith("delta_")]
    out = _table(["metric", "before", "after", "delta", "percent"], [[n, s[f"before_{n}"], s[f"after_{n}"], s[f"delta_{n}"], shown(s[f"percent_{n}"])] for n in names])
    moved = [r for r in _ordered(compared["roles"].collect()) if any(r[f"delta_{m}"] for m in ("files", *METRICS))]
    if moved:
        out += "\n" + _table(["role", "files", "code", "public"], [[LABELS[r["role"]], r["delta_files"], r["delta_code"], r["delta_declared_public"]] for r in moved])
    top = compared["contributors"].collect()
    if top:
        out += "\n" + _table(["file", "status", "code", "cyclomatic"], [[r["path"], r["status"], r["delta_code"], r["delta_cyclomatic_authored"]] for r in top])
    return out
