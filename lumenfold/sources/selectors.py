"""What a user names on the command line: items and places."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame


class Location(NamedTuple):
    path: str
    line: int
    column: int


def location(text: str) -> Location:
    """PATH:LINE:COLUMN by the last two colons; numbers are positive, without padding."""
    parts = text.rsplit(":", 2)
    if len(parts) != 3 or not parts[0]:
        raise ValueError(f"{text!r} is not PATH:LINE:COLUMN")
    numbers = []
    for p in parts[1:]:
        if not p.isascii() or not p.isdigit() or p.startswith("0"):
            raise ValueError(f"{p!r} is not a positive number")
        numbers.append(int(p))
    return Location(parts[0], *numbers)


def item(text: str) -> tuple[str, str]:
    """PACKAGE:PATH by the first colon."""
    package, mark, path = text.partition(":")
    if not mark or not package or not path or package != package.strip() or path != path.strip():
        raise ValueError(f"{text!r} is not PACKAGE:PATH")
    return package, path


_PARSED = "package string, item string, file string, line int, column int"


def parsed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with what each text names: package and item, file, line and column; NULL
    where it can't be read so."""
    names = rows.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text in b.column(at).to_pylist():
                try:
                    first = item(text or "")
                except ValueError:
                    first = (None, None)
                try:
                    then = tuple(location(text or ""))
                except ValueError:
                    then = (None, None, None)
                out.append((*first, *then))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*names, "package", "item", "file", "line", "column"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, {_PARSED}")
