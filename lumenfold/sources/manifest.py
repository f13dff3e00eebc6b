"""Package manifests in TOML: which targets take part in benchmarks.

Each manifest is parsed where it lies, in Arrow batches; what leaves is a row for each
table of a target.  A manifest that can't be read gives an error row."""

from __future__ import annotations

import posixpath
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of tables that a manifest has for targets; a library has one, the others lists.
SECTIONS = ("lib", "bin", "example", "test", "bench")
_SCHEMA = pa.schema([("root", pa.string()), ("section", pa.string()), ("place", pa.int32()), ("name", pa.string()), ("src_path", pa.string()), ("bench", pa.bool_()), ("error", pa.string())])
_DDL = "root string, section string, place int, name string, src_path string, bench boolean, error string"


def settings(root: str, text: str) -> list[dict]:
    """A row for each target's table: section, place in its list, name, path, bench."""
    document = tomllib.loads(text)
    rows = []
    for section in SECTIONS:
        value = document.get(section)
        entries = [value] if section == "lib" else value if isinstance(value, list) else []
        for place, entry in enumerate(entries):
            if isinstance(entry, dict):
                of = lambda key, kind, e=entry: e[key] if isinstance(e.get(key), kind) else None
                path = of("path", str)
                rows.append({"root": root, "section": section, "place": place, "name": of("name", str), "src_path": path and posixpath.normpath(posixpath.join(root, path)), "bench": of("bench", bool), "error": None})
    return rows


def read(manifests: DataFrame) -> DataFrame:
    """``manifests``: root, content -> the rows of ``settings``, with an ``error`` alone for
    a manifest that isn't TOML."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for root, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += settings(root, (content or b"").decode("utf-8"))
                except (UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
                    rows.append({"root": root, "error": f"manifest can't be read: {e}"})
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return manifests.select("root", F.col("content").cast("binary").alias("content")).mapInArrow(run, _DDL)


def bench_enabled(targets: DataFrame, tables: DataFrame) -> DataFrame:
    """``targets`` (root, target, kinds, src_path) with ``bench``: what the first table of
    its section that has its name or path says; else whether its kind is a library, a
    procedural macro, a binary or a benchmark."""
    has = lambda *k: F.arrays_overlap("kinds", F.array(*map(F.lit, k)))
    section = F.when(has("lib", "proc-macro"), "lib").when(has("bin"), "bin").when(has("example"), "example").when(has("test"), "test").when(has("bench"), "bench")
    t = targets.withColumn("_section", section)
    m = tables.where("error is null").select(F.col("root").alias("_r"), F.col("section").alias("_s"), "place", F.col("name").alias("_n"), F.col("src_path").alias("_p"), F.col("bench").alias("_b"))
    fits = (F.col("_section") == "lib") | (F.col("_n") == F.col("target")) | (F.col("_p") == F.col("src_path"))
    met = t.join(m, (F.col("root") == F.col("_r")) & (F.col("_section") == F.col("_s")) & F.coalesce(fits, F.lit(False)), "left")
    said = met.groupBy(*targets.columns).agg(F.min_by(F.struct("_b"), F.col("place")).alias("said"))
    usual = has("lib", "proc-macro", "bin", "bench")
    return said.select(*targets.columns, F.coalesce("said._b", usual).alias("bench"))
