"""Line counts and their roll-up from files to roles to totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The metrics' names in reports.
METRICS = ("physical", "code", "comments", "docs", "blank", "lexical_complexity", "cyclomatic_authored", "cognitive_authored", "declared_public")


def physical_lines(text: Column) -> Column:
    """A trailing newline starts no line; an empty text has none."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "\n")) - F.endswith(text, F.lit("\n")).cast("int"))


def blank_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.rlike(x, F.lit("[^ \\t\\r]")))
    return F.when(text == "", F.lit(0)).otherwise(F.size(lines) - F.endswith(text, F.lit("\n")).cast("int"))


def buckets(files: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Sums by ``keys``; ``files`` counts the rows in which any metric isn't zero.

    One aggregation: partial sums leave each task, never rows."""
    some = F.greatest(*[F.col(m) for m in metrics], F.lit(0)) > 0
    return files.groupBy(*keys).agg(F.count_if(some).alias("files"), *[F.sum(m).cast("long").alias(m) for m in metrics])


def totals(files: DataFrame, path: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row: distinct files, as a file may stand in several roles, and the sums."""
    return files.groupBy(path).agg(*[F.sum(m).alias(m) for m in metrics]).agg(F.count("*").alias("files"), *[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in metrics])


def grouped(rows: DataFrame, sets: list[list[str]], entity: str, sums: list[str], total: str = "Total") -> DataFrame:
    """Sums and distinct entities of several groupings in one pass; ``total`` stands where a
    grouping leaves a key out."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    out = rows.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.count_distinct(entity).alias("files"), *[F.sum(m).cast("long").alias(m) for m in sums], *[F.grouping(k).alias(f"_{k}") for k in keys])
    return out.select(*[F.when(F.col(f"_{k}") == 1, F.lit(total)).otherwise(F.col(k)).alias(k) for k in keys], "files", *sums)


def status_rollup(rows: DataFrame, keys: list[str], status: str, reason: str, order: list[str]) -> DataFrame:
    """complete only if every part is; partial if any is complete or partial; else
    unavailable; with the first reason in ``order``."""
    s = F.col(status)
    rolled = F.when(F.bool_and(s == "complete"), "complete").when(F.bool_or(s.isin("complete", "partial")), "partial").otherwise("unavailable")
    first = F.min_by(F.col(reason), F.when(F.col(reason).isNotNull(), F.struct(*order)))
    return rows.groupBy(*keys).agg(rolled.alias("status"), first.alias("reason"), F.count("*").alias("parts"))
