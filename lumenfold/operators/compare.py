"""Two snapshots against each other: changes, summary and contributors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(before: Column, after: Column) -> Column:
    """Two decimals; 0 for nothing to nothing, NULL for something out of nothing."""
    return F.when(before == 0, F.when(after == 0, F.lit(0.0))).otherwise(F.round((after - before) * F.lit(100.0) / F.when(before != 0, before) * F.lit(100.0), 0) / F.lit(100.0))


def percent_sql(before: str, after: str) -> str:
    """``percent`` as SQL: a comparison has hundreds of operations, and each that is called
    on a column takes its time on the driver."""
    return f"CASE WHEN {before} = 0 THEN CASE WHEN {after} = 0 THEN 0.0D END ELSE round(({after} - {before}) * 100.0D / nullif({before}, 0) * 100.0D, 0) / 100.0D END"


def change(before: str, after: str, name: str) -> list[str]:
    return [f"{before} AS before_{name}", f"{after} AS after_{name}", f"{after} - {before} AS delta_{name}", f"{percent_sql(before, after)} AS percent_{name}"]


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``; a key that occurs twice is an error.  Keys themselves are only looked at
    where a hash of them occurs twice."""
    if not rows.groupBy(F.xxhash64(*keys).alias("h")).agg(F.count("*").alias("n")).where("n > 1").take(1):
        return rows
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(*keys).first()
    if twice is not None:
        raise ValueError(f"{', '.join(str(twice[k]) for k in keys)} occurs {twice['n']} times")
    return rows


def compare(before: DataFrame, after: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Rows that any metric or the presence of changed, with ``status`` added, deleted
    or modified.  Each side has a key once at most; one full outer join."""
    b = before.select(*keys, *[F.col(m).alias(f"_b_{m}") for m in metrics], F.lit(True).alias("_b"))
    a = after.select(*keys, *[F.col(m).alias(f"_a_{m}") for m in metrics], F.lit(True).alias("_a"))
    return changed(b.join(a, keys, "full_outer"), keys, metrics)


def changed(both: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``compare`` of rows that hold both sides: _b_<metric> and _a_<metric>, and _b and
    _a, which are NULL where a side doesn't have the key."""
    side = lambda s, m: f"coalesce(_{s}_{m}, 0)"
    status = "CASE WHEN _b IS NULL THEN 'added' WHEN _a IS NULL THEN 'deleted' ELSE 'modified' END AS status"
    moved = both.where(" OR ".join(f"{side('b', m)} <> {side('a', m)}" for m in metrics))
    return moved.selectExpr(*keys, status, *[c for m in metrics for c in change(side("b", m), side("a", m), m)])


def summary(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """One row of changes of the metrics' sums."""
    total = lambda df, s: df.agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(f"_{s}_{m}") for m in metrics])
    return total(before, "b").crossJoin(total(after, "a")).selectExpr(*[c for m in metrics for c in change(f"_b_{m}", f"_a_{m}", m)])  # one row each


def summed(both: DataFrame, metrics: list[str]) -> DataFrame:
    """``summary`` of rows that hold both sides, in one pass."""
    sums = both.selectExpr(*[f"CAST(coalesce(sum(_{s}_{m}), 0) AS BIGINT) AS _{s}_{m}" for s in "ba" for m in metrics])
    return sums.selectExpr(*[c for m in metrics for c in change(f"_b_{m}", f"_a_{m}", m)])


def contributors(changes: DataFrame, first: list[str], then: list[str], path: str, k: int | None = 10) -> DataFrame:
    """The changes that move most: by the sum of absolute deltas of ``first``, of
    ``then``, then by path.  With ``k`` only a heap of k rows leaves each task."""
    moved = lambda names: sum((F.abs(F.col(f"delta_{n}")) for n in names), F.lit(0)).cast("long")
    ranked = changes.withColumn("rank_first", moved(first)).withColumn("rank_then", moved(then)).orderBy(F.desc("rank_first"), F.desc("rank_then"), path)
    return ranked if k is None else ranked.limit(k)


def other_lines(total: Column, production: Column, test: Column) -> Column:
    """Code that is neither production nor test; never below zero."""
    return F.greatest(F.lit(0), total - production - test)
