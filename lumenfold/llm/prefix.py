"""Prefix sums over an order, by group, from totals of partitions.

Rows are dealt out by ranges of (group, order), so each partition holds a
contiguous run.  The totals of each group's part in each partition, summed in
partition order, say where the part starts; a running sum inside the part does the
rest.  A group of any size is spread over as many partitions as its rows need, and so
are rows that tie on the whole order: their place in the input parts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def prefix_sums(df: DataFrame, group: list[str], order: list[Column], measures: list[str], scratch: Scratch) -> DataFrame:
    """``df`` with ``row_before`` and ``<measure>_before``: what stands before the row
    in its group.  Rows that tie on all of ``order`` may come in any order: they
    should be alike in what matters."""
    order = [*order, F.col("_tie")]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id())
    parts = scratch.cut(dealt.repartitionByRange(*[F.col(g).asc_nulls_first() for g in group], *order).withColumn("_part", F.spark_partition_id()))
    keys = [*group, "_part"]
    totals = parts.groupBy(*keys).agg(F.count("*").alias("_t_row"), *[F.sum(m).alias(f"_t_{m}") for m in measures])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(*keys, *[F.coalesce(F.sum(f"_t_{m}").over(earlier), F.lit(0)).alias(f"_s_{m}") for m in ("row", *measures)])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ran = parts.select("*", F.count("*").over(inside).alias("_r_row"), *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_r_{m}") for m in measures])
    ran, start = ran.alias("r"), start.alias("s")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    # Without groups there is a row for each partition: small, whatever the input.
    joined = ran.join(start if group else F.broadcast(start), on)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], *[(F.col(f"r._r_{m}") + F.col(f"s._s_{m}")).cast("long").alias(f"{m}_before") for m in ("row", *measures)])
