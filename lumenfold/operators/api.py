"""Public surfaces: what is exposed, and the change log of two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefixes(path: Column, separator: str) -> Column:
    """All prefixes of a path that end before a separator, the whole last."""
    parts = F.split(path, F.lit(f"\\Q{separator}\\E"))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def with_exposed_ancestor(rows: DataFrame, path: str, exposed: DataFrame, separator: str = "::") -> DataFrame:
    """Rows of which some prefix is exposed (column ``prefix``); an equi-join on the prefixes."""
    marked = rows.withColumn("_prefix", F.explode(prefixes(F.col(path), separator)))
    hit = marked.join(exposed.select(F.col("prefix").alias("_prefix")).distinct(), "_prefix")
    return hit.groupBy(*rows.columns).agg(F.count("*").alias("exposed_prefixes"), F.max_by("_prefix", F.length("_prefix")).alias("longest_exposed"))


def longest_owner(rows: DataFrame, path: str, owners: DataFrame, separator: str = "/") -> DataFrame:
    """Each row with the owner (column ``owner``, a path) that is its longest prefix, or
    NULL.  Prefixes make an equi-join of what is a comparison of all with all."""
    marked = rows.distinct().withColumn("_prefix", F.explode(prefixes(F.col(path), separator)))
    owned = marked.join(owners.select(F.col("owner").alias("_prefix"), F.col("owner").alias("_owner")).distinct(), "_prefix", "left")
    return owned.groupBy(*rows.columns).agg(F.max_by("_owner", F.when(F.col("_owner").isNotNull(), F.length("_owner"))).alias("owner"))


def changes(before: DataFrame, after: DataFrame, keys: list[str], target: str) -> DataFrame:
    """added, removed and retargeted slots: one full outer join; a slot whose target
    stays is no change, whatever else it carries."""
    b = before.select(*keys, F.col(target).alias("before_target"), F.lit(True).alias("_b"))
    a = after.select(*keys, F.col(target).alias("after_target"), F.lit(True).alias("_a"))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("before_target").eqNullSafe(F.col("after_target")), "retargeted")
    return b.join(a, keys, "full_outer").withColumn("change", kind).where("change is not null").select("change", *keys, "before_target", "after_target")
