"""Public API surfaces of library units, and what changed between two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import api
from .closed_world import library

#: Kinds that make no entry of their own.
NO_ENTRY = ("crate", "implementation", "import", "extern_crate", "foreign_module", "opaque_type")
#: Changes in the order in which they are told.
CHANGES = ("definition_added", "definition_removed", "binding_added", "binding_removed", "binding_retargeted")
UNIT = ["package_path", "unit", "unit_kind"]


def units(targets: DataFrame) -> DataFrame:
    """Production libraries of the target, and procedural macros."""
    macro = F.array_contains("kinds", "proc-macro")
    kept = targets.where((F.col("role") == "production") & library(F.col("kinds")) & ((F.col("context") == "target") | macro))
    return kept.select("invocation", "package", "package_path", F.col("target").alias("unit"), F.when(F.array_contains("kinds", "proc-macro"), "proc_macro").otherwise("library").alias("unit_kind"))


def surface(t: dict[str, DataFrame], targets: DataFrame) -> dict[str, DataFrame]:
    """definitions, bindings, and errors where invocations of one unit disagree."""
    u = units(targets)
    exposed = t["public_binding"].join(u, "invocation").select("invocation", F.col("resolved_target_path").alias("prefix")).distinct()
    own = t["definition"].join(u, "invocation").where(F.col("externally_reachable") & ~F.startswith("definition_path", F.lit("<")) & ~F.col("kind").isin(*NO_ENTRY))
    marked = own.withColumn("_p", F.explode(api.prefixes(F.col("definition_path"), "::")))
    hit = marked.join(exposed, (marked["invocation"] == exposed["invocation"]) & (F.col("_p") == F.col("prefix")), "left_semi").drop("_p").dropDuplicates(["invocation", "compiler_id"])
    span = F.struct(F.col("span").isNull().alias("unknown"), F.col("span.file").alias("file"), F.col("span.line").alias("line"), F.col("span.column").alias("column"))
    d = hit.groupBy(*UNIT, "definition_path", "kind").agg(F.min(span).alias("at"), F.count_distinct("expansion_origin").alias("origins"), F.min("package").alias("package"))
    bound = t["public_binding"].join(u, "invocation").join(t["definition"].select(F.col("invocation").alias("_i"), F.col("compiler_id").alias("_c"), F.col("definition_path").alias("parent_path")), (F.col("invocation") == F.col("_i")) & (F.col("parent") == F.col("_c")), "left")
    b = bound.groupBy(*UNIT, "parent_path", "name", "namespace").agg(F.min("resolved_target_path").alias("resolved_target_path"), F.count_distinct("resolved_target_path").alias("targets"), F.min("exposure").alias("exposure"), F.min(span).alias("at"))
    errors = d.where("origins > 1").select(F.concat_ws(" ", F.lit("definition disagrees between builds:"), "definition_path").alias("message")).unionByName(b.where("targets > 1").select(F.concat_ws(" ", F.lit("binding disagrees between builds:"), "parent_path", "name").alias("message")))
    return {"definitions": d.drop("origins"), "bindings": b.drop("targets"), "errors": errors}


def diff(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """The change log in its total order.  Exposure, spans and a package's display name
    are no identity and no change."""
    key = [*UNIT, "definition_path", "kind"]
    slot = [*UNIT, "parent_path", "name", "namespace"]
    d = api.changes(before["definitions"].withColumn("t", F.lit("")), after["definitions"].withColumn("t", F.lit("")), key, "t")
    b = api.changes(before["bindings"], after["bindings"], slot, "resolved_target_path")
    d = d.select(F.concat(F.lit("definition_"), F.col("change")).alias("change"), *UNIT, F.col("definition_path").alias("path"), F.col("kind").alias("name"), F.lit("").alias("namespace"), F.lit(None).cast("string").alias("before_target"), F.lit(None).cast("string").alias("after_target"))
    b = b.select(F.concat(F.lit("binding_"), F.col("change")).alias("change"), *UNIT, F.coalesce("parent_path", F.lit("")).alias("path"), "name", "namespace", "before_target", "after_target")
    order = F.array_position(F.array(*map(F.lit, CHANGES)), F.col("change"))
    return d.unionByName(b).orderBy(order, *UNIT, "path", "name", "namespace")


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in CHANGES])
