"""Which packages of a workspace a request selects, and what that seeds.

Tables are those of ``sources.build.metadata``: package (package, root), target
(package, root, target, kinds, src_path, test, required), member, dependency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features
from .features import FeatureError


def inside(path: Column, folder: Column) -> Column:
    """Whether a path is the folder or lies in it; the folder '' holds everything."""
    return (folder == "") | (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def selected(package: DataFrame, requested: DataFrame) -> DataFrame:
    """Packages whose root holds a requested path, or that lie in a requested folder.

    ``requested``: path, is_folder.  An equi-join on exploded ancestors, so no path is
    compared with every package."""
    up = lambda c: F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), F.lit(1), i), "/")))
    holds = requested.select(F.explode(up(F.col("path"))).alias("_at")).distinct()
    within = package.select("package", F.explode(up(F.col("root"))).alias("_at")).join(requested.where("is_folder").select(F.col("path").alias("_at")).distinct(), "_at", "left_semi").select("package")
    own = package.join(holds, package["root"] == holds["_at"], "left_semi").select("package")
    return package.join(own.unionByName(within).distinct(), "package", "left_semi")


def audit_inventory(package: DataFrame, requested: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """The packages that an audit's ``requested`` paths (path, is_folder) select, and the
    paths that lie outside of the workspace's ``root``: with any of these there is no audit."""
    outside = requested.where(~inside(F.col("path"), F.lit(root))).select("path")
    return selected(package, requested), outside


def root_contexts(selected: DataFrame, target: DataFrame) -> DataFrame:
    """(package, context): host for a procedural macro, target for every other target but a
    build script; target where a package has none."""
    macro, script = F.array_contains("kinds", "proc-macro"), F.array_contains("kinds", "custom-build")
    found = target.join(selected.select("package"), "package", "left_semi").select("package", F.when(macro, "host").when(~script, "target").alias("context")).where("context is not null").distinct()
    rest = selected.select("package").join(found, "package", "left_anti").withColumn("context", F.lit("target"))
    return found.unionByName(rest)


def seeds(roots: DataFrame, member: DataFrame, edges: DataFrame, reached: DataFrame, *, all_features: bool = False, no_default: bool = False, selectors: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(package, context, feature) that a request enables by itself, and (package, context)
    that a qualified selector activates.

    A plain selector enables the feature in every root that has it and must fit one; a
    qualified one names a package that is reached, or a root's dependency."""
    have = member.select("package", "feature")
    named = [features.parse_selector(s) for s in selectors]
    rooted = roots.join(have, "package")
    if all_features:
        out = rooted
    else:
        wanted = [f for q, f in named if q is None] + ([] if no_default else ["default"])
        out = rooted.where(F.col("feature").isin(wanted)) if wanted else rooted.where("false")
    extra = roots.where("false").select("package", "context")
    for qualifier, feature in named:
        if qualifier is None:
            if rooted.where(F.col("feature") == feature).isEmpty():
                raise FeatureError(f"no selected package has feature {feature}")
            continue
        package = features.qualified((qualifier, feature), edges, roots, reached)
        if have.where((F.col("package") == package) & (F.col("feature") == feature)).isEmpty():
            raise FeatureError(f"package {package} has no feature {feature}")
        where = reached.where(F.col("package") == package).select("package", "context").distinct()
        out = out.unionByName(where.withColumn("feature", F.lit(feature)).select(*out.columns))
        extra = extra.unionByName(where)
    return out.select("package", "context", "feature").distinct(), extra.distinct()


def target_seeds(target: DataFrame, selected: DataFrame, enabled: DataFrame) -> DataFrame:
    """(package, path, role, production, test): the targets of selected packages with their
    gates.  ``target`` has ``bench``; ``enabled``: package, feature."""
    on = enabled.groupBy("package").agg(F.collect_set("feature").alias("_on"))
    t = target.join(selected.select("package"), "package", "left_semi").join(on, "package", "left")
    gate = features.target_gate(F.col("kinds"), F.col("required"), F.coalesce("_on", F.array().cast("array<string>")), F.col("test"), F.col("bench"))
    return t.select("package", F.col("src_path").alias("path"), gate.alias("g")).select("package", "path", "g.role", "g.production", "g.test")


def excluded(pairs: list[str], active: DataFrame, edges: DataFrame, roots: DataFrame, reached: DataFrame) -> DataFrame:
    """(package, feature) taken away at the end; naming a package that isn't built is an error."""
    spark = roots.sparkSession
    rows = []
    for text in pairs:
        qualifier, feature = features.parse_selector(text)
        if qualifier is None:
            rows += [(r["package"], feature) for r in roots.select("package").distinct().collect()]
            continue
        package = features.qualified((qualifier, feature), edges, roots, reached)
        if active.where(F.col("package") == package).isEmpty():
            raise FeatureError(f"package {package} is not built, so feature {feature} can't be excluded")
        rows.append((package, feature))
    return spark.createDataFrame(rows, "package string, feature string")
