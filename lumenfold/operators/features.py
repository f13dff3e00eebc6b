"""Feature resolution of a workspace: contexts and features to a fixed point.

Tables: package (package, path, proc_macro, build_only), member (package, feature,
implies), dependency (package, alias, target, kind, host_match, target_match,
optional, default_features, features, proc_macro).  A state is a package in a
context, host or target; edges from a package carry over to the state of what it
depends on.  All rules are monotone, so rounds add rows until none is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import fixpoint


class FeatureError(ValueError):
    pass


def parse_selector(text: str) -> tuple[str | None, str]:
    """FEATURE or QUALIFIER/FEATURE."""
    parts = text.split("/")
    if len(parts) > 2 or not all(parts) or any(p != p.strip() for p in parts):
        raise FeatureError(f"invalid feature selector {text!r}")
    return (None, parts[0]) if len(parts) == 1 else (parts[0], parts[1])


def feature_mode(all_features: bool, no_default: bool, named: bool, excluded: bool = False) -> str:
    base = "all" if all_features else "none" if no_default and not named else "selected" if no_default else "default+selected" if named else "default"
    return f"{base}-excluded" if excluded else base


def matching(dependency: DataFrame, roots: DataFrame) -> DataFrame:
    """(package, context, alias, target, child, ...): the edges that hold in a context.

    Development edges leave selected roots alone; build edges are of the host, and so is
    what a procedural macro needs; an edge without platform always matches."""
    contexts = dependency.select("*", F.explode(F.array(F.lit("host"), F.lit("target"))).alias("context"))
    chosen = contexts.join(roots.select("package").distinct().withColumn("selected", F.lit(True)), "package", "left")
    allowed = (F.col("kind") != "development") | F.coalesce("selected", F.lit(False))
    platform = F.when((F.col("kind") == "build") | (F.col("context") == "host"), F.col("host_match")).otherwise(F.col("target_match"))
    child = F.when((F.col("kind") == "build") | F.col("proc_macro"), "host").otherwise(F.col("context"))
    return chosen.where(allowed & F.coalesce(platform, F.lit(True))).withColumn("child", child).drop("selected")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(package, context) that any edge leads to from the roots."""

    def step(new: DataFrame) -> DataFrame:
        return new.join(edges, ["package", "context"]).where("target is not null").select(F.col("target").alias("package"), F.col("child").alias("context"))

    return fixpoint.closure(roots.select("package", "context"), step)


def qualified(selector: tuple[str, str], edges: DataFrame, roots: DataFrame, reached: DataFrame) -> str:
    """The one package that a qualifier names: a reachable package, or a root's alias."""
    by_name = reached.where(F.col("package") == selector[0]).select("package")
    by_alias = edges.join(roots.select("package").distinct(), "package", "left_semi").where((F.col("alias") == selector[0]) & F.col("target").isNotNull()).select(F.col("target").alias("package"))
    found = [r["package"] for r in by_name.unionByName(by_alias).distinct().limit(2).collect()]
    if not found:
        raise FeatureError(f"no package {selector[0]} is reachable for feature {selector[1]}")
    if len(found) > 1:
        raise FeatureError(f"package {selector[0]} is ambiguous for feature {selector[1]}")
    return found[0]


def _facts(df: DataFrame, kind: str, what: str) -> DataFrame:
    return df.select("package", "context", F.lit(kind).alias("fact"), F.col(what).alias("value"))


def resolve(member: DataFrame, dependency: DataFrame, roots: DataFrame, seeds: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(package, context, feature) that are enabled.

    ``roots``: package, context; ``seeds``: package, context, feature; ``excluded``:
    package, feature, taken away at the end without undoing what they implied.
    Facts are active (a state is built), feature, and dep (an alias is active)."""
    edges = fixpoint.cut(matching(dependency, roots))
    implied = fixpoint.cut(member.select("package", "feature", F.explode("implies").alias("implies")))
    names = fixpoint.cut(member.select("package", "feature").distinct())
    known = fixpoint.cut(_facts(roots.select("package", "context", F.lit("").alias("v")), "active", "v").unionByName(_facts(seeds, "feature", "feature")).distinct())
    strong = F.col("implies").rlike("^[^?/]+/[^/]+$")
    weak = F.col("implies").rlike(r"^[^?/]+\?/[^/]+$")
    while True:
        on = known.where("fact = 'active'").select("package", "context")
        have = known.where("fact = 'feature'").select("package", "context", F.col("value").alias("feature"))
        deps = known.where("fact = 'dep'").select("package", "context", F.col("value").alias("alias"))
        rules = have.join(implied, ["package", "feature"])
        left, right = F.regexp_extract("implies", r"^([^?/]+)\??/", 1), F.regexp_extract("implies", "/(.+)$", 1)
        optional = edges.where("optional").select("package", "context", "alias").distinct()
        new = [
            # Needed dependencies of what is built, and what features name.
            _facts(on.join(edges.where("not optional"), ["package", "context"]), "dep", "alias"),
            _facts(rules.where(F.startswith("implies", F.lit("dep:"))).select("package", "context", F.substr("implies", F.lit(5)).alias("v")), "dep", "v"),
            _facts(rules.where(strong).select("package", "context", left.alias("v")), "dep", "v"),
            # Plain members, and the feature named as an optional dependency that a strong edge switches on.
            _facts(rules.where(~strong & ~weak & ~F.startswith("implies", F.lit("dep:"))), "feature", "implies"),
            _facts(rules.where(strong).select("package", "context", left.alias("alias")).join(optional, ["package", "context", "alias"]).join(names.withColumnRenamed("feature", "alias"), ["package", "alias"], "left_semi"), "feature", "alias"),
        ]
        # A feature without a rule of its own that has an optional dependency's name switches that on.
        new.append(_facts(have.join(names, ["package", "feature"], "left_anti").withColumnRenamed("feature", "alias").join(optional, ["package", "context", "alias"], "left_semi"), "dep", "alias"))
        used = deps.join(edges, ["package", "context", "alias"]).where("target is not null")
        down = used.select(F.col("target").alias("package"), F.col("child").alias("context"), "default_features", "features")
        new += [
            _facts(down.select("package", "context", F.lit("").alias("v")), "active", "v"),
            _facts(down.where("default_features").select("package", "context", F.lit("default").alias("v")), "feature", "v"),
            _facts(down.select("package", "context", F.explode("features").alias("v")), "feature", "v"),
        ]
        asked = rules.where(strong | weak).select("package", "context", left.alias("alias"), right.alias("v")).join(deps, ["package", "context", "alias"], "left_semi")
        new.append(_facts(asked.join(edges, ["package", "context", "alias"]).where("target is not null").select(F.col("target").alias("package"), F.col("child").alias("context"), "v"), "feature", "v"))
        total = new[0]
        for n in new[1:]:
            total = total.unionByName(n)
        added = fixpoint.cut(total.distinct().join(known, known.columns, "left_anti"))
        if not fixpoint.some(added):
            break
        known = fixpoint.cut(known.unionByName(added))
    out = known.where("fact = 'feature'").select("package", "context", F.col("value").alias("feature")).join(known.where("fact = 'active'").select("package", "context"), ["package", "context"], "left_semi")
    return out if excluded is None else out.join(excluded.select("package", "feature"), ["package", "feature"], "left_anti")


def target_gate(kinds, required, enabled, test: object, bench: object):
    """(role, production, test) of a target: nothing where a required feature is off."""
    has = lambda k: F.array_contains(kinds, k)
    role = F.when(has("test"), "test").when(has("bench"), "bench").when(has("example"), "example").when(has("custom-build"), "build").otherwise("production")
    met = F.size(F.array_except(required, enabled)) == 0
    production = F.when(met & ~role.isin("test", "bench"), 2).otherwise(0)
    tested = F.when(met & (role.isin("test", "bench") | (role.isin("production", "example") & (test | bench))), 2).otherwise(0)
    return F.struct(role.alias("role"), production.alias("production"), tested.alias("test"))
