"""Invocations of a compiler matched with what the build says it made.

Tables: invocation (invocation, merge_key, manifest_dir, input, test_mode, crate_types,
crate_name, extra_filename), artifact (artifact, manifest_dir, target_source,
profile_test, crate_types, filenames, package_id, target_name, target_kinds), failure
(package_id, manifest_dir, target_source, target_name, target_kinds, target_crate_types).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import facts

#: The seven fields that make a unit; two equal units are two units.
UNIT = ["package_id", "target_name", "target_kinds", "target_crate_types", "target_source", "features", "platform"]


def selected(invocation: DataFrame, roots: DataFrame) -> DataFrame:
    return invocation.join(roots.select(F.col("root").alias("manifest_dir")).distinct(), "manifest_dir", "left_semi")


def _stem(path):
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def matches(invocation: DataFrame, artifact: DataFrame) -> DataFrame:
    """(invocation, artifact): equal folder, source and mode by an equi-join; then the
    crate types, and an output whose stem is the crate's name with its suffix."""
    i, a = invocation.alias("i"), artifact.alias("a")
    met = i.join(a, (F.col("i.manifest_dir") == F.col("a.manifest_dir")) & (F.col("i.input") == F.col("a.target_source")) & (F.col("i.test_mode") == F.col("a.profile_test")))
    kinds = lambda c: F.array_sort(F.transform(c, lambda x: F.when(x == "lib", "rlib").otherwise(x)))
    types = F.col("i.test_mode") | (kinds(F.col("i.crate_types")) == kinds(F.col("a.crate_types")))
    made = F.concat(F.col("i.crate_name"), F.coalesce("i.extra_filename", F.lit("")))
    named = F.exists("a.filenames", lambda f: (_stem(f) == made) | (_stem(f) == F.concat(F.lit("lib"), made)))
    return met.where(types & named).select("i.invocation", "a.artifact", "a.package_id", "a.target_name", "a.target_kinds")


def correlate(invocation: DataFrame, artifact: DataFrame, failure: DataFrame) -> dict[str, DataFrame]:
    """correlated: each invocation with its target and status (correlated, failed,
    unmatched or ambiguous); issues: repeated ids and keys, artifacts without an
    invocation and such that several claim."""
    met = matches(invocation, artifact)
    counted = met.groupBy("invocation").agg(F.count("*").alias("n"), F.min(F.struct("artifact", "package_id", "target_name", "target_kinds")).alias("m"))
    failed = failure.groupBy("manifest_dir", F.col("target_source").alias("input")).agg(F.count("*").alias("f"), F.min(F.struct("package_id", "target_name", "target_kinds")).alias("t"))
    rows = invocation.join(counted, "invocation", "left").join(failed, ["manifest_dir", "input"], "left")
    status = F.when(F.col("n") == 1, "correlated").when(F.col("n") > 1, "ambiguous").when(F.col("f") == 1, "failed").otherwise("unmatched")
    one = lambda c: F.when(status == "correlated", F.col(f"m.{c}")).when(status == "failed", F.col(f"t.{c}"))
    out = rows.select("invocation", status.alias("status"), F.when(status == "correlated", F.col("m.artifact")).alias("artifact"), *[one(c).alias(c) for c in ("package_id", "target_name", "target_kinds")])
    say = lambda df, what, text: df.select(F.lit(text).alias("issue"), F.col(what).cast("string").alias("about"))
    issues = say(facts.duplicates(invocation, ["invocation"]), "invocation", "invocation id occurs twice")
    issues = issues.unionByName(say(facts.duplicates(invocation.where("merge_key is not null"), ["merge_key"]), "merge_key", "merge key occurs twice"))
    issues = issues.unionByName(say(artifact.join(met, "artifact", "left_anti"), "artifact", "artifact has no invocation"))
    issues = issues.unionByName(say(facts.duplicates(met.select("artifact", "invocation").distinct(), ["artifact"]), "artifact", "artifact is claimed by several invocations"))
    return {"correlated": out, "issues": issues}


def unit_ledger(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Units whose number differs from what was expected.  Platforms may be NULL."""
    return facts.ledger(expected, observed, UNIT)


def missing_failed(expected: DataFrame, observed: DataFrame, failure: DataFrame) -> DataFrame:
    """(unit, missing): how many facts the units of failed targets lack."""
    e = expected.groupBy(*UNIT).agg(F.count("*").alias("expected"))
    o = observed.groupBy(*UNIT).agg(F.count("*").alias("observed"))
    keys = ["package_id", "target_name", "target_kinds", "target_crate_types", "target_source"]
    failed = e.join(failure.select(*keys).distinct(), keys, "left_semi")
    left, right = failed.alias("e"), o.alias("o")
    on = F.lit(True)
    for k in UNIT:
        on = on & F.col(f"e.{k}").eqNullSafe(F.col(f"o.{k}"))
    missing = F.greatest(F.col("expected") - F.coalesce("observed", F.lit(0)), F.lit(0)).cast("long")
    return left.join(right, on, "left").select(*[F.col(f"e.{k}").alias(k) for k in UNIT], missing.alias("missing")).where("missing > 0")


def script_cfg(outputs: DataFrame, profile: DataFrame) -> DataFrame:
    """(package_id, cfg): what a build script sets and the unit over the same folder
    doesn't observe.  outputs: package_id, out_dir, cfg; profile: package_id, out_dir, cfg."""
    want = outputs.select("package_id", "out_dir", F.explode("cfg").alias("c")).select("package_id", "out_dir", facts.normalized_predicate(F.col("c")).alias("cfg"))
    seen = profile.select("package_id", "out_dir", F.explode("cfg").alias("c")).select("package_id", "out_dir", facts.normalized_predicate(F.col("c")).alias("cfg"))
    used = want.join(profile.select("package_id", "out_dir").distinct(), ["package_id", "out_dir"], "left_semi")
    return used.join(seen, ["package_id", "out_dir", "cfg"], "left_anti").select("package_id", "cfg")
