"""Products of an audit, each behind a check that its evidence is complete.

What can't be said is absent, not empty: an incomplete input gives a status with the
first reason and no product."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import closed_world, correlate, facts, metrics, surface
from ..sources import build


def status(t: dict[str, DataFrame], correlated: DataFrame, issues: DataFrame, ledger: DataFrame) -> tuple[str, str | None]:
    """complete, partial or unavailable for the whole run, with the first reason."""
    product = t["product_status"].groupBy("invocation").agg(F.min("availability").alias("availability"), F.min("message").alias("message"))
    rows = correlated.join(product, "invocation", "left")
    ok = (F.col("status") == "correlated") & (F.col("availability") == "complete")
    own = rows.select(F.lit(1).alias("run"), "invocation", F.when(ok, "complete").when(F.col("status") == "correlated", F.coalesce("availability", F.lit("unavailable"))).otherwise("unavailable").alias("state"), F.when(~F.coalesce(ok, F.lit(False)), F.coalesce("message", F.concat(F.lit("invocation is "), F.col("status")))).alias("why"))
    out = metrics.status_rollup(own, ["run"], "state", "why", ["invocation"]).first()
    if out is None:
        return "unavailable", "no invocation"
    trouble = issues.select(F.col("issue").alias("m")).unionByName(ledger.select(F.lit("a unit's number differs from what was expected").alias("m"))).orderBy("m").first()
    if trouble is not None and out["status"] == "complete":
        return "partial", trouble["m"]
    return out["status"], out["reason"]


#: How a compiler names its levels of optimization, and how the build tool does.
OPTIMIZATION = {"none": "0", "less": "1", "more": "2", "aggressive": "3", "size": "s", "size_min": "z"}


def invocation_issues(t: dict[str, DataFrame], correlated: DataFrame, artifact: DataFrame, audit_target: str | None = None, requested_cfg: list[str] = ()) -> DataFrame:
    """(invocation, issue): what an invocation saw against what its artifact was built with.

    An invocation needs a profile and success; its features and code generation are
    those of its artifact; a host unit is of the host, any other of ``audit_target`` (if
    given) and has observed each of ``requested_cfg``."""
    built = artifact.select("artifact", F.col("features").alias("built"), F.col("profile").alias("built_profile"))
    i = t["invocation"].select("invocation", (F.col("compilation_context") == "host").alias("host")).join(correlated.select("invocation", "artifact"), "invocation")
    i = i.join(t["profile"].withColumn("profiled", F.lit(True)), "invocation", "left").join(built, "artifact", "left").join(t["finished"], "invocation", "left")
    level = F.coalesce(*[F.when(F.col("codegen.optimization") == k, F.lit(v)) for k, v in OPTIMIZATION.items()], F.col("codegen.optimization"))
    wanted = F.when(F.col("host"), F.col("host_triple")).otherwise(F.lit(audit_target).cast("string"))
    seen = F.transform("cfg", lambda c: F.when(c["value"].isNull(), c["name"]).otherwise(F.concat(c["name"], F.lit("="), c["value"])))
    rules = [
        ("there is no profile", F.col("profiled").isNull()),
        ("compiler did not succeed", ~F.coalesce("rustc_success", F.lit(False))),
        ("features differ from the build's", F.array_sort("features") != F.array_sort("built")),
        ("debug assertions differ from the build's", F.col("codegen.debug_assertions") != F.col("built_profile.debug_assertions")),
        ("overflow checks differ from the build's", F.col("codegen.overflow_checks") != F.col("built_profile.overflow_checks")),
        ("optimization differs from the build's", level != F.col("built_profile.opt_level")),
        ("target differs from the audit's", F.col("target_triple") != wanted),
    ]
    out = [i.where(F.coalesce(w, F.lit(False))).select("invocation", F.lit(m).alias("issue")) for m, w in rules]
    for text in requested_cfg:
        one = facts.normalized_predicate(F.lit(text))
        lacks = ~F.coalesce("host", F.lit(False)) & ~F.exists(F.coalesce(seen, F.array().cast("array<string>")), lambda c: c == one)
        out.append(i.where(lacks).select("invocation", F.concat(F.lit("requested cfg was not observed: "), one).alias("issue")))
    return reduce(DataFrame.unionByName, out).distinct()


#: What a producer of facts says of itself, and what has to agree.
HANDSHAKE = ("protocol_version", "driver_version", "linked_version", "release", "commit_hash", "commit_date", "host")


def handshake_issues(said: DataFrame, selected: DataFrame) -> DataFrame:
    """(field, expected, observed): where a producer isn't the one that was selected.

    Both have one row a ``producer`` with the fields of ``HANDSHAKE``; NULL agrees with NULL alone."""
    both = selected.select("producer", *[F.col(f).cast("string").alias(f"e_{f}") for f in HANDSHAKE]).join(said.select("producer", F.lit(True).alias("there"), *[F.col(f).cast("string").alias(f"o_{f}") for f in HANDSHAKE]), "producer", "left")
    fields = both.select("producer", "there", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"e_{f}").alias("expected"), F.col(f"o_{f}").alias("observed")) for f in HANDSHAKE])).alias("f"))
    silent = both.where("there is null").select("producer", F.lit("handshake").alias("field"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("observed"))
    return fields.where("there").select("producer", "f.*").where(~F.col("expected").eqNullSafe(F.col("observed"))).unionByName(silent)


def run(
    t: dict[str, DataFrame],
    targets: DataFrame,
    invocation: DataFrame,
    artifact: DataFrame,
    failure: DataFrame,
    expected: DataFrame | None = None,
    observed: DataFrame | None = None,
    *,
    scripts: DataFrame | None = None,
    ledger: DataFrame | None = None,
    audit_target: str | None = None,
    requested_cfg: list[str] = (),
) -> dict:
    """status, reason, and where complete the closed world and the API surface.

    ``scripts``: package_id, out_dir, cfg, what build scripts set; ``ledger``: the
    compilers that are supported.  Each rule that is broken is an issue, and with any
    issue nothing is said to be complete."""
    out = correlate.correlate(invocation, artifact, failure)
    units = facts.ledger(expected, observed, correlate.UNIT) if expected is not None else out["issues"].where("false")
    issues = out["issues"].select("issue")
    if "profile" in artifact.columns and "features" in artifact.columns:
        issues = issues.unionByName(invocation_issues(t, out["correlated"], artifact, audit_target, requested_cfg).select("issue"))
    if expected is not None:
        issues = issues.unionByName(correlate.missing_failed(expected, observed, failure).select(F.lit("a failed unit left no facts").alias("issue")))
    if scripts is not None:
        seen = t["invocation"].select("invocation", F.col("build_script_out_dir").alias("out_dir")).join(t["profile"].select("invocation", F.transform("cfg", lambda c: F.when(c["value"].isNull(), c["name"]).otherwise(F.concat(c["name"], F.lit("="), c["value"]))).alias("cfg")), "invocation").join(out["correlated"].select("invocation", "package_id"), "invocation")
        issues = issues.unionByName(correlate.script_cfg(scripts, seen.select("package_id", "out_dir", "cfg")).select(F.lit("a build script's cfg was not observed").alias("issue")))
    if ledger is not None:
        issues = issues.unionByName(build.unsupported(t["invocation"], ledger).select(F.lit("compiler is not in the ledger").alias("issue")))
    state, reason = status(t, out["correlated"], issues, units)
    result = {"status": state, "reason": reason, "correlated": out["correlated"], "issues": issues, "closed_world": None, "surface": None}
    if state == "complete":
        world = closed_world.analyze(t, targets)
        broken = world["errors"].select("message").orderBy("message").first()
        if broken is None:
            api = surface.surface(t, targets)
            clash = api["errors"].select("message").orderBy("message").first()
            result |= {"closed_world": world, "surface": api if clash is None else None, "reason": clash and clash["message"]}
        else:
            result |= {"status": "partial", "reason": broken["message"]}
    return result


def compared(before: dict, after: dict, same_compiler: bool, unchanged: bool = True) -> DataFrame | None:
    """The change log; None unless both sides are complete, by one compiler, and the
    working tree stayed as it was (``sources.revision.fingerprint`` before and after)."""
    if before["surface"] is None or after["surface"] is None or not same_compiler or not unchanged:
        return None
    return surface.diff(before["surface"], after["surface"])


def same_compiler(before: DataFrame, after: DataFrame) -> bool:
    """Whether all invocations of both sides are of one exact compiler."""
    keys = ["release", "commit_hash", "commit_date", "host"]
    each = lambda t: t.select(*[F.col(f"compiler.{k}").alias(k) for k in keys])
    return each(before).unionByName(each(after)).distinct().limit(2).count() == 1
