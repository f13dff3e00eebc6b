"""What a build tool says: messages, unit graph and package metadata as tables.

The JSON comes from whoever ran the tool; decoding it is ``from_json`` with a fixed
schema, so unknown fields are no error and missing ones are NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TARGET = "struct<name: string, kind: array<string>, crate_types: array<string>, src_path: string, test: boolean, `required-features`: array<string>>"
MESSAGE = f"reason string, package_id string, manifest_path string, target {_TARGET}, profile struct<opt_level: string, debug_assertions: boolean, overflow_checks: boolean, test: boolean>, features array<string>, filenames array<string>, fresh boolean, message struct<level: string, message: string, rendered: string>, out_dir string, cfgs array<string>, success boolean"
UNIT_GRAPH = f"version int, units array<struct<pkg_id: string, target: {_TARGET}, platform: string, mode: string, features: array<string>>>"
_DEPENDENCY = "struct<name: string, rename: string, kind: string, target: string, optional: boolean, uses_default_features: boolean, features: array<string>, path: string>"
METADATA = f"packages array<struct<id: string, name: string, manifest_path: string, edition: string, features: map<string, array<string>>, targets: array<{_TARGET}>, dependencies: array<{_DEPENDENCY}>>>, workspace_members array<string>"
#: Levels of messages that make a target fail; lines of plain text and bytes of output that are kept.
FAILING, TEXT_LINES, OUTPUT_BYTES = ("error", "error: internal compiler error", "failure-note"), 32, 16 << 10


class BuildError(ValueError):
    pass


def folder(path):
    return F.regexp_replace(path, "/[^/]*$", "")


def messages(lines: DataFrame) -> dict[str, DataFrame]:
    """``lines``: number, line -> artifact, failure, script, finished and text tables."""
    m = lines.select("number", "line", F.from_json("line", MESSAGE).alias("m")).select("number", "line", "m.*")
    of = lambda reason: m.where(F.col("reason") == reason)
    target = [F.col("target.name").alias("target_name"), F.array_sort("target.kind").alias("target_kinds"), F.array_sort("target.crate_types").alias("target_crate_types"), F.col("target.src_path").alias("target_source")]
    artifact = of("compiler-artifact").select(F.col("number").alias("artifact"), "package_id", folder("manifest_path").alias("manifest_dir"), *target, F.col("profile.test").alias("profile_test"), "profile", F.array_sort("features").alias("features"), "filenames", "fresh")
    failure = of("compiler-message").where(F.col("message.level").isin(*FAILING)).select("package_id", folder("manifest_path").alias("manifest_dir"), *target, F.col("message.message").alias("message"))
    script = of("build-script-executed").select("package_id", "out_dir", F.array_sort("cfgs").alias("cfg"))
    finished = of("build-finished").select("success")
    text = m.where("reason is null and line <> ''").orderBy("number").limit(TEXT_LINES).select("number", "line")
    return {"artifact": artifact, "failure": failure, "script": script, "finished": finished, "text": text}


def _one(spark: SparkSession, text: str, schema: str):
    return spark.createDataFrame([(text,)], "j string").select(F.from_json("j", schema).alias("j")).select("j.*")


def expected_units(spark: SparkSession, text: str) -> DataFrame:
    """The multiset of units that a build should compile; running a build script is none."""
    graph = _one(spark, text, UNIT_GRAPH)
    version = graph.first()["version"]
    if version != 1:
        raise BuildError(f"unit graph version {version} is not supported")
    u = graph.select(F.explode("units").alias("u")).where("u.mode <> 'run-custom-build'")
    return u.select(F.col("u.pkg_id").alias("package_id"), F.col("u.target.name").alias("target_name"), F.array_sort("u.target.kind").alias("target_kinds"), F.array_sort("u.target.crate_types").alias("target_crate_types"), F.col("u.target.src_path").alias("target_source"), F.array_sort("u.features").alias("features"), F.col("u.platform").alias("platform"))


def metadata(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """package, target, member and dependency tables; a dependency's target is the
    workspace package in its folder, or NULL."""
    p = _one(spark, text, METADATA).select(F.explode("packages").alias("p"), "workspace_members").select("p.*", F.array_contains("workspace_members", F.col("p.id")).alias("own"))
    p = p.withColumn("root", folder("manifest_path"))
    package = p.select("id", "name", "root", "edition", "own")
    target = p.select(F.col("name").alias("package"), "root", F.explode("targets").alias("t")).select("package", "root", F.col("t.name").alias("target"), F.col("t.kind").alias("kinds"), "t.crate_types", "t.src_path", "t.test", F.coalesce(F.col("t.`required-features`"), F.array()).alias("required"))
    member = p.select(F.col("name").alias("package"), F.explode("features").alias("feature", "implies"))
    d = p.select(F.col("name").alias("package"), F.explode("dependencies").alias("d")).select("package", F.coalesce("d.rename", "d.name").alias("alias"), F.coalesce(F.when(F.col("d.kind") == "dev", "development").otherwise(F.col("d.kind")), F.lit("normal")).alias("kind"), F.col("d.target").alias("platform"), "d.optional", F.col("d.uses_default_features").alias("default_features"), "d.features", F.col("d.path").alias("path"))
    where = p.select(F.col("root").alias("path"), F.col("name").alias("target"), F.exists("targets", lambda t: F.array_contains(t["kind"], "proc-macro")).alias("proc_macro"))
    dependency = d.join(where, "path", "left").select("package", "alias", "target", "kind", "platform", "optional", "default_features", "features", F.coalesce("proc_macro", F.lit(False)).alias("proc_macro"))
    return {"package": package, "target": target, "member": member, "dependency": dependency}


def compiler_cfg(printed: str, true: list[str] = (), false: list[str] = ()) -> tuple[frozenset, frozenset, frozenset]:
    """(known true, known false, closed names) from a compiler's list of predicates and
    what is forced: false ones go before true ones come; forcing closes no name."""
    norm = lambda x: "=".join(p.strip('"') for p in "".join(x.split()).split("=", 1))
    listed, on, off = ({norm(x) for x in xs if x.strip()} for xs in (printed.splitlines(), true, false))
    if both := on & off:
        raise BuildError(f"{sorted(both)[0]} is forced both ways")
    return frozenset((listed - off) | on), frozenset(off), frozenset(x.split("=", 1)[0] for x in listed)


def supported(spark: SparkSession, ledger: list[dict]) -> DataFrame:
    """The compilers that are supported: release, commit_hash, commit_date, host; newest first, each once."""
    seen = set()
    for row in ledger:
        key = (row["release"], row["host"])
        if key in seen:
            raise BuildError(f"{row['release']} is listed twice for {row['host']}")
        seen.add(key)
    order = lambda r: tuple(int(x) for x in r["release"].split("-")[0].split("."))
    return spark.createDataFrame([(r["release"], r["commit_hash"], r["commit_date"], r["host"]) for r in sorted(ledger, key=order, reverse=True)], "release string, commit_hash string, commit_date string, host string")


def unsupported(invocation: DataFrame, ledger: DataFrame) -> DataFrame:
    """Invocations whose exact compiler isn't in the ledger."""
    keys = ["release", "commit_hash", "commit_date", "host"]
    return invocation.select("invocation", *[F.col(f"compiler.{k}").alias(k) for k in keys]).join(ledger, keys, "left_anti")
