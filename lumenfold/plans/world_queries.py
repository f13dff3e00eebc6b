"""Features, workspaces, API surfaces and the closed world on tables that are written from
the sales tables by a fixed rule, each beside the SQL that says what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import closed_world, features, surface, workspace
from ..sources import build, manifest, selectors, tree
from . import audit, snapshot
from .analogues import query, table
from .source_queries import _module_tree

# -- features


def _name(k: Column) -> Column:
    return F.concat(F.lit("n"), k.cast("string"))


def _dependency(spark, sf_dir) -> DataFrame:
    """Each nation depends on the one five numbers on, in a way that its number names."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").where(k + 5 <= 24).select(
        _name(k).alias("package"), F.lit("next").alias("alias"), _name(k + 5).alias("target"), F.when(k % 3 == 1, "build").otherwise("normal").alias("kind"), F.lit(True).alias("host_match"), (k % 11 != 10).alias("target_match"),
        (k % 2 == 1).alias("optional"), (k % 4 != 3).alias("default_features"), F.when(k % 4 == 0, F.array(F.lit("extra"))).otherwise(F.array().cast("array<string>")).alias("features"), F.lit(False).alias("proc_macro"),
    )


def _member(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    more = F.when(k % 7 == 2, F.array(F.lit("base"), F.lit("link"))).when(k % 7 == 3, F.array(F.lit("base"), F.lit("plain"))).when(k % 7 == 5, F.array(F.lit("base"), F.lit("weak"))).otherwise(F.array(F.lit("base")))
    rules = F.array(
        F.struct(F.lit("default").alias("feature"), more.alias("implies")),
        F.struct(F.lit("base").alias("feature"), F.array().cast("array<string>").alias("implies")),
        *[F.struct(F.lit(f).alias("feature"), F.array(F.lit(i)).alias("implies")) for f, i in (("extra", "dep:next"), ("link", "next/base"), ("weak", "next?/extra"), ("plain", "extra"))],
    )
    return table(spark, sf_dir, "nation").select(_name(k).alias("package"), F.explode(rules).alias("r")).select("package", "r.feature", "r.implies")


_CHAIN = """
WITH RECURSIVE s(k, ctx, d, x, b) AS (
  SELECT n_nationkey, 'target', true, false, false FROM nation WHERE n_nationkey < 5
  UNION ALL SELECT k + 5, CASE WHEN k % 3 = 1 THEN 'host' ELSE ctx END, k % 4 <> 3, (k % 4 = 0) OR (d AND k % 7 = 5), d AND k % 7 = 2 FROM s
  WHERE k + 5 <= 24 AND (ctx = 'host' OR k % 3 = 1 OR k % 11 <> 10) AND (k % 2 = 0 OR x OR (d AND k % 7 IN (2, 3)))),
f AS (SELECT 'n' || k AS package, ctx AS context, unnest(list_filter([CASE WHEN d THEN 'default' END, CASE WHEN d OR b THEN 'base' END, CASE WHEN d AND k % 7 = 2 THEN 'link' END, CASE WHEN d AND k % 7 = 3 THEN 'plain' END,
  CASE WHEN d AND k % 7 = 5 THEN 'weak' END, CASE WHEN x OR (d AND k % 7 = 3) THEN 'extra' END], lambda v: v IS NOT NULL)) AS feature FROM s)"""


def _roots(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").where("n_nationkey < 5").select(_name(F.col("n_nationkey")).alias("package"), F.lit("target").alias("context"))


@query(f"{_CHAIN} SELECT * FROM f WHERE NOT (package = 'n5' AND feature = 'base')")
def q43_features(spark, sf_dir):
    """Features and contexts to a fixed point, exclusions at the end."""
    excluded = spark.createDataFrame([("n5", "base")], "package string, feature string")
    roots = _roots(spark, sf_dir)
    return features.resolve(_member(spark, sf_dir), _dependency(spark, sf_dir), roots, roots.withColumn("feature", F.lit("default")), excluded)


@query("""
WITH RECURSIVE r(k, ctx) AS (SELECT n_nationkey, 'target' FROM nation WHERE n_nationkey < 5 UNION ALL SELECT k + 5, CASE WHEN k % 3 = 1 THEN 'host' ELSE ctx END FROM r WHERE k + 5 <= 24 AND (ctx = 'host' OR k % 3 = 1 OR k % 11 <> 10))
SELECT 'reached' AS what, 'n' || k AS package, ctx AS context, '' AS feature FROM r
UNION ALL SELECT 'seed', 'n' || n_nationkey, 'target', f FROM nation, (VALUES ('default'), ('plain')) v(f) WHERE n_nationkey < 5
UNION ALL SELECT 'seed', 'n7', ctx, 'link' FROM r WHERE k = 7
UNION ALL SELECT 'active', 'n7', ctx, '' FROM r WHERE k = 7
UNION ALL SELECT 'mode', 'default+selected-excluded', '', ''""")
def q44_feature_seeds(spark, sf_dir):
    """What is reached, and what a request seeds by itself."""
    roots, dependency = _roots(spark, sf_dir), _dependency(spark, sf_dir)
    edges = features.matching(dependency, roots)
    reached = features.reachable(edges, roots)
    seeds, active = workspace.seeds(roots, _member(spark, sf_dir), edges, reached, selectors=["plain", "n7/link"])
    row = lambda df, what, feature: df.select(F.lit(what).alias("what"), "package", "context", feature.alias("feature"))
    out = row(reached, "reached", F.lit("")).unionByName(row(seeds, "seed", F.col("feature"))).unionByName(row(active, "active", F.lit("")))
    return out.unionByName(spark.createDataFrame([("mode", features.feature_mode(False, False, True, True), "", "")], out.schema))


def _packages(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(package, target, manifest) tables: a package for each nation, with five targets."""
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    root = F.concat(F.lit("w/r"), F.col("n_regionkey").cast("string"), F.lit("/n"), k.cast("string"))
    package = n.select(_name(k).alias("package"), root.alias("root"))
    main = F.when(k % 6 == 0, "proc-macro").otherwise("lib")
    one = lambda name, kind, file, test, required: F.struct(F.lit(name).alias("target"), F.array(kind).alias("kinds"), F.concat(root, F.lit(f"/{file}")).alias("src_path"), F.lit(test).alias("test"), F.array(*map(F.lit, required)).cast("array<string>").alias("required"))
    targets = F.array(one("it", main, "src/lib.rs", True, []), one("tool", F.lit("bin"), "src/main.rs", False, ["extra"]), one("t", F.lit("test"), "tests/t.rs", True, []), one("b", F.lit("bench"), "benches/b.rs", False, []), one("ex", F.lit("example"), "examples/ex.rs", False, []), one("build-script-build", F.lit("custom-build"), "build.rs", False, []))
    target = n.select(_name(k).alias("package"), root.alias("root"), F.explode(targets).alias("t")).select("package", "root", "t.*")
    text = F.concat(F.when(k % 2 == 0, "[lib]\nbench = false\n").otherwise(""), F.when(k % 3 == 0, '[[bin]]\nname = "other"\n[[bin]]\nname = "tool"\nbench = false\n').otherwise(""), F.when(k % 4 == 0, '[[example]]\npath = "examples/../examples/ex.rs"\nbench = true\n').otherwise(""), F.when(k == 24, "[broken\n").otherwise(""))
    return package, target, n.select(root.alias("root"), text.cast("binary").alias("content"))


@query("""
WITH n AS (SELECT n_nationkey AS k, 'n' || n_nationkey AS package, 'w/r' || n_regionkey || '/n' || n_nationkey AS root FROM nation),
sel AS (SELECT * FROM n WHERE root LIKE 'w/r0/%' OR root LIKE 'w/r1/%' OR package = 'n8'),
t AS (SELECT k, package, root, unnest([{'f': '/src/lib.rs', 'r': 'production', 'p': 2, 't': 2}, {'f': '/src/main.rs', 'r': 'production', 'p': CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END, 't': CASE WHEN k % 2 = 0 AND (k % 3 <> 0 OR k = 24) THEN 2 ELSE 0 END},
  {'f': '/tests/t.rs', 'r': 'test', 'p': 0, 't': 2}, {'f': '/benches/b.rs', 'r': 'bench', 'p': 0, 't': 2}, {'f': '/examples/ex.rs', 'r': 'example', 'p': 2, 't': CASE WHEN k % 4 = 0 AND k <> 24 THEN 2 ELSE 0 END}, {'f': '/build.rs', 'r': 'build', 'p': 2, 't': 0}]) AS g FROM sel)
SELECT 'target' AS what, package, root || g.f AS path, g.r AS role, CAST(g.p AS INT) AS production, CAST(g.t AS INT) AS test FROM t
UNION ALL SELECT 'context', package, CASE WHEN k % 6 = 0 THEN 'host' ELSE 'target' END, '', 0, 0 FROM sel UNION ALL SELECT 'context', package, 'target', '', 0, 0 FROM sel WHERE k % 6 = 0
UNION ALL SELECT 'manifest', '', root, 'error', 0, 0 FROM n WHERE k = 24""")
def q45_workspace_targets(spark, sf_dir):
    """Packages by path, their contexts and the gates of their targets."""
    package, target, manifests = _packages(spark, sf_dir)
    requested = spark.createDataFrame([("w/r0", True), ("w/r1", True)], "path string, is_folder boolean")
    one = package.where("package = 'n8'").select(F.concat("root", F.lit("/src/deep/x.rs")).alias("path"), F.lit(False).alias("is_folder"))
    chosen = workspace.selected(package, requested.unionByName(one))
    tables = manifest.read(manifests)
    enabled = package.where("cast(substring(package, 2) as int) % 2 = 0").select("package", F.lit("extra").alias("feature"))
    gates = workspace.target_seeds(manifest.bench_enabled(target, tables), chosen, enabled)
    contexts = workspace.root_contexts(chosen, target)
    zero = [F.lit(0).alias("production"), F.lit(0).alias("test")]
    out = gates.select(F.lit("target").alias("what"), "package", "path", "role", "production", "test")
    out = out.unionByName(contexts.select(F.lit("context").alias("what"), "package", F.col("context").alias("path"), F.lit("").alias("role"), *zero))
    return out.unionByName(tables.where("error is not null").select(F.lit("manifest").alias("what"), F.lit("").alias("package"), F.col("root").alias("path"), F.lit("error").alias("role"), *zero))


# -- files that only edges reach, selectors, ignore rules, build messages


@query("""
WITH n AS (SELECT n_nationkey AS k, 'r' || n_regionkey || '/src/' AS d FROM nation),
x AS (SELECT d, count(*) FILTER (WHERE k % 3 <> 0) + count(*) FILTER (WHERE k % 3 <> 0 AND k % 5 = 0) AS p, 2 * count(*) FILTER (WHERE k % 3 = 0) + count(*) FILTER (WHERE k % 3 = 0 AND k % 5 = 0) AS t, count(*) FILTER (WHERE k % 5 <> 0 AND k % 4 = 2) AS lost,
  count(*) FILTER (WHERE k % 5 = 0 OR k % 4 <> 2) + count(DISTINCT CASE WHEN k % 5 <> 0 AND k % 4 IN (0, 3) AND k % 2 = 0 THEN 1 END) AS found FROM n GROUP BY d)
SELECT d || 'lib.rs' AS path, CAST(p AS BIGINT) AS production, CAST(t AS BIGINT) AS test, CAST(lost AS BIGINT) AS lost FROM x
UNION ALL SELECT 'found', CAST(sum(found) AS BIGINT), 0, 0 FROM x""")
def q46_reached_files(spark, sf_dir):
    """Files that only module edges reach are measured and not reported."""
    all_files = _module_tree(spark, sf_dir)
    first = snapshot.measured(all_files.where("path like '%/lib.rs'"))
    whole = snapshot.expanded(first, lambda wanted: all_files.join(wanted, ["snapshot", "path"], "left_semi"))
    # Of several candidates that exist only the first is a module; the others are loaded and stay outside.
    edges, _ = snapshot.resolved(whole)
    met = edges.select("dst").distinct().count()
    made = snapshot.report(whole)
    code = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("code"))), F.lit(0)).cast("long").alias(role)
    lost = made["diagnostics"].groupBy("path").agg(F.count("*").alias("lost"))
    out = made["roles"].groupBy("path").agg(code("production"), code("test")).join(lost, "path", "left").na.fill(0)
    return out.unionByName(spark.createDataFrame([("found", met, 0, 0)], out.schema))


@query(r"""
WITH t AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN p_brand || ':' || p_name || '::x' WHEN 1 THEN p_brand || ':' WHEN 2 THEN ' ' || p_brand || ':a' WHEN 3 THEN p_brand ELSE p_brand || ':src/a:b.rs:' || p_size || ':' || p_partkey END AS s FROM part)
SELECT k AS p_partkey, s AS text, CASE WHEN k % 5 IN (0, 4) THEN split_part(s, ':', 1) END AS package, CASE WHEN k % 5 IN (0, 4) THEN s[strpos(s, ':') + 1:] END AS item,
  CASE WHEN k % 5 = 4 THEN s[:length(s) - length(regexp_extract(s, ':[0-9]+:[0-9]+$'))] END AS file, CASE WHEN k % 5 = 4 THEN CAST(regexp_extract(s, ':([0-9]+):[0-9]+$', 1) AS INT) END AS line, CASE WHEN k % 5 = 4 THEN CAST(k AS INT) END AS col FROM t""")
def q47_selectors(spark, sf_dir):
    """What users name: items by the first colon, places by the last two."""
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.concat("p_brand", F.lit(":"), "p_name", F.lit("::x"))).when(k % 5 == 1, F.concat("p_brand", F.lit(":"))).when(k % 5 == 2, F.concat(F.lit(" "), "p_brand", F.lit(":a"))).when(k % 5 == 3, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit(":src/a:b.rs:"), F.col("p_size").cast("string"), F.lit(":"), k.cast("string")))
    return selectors.parsed(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text").select("p_partkey", "text", "package", "item", "file", "line", F.col("column").alias("col"))


@query("""
WITH f AS (SELECT 'r' || (p_partkey % 5) || CASE p_partkey % 7 WHEN 0 THEN '/target/x' WHEN 1 THEN '/src/keep' WHEN 2 THEN '/src/gen_' WHEN 3 THEN '/.hidden/x' WHEN 4 THEN '/deep/a/tmp' ELSE '/src/x' END || p_partkey || CASE WHEN p_partkey % 6 = 5 THEN '.txt' ELSE '.rs' END AS path, p_partkey AS k FROM part)
SELECT path FROM f WHERE k % 6 <> 5 AND k % 7 NOT IN (0, 3) AND NOT (k % 7 = 2 AND NOT k % 5 = 3) AND NOT (k % 7 = 4 AND k % 5 = 2)""")
def q48_ignore_rules(spark, sf_dir):
    """Paths that discovery finds under ignore files, the deepest one first."""
    k = F.col("p_partkey")
    middle = F.when(k % 7 == 0, "/target/x").when(k % 7 == 1, "/src/keep").when(k % 7 == 2, "/src/gen_").when(k % 7 == 3, "/.hidden/x").when(k % 7 == 4, "/deep/a/tmp").otherwise("/src/x")
    paths = table(spark, sf_dir, "part").select(F.concat(F.lit("r"), (k % 5).cast("string"), middle, k.cast("string"), F.when(k % 6 == 5, ".txt").otherwise(".rs")).alias("path"))
    return tree.fitting(paths, {"": "target/\n**/gen_*\n[b-a]\n", "r3": "!gen_*\n", "r2": "/deep/**/tmp*.rs\n"})


@query("""
WITH s AS (SELECT s_suppkey AS k FROM supplier)
SELECT 'artifact' AS what, count(*) AS rows, CAST(sum(k) AS BIGINT) AS keys FROM s WHERE k % 6 = 0
UNION ALL SELECT 'failure', count(*), CAST(sum(k) AS BIGINT) FROM s WHERE k % 6 = 1 AND k % 4 <> 0
UNION ALL SELECT 'script', count(*), CAST(sum(k) AS BIGINT) FROM s WHERE k % 6 = 2
UNION ALL SELECT 'finished', count(*), NULL FROM s WHERE k % 6 = 3
UNION ALL SELECT 'text', least(count(*), 32), NULL FROM s WHERE k % 6 = 4
UNION ALL SELECT 'units', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation WHERE n_nationkey % 3 <> 0
UNION ALL SELECT 'packages', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation
UNION ALL SELECT 'dependencies', count(*), CAST(sum(n_nationkey + 1) AS BIGINT) FROM nation WHERE n_nationkey < 24""")
def q49_build_messages(spark, sf_dir):
    """Messages, unit graph and package metadata as tables."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    t = F.struct(F.concat(F.lit("c"), k.cast("string")).alias("name"), F.array(F.lit("lib")).alias("kind"), F.array(F.lit("lib")).alias("crate_types"), F.lit("/w/src/lib.rs").alias("src_path"))
    say = lambda reason, **more: F.to_json(F.struct(F.lit(reason).alias("reason"), k.cast("string").alias("package_id"), F.lit("/w/Cargo.toml").alias("manifest_path"), t.alias("target"), *[v.alias(n) for n, v in more.items()]))
    level = F.when(k % 4 == 0, "warning").otherwise("error")
    line = F.when(k % 6 == 0, say("compiler-artifact", filenames=F.array(F.lit("/t/x")))).when(k % 6 == 1, say("compiler-message", message=F.struct(level.alias("level"), F.lit("no").alias("message")))).when(k % 6 == 2, say("build-script-executed", out_dir=F.lit("/o"), cfgs=F.array(F.lit("b"), F.lit("a")))).when(k % 6 == 3, F.lit('{"reason":"build-finished","success":true}')).when(k % 6 == 4, F.lit("plain words")).otherwise(F.lit('{"reason":"unknown"}'))
    out = build.messages(s.select(k.cast("int").alias("number"), line.alias("line")))
    keyed = lambda df, what, key: df.agg(F.lit(what).alias("what"), F.count("*").alias("rows"), F.sum(F.col(key).cast("long")).alias("keys") if key else F.lit(None).cast("long").alias("keys"))
    n = table(spark, sf_dir, "nation")
    u = n.select(F.struct(F.col("n_nationkey").cast("string").alias("pkg_id"), F.struct(F.lit("t").alias("name"), F.array(F.lit("lib")).alias("kind")).alias("target"), F.when(F.col("n_nationkey") % 3 == 0, "run-custom-build").otherwise("build").alias("mode")).alias("u")).agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list("u").alias("units"))).alias("j")).first()["j"]
    path = lambda x: F.concat(F.lit("/w/n"), x.cast("string"))
    dep = F.when(F.col("n_nationkey") < 24, F.array(F.struct(F.lit("d").alias("name"), path(F.col("n_nationkey") + 1).alias("path")))).otherwise(F.array().cast("array<struct<name: string, path: string>>"))
    p = n.select(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_nationkey").cast("string").alias("name"), F.concat(path(F.col("n_nationkey")), F.lit("/Cargo.toml")).alias("manifest_path"), F.array().cast("array<struct<name: string, kind: array<string>>>").alias("targets"), dep.alias("dependencies")).alias("p")).agg(F.to_json(F.struct(F.collect_list("p").alias("packages"), F.collect_list("p.id").alias("workspace_members"))).alias("j")).first()["j"]
    meta = build.metadata(spark, p)
    parts = [keyed(out["artifact"], "artifact", "package_id"), keyed(out["failure"], "failure", "package_id"), keyed(out["script"], "script", "package_id"), keyed(out["finished"], "finished", None), keyed(out["text"], "text", None), keyed(build.expected_units(spark, u), "units", "package_id"), keyed(meta["package"], "packages", "name"), keyed(meta["dependency"].where("target is not null"), "dependencies", "target")]
    total = parts[0]
    for x in parts[1:]:
        total = total.unionByName(x)
    return total


# -- the closed world


def _hex(crate: int, local: Column) -> Column:
    return F.concat(F.lit(f"{crate:016x}"), F.lpad(F.lower(F.hex(local)), 16, "0"))


def _world(spark, sf_dir) -> tuple[dict[str, DataFrame], DataFrame]:
    """Facts of three builds: a library, its tests, and a program that uses it.

    The library has a public function for each part; the tests' build has them all, the
    plain one all but each nineteenth."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k)
    ends = parts.agg(F.max(k).alias("top"))
    span = lambda at: F.struct(F.lit("s").alias("file"), at.cast("long").alias("start"), (at + 5).cast("long").alias("end"), at.cast("int").alias("line"), F.lit(1).alias("column"))
    none = F.lit(None).cast("struct<file: string, start: bigint, end: bigint, line: int, column: int>")

    def define(inv: str, crate: int, rows: DataFrame, local: Column, path: Column, kind: str, at: Column, parent: Column) -> DataFrame:
        return rows.select(
            F.lit(inv).alias("invocation"), F.concat(F.lit(f"{inv}-d"), local.cast("string")).alias("id"), _hex(crate, local).alias("compiler_id"), parent.alias("parent"), path.alias("name"), path.alias("definition_path"), F.lit(kind).alias("kind"),
            F.lit(kind != "crate").alias("visibility_editable"), F.lit("public").alias("nominal_visibility"), F.lit(True).alias("externally_reachable"), at.alias("span"), none.alias("attribution_callsite"), F.lit("authored").alias("expansion_origin"),
        )

    builds = {"lib": (1, parts.where(k % 19 != 0)), "libtest": (1, parts)}
    one = spark.range(1).select(F.lit(0).cast("long").alias("z"))
    root_of = lambda crate: _hex(crate, F.lit(0).cast("long"))
    definition = define("app", 2, one, F.col("z"), F.lit("app"), "crate", none, F.lit(None).cast("string")).unionByName(define("app", 2, one, F.col("z") + 1, F.lit("app::main"), "function", span(F.lit(1)), root_of(2)))
    reference = None
    refer = lambda inv, rows, a, b, kind: rows.select(F.lit(inv).alias("invocation"), F.concat_ws("-", F.lit(inv), F.lit(kind), a, b).alias("id"), a.alias("from"), b.alias("to"), F.lit(kind).alias("kind"), none.alias("span"))
    for inv, (crate, rows) in builds.items():
        definition = definition.unionByName(define(inv, crate, one, F.col("z"), F.lit("c"), "crate", none, F.lit(None).cast("string"))).unionByName(define(inv, crate, rows, k + 1, F.concat(F.lit("c::f"), k.cast("string")), "function", span(k * 10), root_of(crate)))
        inner = rows.crossJoin(ends)  # one row
        calls = refer(inv, inner.where((k % 3 == 0) & (k + 1 <= F.col("top"))), _hex(1, k + 1), _hex(1, k + 2), "body")
        shown = refer(inv, inner.where((k % 7 == 0) & (k + 2 <= F.col("top"))), _hex(1, k + 1), _hex(1, k + 3), "interface")
        reference = calls.unionByName(shown) if reference is None else reference.unionByName(calls).unionByName(shown)
    reference = reference.unionByName(refer("app", parts.where(k % 11 == 0), F.lit(f"{2:016x}{1:016x}"), _hex(1, k + 1), "body"))
    named = lambda inv, rows, d, kind, reason: rows.select(F.lit(inv).alias("invocation"), F.concat_ws("-", F.lit(inv), F.lit(kind), d).alias("id"), d.alias("definition"), F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    lib = builds["lib"][1]
    root = named("app", one, F.lit(f"{2:016x}{1:016x}"), "entry", "main").unionByName(named("libtest", parts.where(k % 5 == 0), _hex(1, k + 1), "entry", "test"))
    root = root.unionByName(named("lib", lib.where(k % 13 == 0), _hex(1, k + 1), "required_public", "named")).unionByName(named("lib", lib.where(k % 17 == 0), _hex(1, k + 1), "conservative", closed_world.ALLOWED_DEAD))
    sources = spark.createDataFrame([(i, "s", f"/w/{p}/src/lib.rs", None, 10**9, False) for i, p in (("lib", "c"), ("libtest", "c"), ("app", "app"))], "invocation string, key string, local_path string, remapped_path string, byte_len long, generated boolean")
    targets = spark.createDataFrame([("lib", "c", "p/c", "c", ["lib"], "production", "target"), ("libtest", "c", "p/c", "c", ["lib"], "unit_test", "target"), ("app", "app", "p/app", "app", ["bin"], "production", "target")], "invocation string, package string, package_path string, target string, kinds array<string>, role string, context string")
    return {"definition": definition, "reference": reference, "root": root, "source_file": sources}, targets


_STATES = """
WITH RECURSIVE p AS (SELECT p_partkey AS k FROM part), st AS (SELECT 'lib' AS i, k FROM p WHERE k % 19 <> 0 UNION ALL SELECT 'libtest', k FROM p),
raw AS (SELECT i, k, k + 1 AS t, 'body' AS kind FROM st WHERE k % 3 = 0 UNION ALL SELECT i, k, k + 2, 'interface' FROM st WHERE k % 7 = 0),
e AS (SELECT r.i AS si, r.k AS sk, d.i AS di, d.k AS dk, kind FROM raw r JOIN st d ON d.k = r.t AND (d.i = r.i OR NOT EXISTS (SELECT 1 FROM st x WHERE x.i = r.i AND x.k = r.t))),
app AS (SELECT i, k FROM st WHERE k % 11 = 0),
starts AS (SELECT 'production' AS class, i, k FROM app UNION SELECT 'production', 'lib', k FROM st WHERE i = 'lib' AND k % 17 = 0 UNION SELECT 'nonproduction', 'libtest', k FROM p WHERE k % 5 = 0),
live(class, i, k) AS (SELECT * FROM starts UNION SELECT class, di, dk FROM live JOIN e ON si = i AND sk = k),
alive AS (SELECT k, bool_or(class = 'production') AS lp, bool_or(class = 'nonproduction') AS ln FROM live GROUP BY k),
base AS (SELECT DISTINCT k FROM p WHERE k % 11 = 0 OR (k % 13 = 0 AND k % 19 <> 0)),
need(k) AS (SELECT k FROM base UNION SELECT dk FROM need JOIN e ON sk = k AND kind = 'interface'),
found AS (SELECT k, CASE WHEN coalesce(lp, false) OR coalesce(ln, false) THEN 'unnecessary_public' ELSE 'dead' END AS finding, coalesce(lp, false) AS lp, coalesce(ln, false) AS ln FROM p LEFT JOIN alive USING (k) WHERE k NOT IN (SELECT k FROM need) AND NOT (k % 17 = 0 AND k % 19 <> 0))"""


@query(f"""{_STATES}
SELECT 'c::f' || k AS definition_path, finding, lp AS live_production, ln AS live_nonproduction, k % 19 = 0 AS test_compiled_only FROM found""")
def q50_public_findings(spark, sf_dir):
    """Public items that nothing keeps public."""
    a = closed_world.analyze(*_world(spark, sf_dir))
    return a["findings"].select("definition_path", "finding", "live_production", "live_nonproduction", "test_compiled_only")


@query(f"""{_STATES}
SELECT 'c::f' || k AS definition_path, array_to_string(list_sort(list_filter([CASE WHEN k % 13 = 0 AND k % 19 <> 0 THEN 'named' END, CASE WHEN k % 11 = 0 THEN '{closed_world.CROSS_CRATE}' END,
  CASE WHEN k % 19 <> 0 OR k IN (SELECT dk FROM e JOIN need n ON sk = n.k WHERE kind = 'interface') THEN '{closed_world.SPREAD}' END], lambda x: x IS NOT NULL)), '; ') AS reasons FROM need""")
def q51_required_items(spark, sf_dir):
    """Items that have to stay public, each with all of its reasons."""
    a = closed_world.analyze(*_world(spark, sf_dir))
    return closed_world.required_visibility(a).select("definition_path", F.array_join("reasons", "; ").alias("reasons"))


@query(f"""{_STATES}
SELECT (SELECT count(*) FROM p) + 4 AS definition_nodes, (SELECT count(*) FROM e) + (SELECT count(*) FROM app) AS reference_edges,
  (SELECT count(*) FROM starts WHERE class = 'production') + 1 AS production_roots, (SELECT count(*) FROM starts WHERE class = 'nonproduction') AS nonproduction_roots,
  (SELECT count(*) FROM alive WHERE lp) + 1 AS production_live, (SELECT count(*) FROM alive WHERE ln) AS nonproduction_live, (SELECT count(*) FROM p) AS public_candidates,
  (SELECT count(*) FROM found WHERE finding = 'dead') AS dead_public, (SELECT count(*) FROM found WHERE finding <> 'dead') AS unnecessary_public""")
def q52_world_summary(spark, sf_dir):
    """The nine counts of a closed world (A5)."""
    return closed_world.summary(closed_world.analyze(*_world(spark, sf_dir)))


_TARGET = 22


@query(f"""{_STATES},
back(k, level) AS (SELECT {_TARGET}, 0 UNION SELECT sk, level + 1 FROM back JOIN e ON dk = k WHERE level < 30),
near AS (SELECT k, min(level) AS level FROM back GROUP BY k),
used AS (SELECT min(level) + 1 AS level FROM near WHERE k % 11 = 0)
SELECT 'consumer' AS what, 'c::f' || k AS item, CAST(level AS INT) AS level FROM near WHERE k <> {_TARGET} AND EXISTS (SELECT 1 FROM p WHERE p.k = {_TARGET})
UNION ALL SELECT 'consumer', 'app::main', CAST(level AS INT) FROM used WHERE level IS NOT NULL
UNION ALL SELECT 'direct', 'c::f' || sk, CAST(count(DISTINCT si) AS INT) FROM e WHERE dk = {_TARGET} GROUP BY sk
UNION ALL SELECT 'direct', 'app::main', 1 FROM p WHERE k = {_TARGET} AND k % 11 = 0
UNION ALL SELECT 'count', 'all', CAST((SELECT count(*) FROM near WHERE k <> {_TARGET}) + (SELECT count(*) FROM used WHERE level IS NOT NULL) AS INT)
UNION ALL SELECT 'disposition', 'required_public', 0 FROM need WHERE k = {_TARGET}
UNION ALL SELECT 'witness', 'production: app app::main > c c::f{_TARGET}', 1 FROM p WHERE k = {_TARGET}
UNION ALL SELECT 'witness', 'test: c c::f21 > c c::f{_TARGET}', 1 FROM p WHERE k = {_TARGET}
UNION ALL SELECT 'choice', 'c::f{_TARGET}', 0 FROM p WHERE k = {_TARGET}""")
def q53_impact(spark, sf_dir):
    """Who depends on one item: directly, at what distance, by which shortest path."""
    a = closed_world.analyze(*_world(spark, sf_dir))
    got = closed_world.impact(a, closed_world.select(a, "c", f"c::f{_TARGET}"))
    row = lambda df, what, item, level: df.select(F.lit(what).alias("what"), item.alias("item"), level.cast("int").alias("level"))
    out = row(got["consumers"], "consumer", F.col("definition_path"), F.col("level"))
    out = out.unionByName(row(got["direct"].groupBy("definition_path").agg(F.count_distinct("class").alias("n")), "direct", F.col("definition_path"), F.col("n")))
    out = out.unionByName(row(got["consumer_count"], "count", F.lit("all"), F.col("consumers"))).unionByName(row(got["disposition"], "disposition", F.col("disposition"), F.lit(0)))
    out = out.unionByName(row(got["witnesses"], "witness", F.concat(F.col("class"), F.lit(": "), F.array_join("texts", " > ")), F.col("steps")))
    nothing = closed_world.select(a, "c", f"wrong::f{_TARGET}")
    return out.unionByName(row(closed_world.choices(a, nothing, f"wrong::f{_TARGET}"), "choice", F.col("definition_path"), F.lit(0)))


# -- API surfaces


def _surface(spark, sf_dir, gone: int, moved: bool) -> dict[str, DataFrame]:
    """The surface of one build; each sixth item is missing, and some names point elsewhere."""
    t, targets = _world(spark, sf_dir)
    local = F.conv(F.substring("compiler_id", 17, 16), 16, 10).cast("long") - 1
    definition = t["definition"].where(F.coalesce((F.col("kind") == "crate") | (local % 6 != gone), F.lit(False)))
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k).where(k % 19 != 0).where((k % 4 != 0) & (k % 6 != gone))
    path = F.concat(F.lit("c::f"), k.cast("string"))
    aim = F.when(F.lit(moved) & (k % 9 == 0), F.concat(F.lit("c::g"), k.cast("string"))).otherwise(path)
    binding = parts.select(F.lit("lib").alias("invocation"), F.concat(F.lit("b"), k.cast("string")).alias("id"), _hex(1, F.lit(0).cast("long")).alias("parent"), _hex(1, k + 1).alias("target"), F.concat(F.lit("f"), k.cast("string")).alias("name"), F.lit("value").alias("namespace"), F.lit("direct").alias("exposure"), F.lit(None).cast("struct<file: string, start: bigint, end: bigint, line: int, column: int>").alias("span"), aim.alias("resolved_target_path"))
    return surface.surface({**t, "definition": definition, "public_binding": binding}, targets)


_SLOTS = """WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 19 <> 0), b AS (SELECT k FROM p WHERE k % 4 <> 0 AND k % 6 <> 1), a AS (SELECT k, k % 9 = 0 AS moved FROM p WHERE k % 4 <> 0 AND k % 6 <> 5),
c AS (SELECT 'definition_removed' AS change, 'c::f' || b.k AS path, 'function' AS name FROM b LEFT JOIN a ON a.k = b.k AND NOT a.moved WHERE a.k IS NULL
UNION ALL SELECT 'definition_added', 'c::f' || a.k, 'function' FROM a LEFT JOIN b USING (k) WHERE b.k IS NULL AND NOT moved
UNION ALL SELECT 'binding_removed', 'c', 'f' || b.k FROM b LEFT JOIN a USING (k) WHERE a.k IS NULL
UNION ALL SELECT 'binding_added', 'c', 'f' || a.k FROM a LEFT JOIN b USING (k) WHERE b.k IS NULL
UNION ALL SELECT 'binding_retargeted', 'c', 'f' || a.k FROM a JOIN b USING (k) WHERE moved)"""


@query(f"{_SLOTS} SELECT change, path, name FROM c")
def q54_surface_changes(spark, sf_dir):
    """Public surfaces of two builds and their change log."""
    return surface.diff(_surface(spark, sf_dir, 1, False), _surface(spark, sf_dir, 5, True)).select("change", "path", "name")


@query(f"{_SLOTS} SELECT {', '.join(f'''count(*) FILTER (WHERE change = '{c}') AS {c}''' for c in surface.CHANGES)} FROM c")
def q55_surface_summary(spark, sf_dir):
    """How often each kind of change occurs (A10)."""
    return surface.diff_summary(surface.diff(_surface(spark, sf_dir, 1, False), _surface(spark, sf_dir, 5, True)))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '<generated>/c/sha256-' || md5(CAST(s_suppkey AS VARCHAR))[1:16] || '/' || CASE WHEN s_suppkey % 2 = 0 THEN 'x.rs' ELSE 'generated.rs' END
  WHEN s_suppkey % 3 = 1 THEN 'src/a' || s_suppkey || '.rs' ELSE '/other/a' || s_suppkey || '.rs' END AS shown FROM supplier""")
def q56_shown_paths(spark, sf_dir):
    """Places as reports show them: from the root, or by a label that no build changes."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("c").alias("package"), (k % 3 == 0).alias("generated"), F.lit("sha256").alias("source_hash_algorithm"), F.md5(k.cast("string")).alias("source_hash"), F.when(k % 3 == 0, F.when(k % 2 == 0, "/out/x.rs").otherwise("/out/")).when(k % 3 == 1, F.concat(F.lit("/w/src/a"), k.cast("string"), F.lit(".rs"))).otherwise(F.concat(F.lit("/other/a"), k.cast("string"), F.lit(".rs"))).alias("local_path"))
    return closed_world.shown_path(s, "/w").select("s_suppkey", "shown")


# -- texts, arguments, bounded files


@query(f"""{_STATES}
SELECT CASE WHEN finding = 'dead' THEN 'dead' ELSE 'narrow' END AS what, '/w/c/src/lib.rs:' || (k * 10) || ':1  c::f' || k || '  function  ' || finding || '  [' || CASE WHEN lp AND ln THEN 'production and others' WHEN lp THEN 'production' WHEN ln THEN 'others' ELSE 'unreached' END || ']' AS line FROM found
UNION ALL SELECT 'count', 'audit: complete, 3 of 3 invocations correlated'
UNION ALL SELECT 'count', 'required public: ' || (SELECT count(*) FROM need)
UNION ALL SELECT 'count', 'can be narrowed: ' || count(*) FROM found WHERE finding <> 'dead'
UNION ALL SELECT 'count', 'dead public: ' || count(*) FROM found WHERE finding = 'dead'
UNION ALL SELECT 'partial', x FROM (VALUES ('audit: partial, 1 of 1 invocations correlated'), ('reason: no')) v(x)""")
def q57_audit_text(spark, sf_dir):
    """An audit as text: status, counts and findings, or why there are none."""
    from . import audit_text

    a = closed_world.analyze(*_world(spark, sf_dir))
    units = lambda n: spark.createDataFrame([(str(i), "correlated") for i in range(n)], "invocation string, status string")
    whole = audit_text.snapshot_lines({"status": "complete", "reason": None, "correlated": units(3)}, closed_world.summary(a), closed_world.required_visibility(a), a["findings"])
    cut_short = audit_text.snapshot_lines({"status": "partial", "reason": "no", "correlated": units(1)}, closed_world.summary(a))
    kind = lambda x: "dead" if "  dead  " in x else "narrow" if "  unnecessary_public  " in x else "count"
    return spark.createDataFrame([(kind(x), x) for x in whole] + [("partial", x) for x in cut_short], "what string, line string")


@query(f"""{_STATES}
SELECT 'impact' AS what, x AS line FROM (VALUES ('impact of c:c::f{_TARGET}'), ('visibility: required_public'), ('  app:app::main by body [production]'), ('shortest path, production: app app::main > c c::f{_TARGET}'), ('shortest path, test: c c::f21 > c c::f{_TARGET}')) v(x)
UNION ALL SELECT 'impact', 'consumers: ' || ((SELECT count(*) FROM e WHERE dk = {_TARGET}) + 1) || ' direct, ' || ((SELECT count(DISTINCT sk) FROM e WHERE dk = {_TARGET}) + 1) || ' in all'
UNION ALL SELECT 'impact', '  c:c::f' || sk || ' by ' || kind || ' [' || CASE WHEN si = 'lib' THEN 'production' ELSE 'test' END || ']' FROM e WHERE dk = {_TARGET}
UNION ALL SELECT 'nothing', x FROM (VALUES ('impact of c:no::f{_TARGET}'), ('not exactly one declaration'), ('  c:c::f{_TARGET} /w/c/src/lib.rs:{_TARGET * 10}:1')) v(x)
UNION ALL SELECT 'changes', x FROM (VALUES ('before: complete'), ('after: partial'), ('after reason: no'), ('the public surfaces can''t be compared')) v(x)""")
def q58_impact_text(spark, sf_dir):
    """Impact and comparison as text."""
    from . import audit_text

    a = closed_world.analyze(*_world(spark, sf_dir))
    path, wrong = f"c::f{_TARGET}", f"no::f{_TARGET}"
    told = audit_text.impact_lines("c", path, closed_world.impact(a, closed_world.select(a, "c", path)))
    nothing = closed_world.select(a, "c", wrong)
    lost = audit_text.impact_lines("c", wrong, closed_world.impact(a, nothing), closed_world.choices(a, nothing, wrong))
    before, after = ({"status": s, "reason": r, "surface": None} for s, r in (("complete", None), ("partial", "no")))
    both = audit_text.comparison_lines(before, after, audit.compared(before, after, True))
    return spark.createDataFrame([("impact", x) for x in told] + [("nothing", x) for x in lost] + [("changes", x) for x in both], "what string, line string")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '/now' WHEN p_partkey % 3 = 1 THEN '/now/src/a.rs' ELSE '/old2/a.rs' END AS path, CASE WHEN p_partkey % 3 = 2 THEN 'see /old2/a.rs' ELSE 'see /now/b.rs and /now/c.rs' END AS message FROM part""")
def q59_rerooted(spark, sf_dir):
    """A baseline's paths and texts as the working tree calls them."""
    from . import audit_text

    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, "/old").when(k % 3 == 1, "/old/src/a.rs").otherwise("/old2/a.rs")
    text = F.when(k % 3 == 2, "see /old2/a.rs").otherwise("see /old/b.rs and /old/c.rs")
    return audit_text.rerooted(table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), text.alias("message")), ["path", "message"], "/old", "/now")


@query("""
SELECT 'i' || s_suppkey AS invocation, 'c' || s_suppkey AS crate_name, CASE WHEN s_suppkey % 2 = 0 THEN 'lib,rlib' ELSE 'bin' END AS crate_types, 'src/x.rs' AS input, CASE WHEN s_suppkey % 3 = 0 THEN 'there' ELSE 'here' END AS target, CASE WHEN s_suppkey % 3 = 0 THEN 'target' ELSE 'host' END AS context,
  s_suppkey % 4 = 0 OR s_suppkey % 5 = 0 AS test_mode, CASE WHEN s_suppkey % 5 = 0 THEN 'a,test' ELSE 'a' END AS cfg, '-' || s_suppkey AS extra_filename, s_suppkey % 7 <> 0 AS collected,
  '13:invocation-v32:/m0:' || strlen('c' || s_suppkey) || ':c' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '8:lib,rlib' ELSE '3:bin' END || '8:src/x.rs' || CASE WHEN s_suppkey % 3 = 0 THEN '5:there6:target' ELSE '4:here4:host' END
  || CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 5 = 0 THEN '4:true' ELSE '5:false' END || CASE WHEN s_suppkey % 5 = 0 THEN '6:a' || chr(31) || 'test' ELSE '1:a' END || '23:opt-level=1' || chr(31) || 'opt-level=3' || strlen('-' || s_suppkey) || ':-' || s_suppkey || '0:0:' AS merge_key FROM supplier""")
def q60_invocation_identity(spark, sf_dir):
    """What a compiler's arguments say; of a setting that is given twice the last holds."""
    from ..sources import invocation

    k = F.col("s_suppkey")
    q = lambda *xs: F.concat(*[F.concat(F.lit(',"'), F.lit(x) if isinstance(x, str) else x, F.lit('"')) for x in xs])
    n = k.cast("string")
    args = F.concat(
        F.lit('["--crate-name"'), q(F.concat(F.lit("c"), n)), q("src/x.rs"), F.when(k % 2 == 0, q("--crate-type", "rlib,lib")).otherwise(""), F.when(k % 3 == 0, q("--target=there")).otherwise(""), F.when(k % 4 == 0, q("--test")).otherwise(""),
        q("--cfg", "a"), F.when(k % 5 == 0, q("--cfg=test", "--cfg", "a")).otherwise(""), F.when(k % 7 != 0, q("--out-dir", "/o")).otherwise(""), q("-C", "opt-level=1", "-Copt-level=3", "-C"), q(F.lit("extra-filename=first")), q("-C"), q(F.concat(F.lit("extra-filename=-"), n)), F.lit("]"),
    )
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("i"), n).alias("invocation"), args.alias("arguments"), F.lit('{"CARGO_MANIFEST_DIR": "/m"}').alias("environment"))
    return invocation.identities(rows, "here").withColumns({c: F.array_join(c, ",") for c in ("crate_types", "cfg")})


@query("""
WITH r AS (SELECT c_nationkey AS f, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, c_name AS line FROM customer),
m AS (SELECT f, max(i) AS last FROM r GROUP BY f),
s AS (SELECT r.*, i = 0 OR i = last AS mandatory, sum(CASE WHEN i = 0 OR i = last THEN 0 ELSE strlen(line) + 1 END) OVER (PARTITION BY f ORDER BY i) AS held, first_value(strlen(line) + 1) OVER (PARTITION BY f ORDER BY i) AS head FROM r JOIN m USING (f)),
k AS (SELECT * FROM s WHERE mandatory OR held + head <= 500 - 100)
SELECT CAST(f AS VARCHAR) AS file, i AS index, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM k""")
def q61_bounded_files(spark, sf_dir):
    """Records that fit a file whose end is kept for its last ones."""
    from pyspark.sql import Window

    from ..sources import facts

    own = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("file"), (F.row_number().over(own) - 1).cast("long").alias("index"), F.col("c_name").alias("line"))
    last = rows.groupBy("file").agg(F.max("index").alias("last"))
    marked = rows.join(last, "file").select("file", "index", "line", ((F.col("index") == 0) | (F.col("index") == F.col("last"))).alias("mandatory"))
    return facts.bounded(marked, 500, 100).select("file", "index", "offset")


@query("""
SELECT 'package' AS what, 'n' || n_nationkey AS name FROM nation WHERE n_nationkey % 3 = 0 OR n_regionkey = 2
UNION ALL SELECT 'outside', '/else/' || n_nationkey FROM nation WHERE n_nationkey % 5 = 1 AND n_regionkey <> 2""")
def q62_audit_inventory(spark, sf_dir):
    """The packages of an audit, and paths that are not of its workspace."""
    package, _, _ = _packages(spark, sf_dir)
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    root = F.concat(F.lit("w/r"), F.col("n_regionkey").cast("string"), F.lit("/n"), k.cast("string"))
    asked = n.where(k % 3 == 0).select(F.concat(root, F.lit("/src/lib.rs")).alias("path"), F.lit(False).alias("is_folder"))
    asked = asked.unionByName(spark.createDataFrame([("w/r2", True)], asked.schema)).unionByName(n.where((k % 5 == 1) & (F.col("n_regionkey") != 2)).select(F.concat(F.lit("/else/"), k.cast("string")).alias("path"), F.lit(True).alias("is_folder")))
    chosen, outside = workspace.audit_inventory(package, asked, "w")
    return chosen.select(F.lit("package").alias("what"), F.col("package").alias("name")).unionByName(outside.select(F.lit("outside").alias("what"), F.col("path").alias("name")))
