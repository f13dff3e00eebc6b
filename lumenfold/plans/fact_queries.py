"""The engine's fact, correlation, feature and closed-world operators on facts that are
written from the tables' rows by a fixed rule, each beside the SQL that says what must
come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import closed_world, correlate, features, surface, workspace
from ..sources import build, facts, manifest
from . import audit, snapshot
from .analogues import query, table
from .source_queries import _file

# -- facts as JSON lines


def _id(stable: Column, local: int | Column) -> str | Column:
    return F.concat(F.lit('{"stable_crate_id":'), stable.cast("string"), F.lit(f',"local_hash":{local}}}'))


#: What breaks in the file of nation k, and how it is told.
FAULTS = (
    (1, "protocol version differs"),
    (2, "record of another run"),
    (3, "records of several invocations"),
    (4, "sequence has a gap or a repeat"),
    (5, "first record is not the start"),
    (6, "last record is not the end"),
    (7, "there is not one profile"),
    (8, "profile disagrees with the start"),
    (9, "profile is not in canonical order"),
    (10, "there is not one product status"),
    (11, "complete without analysis"),
    (12, "there is not one crate definition"),
    (13, "facts without a product"),
    (14, "fact id occurs twice"),
    (15, "source key occurs twice"),
    (16, "definition id occurs twice"),
    (17, "binding slot occurs twice"),
    (18, "source hash is malformed"),
    (19, "span has no source or leaves it"),
    (20, "root's definition is unknown"),
    (21, "reference's source is unknown"),
    (22, "reference's target is unknown"),
    (23, "binding's path is not its target's"),
    (24, "binding's import is no import"),
)


def _fact_files(spark, sf_dir) -> DataFrame:
    """A file of eleven records for each nation, with the fault that its number names."""
    k = F.col("n_nationkey")
    ours = k + 1
    at = lambda n, broken, fine: F.when(k == n, F.lit(broken)).otherwise(F.lit(fine))
    j = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    crate, fn, use, odd = (_id(ours, h) for h in (0, 1, 2, 77))
    pick = lambda n, broken, fine: F.when(k == n, broken).otherwise(fine)
    span = j('{"file":"s","start":0,"end":', at(19, "1000", "10"), ',"line":1,"column":1}')
    binding = lambda i: ("public_binding", j(f'{{"id":"{i}","parent":', crate, ',"exposing_import":', pick(24, fn, use), ',"target":', fn, ',"name":"f","namespace":"value","resolved_target_path":"', at(23, "c::g", "c::f"), '"}'))
    profile = j('{"test_mode":', at(8, "true", "false"), ',"target_triple":"t","cfg":[{"name":"unix"}],"features":', at(9, '["b","a"]', '["a","b"]'), "}")
    source = ("source_file", j('{"key":"s","byte_len":100,"source_hash_algorithm":"md5","source_hash":"', at(18, "xyz", "0" * 32), '"}'))
    own = lambda i, h: j(f'{{"id":"{i}","compiler_id":', h, ',"parent":', crate, ',"kind":"function","definition_path":"c::f","span":', span, "}")
    root = ("root", j('{"id":"o0","definition":', pick(20, odd, fn), ',"kind":"entry"}'))
    records = [
        (at(5, "other", "invocation_started"), j('{"test_mode":false,"target_triple":"t"}')),
        (F.lit("profile"), profile),
        (F.lit(source[0]), source[1]),
        (F.lit("definition"), j('{"id":"d0","compiler_id":', crate, ',"kind":"', at(12, "module", "crate"), '","definition_path":"c"}')),
        (F.lit("definition"), own("d1", fn)),
        (F.lit("definition"), j('{"id":"', at(14, "d1", "d2"), '","compiler_id":', use, ',"parent":', crate, ',"kind":"import","definition_path":"c::f"}')),
        (F.lit("public_binding"), binding("b0")[1]),
        (at(7, "profile", "reference"), F.when(k == 7, profile).otherwise(j('{"id":"r0","from":', pick(21, odd, fn), ',"to":', pick(22, odd, fn), ',"kind":"body"}'))),
        (F.when(k == 15, F.lit(source[0])).when(k == 16, F.lit("definition")).when(k == 17, F.lit("public_binding")).otherwise(F.lit("root")), F.when(k == 15, source[1]).when(k == 16, own("d9", fn)).when(k == 17, binding("b1")[1]).otherwise(root[1])),
        (at(10, "other", "product_status"), j('{"product":"x","availability":"', at(13, "unavailable", "complete"), '"}')),
        (at(6, "other", "invocation_finished"), j('{"rustc_success":true,"analysis_reached":', at(11, "false", "true"), "}")),
    ]
    lines = []
    for n, (event, payload) in enumerate(records):
        version = at(1, "4", "5") if n == 4 else F.lit(str(facts.VERSION))
        run = at(2, "other", "run") if n == 4 else F.lit("run")
        inv = F.concat(F.lit("i"), k.cast("string"), F.when(F.lit(n == 4) & (k == 3), F.lit("x")).otherwise(F.lit("")))
        seq = F.when(F.lit(n == 10) & (k == 4), F.lit("12")).otherwise(F.lit(str(n)))
        lines.append(j('{"protocol_version":', version, ',"run_id":"', run, '","invocation_id":"', inv, '","sequence":', seq, ',"event":"', event, '","payload":', payload, "}\n"))
    text = F.concat(*lines).cast("binary")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.lpad(k.cast("string"), 2, "0"), F.lit(".jsonl")).alias("file"), F.octet_length(text).cast("long").alias("length"), text.alias("content"))


_FAULT_ROWS = ", ".join("({}, '{}')".format(k, m.replace("'", "''")) for k, m in FAULTS)


@query(f"""WITH f(k, message) AS (VALUES {_FAULT_ROWS})
SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '.jsonl' AS file, message FROM nation JOIN f ON n_nationkey = k""")
def q35_fact_validation(spark, sf_dir):
    """Every rule of a fact file, each broken once."""
    records, errors = facts.decode(_fact_files(spark, sf_dir))
    return errors.unionByName(facts.validate(records, "run"))


@query("""
SELECT 'r' || r_regionkey || '.jsonl' AS file, CASE r_regionkey WHEN 0 THEN 'file is empty' WHEN 1 THEN 'last record is not ended' WHEN 2 THEN 'record 1 is malformed or exceeds its limit' WHEN 3 THEN 'file is not UTF-8' END AS message FROM region WHERE r_regionkey < 4""")
def q36_fact_files(spark, sf_dir):
    """Files that can't be decoded are told and the rest goes on."""
    k = F.col("r_regionkey")
    record = F.lit('{"protocol_version":5,"run_id":"run","invocation_id":"i","sequence":0,"event":"other","payload":{}}\n')
    text = F.when(k == 0, F.lit("").cast("binary")).when(k == 1, F.concat(record, F.lit("{}")).cast("binary")).when(k == 2, F.concat(record, F.lit("{]\n")).cast("binary")).when(k == 3, F.unhex(F.lit("FF0A"))).otherwise(record.cast("binary"))
    files = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), k.cast("string"), F.lit(".jsonl")).alias("file"), F.octet_length(text).cast("long").alias("length"), text.alias("content"))
    return facts.decode(files)[1]


# -- correlation


def _invocations(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Invocations, artifacts and failures written from the suppliers."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    dir_, src = F.concat(F.lit("/w/p"), k.cast("string")), F.concat(F.lit("/w/p"), k.cast("string"), F.lit("/src/lib.rs"))
    name, suffix = F.concat(F.lit("c"), k.cast("string")), F.concat(F.lit("-x"), k.cast("string"))
    own = [dir_.alias("manifest_dir"), src.alias("input"), (k % 3 == 0).alias("test_mode"), F.array(F.lit("lib")).alias("crate_types"), name.alias("crate_name"), suffix.alias("extra_filename")]
    key = F.when(k % 20 == 0, F.concat(F.lit("m"), (k + 1).cast("string"))).otherwise(F.concat(F.lit("m"), k.cast("string")))
    inv = s.select(F.concat(F.lit("i"), k.cast("string")).alias("invocation"), key.alias("merge_key"), *own)
    inv = inv.unionByName(s.where(k % 17 == 0).select(F.concat(F.lit("i"), k.cast("string"), F.lit("b")).alias("invocation"), F.lit(None).cast("string").alias("merge_key"), *own))
    made = lambda df, n: df.select(n.cast("long").alias("artifact"), dir_.alias("manifest_dir"), src.alias("target_source"), (k % 3 == 0).alias("profile_test"), F.array(F.lit("rlib")).alias("crate_types"), F.array(F.concat(F.lit("/t/lib"), name, suffix, F.lit(".rlib"))).alias("filenames"), dir_.alias("package_id"), name.alias("target_name"), F.array(F.lit("lib")).alias("target_kinds"))
    art = made(s.where(k % 5 != 1), k).unionByName(made(s.where((k % 11 == 0) & (k % 5 != 1)), k + 1_000_000))
    fail = s.where(k % 10 == 1).select(dir_.alias("package_id"), dir_.alias("manifest_dir"), src.alias("target_source"), name.alias("target_name"), F.array(F.lit("lib")).alias("target_kinds"), F.array(F.lit("rlib")).alias("target_crate_types"))
    roots = s.where(k % 13 != 0).select(dir_.alias("root"))
    return correlate.selected(inv, roots), art, fail


_INVOCATIONS = "WITH i AS (SELECT s_suppkey AS k, 'i' || s_suppkey AS invocation FROM supplier UNION ALL SELECT s_suppkey, 'i' || s_suppkey || 'b' FROM supplier WHERE s_suppkey % 17 = 0)"


@query(f"""{_INVOCATIONS}
SELECT invocation, CASE WHEN k % 5 <> 1 THEN CASE WHEN k % 11 = 0 THEN 'ambiguous' ELSE 'correlated' END WHEN k % 10 = 1 THEN 'failed' ELSE 'unmatched' END AS status,
  CASE WHEN k % 5 <> 1 AND k % 11 <> 0 THEN k END AS artifact, CASE WHEN (k % 5 <> 1 AND k % 11 <> 0) OR k % 10 = 1 THEN 'c' || k END AS target_name FROM i WHERE k % 13 <> 0""")
def q37_correlated_units(spark, sf_dir):
    """Invocations matched with what the build says it made (K1, K3, K4)."""
    return correlate.correlate(*_invocations(spark, sf_dir))["correlated"].select("invocation", "status", "artifact", "target_name")


@query(f"""{_INVOCATIONS}, s AS (SELECT s_suppkey AS k FROM supplier), a AS (SELECT k, k AS artifact FROM s WHERE k % 5 <> 1 UNION ALL SELECT k, k + 1000000 FROM s WHERE k % 5 <> 1 AND k % 11 = 0)
SELECT 'merge key occurs twice' AS issue, 'm' || (k + 1) AS about FROM s WHERE k % 20 = 0 AND k % 13 <> 0 AND (k + 1) % 13 <> 0 AND k + 1 <= (SELECT max(k) FROM s)
UNION ALL SELECT 'artifact has no invocation', CAST(artifact AS VARCHAR) FROM a WHERE k % 13 = 0
UNION ALL SELECT 'artifact is claimed by several invocations', CAST(artifact AS VARCHAR) FROM a WHERE k % 13 <> 0 AND k % 17 = 0""")
def q38_correlation_issues(spark, sf_dir):
    """Repeated keys, artifacts without an invocation or with several (K2, K5)."""
    return correlate.correlate(*_invocations(spark, sf_dir))["issues"]


@query("""
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 = 0 AS host FROM supplier)
SELECT 'i' || k AS invocation, unnest(list_filter([CASE WHEN k % 2 = 1 AND k % 5 = 0 THEN 'there is no profile' END, CASE WHEN k % 6 = 0 THEN 'compiler did not succeed' END,
  CASE WHEN NOT (k % 2 = 1 AND k % 5 = 0) AND k % 7 = 0 THEN 'features differ from the build''s' END, CASE WHEN NOT (k % 2 = 1 AND k % 5 = 0) AND k % 3 = 0 THEN 'optimization differs from the build''s' END,
  CASE WHEN NOT (k % 2 = 1 AND k % 5 = 0) AND k % 8 = 0 THEN 'overflow checks differ from the build''s' END, CASE WHEN NOT (k % 2 = 1 AND k % 5 = 0) AND k % 9 = 0 THEN 'debug assertions differ from the build''s' END,
  CASE WHEN NOT (k % 2 = 1 AND k % 5 = 0) AND CASE WHEN host THEN k % 10 = 0 ELSE k % 11 = 0 END THEN 'target differs from the audit''s' END,
  CASE WHEN NOT host AND ((k % 2 = 1 AND k % 5 = 0) OR k % 12 = 1) THEN 'requested cfg was not observed: mode=x' END], lambda x: x IS NOT NULL)) AS issue FROM s""")
def q39_invocation_issues(spark, sf_dir):
    """What each invocation saw against what its artifact was built with (K8)."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    inv = F.concat(F.lit("i"), k.cast("string")).alias("invocation")
    t = {
        "invocation": s.select(inv, F.when(k % 4 == 0, "host").otherwise("target").alias("compilation_context")),
        "profile": s.where(~((k % 2 == 1) & (k % 5 == 0))).select(
            inv,
            F.when(k % 10 == 0, "old").otherwise("here").alias("host_triple"),
            F.when(k % 4 == 0, "here").otherwise(F.when(k % 11 == 0, "else").otherwise("there")).alias("target_triple"),
            F.array(F.lit("b"), F.lit("a")).alias("features"),
            F.struct(F.when(k % 3 == 0, "none").otherwise("aggressive").alias("optimization"), (k % 9 != 0).alias("debug_assertions"), (k % 8 != 0).alias("overflow_checks")).alias("codegen"),
            F.array(F.struct(F.lit("unix").alias("name"), F.lit(None).cast("string").alias("value")), F.struct(F.lit("mode").alias("name"), F.when(k % 12 == 1, "y").otherwise("x").alias("value"))).alias("cfg"),
        ),
        "finished": s.select(inv, (k % 6 != 0).alias("rustc_success")),
    }
    correlated = s.select(inv, k.alias("artifact"))
    artifact = s.select(k.alias("artifact"), F.when(k % 7 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("features"), F.struct(F.lit("3").alias("opt_level"), F.lit(True).alias("debug_assertions"), F.lit(True).alias("overflow_checks")).alias("profile"))
    return audit.invocation_issues(t, correlated, artifact, "there", ['mode = "x"'])


@query("""
SELECT 'pkg' || s_suppkey AS package_id, 'custom' || s_suppkey AS cfg FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0""")
def q40_script_cfg(spark, sf_dir):
    """What build scripts set and no unit over their folder observed (K9)."""
    k = F.col("s_suppkey").cast("string")
    s = table(spark, sf_dir, "supplier")
    pkg, out = F.concat(F.lit("pkg"), k).alias("package_id"), F.concat(F.lit("/out/"), k).alias("out_dir")
    scripts = s.select(pkg, out, F.array(F.concat(F.lit("custom"), k), F.concat(F.lit('v = "'), k, F.lit('"'))).alias("cfg"))
    seen = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.concat(F.lit("v="), k))).otherwise(F.array(F.concat(F.lit("v="), k), F.concat(F.lit("custom"), k)))
    return correlate.script_cfg(scripts, s.where("s_suppkey % 5 <> 0").select(pkg, out, seen.alias("cfg")))


def _units(df: DataFrame, n: Column) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    return df.select(F.concat(F.lit("pkg"), k).alias("package_id"), F.lit("t").alias("target_name"), F.array(F.lit("lib")).alias("target_kinds"), F.array(F.lit("lib")).alias("target_crate_types"), F.lit("/s").alias("target_source"), F.array(F.lit("a")).alias("features"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("plat")).alias("platform"), F.explode(F.sequence(F.lit(1), n)).alias("_n")).drop("_n")


@query("""
WITH u AS (SELECT 'pkg' || s_suppkey AS package_id, CASE WHEN s_suppkey % 2 = 0 THEN 'plat' END AS platform, s_suppkey % 3 + 1 AS expected, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 2 END AS observed, s_suppkey % 4 = 0 AS failed FROM supplier)
SELECT 'ledger' AS rule, package_id, platform, CAST(expected AS BIGINT) AS expected, CAST(observed AS BIGINT) AS observed FROM u WHERE expected <> observed
UNION ALL SELECT 'missing', package_id, platform, CAST(expected - observed AS BIGINT), NULL FROM u WHERE failed AND expected > observed""")
def q41_unit_ledger(spark, sf_dir):
    """How many units were expected and seen, and what failed ones lack (K6, K7)."""
    s = table(spark, sf_dir, "supplier")
    expected, observed = _units(s, F.col("s_suppkey") % 3 + 1), _units(s.where("s_suppkey % 5 <> 0"), F.lit(2))
    failure = _units(s.where("s_suppkey % 4 = 0"), F.lit(1)).drop("features", "platform")
    lack = correlate.missing_failed(expected, observed, failure).select(F.lit("missing").alias("rule"), "package_id", "platform", F.col("missing").alias("expected"), F.lit(None).cast("long").alias("observed"))
    return correlate.unit_ledger(expected, observed).select(F.lit("ledger").alias("rule"), "package_id", "platform", "expected", "observed").unionByName(lack)


@query("""
SELECT n_nationkey AS producer, unnest(list_filter([CASE WHEN n_nationkey % 2 = 1 THEN 'protocol_version' END, CASE WHEN n_nationkey % 3 = 1 THEN 'host' END, CASE WHEN n_nationkey % 5 = 1 THEN 'commit_date' END], lambda x: x IS NOT NULL)) AS field FROM nation WHERE n_nationkey % 7 <> 0
UNION ALL SELECT n_nationkey, 'handshake' FROM nation WHERE n_nationkey % 7 = 0
UNION ALL SELECT n_nationkey, 'not in the ledger' FROM nation WHERE n_nationkey % 4 = 0""")
def q42_compiler_identity(spark, sf_dir):
    """What a producer says of itself against what was selected and what is supported."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    said = lambda odd: [(F.when(k % 2 == odd, 4).otherwise(5)).alias("protocol_version"), F.lit("1.0").alias("driver_version"), F.lit("v").alias("linked_version"), F.lit("1.90.0").alias("release"), F.lit("abc").alias("commit_hash"), F.when(k % 5 != odd, F.lit("2026-01-01")).alias("commit_date"), F.when(k % 3 == odd, "x").otherwise("here").alias("host")]
    never = 9  # no number leaves this rest
    issues = audit.handshake_issues(n.where(k % 7 != 0).select(k.alias("producer"), *said(1)), n.select(k.alias("producer"), *said(never)))
    inv = n.select(k.cast("string").alias("invocation"), F.struct(F.when(k % 4 == 0, "1.0.0").otherwise("1.90.0").alias("release"), F.lit("abc").alias("commit_hash"), F.lit("2026-01-01").alias("commit_date"), F.lit("here").alias("host")).alias("compiler"))
    ledger = build.supported(spark, [{"release": r, "commit_hash": "abc", "commit_date": "2026-01-01", "host": "here"} for r in ("1.90.0", "1.91.0")])
    lost = build.unsupported(inv, ledger).select(F.col("invocation").cast("long").alias("producer"), F.lit("not in the ledger").alias("field"))
    return issues.select(F.col("producer").cast("long").alias("producer"), "field").unionByName(lost)
