"""Compiler facts as JSON lines: decoding into typed tables, and validation.

A file of facts is one invocation.  Ids are unsigned 64-bit numbers, which have no
type here: they become 16 hex digits, which sort as the numbers do.  A file that
breaks a rule is reported and takes no part; the rest goes on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import facts
from ..plans import fixpoint

VERSION = 5
#: Bytes of a file and of a record; files of a run.
MAX_FILE, MAX_RECORD, MAX_FILES = 64 << 20, 1 << 20, 10_000

_SPAN = "struct<file: string, start: bigint, end: bigint, line: int, column: int>"
_ID = "struct<stable_crate_id: decimal(20,0), local_hash: decimal(20,0)>"
PAYLOAD = f"""
merge_key string, compiler struct<release: string, commit_hash: string, commit_date: string, host: string>, process_id bigint, rustc_path string,
working_directory string, manifest_dir string, build_script_out_dir string, package_name string, primary_package boolean, test_mode boolean,
target_triple string, compilation_context string, crate_name string, input string,
artifact struct<out_dir: string, crate_name: string, crate_types: array<string>, extra_filename: string, metadata: string, emit: array<string>>,
host_triple string, cfg array<struct<name: string, value: string>>, features array<string>,
codegen struct<optimization: string, panic: string, debug_assertions: boolean, overflow_checks: boolean, codegen_units: string, target_cpu: string, target_features: array<string>>,
key string, local_path string, remapped_path string, source_hash_algorithm string, source_hash string, byte_len bigint, generated boolean,
id string, compiler_id {_ID}, parent {_ID}, name string, definition_path string, kind string, visibility_editable boolean, nominal_visibility string,
externally_reachable boolean, span {_SPAN}, attribution_callsite {_SPAN}, expansion_origin string,
target {_ID}, namespace string, exposure string, exposing_import {_ID}, resolved_target_path string,
definition {_ID}, reason string, `from` {_ID}, `to` {_ID},
product string, availability string, message string, phase string, severity string, rustc_success boolean, analysis_reached boolean
""".strip().replace("\n", " ")


def _columns(ddl: str) -> str:
    """``name type`` pairs as the fields of a struct."""
    parts, depth = [""], 0
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return ", ".join(p.strip().replace(" ", ": ", 1) for p in parts)


RECORD = f"protocol_version int, run_id string, invocation_id string, sequence bigint, event string, payload struct<{_columns(PAYLOAD)}>"
IDS = ("compiler_id", "parent", "target", "exposing_import", "definition", "from", "to")


def hex_id(value: Column) -> Column:
    """Two unsigned numbers as 32 hex digits, in their order."""

    def one(c: Column) -> Column:
        high, low = F.floor(c / F.lit(1 << 32)).cast("bigint"), F.pmod(c, F.lit(1 << 32).cast("decimal(20,0)")).cast("bigint")
        return F.concat(F.lpad(F.lower(F.hex(high)), 8, "0"), F.lpad(F.lower(F.hex(low)), 8, "0"))

    return F.when(value.isNotNull(), F.concat(one(value["stable_crate_id"]), one(value["local_hash"])))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of the *.jsonl files in a folder.

    Whole files are read, as the last line has to end: a reader of lines wouldn't
    tell.  errors: file, message."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(path)
    return decode(raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "content"))


def decode(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files: file, length, content."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    problem = F.when(F.col("length") > MAX_FILE, F.lit("file exceeds its limit")).when(F.col("length") == 0, F.lit("file is empty")).when(text.isNull(), F.lit("file is not UTF-8")).when(~F.endswith(text, F.lit("\n")), F.lit("last record is not ended"))
    judged = files.select("file", text.alias("text"), problem.alias("problem"))
    lines = judged.where("problem is null").select("file", F.posexplode(F.split(F.expr("substring(text, 1, length(text) - 1)"), "\n")).alias("index", "line"))
    parsed = lines.select("file", F.col("index").cast("bigint").alias("index"), (F.octet_length("line") > MAX_RECORD).alias("long"), facts.decoded(F.col("line"), RECORD).alias("r"))
    bad = parsed.where(F.col("long") | F.col("r.event").isNull() | F.col("r.sequence").isNull() | F.col("r.invocation_id").isNull())
    broken = bad.groupBy("file").agg(F.min("index").alias("i")).select("file", F.concat(F.lit("record "), F.col("i").cast("string"), F.lit(" is malformed or exceeds its limit")).alias("message"))
    errors = judged.where("problem is not null").select("file", F.col("problem").alias("message")).unionByName(broken)
    good = parsed.join(broken, "file", "left_anti")
    payload = [hex_id(F.col(f"r.payload.{c}")).alias(c) if c in IDS else F.col(f"r.payload.{c}").alias(c) for c in good.select("r.payload.*").columns]
    records = good.select("file", "index", F.col("r.protocol_version").alias("protocol_version"), F.col("r.run_id").alias("run_id"), F.col("r.invocation_id").alias("invocation_id"), F.col("r.sequence").alias("sequence"), F.col("r.event").alias("event"), *payload)
    # Every rule and table starts from the records: they are decoded once.
    return fixpoint.cut(records), errors


def _count(event: str, where: Column | None = None) -> Column:
    hit = F.col("event") == event
    return F.count_if(hit if where is None else hit & F.coalesce(where, F.lit(False)))


def _errors(rows: DataFrame, message: str, *where: Column) -> DataFrame:
    hit = reduce(lambda a, b: a | b, where)
    return rows.where(F.coalesce(hit, F.lit(False))).select("file", F.lit(message).alias("message"))


def validate(records: DataFrame, run_id: str) -> DataFrame:
    """(file, message): each rule that a file breaks.  Files without a row are valid."""
    by = records.groupBy("file")
    one = F.col("index") == 0
    shape = by.agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(F.col("protocol_version") != VERSION, F.lit(True))).alias("versions"),
        F.count_if(F.coalesce(F.col("run_id") != run_id, F.lit(True))).alias("runs"),
        F.count_distinct("invocation_id").alias("invocations"),
        F.count_if(F.col("sequence") != F.col("index")).alias("gaps"),
        F.max(F.when(one, F.col("event"))).alias("first"),
        F.max_by("event", "index").alias("last"),
        _count("invocation_started").alias("started"),
        _count("profile").alias("profiles"),
        _count("invocation_finished").alias("finished"),
        _count("product_status").alias("products"),
        _count("definition", F.col("kind") == "crate").alias("crates"),
        _count("definition").alias("definitions"),
        F.max(F.when(F.col("event") == "invocation_started", F.struct("test_mode", "target_triple"))).alias("s"),
        F.max(F.when(F.col("event") == "profile", F.struct("test_mode", "target_triple"))).alias("p"),
        F.bool_or(F.when(F.col("event") == "invocation_finished", F.col("analysis_reached"))).alias("analysis"),
        F.max(F.when(F.col("event") == "product_status", F.col("availability"))).alias("availability"),
        F.bool_and(F.when(F.col("event") == "profile", facts.strictly_increasing(F.col("features")))).alias("features_sorted"),
        F.bool_and(F.when(F.col("event") == "profile", facts.strictly_increasing(F.transform("cfg", lambda c: F.concat(c["name"], F.lit("\x00"), F.coalesce(c["value"], F.lit(""))))))).alias("cfg_sorted"),
    )
    shape, c = fixpoint.cut(shape), F.col
    out = [
        _errors(shape, "protocol version differs", c("versions") > 0),
        _errors(shape, "record of another run", c("runs") > 0),
        _errors(shape, "records of several invocations", c("invocations") != 1),
        _errors(shape, "sequence has a gap or a repeat", c("gaps") > 0),
        _errors(shape, "first record is not the start", c("first") != "invocation_started", c("started") != 1),
        _errors(shape, "last record is not the end", c("last") != "invocation_finished", c("finished") != 1),
        _errors(shape, "there is not one profile", c("profiles") != 1),
        _errors(shape, "profile disagrees with the start", c("s.test_mode") != c("p.test_mode"), c("s.target_triple") != c("p.target_triple")),
        _errors(shape, "profile is not in canonical order", ~c("features_sorted"), ~c("cfg_sorted")),
        _errors(shape, "there is not one product status", c("products") != 1),
        _errors(shape, "complete without analysis", (c("availability") == "complete") & ~c("analysis")),
        _errors(shape, "there is not one crate definition", (c("availability") == "complete") & (c("crates") != 1)),
        _errors(shape, "facts without a product", (c("availability") == "unavailable") & (c("definitions") > 0)),
    ]
    kind = lambda e: records.where(F.col("event") == e)
    ids = records.where(c("event").isin("definition", "public_binding", "root", "reference"))
    repeated = lambda rows, key, message: facts.duplicates(rows.where(F.col(key).isNotNull()), ["file", key]).select("file", F.lit(message).alias("message"))
    out += [repeated(ids, "id", "fact id occurs twice"), repeated(kind("source_file"), "key", "source key occurs twice"), repeated(kind("definition"), "compiler_id", "definition id occurs twice")]
    slots = facts.duplicates(kind("public_binding"), ["file", "parent", "name", "namespace"]).select("file", F.lit("binding slot occurs twice").alias("message"))
    hashed = F.when(c("source_hash_algorithm") == "md5", 32).when(c("source_hash_algorithm") == "sha1", 40).when(c("source_hash_algorithm").isin("sha256", "blake3"), 64)
    bad_hash = kind("source_file").where(~F.coalesce((F.length("source_hash") == hashed) & F.col("source_hash").rlike("^[0-9a-f]*$"), F.lit(False))).select("file", F.lit("source hash is malformed").alias("message"))
    out += [slots, bad_hash]
    sources = kind("source_file").select("file", F.col("key").alias("_key"), F.col("byte_len").alias("_len"))
    spans = records.where(c("span").isNotNull()).select("file", "span.file", "span.start", "span.end", "span.line", "span.column").toDF("file", "_f", "start", "end", "line", "column")
    met = spans.join(sources, (spans["file"] == sources["file"]) & (F.col("_f") == F.col("_key")), "left").select(spans["file"], "start", "end", "line", "column", "_len")
    out.append(_errors(met, "span has no source or leaves it", c("_len").isNull(), c("start") > c("end"), c("end") > c("_len"), c("line") < 1, c("column") < 1))
    known = kind("definition").select("file", F.col("compiler_id").alias("_id"), F.col("kind").alias("_kind"), F.col("definition_path").alias("_path"))
    crate = lambda x: F.substring(x, 1, 16)
    local = kind("definition").where("kind = 'crate'").select("file", crate(F.col("compiler_id")).alias("_crate"))

    def missing(rows: DataFrame, key: str, message: str, only_local: bool = False) -> DataFrame:
        rows = rows.where(F.col(key).isNotNull()).select("file", F.col(key).alias("_want"))
        if only_local:
            rows = rows.join(local, (rows["file"] == local["file"]) & (crate(F.col("_want")) == F.col("_crate")), "left_semi")
        return rows.join(known, (rows["file"] == known["file"]) & (F.col("_want") == F.col("_id")), "left_anti").select("file", F.lit(message).alias("message"))

    out += [
        missing(kind("definition"), "parent", "definition's parent is unknown"),
        missing(kind("root"), "definition", "root's definition is unknown"),
        missing(kind("reference"), "from", "reference's source is unknown"),
        missing(kind("reference"), "to", "reference's target is unknown", only_local=True),
        missing(kind("public_binding"), "parent", "binding's parent is unknown"),
        missing(kind("public_binding"), "exposing_import", "binding's import is unknown"),
    ]
    bound = kind("public_binding").select("file", "parent", "exposing_import", "target", "resolved_target_path")
    ends = lambda key, kinds, message: bound.join(known, (bound["file"] == known["file"]) & (F.col(key) == F.col("_id"))).where(~F.col("_kind").isin(*kinds)).select(bound["file"], F.lit(message).alias("message"))
    paths = bound.join(known, (bound["file"] == known["file"]) & (F.col("target") == F.col("_id"))).where("resolved_target_path <> _path").select(bound["file"], F.lit("binding's path is not its target's").alias("message"))
    out += [ends("parent", ("crate", "module", "enum", "trait"), "binding's parent holds no names"), ends("exposing_import", ("use", "extern_crate", "import"), "binding's import is no import"), paths]
    return reduce(DataFrame.unionByName, out).dropDuplicates(["file", "message"])


def tables(records: DataFrame, invalid: DataFrame) -> dict[str, DataFrame]:
    """The valid files' records by event, with the columns that each has."""
    good = records.join(invalid.select("file").distinct(), "file", "left_anti").withColumn("invocation", F.col("invocation_id"))
    pick = lambda e, *cols: good.where(F.col("event") == e).select("invocation", *cols)
    return {
        "invocation": pick("invocation_started", "merge_key", "compiler", "manifest_dir", "build_script_out_dir", "package_name", "test_mode", "target_triple", "compilation_context", "crate_name", "input", "artifact"),
        "profile": pick("profile", "host_triple", "target_triple", "test_mode", "cfg", "features", "codegen"),
        "source_file": pick("source_file", "key", "local_path", "remapped_path", "byte_len", "generated"),
        "definition": pick("definition", "id", "compiler_id", "parent", "name", "definition_path", "kind", "visibility_editable", "nominal_visibility", "externally_reachable", "span", "attribution_callsite", "expansion_origin"),
        "public_binding": pick("public_binding", "id", "parent", "target", "name", "namespace", "exposure", "span", "resolved_target_path"),
        "root": pick("root", "id", "definition", "kind", "reason"),
        "reference": pick("reference", "id", "from", "to", "kind", "span"),
        "product_status": pick("product_status", "product", "availability", "message"),
        "finished": pick("invocation_finished", "rustc_success", "analysis_reached"),
    }


#: Bytes at the end of a file that only its last records may take.
TRAILER = 64 << 10


def bounded(lines: DataFrame, limit: int = MAX_FILE, reserve: int = TRAILER) -> DataFrame:
    """The records that fit a file: ``lines`` (file, index, line, mandatory) in order, with
    ``offset``.

    A record counts with its line end.  One over the record's limit, and one that would
    reach into the reserve, is left out with what follows it; mandatory records may use
    the reserve and go on behind the cut."""
    size = (F.octet_length("line") + 1).cast("long")
    order = Window.partitionBy("file").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_size", size)
    plain = rows.where("not mandatory").withColumn("_sum", F.sum("_size").over(order)).withColumn("_long", F.max((F.col("_size") > MAX_RECORD + 1).cast("int")).over(order))
    early = rows.where("mandatory").groupBy("file").agg(F.sum(F.when(F.col("index") == 0, F.col("_size")).otherwise(0)).alias("_first"))
    kept = plain.join(early, "file", "left").where((F.col("_sum") + F.coalesce("_first", F.lit(0)) <= limit - reserve) & (F.col("_long") == 0)).drop("_sum", "_long", "_first")
    whole = kept.unionByName(rows.where("mandatory"))
    before = Window.partitionBy("file").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    return whole.withColumn("offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).where(F.col("offset") + F.col("_size") <= limit).drop("_size")
