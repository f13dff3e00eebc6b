"""Which public items a closed set of builds still needs.

Tables of facts (see ``sources.facts``) and of targets become a graph of states, a
state being an item in one invocation, so that test and production builds never
mix.  Requirements spread over interface edges, liveness over runtime edges from two
classes of roots; an item is reported if all items behind its visibility token are
eligible and none is required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import fixpoint
from . import facts, graph

#: Kinds of targets that have an API, and of definitions that have no visibility of their own to narrow.
LIBRARY_KINDS = ("lib", "rlib", "dylib", "cdylib", "staticlib", "proc-macro")
NOT_NARROWED = ("crate", "variant", "constructor", "implementation", "import", "macro", "extern_crate", "foreign_module", "opaque_type")
ASSOCIATED = ("associated_type", "associated_function", "associated_constant")
INTERFACE_KINDS = ("interface", "reexport", "visibility_parent", "visibility_requirement")
#: Reasons with a meaning of their own.
ALLOWED_DEAD = "dead_code is explicitly allowed for this definition"
PLAIN_REEXPORT = "a public reexport requires this local target to remain public"
CROSS_CRATE = "referenced from another selected crate"
SPREAD = "required by a public interface or visibility edge"
SEPARATOR = "\x1f"


def role_of(kinds: Column, test_mode: Column) -> Column:
    has = lambda k: F.array_contains(kinds, k)
    return F.when(has("custom-build"), "build").when(has("test"), "test").when(has("bench"), "bench").when(has("example"), "example").when(test_mode, "unit_test").otherwise("production")


def provenance(context: Column, role: Column) -> Column:
    return F.when(context == "host", "build_time").when(role == "production", "production").when(role.isin("unit_test", "test"), "test").otherwise(role)


def library(kinds: Column) -> Column:
    return F.arrays_overlap(kinds, F.array(*map(F.lit, LIBRARY_KINDS)))


def _state(invocation: Column, node: Column) -> Column:
    return F.concat(invocation, F.lit(SEPARATOR), node)


def definitions(t: dict[str, DataFrame], targets: DataFrame) -> DataFrame:
    """Each definition with its node, state, visibility token and whether it may be narrowed.

    ``targets``: invocation, package, package_path, target, kinds, role, context."""
    d = t["definition"].join(targets, "invocation")
    src = t["source_file"].select(F.col("invocation").alias("_i"), F.col("key").alias("_k"), F.coalesce("local_path", "remapped_path").alias("source_path"), "generated")
    d = d.join(src, (F.col("invocation") == F.col("_i")) & (F.col("span.file") == F.col("_k")), "left").drop("_i", "_k")
    place = facts.length_prefixed(F.col("source_path"), F.col("span.start").cast("string"), F.col("span.end").cast("string"))
    known = facts.length_prefixed(F.col("package"), F.col("target"), F.col("definition_path"), F.col("kind"))
    node = F.when(place.isNotNull(), F.concat(known, place)).otherwise(F.concat(F.lit("raw:"), facts.length_prefixed(F.col("invocation"), F.col("compiler_id"))))
    d = d.withColumn("node", node).withColumn("state", _state(F.col("invocation"), F.col("node")))
    d = d.withColumn("token", F.when(F.col("visibility_editable") & place.isNotNull(), F.concat(F.col("kind"), F.lit("@"), place)))
    trait = t["definition"].where("kind = 'trait'").select(F.col("invocation").alias("_i"), F.col("compiler_id").alias("_t"))
    d = d.join(trait, (F.col("invocation") == F.col("_i")) & (F.col("parent") == F.col("_t")), "left").withColumn("implicit", F.col("_t").isNotNull() & F.col("kind").isin(*ASSOCIATED)).drop("_i", "_t")
    reached = ((F.col("role") == "production") & ((F.col("context") == "target") | F.array_contains("kinds", "proc-macro"))) | ((F.col("role") == "unit_test") & (F.col("context") == "target"))
    authored = (F.col("expansion_origin") == "authored") & (F.col("generated") == F.lit(False))
    fits = library(F.col("kinds")) & reached & F.col("externally_reachable") & F.col("visibility_editable") & authored & (F.col("nominal_visibility") == "public") & ~F.col("kind").isin(*NOT_NARROWED) & ~F.col("implicit")
    return d.withColumn("eligible", F.coalesce(fits, F.lit(False)))


def edges(t: dict[str, DataFrame], d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, errors).  A target of the same invocation comes first; else those of all;
    a target in no selected crate is dropped, one with several nodes is an error."""
    own = d.select(F.col("invocation").alias("i"), F.col("compiler_id").alias("c"), "state", "node")
    r = t["reference"].select("invocation", "id", "from", "to", F.col("kind").alias("edge"), "span")
    r = r.join(own.select("i", "c", F.col("state").alias("src")), (F.col("invocation") == F.col("i")) & (F.col("from") == F.col("c")), "left").drop("i", "c")
    r = r.join(own.select("i", "c", F.col("state").alias("here")), (F.col("invocation") == F.col("i")) & (F.col("to") == F.col("c")), "left").drop("i", "c")
    anywhere = own.groupBy("c").agg(F.count_distinct("node").alias("nodes"), F.collect_set("state").alias("states"))
    r = r.join(anywhere, F.col("to") == F.col("c"), "left").drop("c")
    crate = lambda c: F.substring(c, 1, 16)
    selected = own.select(crate(F.col("c")).alias("_crate")).distinct()
    r = r.withColumn("crate", crate(F.col("to"))).join(selected.withColumn("local", F.lit(True)), F.col("crate") == F.col("_crate"), "left")
    lost = r.where("src is null").select("invocation", "id", F.lit("reference has no source node").alias("message"))
    lost = lost.unionByName(r.where("src is not null and here is null and (nodes > 1 or (nodes is null and local))").select("invocation", "id", F.lit("reference leads to no single item of a selected crate").alias("message")))
    good = r.where("src is not null and (here is not null or nodes = 1)").withColumn("dst", F.explode(F.when(F.col("here").isNotNull(), F.array("here")).otherwise(F.col("states"))))
    return good.select("invocation", "id", "src", "dst", F.col("edge").alias("kind"), "span", (crate(F.col("from")) != crate(F.col("to"))).alias("crossing")), lost


def analyze(t: dict[str, DataFrame], targets: DataFrame) -> dict[str, DataFrame]:
    """The graph's tables: definitions, edges, required, live, candidates, findings, errors."""
    d = fixpoint.cut(definitions(t, targets))
    e, errors = edges(t, d)
    e = fixpoint.cut(e)
    role = targets.select(F.col("invocation").alias("_i"), F.when(F.col("role") == "production", "production").otherwise("nonproduction").alias("class"))
    roots = t["root"].join(d.select(F.col("invocation").alias("_i"), F.col("compiler_id").alias("_c"), "state", "node"), (F.col("invocation") == F.col("_i")) & (F.col("definition") == F.col("_c")), "left").drop("_i", "_c")
    errors = errors.unionByName(roots.where("state is null").select("invocation", "id", F.lit("root has no local graph node").alias("message")))
    roots = fixpoint.cut(roots.where("state is not null").join(role, F.col("invocation") == F.col("_i")).drop("_i"))
    crossing = e.where("crossing").join(role, F.col("invocation") == F.col("_i"))
    reasons = roots.where("kind = 'required_public'").select("state", "reason").unionByName(crossing.select(F.col("dst").alias("state"), F.lit(CROSS_CRATE).alias("reason"))).distinct()
    reasons = fixpoint.cut(reasons)
    interface = e.where(F.col("kind").isin(*INTERFACE_KINDS)).select("src", "dst", "kind")
    hubs = graph.through_hubs(d.where("token is not null"), "token", "state").withColumn("kind", F.lit("interface"))
    spread_over = fixpoint.cut(interface.unionByName(hubs).distinct())
    seeds = reasons.groupBy("state").agg(F.bool_or(F.col("reason") != PLAIN_REEXPORT).alias("follow")).select(F.col("state").alias("node"), "follow")
    spread = graph.required(spread_over, seeds)
    # What is reached over at least one edge has that reason too, seeds included.
    arrived = spread.select(F.col("node").alias("src"), "follow").join(spread_over, "src").where(F.col("follow") | (F.col("kind") != "visibility_parent")).select(F.col("dst").alias("state")).distinct()
    all_reasons = reasons.unionByName(arrived.join(d.select("state").distinct(), "state", "left_semi").select("state", F.lit(SPREAD).alias("reason")))
    required = fixpoint.cut(all_reasons.join(d.select("state", "node").distinct(), "state").groupBy("node").agg(F.array_sort(F.collect_set("reason")).alias("reasons")))
    starts = roots.where("kind <> 'required_public'").select(F.col("state").alias("node"), "class").unionByName(crossing.where("class = 'production'").select(F.col("dst").alias("node"), "class")).distinct()
    runtime = e.where("kind <> 'visibility_requirement'").select("src", "dst").distinct()
    live = graph.reachable(runtime, starts, ("class",)).join(d.select("state", F.col("node").alias("n")).distinct(), F.col("node") == F.col("state")).groupBy("n").agg(F.bool_or(F.col("class") == "production").alias("live_production"), F.bool_or(F.col("class") == "nonproduction").alias("live_nonproduction")).withColumnRenamed("n", "node")
    live = fixpoint.cut(live)
    order = F.struct((F.col("role") != "production").alias("o"), "invocation", "compiler_id")
    best = d.where("eligible").groupBy("node").agg(F.min_by(F.struct("invocation", "compiler_id", "package", "target", "definition_path", F.col("kind"), "source_path", "span", "token"), order).alias("best"))
    suppressed = roots.where((F.col("kind") == "conservative") & (F.col("reason") == ALLOWED_DEAD)).select("node").distinct()
    flags = d.where("token is not null").select("token", "node").distinct()
    flags = flags.join(best.select("node", F.lit(True).alias("c")), "node", "left").join(required.select("node", F.lit(True).alias("r")), "node", "left").join(suppressed.withColumn("s", F.lit(True)), "node", "left")
    safe = graph.all_of(flags, ["token"], F.col("c").isNotNull() & F.col("r").isNull() & F.col("s").isNull())
    safe_nodes = flags.join(safe.select("token"), "token", "left_semi").select("node").distinct()
    production = d.where("role = 'production'").select("node").distinct().withColumn("in_production", F.lit(True))
    found = best.join(safe_nodes, "node", "left_semi").join(live, "node", "left").join(production, "node", "left")
    lp, ln = F.coalesce("live_production", F.lit(False)), F.coalesce("live_nonproduction", F.lit(False))
    findings = found.select("node", "best.*", F.when(~lp & ~ln, "dead").otherwise("unnecessary_public").alias("finding"), lp.alias("live_production"), ln.alias("live_nonproduction"), F.col("in_production").isNull().alias("test_compiled_only"))
    return {"definitions": d, "edges": e, "roots": roots, "crossing_roots": crossing.where("class = 'production'").select(F.col("dst").alias("state"), "class").distinct(), "required": required, "live": live, "candidates": best, "suppressed": suppressed, "findings": findings, "errors": errors}


def summary(a: dict[str, DataFrame]) -> DataFrame:
    """One row of the nine counts."""
    one = lambda df, *cols: df.agg(*cols)
    rows = F.count("*")
    roots = a["roots"].where("kind <> 'required_public'").select("state", "class").unionByName(a["crossing_roots"]).distinct()
    parts = [
        one(a["definitions"].select("node").distinct(), rows.alias("definition_nodes")),
        one(a["edges"], rows.alias("reference_edges")),
        one(roots, F.count_if(F.col("class") == "production").alias("production_roots"), F.count_if(F.col("class") == "nonproduction").alias("nonproduction_roots")),
        one(a["live"], F.count_if("live_production").alias("production_live"), F.count_if("live_nonproduction").alias("nonproduction_live")),
        one(a["candidates"], rows.alias("public_candidates")),
        one(a["findings"], F.count_if(F.col("finding") == "dead").alias("dead_public"), F.count_if(F.col("finding") == "unnecessary_public").alias("unnecessary_public")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def shown_path(source: DataFrame, root: str) -> DataFrame:
    """``source`` (package, local_path, remapped_path, generated, source_hash_algorithm,
    source_hash) with ``shown``: authored files relative to ``root``, generated ones by a
    label that no build's folder changes: owner, digest's first 16 digits, file name."""
    name = F.element_at(F.split("local_path", "/"), -1)
    label = F.concat(F.lit("<generated>/"), F.col("package"), F.lit("/"), F.col("source_hash_algorithm"), F.lit("-"), F.substring("source_hash", 1, 16), F.lit("/"), F.when(name == "", "generated.rs").otherwise(name))
    relative = F.when(F.startswith("local_path", F.lit(root + "/")), F.substr("local_path", F.lit(len(root) + 2))).otherwise(F.col("local_path"))
    return source.withColumn("shown", F.when(F.col("generated"), label).otherwise(F.regexp_replace(relative, r"\\", "/")))


def required_visibility(a: dict[str, DataFrame]) -> DataFrame:
    """Authored items that are required, with their reasons, in order."""
    own = a["definitions"].where("visibility_editable and source_path is not null and generated = false and expansion_origin = 'authored' and nominal_visibility = 'public'")
    one = own.groupBy("node").agg(F.min(F.struct("package", "target", "definition_path", "kind", "source_path")).alias("d"))
    return a["required"].join(one, "node").select("d.*", "reasons").orderBy("package", "target", "definition_path", "kind")


def select(a: dict[str, DataFrame], package: str, path: str, location: tuple[str, int, int] | None = None) -> DataFrame:
    """The physical declarations (token or node) that a query names."""
    d = a["definitions"].where((F.col("package") == package) & (F.col("definition_path") == path))
    if location:
        d = d.where((F.col("source_path") == location[0]) & (F.col("span.line") == location[1]) & (F.col("span.column") == location[2]))
    return d.select(F.coalesce("token", "node").alias("physical"), "node", "state", "invocation", "package", "target", "definition_path", "kind", "source_path", "span")


def choices(a: dict[str, DataFrame], selected: DataFrame, path: str) -> DataFrame:
    """What a query that names no declaration, or several, may have meant: those it names,
    else all of its last name, each with its place, in order."""
    last = F.element_at(F.split("definition_path", "::"), -1)
    named = selected if not selected.isEmpty() else a["definitions"].where(last == path.rsplit("::", 1)[-1])
    at = [F.col("span.line").alias("line"), F.col("span.column").alias("column")]
    return named.select("package", "definition_path", "kind", "source_path", *at).distinct().orderBy("package", "definition_path", "source_path", "line", "column")


def impact(a: dict[str, DataFrame], selected: DataFrame) -> dict[str, DataFrame] | None:
    """Who depends on one declaration; None if it is not exactly one (see ``choices``).

    direct: references into it; consumers: all that reach it, by physical declaration,
    without itself; witnesses: a shortest path for each class of provenance;
    disposition: one row."""
    selected = fixpoint.cut(selected)
    if selected.select("physical").distinct().count() != 1:
        return None
    states = selected.select(F.col("state").alias("node")).distinct()
    d, e = a["definitions"], a["edges"]
    nodes = d.select(F.col("state").alias("_s"), "node", F.coalesce("token", "node").alias("physical"), "definition_path", "package", "source_path", "expansion_origin", provenance(F.col("context"), F.col("role")).alias("class")).dropDuplicates(["_s"])
    inside = states.withColumnRenamed("node", "dst")
    direct = e.join(inside, "dst", "left_semi").join(states.select(F.col("node").alias("src")), "src", "left_anti").join(nodes, F.col("src") == F.col("_s")).select("definition_path", "package", "source_path", "class", F.col("kind"), F.col("span.line").alias("line"), F.col("span.column").alias("column"), (F.col("expansion_origin") == "authored").alias("authored")).distinct()
    levels = fixpoint.cut(graph.reverse_levels(e.select("src", "dst").distinct(), states))
    met = fixpoint.cut(levels.join(nodes.withColumnRenamed("node", "item"), F.col("node") == F.col("_s")).join(selected.select("physical").distinct(), "physical", "left_anti"))
    consumers = met.groupBy("physical").agg(F.min("level").alias("level"), F.min("definition_path").alias("definition_path"))
    # Only the nearest consumers of each class can have its shortest path.
    nearest = met.join(met.groupBy(F.col("class").alias("_c")).agg(F.min("level").alias("_l")), (F.col("class") == F.col("_c")) & (F.col("level") == F.col("_l")), "left_semi")
    first = None
    if not met.isEmpty():
        named = graph.witness_paths(levels, nearest.select("node").distinct()).join(nearest.select("node", "class").distinct(), "node")
        # Ties go by the text of the path's items, which no run's ids change.
        texts = fixpoint.cut(named.select("class", "path", F.posexplode("path").alias("n", "at")).join(nodes.select(F.col("_s").alias("at"), F.concat_ws(" ", "package", "definition_path").alias("text")).distinct(), "at", "left"))
        key = texts.groupBy("class", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("texts"))
        first = key.groupBy("class").agg(F.min_by(F.struct("path", "texts", (F.size("path") - 1).alias("steps")), F.struct(F.size("path").alias("s"), "texts", "path")).alias("w")).select("class", "w.path", "w.texts", "w.steps")
    shared = d.join(selected.select(F.col("physical")).distinct(), F.coalesce(d["token"], d["node"]) == F.col("physical"), "left_semi").select("node").distinct()
    any_of = lambda t, name: shared.join(t.select("node").distinct(), "node", "left_semi").agg((F.count("*") > 0).alias(name))
    flags = any_of(a["required"], "required").crossJoin(any_of(a["suppressed"], "suppressed")).crossJoin(any_of(a["findings"], "finding")).crossJoin(any_of(a["findings"].where("finding = 'dead'"), "dead")).crossJoin(any_of(a["candidates"], "candidate"))  # one row each
    disposition = F.when(F.col("required"), "required_public").when(F.col("suppressed"), "suppressed").when(F.col("dead"), "dead").when(F.col("finding"), "unnecessary_public").when(F.col("candidate"), "public").otherwise("not_a_candidate")
    return {"direct": direct.orderBy(F.desc("authored"), "package", "definition_path", "line", "column"), "consumers": consumers, "consumer_count": consumers.agg(F.count_distinct("physical").alias("consumers")), "witnesses": first, "disposition": flags.select(disposition.alias("disposition"))}
