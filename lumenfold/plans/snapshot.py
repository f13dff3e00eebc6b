"""Source metrics of snapshots: files to states to roles to totals.

Measuring is one pass over the files, each by itself, in Arrow batches; a file leaves
it as its sums by state of reachability, never as lines or tokens.  Everything after
is joins and aggregations over one row or a few for each file.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cfg, lattice
from ..functions.rust_syntax import STATES, Source, shared
from ..operators import graph, metrics
from . import fixpoint

MEASURED = "snapshot string, path string, bytes long, errors int, first_error string, metrics array<array<long>>, edges array<struct<production: int, test: int, candidates: array<string>, message: string>>"
_ARROW = pa.schema(
    [
        ("snapshot", pa.string()),
        ("path", pa.string()),
        ("bytes", pa.int64()),
        ("errors", pa.int32()),
        ("first_error", pa.string()),
        ("metrics", pa.list_(pa.list_(pa.int64()))),
        ("edges", pa.list_(pa.struct([("production", pa.int32()), ("test", pa.int32()), ("candidates", pa.list_(pa.string())), ("message", pa.string())]))),
    ]
)
#: Kinds of targets that seed the module graph.
TARGET_ROLES = ("production", "test", "bench", "example", "build")
#: Measured files in a batch: each is under 1 KB and its edges.
ROWS_AT_ONCE = 1000
_REACHED = [f"{r}_{h}" for r in TARGET_ROLES for h in "pt"]
#: Columns that ``contexts`` gives.
CONTEXT = f"snapshot string, path string, referenced boolean, {', '.join(f'{c} int' for c in _REACHED)}"
ROLE_ORDER = ("production", "test", "bench", "example", "build", "conditional", "inactive", "orphan")


def measured(files: DataFrame, profile: cfg.Profile | None = None, packages: list[tuple[str, cfg.Profile]] = ()) -> DataFrame:
    """``files`` (snapshot, path, content) -> a row for each with its metrics by state
    and its module edges.  ``packages``: (root, profile); the longest root that holds a
    path gives its profile, and is its manifest folder."""
    plain = profile or cfg.Profile(enabled=None)

    def made(rows: pa.RecordBatch, sources: list[Source]) -> pa.RecordBatch:
        # Sources of one walk are one object: what it says is turned into Arrow once.  A state without any is NULL.
        own = {id(s): s for s in sources}
        place = dict(zip(own, range(len(own))))
        said = [
            [len(s.errors) for s in own.values()],
            [s.errors[0] if s.errors else None for s in own.values()],
            [[m if any(m) else None for m in s.metrics] for s in own.values()],
            [[{"production": e.gate[0], "test": e.gate[1], "candidates": e.candidates, "message": e.message} for e in s.edges] for s in own.values()],
        ]
        at = pa.array([place[id(s)] for s in sources], pa.int32())
        columns = [*rows.columns[:2], pc.fill_null(pc.binary_length(rows.column(2)), 0), *[pa.array(x, f.type).take(at) for x, f in zip(said, list(_ARROW)[3:])]]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = sorted(packages, key=lambda p: -len(p[0]))
        seen: dict[str | None, dict] = defaultdict(dict)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                rows = whole.slice(at, ROWS_AT_ONCE)
                paths, contents = (c.to_numpy(zero_copy_only=False) for c in rows.columns[1:])
                sources = []
                for path, content in zip(paths, contents):
                    folder, own = next(((r, p) for r, p in owners if not r or path == r or path.startswith(r + "/")), (None, plain)) if owners else (None, plain)
                    sources.append(shared(path, content or b"", own, folder, seen[folder]))
                yield made(rows, sources)

    return files.select("snapshot", "path", "content").mapInArrow(run, MEASURED)


def expanded(files: DataFrame, load, measure=measured) -> DataFrame:
    """``files`` as ``measured`` gives them, with those that only their module edges reach.

    ``load`` takes (snapshot, path) of candidates that were never asked for and gives the
    files that exist (snapshot, path, content); each round measures only these.  Files
    given at first have ``found`` false, the others true."""
    known = fixpoint.cut(files.withColumn("found", F.lit(False)))
    asked = fixpoint.cut(known.select("snapshot", "path"))
    new = known
    while True:
        edges = new.select("snapshot", F.explode("edges").alias("e")).select("snapshot", F.explode("e.candidates").alias("path")).distinct()
        wanted = fixpoint.cut(edges.join(asked, ["snapshot", "path"], "left_anti"))
        if wanted.isEmpty():
            return known
        asked = fixpoint.cut(asked.unionByName(wanted))
        new = fixpoint.cut(measure(load(wanted)).withColumn("found", F.lit(True)))
        known = fixpoint.cut(known.unionByName(new))


def _nothing(files: DataFrame, schema: str) -> DataFrame:
    """No rows, and the planner knows it."""
    return files.sparkSession.sql(f"SELECT {', '.join(f'CAST(NULL AS {kind}) AS {c}' for c, kind in map(str.split, schema.split(', ')))} WHERE false")


def _node(snapshot, path):
    return F.concat(snapshot, F.lit("\x1f"), path)


def resolved(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Module edges by the first candidate that exists: (src, dst, production, test),
    and those without any: (snapshot, path, production, test, message)."""
    edges = files.select("snapshot", "path", F.posexplode("edges").alias("n", "e")).select("snapshot", "path", "n", "e.*")
    if not fixpoint.some(files.where("size(edges) > 0").select(F.lit(1))):
        return _nothing(files, "src string, dst string, production int, test int"), _nothing(files, "snapshot string, path string, production int, test int, message string")
    # Most files have no edge: of all files only those that an edge may lead to are dealt out.
    tried = fixpoint.cut(edges.select("*", F.posexplode_outer("candidates").alias("rank", "target")))
    there = files.select(F.col("snapshot").alias("_s"), F.col("path").alias("_p")).join(tried.select(F.col("snapshot").alias("_s"), F.col("target").alias("_p")).distinct(), ["_s", "_p"], "left_semi")
    met = tried.join(there, (F.col("snapshot") == F.col("_s")) & (F.col("target") == F.col("_p")), "left")
    first = met.groupBy("snapshot", "path", "n", "production", "test", "message").agg(F.min_by("_p", F.when(F.col("_p").isNotNull(), F.col("rank"))).alias("to"))
    good = fixpoint.cut(first.where("to is not null").select(_node(F.col("snapshot"), F.col("path")).alias("src"), _node(F.col("snapshot"), F.col("to")).alias("dst"), "production", "test").distinct())
    return good, first.where("to is null").select("snapshot", "path", "production", "test", "message")


def contexts(files: DataFrame, edges: DataFrame, targets: DataFrame | None) -> DataFrame:
    """(snapshot, path, referenced, and <role>_p, <role>_t of each target role) of the files
    that an edge or a target names.

    ``targets``: snapshot, path, role, production, test.  Without targets library and
    main files are production first, and then whatever nothing refers to.  ``in_context``
    has the other files: nothing reaches them, and they reach nothing."""
    if targets is None and not fixpoint.some(edges):
        return _nothing(files, CONTEXT)
    halves = edges.select("src", "dst", F.explode(F.array(F.struct(F.lit("p").alias("half"), F.col("production").alias("gate")), F.struct(F.lit("t").alias("half"), F.col("test").alias("gate")))).alias("h")).select("src", "dst", "h.half", "h.gate")
    named = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    if targets is not None:
        named = named.unionByName(targets.select(_node(F.col("snapshot"), F.col("path")).alias("node")))
    nodes = fixpoint.cut(files.select(_node(F.col("snapshot"), F.col("path")).alias("node"), "snapshot", "path").join(named.distinct(), "node", "left_semi"))

    def seeded(t: DataFrame) -> DataFrame:
        return t.select("node", "role", F.explode(F.array(F.struct(F.lit("p").alias("half"), F.col("production").alias("value")), F.struct(F.lit("t").alias("half"), F.col("test").alias("value")))).alias("h")).select("node", "role", "h.half", "h.value")

    both = [F.lit("production").alias("role"), F.lit(2).alias("production"), F.lit(2).alias("test")]
    if targets is not None:
        seeds = targets.select(_node(F.col("snapshot"), F.col("path")).alias("node"), "role", "production", "test").join(nodes.select("node"), "node", "left_semi")
        seen = graph.reachable(edges, seeds.select("node"))
    else:
        seeds = nodes.where(F.element_at(F.split("path", "/"), -1).isin("lib.rs", "main.rs")).select("node", *both)
        seen = graph.reachable(edges, seeds.select("node"))
        rest = nodes.select("node").join(seen, "node", "left_anti")
        seeds = fixpoint.cut(seeds.unionByName(rest.select("node", *both)))
        seen = graph.reachable(edges, seeds.select("node"))
    values = graph.propagate(halves, seeded(seeds), own=("role",), shared=("half",))
    wide = values.groupBy("node").agg(*[F.coalesce(F.max(F.when((F.col("role") == r) & (F.col("half") == h), F.col("value"))), F.lit(0)).alias(f"{r}_{h}") for r in TARGET_ROLES for h in "pt"])
    return fixpoint.cut(nodes.join(wide, "node", "left").join(seen.withColumn("referenced", F.lit(True)), "node", "left").na.fill(0).select("snapshot", "path", F.coalesce("referenced", F.lit(False)).alias("referenced"), *_REACHED))


def in_context(rows: DataFrame, ctx: DataFrame, targets: DataFrame | None) -> DataFrame:
    """``rows`` (snapshot, path, ...) with the columns of ``ctx``.  A file outside of it is
    no target's; without targets nothing refers to it, so it is production."""
    own = {"production_p": 2, "production_t": 2} if targets is None else {}
    kept = [c for c in rows.columns if c not in ("snapshot", "path")]
    met = rows.join(ctx, ["snapshot", "path"], "left")
    return met.selectExpr("snapshot", "path", *kept, f"coalesce(referenced, {targets is None}) AS referenced", *[f"coalesce({c}, {own.get(c, 0)}) AS {c}" for c in _REACHED])


def role_of(p: str | int, t: str | int) -> str:
    """The output role, as SQL, of a local state (p, t), columns or values, in a file's contexts."""
    at = lambda c, x: "0" if x == 0 else c if x == 2 else f"least({c}, {x})"
    in_production, in_test = (lambda r: at(f"{r}_p", p)), (lambda r: at(f"{r}_t", t))
    tested = f"greatest({in_test('test')}, {in_test('production')}, {in_test('example')})"
    return lattice.classify_sql(in_production("production"), in_production("example"), tested, in_test("bench"), in_production("build"), "referenced")


def by_state(files: DataFrame, ctx: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(snapshot, path, role, files, metrics...): a row for each state that a file has lines
    in.  ``files`` is 1 in one row of each of a file's roles and 0 in the others, so sums
    by role, by file or of all are those of ``by_role``; no row leaves its task for it."""
    own = in_context(files.select("snapshot", "path", "metrics"), ctx, targets)
    # Below the explosion and by itself, so that where no file has a context roles are constants.
    roles = ", ".join(f"CASE WHEN get(metrics, {i}) IS NOT NULL THEN {role_of(i // 3, i % 3)} END" for i in range(STATES))
    own = own.selectExpr("snapshot", "path", "metrics", f"array({roles}) AS _roles")
    states = own.selectExpr("snapshot", "path", "_roles", "posexplode(metrics) AS (_state, _m)").where("_m IS NOT NULL")
    first = "CAST(array_position(_roles, _roles[_state]) = _state + 1 AS BIGINT) AS files"
    return states.selectExpr("snapshot", "path", "_roles[_state] AS role", first, *[f"_m[{i}] AS {m}" for i, m in enumerate(metrics.METRICS)])


def by_role(states: DataFrame) -> DataFrame:
    """``by_state`` -> (snapshot, path, role, files, metrics...): a row for each role that a
    file has lines in."""
    return metrics.buckets(states, ["snapshot", "path", "role"]).withColumn("files", F.lit(1).cast("long"))


def placed(files: DataFrame, targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``files`` as ``measured`` or ``expanded`` gives them -> themselves as a table, their
    states as ``by_state`` has them, and unresolved edges where they are reachable.
    Files that only edges reach take part in the graph and are in none of the three."""
    files = fixpoint.cut(files)
    edges, lost = resolved(files)
    ctx = contexts(files, edges, targets)
    if "found" in files.columns:
        files = files.where("not found").drop("found")
        lost = lost.join(files.select("snapshot", "path"), ["snapshot", "path"], "left_semi")
    gone = in_context(lost, ctx, targets).withColumn("role", F.expr(role_of("production", "test"))).where(~F.col("role").isin("inactive", "orphan"))
    return files, by_state(files, ctx, targets), gone


def report(files: DataFrame, targets: DataFrame | None = None) -> dict[str, DataFrame]:
    """``files`` as ``measured`` or ``expanded`` gives them -> the tables of a report.
    Files that only edges reach take part in the graph and are not reported.

    roles: by file and role; project: by role; total: a row for each snapshot;
    diagnostics: syntax errors, and unresolved edges where they are reachable.
    """
    files, states, gone = placed(files, targets)
    roles = fixpoint.cut(by_role(states))
    project = roles.groupBy("snapshot", "role").agg(*[F.sum(m).cast("long").alias(m) for m in ("files", *metrics.METRICS)])
    total = files.groupBy("snapshot").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("errors").cast("long").alias("syntax_errors"))
    sums = roles.groupBy("snapshot").agg(*[F.sum(m).cast("long").alias(m) for m in metrics.METRICS])
    syntax = files.where("errors > 0").select("snapshot", "path", F.concat(F.col("errors").cast("string"), F.lit(" syntax error(s); first: "), F.col("first_error")).alias("message"))
    return {"files": files, "roles": roles, "project": project, "total": total.join(sums, "snapshot", "left").na.fill(0), "diagnostics": syntax.unionByName(gone.select("snapshot", "path", "message")).dropDuplicates()}


def _sided(roles: DataFrame, before: str, after: str):
    """``roles`` with the side of each row, and a side's sum of a metric as SQL.  Both sides
    take one aggregation; a side that a key isn't in is NULL."""
    sides = roles.withColumn("_side", F.when(F.col("snapshot") == before, "b").when(F.col("snapshot") == after, "a"))
    return sides, lambda s, m: f"CAST(sum(CASE WHEN _side = '{s}' THEN {m} END) AS BIGINT) AS _{s}_{m}"


def changed_roles(roles: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """The change of each role, zeros filled, of rows as ``compared`` takes them."""
    from ..operators import compare

    counted = ["files", *metrics.METRICS]
    sides, own = _sided(roles, before, after)
    dimension = roles.sparkSession.sql(f"SELECT explode(array({', '.join(f"'{r}'" for r in ROLE_ORDER)})) AS role")
    folded = sides.groupBy("role").agg(*[F.expr(own(s, m)) for s in "ba" for m in counted])
    return dimension.join(folded, "role", "left").na.fill(0).selectExpr("role", *[c for m in counted for c in compare.change(f"_b_{m}", f"_a_{m}", m)])


def compared(roles: DataFrame, before: str = "before", after: str = "after", reported: bool = False, written: bool = False) -> dict[str, DataFrame]:
    """Two snapshots of one ``report``: changed files, roles and the summary.  A file stands
    once in each role of its snapshot, or the sides can't be compared.  ``reported``: the
    rows are as ``report`` or ``placed`` gives them and aren't looked at for it; states of
    ``placed`` give the same sums and needn't be grouped by file first.
    ``written``: several of the tables will be read, so both sides of each file are a table."""
    from ..operators import compare

    if not reported:
        compare.unique(roles, ["snapshot", "path", "role"])
    names = [*metrics.METRICS, "production_code", "test_code", "other_code"]
    sides, own = _sided(roles, before, after)
    code = [f"CAST(sum(CASE WHEN _side = '{s}' THEN CASE WHEN role = '{r}' THEN code ELSE 0 END END) AS BIGINT) AS _{s}_{r}_code" for s in "ba" for r in ("production", "test")]
    files = sides.groupBy("path").agg(*map(F.expr, [*[own(s, m) for s in "ba" for m in metrics.METRICS], *code, *[f"bool_or(CASE WHEN _side = '{s}' THEN true END) AS _{s}" for s in "ba"]]))
    for s in "ba":
        files = files.withColumn(f"_{s}_other_code", F.when(F.col(f"_{s}"), compare.other_lines(F.col(f"_{s}_code"), F.col(f"_{s}_production_code"), F.col(f"_{s}_test_code"))))
    files = fixpoint.cut(files) if written else files
    changed = compare.changed(files, ["path"], names)
    return {"files": changed, "roles": changed_roles(roles, before, after), "summary": compare.summed(files, names), "contributors": compare.contributors(changed, ["production_code", "test_code", "other_code"], list(metrics.METRICS), "path")}
