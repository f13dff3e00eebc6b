"""The engine's source and compiler operators on sources and facts that are written from
the tables' rows by a fixed rule, each beside the SQL that says what must come out.

Each source is a few lines of Rust whose counts follow from the row's numbers, so the
walker, the module graph, the predicates and the reports are compared with plain
arithmetic over the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cfg
from ..operators.metrics import METRICS
from ..sources import build
from . import fixpoint, snapshot
from .analogues import _changes, query, table

_METRICS = ", ".join(METRICS)


def _lines(*lines: str | Column) -> Column:
    """Lines with their ends; a column may hold several or none."""
    return F.concat(*[F.lit(x + "\n") if isinstance(x, str) else x for x in lines])


def _file(path: Column, text: Column, side: str | Column = "after") -> list[Column]:
    return [(F.lit(side) if isinstance(side, str) else side).alias("snapshot"), path.alias("path"), text.cast("binary").alias("content")]


def _part_source(n: Column) -> Column:
    """A function with ``n`` branches, public for even parts, and a test module."""
    k = F.col("p_partkey")
    return _lines(
        F.concat(F.lit("//! part "), k.cast("string"), F.lit("\n\n/// item\n"), F.when(k % 2 == 0, "pub ").otherwise(""), F.lit("fn part(x: u32) -> u32 {\n    // note\n")),
        F.repeat(F.lit("    if x > 1 && x < 9 { return 1; }\n"), n),
        "    for i in 0..x { while i > x { step(i)?; } }",
        "    match x { 0 => 1, 1 => 2, _ => 3 }",
        "}",
        "",
        "#[cfg(test)]",
        "mod tests {",
        "    #[test]",
        "    fn holds() { if true { run!(a && if c { d }); } }",
        "}",
    )


def _parts(spark, sf_dir) -> DataFrame:
    """The part rows, dealt out before sources are written from them.

    A table of small rows lies in one task or two, and measuring a source takes far
    longer than reading its row; a set number of parts is kept where a small size
    would have them put together again."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(8 * spark.sparkContext.defaultParallelism, "p_partkey")


def _part_path() -> Column:
    return F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/lib.rs"))


def _part_sql(name: str, n: str, where: str) -> str:
    """CTE ``name``: (path, role, metrics) of the sources that ``_part_source`` writes."""
    return f"""{name} AS (SELECT 'p' || p_partkey || '/lib.rs' AS path, unnest([
  {{'role': 'production', 'm': [9 + n, 4 + n, 3, 2, 2, 2 * n + 4, 2 * n + 6, 2 * n + 5, 1 - k % 2]}},
  {{'role': 'test', 'm': [5, 5, 0, 0, 0, 2, 2, 1, 0]}}]) AS r FROM (SELECT p_partkey, p_partkey AS k, {n} AS n FROM part WHERE {where}))"""


_NINE = ", ".join(f"CAST(r.m[{i + 1}] AS BIGINT) AS {m}" for i, m in enumerate(METRICS))


@query(f"WITH {_part_sql('s', 'p_size % 4', 'true')} SELECT 'after' AS snapshot, path, r.role AS role, CAST(1 AS BIGINT) AS files, {_NINE} FROM s")
def q26_source_metrics(spark, sf_dir):
    """Sources to tokens, lines, decisions, states and roles."""
    files = _parts(spark, sf_dir).select(*_file(_part_path(), _part_source(F.col("p_size") % 4)))
    return snapshot.report(snapshot.measured(files))["roles"].select("snapshot", "path", "role", "files", *METRICS)


@query("""
SELECT 's' || s_suppkey || '.rs' AS path, CASE s_suppkey % 3 WHEN 0 THEN 'source is not valid UTF-8' END AS fixed_error, s_suppkey % 3 < 2 AS broken,
  CAST(CASE s_suppkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS code, CAST(CASE s_suppkey % 3 WHEN 0 THEN 1 ELSE 0 END AS BIGINT) AS blank, s_suppkey % 3 < 2 AS reported
FROM supplier""")
def q27_source_errors(spark, sf_dir):
    """Bytes that are no UTF-8 are raw lines, broken syntax is told and still measured."""
    k = F.col("s_suppkey") % 3
    content = F.when(k == 0, F.concat(F.lit("a\n \n").cast("binary"), F.unhex(F.lit("FF0A")))).when(k == 1, F.lit("fn f( {\n").cast("binary")).otherwise(F.lit("fn f() {\n}\n").cast("binary"))
    files = table(spark, sf_dir, "supplier").select(F.lit("after").alias("snapshot"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".rs")).alias("path"), content.alias("content"))
    made = snapshot.report(snapshot.measured(files))
    told = made["diagnostics"].select("path").distinct().withColumn("reported", F.lit(True))
    code = made["roles"].groupBy("path").agg(F.sum("code").alias("code"), F.sum("blank").alias("blank"))
    fixed = F.when(F.col("first_error") == "source is not valid UTF-8", F.col("first_error"))
    return made["files"].join(code, "path").join(told, "path", "left").select("path", fixed.alias("fixed_error"), (F.col("errors") > 0).alias("broken"), "code", "blank", F.coalesce("reported", F.lit(False)).alias("reported"))


def _module_tree(spark, sf_dir) -> DataFrame:
    """A library for each region that names its nations' modules; their files lie where
    the number says, or nowhere."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/src/")).alias("d"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("m"))
    line = F.concat(F.when(F.col("k") % 3 == 0, "#[cfg(test)]\n").otherwise(""), F.when(F.col("k") % 5 == 0, F.concat(F.lit('#[path = "odd/'), F.col("m"), F.lit('.rs"]\n'))).otherwise(""), F.lit("mod "), F.col("m"), F.lit(";\n"))
    libs = n.groupBy("d").agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("text")).select(*_file(F.concat("d", F.lit("lib.rs")), F.col("text")))
    body = F.concat(F.lit('pub fn f() {}\ninclude!("data'), (F.col("k") % 2).cast("string"), F.lit('.rs");\n'))
    at = F.when(F.col("k") % 5 == 0, F.array(F.concat(F.lit("odd/"), F.col("m"), F.lit(".rs")))).when(F.col("k") % 4 == 0, F.array(F.concat("m", F.lit(".rs")))).when(F.col("k") % 4 == 1, F.array(F.concat("m", F.lit("/mod.rs")))).when(F.col("k") % 4 == 3, F.array(F.concat("m", F.lit(".rs")), F.concat("m", F.lit("/mod.rs")))).otherwise(F.array().cast("array<string>"))
    mods = n.select("d", body.alias("body"), F.explode(at).alias("at")).select(*_file(F.concat("d", "at"), F.col("body")))
    data = n.select("d").distinct().select(*_file(F.concat("d", F.lit("data0.rs")), F.lit("pub fn g() {}\n")))
    return libs.unionByName(mods).unionByName(data)


_TREE = """
WITH n AS (SELECT n_nationkey AS k, 'r' || n_regionkey || '/src/' AS d, 'n' || n_nationkey AS m FROM nation),
places AS (SELECT k, d, unnest(CASE WHEN k % 5 = 0 THEN ['odd/' || m || '.rs'] WHEN k % 4 = 0 THEN [m || '.rs'] WHEN k % 4 = 1 THEN [m || '/mod.rs'] WHEN k % 4 = 3 THEN [m || '.rs', m || '/mod.rs'] ELSE [] END) AS f FROM n)"""


@query(f"""{_TREE},
x AS (SELECT d || f AS path, CASE WHEN k % 3 = 0 AND NOT (k % 5 <> 0 AND k % 4 = 3 AND f LIKE '%/mod.rs') THEN 'test' ELSE 'production' END AS role, 2 AS code, 1 AS pub FROM places
  UNION ALL SELECT d || 'lib.rs', 'production', count(*) FILTER (WHERE k % 3 <> 0) + count(*) FILTER (WHERE k % 3 <> 0 AND k % 5 = 0), 0 FROM n GROUP BY d
  UNION ALL SELECT d || 'lib.rs', 'test', 2 * count(*) FILTER (WHERE k % 3 = 0) + count(*) FILTER (WHERE k % 3 = 0 AND k % 5 = 0), 0 FROM n GROUP BY d HAVING count(*) FILTER (WHERE k % 3 = 0) > 0)
SELECT path, role, CAST(code AS BIGINT) AS code, CAST(pub AS BIGINT) AS declared_public FROM x
UNION ALL SELECT d || 'data0.rs', CASE WHEN seen IS NULL OR seen THEN 'production' ELSE 'test' END, 1, 1 FROM (SELECT DISTINCT d FROM n) LEFT JOIN (SELECT d, bool_or(role = 'production') AS seen FROM (SELECT d, k, CASE WHEN k % 3 = 0 AND NOT (k % 5 <> 0 AND k % 4 = 3 AND f LIKE '%/mod.rs') THEN 'test' ELSE 'production' END AS role FROM places WHERE f NOT LIKE '%/%' AND k % 2 = 0) GROUP BY d) USING (d)""")
def q28_module_graph(spark, sf_dir):
    """Modules found by the first candidate that exists; gates spread over files."""
    made = snapshot.report(snapshot.measured(_module_tree(spark, sf_dir)))
    return made["roles"].select("path", "role", "code", "declared_public")


@query(f"""{_TREE}
SELECT d || 'lib.rs' AS path, CAST(count(*) AS BIGINT) AS lost FROM n WHERE k % 5 <> 0 AND k % 4 = 2 GROUP BY d
UNION ALL SELECT d || f, 1 FROM places WHERE k % 2 = 1 OR f LIKE '%/%'""")
def q29_unresolved_edges(spark, sf_dir):
    """Modules and includes without a file, where they are reachable."""
    made = snapshot.report(snapshot.measured(_module_tree(spark, sf_dir)))
    return made["diagnostics"].groupBy("path").agg(F.count("*").alias("lost"))


#: Predicates with what they are in production and in tests, under the profile of the query.
_PREDICATES = (
    ("#[cfg(all())]", 2, 2),
    ("#[cfg(any())]", 0, 0),
    ("#[cfg(not(test))]", 2, 0),
    ('#[cfg(all(unix, feature = "on"))]', 2, 2),
    ('#[cfg(any(windows, feature = "off"))]', 0, 0),
    ("#[cfg(custom)]", 1, 1),
    ("#[cfg(all(custom, test))]", 0, 1),
    ('#[cfg(target_os = "linux")]', 0, 0),
    ('#[cfg(named = "b")]', 0, 0),
    ('#[cfg(named = "a")]', 2, 2),
    ("#[cfg(any(not(custom), true))]", 2, 2),
    ("#[cfg(feature)]", 1, 1),
    ('#[cfg(all(not(feature = "gone"), doctest))]', 0, 2),
    ("#[cfg(forced_off)]", 0, 0),
    ("#[cfg(forced_on)]", 2, 2),
    ("#[cfg(false)]", 0, 0),
    ("#[cfg(all(unix)]", 1, 1),
    ("#[test]", 0, 2),
    ("#[tokio :: test]", 0, 2),
    ("#[my::check]", 0, 2),
    ("#[inline]", 2, 2),
    ("#[cfg_attr(unix, test)]", 0, 2),
    ("#[cfg_attr(windows, test)]", 2, 2),
    ("#[cfg_attr(custom, cfg(test), cfg(any()))]", 1, 1),
    ("#[cfg(custom)] #[cfg(test)]", 0, 1),
    ("#[cfg(not(any(unix, custom)))]", 0, 0),
)
_PREDICATE_ROWS = ", ".join(f"({i}, {p}, {t})" for i, (_, p, t) in enumerate(_PREDICATES))


@query(f"""
WITH v(i, production, test) AS (VALUES {_PREDICATE_ROWS})
SELECT s_suppkey, CAST(production AS INT) AS production, CAST(test AS INT) AS test FROM supplier JOIN v ON s_suppkey % {len(_PREDICATES)} = i""")
def q30_predicates(spark, sf_dir):
    """Each item's gate, once for production and once for tests."""
    true, false, closed = build.compiler_cfg('unix\nnamed="a"\nforced_off\n', ["forced_on"], ["forced_off"])
    profile = cfg.Profile(known_true=true, known_false=false, closed_names=closed, enabled=frozenset({"on"}), excluded=frozenset({"gone"}), test_attributes=frozenset({"my::check"}))
    gates = F.element_at(F.array(*[F.lit(g) for g, _, _ in _PREDICATES]), (F.col("s_suppkey") % len(_PREDICATES) + 1).cast("int"))
    files = table(spark, sf_dir, "supplier").select(*_file(F.col("s_suppkey").cast("string"), F.concat(gates, F.lit("\nfn f() {}\n"))))
    # The state that holds the code line of the item says its gate.
    at = F.array_position(F.transform("metrics", lambda m: (m[1] > 0).cast("int")), 1) - 1
    return snapshot.measured(files, profile).select(F.col("path").cast("bigint").alias("s_suppkey"), F.floor(at / 3).cast("int").alias("production"), (at % 3).cast("int").alias("test"))


def _sides(spark, sf_dir) -> DataFrame:
    """The states of both snapshots' sources, each part dealt out once for both."""
    k, n = F.col("p_partkey"), F.col("p_size") % 4
    sides = {"before": (k % 10 != 0, n), "after": (k % 7 != 0, F.when(k % 3 == 0, F.col("p_size") % 5).otherwise(n))}
    own = F.array_compact(F.array(*[F.when(there, F.struct(F.lit(side).alias("side"), branches.alias("n"))) for side, (there, branches) in sides.items()]))
    rows = _parts(spark, sf_dir).select("p_partkey", F.inline(own))
    return snapshot.placed(snapshot.measured(rows.select(*_file(_part_path(), _part_source(F.col("n")), F.col("side")))))[1]


def _compared(spark, sf_dir, written: bool = False) -> dict[str, DataFrame]:
    return snapshot.compared(_sides(spark, sf_dir), reported=True, written=written)


_SIDES = f"""
WITH {_part_sql('sb', 'p_size % 4', 'p_partkey % 10 <> 0')}, {_part_sql('sa', 'CASE WHEN p_partkey % 3 = 0 THEN p_size % 5 ELSE p_size % 4 END', 'p_partkey % 7 <> 0')},
rb AS (SELECT path, r.role AS role, CAST(1 AS BIGINT) AS files, {_NINE} FROM sb), ra AS (SELECT path, r.role AS role, CAST(1 AS BIGINT) AS files, {_NINE} FROM sa)"""
_CODES = [*METRICS, "production_code", "test_code", "other_code"]
_SUMS = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in METRICS) + ", CAST(coalesce(sum(code) FILTER (WHERE role = 'production'), 0) AS BIGINT) AS production_code, CAST(coalesce(sum(code) FILTER (WHERE role = 'test'), 0) AS BIGINT) AS test_code, CAST(coalesce(sum(code) FILTER (WHERE role NOT IN ('production', 'test')), 0) AS BIGINT) AS other_code"
_FILES = f"""{_SIDES}, b AS (SELECT path, {_SUMS} FROM rb GROUP BY path), a AS (SELECT path, {_SUMS} FROM ra GROUP BY path),
j AS (SELECT path, b.code IS NULL AS no_b, a.code IS NULL AS no_a, {', '.join(f'coalesce(b.{m}, 0) AS b_{m}, coalesce(a.{m}, 0) AS a_{m}' for m in _CODES)} FROM b FULL JOIN a USING (path)),
c AS (SELECT path, CASE WHEN no_b THEN 'added' WHEN no_a THEN 'deleted' ELSE 'modified' END AS status, {_changes(_CODES)} FROM j WHERE {' OR '.join(f'b_{m} <> a_{m}' for m in _CODES)})"""


@query(f"{_FILES} SELECT * FROM c")
def q31_changed_files(spark, sf_dir):
    """Two snapshots of the sources by file, with role codes."""
    return _compared(spark, sf_dir)["files"]


_ROLES = ", ".join(f"('{r}')" for r in snapshot.ROLE_ORDER)
_PER_ROLE = ["files", *METRICS]


@query(f"""{_SIDES}, roles(role) AS (VALUES {_ROLES}),
b AS (SELECT role, {', '.join(f'CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}' for m in _PER_ROLE)} FROM roles LEFT JOIN rb USING (role) GROUP BY role),
a AS (SELECT role, {', '.join(f'CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}' for m in _PER_ROLE)} FROM roles LEFT JOIN ra USING (role) GROUP BY role)
SELECT role, {_changes(_PER_ROLE, 'b.{}', 'a.{}')} FROM b JOIN a USING (role)""")
def q32_changed_roles(spark, sf_dir):
    """Changes of all eight roles, zeros filled."""
    return snapshot.changed_roles(_sides(spark, sf_dir))


def _rendered(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query(f"""WITH {_part_sql('s', 'p_size % 4', 'true')}, x AS (SELECT path, r.role AS role, {_NINE} FROM s),
t AS (SELECT 'table' AS part, CASE role WHEN 'production' THEN 'Production' ELSE 'Tests' END AS label, count(*) AS files, CAST(sum(code) AS BIGINT) AS code, CAST(sum(declared_public) AS BIGINT) AS pub FROM x GROUP BY role
  UNION ALL SELECT 'table', 'Total', count(DISTINCT path), CAST(sum(code) AS BIGINT), CAST(sum(declared_public) AS BIGINT) FROM x)
SELECT * FROM t
UNION ALL SELECT 'json', role, count(*), CAST(sum(code) AS BIGINT), CAST(sum(declared_public) AS BIGINT) FROM x GROUP BY role
UNION ALL SELECT 'json', 'total', count(DISTINCT path), CAST(sum(code) AS BIGINT), CAST(sum(declared_public) AS BIGINT) FROM x
UNION ALL SELECT 'files', 'all', count(DISTINCT path), CAST(sum(code) AS BIGINT), CAST(sum(declared_public) AS BIGINT) FROM x
UNION ALL SELECT 'file table', 'production', count(DISTINCT path), CAST(sum(code) FILTER (WHERE role = 'production') AS BIGINT), CAST(sum(declared_public) FILTER (WHERE role = 'production') AS BIGINT) FROM x""")
def q33_rendered_snapshot(spark, sf_dir):
    """A report as JSON and as text, read back: roles, total by files, files."""
    import json
    import re

    from . import render

    files = _parts(spark, sf_dir).select(*_file(_part_path(), _part_source(F.col("p_size") % 4)))
    made = snapshot.report(snapshot.measured(files))
    made |= {k: fixpoint.cut(made[k]) for k in ("project", "total", "diagnostics")}
    # Parts that are rows are written as they are and read back where they lie.
    written = lambda parts: [p if isinstance(p, str) else fixpoint.cut(p) for p in parts]
    doc, text = written(render.snapshot_document(made)), written(render.snapshot_text(made, files=True))
    whole = json.loads("".join(p if isinstance(p, str) else "" for p in doc))
    roles, head = ([re.split(r" {2,}", line.strip()) for line in part.splitlines()] for part in text[0].split("\n\n"))
    number = lambda x: int(x.replace(",", ""))
    at = {name: i for i, name in enumerate(roles[0])}
    rows = [("table", r[0], number(r[1]), number(r[at["code"]]), number(r[at["declared_public"]])) for r in roles[1:]]
    rows += [("json", b["role"], b["files"], b["code"], b["declared_public"]) for b in whole["buckets"]]
    rows.append(("json", "total", whole["file_count"], whole["total"]["code"], whole["total"]["declared_public"]))
    told = doc[-2].select(F.from_json("text", "path string, buckets array<struct<code: long, declared_public: long>>").alias("f"))
    of = lambda m: F.sum(F.aggregate(F.col(f"f.buckets.{m}"), F.lit(0).cast("long"), lambda a, b: a + b)).alias(m)
    rows.append(("files", "all", *told.agg(F.count("f.path"), of("code"), of("declared_public")).first()))
    cells = text[1].select(F.split(F.trim("text"), " {2,}").alias("r"))
    shown = lambda name: F.sum(F.replace(F.col("r")[head[0].index(name)], F.lit(","), F.lit("")).cast("long"))
    rows.append(("file table", "production", *cells.agg(F.count("*"), shown("production"), shown("public")).first()))
    return _rendered(spark, rows, "part string, label string, files long, code long, pub long")


@query(f"""{_FILES}, f AS (SELECT {', '.join(f'sum(before_{m}) AS b_{m}, sum(after_{m}) AS a_{m}' for m in ('code',))} FROM c),
w AS (SELECT (SELECT CAST(sum(code) AS BIGINT) FROM b) AS b_code, (SELECT CAST(sum(code) AS BIGINT) FROM a) AS a_code)
SELECT 'summary' AS part, 'code' AS label, b_code AS before, a_code AS after, a_code - b_code AS delta FROM w
UNION ALL SELECT 'table', 'code', b_code, a_code, a_code - b_code FROM w
UNION ALL SELECT 'files', status, CAST(sum(before_code) AS BIGINT), CAST(sum(after_code) AS BIGINT), count(*) FROM c GROUP BY status
UNION ALL SELECT 'top', path, CAST(0 AS BIGINT), CAST(0 AS BIGINT), delta_code FROM (SELECT * FROM c ORDER BY abs(delta_production_code) + abs(delta_test_code) + abs(delta_other_code) DESC, {' + '.join(f'abs(delta_{m})' for m in METRICS)} DESC, path LIMIT 10)""")
def q34_rendered_comparison(spark, sf_dir):
    """A comparison as JSON and as text, read back: metrics, files, top ten."""
    import json
    import re

    from . import render

    made = _compared(spark, sf_dir, written=True)
    made |= {k: fixpoint.cut(made[k]) for k in ("summary", "roles", "contributors")}
    doc, text = render.comparison_document(made), render.comparison_table(made)
    # The files' part is written as it is and read back where it lies.
    told = fixpoint.cut(doc[-2]).select(F.from_json("text", "status string, code struct<before: long, after: long>").alias("f")).select("f.*")
    number = lambda x: int(x.replace(",", ""))
    parts = [[re.split(r" {2,}", line.strip()) for line in part.splitlines()] for part in text.split("\n\n")]
    s = json.loads("".join(p if isinstance(p, str) else "" for p in doc))["summary"]["code"]
    rows = [("summary", "code", s["before"], s["after"], s["delta"])]
    rows += [("table", "code", *map(number, r[1:4])) for r in parts[0] if r[0] == "code"]
    rows += [("files", *r) for r in told.groupBy("status").agg(F.sum("code.before"), F.sum("code.after"), F.count("*")).orderBy("status").collect()]
    rows += [("top", r[0], 0, 0, number(r[2])) for r in parts[-1][1:]]
    return _rendered(spark, rows, "part string, label string, before long, after long, delta long")
