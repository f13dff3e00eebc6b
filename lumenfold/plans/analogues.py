"""The engine's operators on the sales, event and text tables, each beside the SQL
that gives the same rows.

These are analogues: the operators are those that the engine runs over source trees
and compiler facts, shown on tables whose results a SQL system can confirm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lattice
from ..operators import api, compare, facts, graph, metrics


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100, 0).cast("long")


@query("""
WITH t AS (SELECT lang, coalesce(text, '') AS s FROM documents),
l AS (SELECT lang, CASE WHEN s = '' THEN 0 ELSE len(string_split(s, chr(10))) - CAST(ends_with(s, chr(10)) AS INT) END AS physical,
  CASE WHEN s = '' THEN 0 ELSE len(list_filter(string_split(s, chr(10)), lambda x: translate(x, ' ' || chr(9) || chr(13), '') = '')) - CAST(ends_with(s, chr(10)) AS INT) END AS blank FROM t)
SELECT lang, CAST(count(*) FILTER (WHERE physical > 0 OR blank > 0) AS BIGINT) AS files, CAST(sum(physical) AS BIGINT) AS physical, CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(physical - blank) AS BIGINT) AS code
FROM l GROUP BY lang""")
def q1_line_metrics(spark, sf_dir):
    """Physical, blank and other lines by language (L1, L3, A1-A3)."""
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("lang", metrics.physical_lines(t).alias("physical"), metrics.blank_lines(t).alias("blank")).withColumn("code", F.col("physical") - F.col("blank"))
    return metrics.buckets(rows, ["lang"], ("physical", "blank", "code"))


@query("""
SELECT CASE WHEN grouping(source) = 1 THEN 'Total' ELSE source END AS source, CASE WHEN grouping(lang) = 1 THEN 'Total' ELSE lang END AS lang, count(DISTINCT doc_id) AS files, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents GROUP BY GROUPING SETS ((source, lang), (lang), ())""")
def q2_grouping_totals(spark, sf_dir):
    """Buckets and totals in one pass (A2-A4): distinct files, summed characters."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("n_chars", "chars")
    return metrics.grouped(docs, [["source", "lang"], ["lang"], []], "doc_id", ["chars"])


@query("""
WITH a AS (SELECT d.lang, CASE WHEN l.quality IS NULL THEN 1 WHEN l.quality = 1 THEN 2 ELSE 0 END AS q, CASE WHEN l.toxic IS NULL THEN 1 WHEN l.toxic = 1 THEN 2 ELSE 0 END AS t, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT lang, least(q, 2 - t) AS production, least(2 - q, 2 - t) AS example, t AS test, labelled FROM a)
SELECT lang, CASE WHEN production = 2 THEN 'production' WHEN production = 1 THEN 'conditional' WHEN example = 2 THEN 'example' WHEN example = 1 THEN 'conditional' WHEN test = 2 THEN 'test' WHEN test = 1 THEN 'conditional' WHEN labelled THEN 'inactive' ELSE 'orphan' END AS role, count(*) AS files
FROM r GROUP BY ALL""")
def q3_classify_labels(spark, sf_dir):
    """Three-valued activation and the role by priority (C1, G3); no label is a maybe."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("known"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    q, t = lattice.activation(F.col("quality") == 1), lattice.activation(F.col("toxic") == 1)
    role = lattice.classify(lattice.both(q, lattice.negate(t)), lattice.both(lattice.negate(q), lattice.negate(t)), t, F.lit(0), F.lit(0), F.col("known").isNotNull())
    return rows.groupBy("lang", role.alias("role")).agg(F.count("*").alias("files"))


_HALF = "TIMESTAMP '1998-04-01 00:00:00'"


def _periods(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", _cents("o_totalprice").alias("cents"))
    fold = lambda df: df.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("cents").alias("cents"))
    return fold(rows.where(f"o_orderdate < {_HALF}")), fold(rows.where(f"o_orderdate >= {_HALF}"))


_PERIODS = f"""
WITH o AS (SELECT o_custkey, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
b AS (SELECT o_custkey, count(*) AS orders, CAST(sum(cents) AS BIGINT) AS cents FROM o WHERE o_orderdate < {_HALF} GROUP BY 1),
a AS (SELECT o_custkey, count(*) AS orders, CAST(sum(cents) AS BIGINT) AS cents FROM o WHERE o_orderdate >= {_HALF} GROUP BY 1)"""
_PERCENT = "CASE WHEN {b} = 0 THEN CASE WHEN {a} = 0 THEN 0.0::DOUBLE END ELSE round(({a} - {b}) * 100.0::DOUBLE / {b} * 100.0::DOUBLE) / 100.0::DOUBLE END"


def _changes(names: list[str], b: str = "b_{}", a: str = "a_{}") -> str:
    return ", ".join(f"{b.format(n)} AS before_{n}, {a.format(n)} AS after_{n}, {a.format(n)} - {b.format(n)} AS delta_{n}, {_PERCENT.format(b=b.format(n), a=a.format(n))} AS percent_{n}" for n in names)


_COMPARED = f"""{_PERIODS},
j AS (SELECT o_custkey, b.orders IS NULL AS no_b, a.orders IS NULL AS no_a, coalesce(b.orders, 0) AS b_orders, coalesce(a.orders, 0) AS a_orders, coalesce(b.cents, 0) AS b_cents, coalesce(a.cents, 0) AS a_cents FROM b FULL JOIN a USING (o_custkey)),
c AS (SELECT o_custkey, CASE WHEN no_b THEN 'added' WHEN no_a THEN 'deleted' ELSE 'modified' END AS status, {_changes(['orders', 'cents'])} FROM j WHERE b_orders <> a_orders OR b_cents <> a_cents)"""


@query(f"{_COMPARED} SELECT * FROM c")
def q4_period_compare(spark, sf_dir):
    """Two periods of each customer, full outer, with changes and status."""
    return compare.compare(*_periods(spark, sf_dir), ["o_custkey"], ["orders", "cents"])


@query(f"""{_PERIODS}, s AS (SELECT (SELECT CAST(coalesce(sum(orders), 0) AS BIGINT) FROM b) AS b_orders, (SELECT CAST(coalesce(sum(cents), 0) AS BIGINT) FROM b) AS b_cents, (SELECT CAST(coalesce(sum(orders), 0) AS BIGINT) FROM a) AS a_orders, (SELECT CAST(coalesce(sum(cents), 0) AS BIGINT) FROM a) AS a_cents)
SELECT {_changes(['orders', 'cents'])} FROM s""")
def q5_summary_change(spark, sf_dir):
    """One row of changes of both periods' totals."""
    return compare.summary(*_periods(spark, sf_dir), ["orders", "cents"])


@query(f"""{_COMPARED} SELECT o_custkey, delta_orders, delta_cents, CAST(abs(delta_orders) AS BIGINT) AS rank_first, CAST(abs(delta_cents) AS BIGINT) AS rank_then FROM c ORDER BY rank_first DESC, rank_then DESC, o_custkey LIMIT 10""")
def q6_top_contributors(spark, sf_dir):
    """The ten customers that moved most (D8), with a total order."""
    changed = compare.compare(*_periods(spark, sf_dir), ["o_custkey"], ["orders", "cents"])
    return compare.contributors(changed, ["orders"], ["cents"], "o_custkey").select("o_custkey", "delta_orders", "delta_cents", "rank_first", "rank_then")


@query("""
WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_regionkey = 0 THEN 2 WHEN n_regionkey IN (1, 2) THEN 1 ELSE 0 END AS v FROM nation),
c AS (SELECT c_custkey AS k, max(least(v, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE 2 END)) AS v FROM customer JOIN n ON c_nationkey = n.k GROUP BY 1),
o AS (SELECT o_orderkey AS k, max(least(v, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END)) AS v FROM orders JOIN c ON o_custkey = c.k GROUP BY 1)
SELECT kind, CAST(v AS INT) AS value, count(*) AS nodes FROM (SELECT 'n' AS kind, v FROM n UNION ALL SELECT 'c', v FROM c UNION ALL SELECT 'o', v FROM o) GROUP BY ALL""")
def q7_gate_propagation(spark, sf_dir):
    """The best path's worst gate from nations over customers to orders."""
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    segment = F.when(F.col("c_mktsegment") == "AUTOMOBILE", 1).when(F.col("c_mktsegment") == "FURNITURE", 0).otherwise(2)
    state = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    edges = table(spark, sf_dir, "customer").select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"), segment.alias("gate"))
    edges = edges.unionByName(table(spark, sf_dir, "orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), state.alias("gate")))
    region = F.when(F.col("n_regionkey") == 0, 2).when(F.col("n_regionkey").isin(1, 2), 1).otherwise(0)
    seeds = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("node"), region.alias("value"))
    return graph.propagate(edges, seeds).groupBy(F.substring("node", 1, 1).alias("kind"), "value").agg(F.count("*").alias("nodes"))


def _supply(spark, sf_dir, quantity):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") == quantity)
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return rows.select(s.alias("s"), p.alias("p")).distinct()


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p FROM lineitem WHERE l_quantity = 50),
b AS (SELECT s AS src, p AS dst FROM e UNION SELECT p, s FROM e),
r(node) AS (SELECT min(s) FROM e UNION SELECT dst FROM r JOIN b ON node = src)
SELECT node FROM r WHERE node IS NOT NULL""")
def q8_reachability(spark, sf_dir):
    """All that is reached from one supplier over a cyclic graph."""
    e = _supply(spark, sf_dir, 50)
    edges = e.select(F.col("s").alias("src"), F.col("p").alias("dst")).unionByName(e.select(F.col("p").alias("src"), F.col("s").alias("dst")))
    return graph.reachable(edges, e.agg(F.min("s").alias("node")).where("node is not null"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_quantity = 50 UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_quantity = 49),
r(node, level) AS (SELECT min(dst), 0 FROM e WHERE dst LIKE 'p%' UNION SELECT src, level + 1 FROM r JOIN e ON dst = node WHERE level < 40),
m AS (SELECT node, min(level) AS level FROM r WHERE node IS NOT NULL GROUP BY 1)
SELECT level, count(*) AS consumers, min(node) AS first_consumer FROM m GROUP BY 1""")
def q9_reverse_levels(spark, sf_dir):
    """Who depends on one part, by distance."""
    edges = _supply(spark, sf_dir, 50).select(F.col("s").alias("src"), F.col("p").alias("dst")).unionByName(_supply(spark, sf_dir, 49).select(F.col("p").alias("src"), F.col("s").alias("dst"))).distinct()
    start = edges.where("dst like 'p%'").agg(F.min("dst").alias("node")).where("node is not null")
    return graph.reverse_levels(edges, start).groupBy("level").agg(F.count("*").alias("consumers"), F.min("node").alias("first_consumer"))


@query("""
SELECT d.doc_id, coalesce(bool_or(l.quality = 1) OVER (PARTITION BY d.text), false) AS required FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q10_required_spread(spark, sf_dir):
    """A requirement spreads over all documents of one text, by way of a hub."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("token"))
    edges = graph.through_hubs(docs, "token", "doc_id").withColumn("kind", F.lit("visibility"))
    seeds = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("node"), F.lit(True).alias("follow"))
    found = graph.required(edges, seeds).select(F.col("node").alias("_node"), F.lit(True).alias("_r"))
    return docs.join(found, F.col("doc_id").cast("string") == F.col("_node"), "left").select("doc_id", F.coalesce("_r", F.lit(False)).alias("required"))


@query("SELECT l_partkey, count(*) AS rows FROM lineitem GROUP BY 1 HAVING bool_and(l_quantity >= 5)")
def q11_safe_groups(spark, sf_dir):
    """Parts of which every line satisfies a condition."""
    return graph.all_of(table(spark, sf_dir, "lineitem"), ["l_partkey"], F.col("l_quantity") >= 5)


@query("""
SELECT o_custkey, o_orderkey, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) = 1""")
def q12_representative(spark, sf_dir):
    """The smallest row of each key by a composite order."""
    rows = table(spark, sf_dir, "orders")
    return facts.first_of(rows, ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority", _cents("o_totalprice").alias("cents"))


@query("SELECT conv_id, count(*) AS records, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY 1")
def q13_contiguity(spark, sf_dir):
    """Whether each conversation's turns run 0, 1, 2, ... (V1)."""
    return facts.contiguous(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS repeated FROM documents")
def q14_duplicate_keys(spark, sf_dir):
    """Documents whose content another has too (V8, K2)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("token"))
    return facts.flag_repeats(rows, ["token"]).select("doc_id", "repeated")


@query("""
SELECT 'labels.doc_id' AS key, (SELECT count(*) FROM labels) AS rows, (SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)) AS violations
UNION ALL SELECT 'documents.doc_id', (SELECT count(*) FROM documents), (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE d.doc_id = l.doc_id))
UNION ALL SELECT 'orders.o_orderkey', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey))
UNION ALL SELECT 'lineitem.l_orderkey', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE l.l_orderkey = o.o_orderkey))""")
def q15_foreign_keys(spark, sf_dir):
    """References without their other end."""
    t = lambda n: table(spark, sf_dir, n)
    out = None
    for child, key, parent, other in (("labels", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")):
        rows = t(child).agg(F.count("*").alias("rows")).crossJoin(facts.orphans(t(child), key, t(parent), other).agg(F.count("*").alias("violations")))  # one row each
        rows = rows.select(F.lit(f"{child}.{key}").alias("key"), "rows", "violations")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""
WITH e AS (SELECT l_orderkey, max(l_linenumber) AS expected FROM lineitem GROUP BY 1), o AS (SELECT l_orderkey, count(*) AS observed FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(coalesce(expected, 0) AS BIGINT) AS expected, CAST(coalesce(observed, 0) AS BIGINT) AS observed FROM e FULL JOIN o USING (l_orderkey) WHERE coalesce(expected, 0) <> coalesce(observed, 0)""")
def q16_ledger(spark, sf_dir):
    """How many lines each order should have and has (K6)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("expected"), F.count("*").alias("observed"))
    return facts.counted_ledger(lines.select("l_orderkey", "expected"), lines.select("l_orderkey", "observed"), ["l_orderkey"])


@query("""
SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value IS NULL, value, event_id) = 1""")
def q17_first_per_key(spark, sf_dir):
    """The first row of each key, nulls last."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return facts.first_of(rows, ["user_id", "event_type"], [F.col("value").isNull(), F.col("value"), F.col("event_id")])


@query("""
SELECT event_type, count(*) AS records, CAST(count(k) AS BIGINT) AS decoded, CAST(coalesce(sum(k), 0) AS BIGINT) AS total FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def q18_decode(spark, sf_dir):
    """JSON payloads decoded by a schema; a bad one counts as not decoded."""
    rows = table(spark, sf_dir, "events").select("event_type", facts.decoded(F.col("props"), "k long")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("records"), F.count("k").alias("decoded"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("total"))


@query("""
WITH g AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS gate FROM lineitem),
p AS (SELECT l_returnflag, gate, coalesce(max(gate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_tax, l_discount, l_returnflag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT l_returnflag, CAST(least(gate, before) AS INT) AS alternative, count(*) AS arms FROM p GROUP BY ALL""")
def q19_running_or(spark, sf_dir):
    """Each line's gate with the OR of those before it."""
    gate = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    rows = table(spark, sf_dir, "lineitem").withColumn("gate", gate)
    before = graph.running_either(F.col("gate"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_tax", "l_discount", "l_returnflag"])
    return rows.select("l_returnflag", F.col("gate"), before.alias("before")).groupBy("l_returnflag", F.least("gate", "before").alias("alternative")).agg(F.count("*").alias("arms"))


_PATH = "split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1)"
_SQL_PATHS = f"WITH u AS (SELECT page_id, {_PATH} AS path FROM pages), x AS (SELECT page_id, path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda n: array_to_string(string_split(path, '/')[1:n], '/'))) AS prefix FROM u)"


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_PATH).alias("path"))


def _busy(paths: DataFrame, least: int) -> DataFrame:
    marked = paths.select(F.explode(api.prefixes(F.col("path"), "/")).alias("prefix"))
    return marked.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("prefix")


@query(f"""{_SQL_PATHS}, e AS (SELECT prefix FROM x GROUP BY 1 HAVING count(*) >= 3)
SELECT page_id, path, count(*) AS exposed_prefixes, arg_max(prefix, length(prefix)) AS longest_exposed FROM x SEMI JOIN e USING (prefix) GROUP BY 1, 2""")
def q20_exposed_prefixes(spark, sf_dir):
    """Pages that lie under a prefix which several share."""
    paths = _paths(spark, sf_dir)
    return api.with_exposed_ancestor(paths, "path", _busy(paths, 3), "/")


@query(f"""{_SQL_PATHS}, e AS (SELECT prefix FROM x GROUP BY 1 HAVING count(*) >= 3), w AS (SELECT page_id, arg_max(prefix, length(prefix)) AS owner FROM x SEMI JOIN e USING (prefix) GROUP BY 1)
SELECT page_id, path, owner FROM u LEFT JOIN w USING (page_id)""")
def q21_longest_owner(spark, sf_dir):
    """Each page's owner: the longest of the shared prefixes."""
    paths = _paths(spark, sf_dir)
    return api.longest_owner(paths, "path", _busy(paths, 3).withColumnRenamed("prefix", "owner"))


@query(f"""
WITH b AS (SELECT o_custkey, o_orderpriority, max(o_orderstatus) AS t FROM orders WHERE o_orderdate < {_HALF} GROUP BY ALL), a AS (SELECT o_custkey, o_orderpriority, max(o_orderstatus) AS t FROM orders WHERE o_orderdate >= {_HALF} GROUP BY ALL)
SELECT CASE WHEN b.t IS NULL THEN 'added' WHEN a.t IS NULL THEN 'removed' ELSE 'retargeted' END AS change, o_custkey, o_orderpriority, b.t AS before_target, a.t AS after_target FROM b FULL JOIN a USING (o_custkey, o_orderpriority) WHERE b.t IS NULL OR a.t IS NULL OR a.t <> b.t
ORDER BY change, o_custkey, o_orderpriority""")
def q22_change_log(spark, sf_dir):
    """Slots added, removed and retargeted, in a total order."""
    slots = lambda df: df.groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderstatus").alias("t"))
    rows = table(spark, sf_dir, "orders")
    return api.changes(slots(rows.where(f"o_orderdate < {_HALF}")), slots(rows.where(f"o_orderdate >= {_HALF}")), ["o_custkey", "o_orderpriority"], "t").orderBy("change", "o_custkey", "o_orderpriority")


@query("""
WITH RECURSIVE strong AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_quantity = 50 UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_quantity = 49 AND l_returnflag = 'R'),
seeds AS (SELECT DISTINCT 's' || s_suppkey AS node FROM supplier WHERE s_suppkey % 50 = 3),
active(node) AS (SELECT node FROM seeds UNION SELECT dst FROM active JOIN strong ON node = src),
weak AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_quantity = 48)
SELECT 'active' AS rule, node, NULL AS via FROM active
UNION ALL SELECT 'weak', w.dst, w.src FROM weak w WHERE w.src IN (SELECT node FROM active) AND w.dst IN (SELECT node FROM active)""")
def q23_rule_closure(spark, sf_dir):
    """Strong edges activate, to a fixed point; weak ones count only between what is active."""
    node = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    lines = table(spark, sf_dir, "lineitem")
    s, p = node("s", "l_suppkey"), node("p", "l_partkey")
    strong = lines.where("l_quantity = 50").select(s.alias("src"), p.alias("dst")).unionByName(lines.where("l_quantity = 49 and l_returnflag = 'R'").select(p.alias("src"), s.alias("dst"))).distinct()
    seeds = table(spark, sf_dir, "supplier").where("s_suppkey % 50 = 3").select(node("s", "s_suppkey").alias("node"))
    active = graph.reachable(strong, seeds)
    weak = lines.where("l_quantity = 48").select(s.alias("src"), p.alias("dst")).distinct()
    both = weak.join(active.withColumnRenamed("node", "src"), "src", "left_semi").join(active.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return active.select(F.lit("active").alias("rule"), "node", F.lit(None).cast("string").alias("via")).unionByName(both.select(F.lit("weak").alias("rule"), F.col("dst").alias("node"), F.col("src").alias("via")))


@query("""
WITH s AS (SELECT user_id, event_id, CASE WHEN value >= 50 THEN 'complete' WHEN value >= 5 THEN 'partial' ELSE 'unavailable' END AS status, CASE WHEN value < 50 THEN event_type END AS reason FROM events WHERE event_type <> 'error' OR value >= 2)
SELECT user_id, CASE WHEN bool_and(status = 'complete') THEN 'complete' WHEN bool_or(status IN ('complete', 'partial')) THEN 'partial' ELSE 'unavailable' END AS status, arg_min(reason, event_id) FILTER (WHERE reason IS NOT NULL) AS reason, count(*) AS parts FROM s GROUP BY 1""")
def q24_status_rollup(spark, sf_dir):
    """Complete, partial or unavailable over a user's events, with the first reason."""
    value = F.col("value")
    status = F.when(value >= 50, "complete").when(value >= 5, "partial").otherwise("unavailable")
    rows = table(spark, sf_dir, "events").where("event_type <> 'error' or value >= 2").select("user_id", "event_id", status.alias("state"), F.when(value < 50, F.col("event_type")).alias("why"))
    return metrics.status_rollup(rows, ["user_id"], "state", "why", ["event_id"])


@query("""
SELECT p_partkey, lower(p_type) || '=' || p_name AS raw, regexp_replace(lower(p_type) || '=' || p_name, '\\s', '', 'g') AS normalized, strlen(p_brand) || ':' || p_brand || strlen(p_name) || ':' || p_name AS key FROM part""")
def q25_normalized_key(spark, sf_dir):
    """Predicates without white space and quotes; keys with lengths before their parts."""
    rows = table(spark, sf_dir, "part")
    raw = F.concat(F.lower("p_type"), F.lit("="), F.col("p_name"))
    quoted = F.concat(F.lower("p_type"), F.lit(' = "'), F.col("p_name"), F.lit('"'))
    return rows.select("p_partkey", raw.alias("raw"), facts.normalized_predicate(quoted).alias("normalized"), facts.length_prefixed(F.col("p_brand"), F.col("p_name")).alias("key"))
