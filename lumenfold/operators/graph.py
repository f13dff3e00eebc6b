"""Graph operators: gates, reachability, witnesses, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import fixpoint


def propagate(edges: DataFrame, seeds: DataFrame, own: tuple[str, ...] = (), shared: tuple[str, ...] = ()) -> DataFrame:
    """(node, [own and shared columns,] value): the best of all paths' worst gates.

    ``edges``: src, dst, gate; ``seeds``: node, value.  Values lie on a short
    lattice, so cycles settle.  ``own`` names columns of the seeds and ``shared`` such
    of both that tell apart what runs independently over the same edges.
    """
    on = [*own, *shared]

    def step(new: DataFrame) -> DataFrame:
        return new.join(edges, [*[new[c] == edges[c] for c in shared], new["node"] == edges["src"]]).select(edges["dst"].alias("node"), *[new[c] for c in on], F.least(new["value"], edges["gate"]).alias("value"))

    return fixpoint.raised(seeds.select("node", *on, "value"), ["node", *on], "value", step)


def reachable(edges: DataFrame, roots: DataFrame, classes: tuple[str, ...] = ()) -> DataFrame:
    """Nodes reached from ``roots`` (column node) over src -> dst; with ``classes`` all
    classes of roots in one pass."""
    cols = list(classes)

    def step(new: DataFrame) -> DataFrame:
        return new.join(edges, new["node"] == edges["src"]).select(edges["dst"].alias("node"), *[new[c] for c in cols])

    return fixpoint.closure(roots.select("node", *cols), step)


def reverse_levels(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(node, next, level): breadth-first over edges against their direction.

    ``next`` is the edge's other end by which a node was found first: the one whose
    own place in the search is earliest.  Places are numbers that grow with the order
    (place of next, node) in each level; they come from one distributed sort of the
    level's new nodes, so a row has one size at any level.  ``targets`` have level 0
    and no next.
    """
    seed = targets.select("node").distinct()
    seed = seed.select("node", F.lit(None).cast(seed.schema["node"].dataType).alias("next"), F.lit(0).cast("long").alias("from"))

    def placed(new: DataFrame) -> DataFrame:
        # Sorted rows lie in ranges of partitions, so their ids grow in that order.
        return new.orderBy("from", "node").withColumn("place", F.monotonically_increasing_id())

    def step(new: DataFrame) -> DataFrame:
        back = new.select(F.col("node").alias("next"), F.col("place").alias("from")).join(edges, F.col("next") == F.col("dst"))
        first = back.groupBy(F.col("src").alias("node")).agg(F.min(F.struct("from", "next")).alias("b"))
        return first.select("node", F.col("b.next").alias("next"), F.col("b.from").alias("from"))

    return fixpoint.layers(seed, "node", step, placed).select("node", "next", "level")


def witness_paths(levels: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, path): the nodes from each wanted one to its target along ``next``."""
    steps = levels.select(F.col("node").alias("at"), "next")
    open_ = fixpoint.cut(wanted.select("node", F.array("node").alias("path"), F.col("node").alias("at")))
    done = None
    while True:
        moved = fixpoint.cut(open_.join(steps, "at"))
        end = moved.where("next is null").select("node", "path")
        done = end if done is None else done.unionByName(end)
        open_ = moved.where("next is not null").select("node", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("at"))
        if not fixpoint.some(open_):
            return done


def through_hubs(members: DataFrame, group: str, node: str) -> DataFrame:
    """Edges that connect all members of each group of two or more by way of a hub:
    two a member, where a clique would take the square."""
    sizes = members.select(group, node).distinct().groupBy(group).agg(F.count("*").alias("n")).where("n > 1")
    pairs = members.select(group, node).distinct().join(sizes, group, "left_semi")
    hub = F.concat(F.lit("group:"), F.col(group).cast("string"))
    own = F.col(node).cast("string")
    return pairs.select(own.alias("src"), hub.alias("dst")).unionByName(pairs.select(hub.alias("src"), own.alias("dst")))


def required(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """States that must stay public.  ``edges``: src, dst, kind; ``seeds``: node, follow.
    A state that doesn't follow skips edges to a visibility parent, and so does what it
    reaches, unless another way leads there."""

    def step(new: DataFrame) -> DataFrame:
        allowed = F.col("follow") | (F.col("kind") != "visibility_parent")
        return new.join(edges, new["node"] == edges["src"]).where(allowed).select(edges["dst"].alias("node"), "follow")

    return fixpoint.closure(seeds.select("node", "follow"), step).groupBy("node").agg(F.bool_or("follow").alias("follow"))


def all_of(rows: DataFrame, keys: list[str], holds: Column) -> DataFrame:
    """Keys of which every row holds (relational division): one aggregation."""
    return rows.groupBy(*keys).agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("_all"), F.count("*").alias("rows")).where("_all").drop("_all")


def running_either(gate: Column, keys: list[str], order: list) -> Column:
    """The OR of the gates of all preceding rows; never for the first."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(gate).over(before), F.lit(0))
