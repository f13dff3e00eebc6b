"""Checks and decoding of fact streams: order, keys, references, multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decoded(text: Column, schema: str) -> Column:
    """A JSON record by its schema: unknown fields play no part, and a record that can't be
    read has NULL in every field."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def contiguous(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """For each key whether ``sequence`` runs 0, 1, 2, ... without gap or repeat.

    Counts, extremes and distinct numbers tell: no sort, and a long stream is
    aggregated where it lies."""
    s = F.col(sequence)
    whole = (F.min(s) == 0) & (F.max(s) == F.count("*") - 1) & (F.count_distinct(s) == F.count("*"))
    return rows.groupBy(*keys).agg(F.count("*").alias("records"), F.coalesce(whole, F.lit(False)).alias("contiguous"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def orphans(rows: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key isn't null and has no parent."""
    return rows.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; a partial aggregate, not a sort of all rows."""
    other = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*other), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def ledger(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Two multisets: how often each key is expected and observed, where these differ.
    NULLs are values of a key."""
    e = expected.groupBy(*keys).agg(F.count("*").alias("expected"))
    o = observed.groupBy(*keys).agg(F.count("*").alias("observed"))
    return counted_ledger(e, o, keys)


def counted_ledger(e: DataFrame, o: DataFrame, keys: list[str]) -> DataFrame:
    both = e.withColumn("observed", F.lit(0).cast("long")).select(*keys, "expected", "observed").unionByName(o.withColumn("expected", F.lit(0).cast("long")).select(*keys, "expected", "observed"))
    return both.groupBy(*keys).agg(F.sum("expected").cast("long").alias("expected"), F.sum("observed").cast("long").alias("observed")).where("expected <> observed")


def strictly_increasing(values: Column) -> Column:
    """Canonical order of a list: sorted, and no value twice."""
    return values == F.array_sort(F.array_distinct(values))


def normalized_predicate(value: Column) -> Column:
    """White space goes, and the quotes of a value: name = "v" becomes name=v."""
    compact = F.regexp_replace(value, r"\s", "")
    at = F.instr(compact, "=")
    right = F.substr(compact, at + 1)
    return F.when(at > 0, F.concat(F.substr(compact, F.lit(1), at), F.regexp_replace(right, '^"|"$', ""))).otherwise(compact)


def length_prefixed(*parts: Column) -> Column:
    """A key that no other list of parts has: each with its length in bytes before it."""
    return F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts])


def flag_repeats(rows: DataFrame, keys: list[str], name: str = "repeated") -> DataFrame:
    """Rows with whether another has the same key.  A count beside a join: a key with
    very many rows is split like any skewed join, which a window's partition isn't."""
    twice = duplicates(rows, keys).select(*[F.col(k).alias(f"_d_{k}") for k in keys], F.lit(True).alias("_twice"))
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(F.col(f"_d_{k}"))
    return rows.join(twice, on, "left").select(*rows.columns, F.coalesce("_twice", F.lit(False)).alias(name))
