"""Fixed points of monotone rules over DataFrames.

One helper runs every iterative operator: it keeps what is known and the rows that
the last round added (semi-naive evaluation), and writes each round's rows as a table
in the shared folder.  So lineage stays short, a lost executor costs a round, and the
planner knows each round's size: a small one is sent to the edges where they lie, and
neither edges nor what is known are dealt out again for it.

Rounds have no limit: rules only add rows over finite values, so they settle.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_folders: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``.  Only where that is unset
    and the driver is the only executor a temporary folder takes its place."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _folders:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="lumenfold-rounds-")
        _folders[app] = f"{named.rstrip('/')}/lumenfold-rounds-{app}"
        atexit.register(_clear, spark, _folders[app])
    return _folders[app]


def _clear(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already; its folder stays for the cluster's own cleaning
        pass


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder."""
    spark: SparkSession = df.sparkSession
    path, schema = f"{_folder(spark)}/{uuid.uuid4().hex}", df.schema
    # Columns go by number: a table's may have names that a file can't.
    names = [f"_{i}" for i in range(len(schema.fields))]
    df.toDF(*names).write.parquet(path)
    back = spark.read.schema(df.toDF(*names).schema).parquet(path)
    return back.toDF(*schema.names)


def some(df: DataFrame) -> bool:
    return bool(df.take(1))


#: Rounds whose rows are kept apart before they are written as one.
PARTS = 8


class _Known:
    """What is known so far: the rounds' rows, each written once, together now and then."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def add(self, new: DataFrame) -> None:
        self.parts.append(new)
        if len(self.parts) > PARTS:
            self.parts = [cut(self.all())]


def closure(seed: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows reachable from ``seed``: ``step`` gives the rows that follow from the
    newest ones; rows that are known already don't come back."""
    new = cut(seed.distinct())
    known = _Known(new)
    while True:
        new = cut(step(new).distinct().join(known.all(), new.columns, "left_anti"))
        if not some(new):
            return known.all()
        known.add(new)


def raised(seed: DataFrame, keys: list[str], value: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The largest ``value`` of each key: ``step`` gives candidates that follow from the
    rows raised last; only rows that a candidate raises count as new.

    What was raised is added, not put in the old row's place: a key may be known with
    several values until the end, of which the largest holds."""
    new = cut(seed.groupBy(keys).agg(F.max(value).alias(value)))
    known = _Known(new)
    largest = lambda df: df.groupBy(keys).agg(F.max(value).alias(value))
    while True:
        best = step(new).groupBy(keys).agg(F.max(value).alias("_best"))
        old = known.all().withColumnRenamed(value, "_old")
        # A candidate that is no more than any known value of its key doesn't count.
        met = best.join(old, [best[k] == old[k] for k in keys] + [best["_best"] <= old["_old"]], "left_anti")
        new = cut(met.select(*keys, F.col("_best").alias(value)))
        if not some(new):
            return largest(known.all())
        known.add(new)


def layers(seed: DataFrame, key: str, step: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``seed`` with ``level`` 0 and each key that ``step`` reaches with the round in
    which it came first.  Other columns are those of its first arrival, so ``step``
    gives one row for each key.  ``finish`` sees a round's rows once they are known to
    be new."""
    new = cut(finish(seed.withColumn("level", F.lit(0))))
    known = _Known(new)
    level = 0
    while True:
        level += 1
        new = cut(finish(step(new).withColumn("level", F.lit(level)).join(known.all().select(key), key, "left_anti")))
        if not some(new):
            return known.all()
        known.add(new)
