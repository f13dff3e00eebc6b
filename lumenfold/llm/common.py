"""What the operators of this folder share: tables, scratch space, byte splits."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: A broadcast side is allowed up to this many bytes of measured content.
BROADCAST_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean_workers(spark: SparkSession) -> None:
    """Python workers give memory back that they no longer use: they outlive a stage and
    stand beside the engine's own memory in an executor.  What a user has set stays."""
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "1"), ("MALLOC_TRIM_THRESHOLD_", "1048576"), ("MALLOC_MMAP_THRESHOLD_", "1048576")):
        spark.sparkContext.environment.setdefault(name, value)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this application.

    It lies under ``spark.checkpoint.dir``.  Only where that is unset and the driver is
    the only executor (tests on one machine) a temporary folder takes its place; a
    cluster without a shared folder is an error, as reads would miss what others wrote.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = getattr(sc, "_lumenfold_scratch", None)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = sc._lumenfold_scratch = tempfile.mkdtemp(prefix="lumenfold-")
    return f"{named.rstrip('/')}/lumenfold-{sc.applicationId}"


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no more
    than the stage it worked on.  ``drop`` frees a table that no plan needs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []
        lean_workers(spark)
        _later(spark)
        for inside in _scopes:
            inside.append(self)

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{scratch_root(self.spark)}/{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(path)
        self.made.append(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *, keep: int = 0) -> None:
        """Delete all tables made here but the last ``keep``."""
        gone, self.made = (self.made[:-keep], self.made[-keep:]) if keep else (self.made, [])
        for path in gone:
            fs, p = _path(self.spark, path)
            fs.delete(p, True)


_scopes: list[list[Scratch]] = []


@contextmanager
def scope() -> Iterator[None]:
    """What scratch spaces made inside have written goes at the end: by then the result
    that needed it must stand elsewhere."""
    inside: list[Scratch] = []
    _scopes.append(inside)
    try:
        yield
    finally:
        _scopes[:] = [s for s in _scopes if s is not inside]
        for scratch in inside:
            scratch.drop()


_registered: set[str] = set()


def _later(spark: SparkSession) -> None:
    """Delete the application's folder when the driver's Python ends."""
    root = scratch_root(spark)
    if root in _registered:
        return
    _registered.add(root)

    def clear() -> None:
        try:
            fs, p = _path(spark, root)
            fs.delete(p, True)
        except Exception:  # the session is gone already; its folder stays for the cluster's own cleaning
            pass

    atexit.register(clear)
