"""Contiguous shards of near-equal bytes from global prefix sums.

Documents stand in the order of their key.  The bytes before each come from
per-partition totals (see ``prefix``), and cuts at equal targets deal them out, so a
shard is a run of the order and differs from the target by one document at most.
Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .prefix import prefix_sums


def shard(docs: DataFrame, shards: int = 8, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``size`` (UTF-8 bytes and 1), ``text_crc32``, ``shard`` and ``slot``
    (gapless from 0 in each shard, in order).

    A null text counts as empty.  Null keys come first; equal keys stand by checksum
    and size, and rows that tie in these too are alike.  An empty table gives no
    rows; other columns, whatever their names, play no part.  A shard may be empty
    where one document is larger than the target.
    """
    scratch = Scratch(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("k"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("crc"))
    order = [F.col("k").asc_nulls_first(), F.col("crc"), F.col("size")]
    placed = prefix_sums(rows, [], order, ["size"], scratch)
    total = rows_total(placed)
    dealt = scratch.cut(
        placed.crossJoin(F.broadcast(total)).select(  # one row
            "k", "size", "crc", "row_before", F.expr(f"cast(size_before as decimal(20, 0)) * {int(shards)} div total").cast("int").alias("shard")
        )
    )
    first = dealt.groupBy("shard").agg(F.min("row_before").alias("first"))  # a row for each shard
    return dealt.join(F.broadcast(first), "shard").select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row_before") - F.col("first")).alias("slot"))


def rows_total(placed: DataFrame) -> DataFrame:
    return placed.agg(F.sum("size").alias("total"))
