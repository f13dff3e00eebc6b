"""Facts as they arrive: finished files are decoded and validated in batches.

A file is a whole invocation, so a stream of files needs no state across batches: each
micro-batch decodes its files, checks them, and appends what is valid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import facts

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, run_id: str, sink: str, checkpoint: str, files_per_batch: int = 200) -> StreamingQuery:
    """Append the valid records under ``sink``/records and all errors under ``sink``/errors."""
    files = spark.readStream.schema(FILES).format("binaryFile").option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_batch).load(folder)

    def each(batch: DataFrame, number: int) -> None:
        named = batch.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "content")
        records, errors = facts.decode(named)
        bad = facts.validate(records, run_id)
        errors.unionByName(bad).withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{sink}/errors")
        records.join(bad.select("file").distinct(), "file", "left_anti").withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{sink}/records")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
