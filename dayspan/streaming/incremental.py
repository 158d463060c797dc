"""Apply a stage to each micro-batch of a file stream, idempotently."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files arriving under ``path`` (explicit schema)."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def run_incremental(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], sink_path: str,
                    checkpoint_path: str, fmt: str = "parquet", partition_by: Sequence[str] | None = None,
                    available_now: bool = True) -> StreamingQuery:
    """Run ``transform`` on every micro-batch and write its result.

    Each batch overwrites its own ``batch=<id>`` folder, so a batch replayed
    after a failure replaces its earlier output instead of duplicating it;
    progress is kept in ``checkpoint_path`` (a shared folder on a cluster).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        w = transform(batch).write.format(fmt).mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.save(f"{sink_path.rstrip('/')}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
