"""Detections as they land.

There is no stateful streaming here: record checks and frame conversions are row
by row, so the batch functions run unchanged on a streaming reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxlake.functions import frames
from voxlake.sources.detections import checked_records, explode_records, landing_records


def stream_detections(spark: SparkSession, landing: str) -> DataFrame:
    """Storage-frame boxes of every new record, degenerate boxes left out."""
    rows = explode_records(checked_records(landing_records(spark, landing, stream=True)))
    slots = F.col("slots")
    return rows.where(~frames.slots_degenerate(slots, frames.RESTORED_SLOTS)).withColumn(
        "box", frames.slots_to_box(slots, frames.RESTORED_SLOTS)
    )


def append_detections(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a detection stream to a Parquet table until the landing folder is read."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
