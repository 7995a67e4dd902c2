"""The refresh as a stream: each micro-batch is upserted into the rolling snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from incidara.roles import RETENTION_DAYS, Roles
from incidara.sources.snapshot import merge, read_metadata


def upsert_stream(stream: DataFrame, directory: str, checkpoint: str, roles: Roles, days: int = RETENTION_DAYS, **trigger) -> StreamingQuery:
    """Keep the snapshot of ``directory`` up to date with ``stream``; a batch writes the days that it touches.

    A batch that is run again after a failure gives the same snapshot: its rows replace themselves.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        merge(spark, directory, batch, roles, days, read_metadata(spark, directory)["source_start_date"])

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def daily_counts(stream: DataFrame, roles: Roles, late: str = "14 days") -> DataFrame:
    """``date, dispatch_records`` of each day, final once the watermark has passed it."""
    timed = stream.withColumn("_incidara_time", F.col(roles.event_time).cast("timestamp"))
    days = timed.withWatermark("_incidara_time", late).groupBy(F.window("_incidara_time", "1 day"))
    return days.agg(F.count(F.lit(1)).alias("dispatch_records")).select(F.col("window.start").cast("date").alias("date"), "dispatch_records")
