"""Latest rows, keep-last upserts and rolling retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, time: str, *ties: Column | str) -> DataFrame:
    """The row with the latest time of each key; ``ties`` make the choice definite."""
    order = Window.partitionBy(key).orderBy(F.col(time).desc_nulls_last(), *ties)
    return df.withColumn("_incidara_row", F.row_number().over(order)).filter("_incidara_row = 1").drop("_incidara_row")


def upsert_keep_last(existing: DataFrame, fresh: DataFrame, key: str, *ties: Column | str) -> DataFrame:
    """Both tables, with the fresh row where a key is in both; rows without a key count as one key."""
    both = existing.withColumn("_incidara_source", F.lit(0)).unionByName(fresh.withColumn("_incidara_source", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(F.col("_incidara_source").desc(), *ties)
    return both.withColumn("_incidara_row", F.row_number().over(order)).filter("_incidara_row = 1").drop("_incidara_row", "_incidara_source")


def retain(df: DataFrame, time: str, days: int) -> DataFrame:
    """Rows not more than ``days`` days older than the latest; rows without a time go."""
    latest = df.agg((F.max(time) - F.expr(f"INTERVAL {int(days)} DAYS")).alias("_incidara_cutoff"))
    return df.join(F.broadcast(latest), F.col(time) >= F.col("_incidara_cutoff")).drop("_incidara_cutoff")
