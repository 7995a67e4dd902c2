"""Summaries and simple counts of a call table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidara.functions import calendar
from incidara.operators.schema import require_columns
from incidara.roles import Roles


def summary(df: DataFrame, roles: Roles) -> DataFrame:
    """One row: sizes, time range, medians; null where a column has no value."""
    r = roles
    require_columns(df, r.event_id, r.event_time, r.category, r.place, r.priority, r.staff, r.lat, r.lon)
    located = F.count_if(F.col(r.lat).isNotNull() & F.col(r.lon).isNotNull())
    sizes = [F.count(F.lit(1)).alias("n"), F.min(r.event_time).alias("first"), F.max(r.event_time).alias("last"), located.alias("located")]
    # few rows are left for the counts and medians: one for each combination of values
    values = [F.col(c).alias(f"v{k}") for k, c in enumerate((r.category, r.place, r.priority, r.staff))]
    combinations = df.groupBy(*values).agg(*sizes)
    figures = combinations.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_calls"),
        F.min("first").alias("date_min"),
        F.max("last").alias("date_max"),
        F.countDistinct("v0").alias("unique_event_groups"),
        F.countDistinct("v1").alias("unique_neighborhoods"),
        F.percentile("v2", 0.5, F.col("n")).alias("median_priority"),
        F.percentile("v3", 0.5, F.col("n")).alias("median_officers"),
        F.coalesce(F.sum("located"), F.lit(0)).alias("mappable_records"),
    )
    events = df.agg(F.countDistinct(r.event_id).alias("unique_events"))
    names = ["total_calls", "unique_events", "date_min", "date_max", "unique_event_groups", "unique_neighborhoods", "median_priority", "median_officers", "mappable_records"]
    return figures.crossJoin(events).select(*names)  # one row each


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, count``, most frequent first, nulls left out."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "value")


def all_value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """``dimension, value, count`` of several columns in one pass over the table."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(F.inline(pairs)).filter("value IS NOT NULL")
    return long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("count"))


def null_counts(df: DataFrame) -> DataFrame:
    """``column_name, missing_values`` of every column."""
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}") for k, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{k}").alias("missing_values")) for k, c in enumerate(df.columns)]
    return counted.select(F.inline(F.array(*rows)))


def monthly_counts(df: DataFrame, time: str) -> DataFrame:
    months = df.filter(F.col(time).isNotNull()).groupBy(calendar.period_start(F.col(time), "month").alias("month"))
    return months.agg(F.count(F.lit(1)).alias("count")).orderBy("month")


def hourly_profile(df: DataFrame, time: str) -> DataFrame:
    """``hour, count`` for all 24 hours."""
    counted = df.filter(F.col(time).isNotNull()).groupBy(F.hour(time).alias("hour")).agg(F.count(F.lit(1)).alias("count"))
    return calendar.densify(calendar.hours(df.sparkSession), counted, "hour", "count").orderBy("hour")


def top_values(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    if isinstance(top_n, bool) or not isinstance(top_n, int) or top_n < 1:
        raise ValueError("top_n is a positive integer")
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), column).limit(top_n)


def priority_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(column)


def recent_points(df: DataFrame, roles: Roles, columns: list[str], max_points: int | None = None) -> DataFrame:
    """Rows with a time and coordinates, latest first; the ``max_points`` latest if that is given."""
    if max_points is not None and (isinstance(max_points, bool) or not isinstance(max_points, int) or max_points < 1):
        raise ValueError("max_points is a positive integer")
    require_columns(df, *columns, roles.event_time, roles.lat, roles.lon)
    rows = df.dropna(subset=[roles.event_time, roles.lat, roles.lon]).orderBy(F.col(roles.event_time).desc(), roles.row_id, *roles.ties)
    return (rows if max_points is None else rows.limit(max_points)).select(*columns)


def place_counts(df: DataFrame, roles: Roles) -> DataFrame:
    """``place, call_count, unique_events``, most calls first; rows without a place go."""
    counted = df.filter(F.col(roles.place).isNotNull()).groupBy(roles.place)
    rows = counted.agg(F.count(F.lit(1)).alias("call_count"), F.countDistinct(roles.event_id).alias("unique_events"))
    return rows.orderBy(F.desc("call_count"), roles.place)
