"""Periods, windows of time, and gap-free axes."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAINS = ("month", "week")


def check_grain(grain: str) -> str:
    if grain not in GRAINS:
        raise ValueError("grain is 'month' or 'week'")
    return grain


def period_start(time: Column, grain: str) -> Column:
    """First instant of the month, or of the week from Monday on, without time zone."""
    return F.date_trunc(check_grain(grain), time).cast("timestamp_ntz")


def one_period(grain: str) -> Column:
    return F.expr(f"INTERVAL 1 {check_grain(grain).upper()}")


def minutes_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(6e7)


def whole_days(start: Column, end: Column) -> Column:
    """Days of 24 hours that have passed, not midnights crossed."""
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(86_400_000_000))


def axis(bounds: DataFrame, start: Column, end: Column, step: Column, name: str) -> DataFrame:
    """One row for each step from ``start`` to ``end`` of a one-row frame; none if the end is before."""
    return bounds.filter(start <= end).select(F.explode(F.sequence(start, end, step)).alias(name))


def hours(spark: SparkSession) -> DataFrame:
    return spark.range(24).select(F.col("id").cast("int").alias("hour"))


def densify(axis_rows: DataFrame, counts: DataFrame, key: str, *values: str) -> DataFrame:
    """``counts`` on every row of the axis, zero where there are none."""
    joined = axis_rows.join(counts, key, "left")
    return joined.select(key, *[F.coalesce(F.col(v), F.lit(0)).cast("bigint").alias(v) for v in values])


def time_literal(value: str | date | datetime) -> str:
    """``yyyy-mm-ddThh:mm:ss.mmm`` of a date, a time or their ISO text; a time zone is dropped."""
    at = datetime.fromisoformat(value if isinstance(value, str) else value.isoformat())
    return at.replace(tzinfo=None).isoformat(timespec="milliseconds")


def iso_date(value: str) -> str:
    """``value`` if it is a date in the form yyyy-mm-dd and no other."""
    if not isinstance(value, str):
        raise ValueError("a date is a string")
    try:
        parsed = date.fromisoformat(value)
    except ValueError as error:
        raise ValueError(f"no date in the form yyyy-mm-dd: {value!r}") from error
    if parsed.isoformat() != value:
        raise ValueError(f"no date in the form yyyy-mm-dd: {value!r}")
    return value


def days_before(day: date, days: int) -> date:
    return day - timedelta(days=days)
