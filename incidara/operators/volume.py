"""Distinct events by month or week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidara.functions import calendar
from incidara.functions.clean import clean_text
from incidara.operators.schema import require_columns
from incidara.roles import Roles

#: Columns of the feed that volumes may be grouped by.
GROUPS = ("event_group", "call_type", "initial_call_type", "final_call_type", "dispatch_neighborhood")


def _time(value, default: Column) -> Column:
    return default if value is None else F.lit(calendar.time_literal(value)).cast("timestamp_ntz")


def time_bounds(df: DataFrame, roles: Roles) -> DataFrame:
    """``min_time, max_time`` of rows that have a time and an event."""
    rows = df.filter(F.col(roles.event_time).isNotNull() & F.col(roles.event_id).isNotNull())
    return rows.agg(F.min(roles.event_time).alias("min_time"), F.max(roles.event_time).alias("max_time"))


def distinct_events(df: DataFrame, roles: Roles, start, end, group_by: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Different events (and groups) with a time in ``[start, end)``, in order, or one page of them."""
    columns = [roles.event_id] + ([group_by] if group_by else [])
    time = F.col(roles.event_time)
    rows = df.filter((time >= _time(start, time)) & (time < _time(end, time)) & F.col(roles.event_id).isNotNull()).select(*columns).distinct().orderBy(*columns)
    return rows if limit is None else rows.offset(offset).limit(limit)


def period_volume(df: DataFrame, roles: Roles, grain: str = "month", group_by: str | None = None, start=None, end=None, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """``period_start[, year, week_of_year][, group], event_count`` over ``[start, end)``.

    Without bounds: from the first event to the end of the last one's period.  Ungrouped volumes have
    every period, grouped ones those that occur; a missing group is ``unknown``, and groups that
    differ in case or outer white space are one.  An event in two periods counts in each.
    """
    calendar.check_grain(grain)
    if allowed is not None and group_by is not None and group_by not in allowed:
        raise ValueError(f"group_by is one of {allowed}")
    require_columns(df, roles.event_id, roles.event_time, *([group_by] if group_by else []))
    time = F.col(roles.event_time)
    rows = df.filter(time.isNotNull() & F.col(roles.event_id).isNotNull())
    if start is not None:
        rows = rows.filter(time >= _time(start, time))
    if end is not None:
        rows = rows.filter(time < _time(end, time))
    keys = [calendar.period_start(time, grain).alias("period_start")]
    if group_by:
        keys.append(F.coalesce(clean_text(F.col(group_by)), F.lit("unknown")).alias(group_by))
    counted = rows.groupBy(*keys).agg(F.countDistinct(roles.event_id).alias("event_count"))
    if not group_by:
        bounds = counted.agg(F.min("period_start").alias("first"), F.max("period_start").alias("last")) if start is None or end is None else df.sparkSession.range(1)
        first = F.col("first") if start is None else calendar.period_start(_time(start, time), grain)
        last = F.col("last") if end is None else calendar.period_start(_time(end, time) - F.expr("INTERVAL 1 MICROSECOND"), grain)
        counted = calendar.densify(calendar.axis(bounds, first, last, calendar.one_period(grain), "period_start"), counted, "period_start", "event_count")
    if grain == "week":
        year, week = F.extract(F.lit("YEAROFWEEK"), F.col("period_start")), F.weekofyear("period_start")
        counted = counted.select("period_start", year.cast("int").alias("year"), week.cast("int").alias("week_of_year"), *([group_by] if group_by else []), "event_count")
    return counted.orderBy("period_start", *([group_by] if group_by else []))
