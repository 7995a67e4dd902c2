"""Response times: the event-level rollup, and the years that it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidara.functions import calendar
from incidara.functions.bins import BIN_COLUMN, importance_bin
from incidara.operators.schema import require_columns
from incidara.roles import DEFAULT_BINS, MAX_RESPONSE_MINUTES, BinSpec, Roles


def event_response(df: DataFrame, roles: Roles, spec: BinSpec = DEFAULT_BINS, max_minutes: float = MAX_RESPONSE_MINUTES) -> DataFrame:
    """One row for each event: first times, first known category, priority and place, minutes to arrival.

    "First" is in the order of time and then of ``row_id`` and the ties, nulls skipped; a time that is
    missing comes last.  Events whose minutes are missing or not in ``0 .. max_minutes`` are left out.
    """
    r = roles
    require_columns(df, r.event_id, r.row_id, r.event_time, r.arrival_time, r.category, r.priority, r.place)
    order = F.struct(F.col(r.event_time).isNull(), r.event_time, r.row_id, *r.ties)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    needed = dict.fromkeys([r.event_id, r.row_id, r.event_time, r.arrival_time, r.category, r.priority, r.place, *r.ties])
    # rows are dealt as they are, if they are not yet: what three first values keep of a row is larger than the row
    dealt = df.filter(F.col(r.event_id).isNotNull()).select(*needed).repartition(r.event_id)
    events = (
        dealt.groupBy(r.event_id)
        .agg(
            F.min(r.event_time).alias("queued_time"),
            F.min(r.arrival_time).alias("first_arrival_time"),
            first(r.category).alias(r.category),
            first(r.priority).alias(r.priority),
            first(r.place).alias(r.place),
            F.countDistinct(r.row_id).alias("dispatch_records"),
        )
    )
    timed = events.withColumn("response_time_minutes", calendar.minutes_between(F.col("queued_time"), F.col("first_arrival_time")))
    return timed.filter(F.col("response_time_minutes").between(0, max_minutes)).withColumn(BIN_COLUMN, importance_bin(F.col(r.category), spec))


def latest_row_response(df: DataFrame, roles: Roles, max_minutes: float = MAX_RESPONSE_MINUTES) -> DataFrame:
    """Rows with the minutes between their own two times, where these are in ``0 .. max_minutes``."""
    timed = df if "response_time_minutes" in df.columns else df.withColumn("response_time_minutes", calendar.minutes_between(F.col(roles.event_time), F.col(roles.arrival_time)))
    return timed.filter(F.col("response_time_minutes").between(0, max_minutes))


def years_observed(response: DataFrame) -> DataFrame:
    """``years_observed``: whole days between first and last event over 365.25; 1 if there are none."""
    span = response.agg(F.min("queued_time").alias("first"), F.max("queued_time").alias("last"))
    years = calendar.whole_days(F.col("first"), F.col("last")) / F.lit(365.25)
    return span.select(F.when(years > 0, years).otherwise(F.lit(1.0)).alias("years_observed"))
