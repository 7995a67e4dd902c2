"""Distinct events in a form that can be added up: exact bitmaps by day.

Events are numbered in the order of their first time, so those of a day are neighbours and their bits fill few blocks.  A day has, for each
group, one bitmap for each block of numbers that occurs.  Weeks, months and sets of groups are unions of days: an event
that is in several of them counts once, and the calls are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidara.functions import calendar
from incidara.functions.clean import clean_text
from incidara.operators.schema import require_columns
from incidara.roles import Roles


def number_events(df: DataFrame, roles: Roles, known: DataFrame | None = None) -> DataFrame:
    """``event, number`` of every event with a time that ``known`` (such a table) does not have; numbers are dense in blocks.

    Numbers depend on how Spark deals the rows: write the table, and go on from what was written.
    """
    require_columns(df, roles.event_id, roles.event_time)
    rows = df.filter(F.col(roles.event_id).isNotNull() & F.col(roles.event_time).isNotNull())
    firsts = rows.groupBy(F.col(roles.event_id).cast("string").alias("event")).agg(F.min(roles.event_time).alias("first"))
    after = F.lit(0).cast("bigint")
    if known is not None:
        firsts = firsts.join(known.select("event"), "event", "left_anti")
        last = known.agg(F.max("number").alias("last")).first()["last"]  # one number
        after = F.lit(0 if last is None else last // 32768 * 32768 + 32768).cast("bigint")
    ordered = firsts.repartitionByRange("first", "event").sortWithinPartitions("first", "event")
    # 2 ** 33 numbers for each partition: blocks of different ones do not meet
    return ordered.select("event", (after + F.monotonically_increasing_id()).alias("number"))


def event_days(df: DataFrame, numbers: DataFrame, roles: Roles, *groups: str, keep: Sequence[str] = ()) -> DataFrame:
    """``day, groups, block, events`` (and ``keep``, columns that follow from the day): bitmaps of each day's events.  A missing group is ``unknown``; case and outer white space do not count."""
    require_columns(df, roles.event_id, roles.event_time, *groups)
    named = [F.coalesce(clean_text(F.col(g)), F.lit("unknown")).alias(g) for g in groups]
    rows = df.select(F.col(roles.event_time).cast("date").alias("day"), F.col(roles.event_id).cast("string").alias("event"), *named, *keep)
    rows = rows.filter(F.col("day").isNotNull() & F.col("event").isNotNull()).distinct()
    placed = rows.join(numbers, "event")
    return placed.groupBy("day", *groups, *keep, F.bitmap_bucket_number("number").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("events"))


def distinct_by(days: DataFrame, *keys: Column | str) -> DataFrame:
    """``keys, event_count`` from bitmaps: unions first, by block, then bits."""
    united = days.groupBy(*keys, "block").agg(F.bitmap_or_agg("events").alias("events"))
    return united.groupBy(*[c for c in united.columns if c not in ("block", "events")]).agg(F.sum(F.bitmap_count("events")).alias("event_count"))


def volume(days: DataFrame, grain: str, *groups: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """``period_start, groups, event_count`` of days in ``[start, end)``; periods without an event do not appear."""
    if start is not None:
        days = days.filter(F.col("day") >= F.lit(calendar.iso_date(start)).cast("date"))
    if end is not None:
        days = days.filter(F.col("day") < F.lit(calendar.iso_date(end)).cast("date"))
    period = calendar.period_start(F.col("day").cast("timestamp_ntz"), grain).alias("period_start")
    return distinct_by(days, period, *groups)
