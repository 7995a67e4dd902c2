"""The daily series: events and records of each day with a trailing average."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidara.functions import calendar
from incidara.functions.bins import BIN_COLUMN
from incidara.operators.schema import require_columns
from incidara.roles import AVERAGE_DAYS, RECENT_DAYS, YEAR_DAYS, Roles


def daily_window(df: DataFrame, roles: Roles) -> DataFrame:
    """One row of dates: the range of the data, of the plot and of what it shows at first.

    The first day is left out, as it may be partial; the plot has a year at most, the first view a month.
    """
    days = df.filter(F.col(roles.event_time).isNotNull()).agg(F.min(roles.event_time).cast("date").alias("first"), F.max(roles.event_time).cast("date").alias("last"))
    starts = days.withColumn("plot_start", F.greatest(F.date_add("first", 1), F.date_sub("last", YEAR_DAYS)))
    return starts.select(
        F.col("first").alias("earliest_available"),
        F.col("last").alias("latest_available"),
        F.date_add("first", 1).alias("earliest_complete"),
        "plot_start",
        F.col("last").alias("plot_end"),
        F.greatest(F.date_sub("last", RECENT_DAYS), F.col("plot_start")).alias("view_start"),
    )


def daily_series(df: DataFrame, roles: Roles, selected_bins: Sequence[str]) -> DataFrame:
    """``date, unique_call_events, dispatch_records, rolling_7_day_avg`` on every day of the plot window.

    The average is over the day and the six before it, null before there are seven.
    """
    require_columns(df, roles.event_id, roles.row_id, roles.event_time, BIN_COLUMN)
    rows = df.filter(F.col(roles.event_time).isNotNull() & F.col(roles.event_id).isNotNull())
    window = F.broadcast(daily_window(rows, roles).select("plot_start", "plot_end"))  # one row
    counted = (
        rows.filter(F.col(BIN_COLUMN).isin(list(selected_bins)))
        .groupBy(F.col(roles.event_time).cast("date").alias("date"))
        .agg(F.countDistinct(roles.event_id).alias("unique_call_events"), F.count(F.lit(1)).alias("dispatch_records"))
    )
    days = calendar.axis(window, F.col("plot_start"), F.col("plot_end"), F.expr("INTERVAL 1 DAY"), "date")
    series = calendar.densify(days, counted, "date", "unique_call_events", "dispatch_records")
    trailing = Window.orderBy("date").rowsBetween(1 - AVERAGE_DAYS, 0)  # a year of days at most
    average = F.when(F.count(F.lit(1)).over(trailing) == AVERAGE_DAYS, F.avg("unique_call_events").over(trailing))
    return series.withColumn("rolling_7_day_avg", average).orderBy("date")
