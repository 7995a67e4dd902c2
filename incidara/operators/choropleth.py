"""Map tables: rates by polygon, and the points with what their tooltips say."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidara.functions.bins import BIN_COLUMN
from incidara.functions.clean import title_case
from incidara.operators.medians import grouped_median
from incidara.operators.response import latest_row_response
from incidara.plans.ranges import clean_date
from incidara.roles import MAX_RESPONSE_MINUTES, RECENT_DAYS, YEAR_DAYS, Roles

MISSING = "Not available"


def latest_day(df: DataFrame, roles: Roles) -> DataFrame:
    return df.agg(F.max(roles.event_time).cast("date").alias("latest_day"))


def past_year(events: DataFrame, roles: Roles) -> DataFrame:
    """Events of the latest available day and the 364 before it."""
    last = F.broadcast(latest_day(events, roles))  # one row
    day = F.col(roles.event_time).cast("date")
    return events.join(last, (day >= F.date_sub("latest_day", YEAR_DAYS)) & (day <= F.col("latest_day"))).drop("latest_day")


def rates(events: DataFrame, polygons: DataFrame, population: DataFrame, roles: Roles, selected_bins: Sequence[str], area: str, max_minutes: float = MAX_RESPONSE_MINUTES) -> DataFrame:
    """Each polygon with population, events of the past year, their rate per 1,000 and median minutes.

    ``events`` is the latest row of each event with its ``area``; ``population`` has ``area`` too.  The
    rate is null without a positive population.
    """
    chosen = past_year(events, roles).filter(F.col(BIN_COLUMN).isin(list(selected_bins)) & F.col(area).isNotNull())
    counts = chosen.groupBy(area).agg(F.countDistinct(roles.event_id).alias("past_year_unique_events"))
    medians = grouped_median(latest_row_response(chosen, roles, max_minutes), [area], "response_time_minutes", "selected_median_response_minutes")
    joined = polygons.drop("population").join(population.select(area, "population"), area, "left").join(counts, area, "left").join(medians, area, "left")
    events_there = F.coalesce("past_year_unique_events", F.lit(0)).cast("bigint")
    rate = F.when(F.col("population") > 0, events_there / F.col("population") * F.lit(1000))
    return joined.withColumns({"past_year_unique_events": events_there, "past_year_unique_events_per_1000": rate})


def _whole(value: Column) -> Column:
    return F.coalesce(F.bround(value, 0).cast("bigint").cast("string"), F.lit(MISSING))


def _tenth(value: Column, unit: str = "") -> Column:
    return F.coalesce(F.concat(F.bround(value, 1).cast("string"), F.lit(unit)), F.lit(MISSING))


def map_points(events: DataFrame, polygon_rates: DataFrame, roles: Roles, selected_bins: Sequence[str], area: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Selected events of the past year between two days, with their area's figures as text.

    Without both days: the last thirty.  Days that are none: no bounds.  An area's figures are taken
    once, however many polygons it has.
    """
    chosen = past_year(events, roles).filter(F.col(BIN_COLUMN).isin(list(selected_bins)))
    day = F.col(roles.event_time).cast("date")
    if start is not None and end is not None:
        days = [_day(start), _day(end)]
        if None not in days:
            chosen = chosen.filter(day.between(*map(F.lit, days)))
    else:
        last = F.broadcast(latest_day(events, roles))
        chosen = chosen.join(last, (day >= F.date_sub("latest_day", RECENT_DAYS)) & (day <= F.col("latest_day"))).drop("latest_day")
    names = ("population", "past_year_unique_events", "past_year_unique_events_per_1000", "selected_median_response_minutes")
    figures = polygon_rates.groupBy(area).agg(*[F.max(n).alias(n) for n in names])
    joined = chosen.join(figures, area, "left")
    return joined.select(
        *chosen.columns,
        F.date_format(roles.event_time, "yyyy-MM-dd HH:mm").alias("event_time_display"),
        title_case(F.col(area)).alias(f"{area}_display"),
        _whole(F.col("population")).alias("population_display"),
        _whole(F.col("past_year_unique_events")).alias("past_year_unique_events_display"),
        _tenth(F.col("past_year_unique_events_per_1000")).alias("past_year_events_per_1000_display"),
        _tenth(F.col("selected_median_response_minutes"), " min").alias("median_response_display"),
    )


def _day(value: str) -> date | None:
    text = clean_date(value)
    return None if text is None else date.fromisoformat(text)
