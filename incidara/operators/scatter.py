"""Volume against response: rates by place and bin, concern scores, guide lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidara.functions.bins import BIN_COLUMN
from incidara.functions.ranks import percent_rank_of_ties
from incidara.operators.medians import grouped_median
from incidara.operators.response import years_observed
from incidara.roles import EXCLUDED_PLACES, MIN_EVENTS, Roles


def volume_response(response: DataFrame, population: DataFrame, roles: Roles, selected_bins: Sequence[str], min_events: int = MIN_EVENTS) -> DataFrame:
    """For each place and bin with enough events: counts, median and mean minutes, yearly rate per 1,000.

    Places that are unknown, or have no population, are left out.
    """
    place = roles.place
    chosen = response.filter(F.col(BIN_COLUMN).isin(list(selected_bins)) & ~F.col(place).isin(*EXCLUDED_PLACES))
    counts = chosen.groupBy(place, BIN_COLUMN).agg(F.countDistinct(roles.event_id).alias("unique_call_events"), F.avg("response_time_minutes").alias("mean_response_minutes"))
    medians = grouped_median(chosen, [place, BIN_COLUMN], "response_time_minutes", "median_response_minutes")
    groups = counts.filter(F.col("unique_call_events") >= min_events).join(medians, [place, BIN_COLUMN], "left")
    groups = groups.select(place, BIN_COLUMN, "unique_call_events", "median_response_minutes", "mean_response_minutes")
    known = population.filter(F.col("population") > 0).select(place, "population")
    joined = groups.join(known, place).crossJoin(F.broadcast(years_observed(response)))  # one row of years
    rate = F.col("unique_call_events") / F.col("years_observed") / F.col("population") * F.lit(1000)
    return joined.withColumn("annual_events_per_1000", rate).filter(F.col("annual_events_per_1000") > 0).drop("years_observed")


def concern_score(rates: DataFrame) -> DataFrame:
    """Ranks of rate and response among all rows, their product, and a marker size from it."""
    ranked = rates.withColumns(
        {
            "volume_rank": percent_rank_of_ties(F.col("annual_events_per_1000")),
            "response_rank": percent_rank_of_ties(F.col("median_response_minutes")),
        }
    )
    scored = ranked.withColumn("concern_score", F.col("volume_rank") * F.col("response_rank"))
    return scored.withColumn("marker_size", F.lit(10) + F.lit(40) * F.col("concern_score"))


def guide_lines(rates: DataFrame) -> DataFrame:
    """One row: medians and extents of both axes."""
    found = {}
    for axis, column in (("volume", "annual_events_per_1000"), ("response", "median_response_minutes")):
        found |= {f"{axis}_median": F.median(column), f"{axis}_min": F.min(column), f"{axis}_max": F.max(column)}
    return rates.agg(*[value.alias(name) for name, value in found.items()])
