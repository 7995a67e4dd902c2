"""Exact medians of groups by counting ranges of values.

Equal values of a group are counted first, in every task and then by group and value, so a group's values are spread
over tasks however many there are.  Their counts by range of values, at most ``ranges`` of them a group, tell the range that
holds the middle; it is cut into ranges again; and only values of the last such range are put in order.  No task has all
values of a group, and no buffer holds them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group's values are counted in, and how often.
RANGES, ROUNDS = 1024, 2


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Rows of one group; a missing key is a group as well."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_r{k}"]) for k, c in enumerate(names)], F.lit(True))


def _beside(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """``left`` with the columns of its group's row in ``right``."""
    renamed = right.withColumnsRenamed({c: f"_r{k}" for k, c in enumerate(names)})
    return left.join(renamed, _same(left, renamed, names)).drop(*[f"_r{k}" for k in range(len(names))])


def grouped_median(df: DataFrame, keys: list[str], value: str, name: str, ranges: int = RANGES, rounds: int = ROUNDS) -> DataFrame:
    """``keys, name``: the median of ``value`` in each group that has one; of an even number, the middle of the two in the middle.

    Missing values and NaN do not count; a missing key is a group.  ``keys`` may be empty.
    """
    v, n = F.col("_v"), F.col("_n")
    known = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(v.isNotNull() & ~F.isnan(v))
    counted = known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    size = counted.groupBy(*keys).agg(F.sum(n).alias("_size"), F.min(v).alias("_low"), F.max(v).alias("_high"), F.lit(0).cast("bigint").alias("_before"))
    places = [((F.col("_size") - 1) / 2).cast("bigint"), (F.col("_size") / 2).cast("bigint")]  # of the two in the middle, from 0
    wanted = size.select(*keys, "_size", "_low", "_high", "_before")
    for _ in range(rounds):
        share = (v - F.col("_low")) / (F.col("_high") - F.col("_low"))
        part = F.when(F.col("_high") > F.col("_low"), F.least(F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * ranges), F.lit(ranges - 1))).otherwise(0)
        near = _beside(counted, wanted, keys).filter((v >= F.col("_low")) & (v <= F.col("_high"))).withColumn("_part", part)
        parts = near.groupBy(*keys, "_size", "_before", "_part").agg(F.sum(n).alias("_m"), F.min(v).alias("_least"), F.max(v).alias("_most"))
        upto = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_part"))  # ``ranges`` rows a group
        placed = parts.withColumn("_end", F.col("_before") + upto).withColumn("_begin", F.col("_end") - F.col("_m"))
        middle = placed.filter((F.col("_begin") <= places[1]) & (F.col("_end") > places[0]))  # one range, or the two around the middle
        wanted = middle.groupBy(*keys, "_size").agg(F.min("_least").alias("_low"), F.max("_most").alias("_high"), F.min("_begin").alias("_before"))
    near = _beside(counted, wanted, keys).filter((v >= F.col("_low")) & (v <= F.col("_high")))
    end = F.col("_before") + F.sum(n).over(Window.partitionBy(*keys).orderBy("_v"))  # values of the last range
    placed = near.withColumn("_end", end).withColumn("_begin", F.col("_end") - n)
    two = [F.max(F.when((F.col("_begin") <= p) & (F.col("_end") > p), v)) for p in places]
    both = placed.groupBy(*keys, "_size").agg(two[0].alias("_one"), two[1].alias("_other"))
    return both.select(*keys, F.when(F.col("_one") == F.col("_other"), F.col("_one")).otherwise(F.col("_one") * 0.5 + F.col("_other") * 0.5).alias(name))
