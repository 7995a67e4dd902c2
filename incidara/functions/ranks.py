"""Ranks that Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def percent_rank_of_ties(value: Column) -> Column:
    """Average rank of equal values over the number of non-null values, ascending; null for null.

    The window is over the whole frame, so use it on aggregated tables.
    """
    everything = Window.partitionBy()
    first = F.rank().over(Window.orderBy(value.asc_nulls_last()))
    equal = F.count(F.lit(1)).over(Window.partitionBy(value))
    return F.when(value.isNotNull(), (first + (equal - 1) / F.lit(2.0)) / F.count(value).over(everything))
