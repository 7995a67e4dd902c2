"""Text, number and time coercion as column expressions; what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def strip(column: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(column.cast("string"), r"(?U)^\s+|\s+$", "")


def clean_text(column: Column) -> Column:
    return F.lower(strip(column))


def title_case(column: Column) -> Column:
    """Each run of letters begins in upper case and goes on in lower case, digits and marks apart."""
    pieces = F.split(F.lower(column.cast("string")), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def to_number(column: Column) -> Column:
    """A double; null for what is no number and for NaN, which counts as missing."""
    text = strip(column)
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def number_or_null(column: Column) -> Column:
    """A numeric column as double without NaN."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def to_time(column: Column) -> Column:
    """A timestamp without time zone; null for what is none."""
    return strip(column).try_cast("timestamp_ntz")
