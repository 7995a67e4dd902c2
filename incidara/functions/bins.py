"""Importance bins: classification, and the names and codes of their combinations."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidara.functions.clean import clean_text
from incidara.roles import DEFAULT_BINS, BinSpec

BIN_COLUMN = "event_importance_bin"
SEPARATOR = "||"
#: Colours of the bins and of what is none or several of them.
BIN_COLORS = {"drug-related": "#2F80ED", "property/nonviolent": "#27AE60", "violent/person crime": "#EB5757"}
OTHER_COLOR, SEVERAL_COLOR = "#bbbbbb", "#dddddd"


def importance_bin(category: Column, spec: BinSpec = DEFAULT_BINS) -> Column:
    """Bin of a category; null is unknown, an unlisted one (also the empty text) is other."""
    cleaned = clean_text(category)
    start = F.when(category.isNull(), F.lit(spec.unknown))
    return reduce(lambda case, item: case.when(cleaned.isin(*item[1]), F.lit(item[0])), spec.bins.items(), start).otherwise(F.lit(spec.other))


def with_bin(df: DataFrame, category: str, spec: BinSpec = DEFAULT_BINS) -> DataFrame:
    """``df`` with the bin column; one that is there already stays as it is."""
    if category not in df.columns:
        raise ValueError(f"missing column: {category}")
    return df if BIN_COLUMN in df.columns else df.withColumn(category, clean_text(F.col(category))).withColumn(BIN_COLUMN, importance_bin(F.col(category), spec))


def combo_label(combo: list[str], spec: BinSpec = DEFAULT_BINS) -> str:
    return "All selected bins" if len(combo) == len(spec.targets) else " + ".join(combo)


def combinations(spec: BinSpec = DEFAULT_BINS) -> list[list[str]]:
    """All of the target bins first, then every smaller choice of them."""
    sizes = (len(spec.targets), *range(1, len(spec.targets)))
    return [list(c) for size in sizes for c in itertools.combinations(spec.targets, size)]


def encode_combo(combo: list[str]) -> str:
    return SEPARATOR.join(combo)


def decode_combo(code: str | None, spec: BinSpec = DEFAULT_BINS) -> list[str]:
    return list(spec.targets) if code is None else code.split(SEPARATOR)


def combo_options(spec: BinSpec = DEFAULT_BINS) -> list[dict[str, str]]:
    return [{"label": combo_label(c, spec), "value": encode_combo(c)} for c in combinations(spec)]


def combo_color(combo: list[str]) -> str:
    return BIN_COLORS.get(combo[0], OTHER_COLOR) if len(combo) == 1 else SEVERAL_COLOR
