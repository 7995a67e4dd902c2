"""Declared schemas: what a table must have, and how any input is brought to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidara.functions.clean import clean_text, number_or_null, strip, to_number, to_time

_KINDS = {"id": T.StringType(), "text": T.StringType(), "number": T.DoubleType(), "time": T.TimestampNTZType()}
#: The feed's columns in order, and how each is read.
CALL_COLUMNS = {
    "cad_event_number": "id",
    "cad_event_original_time_queued": "time",
    "cad_event_arrived_time": "time",
    "cad_event_clearance_description": "text",
    "call_sign_dispatch_id": "id",
    "call_type": "text",
    "priority": "number",
    "initial_call_type": "text",
    "final_call_type": "text",
    "cad_event_response_category": "text",
    "dispatch_precinct": "text",
    "dispatch_sector": "text",
    "dispatch_beat": "text",
    "dispatch_neighborhood": "text",
    "dispatch_latitude": "number",
    "dispatch_longitude": "number",
    "count_of_officers": "number",
    "event_group": "text",
}


def struct_of(columns: dict[str, str] = CALL_COLUMNS) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in columns.items()])


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def conform(df: DataFrame, columns: dict[str, str] = CALL_COLUMNS) -> DataFrame:
    """``df`` with exactly the declared columns in their order: cleaned, coerced, null where absent."""
    read = {"id": strip, "text": clean_text, "number": to_number, "time": to_time}

    def column(name: str, kind: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast(_KINDS[kind]).alias(name)
        found = F.col(name)
        if kind == "time" and isinstance(df.schema[name].dataType, T.TimestampNTZType):
            return found  # as it is, so that filters still reach the source
        if kind == "number" and isinstance(df.schema[name].dataType, T.NumericType):
            return number_or_null(found).alias(name)
        return read[kind](found).cast(_KINDS[kind]).alias(name)

    return df.select(*[column(name, kind) for name, kind in columns.items()])


def from_records(spark: SparkSession, records: list[dict], columns: dict[str, str] = CALL_COLUMNS) -> DataFrame:
    """A typed table of a page of records, whose values may be text and whose keys may be absent."""
    if not isinstance(records, list) or not all(isinstance(r, dict) for r in records):
        raise ValueError("records are a list of dicts")
    raw = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    rows = [tuple(None if r.get(name) is None else str(r[name]) for name in columns) for r in records]
    return conform(spark.createDataFrame(rows, raw), columns)


def probe(df: DataFrame) -> DataFrame:
    """``column_name, data_type, non_null, nulls`` of every column, in one pass."""
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}") for k, c in enumerate(df.columns)], F.count(F.lit(1)).alias("rows"))
    kinds = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), (F.col("rows") - F.col(f"n{k}")).alias("non_null"), F.col(f"n{k}").alias("nulls")) for k, (c, t) in enumerate(df.dtypes)]
    return counted.select(F.inline(F.array(*kinds)))


def record_keys(raw: DataFrame, json_column: str = "value") -> DataFrame:
    """``key, records`` over a column of JSON objects: which keys occur, and in how many records."""
    keys = raw.select(F.explode(F.json_object_keys(F.col(json_column))).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("records"))
