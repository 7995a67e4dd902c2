"""The eleven calls of the fixture, and the edge cases of each operator."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from incidara.functions import bins, calendar, clean, ranks
from incidara.operators import daily, dedup, response, schema, spatial, summary, volume
from incidara.roles import BinSpec, Roles

ROLES = Roles(event_id="event_id", row_id="row_id", event_time="queued", arrival_time="arrived", category="category", place="place", priority="priority", lat="lat", lon="lon")
T = lambda text: None if text is None else datetime.fromisoformat(text)
ROWS = [
    ("E1", "R1", "2024-12-30 10:00:00", "2024-12-30 10:10:00", None, 1.0, "alpha", 47.60, -122.33),
    ("E1", "R2", "2024-12-30 10:00:00", "2024-12-30 10:04:00", "assault", 2.0, "alpha", 47.61, -122.33),
    ("E2", "R3", "2024-12-31 23:59:00", "2025-01-01 00:01:00", "theft", 3.0, "alpha", 47.60, -122.34),
    ("E3", "R4", "2025-01-01 08:00:00", None, "narcotics", 2.0, "beta", 47.62, -122.30),
    ("E4", "R5", "2025-01-02 09:00:00", "2025-01-02 08:59:00", "robbery", 1.0, "beta", 47.62, -122.31),
    ("E5", "R6", "2025-01-02 09:00:00", "2025-01-03 09:00:00", "fraud", 4.0, "beta", 47.99, -122.31),
    ("E6", "R7", "2025-01-06 00:00:00", "2025-01-06 00:00:30", "traffic", 5.0, None, 47.45, -122.20),
    ("E7", "R8", "2025-01-06 12:00:00", "2025-01-07 12:01:00", "theft", 3.0, "unknown", None, None),
    ("E8", "R9", None, "2025-01-06 13:00:00", "theft", 3.0, "alpha", 47.60, -122.33),
    (None, "R10", "2025-01-06 13:00:00", "2025-01-06 13:05:00", "theft", 3.0, "alpha", 47.60, -122.33),
    ("E1", "R11", "2025-01-07 10:00:00", "2025-01-07 10:20:00", "assault", 2.0, "beta", 47.62, -122.30),
]
SCHEMA = "event_id string, row_id string, queued timestamp_ntz, arrived timestamp_ntz, category string, priority double, place string, lat double, lon double"


@pytest.fixture(scope="module")
def calls(spark):
    rows = [(a, b, T(q), T(r), *rest) for a, b, q, r, *rest in ROWS]
    return spark.createDataFrame(rows, SCHEMA).withColumn(bins.BIN_COLUMN, bins.importance_bin(F.col("category")))


def _rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_daily_series(calls):
    targets = ["property/nonviolent", "drug-related", "violent/person crime"]
    got = _rows(daily.daily_series(calls, ROLES, targets))
    expected = [(1, 1), (1, 1), (2, 2), (0, 0), (0, 0), (0, 0), (1, 1), (1, 1)]
    assert [r[1:3] for r in got] == expected
    assert [r[0] for r in got] == [date(2024, 12, 31), *[date(2025, 1, d) for d in range(1, 8)]]
    assert [r[3] for r in got[:6]] == [None] * 6 and all(abs(r[3] - 5 / 7) < 1e-12 for r in got[6:])


def test_daily_series_of_one_day_is_empty(calls):
    assert daily.daily_series(calls.filter("queued < '2024-12-31'"), ROLES, ["drug-related"]).count() == 0


def test_event_response(calls):
    wide = {r["event_id"]: r for r in response.event_response(calls, ROLES, max_minutes=1e9).collect()}
    assert {k: r["response_time_minutes"] for k, r in wide.items()} == {"E1": 4.0, "E2": 2.0, "E5": 1440.0, "E6": 0.5, "E7": 1441.0}
    first = wide["E1"]
    assert (first["category"], first["priority"], first["place"], first["dispatch_records"]) == ("assault", 1.0, "alpha", 3)
    band = response.event_response(calls, ROLES)
    assert {r["event_id"] for r in band.collect()} == {"E1", "E2", "E5", "E6"}
    assert abs(response.years_observed(band).first()[0] - 6 / 365.25) < 1e-15
    assert response.years_observed(band.limit(0)).first()[0] == 1.0


def test_mappable_events(calls):
    got = set(_rows(spatial.mappable_events(calls, ROLES), "event_id", "row_id"))
    assert got == {("E1", "R11"), ("E2", "R3"), ("E3", "R4"), ("E4", "R5"), ("E6", "R7")}


def test_volumes(calls):
    week = _rows(volume.period_volume(calls, ROLES, "week"))
    assert week == [(datetime(2024, 12, 30), 2025, 1, 5), (datetime(2025, 1, 6), 2025, 2, 3)]
    assert [r[1] for r in _rows(volume.period_volume(calls, ROLES))] == [2, 6]
    by_place = {(r[0].month, r[1]): r[2] for r in _rows(volume.period_volume(calls, ROLES, "month", "place"))}
    assert by_place == {(12, "alpha"): 2, (1, "beta"): 4, (1, "unknown"): 2}
    clipped = _rows(volume.period_volume(calls, ROLES, "month", None, "2024-11-15", "2025-01-02"))
    assert [(r[0].month, r[1]) for r in clipped] == [(11, 0), (12, 2), (1, 1)]
    with pytest.raises(ValueError):
        volume.period_volume(calls, ROLES, "day")
    with pytest.raises(ValueError):
        volume.period_volume(calls, ROLES, "month", "place", allowed=volume.GROUPS)


def test_counts(calls):
    assert _rows(summary.place_counts(calls, ROLES)) == [("alpha", 5, 3), ("beta", 4, 4), ("unknown", 1, 1)]
    hours = dict(_rows(summary.hourly_profile(calls, "queued")))
    assert {h: n for h, n in hours.items() if n} == {0: 1, 8: 1, 9: 2, 10: 3, 12: 1, 13: 1, 23: 1} and len(hours) == 24
    found = summary.summary(calls.withColumn("count_of_officers", F.lit(None).cast("double")), ROLES).first()
    assert (found["median_priority"], found["mappable_records"], found["median_officers"]) == (3.0, 10, None)
    assert _rows(summary.value_counts(calls, "category"))[0] == ("theft", 4)
    for wrong in (0, True, 2.5):
        with pytest.raises(ValueError):
            summary.top_values(calls, "category", wrong)


def test_upsert_and_retention(spark):
    schema_ = "k string, t timestamp_ntz, v string"
    make = lambda rows: spark.createDataFrame([(k, T(t), v) for k, t, v in rows], schema_)
    old = make([("a", "2024-01-05", "old"), ("b", "2024-12-01", "old"), (None, "2024-12-02", "n1"), ("c", "2023-01-01", "old")])
    new = make([("b", "2024-12-03", "new"), ("d", "2025-01-04", "new"), (None, "2024-12-05", "n2"), ("e", None, "new")])
    both = dedup.upsert_keep_last(old, new, "k", F.col("t").desc())
    kept = dedup.retain(both, "t", 365).orderBy("t")
    assert _rows(kept, "k", "v") == [("a", "old"), ("b", "new"), (None, "n2"), ("d", "new")]
    again = dedup.upsert_keep_last(both, new, "k", F.col("t").desc())
    assert sorted(map(str, _rows(again))) == sorted(map(str, _rows(both)))


def test_percent_rank_of_ties(spark):
    values = spark.createDataFrame([(10.0,), (20.0,), (20.0,), (50.0,), (None,)], "v double")
    got = sorted(_rows(values.withColumn("r", ranks.percent_rank_of_ties(F.col("v")))), key=str)
    assert got == sorted([(10.0, 0.25), (20.0, 0.625), (20.0, 0.625), (50.0, 1.0), (None, None)], key=str)


def test_text_and_coercion(spark):
    rows = spark.createDataFrame([("\t a \n",), ("slu/cascade o'brien - west 3rd",), (None,)], "s string")
    got = _rows(rows.select(clean.clean_text(F.col("s")), clean.title_case(clean.clean_text(F.col("s")))))
    assert got == [("a", "A"), ("slu/cascade o'brien - west 3rd", "Slu/Cascade O'Brien - West 3Rd"), (None, None)]
    numbers = {"1": 1.0, "abc": None, "": None, " 12 ": 12.0, "nan": None, "1d": None, "inf": float("inf"), "1e3": 1000.0}
    frame = spark.createDataFrame([(k,) for k in numbers], "s string")
    assert dict(_rows(frame.select("s", clean.to_number(F.col("s"))))) == numbers
    times = spark.createDataFrame([("2025-01-01T10:20:30.123",), ("junk",), ("",)], "s string")
    assert [r[0] for r in _rows(times.select(clean.to_time(F.col("s"))))] == [datetime(2025, 1, 1, 10, 20, 30, 123000), None, None]


def test_conform_and_guards(spark):
    df = schema.from_records(spark, [{"cad_event_number": " X1 ", "priority": "2", "surplus": 1}, {"event_group": " Theft "}])
    assert df.columns == list(schema.CALL_COLUMNS) and df.schema["priority"].dataType.simpleString() == "double"
    assert _rows(df, "cad_event_number", "priority", "event_group") == [("X1", 2.0, None), (None, None, "theft")]
    assert schema.from_records(spark, []).count() == 0
    for wrong in ({"a": 1}, [1]):
        with pytest.raises(ValueError):
            schema.from_records(spark, wrong)
    with pytest.raises(ValueError, match="nope"):
        schema.require_columns(df, "nope")


def test_bins(spark):
    cases = {None: "unknown / unclassified", "": "other / unclassified", " Narcotics ": "drug-related", "rape": "violent/person crime", "car prowl": "property/nonviolent", "traffic": "lower public-safety urgency", "x": "other / unclassified"}
    frame = spark.createDataFrame([(k,) for k in cases], "event_group string")
    assert [r[0] for r in _rows(frame.select(bins.importance_bin(F.col("event_group"))))] == list(cases.values())
    assert bins.with_bin(frame.withColumn(bins.BIN_COLUMN, F.lit("mine")), "event_group").first()[1] == "mine"
    combos = bins.combinations()
    assert len(combos) == 7 and len(combos[0]) == 3 and bins.combo_label(combos[0]) == "All selected bins"
    assert [bins.decode_combo(bins.encode_combo(c)) for c in combos] == combos and bins.decode_combo(None) == combos[0]
    assert bins.combo_label(combos[4]) == " + ".join(combos[4]) and bins.combo_options()[0]["label"] == "All selected bins"
    assert bins.combo_color(["drug-related"]) == "#2F80ED" and bins.combo_color(combos[0]) == bins.SEVERAL_COLOR
    assert bins.importance_bin(F.col("event_group"), BinSpec()) is not None


SQUARE = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]


@pytest.mark.parametrize(
    ("rings", "inside", "outside"),
    [
        (SQUARE, [(0.5, 0.5)], [(1.5, 0.5), (0, 0.5), (0.5, 1), (1, 0.5), (0.5, 0), (0, 0), (1, 1)]),
        ([[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 1.0), (0.0, 2.0)]], [(0.5, 1.0), (1.5, 1.0)], [(1.0, 1.5), (1.0, 1.0)]),
        ([*SQUARE, [(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)]], [(0.2, 0.2)], [(0.5, 0.5), (0.4, 0.5)]),
        ([*SQUARE, [(3.0, 3.0), (4.0, 3.0), (4.0, 4.0), (3.0, 4.0)]], [(0.5, 0.5), (3.5, 3.5)], [(2.0, 2.0)]),
        ([SQUARE[0] + SQUARE[0][:1]], [(0.5, 0.5)], [(0, 0)]),
    ],
)
def test_within(spark, rings, inside, outside):
    polygon = spark.createDataFrame([(1, "a", rings)], f"objectid long, area string, rings {spatial.RINGS}")
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate([*inside, *outside])], "id long, x double, y double")
    assert {r["id"] for r in spatial.containing(points, polygon, "x", "y", cell=0.3).collect()} == set(range(len(inside)))


def test_lookup_takes_the_first_polygon_and_keeps_unmatched_points(spark):
    polygons = spark.createDataFrame([(2, "second", SQUARE), (1, "first", SQUARE)], f"objectid long, area string, rings {spatial.RINGS}")
    points = spark.createDataFrame([("in", 0.5, 0.5), ("out", 5.0, 5.0), ("none", None, None)], "id string, x double, y double")
    got = dict(_rows(spatial.lookup(points, polygons, "id", "x", "y", "area")))
    assert got == {"in": "first", "out": None, "none": None}


def test_calendar_values():
    assert calendar.time_literal("2024-01-01") == "2024-01-01T00:00:00.000" and calendar.time_literal("2024-01-01T13:30:00") == "2024-01-01T13:30:00.000"
    assert calendar.time_literal(date(2024, 1, 2)) == "2024-01-02T00:00:00.000" and calendar.time_literal(datetime(2024, 1, 2, 3)) == "2024-01-02T03:00:00.000"
    assert calendar.iso_date("2024-02-29") == "2024-02-29"
    for wrong in ("2024-2-1", "20240201", "2023-02-29", 5):
        with pytest.raises(ValueError):
            calendar.iso_date(wrong)
