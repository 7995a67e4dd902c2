"""Ring nesting, quadtree cells and reprojection."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from incidara.functions import projections
from incidara.operators import spatial, topology
from incidara.sources import tables

BOX = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def polygons(spark, *rings_of_each):
    rows = [(k, f"area {k}", [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in enumerate(rings_of_each, 1)]
    return spark.createDataFrame(rows, f"objectid long, area string, rings {spatial.RINGS}")


def parts_of(df):
    found = df.select("objectid", topology.polygons_of(F.col("rings")).alias("parts")).orderBy("objectid").collect()
    return [[[[(p["x"], p["y"]) for p in ring] for ring in part] for part in r["parts"]] for r in found]


def test_rings_nest_whatever_their_order(spark):
    shell, hole, island, pond, other = BOX(0, 0, 10, 10), BOX(1, 1, 9, 9), BOX(2, 2, 8, 8), BOX(3, 3, 4, 4), BOX(20, 0, 30, 10)
    second_hole, touching = BOX(21, 1, 22, 2), [(20.0, 0.0), (25.0, 5.0), (25.0, 0.0)]
    rng = random.Random(3)
    for _ in range(4):
        rings = [shell, hole, island, pond, other, second_hole]
        rng.shuffle(rings)
        got = {tuple(part[0]): sorted(map(tuple, part[1:])) for part in parts_of(polygons(spark, rings))[0]}
        assert got == {tuple(shell): [tuple(hole)], tuple(island): [tuple(pond)], tuple(other): [tuple(second_hole)]}
    # a hole that touches its shell at corners and along nothing else, and one whose corners are all on the shell
    diamond = [(5, 0), (10, 5), (5, 10), (0, 5)]
    assert parts_of(polygons(spark, [diamond, shell]))[0] == [[shell, diamond]]
    assert parts_of(polygons(spark, [touching, other]))[0] == [[other, touching]]
    assert parts_of(polygons(spark, [], [shell]))== [[], [[shell]]]


def test_geojson_keeps_parts_holes_and_islands(spark, tmp_path):
    given = polygons(spark, [BOX(2, 2, 3, 3), BOX(5, 0, 6, 1), BOX(1, 1, 4, 4), BOX(0, 0, 5, 5)], [BOX(0, 0, 1, 1)], [])
    tables.write_geojson(given, str(tmp_path / "out"), "objectid", "area")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    features = {f["properties"]["objectid"]: f["geometry"] for f in json.loads(text)["features"]}
    assert features[1]["type"] == "MultiPolygon" and [len(p) for p in features[1]["coordinates"]] == [1, 1, 2]
    assert features[2] == {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]}
    assert features[3] == {"type": "Polygon", "coordinates": []}
    again = tables.read_geojson(spark, str(tmp_path / "out")).filter("objectid = '1'").withColumn("objectid", F.lit(1))
    assert [[len(r) for r in part] for part in parts_of(again)[0]] == [[5], [5], [5, 5]]
    tables.write_geojson(again, str(tmp_path / "twice"), "objectid", "area")
    twice = tables.read_geojson(spark, str(tmp_path / "twice")).withColumn("objectid", F.lit(1))
    assert parts_of(twice) == parts_of(again)
    assert tables.feature_collection(given, "objectid")["features"][0]["properties"] == {"objectid": 1}


def test_a_cache_that_cannot_be_read_is_not_replaced(spark, tmp_path):
    broken, served = tmp_path / "broken.geojson", tmp_path / "served.geojson"
    broken.write_text("no json at all")
    served.write_text('{"type": "FeatureCollection", "features": [{"properties": {"neighborhood": "a", "precinct": "n"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}]}')
    with pytest.raises(Exception):  # noqa: B017
        tables.read_boundaries(spark, str(broken), url=served.as_uri()).collect()
    assert broken.read_text() == "no json at all"
    new = str(tmp_path / "new")
    assert tables.read_boundaries(spark, new, url=served.as_uri()).count() == 1 and tables.exists(spark, new)


# cells


def star(corners, seed, wide=3.0):
    rng = random.Random(seed)
    return [(wide * rng.uniform(0.4, 1) * math.cos(2 * math.pi * k / corners), wide * rng.uniform(0.4, 1) * math.sin(2 * math.pi * k / corners)) for k in range(corners)]


def all_tests(points, areas):
    """Every point against every edge of every area."""
    whole = points.crossJoin(areas.withColumn("edges", spatial.edges(F.col("rings"))))
    return whole.filter(spatial.is_within(F.col("x"), F.col("y"), F.col("edges")))


@pytest.mark.parametrize("cell,levels", [(0.02, 4), (0.5, 2), (0.3, 0), (7.0, 3)])
def test_cells_give_the_rows_of_the_whole_test(spark, cell, levels):
    areas = polygons(spark, [star(40, 1)], [BOX(0, 0, 1, 1), BOX(0.25, 0.25, 0.75, 0.75)], [BOX(-1, -1, 0, 0), BOX(1, 1, 2, 2)], [star(9, 4, 0.5)]) if cell > 0.1 else polygons(
        spark, [star(40, 1, 0.3)], [BOX(0, 0, 0.1, 0.1), BOX(0.02, 0.02, 0.08, 0.08)], [BOX(-0.1, -0.1, 0, 0), BOX(0.1, 0.1, 0.2, 0.2)]
    )
    width = 3.2 if cell > 0.1 else 0.32
    rng = random.Random(9)
    at = [(rng.uniform(-width, width), rng.uniform(-width, width)) for _ in range(3000)]
    at += [(x * width / 16, y * width / 16) for x in range(-16, 17) for y in range(-16, 17)] + [(0.25, 0.5), (0.5, 0.25), (1.0, 0.5), (0.0, 0.0), (0.02, 0.05)]
    points = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(at)], "id long, x double, y double")
    gridded = points.withColumns({"cell_x": F.floor(F.col("x") / cell), "cell_y": F.floor(F.col("y") / cell)})
    met = gridded.join(spatial.polygon_cells(areas, cell, levels), ["cell_x", "cell_y"])
    inside = F.col("edges").isNull() | spatial.is_within(F.col("x"), F.col("y"), F.col("edges"), F.col("crossed"))
    got = sorted(map(tuple, met.filter(inside).select("id", "objectid").collect()))
    assert got == sorted(map(tuple, all_tests(points, areas).select("id", "objectid").collect()))


def test_few_edges_are_looked_at(spark):
    """Points of a detailed area: most cells need no test, the others few edges."""
    areas = polygons(spark, [[(math.cos(2 * math.pi * k / 720) * 0.4, math.sin(2 * math.pi * k / 720) * 0.4) for k in range(720)]])
    points = spark.range(4000).select("id", (F.rand(1) - 0.5).alias("x"), (F.rand(2) - 0.5).alias("y")).cache()
    points.count()
    gridded = points.withColumns({"cell_x": F.floor(F.col("x") / 0.02), "cell_y": F.floor(F.col("y") / 0.02)})
    cells = spatial.polygon_cells(areas, 0.02)
    tests = gridded.join(cells, ["cell_x", "cell_y"]).agg(F.sum(F.coalesce(F.size("edges"), F.lit(0)))).first()[0]
    in_box = points.filter("abs(x) <= 0.4 AND abs(y) <= 0.4").count()
    assert tests * 100 < in_box * 720  # before, each point in the box met all 720
    assert spatial.containing(points, areas, "x", "y").count() == all_tests(points, areas).count()
    whole = cells.filter("edges IS NULL").count()
    assert whole > 4 * cells.filter("edges IS NOT NULL").count() and cells.groupBy("cell_x", "cell_y").count().filter("count > 1").isEmpty()


def test_cells_join_on_cells_alone(spark):
    areas, points = polygons(spark, [star(20, 1)]), spark.createDataFrame([(1, 0.1, 0.1)], "id long, x double, y double")
    plan = spatial.containing(points, areas, "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# projections


@pytest.mark.parametrize(
    "projection,x,y,longitude,latitude,near",
    [  # published examples of the methods, to a hundredth of their unit
        (projections.system(27700), 577274.99, 69740.50, 0.5, 50.5, 1e-7),
        (projections.LambertConic(projections.CLARKE_1866, 27 + 50 / 60, -99.0, 28 + 23 / 60, 30 + 17 / 60, 2000000 * projections.US_FOOT, 0.0, projections.US_FOOT), 2963503.91, 254759.80, -96.0, 28.5, 1e-7),
        (projections.system(3857), -11169055.58, 2800000.00, -(100 + 20 / 60), 24 + 22 / 60 + 54.433 / 3600, 1e-7),
        (projections.system(32631), 448251.795, 5411932.678, 2.2945, 48.8582, 1e-7),
        (projections.system(32731), 500000.0, 10_000_000.0, 3.0, 0.0, 1e-12),
        (projections.system(2285), 500000 / projections.US_FOOT, 0.0, -(120 + 50 / 60), 47.0, 1e-9),
        (projections.system(32148), 500000.0, 0.0, -(120 + 50 / 60), 47.0, 1e-9),
    ],
)
def test_control_points(spark, projection, x, y, longitude, latitude, near):
    got = spark.createDataFrame([(x, y)], "x double, y double").select(projection.degrees(F.col("x"), F.col("y")).alias("p")).first()["p"]
    assert abs(got["x"] - longitude) < near and abs(got["y"] - latitude) < near


def test_file_coordinates_are_reprojected(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"neighborhood": "a", "precinct": "n"}, "geometry": {"type": "Polygon", "coordinates": [[[448251.795, 5411932.678], [449251.795, 5411932.678], [449251.795, 5412932.678]]]}}
    path = tmp_path / "utm.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::32631"}}, "features": [feature]}))
    p = tables.read_boundaries(spark, str(path)).first()["rings"][0][0]
    assert abs(p["x"] - 2.2945) < 1e-7 and abs(p["y"] - 48.8582) < 1e-7
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    with pytest.raises(ValueError, match="degrees"):
        tables.read_boundaries(spark, str(path))


def test_names_of_systems():
    assert projections.named(None) is projections.named("urn:ogc:def:crs:OGC:1.3:CRS84") is projections.named("EPSG:4326") is None
    assert projections.named("urn:ogc:def:crs:EPSG::2926") == projections.SYSTEMS[2926] == projections.named("EPSG:2285")
    for name in ("local", "EPSG:1234", "urn:ogc:def:crs:EPSG::32661"):
        with pytest.raises(ValueError, match="cannot be reprojected"):
            projections.named(name)
