"""Dimension tables: population, boundaries, crosswalk."""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidara.functions import projections
from incidara.functions.clean import clean_text, to_number
from incidara.operators.schema import require_columns
from incidara.operators.spatial import RINGS, crosswalk, normalise_polygons
from incidara.operators.topology import closed, polygons_of

_FEATURES = "features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_population(spark: SparkSession, path: str, place: str = "dispatch_neighborhood") -> DataFrame:
    """``place, population`` of a CSV file with a header; what is no number is null."""
    raw = require_columns(spark.read.csv(path, header=True), place, "population")
    return raw.select(clean_text(F.col(place)).alias(place), to_number(F.col("population")).alias("population"))


def rings_of(kind, coordinates):
    """Rings of a polygon's or multipolygon's coordinates in JSON."""
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>"))
    return F.transform(F.when(kind == "MultiPolygon", many).otherwise(one), lambda ring: F.transform(ring, point)).cast(RINGS)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that path, in whatever file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def read_geojson(spark: SparkSession, *paths: str) -> DataFrame:
    """Features of the first of ``paths`` that is there: their properties as columns, and ``rings`` in degrees.

    A path that is there but cannot be read is an error.  Coordinates are reprojected from the system that the file names in ``crs``, if any.
    """
    path = next((p for p in paths if exists(spark, p)), None)
    if path is None:
        raise FileNotFoundError(f"none of {paths} is there")
    raw = spark.read.text(path, wholetext=True)
    features = raw.select(F.inline(F.from_json("value", _FEATURES).getField("features"))).filter("geometry IS NOT NULL")
    names = [r["name"] for r in features.select(F.explode(F.map_keys("properties")).alias("name")).distinct().orderBy("name").collect()]  # a file's property names
    rings = rings_of(F.col("geometry.type"), F.col("geometry.coordinates"))
    named = raw.select(F.get_json_object("value", "$.crs.properties.name").alias("crs")).first()  # one file
    projection = projections.named(named["crs"] if named else None)
    if projection is not None:
        rings = F.transform(rings, lambda ring: F.transform(ring, lambda p: projection.degrees(p["x"], p["y"])))
    return features.select(*[F.col("properties")[n].alias(n) for n in names], rings.alias("rings"))


def require_degrees(polygons: DataFrame) -> DataFrame:
    """``polygons``, or an error if a point of their ``rings`` is no longitude and latitude in degrees."""
    point = F.explode(F.flatten("rings")).alias("p")
    outside = polygons.select(point).filter((F.abs("p.x") > 180) | (F.abs("p.y") > 90))
    if not outside.isEmpty():
        raise ValueError("coordinates are not in degrees; name their system in the file's crs, or give longitude and latitude (EPSG:4326)")
    return polygons


def read_boundaries(
    spark: SparkSession, *paths: str, name: str = "mcpp_neighborhood", group: str = "mcpp_precinct", url: str | None = None, timeout: float = 30.0
) -> DataFrame:
    """The first of ``paths`` that is there, else the GeoJSON at ``url``, which is then written to all of ``paths``.

    What is there is never overwritten: a path that cannot be read is an error.
    """
    if url is not None and not any(exists(spark, path) for path in paths):
        with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
            text = answer.read().decode("utf-8")
        for path in paths:
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("error").text(path)
    return normalise_polygons(require_degrees(read_geojson(spark, *paths)), name, group)


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    return crosswalk(spark.read.text(path, wholetext=True))


def feature_json(polygons: DataFrame, *properties: str) -> DataFrame:
    """``feature``: one GeoJSON feature as text for each row, a Polygon or, where its rings make several, a MultiPolygon."""
    ring = lambda r: F.transform(closed(r), lambda p: F.array(p["x"], p["y"]))
    parts = polygons.withColumn("_parts", F.transform(polygons_of(F.col("rings")), lambda part: F.transform(part, ring)))
    geometry = lambda kind, coordinates: F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))
    one = F.coalesce(F.try_element_at("_parts", F.lit(1)), F.array().cast("array<array<array<double>>>"))
    written = F.when(F.size("_parts") > 1, geometry("MultiPolygon", F.col("_parts"))).otherwise(geometry("Polygon", one))
    given = F.to_json(F.struct(*properties)) if properties else F.lit("{}")
    return parts.select(F.concat(F.lit('{"type":"Feature","properties":'), given, F.lit(',"geometry":'), written, F.lit("}")).alias("feature"))


def write_geojson(polygons: DataFrame, path: str, *properties: str) -> None:
    """The polygons as one GeoJSON text below ``path``; for boundary tables, which are small."""
    whole = feature_json(polygons, *properties).agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("features"))
    whole.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "features", F.lit("]}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def feature_collection(polygons: DataFrame, *properties: str) -> dict:
    """The same as an object, for a chart."""
    return {"type": "FeatureCollection", "features": [json.loads(r["feature"]) for r in feature_json(polygons, *properties).toLocalIterator()]}
