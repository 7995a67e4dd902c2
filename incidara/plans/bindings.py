"""Role bindings of the test tables: order lines as calls, user events, vectors as points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidara.functions.clean import clean_text
from incidara.operators.spatial import RINGS
from incidara.roles import BinSpec, Roles

#: Order lines: an order is an event, a line of it a dispatched unit.
CALL_ROLES = Roles(
    event_id="event_id", row_id="row_id", event_time="queued", arrival_time="arrived", category="category", place="place",
    priority="priority", staff="staff", lat="lat", lon="lon", ties=("supplier", "staff", "price"),
)
#: User events: a user and day is what happens, each event a record of it.
EVENT_ROLES = Roles(event_id="user_id", row_id="event_id", event_time="ts", category="event_type")
#: Vectors: the first two components are a place.
POINT_ROLES = Roles(event_id="vec_id", row_id="vec_id", event_time="queued", lat="y", lon="x")

CALL_BINS = BinSpec(
    bins={"violent/person crime": ("large", "economy"), "drug-related": ("promo",), "property/nonviolent": ("standard",), "lower public-safety urgency": ("small",)},
    targets=("property/nonviolent", "drug-related", "violent/person crime"),
)
EVENT_BINS = BinSpec(bins={"purchases": ("purchase", "signup"), "errors": ("error",)}, targets=("purchases", "errors"))
#: Response times of the order lines are in days, so the band is a year.
CALL_MINUTES = 365 * 1440
CALL_MIN_EVENTS = 10

#: objectid, area, group, rings of x and y.  One area is concave, one has a hole, two overlap, one has two polygons.
POLYGONS = [
    (1, "north shore", "north", [[(-0.4, 0.0), (-0.05, 0.0), (-0.05, 0.45), (-0.4, 0.45)]]),
    (2, "harbor bend", "north", [[(-0.05, 0.0), (0.4, 0.0), (0.4, 0.4), (0.2, 0.4), (0.2, 0.2), (-0.05, 0.2)]]),
    (3, "old mill", "south", [[(-0.4, -0.45), (0.0, -0.45), (0.0, 0.0), (-0.4, 0.0)], [(-0.25, -0.3), (-0.15, -0.3), (-0.15, -0.15), (-0.25, -0.15)]]),
    (4, "river east", "south", [[(-0.1, -0.45), (0.4, -0.45), (0.4, -0.05), (-0.1, -0.05)]]),
    (5, "north shore", "north", [[(-0.05, 0.2), (0.2, 0.2), (0.2, 0.45), (-0.05, 0.45)]]),
]
AREA_PEOPLE = [("north shore", 1200), ("harbor bend", 800), ("old mill", 0)]
POINT_BOX = {"lat": (-0.2, 0.2), "lon": (-0.15, 0.25)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order, part and nation, dealt by ``event_id``: what groups or orders rows by event needs no further shuffle."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customers, nations, parts = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")
    placed = orders.join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    placed = placed.join(F.broadcast(nations.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))  # a table of fixed size
    typed = lines.join(parts.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    joined = typed.join(placed, F.col("l_orderkey").cast("string") == F.col("o_orderkey").cast("string"))
    return joined.select(
        F.col("l_orderkey").cast("string").alias("event_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("row_id"),
        F.col("o_orderdate").alias("queued"),
        F.col("l_shipdate").alias("arrived"),
        clean_text(F.col("p_type")).alias("category"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
        F.col("n_name").alias("place"),
        F.col("l_quantity").alias("staff"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("lat"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("lon"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_extendedprice").alias("price"),
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return people.groupBy(F.col("n_name").alias("place")).agg(F.count(F.lit(1)).alias("population"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a time, a bin and a place: component 0 is x, component 1 is y."""
    vectors = table(spark, sf_dir, "embeddings")
    day = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(vec_id % 400 AS INT))")
    value = lambda k: F.col("embedding")[k].cast("double")
    return vectors.select(
        "vec_id", value(0).alias("x"), value(1).alias("y"), day.alias("queued"),
        (day + F.expr("make_dt_interval(0, 0, CAST(label AS INT) * 7 + 3)")).alias("arrived"),
        F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("event_importance_bin"),
    )


def polygons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLYGONS, f"objectid long, area string, area_group string, rings {RINGS}")


def area_people(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AREA_PEOPLE, "area string, population long")


def label_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label of the vectors an area of four rings in no order: an island, a second part, a hole, a shell.

    The shell is the box of the label's vectors, the hole its middle half, the island its middle eighth, the second part the box moved by 2.
    """
    box = points(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    box = box.groupBy("label").agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "low"), (F.max, "high"))])
    box = box.filter("low_x < high_x AND low_y < high_y")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def ring(share_low: float, share_high: float, move: float = 0.0):
        at = lambda c, share: F.col(f"low_{c}") + (F.col(f"high_{c}") - F.col(f"low_{c}")) * F.lit(share) + F.lit(move if c == "x" else 0.0)
        (x0, x1), (y0, y1) = [(at(c, share_low), at(c, share_high)) for c in ("x", "y")]
        return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))

    rings = F.array(ring(0.4375, 0.5625), ring(0.0, 1.0, 2.0), ring(0.25, 0.75), ring(0.0, 1.0))
    name = F.concat(F.lit("label "), F.col("label").cast("string"))
    return box.select(F.col("label").cast("long").alias("objectid"), name.alias("area"), F.lit("all").alias("area_group"), rings.cast(RINGS).alias("rings"))
