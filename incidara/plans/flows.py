"""Catalog queries that write and read: snapshots, refreshes and streams below the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from incidara.operators import dedup, spatial, topology
from incidara.plans import bindings as b
from incidara.plans import catalog, derived
from incidara.plans.catalog import query
from incidara.sources import snapshot, tables
from incidara.streaming import refresh


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` or the context's checkpoint folder; on one machine (master ``local``) without them, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_REFRESHED = f"""{catalog._CALLS}, both_tables AS (
  SELECT row_id, queued, staff, supplier, price, 0 AS source FROM calls WHERE staff <= 30
  UNION ALL SELECT row_id, queued + INTERVAL 1 DAY, staff + 100, supplier, price, 1 FROM calls WHERE staff >= 20
), kept AS (
  SELECT * FROM both_tables QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY source DESC, queued DESC, supplier, staff, price) = 1
)"""
_COLUMNS = ["row_id", "queued", "staff", "supplier", "price"]


def _tables(spark, sf_dir):
    rows = b.calls(spark, sf_dir).select(*_COLUMNS)
    fresh = rows.filter("staff >= 20").withColumns({"queued": F.col("queued") + F.expr("INTERVAL 1 DAY"), "staff": F.col("staff") + 100})
    return rows.filter("staff <= 30"), fresh


@query(f"WITH {catalog._CALLS} SELECT row_id, queued, staff, supplier, price FROM calls")
def snapshot_roundtrip(spark, sf_dir):
    where = shared_folder(spark, "snapshot")
    snapshot.save_snapshot(b.calls(spark, sf_dir).select(*_COLUMNS), where, "1995-01-01")
    return snapshot.load_snapshot(spark, where)[0]


@query(f"""WITH {catalog._CALLS} SELECT row_id, queued, staff, supplier, price FROM calls
QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY queued DESC, supplier, staff, price) = 1""")
def full_refresh(spark, sf_dir):
    where = shared_folder(spark, "snapshot")
    snapshot.full_refresh(where, lambda start: b.calls(spark, sf_dir).select(*_COLUMNS), "1995-01-01", b.CALL_ROLES)
    return snapshot.load_snapshot(spark, where)[0]


@query(f"WITH {_REFRESHED} SELECT row_id, queued, staff FROM kept WHERE queued >= (SELECT max(queued) FROM kept) - INTERVAL 365 DAY")
def incremental_refresh(spark, sf_dir):
    where = shared_folder(spark, "snapshot")
    existing, fresh = _tables(spark, sf_dir)
    snapshot.save_snapshot(existing, where, "1995-01-01")
    snapshot.incremental_refresh(spark, where, lambda start: fresh, b.CALL_ROLES)
    return snapshot.load_snapshot(spark, where)[0].select("row_id", "queued", "staff")


@query(f"""WITH {catalog._CALLS}, one AS (
  SELECT * FROM calls QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY queued DESC, supplier, staff, price) = 1
), last AS (SELECT max(CAST(queued AS DATE)) AS day FROM one), moved AS (
  SELECT row_id FROM one, last WHERE CAST(queued AS DATE) = day - 7 AND staff >= 25
), now AS (
  SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM moved) THEN queued + INTERVAL 2 DAY ELSE queued END AS queued FROM one
)
SELECT CAST(CAST(queued AS DATE) AS VARCHAR) AS day, count(*) AS n_rows, CAST(queued AS DATE) IN (SELECT CAST(queued AS DATE) + k FROM one SEMI JOIN moved USING (row_id), unnest([0, 2]) t(k)) AS written
FROM now WHERE queued >= (SELECT max(queued) FROM now) - INTERVAL 365 DAY GROUP BY ALL""")
def refresh_touched_days(spark, sf_dir):
    """Rows of one day move two days on; which days of the snapshot the refresh writes, and what they have."""
    where = shared_folder(spark, "snapshot")
    rows = b.calls(spark, sf_dir).select(*_COLUMNS)
    snapshot.full_refresh(where, lambda start: rows, "1995-01-01", b.CALL_ROLES)
    snapshot.merge(spark, where, rows.limit(0), b.CALL_ROLES)  # the retention
    now, before = snapshot.load_snapshot(spark, where)
    day = F.col("queued").cast("date")
    last = now.agg(F.max(day).alias("last"))
    moved = now.join(F.broadcast(last), (day == F.date_sub("last", 7)) & (F.col("staff") >= 25)).drop("last")
    snapshot.merge(spark, where, moved.withColumn("queued", F.col("queued") + F.expr("INTERVAL 2 DAYS")), b.CALL_ROLES)
    now, after = snapshot.load_snapshot(spark, where)
    written = [p["day"] for p in after["parts"] if p not in before["parts"]]
    return now.groupBy(day.cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("written", F.col("day").isin(written))


@query(f"""WITH {_REFRESHED}, now AS (SELECT * FROM kept WHERE queued >= (SELECT max(queued) FROM kept) - INTERVAL 365 DAY)
SELECT date_trunc('month', queued)::TIMESTAMP AS period_start, count(DISTINCT split_part(row_id, '-', 1)) AS event_count FROM now GROUP BY 1""")
def derived_volume(spark, sf_dir):
    """Volumes of a refreshed snapshot from bitmaps by day, of which the refresh has changed some."""
    where = shared_folder(spark, "snapshot")
    roles = b.CALL_ROLES
    existing, fresh = (rows.withColumn("event_id", F.split("row_id", "-")[0]) for rows in _tables(spark, sf_dir))
    snapshot.save_snapshot(existing, where, "1995-01-01")
    snapshot.merge(spark, where, existing.limit(0), roles)
    derived.DerivedTables(spark, where, roles).event_days()
    snapshot.merge(spark, where, fresh, roles)
    return derived.DerivedTables(spark, where, roles).volume("month")


@query(f"WITH {_REFRESHED} SELECT row_id, queued, staff FROM kept WHERE queued >= (SELECT max(queued) FROM kept) - INTERVAL 365 DAY")
def stream_upsert(spark, sf_dir):
    where, arriving = shared_folder(spark, "snapshot"), shared_folder(spark, "arriving")
    existing, fresh = _tables(spark, sf_dir)
    snapshot.save_snapshot(existing, where, "1995-01-01")
    fresh.write.parquet(arriving)
    stream = spark.readStream.schema(fresh.schema).parquet(arriving)
    refresh.upsert_stream(stream, where, shared_folder(spark, "progress"), b.CALL_ROLES).awaitTermination()
    return snapshot.load_snapshot(spark, where)[0].select("row_id", "queued", "staff")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS dispatch_records FROM events GROUP BY 1")
def stream_daily_counts(spark, sf_dir):
    name = f"daily_counts_{uuid.uuid4().hex}"
    events, arriving = b.table(spark, sf_dir, "events"), shared_folder(spark, "arriving")
    events.write.parquet(arriving)
    stream = spark.readStream.schema(events.schema).parquet(arriving)
    counts = refresh.daily_counts(stream, b.EVENT_ROLES)
    writer = counts.writeStream.format("memory").queryName(name).outputMode("complete")  # a row for each day
    writer.option("checkpointLocation", shared_folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("date").cast("string").alias("date"), "dispatch_records")


@query(f"""WITH {catalog._LABEL_BOXES}, corners AS (
  SELECT *, unnest([x0, x1, x1, x0, x0]) AS x, unnest([y0, y0, y1, y1, y0]) AS y, unnest(range(1, 6)) AS corner FROM ring_boxes
) SELECT label::BIGINT AS objectid, 'label ' || label AS area, part::INT AS part, ring::INT AS ring, corner::INT AS corner, x, y FROM corners""")
def geojson_roundtrip(spark, sf_dir):
    """Areas with parts, holes and islands, written and read; every corner."""
    where = shared_folder(spark, "areas")
    tables.write_geojson(b.label_areas(spark, sf_dir), where, "objectid", "area", "area_group")
    read = spatial.normalise_polygons(tables.read_geojson(spark, where), "area", "area_group")
    parts = read.select("objectid", "area", F.posexplode(topology.polygons_of(F.col("rings"))).alias("part", "rings"))
    rings = parts.select("objectid", "area", F.col("part") + 1, F.posexplode("rings").alias("ring", "points")).toDF("objectid", "area", "part", "ring", "points")
    corners = rings.select("objectid", "area", "part", (F.col("ring") + 1).alias("ring"), F.posexplode("points").alias("corner", "p"))
    return corners.select("objectid", "area", "part", "ring", (F.col("corner") + 1).alias("corner"), "p.x", "p.y")


@query(f"""WITH {catalog._POINTS}, pairs AS (SELECT * FROM (VALUES ('alpha', 'north shore'), ('beta', 'river east'), ('beta', 'old mill'), ('unknown', '')) t(label, boundary)),
labelled AS (SELECT *, CASE WHEN vec_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS label FROM located)
SELECT label, count(*) AS evaluated_events, count(boundary) AS correctly_labeled, count(boundary) / count(*) * 100 AS pct_correctly_labeled
FROM labelled LEFT JOIN pairs ON pairs.label = labelled.label AND boundary = area GROUP BY labelled.label""".replace("SELECT label, count", "SELECT labelled.label AS label, count"))
def crosswalk_accuracy(spark, sf_dir):
    labelled = catalog._located(spark, sf_dir).withColumn("label", F.when(F.col("vec_id") % 2 == 0, "alpha").otherwise("beta"))
    return spatial.crosswalk_accuracy(labelled, spatial.crosswalk(spark.createDataFrame([(catalog._CROSSWALK,)], "value string")), "label", "area")


@query(f"""WITH {catalog._CALLS} SELECT event_id, row_id, queued, staff FROM calls WHERE queued >= TIMESTAMP '1996-01-01' AND queued < TIMESTAMP '1996-02-01'
AND lat IS NOT NULL AND staff BETWEEN 10 AND 20 AND category IN ('standard', 'promo') AND NOT place IN ('NATION_1', 'NATION_2')""")
def filtered_scan(spark, sf_dir):
    rows = b.calls(spark, sf_dir).dropna(subset=["lat"])
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("1996-01-01", "1996-02-01"))
    chosen = rows.filter((F.col("queued") >= start) & (F.col("queued") < end) & F.col("staff").between(10, 20) & F.col("category").isin("standard", "promo") & ~F.col("place").isin("NATION_1", "NATION_2"))
    return chosen.select("event_id", "row_id", "queued", "staff")


@query("SELECT * FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) WHERE n >= 10")
def grouped_having(spark, sf_dir):
    return b.table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10")


@query("""SELECT event_id, ts, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""")
def latest_event_per_user(spark, sf_dir):
    return dedup.latest_per_key(b.table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "ts", "user_id")
