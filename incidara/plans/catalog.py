"""Every query of the call analytics on the test tables, and the SQL that says what it returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidara.functions import calendar, clean, projections
from incidara.functions.bins import BIN_COLUMN, importance_bin
from incidara.functions.ranks import percent_rank_of_ties
from incidara.operators import choropleth, daily, dedup, medians, response, scatter, schema, spatial, summary, volume
from incidara.plans import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common parts of the SQL.
_CALLS = """calls AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS event_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS row_id,
         o_orderdate AS queued, l_shipdate AS arrived, lower(trim(p_type)) AS category,
         CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority, n_name AS place, l_quantity AS staff,
         nullif(l_discount, 0.0) AS lat, nullif(l_tax, 0.0) AS lon, l_suppkey AS supplier, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def _case(column: str, spec: b.BinSpec) -> str:
    whens = " ".join(f"WHEN {column} IN ({', '.join(repr(c) for c in categories)}) THEN '{name}'" for name, categories in spec.bins.items())
    return f"CASE WHEN {column} IS NULL THEN '{spec.unknown}' {whens} ELSE '{spec.other}' END"


_RESPONSE = f"""{_CALLS}, events AS (
  SELECT event_id, min(queued) AS queued_time, min(arrived) AS first_arrival_time,
         first(category ORDER BY queued, row_id, supplier, staff, price) AS category,
         first(priority ORDER BY queued, row_id, supplier, staff, price) AS priority,
         first(place ORDER BY queued, row_id, supplier, staff, price) AS place,
         count(DISTINCT row_id) AS dispatch_records
  FROM calls GROUP BY event_id
), response AS (
  SELECT *, date_diff('microsecond', queued_time, first_arrival_time) / 6e7::DOUBLE AS response_time_minutes,
         {_case("category", b.CALL_BINS)} AS event_importance_bin
  FROM events
  WHERE date_diff('microsecond', queued_time, first_arrival_time) / 6e7::DOUBLE BETWEEN 0 AND {b.CALL_MINUTES}
), years AS (
  SELECT CASE WHEN d > 0 THEN d / 365.25::DOUBLE ELSE 1.0::DOUBLE END AS years_observed
  FROM (SELECT floor(date_diff('microsecond', min(queued_time), max(queued_time)) / 86400000000::DOUBLE) AS d FROM response)
)"""
_TARGETS = ", ".join(f"'{t}'" for t in b.CALL_BINS.targets)
_RATES = f"""{_RESPONSE}, people AS (
  SELECT n_name AS place, count(*) AS population FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
), rates AS (
  SELECT g.place, event_importance_bin, unique_call_events, median_response_minutes, mean_response_minutes, population,
         unique_call_events / years_observed / population * 1000 AS annual_events_per_1000
  FROM (SELECT place, event_importance_bin, count(DISTINCT event_id) AS unique_call_events,
               median(response_time_minutes) AS median_response_minutes, round(avg(response_time_minutes), 6) AS mean_response_minutes
        FROM response WHERE event_importance_bin IN ({_TARGETS}) AND place NOT IN ('unknown', '-', '', 'nan')
        GROUP BY place, event_importance_bin HAVING count(DISTINCT event_id) >= {b.CALL_MIN_EVENTS}) g
       JOIN people USING (place), years
  WHERE population > 0
)"""
_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE) / count({0}) OVER ()"
_SCORES = f"""{_RATES}, ranked AS (
  SELECT *, {_RANK.format("annual_events_per_1000")} AS volume_rank, {_RANK.format("median_response_minutes")} AS response_rank FROM rates
)"""


def _edge_rows() -> str:
    rows = []
    for number, area, group, rings in b.POLYGONS:
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                rows.append(f"({number}, '{area}', '{group}', {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)")
    return ", ".join(rows)


_SIDE = "(x - x1) * (y2 - y1) - (x2 - x1) * (y - y1)"
_POINTS = f"""points AS (
  SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
         TIMESTAMP '2024-01-01' + to_days(CAST(vec_id % 400 AS INTEGER)) AS queued,
         TIMESTAMP '2024-01-01' + to_days(CAST(vec_id % 400 AS INTEGER)) + to_minutes(label * 7 + 3) AS arrived,
         CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS event_importance_bin
  FROM embeddings
), edges AS (
  SELECT * FROM (VALUES {_edge_rows()}) t(objectid, area, area_group, x1, y1, x2, y2)
), inside AS (
  SELECT vec_id, objectid, area, area_group FROM points, edges GROUP BY vec_id, objectid, area, area_group
  HAVING sum(CASE WHEN (y1 > y) <> (y2 > y) AND (CASE WHEN y2 > y1 THEN {_SIDE} ELSE -({_SIDE}) END) < 0 THEN 1 ELSE 0 END) % 2 = 1
     AND sum(CASE WHEN {_SIDE} = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) = 0
), located AS (
  SELECT p.*, i.area, i.area_group FROM points p LEFT JOIN
    (SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY objectid) = 1) i USING (vec_id)
)"""
_AREAS = f"""{_POINTS}, polygons AS (SELECT DISTINCT objectid, area, area_group FROM edges),
people AS (SELECT * FROM (VALUES {", ".join(f"('{a}', {n})" for a, n in b.AREA_PEOPLE)}) t(area, population)),
year AS (
  SELECT *, date_diff('microsecond', queued, arrived) / 6e7::DOUBLE AS minutes FROM located
  WHERE CAST(queued AS DATE) >= (SELECT max(CAST(queued AS DATE)) - 364 FROM located)
), counts AS (
  SELECT area, count(DISTINCT vec_id) AS n FROM year WHERE event_importance_bin = 'even' GROUP BY area
), medians AS (
  SELECT area, median(minutes) AS m FROM year WHERE event_importance_bin = 'even' AND minutes BETWEEN 0 AND 1440 GROUP BY area
), map AS (
  SELECT objectid, area, area_group, population::BIGINT AS population, coalesce(n, 0)::BIGINT AS past_year_unique_events, m AS selected_median_response_minutes,
         CASE WHEN population > 0 THEN coalesce(n, 0) / population * 1000 END::DOUBLE AS past_year_unique_events_per_1000
  FROM polygons LEFT JOIN people USING (area) LEFT JOIN counts USING (area) LEFT JOIN medians USING (area)
)"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


# summaries


@query(f"""WITH {_CALLS} SELECT count(*) AS total_calls, count(DISTINCT event_id) AS unique_events, min(queued) AS date_min, max(queued) AS date_max,
count(DISTINCT category) AS unique_event_groups, count(DISTINCT place) AS unique_neighborhoods, median(priority)::DOUBLE AS median_priority,
median(staff)::DOUBLE AS median_officers, count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS mappable_records FROM calls""")
def summary_scalar(spark, sf_dir):
    return summary.summary(b.calls(spark, sf_dir), b.CALL_ROLES)


@query(f"""WITH {_CALLS}, long AS (SELECT 'category' AS dimension, category AS value FROM calls UNION ALL SELECT 'priority', CAST(priority AS VARCHAR) FROM calls
UNION ALL SELECT 'place', place FROM calls) SELECT dimension, value, count(*) AS count FROM long WHERE value IS NOT NULL GROUP BY dimension, value""")
def summary_value_counts(spark, sf_dir):
    return summary.all_value_counts(b.calls(spark, sf_dir), "category", "priority", "place")


@query(f"""WITH {_CALLS} SELECT * FROM (SELECT 'lat' AS column_name, count(*) FILTER (lat IS NULL) AS missing_values FROM calls UNION ALL
SELECT 'lon', count(*) FILTER (lon IS NULL) FROM calls UNION ALL SELECT 'place', count(*) FILTER (place IS NULL) FROM calls)""")
def null_counts(spark, sf_dir):
    return summary.null_counts(b.calls(spark, sf_dir).select("lat", "lon", "place"))


@query(f"WITH {_CALLS} SELECT CAST(date_trunc('month', queued) AS TIMESTAMP) AS month, count(*) AS count FROM calls GROUP BY 1")
def monthly_counts(spark, sf_dir):
    return summary.monthly_counts(b.calls(spark, sf_dir), "queued")


@query("""SELECT CAST(h.range AS INTEGER) AS hour, coalesce(n, 0)::BIGINT AS count FROM range(24) h LEFT JOIN
(SELECT hour(ts) AS hh, count(*) AS n FROM events GROUP BY 1) ON hh = h.range""")
def hourly_profile(spark, sf_dir):
    return summary.hourly_profile(b.table(spark, sf_dir, "events"), "ts")


@query(f"WITH {_CALLS} SELECT category, count(*) AS count FROM calls GROUP BY category ORDER BY count DESC, category LIMIT 4")
def top_categories(spark, sf_dir):
    return summary.top_values(b.calls(spark, sf_dir), "category", 4)


@query(f"WITH {_CALLS} SELECT priority, count(*) AS count FROM calls WHERE priority IS NOT NULL GROUP BY priority")
def priority_histogram(spark, sf_dir):
    return summary.priority_histogram(b.calls(spark, sf_dir), "priority")


@query(f"""WITH {_CALLS} SELECT event_id, row_id, queued, category, priority, place, lat, lon FROM calls WHERE lat IS NOT NULL AND lon IS NOT NULL
ORDER BY queued DESC, row_id, supplier, staff, price LIMIT 40""")
def recent_points_topk(spark, sf_dir):
    columns = ["event_id", "row_id", "queued", "category", "priority", "place", "lat", "lon"]
    return summary.recent_points(b.calls(spark, sf_dir), b.CALL_ROLES, columns, 40)


@query(f"WITH {_CALLS} SELECT place, count(*) AS call_count, count(DISTINCT event_id) AS unique_events FROM calls WHERE place IS NOT NULL GROUP BY place")
def place_counts(spark, sf_dir):
    return summary.place_counts(b.calls(spark, sf_dir), b.CALL_ROLES)


# volumes

_AXIS = """(SELECT unnest(generate_series(date_trunc('{0}', {1}), date_trunc('{0}', {2}), INTERVAL 1 {0}))::TIMESTAMP AS period_start)"""


@query(f"""WITH {_CALLS}, axis AS (SELECT unnest(generate_series(date_trunc('month', min(queued))::TIMESTAMP, date_trunc('month', max(queued))::TIMESTAMP, INTERVAL 1 MONTH)) AS period_start FROM calls),
counted AS (SELECT date_trunc('month', queued)::TIMESTAMP AS period_start, count(DISTINCT event_id) AS n FROM calls GROUP BY 1)
SELECT period_start, coalesce(n, 0)::BIGINT AS event_count FROM axis LEFT JOIN counted USING (period_start)""")
def volume_month(spark, sf_dir):
    return volume.period_volume(b.calls(spark, sf_dir), b.CALL_ROLES)


@query(f"""WITH {_CALLS}, axis AS (SELECT unnest(generate_series(date_trunc('week', min(queued))::TIMESTAMP, date_trunc('week', max(queued))::TIMESTAMP, INTERVAL 7 DAY)) AS period_start FROM calls),
counted AS (SELECT date_trunc('week', queued)::TIMESTAMP AS period_start, count(DISTINCT event_id) AS n FROM calls GROUP BY 1)
SELECT period_start, isoyear(period_start)::INT AS year, weekofyear(period_start)::INT AS week_of_year, coalesce(n, 0)::BIGINT AS event_count FROM axis LEFT JOIN counted USING (period_start)""")
def volume_week_iso(spark, sf_dir):
    return volume.period_volume(b.calls(spark, sf_dir), b.CALL_ROLES, "week")


@query(f"""WITH {_CALLS} SELECT date_trunc('month', queued)::TIMESTAMP AS period_start, coalesce(category, 'unknown') AS category, count(DISTINCT event_id) AS event_count
FROM calls GROUP BY 1, 2""")
def volume_month_by_category(spark, sf_dir):
    return volume.period_volume(b.calls(spark, sf_dir), b.CALL_ROLES, "month", "category")


@query(f"""WITH {_CALLS} SELECT date_trunc('week', queued)::TIMESTAMP AS period_start, isoyear(queued)::INT AS year, weekofyear(queued)::INT AS week_of_year, category,
count(DISTINCT event_id) AS event_count FROM calls GROUP BY ALL""")
def volume_week_by_category(spark, sf_dir):
    return volume.period_volume(b.calls(spark, sf_dir), b.CALL_ROLES, "week", "category")


@query(f"""WITH {_CALLS}, axis AS (SELECT unnest(generate_series(TIMESTAMP '1996-02-01', TIMESTAMP '1996-05-01', INTERVAL 1 MONTH)) AS period_start),
counted AS (SELECT date_trunc('month', queued)::TIMESTAMP AS period_start, count(DISTINCT event_id) AS n FROM calls
WHERE queued >= TIMESTAMP '1996-02-10' AND queued < TIMESTAMP '1996-05-20' GROUP BY 1)
SELECT period_start, coalesce(n, 0)::BIGINT AS event_count FROM axis LEFT JOIN counted USING (period_start)""")
def volume_clipped_window(spark, sf_dir):
    return volume.period_volume(b.calls(spark, sf_dir), b.CALL_ROLES, "month", None, "1996-02-10", "1996-05-20")


@query(f"WITH {_CALLS} SELECT min(queued) AS min_time, max(queued) AS max_time FROM calls WHERE event_id IS NOT NULL")
def time_bounds(spark, sf_dir):
    return volume.time_bounds(b.calls(spark, sf_dir), b.CALL_ROLES)


@query(f"""WITH {_CALLS} SELECT DISTINCT event_id, category FROM calls WHERE queued >= TIMESTAMP '1996-01-01' AND queued < TIMESTAMP '1996-03-01'
ORDER BY event_id, category LIMIT 100 OFFSET 50""")
def distinct_paged(spark, sf_dir):
    return volume.distinct_events(b.calls(spark, sf_dir), b.CALL_ROLES, "1996-01-01", "1996-03-01", "category", 100, 50)


@query("SELECT l_returnflag, l_linestatus, median(l_extendedprice)::DOUBLE AS median_price, median(l_quantity)::DOUBLE AS median_quantity FROM lineitem GROUP BY ALL")
def grouped_medians(spark, sf_dir):
    """Two medians of few groups with very many values, and with very many of each value."""
    lines, keys = b.table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]
    return medians.grouped_median(lines, keys, "l_extendedprice", "median_price").join(medians.grouped_median(lines, keys, "l_quantity", "median_quantity"), keys)


# daily series


def _binned_events(spark, sf_dir):
    return b.table(spark, sf_dir, "events").withColumn(BIN_COLUMN, importance_bin(F.col("event_type"), b.EVENT_BINS))


_WINDOW = """bounds AS (
  SELECT min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last FROM events WHERE user_id IS NOT NULL
), win AS (
  SELECT first, last, greatest(first + 1, last - 364) AS plot_start FROM bounds
)"""


@query(f"""WITH {_WINDOW}, axis AS (SELECT CAST(unnest(generate_series(plot_start, last, INTERVAL 1 DAY)) AS DATE) AS date FROM win),
counted AS (SELECT CAST(ts AS DATE) AS date, count(DISTINCT user_id) AS u, count(*) AS n FROM events WHERE event_type IN ('purchase', 'signup', 'error') AND user_id IS NOT NULL GROUP BY 1),
series AS (SELECT date, coalesce(u, 0)::BIGINT AS unique_call_events, coalesce(n, 0)::BIGINT AS dispatch_records FROM axis LEFT JOIN counted USING (date))
SELECT CAST(date AS VARCHAR) AS date, unique_call_events, dispatch_records, CASE WHEN count(*) OVER w = 7 THEN avg(unique_call_events) OVER w END AS rolling_7_day_avg FROM series
WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def daily_series_7d(spark, sf_dir):
    series = daily.daily_series(_binned_events(spark, sf_dir), b.EVENT_ROLES, b.EVENT_BINS.targets)
    return series.withColumn("date", F.col("date").cast("string"))


@query(f"""WITH {_WINDOW} SELECT CAST(COLUMNS(*) AS VARCHAR) FROM (SELECT first AS earliest_available, last AS latest_available, first + 1 AS earliest_complete,
plot_start, last AS plot_end, greatest(last - 29, plot_start) AS view_start FROM win)""")
def daily_window_bounds(spark, sf_dir):
    window = daily.daily_window(b.table(spark, sf_dir, "events"), b.EVENT_ROLES)
    return window.select(*[F.col(c).cast("string").alias(c) for c in window.columns])


# latest rows, upsert, retention


@query(f"""WITH {_CALLS} SELECT event_id, row_id, queued, staff FROM calls QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY queued DESC, row_id, supplier, staff, price) = 1""")
def latest_per_event(spark, sf_dir):
    r = b.CALL_ROLES
    return dedup.latest_per_key(b.calls(spark, sf_dir), r.event_id, r.event_time, r.row_id, *r.ties).select("event_id", "row_id", "queued", "staff")


_UPSERT = f"""{_CALLS}, both_tables AS (
  SELECT row_id, queued, staff, supplier, price, 0 AS source FROM calls WHERE staff <= 30
  UNION ALL SELECT row_id, queued + INTERVAL 1 DAY, staff + 100, supplier, price, 1 FROM calls WHERE staff >= 20
), kept AS (
  SELECT * FROM both_tables QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY source DESC, supplier, staff, price) = 1
)"""


def _upserted(spark, sf_dir):
    calls = b.calls(spark, sf_dir).select("row_id", "queued", "staff", "supplier", "price")
    fresh = calls.filter("staff >= 20").withColumns({"queued": F.col("queued") + F.expr("INTERVAL 1 DAY"), "staff": F.col("staff") + 100})
    return dedup.upsert_keep_last(calls.filter("staff <= 30"), fresh, "row_id", "supplier", "staff", "price")


@query(f"WITH {_UPSERT} SELECT row_id, queued, staff FROM kept")
def upsert_keep_last(spark, sf_dir):
    return _upserted(spark, sf_dir).select("row_id", "queued", "staff")


@query(f"WITH {_UPSERT} SELECT row_id, queued, staff FROM kept WHERE queued >= (SELECT max(queued) FROM kept) - INTERVAL 365 DAY")
def rolling_retention(spark, sf_dir):
    return dedup.retain(_upserted(spark, sf_dir), "queued", 365).select("row_id", "queued", "staff")


# response


def _response(spark, sf_dir):
    return response.event_response(b.calls(spark, sf_dir), b.CALL_ROLES, b.CALL_BINS, b.CALL_MINUTES)


@query(f"WITH {_RESPONSE} SELECT * FROM response")
def response_rollup(spark, sf_dir):
    return _response(spark, sf_dir)


@query(f"""WITH {_CALLS}, latest AS (SELECT * FROM calls QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY queued DESC, row_id, supplier, staff, price) = 1)
SELECT event_id, row_id, date_diff('microsecond', queued, arrived) / 6e7::DOUBLE AS response_time_minutes FROM latest
WHERE date_diff('microsecond', queued, arrived) / 6e7::DOUBLE BETWEEN 0 AND {b.CALL_MINUTES}""")
def latest_row_response(spark, sf_dir):
    r = b.CALL_ROLES
    latest = dedup.latest_per_key(b.calls(spark, sf_dir), r.event_id, r.event_time, r.row_id, *r.ties)
    return response.latest_row_response(latest, r, b.CALL_MINUTES).select("event_id", "row_id", "response_time_minutes")


@query(f"WITH {_RESPONSE} SELECT * FROM years")
def years_observed(spark, sf_dir):
    return response.years_observed(_response(spark, sf_dir))


def _rates(spark, sf_dir):
    found = scatter.volume_response(_response(spark, sf_dir), b.population(spark, sf_dir), b.CALL_ROLES, b.CALL_BINS.targets, b.CALL_MIN_EVENTS)
    return found.withColumn("mean_response_minutes", F.round("mean_response_minutes", 6))


@query(f"WITH {_RATES} SELECT * FROM rates")
def scatter_rates(spark, sf_dir):
    return _rates(spark, sf_dir)


@query(f"""WITH {_SCORES} SELECT place, event_importance_bin, volume_rank, response_rank, volume_rank * response_rank AS concern_score,
10 + 40 * (volume_rank * response_rank) AS marker_size FROM ranked""")
def concern_score(spark, sf_dir):
    return scatter.concern_score(_rates(spark, sf_dir)).select("place", BIN_COLUMN, "volume_rank", "response_rank", "concern_score", "marker_size")


@query(f"""WITH {_RATES} SELECT median(annual_events_per_1000) AS volume_median, min(annual_events_per_1000) AS volume_min, max(annual_events_per_1000) AS volume_max,
median(median_response_minutes) AS response_median, min(median_response_minutes) AS response_min, max(median_response_minutes) AS response_max FROM rates""")
def scatter_guides(spark, sf_dir):
    return scatter.guide_lines(_rates(spark, sf_dir))


@query(f"""WITH {_CALLS}, counted AS (SELECT place, count(DISTINCT category || priority) AS v FROM calls GROUP BY place)
SELECT place, v, {_RANK.format("v")} AS pct_rank FROM counted""")
def pct_rank_avg_ties(spark, sf_dir):
    counted = b.calls(spark, sf_dir).groupBy("place").agg(F.countDistinct("category", "priority").alias("v"))
    return counted.withColumn("pct_rank", percent_rank_of_ties(F.col("v")))


# columns


@query(f"WITH {_CALLS} SELECT category, {_case('category', b.CALL_BINS)} AS event_importance_bin, count(*) AS count FROM calls GROUP BY 1, 2")
def bin_assignment(spark, sf_dir):
    binned = b.calls(spark, sf_dir).withColumn(BIN_COLUMN, importance_bin(F.col("category"), b.CALL_BINS))
    return binned.groupBy("category", BIN_COLUMN).agg(F.count(F.lit(1)).alias("count"))


@query("""SELECT c_custkey, lower(c_mktsegment) || '-' || c_custkey AS cleaned FROM customer""")
def text_clean(spark, sf_dir):
    raw = F.concat(F.lit("\t "), F.col("c_mktsegment"), F.lit("-"), F.col("c_custkey").cast("string"), F.lit(" \n"))
    return b.table(spark, sf_dir, "customer").select("c_custkey", clean.clean_text(raw).alias("cleaned"))


@query("""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_name || '/' || p_brand || ' 3rd'), '[[:alpha:]]+|[^[:alpha:]]+'),
lambda x: upper(x[1]) || x[2:]), '') AS titled FROM part""")
def title_case(spark, sf_dir):
    raw = F.concat("p_name", F.lit("/"), "p_brand", F.lit(" 3rd"))
    return b.table(spark, sf_dir, "part").select("p_partkey", clean.title_case(raw).alias("titled"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN value END AS mixed FROM events""")
def numeric_coerce(spark, sf_dir):
    mixed = F.when(F.col("user_id") % 3 == 0, "nan").when(F.col("user_id") % 3 == 1, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).otherwise("12d")
    rows = b.table(spark, sf_dir, "events")
    return rows.select("event_id", clean.to_number(F.get_json_object("props", "$.k")).alias("k"), clean.to_number(mixed).alias("mixed"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS read_time FROM orders""")
def time_coerce(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 4 == 0, F.lit("junk")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    return b.table(spark, sf_dir, "orders").select("o_orderkey", clean.to_time(text).alias("read_time"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS cad_event_number, o_orderdate AS cad_event_original_time_queued, lower(o_orderpriority) AS call_type,
o_totalprice AS priority, CAST(NULL AS DOUBLE) AS dispatch_latitude FROM orders""")
def schema_conform(spark, sf_dir):
    raw = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cad_event_number"), F.col("o_orderdate").alias("cad_event_original_time_queued"),
        F.concat(F.lit(" "), "o_orderpriority").alias("call_type"), F.col("o_totalprice").alias("priority"), F.lit(1).alias("surplus"),
    )
    return schema.conform(raw).select("cad_event_number", "cad_event_original_time_queued", "call_type", "priority", "dispatch_latitude")


@query("""SELECT * FROM (SELECT 'event_id' AS column_name, count(event_id) AS non_null, count(*) - count(event_id) AS nulls FROM events UNION ALL
SELECT 'props', count(props), count(*) - count(props) FROM events)""")
def schema_probe(spark, sf_dir):
    return schema.probe(b.table(spark, sf_dir, "events").select("event_id", "props")).select("column_name", "non_null", "nulls")


@query("SELECT key, count(*) AS records FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def record_keys(spark, sf_dir):
    return schema.record_keys(b.table(spark, sf_dir, "events"), "props")


# places


@query(f"""WITH {_POINTS} SELECT vec_id, x, y FROM points WHERE y BETWEEN {b.POINT_BOX["lat"][0]} AND {b.POINT_BOX["lat"][1]}
AND x BETWEEN {b.POINT_BOX["lon"][0]} AND {b.POINT_BOX["lon"][1]}""")
def bbox_filter(spark, sf_dir):
    return spatial.in_box(b.points(spark, sf_dir), b.POINT_ROLES, b.POINT_BOX).select("vec_id", "x", "y")


@query(f"WITH {_POINTS} SELECT vec_id, objectid, area FROM inside")
def point_in_polygon(spark, sf_dir):
    return spatial.containing(b.points(spark, sf_dir), b.polygons(spark), "x", "y").select("vec_id", F.col("objectid").cast("int").alias("objectid"), "area")


def _located(spark, sf_dir):
    points = b.points(spark, sf_dir)
    found = spatial.lookup(points, b.polygons(spark), "vec_id", "x", "y", "area", "area_group")
    return points.join(found, "vec_id", "left")


@query(f"WITH {_POINTS} SELECT vec_id, x, y, area, area_group FROM located")
def lookup_enrich(spark, sf_dir):
    return _located(spark, sf_dir).select("vec_id", "x", "y", "area", "area_group")


@query(f"WITH {_POINTS} SELECT vec_id, area FROM located")
def lookup_extend(spark, sf_dir):
    points, polygons = b.points(spark, sf_dir), b.polygons(spark)
    stored = spatial.lookup(points.filter("y > 0"), polygons, "vec_id", "x", "y", "area")
    return spatial.extend_lookup(stored, points, polygons, "vec_id", "x", "y", "area")


def _areas(spark, sf_dir):
    return choropleth.rates(_located(spark, sf_dir), b.polygons(spark), b.area_people(spark), b.POINT_ROLES.bind(arrival_time="arrived"), ["even"], "area")


@query(f"WITH {_AREAS} SELECT * FROM map")
def choropleth_rates(spark, sf_dir):
    return _areas(spark, sf_dir).drop("rings").withColumn("objectid", F.col("objectid").cast("int"))


@query(f"""WITH {_AREAS}, figures AS (SELECT area, max(population) AS p, max(past_year_unique_events) AS n, max(past_year_unique_events_per_1000) AS r,
max(selected_median_response_minutes) AS m FROM map GROUP BY area)
SELECT vec_id, strftime(queued, '%Y-%m-%d %H:%M') AS event_time_display, array_to_string(list_transform(string_split(area, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS area_display,
coalesce(CAST(p AS VARCHAR), 'Not available') AS population_display, coalesce(CAST(n AS VARCHAR), 'Not available') AS past_year_unique_events_display,
coalesce(CAST(round_even(r, 1) AS VARCHAR), 'Not available') AS past_year_events_per_1000_display,
coalesce(CAST(round_even(m, 1) AS VARCHAR) || ' min', 'Not available') AS median_response_display
FROM year LEFT JOIN figures USING (area) WHERE event_importance_bin = 'even' AND CAST(queued AS DATE) >= (SELECT max(CAST(queued AS DATE)) - 29 FROM located)""")
def map_points_display(spark, sf_dir):
    roles = b.POINT_ROLES.bind(arrival_time="arrived")
    points = choropleth.map_points(_located(spark, sf_dir), _areas(spark, sf_dir), roles, ["even"], "area")
    return points.select("vec_id", *[c for c in points.columns if c.endswith("_display")])


_LABELS = "CASE WHEN vec_id % 3 = 0 THEN 'north shore' WHEN vec_id % 3 = 1 THEN 'river east' ELSE 'old mill' END"
_ACCURACY = f"""{_POINTS}, accuracy AS (
  SELECT label, count(*) AS evaluated_events, count(*) FILTER (label = area) AS correctly_labeled, count(area) AS events_with_any_boundary,
         count(*) - count(*) FILTER (label = area) AS incorrect_or_outside, count(*) FILTER (label = area) / count(*) * 100 AS pct_correctly_labeled
  FROM (SELECT *, {_LABELS} AS label FROM located) GROUP BY label
)"""


def _accuracy(spark, sf_dir):
    return spatial.assignment_accuracy(_located(spark, sf_dir).withColumn("label", F.expr(_LABELS)), "label", "area")


@query(f"WITH {_ACCURACY} SELECT * FROM accuracy")
def boundary_accuracy(spark, sf_dir):
    return _accuracy(spark, sf_dir)


@query(f"""WITH {_ACCURACY}, t AS (SELECT sum(evaluated_events)::BIGINT AS e, sum(correctly_labeled)::BIGINT AS c, sum(events_with_any_boundary)::BIGINT AS w FROM accuracy)
SELECT metric, value, value * 100.0::DOUBLE / e AS percentage FROM (
SELECT 'evaluated events' AS metric, e AS value, e FROM t UNION ALL SELECT 'correctly labeled', c, e FROM t UNION ALL
SELECT 'in a different boundary', w - c, e FROM t UNION ALL SELECT 'outside all boundaries', e - w, e FROM t)""")
def accuracy_summary(spark, sf_dir):
    return spatial.accuracy_summary(_accuracy(spark, sf_dir))


_CROSSWALK = '{"alpha": "North Shore", "beta": ["River East", "Old Mill"], "unknown": ""}'


@query("""SELECT DISTINCT event_type AS label, 'area ' || (CAST(json_extract(props, '$.k') AS INT) % CASE event_type WHEN 'error' THEN 1 ELSE 4 END) AS boundary FROM events""")
def crosswalk_explode(spark, sf_dir):
    """A crosswalk of event types, written as JSON with lists and single names, and read again."""
    kinds = F.when(F.col("event_type") == "error", 1).otherwise(4)
    named = F.concat(F.lit("area "), (F.get_json_object("props", "$.k").cast("int") % kinds).cast("string"))
    lists = b.table(spark, sf_dir, "events").groupBy("event_type").agg(F.array_sort(F.collect_set(named)).alias("names"))
    value = F.when(F.size("names") == 1, F.concat(F.lit('"'), F.col("names")[0], F.lit('"'))).otherwise(F.to_json("names"))
    entries = lists.select(F.concat(F.lit('"'), "event_type", F.lit('": '), value).alias("entry"))
    return spatial.crosswalk(entries.agg(F.concat(F.lit("{"), F.array_join(F.collect_list("entry"), ", "), F.lit("}")).alias("value")))


_LABEL_BOXES = """boxes AS (
  SELECT label, min(CAST(embedding[1] AS DOUBLE)) AS x0, max(CAST(embedding[1] AS DOUBLE)) AS x1, min(CAST(embedding[2] AS DOUBLE)) AS y0, max(CAST(embedding[2] AS DOUBLE)) AS y1
  FROM embeddings GROUP BY label HAVING min(embedding[1]) < max(embedding[1]) AND min(embedding[2]) < max(embedding[2])
), kinds AS (
  SELECT * FROM (VALUES (1, 1, 0.4375::DOUBLE, 0.5625::DOUBLE, 0::DOUBLE), (2, 1, 0, 1, 2), (3, 1, 0, 1, 0), (3, 2, 0.25, 0.75, 0)) t(part, ring, low, high, move)
), ring_boxes AS (
  SELECT label, part, ring, x0 + (x1 - x0) * low + move AS x0, x0 + (x1 - x0) * high + move AS x1, y0 + (y1 - y0) * low AS y0, y0 + (y1 - y0) * high AS y1 FROM boxes, kinds
)"""


@query(f"""WITH {_LABEL_BOXES}, met AS (
  SELECT vec_id, label AS objectid, count(*) FILTER (x > x0 AND x < x1 AND y > y0 AND y < y1 AND NOT (part = 3 AND ring = 2)) AS inside,
         count(*) FILTER (part = 3 AND ring = 2 AND x >= x0 AND x <= x1 AND y >= y0 AND y <= y1) AS in_hole,
         count(*) FILTER (part = 1 AND x > x0 AND x < x1 AND y > y0 AND y < y1) AS on_island
  FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), ring_boxes GROUP BY ALL
) SELECT vec_id, objectid FROM met WHERE on_island > 0 OR (inside > 0 AND in_hole = 0)""")
def points_in_parts(spark, sf_dir):
    """Points in areas with holes, islands in them, and second parts."""
    return spatial.containing(b.points(spark, sf_dir).select("vec_id", "x", "y"), b.label_areas(spark, sf_dir), "x", "y").select("vec_id", "objectid")


def _conic_sql(number: int, x: str, y: str) -> str:
    """Longitude and latitude of a conformal conic system in SQL, by iteration instead of a series."""
    p = projections.SYSTEMS[number]
    e = p.ellipsoid.eccentricity
    m = lambda d: f"(cos(radians({d}::DOUBLE)) / sqrt(1 - pow({e} * sin(radians({d}::DOUBLE)), 2)))"
    t = lambda d: f"(tan(pi() / 4 - radians({d}::DOUBLE) / 2) / pow((1 - {e} * sin(radians({d}::DOUBLE))) / (1 + {e} * sin(radians({d}::DOUBLE))), {e} / 2))"
    better = lambda v: f"(pi() / 2 - 2 * atan(t * pow((1 - {e} * sin({v})) / (1 + {e} * sin({v})), {e} / 2)))"
    steps = "".join(f", i{k + 1} AS (SELECT *, {better(f'v{k}')} AS v{k + 1} FROM i{k})" for k in range(8))
    return f"""c AS (SELECT ln({m(p.first)} / {m(p.second)}) / ln({t(p.first)} / {t(p.second)}) AS n), g AS (
      SELECT n, {p.ellipsoid.axis} * {m(p.first)} / (n * pow({t(p.first)}, n)) AS af FROM c
    ), r AS (SELECT *, {x} * {p.unit} - {p.easting} AS e, af * pow({t(p.latitude)}, n) - ({y} * {p.unit} - {p.northing}) AS s FROM given, g
    ), i0 AS (SELECT *, pow(sqrt(e * e + s * s) / af, 1 / n) AS t, pi() / 2 - 2 * atan(pow(sqrt(e * e + s * s) / af, 1 / n)) AS v0, atan2(e, s) / n AS turned FROM r){steps},
    found AS (SELECT *, degrees(turned) + {p.longitude} AS lon, degrees(v8) AS lat FROM i8)"""


@query(f"""WITH given AS (SELECT vec_id, 1270000 + 100000 * CAST(embedding[1] AS DOUBLE) AS east, 230000 + 100000 * CAST(embedding[2] AS DOUBLE) AS north FROM embeddings),
{_conic_sql(2285, "east", "north")} SELECT vec_id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM found""")
def reprojected_points(spark, sf_dir):
    """Vectors as places of a map in feet, back to degrees."""
    p = projections.system(2285).degrees(F.lit(1270000) + F.lit(100000) * F.col("x"), F.lit(230000) + F.lit(100000) * F.col("y"))
    return b.points(spark, sf_dir).select("vec_id", p.alias("p")).select("vec_id", F.round("p.x", 7).alias("lon"), F.round("p.y", 7).alias("lat"))


@query(f"""WITH {_CALLS} SELECT CAST((max(CAST(queued AS DATE)) - 29) AS VARCHAR) AS range_start, CAST(max(CAST(queued AS DATE)) AS VARCHAR) AS range_end FROM calls""")
def default_map_range(spark, sf_dir):
    last = F.max("queued").cast("date")
    return b.calls(spark, sf_dir).agg(F.date_sub(last, 29).cast("string").alias("range_start"), last.cast("string").alias("range_end"))
