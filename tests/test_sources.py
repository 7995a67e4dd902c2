"""Snapshots, the paged source against a local stub, dimension files, streams, ranges and charts."""

import json
import sqlite3
import threading
import urllib.error
import urllib.parse
from datetime import date, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from incidara.operators.schema import CALL_COLUMNS, from_records
from incidara.plans import charts, ranges
from incidara.plans.context import Charts, Context
from incidara.plans.figures import Figures
from incidara.roles import Roles
from incidara.sources import rest, snapshot, tables
from incidara.streaming import refresh

ROLES = Roles()
RECORDS = [
    {"call_sign_dispatch_id": f"R{k:03}", "cad_event_number": f"E{k // 2}", "cad_event_original_time_queued": f"2025-01-{1 + k % 28:02}T0{k % 10}:00:00.000",
     "cad_event_arrived_time": f"2025-01-{1 + k % 28:02}T0{k % 10}:0{k % 7}:00.000", "event_group": ["Theft", "narcotics", "assault"][k % 3], "priority": str(k % 5),
     "dispatch_neighborhood": ["alpha", "beta"][k % 2], "dispatch_latitude": str(47.6 + k / 1000), "dispatch_longitude": "-122.3"}
    for k in range(60)
]


class Feed:
    """An endpoint over records in SQLite, whose language has what the source asks for; ``between`` runs before each answer."""

    def __init__(self, records):
        self.asked, self.between = [], lambda asked, db: None
        self.columns = sorted({c for r in records for c in r})
        self.db = sqlite3.connect(":memory:", check_same_thread=False)
        self.db.create_function("date_trunc_ymd", 1, lambda t: t and t[:10] + "T00:00:00.000")
        self.db.create_function("date_extract_hh", 1, lambda t: t and int(t[11:13]))
        self.db.create_function("date_extract_mm", 1, lambda t: t and int(t[14:16]))
        self.db.execute(f"CREATE TABLE calls ({', '.join(self.columns)})")
        self.add(records)
        feed = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                given = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
                rows = {"error": 1} if "bad" in self.path else feed.answer(given)
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps(rows).encode())

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url, self.lock = f"http://127.0.0.1:{self.server.server_port}/calls", threading.Lock()

    def add(self, records):
        self.db.executemany(f"INSERT INTO calls VALUES ({', '.join('?' * len(self.columns))})", [[r.get(c) for c in self.columns] for r in records])

    def answer(self, given):
        with self.lock:
            self.between(given, self)
            self.asked.append(given)
            select = given.get("$select")
            listed = [c if c.split(" ")[-1] in self.columns or "(" in c else f"NULL AS {c}" for c in select.split(",")] if select and not select.startswith("DISTINCT") else [select or "*"]
            query = f"SELECT {', '.join(listed)} FROM calls"
            for word, clause in (("$where", "WHERE"), ("$group", "GROUP BY"), ("$order", "ORDER BY"), ("$limit", "LIMIT"), ("$offset", "OFFSET")):
                query += f" {clause} {given[word]}" if word in given else ""
            found = self.db.execute(query)
            return [dict(zip([d[0] for d in found.description], r, strict=True)) for r in found.fetchall()]


@pytest.fixture(scope="module")
def endpoint():
    feed = Feed(RECORDS)
    yield feed.url, feed.asked
    feed.server.shutdown()


def test_paged_source(spark, endpoint):
    url, asked = endpoint
    df = rest.read_calls(spark, url, "2025-01-01", "2025-02-01", windowDays=7, pageSize=4)
    rows = df.collect()
    assert df.columns == list(CALL_COLUMNS) and sorted(r["call_sign_dispatch_id"] for r in rows) == [r["call_sign_dispatch_id"] for r in RECORDS]
    assert rows[0]["event_group"] in ("theft", "narcotics", "assault")
    assert all(int(a["$limit"]) == 4 and ">= '2025-" in a["$where"] for a in asked if "$where" in a)
    later = df.filter(F.col("cad_event_original_time_queued") >= datetime(2025, 1, 20)).count()
    assert later == sum(r["cad_event_original_time_queued"] >= "2025-01-20" for r in RECORDS)
    assert "cad_event_original_time_queued >= '2025-01-20T00:00:00.000'" in asked[-1]["$where"]  # it reached the endpoint
    assert rest.read_calls(spark, url, "2025-01-01", pageSize=4, maxPages=2).count() == 8
    assert rest.sample(spark, url, 3).count() == 3


def test_open_ended_feed_is_cut_into_windows(spark, endpoint):
    url, asked = endpoint
    time = "cad_event_original_time_queued"
    times = [datetime.fromisoformat(r[time]) for r in RECORDS]
    assert rest.fetch_bounds(url, time, "cad_event_number") == (min(times), max(times))
    assert rest.fetch_bounds(url, time, where=[f"{time} > '2030-01-01'"]) == (None, None)
    df = rest.read_calls(spark, url, "2025-01-01", windowDays=7)
    assert df.rdd.getNumPartitions() == 4 and df.count() == len(RECORDS)
    reader = rest.PagedReader(df.select(time).schema, {"endpoint": url, "start": "2025-01-01", "windowDays": "7"})
    list(reader.pushFilters([rest.LessThan((time,), datetime(2025, 1, 10))]))
    assert [w.end for w in reader.partitions()] == ["2025-01-08T00:00:00.000", "2025-01-11T00:00:00.000"]  # the filter's bound, rounded up


def test_distinct_events_of_the_endpoint(spark, endpoint):
    url, asked = endpoint
    found = rest.read_distinct(spark, url, "2025-01-01", group_by="event_group", windowDays=7, pageSize=3)
    assert sorted(map(tuple, found.collect())) == sorted({(r["cad_event_number"], r["event_group"]) for r in RECORDS})
    asked_for = [a for a in asked if a.get("$select") == "DISTINCT cad_event_number,event_group"]
    assert any("cad_event_number > 'E" in a["$where"] for a in asked_for) and all(a["$offset"] == "0" for a in asked_for)


TIME, ROW, EVENT = ROLES.event_time, ROLES.row_id, ROLES.event_id


def made(n, times, prefix="N"):
    return [{ROW: f"{prefix}{k:06}", EVENT: f"E{k // 3}", TIME: times(k), "event_group": "theft" if k % 5 else None} for k in range(n)]


def test_rows_that_come_between_pages_move_no_others(spark):
    """New rows before, at and behind the place of the page: none that was there is lost or met twice."""
    feed = Feed(made(300, lambda k: f"2025-03-{1 + k % 9:02}T0{k % 3}:00:00.000"))

    def insert(asked, feed, count=[0]):
        if "$order" in asked and asked["$order"].startswith(TIME):
            count[0] += 1
            feed.add(made(7, lambda k: f"2025-03-{1 + k % 9:02}T0{k % 3}:30:00.000", f"L{count[0]:03}") + made(2, lambda k: "2025-03-09T02:00:00.000", f"A{count[0]:03}"))

    feed.between = insert
    rows = rest.read_calls(spark, feed.url, "2025-03-01", "2025-03-20", pageSize=20, windowDays=30).collect()
    ids = [r[ROW] for r in rows]
    assert len(ids) == len(set(ids)) and {f"N{k:06}".lower() for k in range(300)} <= {i.lower() for i in ids}
    pages = [a for a in feed.asked if a.get("$order", "").startswith(TIME)]
    assert len(pages) > 15 and all(a["$offset"] == "0" for a in pages)  # no page counts through those before it
    feed.server.shutdown()


def test_pages_of_one_instant_and_of_quoted_ids(spark):
    feed = Feed(made(100, lambda k: "2025-03-01T00:00:00.000") + [{ROW: "o'brien", EVENT: "e'", TIME: "2025-03-01T00:00:00.000"}])
    df = rest.read_calls(spark, feed.url, "2025-03-01", "2025-03-02", pageSize=9)
    assert df.count() == 101 and df.select("event_group").count() == 101  # the place is known whatever columns are read
    found = rest.read_distinct(spark, feed.url, "2025-03-01", "2025-03-02", group_by="event_group", pageSize=5)
    want = {(f"E{k // 3}", "theft" if k % 5 else None) for k in range(100)} | {("e'", None)}
    assert set(map(tuple, found.collect())) == want and found.count() == len(want)
    feed.server.shutdown()


def test_windows_have_equal_work(spark):
    """One busy hour of one busy day among quiet months."""
    quiet = made(900, lambda k: f"2025-{1 + k % 6:02}-{1 + k % 28:02}T{k % 24:02}:{k % 60:02}:00.000")
    busy = made(3000, lambda k: f"2025-03-14T17:{k % 60:02}:{k // 60:02}.000", "B")
    feed = Feed(quiet + busy)
    schema = rest.read_calls(spark, feed.url, "2025-01-01").select(TIME).schema
    reader = rest.PagedReader(schema, {"endpoint": feed.url, "start": "2025-01-01", "end": "2025-07-01", "windowRows": "300"})
    windows = reader.partitions()
    assert windows[0].start == "2025-01-01T00:00:00.000" and windows[-1].end == "2025-07-01T00:00:00.000"
    assert all(a.end == b.start for a, b in zip(windows, windows[1:], strict=False)) and len(windows) == 13
    sizes = [feed.db.execute(f"SELECT count(*) FROM calls WHERE {TIME} >= ? AND {TIME} < ?", (w.start, w.end)).fetchone()[0] for w in windows]
    assert sum(sizes) == 3900 and max(sizes) <= 2 * min(sizes)
    assert len([a for a in feed.asked if "$group" in a]) <= 4  # days, the busy day's hours, its hour's minutes
    assert rest.read_calls(spark, feed.url, "2025-01-01", "2025-07-01", windowRows=300).count() == 3900
    empty = rest.PagedReader(schema, {"endpoint": feed.url, "start": "2030-01-01", "end": "2030-02-01"})
    assert [w.start for w in empty.partitions()] == ["2030-01-01T00:00:00.000"]
    feed.server.shutdown()


def test_page_guards(endpoint):
    url, _ = endpoint
    for limit, offset in ((0, 0), (True, 0), (5, -1), (5, True)):
        with pytest.raises(ValueError):
            rest.page_parameters(["a"], "t", "r", [], limit, offset)
    with pytest.raises(ValueError):
        rest.fetch_page(url, {"$limit": "1"}, timeout=True)
    with pytest.raises(ValueError):
        rest.fetch_page(url + "/bad", {"$limit": "1"})


def test_hiccups_cost_a_page(spark, monkeypatch):
    """A busy endpoint is asked again, page by page; an answer that says no is an error at once."""
    monkeypatch.setattr(rest, "PAUSE", 0.01)
    feed = Feed(RECORDS)
    seen = []

    def busy(asked, feed):
        seen.append(asked)
        if len(seen) % 3:  # two of three requests
            raise BrokenPipeError  # the connection ends without an answer

    feed.between = busy
    records = rest.fetch_page(feed.url, {"$limit": "7"})
    assert len(records) == 7 and len(seen) == 3
    with pytest.raises(OSError):
        rest.fetch_page(feed.url, {"$limit": "7"}, retries=1)
    seen.clear()
    assert rest.read_calls(spark, feed.url, "2025-01-01", "2025-02-01", windowDays=40, pageSize=20).count() == 60
    assert len(seen) == 12  # four pages, each asked for three times
    feed.server.shutdown()
    error = lambda code, **headers: urllib.error.HTTPError("x", code, "", headers, None)
    assert rest._pause(error(404), 0) is None and rest._pause(error(503), 1) == 0.02
    assert rest._pause(error(429, **{"Retry-After": "3"}), 0) == 3 and rest._pause(error(429, **{"Retry-After": "900"}), 0) == rest.LONGEST
    assert rest._pause(TimeoutError(), 0) == 0.01


def test_snapshot_round_trip_refresh_and_stream(spark, tmp_path):
    where = str(tmp_path / "snapshot")
    first = from_records(spark, RECORDS[:30])
    snapshot.full_refresh(where, lambda start: first.unionByName(first), "2025-01-01", ROLES)
    df, metadata = snapshot.load_snapshot(spark, where)
    assert metadata["row_count"] == df.count() == 30 and metadata["columns"] == df.columns
    asked = []
    fresh = from_records(spark, [r | {"priority": "9"} for r in RECORDS[25:]])
    snapshot.incremental_refresh(spark, where, lambda start: asked.append(start) or fresh, ROLES)
    df, metadata = snapshot.load_snapshot(spark, where)
    assert asked == ["2025-01-14"] and df.count() == 60 and df.filter("priority = 9").count() == 35
    target = f"{where}/{snapshot.METADATA}"
    broken = dict(metadata, row_count=1)
    spark.createDataFrame([(json.dumps(broken),)], "value string").write.mode("overwrite").text(target)
    with pytest.raises(ValueError, match="rows"):
        snapshot.load_snapshot(spark, where)
    del broken["columns"]
    spark.createDataFrame([(json.dumps(broken),)], "value string").write.mode("overwrite").text(target)
    with pytest.raises(ValueError, match="keys"):
        snapshot.load_snapshot(spark, where)
    snapshot.save_snapshot(df, where, "2025-01-01", ROLES.event_time, ROLES.row_id, unique=True)
    assert snapshot.remove_old_versions(spark, where) == 2 and snapshot.remove_old_versions(spark, where) == 0
    arriving = str(tmp_path / "arriving")
    from_records(spark, [RECORDS[0] | {"priority": "7"}]).write.parquet(arriving)
    stream = spark.readStream.schema(df.schema).parquet(arriving)
    refresh.upsert_stream(stream, where, str(tmp_path / "state"), ROLES).awaitTermination(60)
    df, _ = snapshot.load_snapshot(spark, where)
    assert df.count() == 60 and df.filter("priority = 7").count() == 1
    counts = refresh.daily_counts(stream, ROLES).writeStream.format("memory").queryName("day_counts").outputMode("complete").start()
    counts.processAllAvailable()
    counts.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM day_counts").collect()] == [(date(2025, 1, 1), 1)]


def files_of(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def test_a_batch_of_one_day_writes_that_day_alone(spark, tmp_path):
    where, data = str(tmp_path / "snapshot"), tmp_path / "snapshot" / snapshot.DATA
    snapshot.full_refresh(where, lambda start: from_records(spark, RECORDS), "2025-01-01", ROLES, by_day=True)
    before, files = snapshot.read_metadata(spark, where), files_of(data)
    assert len(before["parts"]) == 28 and len(files) >= 28
    day = [r | {"priority": "9"} for r in RECORDS if r["cad_event_original_time_queued"].startswith("2025-01-05")]
    snapshot.merge(spark, where, from_records(spark, day), ROLES)
    after, written = snapshot.read_metadata(spark, where), files_of(data) - files
    assert files <= files_of(data)  # nothing that was there has changed
    assert written and all("=2025-01-05/" in f for f in written)
    assert [p["day"] for p in after["parts"] if p not in before["parts"]] == ["2025-01-05"]
    df, _ = snapshot.load_snapshot(spark, where)
    assert df.count() == 60 and df.filter("priority = 9").count() == len(day) == sum(r["cad_event_original_time_queued"].startswith("2025-01-05") for r in RECORDS)
    # an id that moves to another day: both days are written, and the row is there once
    moved = RECORDS[0] | {"cad_event_original_time_queued": "2025-01-20T12:00:00.000"}
    snapshot.merge(spark, where, from_records(spark, [moved]), ROLES)
    now = snapshot.read_metadata(spark, where)
    assert {p["day"] for p in now["parts"] if p not in after["parts"]} == {"2025-01-01", "2025-01-20"}
    df, _ = snapshot.load_snapshot(spark, where)
    assert df.count() == 60 and str(df.filter("call_sign_dispatch_id = 'R000'").first()[ROLES.event_time]) == "2025-01-20 12:00:00"
    kept = {p["path"] for p in now["parts"]}
    snapshot.remove_old_versions(spark, where)
    assert {f"{f.split('/')[0]}/{f.split('/')[1]}" for f in files_of(data)} == kept and snapshot.load_snapshot(spark, where)[0].count() == 60


def test_days_beyond_retention_are_not_written(spark, tmp_path):
    """A batch of many days, most of them too old: an id among them still replaces its stored row."""
    where, data = str(tmp_path / "snapshot"), tmp_path / "snapshot" / snapshot.DATA
    snapshot.full_refresh(where, lambda start: from_records(spark, RECORDS), "2025-01-01", ROLES, by_day=True)
    files = files_of(data)
    old = [RECORDS[0] | {"call_sign_dispatch_id": f"OLD{k}", "cad_event_original_time_queued": f"20{k + 10}-03-01T00:00:00.000"} for k in range(10)]
    back = RECORDS[1] | {"cad_event_original_time_queued": "2012-03-01T00:00:00.000"}
    new = RECORDS[0] | {"call_sign_dispatch_id": "NEW", "cad_event_original_time_queued": "2025-01-29T00:00:00.000"}
    snapshot.merge(spark, where, from_records(spark, [*old, back, new]), ROLES)
    written = {f.split("=")[1].split("/")[0] for f in files_of(data) - files}
    assert written == {RECORDS[1]["cad_event_original_time_queued"][:10], "2025-01-29"}
    df, metadata = snapshot.load_snapshot(spark, where)
    assert df.count() == 60 and metadata["row_count"] == 60  # R001 has gone with its old time, NEW has come
    assert df.filter("call_sign_dispatch_id LIKE 'OLD%' OR call_sign_dispatch_id = 'R001'").count() == 0
    # without a later row in the batch it is the days that stay which tell what is too old
    files = files_of(data)
    snapshot.merge(spark, where, from_records(spark, old), ROLES)
    assert files_of(data) == files and snapshot.load_snapshot(spark, where)[0].count() == 60


def test_retention_drops_days_and_filters_one(spark, tmp_path):
    where = str(tmp_path / "snapshot")
    snapshot.full_refresh(where, lambda start: from_records(spark, RECORDS), "2025-01-01", ROLES, by_day=True)
    late = RECORDS[0] | {"call_sign_dispatch_id": "LATE", "cad_event_original_time_queued": "2025-01-30T05:00:00.000"}
    snapshot.merge(spark, where, from_records(spark, [late, RECORDS[1] | {"cad_event_original_time_queued": None}]), ROLES, days=20)
    df, metadata = snapshot.load_snapshot(spark, where)
    want = {r["call_sign_dispatch_id"] for r in RECORDS if r["cad_event_original_time_queued"] >= "2025-01-10T05"} - {"R001"} | {"LATE"}
    assert {r[ROLES.row_id] for r in df.collect()} == want and metadata["parts"][0]["day"] == "2025-01-10"
    assert metadata["cutoff"] == "2025-01-10 05:00:00" and metadata["source_start_date"] == "2025-01-10" and metadata["row_count"] == len(want)


@pytest.mark.parametrize("by_day", [False, True])
def test_stored_rows_of_unique_ids_are_not_grouped_again(spark, tmp_path, monkeypatch, by_day):
    where, plans = str(tmp_path / "snapshot"), []
    snapshot.full_refresh(where, lambda start: from_records(spark, RECORDS), "2025-01-01", ROLES, by_day)
    write = snapshot._write_parts
    monkeypatch.setattr(snapshot, "_write_parts", lambda df, *rest: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *rest))
    snapshot.merge(spark, where, from_records(spark, RECORDS[:2]), ROLES)
    stored, _, batch = plans[0].partition("LeftAnti")[2].partition("Window [")
    assert batch and "hashpartitioning" not in stored and "Window [" not in batch
    assert " >= 2024-01-29 07:00:00" in stored  # before anything else
    assert snapshot.load_snapshot(spark, where)[0].count() == 60


def test_an_old_fresh_row_still_replaces_its_stored_one(spark, tmp_path):
    """Of ids that are stored twice, in a snapshot not yet by day: rows too old are left out before ids are looked at, and none comes back."""
    where, time = str(tmp_path / "snapshot"), "cad_event_original_time_queued"
    twice = [r | {time: "2025-01-27T12:00:00.000", "priority": "9"} for r in RECORDS[:20]]
    snapshot.save_snapshot(from_records(spark, RECORDS + twice), where, "2025-01-01")
    old = [RECORDS[k] | {time: "2024-06-01T00:00:00.000"} for k in (3, 50)]
    both = [RECORDS[4] | {time: t} for t in ("2024-07-01T00:00:00.000", "2025-01-26T00:00:00.000")]
    snapshot.merge(spark, where, from_records(spark, [*old, *both, RECORDS[5] | {time: None}]), ROLES, days=10)
    got = {r[ROLES.row_id]: str(r[time]) for r in snapshot.load_snapshot(spark, where)[0].collect()}
    want = {r["call_sign_dispatch_id"]: r[time] for r in RECORDS + twice} | {"R003": "", "R050": "", "R005": "", "R004": both[1][time]}
    latest = max(want.values())
    assert latest == "2025-01-28T07:00:00.000"
    assert got == {k: t[:19].replace("T", " ") for k, t in want.items() if t >= "2025-01-18T07:00:00.000"}


def test_refresh_edges(spark, tmp_path):
    where = str(tmp_path / "snapshot")
    with pytest.raises(FileNotFoundError):
        snapshot.read_metadata(spark, where)
    rows = from_records(spark, RECORDS[:3] + [RECORDS[0] | {"priority": "8"}, RECORDS[5] | {"call_sign_dispatch_id": None}])
    snapshot.save_snapshot(rows, where, "2025-01-01")  # one part, and an id that is there twice
    snapshot.merge(spark, where, rows.limit(0), ROLES)
    df, metadata = snapshot.load_snapshot(spark, where)
    assert df.count() == 4 and metadata["unique"] and all(p["day"] for p in metadata["parts"])
    extra = from_records(spark, [RECORDS[1]]).withColumn("remark", F.lit("x"))
    snapshot.merge(spark, where, extra, ROLES)  # a column more: other days read it as null
    df, _ = snapshot.load_snapshot(spark, where)
    assert df.count() == 4 and df.filter("remark = 'x'").count() == 1 and df.filter("remark IS NULL").count() == 3
    snapshot.merge(spark, where, from_records(spark, [RECORDS[9] | {"call_sign_dispatch_id": None}]), ROLES)
    assert snapshot.load_snapshot(spark, where)[0].filter("call_sign_dispatch_id IS NULL").count() == 1
    nothing = str(tmp_path / "nothing")
    snapshot.save_snapshot(rows.limit(0), nothing, "2025-01-01", ROLES.event_time)
    with pytest.raises(ValueError, match="time"):
        snapshot.merge(spark, nothing, rows.limit(0), ROLES)
    assert snapshot.load_snapshot(spark, nothing)[0].count() == 0


def test_of_two_writers_one_commits(spark, tmp_path):
    where = str(tmp_path / "snapshot")
    rows = from_records(spark, RECORDS)
    snapshot.full_refresh(where, lambda start: rows, "2025-01-01", ROLES, by_day=True)
    name, metadata = snapshot._metadata_name(spark, where), snapshot.read_metadata(spark, where)
    snapshot.merge(spark, where, rows.limit(1), ROLES)
    with pytest.raises(RuntimeError, match="another writer"):
        snapshot._commit(spark, where, metadata, name)
    assert snapshot.load_snapshot(spark, where)[0].count() == 60


GEO = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"Neighborhood": " Alpha ", "PRECINCT": "N"}, "geometry": {"type": "Polygon", "coordinates": [[[-122.4, 47.5], [-122.2, 47.5], [-122.2, 47.7], [-122.4, 47.7], [-122.4, 47.5]]]}},
    {"type": "Feature", "properties": {"Neighborhood": "beta", "PRECINCT": "S"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[2, 2], [3, 2], [3, 3], [2, 2]]]]}},
]}


def test_dimension_files(spark, tmp_path):
    geo = tmp_path / "areas.geojson"
    geo.write_text(json.dumps(GEO))
    areas = tables.read_boundaries(spark, str(tmp_path / "missing.geojson"), str(geo)).orderBy("objectid")
    rows = areas.collect()
    assert [(r["objectid"], r["mcpp_neighborhood"], r["mcpp_precinct"], r["mcpp_neighborhood_display"]) for r in rows] == [(1, "alpha", "n", "Alpha"), (2, "beta", "s", "Beta")]
    assert [len(r["rings"]) for r in rows] == [1, 2]
    with pytest.raises(FileNotFoundError):
        tables.read_geojson(spark, str(tmp_path / "none"))
    caches = [str(tmp_path / "cache1"), str(tmp_path / "cache2")]
    tables.write_geojson(areas, str(tmp_path / "served"), "mcpp_neighborhood")
    served = next((tmp_path / "served").glob("part-*"))
    assert tables.read_boundaries(spark, *caches, url=served.as_uri(), group="mcpp_neighborhood").count() == 2
    assert all(tables.read_geojson(spark, c).count() == 2 for c in caches)  # written through to both
    with pytest.raises(ValueError, match="degrees"):
        tables.require_degrees(areas.select(F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] * 1000).alias("x"), p["y"].alias("y")))).alias("rings")))
    tables.write_geojson(areas, str(tmp_path / "out"), "mcpp_neighborhood")
    again = tables.read_geojson(spark, str(tmp_path / "out"))
    assert again.count() == 2 and tables.feature_collection(areas, "objectid")["features"][0]["properties"] == {"objectid": 1}
    people = tmp_path / "people.csv"
    people.write_text("dispatch_neighborhood,population\n Alpha ,100\nbeta,none\n")
    assert [tuple(r) for r in tables.read_population(spark, str(people)).collect()] == [("alpha", 100.0), ("beta", None)]
    walk = tmp_path / "walk.json"
    walk.write_text('{"a": "A", "b": ["B", "C"], "unknown": ""}')
    assert [tuple(r) for r in tables.read_crosswalk(spark, str(walk)).collect()] == [("a", "A"), ("b", "B"), ("b", "C"), ("unknown", "")]
    calls = from_records(spark, RECORDS)
    context = Context(calls, areas, tables.read_population(spark, str(people)))
    bins = context.bins.targets
    assert context.located.filter("mcpp_neighborhood = 'alpha'").count() == 30
    assert context.choropleth(bins).filter("mcpp_neighborhood = 'alpha'").first()["past_year_unique_events_per_1000"] == 300.0
    assert context.points(bins).count() == 30 and context.points(bins, "2025-01-01", "2025-01-05").count() == context.points(bins, "2025-01-05", "2025-01-01").count() + Charts(context).point_count(bins, "2025-01-01", "2025-01-05")
    assert context.points(bins, "x", "y").count() == 30
    scores = context.scatter(bins, 1)
    assert scores.count() == 3 and charts.scatter_chart(scores, "dispatch_neighborhood", bins)["data"]
    assert charts.scatter_chart(scores.limit(0), "dispatch_neighborhood", bins)["data"] == []
    assert len(charts.daily_chart(context.daily(bins), bins)["data"]) == 2
    from incidara.operators.scatter import guide_lines

    chart = charts.scatter_chart(scores, "dispatch_neighborhood", bins, guide_lines(scores))
    assert [s["line"]["dash"] for s in chart["layout"]["shapes"]] == ["dash"] * 2 and len(chart["layout"]["annotations"]) == 2
    assert all(len(t["hovertext"]) == len(t["x"]) and " minutes" in t["hovertext"][0] for t in chart["data"])
    assert charts.scatter_chart(scores, "dispatch_neighborhood", bins, guide_lines(scores.limit(0)))["layout"]["shapes"] == []
    chart = charts.map_chart(context.choropleth(bins), context.points(bins), ROLES, "mcpp_neighborhood", bins)
    assert chart["data"][0]["type"] == "choroplethmapbox" and chart["data"][0]["z"] == [300.0] and len(chart["data"][0]["geojson"]["features"]) == 2
    assert charts.count_points(chart) == context.points(bins).count() == 30 and {t["type"] for t in chart["data"][1:]} == {"scattermapbox"}
    nothing = charts.map_chart(context.choropleth(bins).limit(0), context.points(bins).limit(0), ROLES, "mcpp_neighborhood", bins)
    assert nothing == charts.empty_map() and charts.count_points(nothing) == 0
    with pytest.raises(ValueError, match="more than 3 points"):
        charts.map_chart(context.choropleth(bins), context.points(bins), ROLES, "mcpp_neighborhood", bins, most=3)
    assert chart["layout"]["mapbox"]["zoom"] == charts.ZOOM and chart["data"][0]["showscale"] is False
    assert ranges.default_range(context.valid_time, ROLES) == ("2024-12-30", "2025-01-28")
    check_figures(spark, context, bins)
    context.close()


def check_figures(spark, context, bins):
    """Each figure is made once for what it depends on, and a caller's change stays the caller's."""
    kept, jobs = Figures(context), spark.sparkContext.statusTracker()

    def jobs_of(name, make):
        spark.sparkContext.setJobGroup(name, name)
        try:
            return make(), len(jobs.getJobIdsForGroup(name))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    (chart, shown), some = jobs_of("map-1", lambda: kept.map(bins, show_colorbar=True, zoom=12))
    assert some and shown == 30 and chart["data"][0]["showscale"] and chart["layout"]["mapbox"]["zoom"] == 12
    chart["data"].clear()
    (again, _), none = jobs_of("map-2", lambda: kept.map(list(bins), show_colorbar=True, zoom=12))
    assert none == 0 and charts.count_points(again) == 30 and again["layout"]["uirevision"] == "keep-map"
    (plain, _), some = jobs_of("map-3", lambda: kept.map(bins, zoom=12))
    assert some and plain["data"][0]["showscale"] is False  # the switch is part of the key
    days, shown = kept.map(bins, "2025-01-01", "2025-01-05")
    assert shown == charts.count_points(days) < 30
    assert kept.daily(bins)["layout"]["showlegend"] and not kept.daily(bins, legend=False)["layout"]["showlegend"]
    scatter, none = kept.scatter(bins, min_events=1), jobs_of("scatter", lambda: kept.scatter(bins, min_events=1))[1]
    assert none == 0 and len(scatter["layout"]["shapes"]) == 2
    assert kept.scatter(bins, min_events=10**6)["data"] == []


def test_ranges():
    default = ("2025-01-01", "2025-01-30")
    assert ranges.visible_range(None, default) == default and ranges.visible_range({"xaxis.autorange": True}, default) == default
    assert ranges.visible_range({"xaxis.range[0]": "2025-01-02 10:00", "xaxis.range[1]": "2025-01-03"}, default) == ("2025-01-02", "2025-01-03")
    assert ranges.visible_range({"xaxis.range": ["2025-01-02", "2025-01-04"]}, default) == ("2025-01-02", "2025-01-04")
    assert ranges.visible_range({"xaxis.range": ["junk", "2025-01-04"]}, default) == default
    assert ranges.stored_range({"start": "2025-01-02", "end": None}, default) == default and ranges.stored_range({}, default) == default
    assert charts.count_points({"data": [{"type": "scattermapbox", "lat": [1, 2]}, {"type": "choropleth"}]}) == 2
