"""Derived tables: the same rows as from all calls, and only changed days computed again."""

import json
import random

import pytest
from pyspark.sql import functions as F

from incidara.operators import dedup, event_days, volume
from incidara.operators.schema import from_records
from incidara.plans import derived
from incidara.roles import DEFAULT_BINS, BinSpec, Roles
from incidara.sources import snapshot

ROLES = Roles()


def records(n, seed, days=range(1, 29)):
    rng = random.Random(seed)
    return [
        {ROLES.row_id: f"R{seed}-{k}", ROLES.event_id: f"E{rng.randrange(n // 2)}", "event_group": rng.choice(["theft", "narcotics", "assault", None]), "dispatch_neighborhood": rng.choice("ab"),
         ROLES.event_time: f"2025-01-{rng.choice(list(days)):02}T{rng.randrange(24):02}:00:00.000"}
        for k in range(n)
    ]


def volumes(tables, grain="week"):
    return {r["period_start"]: r["event_count"] for r in tables.volume(grain).collect()}


def plain(df, grain="week"):
    return {r["period_start"]: r["event_count"] for r in volume.period_volume(df, ROLES, grain).collect() if r["event_count"]}


def test_a_refresh_computes_only_what_changed(spark, tmp_path):
    where = str(tmp_path / "snapshot")
    snapshot.full_refresh(where, lambda start: from_records(spark, records(400, 1)), "2025-01-01", ROLES, by_day=True)
    first = derived.DerivedTables(spark, where, ROLES)
    now, _ = snapshot.load_snapshot(spark, where)
    assert volumes(first) == plain(now) and len(first.computed["event_days"]) == 28
    # another session over the same version finds everything there
    other = derived.DerivedTables(spark.newSession(), where, ROLES)
    assert volumes(other, "month") == plain(now, "month") and other.computed["event_days"] == []
    # a batch of two days
    snapshot.merge(spark, where, from_records(spark, records(60, 2, [7, 9])), ROLES)
    after = derived.DerivedTables(spark, where, ROLES)
    now, _ = snapshot.load_snapshot(spark, where)
    assert now.count() == 460 and volumes(after) == plain(now) and sorted(after.computed["event_days"]) == ["2025-01-07", "2025-01-09"]
    grouped = volume.period_volume(now, ROLES, "month", "dispatch_neighborhood")
    assert sorted(map(tuple, after.volume("month", "dispatch_neighborhood").collect())) == sorted(map(tuple, grouped.collect()))
    assert derived.remove_old_pieces(after) == 2 and volumes(after) == plain(now)
    # a later row moves the cutoff: old days go, the day of the cutoff is computed again
    late = [{ROLES.row_id: "late", ROLES.event_id: "late", ROLES.event_time: "2025-02-10T12:00:00.000"}]
    snapshot.merge(spark, where, from_records(spark, late), ROLES, days=30)
    last = derived.DerivedTables(spark, where, ROLES)
    now, _ = snapshot.load_snapshot(spark, where)
    assert volumes(last) == plain(now) and sorted(last.computed["event_days"]) == ["2025-01-11", "2025-02-10"]


def test_latest_rows_and_counts_of_days(spark, tmp_path):
    where = str(tmp_path / "snapshot")
    snapshot.full_refresh(where, lambda start: from_records(spark, records(300, 4)), "2025-01-01", ROLES, by_day=True)
    snapshot.merge(spark, where, from_records(spark, records(50, 5, [20])), ROLES)
    tables = derived.DerivedTables(spark, where, ROLES)
    now, _ = snapshot.load_snapshot(spark, where)
    columns = [ROLES.event_id, ROLES.event_time, ROLES.row_id, "event_group"]
    want = dedup.latest_per_key(now, ROLES.event_id, ROLES.event_time, ROLES.row_id).select(*columns)
    assert sorted(map(str, tables.latest_rows("event_group").collect())) == sorted(map(str, want.collect()))
    assert tables.day_counts().agg(F.sum("dispatch_records")).first()[0] == 350
    assert {r["day"].day for r in tables.day_counts().collect()} == {int(r["d"]) for r in now.select(F.dayofmonth(ROLES.event_time).alias("d")).distinct().collect()}


def numbered(tables):
    rows = tables.numbers().collect()
    assert len({r["event"] for r in rows}) == len({r["number"] for r in rows}) == len(rows)
    return {r["event"] for r in rows}


def test_sessions_of_two_versions_number_at_once(spark, tmp_path, monkeypatch):
    """While one session numbers the events of a version, another does so for a later one; and pieces are made twice."""
    where = str(tmp_path / "snapshot")
    snapshot.full_refresh(where, lambda start: from_records(spark, records(200, 1)), "2025-01-01", ROLES, by_day=True)
    one = derived.DerivedTables(spark, where, ROLES)
    snapshot.merge(spark, where, from_records(spark, records(300, 2, [5, 6])), ROLES)
    other, plainly, faster = derived.DerivedTables(spark.newSession(), where, ROLES), event_days.number_events, []

    def number_events(*given):
        if not faster:
            faster.append(True)
            faster.append(volumes(other))
        return plainly(*given)

    monkeypatch.setattr(event_days, "number_events", number_events)
    assert volumes(one) == plain(one._calls(one.metadata["parts"]))
    now, _ = snapshot.load_snapshot(spark, where)
    assert faster[1] == volumes(other) == plain(now)
    assert numbered(one) == numbered(other) == {r["event"] for r in now.select(F.col(ROLES.event_id).alias("event")).distinct().collect()}

    def derive(rows):  # the other session is faster
        if not other.computed.get("twice"):
            other.table("twice", lambda rows: rows.select(derived._PART, ROLES.row_id))
        return rows.select(derived._PART, ROLES.row_id)

    assert derived.DerivedTables(spark, where, ROLES).table("twice", derive).count() == now.count() == 500
    assert not [n for n in (tmp_path / "snapshot" / derived.DERIVED).glob("*/.*") if not n.name.endswith(".crc")]  # nothing half done is left


def test_only_new_parts_are_numbered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(derived, "COMPACT", 3)
    where = str(tmp_path / "snapshot")
    snapshot.full_refresh(where, lambda start: from_records(spark, records(100, 1)), "2025-01-01", ROLES, by_day=True)
    seen = numbered(derived.DerivedTables(spark, where, ROLES))
    for seed, day in ((2, 7), (3, 9), (4, 11)):
        snapshot.merge(spark, where, from_records(spark, records(400, seed, [day])), ROLES)
        before, seen = seen, numbered(derived.DerivedTables(spark, where, ROLES))
        assert before < seen
    now, metadata = snapshot.load_snapshot(spark, where)
    assert seen == {r[0] for r in now.select(ROLES.event_id).distinct().collect()}
    listed = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "snapshot" / derived.DERIVED).glob("event_numbers*/g*/parts.json")}
    assert [len(listed[n]) for n in sorted(listed)] == [28, 1, 28, 1]  # the third holds all before it
    tables = derived.DerivedTables(spark, where, ROLES)
    derived.remove_old_pieces(tables)
    assert numbered(tables) == seen and len(list((tmp_path / "snapshot" / derived.DERIVED).glob("event_numbers*/g*"))) == 2


def test_other_bins_have_other_tables(spark, tmp_path):
    where = str(tmp_path / "snapshot")
    snapshot.full_refresh(where, lambda start: from_records(spark, records(60, 1)), "2025-01-01", ROLES, by_day=True)
    bins = lambda spec: {r[0] for r in derived.DerivedTables(spark, where, ROLES, spec).day_counts().select("event_importance_bin").collect()}
    assert "drug-related" in bins(DEFAULT_BINS)
    assert bins(BinSpec({"all": ("theft", "narcotics", "assault")}, ("all",))) == {"all", BinSpec().unknown}


def test_derived_tables_need_days(spark, tmp_path):
    where = str(tmp_path / "whole")
    snapshot.save_snapshot(from_records(spark, records(5, 1)), where, "2025-01-01")
    with pytest.raises(ValueError, match="by day"):
        derived.DerivedTables(spark, where, ROLES)
    nothing = str(tmp_path / "nothing")
    snapshot.save_snapshot(from_records(spark, records(5, 1)).limit(0), nothing, "2025-01-01", ROLES.event_time)
    assert derived.DerivedTables(spark, nothing, ROLES).volume("month").count() == 0
