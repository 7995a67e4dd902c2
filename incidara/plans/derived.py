"""Derived tables that outlive a session: computed by day, kept beside the snapshot, refreshed by the days that changed.

A snapshot's parts are never changed, so what follows from one part alone holds for good under that part's name.  A
derived table is a folder with a piece for each part; a version of the table is the pieces of the snapshot's parts.  A refresh gives the days
it touches new parts, and only their pieces are missing then; any session, on any machine, finds the others.
Sessions may compute the same pieces at the same time: each writes beside the table, and the first to give a piece its name wins.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from incidara.functions.bins import BIN_COLUMN, importance_bin
from incidara.operators import event_days
from incidara.roles import DEFAULT_BINS, BinSpec, Roles
from incidara.sources import snapshot

DERIVED = "derived"
_PART = "_incidara_part"
#: Every generation of event numbers that this divides holds all numbers again.
COMPACT = 32


class DerivedTables:
    """Tables that follow from the snapshot in ``directory``, of the version that is newest when this is made."""

    def __init__(self, spark: SparkSession, directory: str, roles: Roles, spec: BinSpec = DEFAULT_BINS):
        self.spark, self.directory, self.roles, self.spec = spark, directory, roles, spec
        self.metadata = snapshot.read_metadata(spark, directory)
        if self.metadata["time"] != roles.event_time:
            raise ValueError("derived tables need a snapshot that is kept by day")
        #: Pieces that this session has computed, by table.
        self.computed: dict[str, list[str]] = {}

    def _named(self, name: str, *columns: str) -> str:
        """A folder's name for what is derived with these columns, roles and bins; other ones have other folders."""
        told = json.dumps([name, columns, repr(self.roles), repr(self.spec)])
        return f"{name}-{hashlib.sha256(told.encode()).hexdigest()[:16]}"

    def _calls(self, parts: list[dict]) -> DataFrame:
        """Rows of parts with the part's name; rows before the cutoff are not among them."""
        spark, metadata = self.spark, self.metadata
        schema = StructType.fromJson(metadata["schema"])
        rows = snapshot._within(snapshot._read_parts(spark, self.directory, schema, parts), self.roles.event_time, metadata["cutoff"])
        names = {p["day"]: self._name(p) for p in parts}
        pairs = F.create_map(*[F.lit(x) for pair in (names or {"": ""}).items() for x in pair])  # one for each day
        return rows.withColumn(_PART, pairs[F.col(self.roles.event_time).cast("date").cast("string")])

    def _name(self, part: dict) -> str:
        """A part's name; the day of the cutoff holds fewer rows with each version, so it has the cutoff in it."""
        cutoff = self.metadata["cutoff"]
        edge = f"@{cutoff}" if cutoff and part["day"] == cutoff[:10] else ""
        return (part["path"] + edge).replace("/", "~").replace(":", "-").replace(" ", "_").replace("=", "-")

    def table(self, name: str, derive: Callable[[DataFrame], DataFrame], *columns: str) -> DataFrame:
        """The rows that ``derive`` makes of each day, with the pieces that are missing computed by one job.

        ``derive`` takes rows of whole days and keeps the column ``_incidara_part``, which says which of its rows belong together.
        ``name`` and ``columns`` stand for what it does, beside roles and bins: another function, or other parameters, need another name.
        """
        base = f"{self.directory}/{DERIVED}/{self._named(name, *columns)}"
        parts = [p for p in self.metadata["parts"] if p["day"] is not None]
        there = set(snapshot._names(self.spark, base))
        missing = [p for p in parts if f"{_PART}={self._name(p)}" not in there]
        self.computed["-".join([name, *columns])] = [p["day"] for p in missing]
        if missing:
            found = derive(self._calls(missing))
            staging = f"{base}/.{uuid.uuid4().hex}"
            found.hint("rebalance", _PART).write.partitionBy(_PART).parquet(staging)  # few files a day, a large day several
            for piece in snapshot._names(self.spark, staging):
                if piece.startswith(_PART):  # where another session was faster, its piece has the same rows
                    snapshot._rename_new(self.spark, f"{staging}/{piece}", f"{base}/{piece}")
            snapshot._delete(self.spark, staging)
            schema = found.schema
        else:
            schema = derive(self._calls(parts[:1])).schema
        wanted = [f"{base}/{_PART}={self._name(p)}" for p in parts]
        there = set(snapshot._names(self.spark, base))
        wanted = [w for w in wanted if w.rsplit("/", 1)[1] in there]  # a day of which nothing follows has no piece
        fields = StructType([f for f in schema.fields if f.name != _PART])
        return self.spark.read.schema(fields).parquet(*wanted) if wanted else self.spark.createDataFrame([], fields)

    def _generations(self, base: str) -> tuple[list[str], set[str]]:
        """Generations of numbers from the newest that holds all before it, and the parts whose events have numbers."""
        names = [n for n in snapshot._names(self.spark, base) if n.startswith("g")]
        if not names:
            return [], set()
        newest = int(names[-1][1:])
        names = [n for n in names if int(n[1:]) >= newest // COMPACT * COMPACT]
        files = self.spark.read.text([f"{base}/{n}/parts.json" for n in names], wholetext=True).collect()  # one small file for each
        return names, {p for r in files for p in json.loads(r["value"])}

    def numbers(self) -> DataFrame:
        """``event, number`` of every event so far; only parts that no session has numbered are read.

        Numbers come in generations, each written once.  Of two sessions that write the same one, the second
        starts again from what the first has numbered, so an event has one number and a number one event.
        """
        base, spark = f"{self.directory}/{DERIVED}/{self._named('event_numbers')}", self.spark
        parts = [p for p in self.metadata["parts"] if p["day"] is not None]
        while True:
            done, covered = self._generations(base)
            known = spark.read.parquet(*[f"{base}/{n}/numbers" for n in done]) if done else None
            missing = [p for p in parts if p["path"] not in covered]
            if known is not None and not missing:
                return known
            rows = snapshot._read_parts(spark, self.directory, StructType.fromJson(self.metadata["schema"]), missing)  # rows before the cutoff as well
            found = event_days.number_events(rows, self.roles, known)
            number = int(done[-1][1:]) + 1 if done else 1
            staging, names = f"{base}/.{uuid.uuid4().hex}", {p["path"] for p in missing}
            found.write.parquet(f"{staging}/numbers")
            if number % COMPACT == 0 and known is not None:
                known.write.mode("append").parquet(f"{staging}/numbers")
                names |= {p["path"] for p in parts} & covered
            snapshot._write_text(spark, f"{staging}/parts.json", json.dumps(sorted(names)))
            snapshot._rename_new(spark, staging, f"{base}/g{number:08}")

    def event_days(self, *groups: str) -> DataFrame:
        """Bitmaps of each day's events by ``groups`` (see ``operators.event_days``)."""
        numbers = self.numbers()
        derive = lambda rows: event_days.event_days(rows, numbers, self.roles, *groups, keep=[_PART])
        return self.table("event_days", derive, *groups)

    def volume(self, grain: str, *groups: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """Distinct events by week or month, from the bitmaps."""
        return event_days.volume(self.event_days(*groups), grain, *groups, start=start, end=end)

    def day_counts(self) -> DataFrame:
        """``day, event_importance_bin, dispatch_records``."""
        r = self.roles

        def derive(rows: DataFrame) -> DataFrame:
            binned = rows if BIN_COLUMN in rows.columns else rows.withColumn(BIN_COLUMN, importance_bin(F.col(r.category), self.spec))
            known = binned.filter(F.col(r.event_id).isNotNull())
            return known.groupBy(_PART, F.col(r.event_time).cast("date").alias("day"), BIN_COLUMN).agg(F.count(F.lit(1)).alias("dispatch_records"))

        return self.table("day_counts", derive)

    def latest_rows(self, *columns: str) -> DataFrame:
        """The latest row of each event, from the latest of each day; of rows of one time the one with the first row id and ties."""
        r = self.roles
        carried = list(dict.fromkeys([r.event_id, r.event_time, r.row_id, *r.ties, *columns]))

        def latest(rows: DataFrame, *keys: str) -> DataFrame:
            # what is greatest by time is least by the time before it
            order = F.struct((-F.unix_micros(F.col(r.event_time).cast("timestamp"))).alias("back"), r.row_id, *r.ties)
            return rows.groupBy(*keys, r.event_id).agg(F.min_by(F.struct(*carried), order).alias("row"))

        def derive(rows: DataFrame) -> DataFrame:
            known = rows.filter(F.col(r.event_id).isNotNull() & F.col(r.event_time).isNotNull())
            return latest(known, _PART).select(_PART, "row.*")

        return latest(self.table("latest_rows", derive, *columns)).select("row.*")


def remove_old_pieces(tables: DerivedTables) -> int:
    """Delete pieces of parts that the snapshot's version does not have; the number deleted.

    What sessions that were lost have left beside the tables goes as well, and numbers that a later generation holds
    again.  Call it when no session computes pieces or reads an older version.
    """
    spark, base = tables.spark, f"{tables.directory}/{DERIVED}"
    needed = {f"{_PART}={tables._name(p)}" for p in tables.metadata["parts"]}
    gone = 0
    for name in snapshot._names(spark, base):
        pieces = snapshot._names(spark, f"{base}/{name}")
        newest = max((int(n[1:]) for n in pieces if n.startswith("g")), default=0)
        for piece in pieces:
            if piece.startswith(_PART) and piece not in needed:
                gone += snapshot._delete(spark, f"{base}/{name}/{piece}")
            elif piece.startswith(".") or (piece.startswith("g") and int(piece[1:]) < newest // COMPACT * COMPACT):
                snapshot._delete(spark, f"{base}/{name}/{piece}")
    return gone
