"""The rolling snapshot: Parquet by day, and a metadata file that names what makes up each version.

A version is a list of parts, each a folder that is written once and never changed.  A snapshot that was saved with its time column
has one part a day (rows without a time make one too); a refresh writes the days that its batch touches and a new metadata file, and all
other days stay the files they are.  Metadata files are numbered; writing the next number is the commit, and fails if
another writer was faster.  Readers see one version or the other whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from incidara.operators.dedup import upsert_keep_last
from incidara.operators.schema import require_columns
from incidara.roles import OVERLAP_DAYS, RETENTION_DAYS, Roles

DATA, METADATA = "calls", "calls_metadata"
_KEYS = ("refreshed_at_utc", "source_start_date", "row_count", "columns", "version")
_DAY = "_incidara_day"
#: The folder of rows without a time.
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


# files


def _folder(spark: SparkSession, path: str):
    """A path of Hadoop's and its file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def _names(spark: SparkSession, path: str) -> list[str]:
    files, folder = _folder(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []


def _delete(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.delete(folder, True)


def _metadata_name(spark: SparkSession, directory: str) -> str | None:
    """The newest metadata file's name."""
    names = [n for n in _names(spark, f"{directory}/{METADATA}") if not n.startswith(("_", "."))]
    return names[-1] if names else None


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is not there yet."""
    files, target = _folder(spark, path)
    out = files.create(target, False)
    out.write(bytearray(text.encode()))
    out.close()


def _rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Give a file or folder its name, unless there is one of that name: then the source is deleted, and the answer is no."""
    files, old = _folder(spark, source)
    _, new = _folder(spark, target)
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), settings)
    try:  # unlike FileSystem's, this rename never replaces a file, nor moves a folder into one that is there
        context.rename(files.makeQualified(old), files.makeQualified(new), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception:
        files.delete(old, True)
        if files.exists(new):
            return False
        raise
    return True


def _commit(spark: SparkSession, directory: str, metadata: dict, after: str | None) -> str:
    """Write the metadata file that follows ``after``; an error if there is one already."""
    number = int(after[1:9]) + 1 if after and after.startswith("v") else 1
    name, hidden = f"v{number:08}.json", f"{directory}/{METADATA}/.{uuid.uuid4().hex}"
    _write_text(spark, hidden, json.dumps(metadata))
    if not _rename_new(spark, hidden, f"{directory}/{METADATA}/{name}"):
        raise RuntimeError(f"another writer has committed {name}; refresh again")
    return f"{directory}/{METADATA}"


# versions


def _write_parts(df: DataFrame, directory: str, version: str, time: str | None, row_id: str | None = None) -> list[dict]:
    """Write ``df`` as parts of a version; what each has.  With ``time`` a part is a day, in order of time."""
    base = f"{directory}/{DATA}/{version}"
    if time is None:
        df.write.parquet(base)
        return [{"day": None, "path": version, "rows": df.sparkSession.read.schema(df.schema).parquet(base).count(), "last": None}]
    order = [F.col(time).asc_nulls_last(), *([F.col(row_id)] if row_id else [])]
    dealt = df.withColumn(_DAY, F.col(time).cast("date")).repartitionByRange(*order).sortWithinPartitions(_DAY, *order)  # a large day is several files
    dealt.write.partitionBy(_DAY).parquet(base)
    names = [n for n in _names(df.sparkSession, base) if n.startswith(_DAY)]
    if not names:
        return []
    written = df.sparkSession.read.schema(dealt.schema).parquet(base)
    rows = written.groupBy(_DAY).agg(F.count(F.lit(1)).alias("rows"), F.max(time).cast("string").alias("last")).collect()  # a row for each day
    parts = []
    for r in rows:
        day = None if r[_DAY] is None else r[_DAY].isoformat()
        parts.append({"day": day, "path": f"{version}/{_DAY}={day or _NO_DAY}", "rows": r["rows"], "last": r["last"]})
    return sorted(parts, key=lambda p: p["day"] or "")


def _read_parts(spark: SparkSession, directory: str, schema: StructType, parts: list[dict]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{directory}/{DATA}/{p['path']}" for p in parts])


def _within(df: DataFrame, time: str, cutoff: str | None) -> DataFrame:
    return df if cutoff is None else df.filter(F.col(time) >= F.lit(cutoff).cast(df.schema[time].dataType))


def _described(spark, directory, schema, parts, version, time, cutoff, unique, source_start_date) -> dict:
    """The metadata of parts.  Only in the day of the cutoff rows are looked at."""
    edge = [p for p in parts if cutoff is not None and p["day"] == cutoff[:10]]
    rows = sum(p["rows"] for p in parts if p not in edge)
    if edge:
        rows += _within(_read_parts(spark, directory, schema, edge), time, cutoff).count()
    return {
        "refreshed_at_utc": datetime.now(UTC).isoformat(),
        "source_start_date": source_start_date,
        "row_count": rows,
        "columns": schema.names,
        "version": version,
        "schema": json.loads(schema.json()),
        "time": time,
        "cutoff": cutoff,
        "unique": unique,
        "parts": parts,
    }


def _rows(spark: SparkSession, directory: str, metadata: dict) -> DataFrame:
    """The rows of a version; whole days are not filtered."""
    schema, cutoff = StructType.fromJson(metadata["schema"]), metadata["cutoff"]
    edge = [p for p in metadata["parts"] if cutoff is not None and p["day"] == cutoff[:10]]
    whole = _read_parts(spark, directory, schema, [p for p in metadata["parts"] if p not in edge])
    return whole.unionByName(_within(_read_parts(spark, directory, schema, edge), metadata["time"], cutoff)) if edge else whole


def save_snapshot(
    df: DataFrame, directory: str, source_start_date: str | Callable[[DataFrame], str], time: str | None = None, row_id: str | None = None, unique: bool = False
) -> tuple[str, str]:
    """Write a new version of all rows and then its metadata.

    A write that is lost on the way leaves the previous version in place.  ``directory`` is on any file system that Spark
    writes to.  ``source_start_date`` is a date, or a function that gives it from the rows as written; an error of that function leaves the
    previous version in place as well.  With ``time`` the rows are kept by day.  ``unique`` says that no row id is there twice.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    after = _metadata_name(spark, directory)
    parts = _write_parts(df, directory, version, time, row_id)
    metadata = _described(spark, directory, df.schema, parts, version, time, None, unique, None)
    metadata["source_start_date"] = source_start_date(_rows(spark, directory, metadata)) if callable(source_start_date) else source_start_date
    return f"{directory}/{DATA}/{version}", _commit(spark, directory, metadata, after)


def read_metadata(spark: SparkSession, directory: str) -> dict:
    """What the newest version is made of."""
    name = _metadata_name(spark, directory)
    if name is None:
        raise FileNotFoundError(f"no snapshot in {directory}")
    rows = spark.read.text(f"{directory}/{METADATA}/{name}", wholetext=True).collect()  # one small file
    metadata = json.loads(rows[0]["value"]) if rows else None
    if not isinstance(metadata, dict) or any(k not in metadata for k in _KEYS):
        raise ValueError(f"metadata needs the keys {_KEYS}")
    return metadata


def load_snapshot(spark: SparkSession, directory: str) -> tuple[DataFrame, dict]:
    """The snapshot and its metadata; an error if rows or columns are not those that were written."""
    metadata = read_metadata(spark, directory)
    df = _rows(spark, directory, metadata)
    if df.columns != metadata["columns"]:
        raise ValueError(f"columns are {df.columns}, metadata has {metadata['columns']}")
    if (rows := df.count()) != metadata["row_count"]:
        raise ValueError(f"the snapshot has {rows} rows, metadata has {metadata['row_count']}")
    return df, metadata


def remove_old_versions(spark: SparkSession, directory: str) -> int:
    """Delete the parts and metadata files that the newest version does not need; the number of versions' folders that went whole.

    Call it when no write is under way and nothing reads an older version any more.
    """
    newest, needed = _metadata_name(spark, directory), {p["path"] for p in read_metadata(spark, directory)["parts"]}
    gone = 0
    for version in _names(spark, f"{directory}/{DATA}"):
        if not any(path == version or path.startswith(f"{version}/") for path in needed):
            gone += _delete(spark, f"{directory}/{DATA}/{version}")
        elif version not in needed:
            for name in _names(spark, f"{directory}/{DATA}/{version}"):
                if name.startswith(_DAY) and f"{version}/{name}" not in needed:
                    _delete(spark, f"{directory}/{DATA}/{version}/{name}")
    for name in _names(spark, f"{directory}/{METADATA}"):
        if name != newest:
            _delete(spark, f"{directory}/{METADATA}/{name}")
    return gone


# refreshes


def _touched(existing: DataFrame, fresh: DataFrame, roles: Roles) -> set[str | None]:
    """Days of fresh rows, and days that have a row of one of their ids; two columns are read, and a row for each day comes back."""
    day = F.col(roles.event_time).cast("date").cast("string").alias("day")
    ids = fresh.select(F.col(roles.row_id).alias("_incidara_id")).distinct()
    again = existing.select(day, roles.row_id).join(ids, F.col(roles.row_id).eqNullSafe(F.col("_incidara_id")), "left_semi").select("day")
    return {r["day"] for r in fresh.select(day).unionByName(again).distinct().collect()}


def _staying(stored: DataFrame, fresh: DataFrame, row_id: str) -> DataFrame:
    """Stored rows whose id no fresh row has; stored rows are not shuffled for a batch that can be broadcast."""
    ids = fresh.select(F.col(row_id).alias("_incidara_id"))
    return stored.join(ids, F.col(row_id).eqNullSafe(F.col("_incidara_id")), "left_anti")


def _one_each(rows: DataFrame, roles: Roles) -> DataFrame:
    """The latest row of each row id."""
    return upsert_keep_last(rows.limit(0), rows, roles.row_id, F.col(roles.event_time).desc_nulls_last(), *roles.ties)


def merge(spark: SparkSession, directory: str, fresh: DataFrame, roles: Roles, days: int = RETENTION_DAYS, source_start_date: str | None = None) -> tuple[str, str]:
    """Upsert ``fresh`` by row id and keep ``days`` days up to the latest time; days that this does not touch stay as they are.

    Rows without a time go, and days that are beyond the retention for certain are not written.  Rows without a row id count as one id.  A version that was saved without its time column or with ids twice, or whose
    columns change their types, is written anew once.  A batch that is run again gives the same rows.  ``source_start_date`` is the cutoff's day if not given.
    """
    after, metadata = _metadata_name(spark, directory), read_metadata(spark, directory)
    version = uuid.uuid4().hex
    old = StructType.fromJson(metadata["schema"])
    nothing = spark.createDataFrame([], old)
    require_columns(nothing, roles.row_id, roles.event_time)
    coming = f"{directory}/{DATA}/{version}-fresh"
    fresh.write.parquet(coming)  # it is read several times, and may come from far
    try:
        fresh = spark.read.schema(fresh.schema).parquet(coming)
        schema = nothing.unionByName(fresh.limit(0), allowMissingColumns=True).schema
        existing = _rows(spark, directory, metadata)
        same = all(schema[f.name].dataType == f.dataType for f in old.fields)
        daily = metadata["time"] == roles.event_time and metadata["unique"] and same
        if daily:
            touched = _touched(existing, fresh, roles)
            stay = [p for p in metadata["parts"] if p["day"] is not None and p["day"] not in touched]
        else:
            stay = []
        changing = _rows(spark, directory, metadata | {"parts": [p for p in metadata["parts"] if p not in stay]}) if stay else existing
        changing, coming_rows = changing.unionByName(fresh.limit(0), allowMissingColumns=True), existing.limit(0).unionByName(fresh, allowMissingColumns=True)  # of one schema
        latest = coming_rows.select(roles.event_time)  # the latest fresh row stays whatever its id, so what is too old beside it, or beside a day that stays, is not written
        if not daily:  # all days are new, and no part tells its last row
            latest = latest.unionByName(_staying(changing, coming_rows, roles.row_id).select(roles.event_time))
        latest = latest.agg(F.max(roles.event_time).cast("string").alias("latest")).first()["latest"]
        sure = [datetime.fromisoformat(x) for x in (latest, *(p["last"] for p in stay)) if x]
        oldest = (max(sure) - timedelta(days=days)).isoformat(sep=" ") if sure else None
        # of an id the latest row counts, so older ones may go before it is found
        kept = _staying(_within(changing, roles.event_time, oldest), coming_rows, roles.row_id)
        if not (metadata["unique"] and same):
            kept = _one_each(kept, roles)
        rows = kept.unionByName(_within(_one_each(coming_rows, roles), roles.event_time, oldest))
        parts = _write_parts(rows.filter(F.col(roles.event_time).isNotNull()).select(*schema.names), directory, version, roles.event_time, roles.row_id)
    finally:
        _delete(spark, coming)
    lasts = [datetime.fromisoformat(p["last"]) for p in stay + parts if p["last"]]
    if not lasts:
        raise ValueError("no row has a time")
    cutoff = max(lasts) - timedelta(days=days)
    parts = sorted((p for p in stay + parts if date.fromisoformat(p["day"]) >= cutoff.date()), key=lambda p: p["day"])
    start = source_start_date or cutoff.date().isoformat()
    metadata = _described(spark, directory, schema, parts, version, roles.event_time, cutoff.isoformat(sep=" "), True, start)
    return f"{directory}/{DATA}/{version}", _commit(spark, directory, metadata, after)


def incremental_refresh(spark: SparkSession, directory: str, fetch, roles: Roles, days: int = RETENTION_DAYS, overlap_days: int = OVERLAP_DAYS) -> tuple[str, str]:
    """Fetch what is new since ``overlap_days`` before the latest row, and merge it.

    ``fetch`` takes a start date and gives a table.
    """
    metadata = read_metadata(spark, directory)
    existing = _rows(spark, directory, metadata)
    require_columns(existing, roles.row_id, roles.event_time)
    if metadata["time"] == roles.event_time:  # the metadata knows
        last = max((p["last"] for p in metadata["parts"] if p["last"]), default=None)
        latest = None if last is None else datetime.fromisoformat(last).date()
    else:
        latest = existing.agg(F.max(roles.event_time).cast("date").alias("latest")).first()["latest"]
    if latest is None:
        raise ValueError("no row of the snapshot has a time")
    return merge(spark, directory, fetch((latest - timedelta(days=overlap_days)).isoformat()), roles, days)


def full_refresh(directory: str, fetch, start_date: str, roles: Roles | None = None, by_day: bool = False) -> tuple[str, str]:
    """Fetch everything from ``start_date`` on; with ``roles``, one row of each row id stays.

    ``by_day`` keeps the rows by day at once; else the first refresh does so with the days that it retains.
    """
    rows = fetch(start_date)
    if roles is None:
        return save_snapshot(rows, directory, start_date)
    rows = _one_each(rows, roles)
    return save_snapshot(rows, directory, start_date, *((roles.event_time, roles.row_id) if by_day else ()), unique=True)
