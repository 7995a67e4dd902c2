"""A paged REST table as a Spark data source.

``spark.read.format("paged_rest").option("endpoint", url).schema(...).load()``.  The endpoint takes
``$select, $where, $group, $order, $limit, $offset`` and gives a JSON list of objects.  Projection is the schema; comparisons of the
time column are pushed to the endpoint; and the time range, whose open ends are asked of the endpoint, is cut into
windows, one for each partition, so pages of different windows are fetched by different tasks and a window that is lost
is fetched again alone.

Windows have about equally many rows: the endpoint counts its rows by day, days with too many by hour, such hours by minute.
A page begins behind the last row of the one before, by time and row id, so a deep page costs what the first one does,
and rows that come or go meanwhile move no others into a page or out of one.
"""

from __future__ import annotations

import http.client
import json
import time as clock
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import TimestampNTZType

from incidara.functions.calendar import iso_date, time_literal
from incidara.operators.schema import CALL_COLUMNS, conform
from incidara.roles import Roles
from incidara.shipping import ship


def positive(value, name: str, kind: type | tuple = int):
    if isinstance(value, bool) or not isinstance(value, kind) or value <= 0:
        raise ValueError(f"{name} is a positive number")
    return value


def page_parameters(columns: list[str], time: str, row_id: str, where: list[str], limit: int, offset: int) -> dict[str, str]:
    """Query parameters of one page: only the columns, only the rows, in a definite order."""
    positive(limit, "limit")
    if isinstance(offset, bool) or not isinstance(offset, int) or offset < 0:
        raise ValueError("offset is a number not below 0")
    found = {"$select": ",".join(columns), "$order": f"{time} DESC,{row_id}", "$limit": str(limit), "$offset": str(offset)}
    return found | ({"$where": " AND ".join(where)} if where else {})


#: Answers after which the same request may succeed: the endpoint is busy, or something before it is.
PASSING = frozenset({408, 425, 429, 500, 502, 503, 504})
#: How often a request is made again, and the seconds before the first time; they double, up to the longest.
RETRIES, PAUSE, LONGEST = 4, 0.5, 30.0


def _pause(error: Exception, attempt: int) -> float | None:
    """Seconds to wait before a request that failed is made again; None if that is no use."""
    usual = min(PAUSE * 2**attempt, LONGEST)
    if isinstance(error, urllib.error.HTTPError):
        if error.code not in PASSING:
            return None
        asked = (error.headers.get("Retry-After") or "") if error.headers else ""
        return min(max(usual, float(asked)), LONGEST) if asked.isdigit() else usual
    return usual


def fetch_page(endpoint: str, parameters: dict[str, str], timeout: float = 10.0, retries: int = RETRIES) -> list[dict]:
    """Records of one page; an error unless the answer is a list of objects.

    A request that meets a busy or unreachable endpoint is made again after a pause, up to ``retries`` times, so a hiccup costs a task one
    page and not its window.
    """
    positive(timeout, "timeout", (int, float))
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(f"{endpoint}?{urllib.parse.urlencode(parameters)}", timeout=timeout) as answer:  # noqa: S310
                records = json.load(answer)
            break
        except (OSError, http.client.IncompleteRead) as error:  # HTTP errors, time-outs and lost connections are OSErrors
            pause = _pause(error, attempt)
            if pause is None or attempt == retries:
                raise
            clock.sleep(pause)
    if not isinstance(records, list) or not all(isinstance(r, dict) for r in records):
        raise ValueError("the endpoint's answer is no list of objects")
    return records


def fetch_bounds(endpoint: str, time: str, event: str | None = None, where: list[str] | None = None, timeout: float = 10.0) -> tuple[datetime | None, datetime | None]:
    """First and last time of the endpoint's rows that have one (and an event), by one request; it aggregates them itself."""
    needed = [f"{c} IS NOT NULL" for c in (time, event) if c] + (where or [])
    records = fetch_page(endpoint, {"$select": f"min({time}) AS min_time,max({time}) AS max_time", "$where": " AND ".join(needed)}, timeout)
    found = [(records[0].get(name) if records else None) for name in ("min_time", "max_time")]
    return tuple(datetime.fromisoformat(str(v)).replace(tzinfo=None) if v else None for v in found)


def quoted(value) -> str:
    """A text literal of the endpoint's language."""
    return "'" + str(value).replace("'", "''") + "'"


def behind(keys: list[tuple[str, str, object]]) -> str:
    """Condition for rows that come after given ones: ``(column, sign, value)`` for each column of the order."""
    column, sign, value = keys[0]
    after = f"{column} {sign} {quoted(value)}"
    return after if len(keys) == 1 else f"({after} OR ({column} = {quoted(value)} AND {behind(keys[1:])}))"


def fetch_counts(endpoint: str, period: str, where: list[str], timeout: float = 10.0) -> list[tuple[str, int]]:
    """The endpoint's rows for each value of the expression ``period``, in its order, by one request."""
    parameters = {"$select": f"{period} AS period,count(*) AS rows", "$group": "period", "$order": "period", "$limit": "1000000"}
    records = fetch_page(endpoint, parameters | ({"$where": " AND ".join(where)} if where else {}), timeout)
    return [(str(r["period"]), int(r["rows"])) for r in records if r.get("period") is not None]


def balanced(units: list[tuple[datetime, int]], windows: int) -> list[int]:
    """Places at which to cut ``units`` (begin and rows) into so many windows of about the same rows."""
    total, so_far, cuts = sum(n for _, n in units), 0, []
    for k, (_, n) in enumerate(units):
        if k and len(cuts) < windows - 1 and so_far + n / 2 >= (len(cuts) + 1) * total / windows:  # the nearer of this unit's borders
            cuts.append(k)
        so_far += n
    return cuts


@dataclass
class Window(InputPartition):
    start: str | None
    end: str | None


class PagedReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        defaults = Roles()
        self.columns = [f.name for f in schema.fields]
        self.times = {f.name for f in schema.fields if isinstance(f.dataType, TimestampNTZType)}
        self.endpoint = options["endpoint"]
        self.time = options.get("timeColumn", defaults.event_time)
        self.row_id = options.get("rowIdColumn", defaults.row_id)
        self.page_size = positive(int(options.get("pageSize", 5000)), "pageSize")
        self.max_pages = positive(int(options["maxPages"]), "maxPages") if options.get("maxPages") else None
        self.timeout = positive(float(options.get("timeout", 20)), "timeout", float)
        self.days = positive(int(options["windowDays"]), "windowDays") if options.get("windowDays") else None
        self.rows = positive(int(options.get("windowRows", 50_000)), "windowRows")
        self.start, self.end = options.get("start"), options.get("end")
        self.distinct = options.get("distinct", "false").lower() == "true"
        self.where: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of the time column go to the endpoint; Spark applies all filters again."""
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in signs and f.attribute == (self.time,) and isinstance(f.value, datetime):
                self.where.append(f"{self.time} {signs[type(f)]} '{f.value.isoformat(timespec='milliseconds')}'")
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.start = max(filter(None, (self.start, f.value.date().isoformat())))
                else:
                    after = (f.value + timedelta(days=1)).date().isoformat()
                    self.end = min(filter(None, (self.end, after)))
            yield f

    def partitions(self) -> list[InputPartition]:
        if self.start is None or self.end is None:  # one request finds what is missing
            first, last = fetch_bounds(self.endpoint, self.time, where=self.where, timeout=self.timeout)
            if first is None:
                return [Window(self.start, self.end)]
            self.start = self.start or first.date().isoformat()
            self.end = self.end or (last + timedelta(days=1)).date().isoformat()
        begin, end = datetime.fromisoformat(self.start), datetime.fromisoformat(self.end)
        if begin >= end:
            return [Window(self.end, self.end)]
        if self.days is None:
            edges = [begin, *self._balanced_edges(begin, end), end]
        else:
            edges = [begin + timedelta(days=k) for k in range(0, (end - begin).days + 1, self.days)]
            edges = [e for e in edges if e < end] + [end]
        return [Window(time_literal(a), time_literal(b)) for a, b in zip(edges, edges[1:], strict=False)]

    def _counted(self, begin: datetime, end: datetime, level: int, most: float | None) -> list[tuple[datetime, int]]:
        """Begins and rows of the days from ``begin`` on (level 0), a day's hours (1) or an hour's minutes (2), finer where one has over ``most``."""
        where = [*self.where, f"{self.time} >= {quoted(time_literal(begin))}", f"{self.time} < {quoted(time_literal(end))}"]
        period = (f"date_trunc_ymd({self.time})", f"date_extract_hh({self.time})", f"date_extract_mm({self.time})")[level]
        found, step = [], (timedelta(days=1), timedelta(hours=1), timedelta(minutes=1))[level]
        for name, rows in fetch_counts(self.endpoint, period, where, self.timeout):
            at = max(begin, datetime.fromisoformat(name).replace(tzinfo=None)) if not level else begin + int(float(name)) * step
            found.append((at, rows))
        if most is None:
            most = sum(n for _, n in found) / max(1, -(-sum(n for _, n in found) // self.rows)) / 4
        out = []
        for at, rows in sorted(found):
            finer = rows > most and level < 2
            out += self._counted(at, min(at.replace(hour=0, minute=0, second=0) + step if not level else at + step, end), level + 1, most) if finer else [(at, rows)]
        return out

    def _balanced_edges(self, begin: datetime, end: datetime) -> list[datetime]:
        units = self._counted(begin, end, 0, None)
        return [units[k][0] for k in balanced(units, -(-sum(n for _, n in units) // self.rows)) if begin < units[k][0] < end]

    def _value(self, column: str, value):
        if value is None or column not in self.times:
            return None if value is None else str(value)
        try:
            return datetime.fromisoformat(str(value).strip()).replace(tzinfo=None)
        except ValueError:
            return None

    def read(self, partition: Window) -> Iterator[tuple]:
        where = list(self.where)
        if partition.start is not None:
            where.append(f"{self.time} >= '{time_literal(partition.start)}'")
        if partition.end is not None:
            where.append(f"{self.time} < '{time_literal(partition.end)}'")
        columns = list(dict.fromkeys([*self.columns, *([] if self.distinct else [self.time, self.row_id])]))
        if self.distinct:  # rows without a group come last, by themselves, so the order never has a missing value
            event, *group = self.columns
            streams = [([f"{c} IS NOT NULL" for c in self.columns], [(c, ">") for c in self.columns])]
            streams += [([f"{event} IS NOT NULL", f"{c} IS NULL"], [(event, ">")]) for c in group]
        else:
            streams = [([], [(self.time, "<"), (self.row_id, ">")])]
        left = self.max_pages
        for conditions, order in streams:
            seek, beyond = [], 0
            while left is None or left > 0:
                parameters = page_parameters(columns, self.time, self.row_id, [*where, *conditions, *seek], self.page_size, beyond)
                if self.distinct:  # the endpoint folds equal rows
                    parameters |= {"$select": f"DISTINCT {parameters['$select']}", "$order": ",".join(c for c, _ in order)}
                records = fetch_page(self.endpoint, parameters, self.timeout)
                for record in records:
                    yield tuple(self._value(c, record.get(c)) for c in self.columns)
                left = None if left is None else left - 1
                if len(records) < self.page_size:
                    break
                last = [(c, sign, records[-1].get(c)) for c, sign in order]
                if all(value is not None for _, _, value in last):
                    seek, beyond = [behind(last)], 0
                else:  # the row names no place to go on from
                    beyond += len(records)


class PagedRest(DataSource):
    """Times are times, every other column is text; ``read_calls`` gives it its type."""

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return ", ".join(f"{name} {'timestamp_ntz' if kind == 'time' else 'string'}" for name, kind in CALL_COLUMNS.items())

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, self.options)


def read_calls(spark: SparkSession, endpoint: str, start_date: str, end_date: str | None = None, **options) -> DataFrame:
    """The feed from ``start_date`` on, cleaned and typed.  Lets the session push filters to Python sources."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedRest)
    settings = {"endpoint": endpoint, "start": iso_date(start_date)} | ({"end": iso_date(end_date)} if end_date else {})
    return conform(spark.read.format("paged_rest").options(**settings, **{k: str(v) for k, v in options.items()}).load())


def read_distinct(spark: SparkSession, endpoint: str, start_date: str, end_date: str | None = None, group_by: str | None = None, event: str = Roles().event_id, **options) -> DataFrame:
    """Different events (and groups) of ``[start_date, end_date)``: the endpoint folds them window by window, Spark across windows."""
    ship(spark)
    spark.dataSource.register(PagedRest)
    columns = [event] + ([group_by] if group_by else [])
    settings = {"endpoint": endpoint, "start": iso_date(start_date), "distinct": "true"} | ({"end": iso_date(end_date)} if end_date else {})
    rows = spark.read.format("paged_rest").schema(", ".join(f"{c} string" for c in columns)).options(**settings, **{k: str(v) for k, v in options.items()}).load()
    return rows.filter(F.col(event).isNotNull()).distinct()


def sample(spark: SparkSession, endpoint: str, limit: int = 25, timeout: float = 10.0) -> DataFrame:
    """A few records as they are, one JSON object in each row."""
    records = fetch_page(endpoint, {"$limit": str(positive(limit, "limit"))}, timeout)
    return spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
