"""Date ranges that a reader of the charts chooses; small values on the driver."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidara.roles import RECENT_DAYS, Roles


def clean_date(value) -> str | None:
    """``yyyy-mm-dd`` of a date or time in text or object; None for what is neither."""
    if value is None:
        return None
    if isinstance(value, (datetime, date)):
        return value.strftime("%Y-%m-%d")
    try:
        return datetime.fromisoformat(str(value).strip()).strftime("%Y-%m-%d")
    except ValueError:
        return None


def default_range(df: DataFrame, roles: Roles) -> tuple[str, str]:
    """The latest day and the 29 before it."""
    last = df.agg(F.max(roles.event_time).cast("date").alias("last")).first()["last"]
    if last is None:
        raise ValueError("no event has a time")
    return (last - timedelta(days=RECENT_DAYS)).isoformat(), last.isoformat()


def chosen_range(start, end, default: tuple[str, str]) -> tuple[str, str]:
    found = clean_date(start), clean_date(end)
    return default if None in found else found


def visible_range(change: Mapping | None, default: tuple[str, str]) -> tuple[str, str]:
    """Range of a chart's zoom event, in either of its spellings; the default if it has none."""
    if not change or change.get("xaxis.autorange") is True:
        return default
    if "xaxis.range[0]" in change and "xaxis.range[1]" in change:
        return chosen_range(change["xaxis.range[0]"], change["xaxis.range[1]"], default)
    both = change.get("xaxis.range")
    return chosen_range(both[0], both[1], default) if isinstance(both, list) and len(both) >= 2 else default


def stored_range(stored: Mapping | None, default: tuple[str, str]) -> tuple[str, str]:
    return chosen_range(stored.get("start"), stored.get("end"), default) if stored else default
