"""Chart specifications as plain dictionaries, one trace for each series of a small result table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidara.functions.bins import BIN_COLORS, BIN_COLUMN, OTHER_COLOR, combo_color, combo_label
from incidara.roles import Roles
from incidara.sources.tables import feature_collection

#: How near a map starts: a city fills it.
ZOOM = 10


def _columns(df: DataFrame, *names: str) -> dict[str, list]:
    rows = df.select(*names).collect()  # aggregated: a row for each mark of a chart
    return {n: [r[n] for r in rows] for n in names}


def bar(df: DataFrame, x: str, y: str, title: str) -> dict:
    data = _columns(df, x, y)
    return {"data": [{"type": "bar", "x": data[x], "y": data[y]}], "layout": {"title": title}}


def daily_chart(series: DataFrame, selected: Sequence[str]) -> dict:
    data = _columns(series, "date", "unique_call_events", "dispatch_records", "rolling_7_day_avg")
    days = [d.isoformat() for d in data["date"]]
    traces = [
        {"type": "scatter", "mode": "lines", "name": "Unique events", "x": days, "y": data["unique_call_events"], "customdata": data["dispatch_records"], "line": {"color": combo_color(list(selected))}},
        {"type": "scatter", "mode": "lines", "name": "7-day average", "x": days, "y": data["rolling_7_day_avg"]},
    ]
    return {"data": traces, "layout": {"title": combo_label(list(selected))}}


def _said(value: float | None, unit: str, digits: int = 1) -> str:
    return f"{'n/a' if value is None else round(value, digits)}{unit}"


def _guides(guides: DataFrame) -> tuple[list[dict], list[dict]]:
    """Lines at the medians of both axes, from end to end of the other, and their names."""
    row = guides.first()
    if row is None or row["volume_median"] is None:
        return [], []
    x, y = row["volume_median"], row["response_median"]
    line = {"type": "line", "line": {"dash": "dash", "width": 1}}
    shapes = [line | {"x0": x, "x1": x, "y0": row["response_min"], "y1": row["response_max"]}, line | {"x0": row["volume_min"], "x1": row["volume_max"], "y0": y, "y1": y}]
    notes = [{"x": x, "y": row["response_max"], "text": "Median volume", "showarrow": False}, {"x": row["volume_max"], "y": y, "text": "Median response", "showarrow": False}]
    return shapes, notes


def scatter_chart(rates: DataFrame, place: str, selected: Sequence[str], guides: DataFrame | None = None) -> dict:
    """Places by rate and response time, a trace for each bin; ``guides`` (see ``guide_lines``) draws the medians."""
    names = (place, BIN_COLUMN, "annual_events_per_1000", "median_response_minutes", "concern_score", "marker_size")
    data = _columns(rates, *names)
    if not data[place]:
        return {"data": [], "layout": {"title": "No places with enough events"}}
    traces = []
    for name in selected:
        mine = [k for k, b in enumerate(data[BIN_COLUMN]) if b == name]
        pick = lambda column, mine=mine: [data[column][k] for k in mine]
        marker = {"size": pick("marker_size"), "color": BIN_COLORS.get(name, OTHER_COLOR)}
        hover = ["<br>".join([str(data[place][k]), name, _said(data[names[2]][k], " events per 1,000 a year"), _said(data[names[3]][k], " minutes"), _said(data[names[4]][k], " concern", 2)]) for k in mine]
        traces.append({"type": "scatter", "mode": "markers", "name": name, "x": pick("annual_events_per_1000"), "y": pick("median_response_minutes"), "text": pick(place), "hovertext": hover, "hoverinfo": "text", "marker": marker})
    shapes, notes = _guides(guides) if guides is not None else ([], [])
    return {"data": [t for t in traces if t["x"]], "layout": {"title": combo_label(list(selected)), "shapes": shapes, "annotations": notes}}


def empty_map(title: str = "No calls in this selection", zoom: float = ZOOM) -> dict:
    return {"data": [], "layout": {"title": title, "mapbox": {"style": "open-street-map", "zoom": zoom}}}


def map_chart(
    rates: DataFrame, points: DataFrame, roles: Roles, area: str, selected: Sequence[str], most: int = 50_000, show_colorbar: bool = False, zoom: float = ZOOM
) -> dict:
    """Rates by polygon as a choropleth below the calls as markers, a layer for each bin.

    ``rates`` and ``points`` are those of ``operators.choropleth``; ``show_colorbar`` shows the scale of the rates.  More than ``most`` points are an error: a browser
    cannot draw them, and the driver would have to hold them.
    """
    figures = _columns(rates, "plot_feature_id", area, "past_year_unique_events_per_1000", "selected_median_response_minutes")
    says = F.concat_ws("<br>", "event_time_display", f"{area}_display", "past_year_events_per_1000_display", "median_response_display")
    shown = points.select(F.col(roles.lon).alias("lon"), F.col(roles.lat).alias("lat"), BIN_COLUMN, says.alias("text"))
    found = shown.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} points: choose fewer days")
    if not figures["plot_feature_id"] and not found:
        return empty_map(zoom=zoom)
    known = [k for k, value in enumerate(figures["past_year_unique_events_per_1000"]) if value is not None]
    pick = lambda column: [figures[column][k] for k in known]
    layers = [
        {
            "type": "choroplethmapbox", "name": "Events per 1,000 a year", "geojson": feature_collection(rates, "plot_feature_id", area),
            "featureidkey": "properties.plot_feature_id", "locations": pick("plot_feature_id"), "z": pick("past_year_unique_events_per_1000"), "text": pick(area),
            "customdata": pick("selected_median_response_minutes"), "marker": {"opacity": 0.5},
            "showscale": show_colorbar, "colorbar": {"title": "Events per 1,000 a year"},
        }
    ]
    for name in selected:
        mine = [r for r in found if r[BIN_COLUMN] == name]
        if mine:
            marker = {"size": 6, "color": BIN_COLORS.get(name, OTHER_COLOR)}
            layers.append({"type": "scattermapbox", "mode": "markers", "name": name, "lon": [r["lon"] for r in mine], "lat": [r["lat"] for r in mine], "text": [r["text"] for r in mine], "marker": marker})
    center = {axis: sum(r[axis] for r in found) / len(found) for axis in ("lon", "lat")} if found else None
    return {"data": layers, "layout": {"title": combo_label(list(selected)), "mapbox": {"style": "open-street-map", "zoom": zoom} | ({"center": center} if center else {})}}


def count_points(chart: dict) -> int:
    """Points of all marker layers of a map."""
    return sum(len(t.get("lat") or ()) for t in chart["data"] if t.get("type") == "scattermapbox")
