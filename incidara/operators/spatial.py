"""Points in polygons: grid cells for the join, an exact test inside each cell.

A polygon is an array of rings (outer rings and holes alike), each an array of points ``x, y``.  A point is
within if a ray from it crosses the rings an odd number of times and it is on no edge.  Polygons are
dealt to grid cells by a quadtree, so the join is on the cell, whatever their number, and edges are looked at only near borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidara.functions.clean import clean_text, title_case
from incidara.operators.dedup import latest_per_key
from incidara.operators.schema import require_columns
from incidara.roles import CITY_BOX, Roles

RINGS = "array<array<struct<x:double,y:double>>>"


def in_box(df: DataFrame, roles: Roles, box: dict[str, tuple[float, float]] = CITY_BOX) -> DataFrame:
    """Rows inside the box, its edges included; rows without coordinates go."""
    return df.filter(F.col(roles.lat).between(*box["lat"]) & F.col(roles.lon).between(*box["lon"]))


def mappable_events(df: DataFrame, roles: Roles, box: dict[str, tuple[float, float]] = CITY_BOX) -> DataFrame:
    """The latest row of each event that has a time and lies in the box."""
    rows = in_box(df.filter(F.col(roles.event_id).isNotNull() & F.col(roles.event_time).isNotNull()), roles, box)
    return latest_per_key(rows, roles.event_id, roles.event_time, roles.row_id, *roles.ties)


def edges(rings: Column) -> Column:
    """All edges of the rings, each with its two ends; a ring that is open is closed."""
    ring_edges = lambda ring: F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.element_at(ring, F.when(i + 2 > F.size(ring), 1).otherwise(i + 2)).alias("b")))
    return F.flatten(F.transform(rings, ring_edges))


def _side(x: Column, y: Column, e: Column) -> Column:
    return (x - e["a"]["x"]) * (e["b"]["y"] - e["a"]["y"]) - (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"])


def is_on_edge(x: Column, y: Column, some_edges: Column) -> Column:
    between = lambda v, p, q: (v >= F.least(p, q)) & (v <= F.greatest(p, q))
    return F.exists(some_edges, lambda e: (_side(x, y, e) == 0) & between(x, e["a"]["x"], e["b"]["x"]) & between(y, e["a"]["y"], e["b"]["y"]))


def is_within(x: Column, y: Column, some_edges: Column, crossed: Column | int = 0) -> Column:
    """Whether the point is strictly inside; no division, so level edges need no care.

    ``some_edges`` are all edges, or those that a ray from the point to greater x can meet but for ``crossed`` that it does.
    """
    spans = lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y)
    crosses = lambda e: spans(e) & (F.when(e["b"]["y"] > e["a"]["y"], _side(x, y, e)).otherwise(-_side(x, y, e)) < 0)
    return ((F.size(F.filter(some_edges, crosses)) + crossed) % 2 == 1) & ~is_on_edge(x, y, some_edges)


def _bounds(rings: str, axis: str) -> tuple[Column, Column]:
    values = F.flatten(F.transform(rings, lambda ring: F.transform(ring, lambda p: p[axis])))
    return F.array_min(values), F.array_max(values)


def _conditions(size: float, beyond: float) -> tuple[str, str, str]:
    """How an edge ``e`` stands to a cell that is wider by ``beyond`` on each side: relevant to rays from it, in it, always crossed.

    As text: expressions of this depth take long to put together one by one.
    """
    x0, y0 = (f"(cell_{axis} * {size!r}D - {beyond!r}D)" for axis in "xy")
    x1, y1 = (f"(cell_{axis} * {size!r}D + {size!r}D + {beyond!r}D)" for axis in "xy")
    low, high = (lambda axis: f"least(e.a.{axis}, e.b.{axis})"), (lambda axis: f"greatest(e.a.{axis}, e.b.{axis})")
    relevant = f"{high('y')} >= {y0} AND {low('y')} <= {y1} AND {high('x')} >= {x0}"
    sides = ", ".join(f"({x} - e.a.x) * (e.b.y - e.a.y) - (e.b.x - e.a.x) * ({y} - e.a.y)" for x in (x0, x1) for y in (y0, y1))
    inside = f"{relevant} AND {low('x')} <= {x1} AND NOT (least({sides}) > 0 OR greatest({sides}) < 0)"
    return relevant, inside, f"{low('x')} > {x1} AND {low('y')} <= {y0} AND {high('y')} >= {y1}"


def _split(cells: DataFrame, size: float, beyond: float) -> DataFrame:
    """Cells of ``size``, each with the edges that matter in it; cells that no edge meets are decided, and those outside go."""
    relevant, inside, crossed = _conditions(size, beyond)
    now = cells.withColumn("edges", F.expr(f"IF(decided IS NULL, filter(edges, e -> {relevant}), edges)"))
    middle = is_within((F.col("cell_x") + 0.5) * F.lit(size), (F.col("cell_y") + 0.5) * F.lit(size), F.col("edges"), F.col("crossed"))
    now = now.withColumn("decided", F.when(F.expr(f"decided IS NULL AND NOT exists(edges, e -> {inside})"), middle).otherwise(F.col("decided")))
    now = now.filter("coalesce(decided, true)")
    always, rest = f"size(filter(edges, e -> {crossed}))", f"filter(edges, e -> NOT ({crossed}))"
    now = now.withColumn("crossed", F.expr(f"IF(decided IS NULL, crossed + {always}, crossed)"))
    return now.withColumn("edges", F.expr(f"IF(decided IS NULL, {rest}, NULL)"))


#: Halvings between the coarsest cells and the ones that points are dealt to.
LEVELS = 2


def polygon_cells(polygons: DataFrame, cell: float, levels: int = LEVELS) -> DataFrame:
    """``polygons`` (``objectid, rings``) once for each grid cell that they meet, as ``cell_x, cell_y, edges, crossed``.

    A quadtree: cells of ``2 ** levels`` times the size are halved where an edge goes through them.  A cell that lies
    in the polygon as a whole has null ``edges`` and needs no test; any other has the edges that a ray from a point in it to greater x can
    meet, without those that every such ray crosses, whose number is ``crossed``.
    """
    beyond, size = cell * 1e-6, cell * 2**levels
    spans = {}
    for axis in ("x", "y"):
        low, high = _bounds("rings", axis)
        spans |= {f"_low_{axis}": F.floor(low / size), f"_high_{axis}": F.floor(high / size)}
    boxed = polygons.withColumns({**spans, "edges": edges(F.col("rings")), "crossed": F.lit(0), "decided": F.lit(None).cast("boolean")}).drop("rings")
    cells = boxed.withColumn("cell_x", F.explode(F.sequence("_low_x", "_high_x"))).withColumn("cell_y", F.explode(F.sequence("_low_y", "_high_y"))).drop(*spans)
    cells = _split(cells, size, beyond)
    for _ in range(levels):
        size /= 2
        quarters = [F.struct((F.col("cell_x") * 2 + i).alias("x"), (F.col("cell_y") * 2 + k).alias("y")) for i in (0, 1) for k in (0, 1)]
        halved = cells.withColumn("_quarter", F.explode(F.array(*quarters)))
        cells = _split(halved.withColumns({"cell_x": F.col("_quarter.x"), "cell_y": F.col("_quarter.y")}).drop("_quarter"), size, beyond)
    return cells.drop("decided")


def containing(points: DataFrame, polygons: DataFrame, x: str, y: str, cell: float = 0.02) -> DataFrame:
    """``points`` beside each polygon that they are within; points in none do not appear."""
    gridded = points.withColumns({"cell_x": F.floor(F.col(x) / cell), "cell_y": F.floor(F.col(y) / cell)})
    met = gridded.join(polygon_cells(polygons, cell), ["cell_x", "cell_y"])
    inside = F.col("edges").isNull() | is_within(F.col(x), F.col(y), F.col("edges"), F.col("crossed"))
    return met.filter(inside).drop("cell_x", "cell_y", "edges", "crossed")


def lookup(points: DataFrame, polygons: DataFrame, key: str, x: str, y: str, *carry: str, cell: float = 0.02) -> DataFrame:
    """``key`` and ``carry`` (columns of the polygons) of every point: of the first polygon by objectid, or null."""
    found = containing(points.select(key, x, y), polygons, x, y, cell)
    first = found.groupBy(key).agg(F.min_by(F.struct(*carry), "objectid").alias("area"))
    return points.select(key).distinct().join(first, key, "left").select(key, *[F.col("area")[c].alias(c) for c in carry])


def extend_lookup(existing: DataFrame, points: DataFrame, polygons: DataFrame, key: str, x: str, y: str, *carry: str, cell: float = 0.02) -> DataFrame:
    """A stored lookup and, by anti-join, the points that it does not have yet."""
    new = points.join(existing.select(key), key, "left_anti")
    return existing.select(key, *carry).unionByName(lookup(new, polygons, key, x, y, *carry, cell=cell))


def normalise_polygons(raw: DataFrame, name: str = "mcpp_neighborhood", group: str = "mcpp_precinct") -> DataFrame:
    """``objectid, name, group, rings`` and display columns of a boundary table under either spelling.

    Column names are trimmed and lower-cased; without ``objectid`` the rows are numbered by name.
    """
    df = raw.toDF(*[c.strip().lower() for c in raw.columns])
    pick = {}
    for wanted in (name, group):
        short = wanted.rsplit("_", 1)[-1]
        if wanted not in df.columns and short not in df.columns:
            raise ValueError(f"polygons need {wanted!r} or {short!r}")
        pick[wanted] = clean_text(F.col(wanted if wanted in df.columns else short))
    require_columns(df, "rings")
    number = F.col("objectid").cast("bigint") if "objectid" in df.columns else F.row_number().over(Window.orderBy(pick[name], F.to_json("rings"))).cast("bigint")
    out = df.select(number.alias("objectid"), *[c.alias(n) for n, c in pick.items()], "rings")
    return out.withColumns({"plot_feature_id": F.col("objectid").cast("string"), f"{name}_display": title_case(F.col(name))})


def assignment_accuracy(labelled: DataFrame, label: str, area: str) -> DataFrame:
    """For each label: how many events lie in the area of that name, in any, or elsewhere."""
    same = F.coalesce(F.col(label) == F.col(area), F.lit(False))
    counted = labelled.filter(F.col(label).isNotNull()).groupBy(label)
    rows = counted.agg(
        F.count(F.lit(1)).alias("evaluated_events"),
        F.count_if(same).alias("correctly_labeled"),
        F.count_if(F.col(area).isNotNull()).alias("events_with_any_boundary"),
        F.count_if(~same).alias("incorrect_or_outside"),
    )
    percent = F.col("correctly_labeled") / F.col("evaluated_events") * F.lit(100)
    return rows.withColumn("pct_correctly_labeled", percent).orderBy("pct_correctly_labeled", label)


def accuracy_summary(by_label: DataFrame) -> DataFrame:
    """``metric, value, percentage`` over all labels."""
    totals = by_label.agg(*[F.sum(c).alias(c) for c in ("evaluated_events", "correctly_labeled", "events_with_any_boundary")])
    every = F.col("evaluated_events")
    metrics = [
        ("evaluated events", every),
        ("correctly labeled", F.col("correctly_labeled")),
        ("in a different boundary", F.col("events_with_any_boundary") - F.col("correctly_labeled")),
        ("outside all boundaries", every - F.col("events_with_any_boundary")),
    ]
    rows = [F.struct(F.lit(m).alias("metric"), v.alias("value"), F.try_divide(v * F.lit(100.0), every).alias("percentage")) for m, v in metrics]
    return totals.select(F.inline(F.array(*rows)))


def crosswalk(raw: DataFrame, json_column: str = "value") -> DataFrame:
    """``label, boundary`` pairs of a JSON object whose values are a name or a list of names."""
    pairs = raw.select(F.explode(F.from_json(json_column, "map<string,string>")).alias("label", "names"))
    names = F.when(F.col("names").startswith("["), F.from_json("names", "array<string>")).otherwise(F.array("names"))
    return pairs.select("label", F.explode(names).alias("boundary"))


def crosswalk_accuracy(labelled: DataFrame, pairs: DataFrame, label: str, area: str) -> DataFrame:
    """As ``assignment_accuracy``, where a label fits every boundary that the crosswalk has for it.

    ``pairs`` is ``label, boundary``; names are compared cleaned.
    """
    named = pairs.select(clean_text(F.col("label")).alias("_incidara_label"), clean_text(F.col("boundary")).alias("_incidara_area")).distinct()
    found = labelled.filter(F.col(label).isNotNull()).select(label, F.col(area).alias("_incidara_found"))
    matched = found.join(
        named.withColumn("_incidara_same", F.lit(True)),
        (clean_text(F.col(label)) == F.col("_incidara_label")) & (clean_text(F.col("_incidara_found")) == F.col("_incidara_area")),
        "left",
    )
    same = F.coalesce("_incidara_same", F.lit(False))
    rows = matched.groupBy(label).agg(F.count(F.lit(1)).alias("evaluated_events"), F.count_if(same).alias("correctly_labeled"))
    return rows.withColumn("pct_correctly_labeled", F.col("correctly_labeled") / F.col("evaluated_events") * F.lit(100)).orderBy("pct_correctly_labeled", label)
