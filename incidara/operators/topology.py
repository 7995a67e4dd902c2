"""Which rings of a multipolygon are shells, and which holes are in which shell.

Rings of a valid multipolygon do not cross, so they nest like boxes: a ring in an even number of others is a shell (an
island in a hole is one again), any other a hole of the innermost ring around it.  Whatever parts a file had, and in what
order, its rings alone say how they belong together.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from incidara.operators.spatial import edges, is_on_edge, is_within


def closed(ring: Column) -> Column:
    """The ring with its first point once more at the end, if it is not there."""
    first, last = ring[0], F.element_at(ring, -1)
    same = (first["x"] == last["x"]) & (first["y"] == last["y"])
    return F.when((F.size(ring) > 0) & ~same, F.concat(ring, F.array(first))).otherwise(ring)


def twice_area(ring: Column) -> Column:
    """Twice the area of a ring, negative if it runs clockwise."""
    each = F.transform(edges(F.array(ring)), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.aggregate(each, F.lit(0.0), lambda total, v: total + v)


def ring_within(inner: Column, outer: Column) -> Column:
    """Whether one ring lies in another that it does not cross; they may touch.

    Any corner or middle of an edge that is not on the other ring tells.  If all are, the smaller one is within.
    """
    around = edges(F.array(outer))
    middles = F.transform(edges(F.array(inner)), lambda e: F.struct(((e["a"]["x"] + e["b"]["x"]) / 2).alias("x"), ((e["a"]["y"] + e["b"]["y"]) / 2).alias("y")))
    corners = F.transform(inner, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    telling = F.filter(F.concat(corners, middles), lambda p: ~is_on_edge(p["x"], p["y"], around))
    one = F.try_element_at(telling, F.lit(1))
    return F.when(F.size(telling) > 0, is_within(one["x"], one["y"], around)).otherwise(F.abs(twice_area(inner)) < F.abs(twice_area(outer)))


def polygons_of(rings: Column) -> Column:
    """The rings as polygons: an array of shells in their order, each followed by its holes."""
    numbered = F.transform(rings, lambda ring, i: F.struct(i.alias("i"), ring.alias("ring")))
    around = F.transform(
        numbered,
        lambda r: F.struct(
            r["i"].alias("i"),
            r["ring"].alias("ring"),
            F.transform(F.filter(numbered, lambda o: (o["i"] != r["i"]) & ring_within(r["ring"], o["ring"])), lambda o: o["i"]).alias("around"),
        ),
    )
    shells = F.filter(around, lambda r: F.size(r["around"]) % 2 == 0)
    holes_of = lambda s: F.filter(around, lambda r: (F.size(r["around"]) == F.size(s["around"]) + 1) & F.array_contains(r["around"], s["i"]))
    return F.transform(shells, lambda s: F.concat(F.array(s["ring"]), F.transform(holes_of(s), lambda h: h["ring"])))
