"""Polygons as columns: an array of rings, each an array of (x, y), the first one the outline, the others holes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def point(x: Column | float, y: Column | float) -> Column:
    return F.struct((x if isinstance(x, Column) else F.lit(x)).cast("double").alias("x"), (y if isinstance(y, Column) else F.lit(y)).cast("double").alias("y"))


def ring(*points: tuple) -> Column:
    return F.array(*[point(x, y) for x, y in points])


def polygon(*rings: Column) -> Column:
    return F.array(*rings)


def l_shape(x0: Column, y0: Column, arm: Column, width: Column) -> Column:
    """An L of two arms: the crown outlines of the survey fixtures."""
    return polygon(ring((x0, y0), (x0 + arm, y0), (x0 + arm, y0 + width), (x0 + width, y0 + width), (x0 + width, y0 + arm), (x0, y0 + arm)))


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return polygon(ring((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)))


def edges(r: Column) -> Column:
    """Pairs of neighbouring points of a ring, the last one closed to the first."""
    return F.transform(r, lambda p, i: F.struct(p.alias("a"), F.get(r, F.pmod(i + 1, F.size(r))).alias("b")))


def ring_area(r: Column) -> Column:
    return F.abs(F.aggregate(edges(r), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def area(g: Column) -> Column:
    """Of the outline without its holes."""
    return F.aggregate(F.transform(g, lambda r, i: F.when(i == 0, ring_area(r)).otherwise(-ring_area(r))), F.lit(0.0), lambda s, a: s + a)


def bbox(g: Column) -> Column:
    xs, ys = F.transform(g[0], lambda p: p["x"]), F.transform(g[0], lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def padded(b: Column, pad: float) -> Column:
    return F.struct((b["xmin"] - pad).alias("xmin"), (b["ymin"] - pad).alias("ymin"), (b["xmax"] + pad).alias("xmax"), (b["ymax"] + pad).alias("ymax"))


def envelope(g: Column) -> Column:
    """The box around a polygon, as a polygon."""
    b = bbox(g)
    return box(b["xmin"], b["ymin"], b["xmax"], b["ymax"])


def contains_point(g: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings: points in holes are outside."""
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
    count = lambda r: F.size(F.filter(edges(r), lambda e: F.coalesce(crosses(e), F.lit(False))))
    return F.aggregate(F.transform(g, count), F.lit(0), lambda s, n: s + n) % 2 == 1


def within_box(g: Column, xmin, ymin, xmax, ymax) -> Column:
    b = bbox(g)
    return (b["xmin"] >= xmin) & (b["ymin"] >= ymin) & (b["xmax"] <= xmax) & (b["ymax"] <= ymax)


def largest_part(parts: Column) -> Column:
    """Of an array of polygons the one of the greatest area, the first of equals; null of null or none."""
    ranked = F.transform(parts, lambda g, i: F.struct(area(g).alias("area"), (-i).alias("order"), g.alias("part")))
    return F.array_max(ranked)["part"]


def first_polygon(parts: Column) -> Column:
    """Of a collection of (kind, rings) the first polygon; null if it has none."""
    return F.get(F.filter(parts, lambda p: p["kind"] == "Polygon"), F.lit(0))["rings"]


def map_points(g: Column, f) -> Column:
    return F.transform(g, lambda r: F.transform(r, f))


def to_pixels(g: Column, xmin: Column, ymin: Column, res: float) -> Column:
    return map_points(g, lambda p: point((p["x"] - xmin) / res, (p["y"] - ymin) / res))


def prompt_box(b: Column, xmin: float, ymax: float, res: float) -> Column:
    """A map box as the pixel box of a raster; rows count downwards, so top and bottom change places."""
    return F.struct(((b["xmin"] - xmin) / res).alias("left"), ((ymax - b["ymax"]) / res).alias("top"), ((b["xmax"] - xmin) / res).alias("right"), ((ymax - b["ymin"]) / res).alias("bottom"))


def let(value: Column, use) -> Column:
    """use(value) with value computed once, also where use takes it into a lambda."""
    return F.transform(F.array(value), use)[0]


def cell_cover(g: Column, res: float = 1.0) -> Column:
    """(cx, cy) of the cells of a grid whose centres lie inside, by the even-odd rule.

    Each row of cells is crossed once: the sorted places where edges meet its middle line bound the spans inside.
    """
    b = bbox(g)
    none = F.expr("cast(array() as array<struct<cx:int,cy:int>>)")

    def span(crossings: Column, k: Column, cy: Column) -> Column:
        first = F.ceil(F.get(crossings, 2 * k) / res - 0.5).cast("int")
        last = F.ceil(F.get(crossings, 2 * k + 1) / res - 0.5).cast("int") - 1
        return F.when(last >= first, F.transform(F.sequence(first, last), lambda cx: F.struct(cx.alias("cx"), cy.alias("cy")))).otherwise(none)

    def row(lines: Column, cy: Column) -> Column:
        y = (cy + 0.5) * res
        met = F.filter(lines, lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
        places = F.array_sort(F.transform(met, lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
        pairs = lambda c: F.transform(F.sequence(F.lit(0), F.floor(F.size(c) / 2 - 1).cast("int")), lambda k: span(c, k, cy))
        return let(places, lambda c: F.when(F.size(c) > 1, F.flatten(pairs(c))).otherwise(none))

    low = F.floor(b["ymin"] / res).cast("int")
    rows = F.sequence(low, F.greatest(low, F.ceil(b["ymax"] / res).cast("int") - 1))
    return let(F.flatten(F.transform(g, edges)), lambda lines: F.flatten(F.transform(rows, lambda cy: row(lines, cy))))


def packed_cells(g: Column, res: float = 1.0) -> Column:
    """The cell cover as one number for each cell, for set operations on arrays."""
    return F.transform(cell_cover(g, res), lambda c: packed_cell(c["cx"], c["cy"]))


def packed_cell(cx: Column, cy: Column) -> Column:
    return F.shiftleft(cx.cast("long"), 32) + cy


def unpacked(cell: Column) -> Column:
    """(cx, cy) of a packed cell; negative places count too."""
    cy = F.shiftright(F.shiftleft(cell, 32), 32)
    return F.struct(F.shiftright(cell - cy, 32).cast("int").alias("cx"), cy.cast("int").alias("cy"))


def touch(a: Column, b: Column) -> Column:
    """Whether two closed segments (a, b) have a point in common."""
    side = lambda s, p: (s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (p["x"] - s["a"]["x"])
    meet = lambda c: (F.least(a["a"][c], a["b"][c]) <= F.greatest(b["a"][c], b["b"][c])) & (F.least(b["a"][c], b["b"][c]) <= F.greatest(a["a"][c], a["b"][c]))
    return meet("x") & meet("y") & (side(a, b["a"]) * side(a, b["b"]) <= 0) & (side(b, a["a"]) * side(b, a["b"]) <= 0)


def intersects(p: Column, q: Column) -> Column:
    """Whether two polygons have a point in common; a shared piece of boundary, even one point, counts."""
    crossing = F.exists(F.flatten(F.transform(p, edges)), lambda e: F.exists(F.flatten(F.transform(q, edges)), lambda d: touch(e, d)))
    return crossing | contains_point(p, q[0][0]["x"], q[0][0]["y"]) | contains_point(q, p[0][0]["x"], p[0][0]["y"])


#: WGS 84, and the central meridian and scale of UTM zone 17.
_A, _FLAT, _SCALE, _MERIDIAN = 6378137.0, 1 / 298.257223563, 0.9996, -81.0


def utm17(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres, by the third-order Krüger series."""
    n = _FLAT / (2 - _FLAT)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - _MERIDIAN)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return 500_000 + _SCALE * radius * east, _SCALE * radius * north
