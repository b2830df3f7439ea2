"""Spatial joins and crown operators on a grid of cells.

Polygons meet by blocks of the grid that their bounds touch: an equi-join, after which bounds and then cells are
compared. A crown is the set of its cells, so that intersection, difference and overlap are joins on cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopylens.functions import geometry as G
from canopylens.sources.tables import round_trip_parquet


def blocks(b: Column, size: int) -> Column:
    """(bx, by) of the grid blocks that a box touches."""
    span = lambda lo, hi: F.sequence(F.floor(lo / size).cast("int"), F.floor(hi / size).cast("int"))
    return F.flatten(F.transform(span(b["xmin"], b["xmax"]), lambda x: F.transform(span(b["ymin"], b["ymax"]), lambda y: F.struct(x.alias("bx"), y.alias("by")))))


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def within_tiles(crowns: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """(tile_id, id) of the crowns that lie in a tile; crowns and tiles meet by the block of the crown's corner."""
    placed = tiles.select("tile_id", F.struct("xmin", "ymin", "xmax", "ymax").alias("t")).withColumn("at", F.explode(blocks(F.col("t"), size)))
    corner = F.struct(F.floor(F.col("b.xmin") / size).cast("int").alias("bx"), F.floor(F.col("b.ymin") / size).cast("int").alias("by"))
    boxed = crowns.select("id", G.bbox(F.col("geom")).alias("b")).withColumn("at", corner)
    b, t = F.col("b"), F.col("t")
    return boxed.join(placed, "at").where((b["xmin"] >= t["xmin"]) & (b["ymin"] >= t["ymin"]) & (b["xmax"] <= t["xmax"]) & (b["ymax"] <= t["ymax"])).select("tile_id", "id")


def overlap_candidates(crowns: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, a, b), a < b: crowns whose bounds meet. A pair is taken in the one block with the corner of both bounds."""
    return boxes_near(crowns.select(*keys, "id", G.bbox(F.col("geom")).alias("box")), keys, size)


def boxes_near(boxed: DataFrame, keys: list[str], size: int) -> DataFrame:
    """overlap_candidates() of (keys, id, box)."""
    boxed = boxed.withColumn("at", F.explode(blocks(F.col("box"), size)))
    x, y = boxed.select(*keys, "at", F.col("id").alias("a"), F.col("box").alias("box_a")), boxed.select(*keys, "at", F.col("id").alias("b"), F.col("box").alias("box_b"))
    p, q = F.col("box_a"), F.col("box_b")
    first = (F.col("at.bx") == F.floor(F.greatest(p["xmin"], q["xmin"]) / size)) & (F.col("at.by") == F.floor(F.greatest(p["ymin"], q["ymin"]) / size))
    return x.join(y, [*keys, "at"]).where((F.col("a") < F.col("b")) & boxes_meet(p, q) & first).select(*keys, "a", "b")


def crown_cells(crowns: DataFrame, keys: list[str], res: float = 1.0) -> DataFrame:
    return crowns.select(*keys, "id", F.explode(G.cell_cover(F.col("geom"), res)).alias("c")).select(*keys, "id", "c.cx", "c.cy")


def shared_cells(crowns: DataFrame, keys: list[str], block: int = 16) -> DataFrame:
    """(keys, a, b, shared), a < b: how many cells two crowns (keys, id, geom) have in common, if any.

    Pairs are found by their bounds; then the two arrays of cells meet, so that no cell is a row of a join.
    """
    packed = crowns.select(*keys, "id", G.packed_cells(F.col("geom")).alias("cells"))
    near = overlap_candidates(crowns, keys, block)
    near = near.join(packed.withColumnsRenamed({"id": "a", "cells": "_a"}), [*keys, "a"]).join(packed.withColumnsRenamed({"id": "b", "cells": "_b"}), [*keys, "b"])
    return near.select(*keys, "a", "b", F.size(F.array_intersect("_a", "_b")).cast("long").alias("shared")).where("shared > 0")


def intersecting(crowns: DataFrame, keys: list[str], block: int = 16) -> DataFrame:
    """(keys, a, b), a < b: crowns (keys, id, geom) that have a point in common; touching boundaries count."""
    near = overlap_candidates(crowns, keys, block)
    own = crowns.select(*keys, "id", "geom")
    near = near.join(own.withColumnsRenamed({"id": "a", "geom": "_a"}), [*keys, "a"]).join(own.withColumnsRenamed({"id": "b", "geom": "_b"}), [*keys, "b"])
    return near.where(G.intersects(F.col("_a"), F.col("_b"))).select(*keys, "a", "b")


def crown_iou(new: DataFrame, ref: DataFrame, keys: list[str], ref_keys: list[str] | None = None) -> DataFrame:
    """new with inter_area, union_area and iou against the crown of ref with the same keys. 0 of 0 is 0.

    new, ref: crowns with geom; the cells of the two meet as arrays. Crowns without one in ref are left out.
    """
    other = ref.select(*[F.col(r).alias(k) for k, r in zip(keys, ref_keys or keys, strict=True)], G.packed_cells(F.col("geom")).alias("_ref"))
    both = new.withColumn("_new", G.packed_cells(F.col("geom"))).join(other, keys)
    inter = F.size(F.array_intersect("_new", "_ref")).cast("long")
    out = both.withColumn("inter_area", inter).withColumn("union_area", F.size("_new") + F.size("_ref") - F.col("inter_area"))
    return out.withColumn("iou", F.round(F.coalesce(F.try_divide("inter_area", "union_area"), F.lit(0.0)), 4)).drop("_new", "_ref", "geom")


def packed_crowns(crowns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, cells): each crown's cells, one number for each, as an array."""
    return crowns.select(*keys, "id", G.packed_cells(F.col("geom")).alias("cells"))


def crown_avoid(packed: DataFrame, keys: list[str], block: int = 16) -> DataFrame:
    """packed crowns without the cells that a smaller crown holds too, and lost, how many these are.

    All are compared as they are, so that the order doesn't matter; of equal ones both keep the overlap. Crowns are
    paired by bounds; the cells of a crown's smaller neighbours are taken from its own as one array.
    """
    row, col = F.transform("cells", lambda c: G.unpacked(c)["cx"]), F.transform("cells", lambda c: G.unpacked(c)["cy"])
    box = F.struct(F.array_min(row).alias("xmin"), F.array_min(col).alias("ymin"), (F.array_max(row) + 1).alias("xmax"), (F.array_max(col) + 1).alias("ymax"))
    sized = packed.where(F.size("cells") > 0).select(*keys, "id", box.alias("box"), F.size("cells").alias("n"))
    near = boxes_near(sized.select(*keys, "id", "box"), keys, block)
    n_of = lambda side: sized.select(*keys, F.col("id").alias(side), F.col("n").alias(f"n_{side}"))
    uneven = near.join(n_of("a"), [*keys, "a"]).join(n_of("b"), [*keys, "b"]).where("n_a <> n_b")
    larger, smaller = (F.when((F.col("n_a") > F.col("n_b")) == way, F.col("a")).otherwise(F.col("b")) for way in (True, False))
    takers = uneven.select(*keys, larger.alias("larger"), smaller.alias("id"))
    other = packed.select(*keys, "id", F.col("cells").alias("_theirs"))
    taken = takers.join(other, [*keys, "id"]).groupBy(*keys, F.col("larger").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list("_theirs"))).alias("_taken"))
    out = packed.join(taken, [*keys, "id"], "left").withColumn("_left", F.when(F.col("_taken").isNull(), F.col("cells")).otherwise(F.array_except("cells", "_taken")))
    return out.select(*keys, "id", F.col("_left").alias("cells"), (F.size("cells") - F.size("_left")).alias("lost"), *[c for c in packed.columns if c not in (*keys, "id", "cells", "lost")])


def crown_avoid_rounds(packed: DataFrame, keys: list[str], max_iter: int = 10) -> DataFrame:
    """crown_avoid again and again while a crown still loses something, at most max_iter times.

    Crowns that were equal keep their overlap until one of them has lost cells to a third.
    """
    for _ in range(max_iter):
        packed = round_trip_parquet(crown_avoid(packed, keys), [])  # a table in the shared folder, so that rounds don't nest
        if packed.where("lost > 0").isEmpty():
            break
    return packed.drop("lost")


def avoid_report(before: DataFrame, after: DataFrame, keys: list[str], res: float = 1.0) -> DataFrame:
    """(keys, id, area_before, area_left, area_after, geom): crowns before and after their overlaps are resolved.

    Of what is left the largest part stays, as a polygon around its cells without holes; where nothing is, geom is null.
    Areas are counts of cells.
    """
    areas = before.select(*keys, "id", F.size("cells").cast("long").alias("area_before"))
    part = outlines(largest_parts(after.select(*keys, "id", "cells", F.size("cells").cast("long").alias("area_left"))), res)
    return areas.join(part.withColumn("area_after", F.size("cells").cast("long")), [*keys, "id"]).select(*keys, "id", "area_before", "area_left", "area_after", "geom")


UP, LOW = 1 << 32, 0xFFFFFFFF


def largest_part(cells: np.ndarray) -> np.ndarray:
    """Of packed cells those of the largest part connected by sides; of equal parts that of the first cell.

    Cells of a column that follow each other are one run; runs of neighbouring columns that share a row are joined.
    """
    cells = np.unique(cells)
    if not len(cells):
        return cells
    run = np.concatenate([[0], np.cumsum(np.diff(cells) != 1)])
    at = np.minimum(np.searchsorted(cells, cells + UP), len(cells) - 1)
    beside = cells[at] == cells + UP
    parent = list(range(run[-1] + 1))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for a, b in np.unique(np.stack([run[beside], run[at[beside]]], 1), axis=0).tolist():
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    part = np.array([root(k) for k in range(len(parent))])[run]
    return cells[part == np.bincount(part).argmax()]


def _with_arrays(df: DataFrame, schema: T.StructType, make) -> DataFrame:
    """df with schema's last columns from make(cells as arrays, batch), some thousand crowns at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                column = batch.column("cells")
                flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.fill_null(column.value_lengths(), 0).to_numpy())
                yield make(np.split(flat, ends[:-1]) if len(ends) else [], batch)

    return df.mapInArrow(work, schema)


def largest_parts(packed: DataFrame) -> DataFrame:
    """packed crowns (.., cells, ..) with the cells of their largest part; many crowns meet one task."""

    def make(cells: list[np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [largest_part(c) for c in cells]
        sizes = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32())
        made = pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(parts) if parts else [], pa.int64()))
        return pa.RecordBatch.from_arrays([made if n == "cells" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    return _with_arrays(packed, packed.schema, make)


def outlines(packed: DataFrame, res: float = 1.0, left: float = 0.0, top: float | None = None) -> DataFrame:
    """packed crowns, each of one part, with geom: the ring around its cells on the map, null where there is no cell.

    With top, rows count downwards from it.
    """
    kind = T.StructType.fromDDL(f"geom {G.RINGS}")
    point = lambda x, y: {"x": left + x * res, "y": y * res if top is None else top - y * res}

    def make(cells: list[np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch:
        shapes = []
        for c in cells:
            y = (c & LOW).astype(np.uint32).astype(np.int32).astype(np.int64)
            ring = outline(set(zip(((c - y) >> 32).tolist(), y.tolist(), strict=True)))
            shapes.append([[point(*p) for p in ring]] if ring else None)
        rings = pa.array(shapes, pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
        return pa.RecordBatch.from_arrays([*batch.columns, rings], names=[*batch.schema.names, "geom"])

    return _with_arrays(packed, T.StructType([*packed.schema, *kind]), make)


def largest_component(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Of the cells (keys, id, cx, cy) of each crown those of its largest part connected by sides."""
    packed = cells.groupBy(*keys, "id").agg(F.collect_list(G.packed_cell(F.col("cx"), F.col("cy"))).alias("cells"))
    return largest_parts(packed).select(*keys, "id", F.explode("cells").alias("c")).select(*keys, "id", G.unpacked(F.col("c"))["cx"].alias("cx"), G.unpacked(F.col("c"))["cy"].alias("cy"))


def best_masks(masks: DataFrame) -> DataFrame:
    """The mask of the highest score for each crown, the first of equals."""
    order = Window.partitionBy("id").orderBy(F.desc("score"), "k")
    return masks.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def outline(cells: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners, in order, of the ring around connected cells; the longest ring if there are holes."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x, y in cells:
        for near, a, b in (((x, y - 1), (x, y), (x + 1, y)), ((x + 1, y), (x + 1, y), (x + 1, y + 1)), ((x, y + 1), (x + 1, y + 1), (x, y + 1)), ((x - 1, y), (x, y + 1), (x, y))):
            if near not in cells:
                after.setdefault(a, []).append(b)
    rings: list[list[tuple[int, int]]] = []
    while after:
        start = at = min(after)
        ring = [start]
        while True:
            nexts = after[at]
            to = nexts.pop(0)
            if not nexts:
                del after[at]
            if to == start:
                break
            ring.append(to)
            at = to
        n = len(ring)
        straight = lambda i, r=ring, n=n: (r[i][0] - r[i - 1][0]) * (r[(i + 1) % n][1] - r[i][1]) == (r[i][1] - r[i - 1][1]) * (r[(i + 1) % n][0] - r[i][0])
        rings.append([ring[i] for i in range(n) if not straight(i)])
    return max(rings, key=lambda r: max(p[0] for p in r) - min(p[0] for p in r)) if rings else []


def masks_to_crowns(masks: DataFrame, crowns: DataFrame, res: float, left: float, top: float) -> DataFrame:
    """(id, tag, GlobalID, score, area, geom): each crown's best mask as a polygon on the ground.

    masks: (id, k, score, cells: array of (cx, cy), rows counted downwards); crowns: (id, tag, GlobalID). Of the best
    mask the largest part connected by sides is kept; its area is that of its cells, and geom its outline without holes.
    """
    best = best_masks(masks).select("id", "score", F.transform("cells", lambda c: G.packed_cell(c["cx"], c["cy"])).alias("cells"))
    traced = outlines(largest_parts(best), res, left, top).select("id", "score", (F.size("cells") * res * res).alias("area"), "geom")
    return traced.join(crowns.select("id", "tag", "GlobalID"), "id")


def clipped(p: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polygons p, of n points each, cut to the left of the line from a to b, all at once."""
    width = p.shape[1]
    here = np.arange(width) < n[:, None]
    after = np.where(np.arange(width) + 1 < n[:, None], np.arange(width) + 1, 0)
    side = (b - a)[:, None, 0] * (p[:, :, 1] - a[:, None, 1]) - (b - a)[:, None, 1] * (p[:, :, 0] - a[:, None, 0])
    side_after, p_after = np.take_along_axis(side, after, 1), np.take_along_axis(p, after[:, :, None], 1)
    crosses = here & (side * side_after < 0)
    at = np.divide(side, side - side_after, out=np.zeros_like(side), where=crosses)
    points = np.stack([p, p + (p_after - p) * at[:, :, None]], 2).reshape(len(p), 2 * width, 2)
    kept = np.stack([here & (side >= 0), crosses], 2).reshape(len(p), 2 * width)
    order = np.argsort(~kept, 1, kind="stable")[:, : width + 1]
    return np.take_along_axis(points, order[:, :, None], 1), kept.sum(1)


def common_areas(t: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The common area of each pair of triangles, whose corners run counterclockwise."""
    p, n = t, np.full(len(t), 3)
    for k in range(3):
        p, n = clipped(p, n, u[:, k], u[:, (k + 1) % 3])
    after = np.where(np.arange(p.shape[1]) + 1 < n[:, None], np.arange(p.shape[1]) + 1, 0)
    x, y = p[:, :, 0], p[:, :, 1]
    cross = x * np.take_along_axis(y, after, 1) - np.take_along_axis(x, after, 1) * y
    return np.where(n > 2, np.abs(np.where(np.arange(p.shape[1]) < n[:, None], cross, 0).sum(1)) / 2, 0.0)


def fan(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sign, triangle) that add up to a polygon: its outline counts once, holes away from it, whichever way they run."""
    signs, triangles = [], []
    for k, r in enumerate(rings):
        t = np.stack([np.broadcast_to(r[0], (len(r) - 2, 2)), r[1:-1], r[2:]], 1) if len(r) > 2 else np.zeros((0, 3, 2))
        turn = (t[:, 1, 0] - t[:, 0, 0]) * (t[:, 2, 1] - t[:, 0, 1]) - (t[:, 1, 1] - t[:, 0, 1]) * (t[:, 2, 0] - t[:, 0, 0])
        t = np.where((turn < 0)[:, None, None], t[:, ::-1], t)[turn != 0]
        way = np.sign(turn.sum()) * (1 if k == 0 else -1)
        signs.append(np.sign(turn[turn != 0]) * way)
        triangles.append(t)
    return np.concatenate(signs), np.concatenate(triangles)


def exact_overlap(pairs: DataFrame) -> DataFrame:
    """pairs (geom_a, geom_b, ...) with inter_area, the exact area of their intersection; holes are no part of either.

    Each polygon is a signed fan of triangles around a local origin, over all its rings; the areas of all clipped pairs of
    triangles are computed at once for a batch of pairs and added up.
    """

    def polygon(g: list | None) -> list[np.ndarray]:
        return [np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2) for r in g or [] if r]

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                signs, first, second, owner = [np.zeros(0)], [np.zeros((0, 3, 2))], [np.zeros((0, 3, 2))], [np.zeros(0, int)]
                for k, (p, q) in enumerate(zip(*(map(polygon, batch.column(c).to_pylist()) for c in ("geom_a", "geom_b")), strict=True)):
                    if p and q:
                        origin = p[0][0].copy()
                        (s, t), (r, u) = fan([x - origin for x in p]), fan([x - origin for x in q])
                        signs.append(np.outer(s, r).ravel())
                        first.append(np.repeat(t, len(u), 0))
                        second.append(np.tile(u, (len(t), 1, 1)))
                        owner.append(np.full(len(t) * len(u), k))
                areas = np.concatenate(signs) * common_areas(np.concatenate(first), np.concatenate(second))
                total = np.bincount(np.concatenate(owner), areas, batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], names=[*batch.schema.names, "inter_area"])

    return pairs.mapInArrow(overlap, T.StructType([*pairs.schema, T.StructField("inter_area", T.DoubleType())]))


def track_crowns(crowns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, yr, prev_yr, direction, area, inter_area, union_area, iou): each crown against itself on the date before.

    crowns: (id, yr, geom); pairs: (yr, direction, reference), the reference being the neighbour towards the anchor. All
    dates are compared in one join.
    """
    dated = crowns.select("id", "yr", "geom").join(pairs.select("yr", "direction", F.col("reference").alias("prev_yr")), "yr")
    dated = dated.withColumn("area", G.area(F.col("geom")))
    return crown_iou(dated, crowns, ["id", "prev_yr"], ["id", "yr"]).select("id", "yr", "prev_yr", "direction", "area", "inter_area", "union_area", "iou")
