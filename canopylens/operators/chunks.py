"""Rasters as chunks: one row for each square of cells, each band a dense array, with bounds and statistics beside it.

A chunk has yr, chunk_row, chunk_col, side (cells along a side), the first and last row and column that hold a cell
(row0, row1, col0, col1), n (its cells), and for each band an array of side x side values, row by row and null where
there is none, with its smallest and largest value (band_min, band_max). Scans skip chunks by bounds and statistics;
what is left is worked on array by array, and only cells that a result needs become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopylens.functions import geometry as G

SIDE = 64
KEYS = ["yr", "chunk_row", "chunk_col"]
BOUNDS = ["row0", "row1", "col0", "col1"]
#: Crowns that meet a copy of their chunk together.
CROWNS_AT_ONCE = 256


def chunk_schema(pixels: DataFrame, bands: list[str]) -> T.StructType:
    kinds = {b: pixels.schema[b].dataType for b in bands}
    fields = [T.StructField(c, T.IntegerType()) for c in (*KEYS, "side", *BOUNDS, "n")]
    return T.StructType([*fields, *[f for b, k in kinds.items() for f in (T.StructField(b, T.ArrayType(k)), T.StructField(f"{b}_min", k), T.StructField(f"{b}_max", k))]])


def to_chunks(pixels: DataFrame, bands: list[str], side: int = SIDE) -> DataFrame:
    """Chunks of pixels (yr, row_no, col, bands); a task builds one chunk at a time."""
    schema = chunk_schema(pixels, bands)

    def build(key: tuple, cells: pa.Table) -> pa.Table:
        yr, chunk_row, chunk_col = (k.as_py() for k in key)
        row, col = (cells[c].to_numpy() for c in ("row_no", "col"))
        place = np.full(side * side, -1)
        place[(row - chunk_row * side) * side + col - chunk_col * side] = np.arange(len(row))
        taken = pa.array(place, mask=place < 0)
        out = [yr, chunk_row, chunk_col, side, row.min(), row.max(), col.min(), col.max(), int((place >= 0).sum())]
        columns = [pa.array([x], pa.int32()) for x in out]
        for b in bands:
            dense = cells[b].combine_chunks().take(taken)
            ends = pc.min_max(dense)
            columns += [pa.ListArray.from_arrays(pa.array([0, len(dense)], pa.int32()), dense), pa.array([ends["min"].as_py()], dense.type), pa.array([ends["max"].as_py()], dense.type)]
        return pa.Table.from_arrays(columns, names=schema.names)

    keys = [F.col("yr").cast("int").alias("yr"), F.floor(F.col("row_no") / side).cast("int").alias("chunk_row"), F.floor(F.col("col") / side).cast("int").alias("chunk_col")]
    return pixels.select("yr", "row_no", "col", *bands).groupBy(*keys).applyInArrow(build, schema)


def along_a_curve(row: str = "chunk_row", col: str = "chunk_col", bits: int = 20) -> Column:
    """Places of neighbouring chunks are mostly near each other along this: the bits of row and column in turns."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        for shift, c in ((2 * k + 1, row), (2 * k, col)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(F.col(c).cast("long"), k).bitwiseAND(F.lit(1)), shift))
    return out


def cells_of(chunks: DataFrame, bands: list[str], others: tuple[str, ...] = ()) -> DataFrame:
    """(yr, row_no, col, bands, others): the cells in which any of these bands has a value; other bands aren't read."""
    at, side = F.col("at"), F.col("side")
    place = [(F.col("chunk_row") * side + F.floor(at / side)).cast("int").alias("row_no"), (F.col("chunk_col") * side + at % side).cast("int").alias("col")]
    rows = chunks.select(*KEYS, "side", *others, F.posexplode(F.arrays_zip(*bands)).alias("at", "cell"))
    full = reduce(lambda x, y: x | y, [F.col(f"cell.{b}").isNotNull() for b in bands])
    return rows.where(full).select("yr", *place, *[f"cell.{b}" for b in bands], *others)


def bands_of(chunks: DataFrame) -> list[str]:
    return [f.name for f in chunks.schema if isinstance(f.dataType, T.ArrayType)]


def where_cells(chunks: DataFrame, keep) -> DataFrame:
    """chunks with null in all cells but those that keep(value, row_no, col) holds for; statistics are made anew."""
    bands = bands_of(chunks)
    side = F.col("side")
    masked = {b: F.transform(b, lambda v, i: F.when(keep(v, F.col("chunk_row") * side + F.floor(i / side), F.col("chunk_col") * side + i % side), v)) for b in bands}
    out = chunks.withColumns(masked)
    return out.withColumns({f"{b}_{end}": f(b) for b in bands for end, f in (("min", F.array_min), ("max", F.array_max))})


def mask_nodata(chunks: DataFrame, bands: list[str], nodata: float) -> DataFrame:
    """chunks with null for nodata in some bands; of the bands' chunks only those whose range holds it are gone through."""
    masked = {}
    for b in bands:
        full = F.filter(b, lambda v: v != nodata)
        hit = F.lit(nodata).between(F.col(f"{b}_min"), F.col(f"{b}_max"))
        masked |= {b: F.when(hit, F.transform(b, lambda v: F.when(v != nodata, v))).otherwise(F.col(b))}
        masked |= {f"{b}_min": F.when(hit, F.array_min(full)).otherwise(F.col(f"{b}_min")), f"{b}_max": F.when(hit, F.array_max(full)).otherwise(F.col(f"{b}_max"))}
    return chunks.withColumns(masked)


def reaching(chunks: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """The chunks with a cell whose row and column are those of a centre in the box, by their bounds alone.

    The box becomes whole rows and columns first, so that the scan compares columns with numbers and skips files.
    """
    first_col, last_col, first_row, last_row = math.ceil(xmin - 0.5), math.floor(xmax - 0.5), math.ceil(ymin - 0.5), math.floor(ymax - 0.5)
    return chunks.where((F.col("col1") >= first_col) & (F.col("col0") <= last_col) & (F.col("row1") >= first_row) & (F.col("row0") <= last_row))


def crop_box(chunks: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, pad: float = 0) -> DataFrame:
    """Chunks with the cells whose centres lie in a padded box."""
    box = (xmin - pad, ymin - pad, xmax + pad, ymax + pad)
    return where_cells(reaching(chunks, *box), lambda _, row, col: (col + 0.5).between(box[0], box[2]) & (row + 0.5).between(box[1], box[3]))


def inside(rings: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Which cells of rows x cols have their centre inside, by the even-odd rule over all rings."""
    y, x = rows + 0.5, cols + 0.5
    out = np.zeros((len(rows), len(cols)), bool)
    for ring in rings:
        a, b = ring, np.roll(ring, -1, axis=0)
        for (ax, ay), (bx, by) in zip(a, b, strict=True):
            met = (ay > y) != (by > y)
            if met.any():
                out[met] ^= x[None, :] < ((bx - ax) * (y[met] - ay) / (by - ay) + ax)[:, None]
    return out


def crop_polygon(chunks: DataFrame, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """Chunks with the cells whose centres lie in a polygon: those that its bounds reach, one mask for each."""
    shape = [np.array(r, float) for r in rings]
    ends = shape[0].min(0), shape[0].max(0)
    bands = bands_of(chunks)

    def crop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for row, col, side in zip(*(batch.column(c).to_pylist() for c in ("chunk_row", "chunk_col", "side")), strict=True):
                masks.append(inside(shape, row * side + np.arange(side), col * side + np.arange(side)).ravel())
            mask = pa.array(np.concatenate(masks) if masks else np.zeros(0, bool))
            columns = []
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                if name in bands:
                    flat = column.flatten()
                    flat = pc.if_else(mask, flat, pa.scalar(None, flat.type))
                    sizes = np.concatenate([[0], np.cumsum([len(m) for m in masks])])
                    column = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    cropped = reaching(chunks, ends[0][0], ends[0][1], ends[1][0], ends[1][1]).mapInArrow(crop, chunks.schema)
    return cropped.withColumns({f"{b}_{end}": f(b) for b in bands for end, f in (("min", F.array_min), ("max", F.array_max))})


def cut_tiles(chunks: DataFrame, size: int, halo: int, tile_rows: int, tile_cols: int) -> DataFrame:
    """chunks with tile_row and tile_col, once for each tile that has cells of theirs, itself or in its halo.

    A chunk's tiles are computed from its bounds; cells of other tiles are null.
    """
    span = lambda lo, hi, n: F.sequence(F.greatest(F.lit(0), F.floor((F.col(lo) - halo) / size)).cast("int"), F.least(F.lit(n - 1), F.floor((F.col(hi) + halo) / size)).cast("int"))
    dealt = chunks.withColumn("tile_row", F.explode(span("row0", "row1", tile_rows))).withColumn("tile_col", F.explode(span("col0", "col1", tile_cols)))
    near = lambda at, tile: at.between(F.col(tile) * size - halo, F.col(tile) * size + size + halo - 1)
    return where_cells(dealt, lambda _, row, col: near(row, "tile_row") & near(col, "tile_col"))


def values_in(band: str) -> Column:
    """How many cells of a chunk have a value in a band."""
    return F.size(F.filter(band, lambda v: v.isNotNull()))


def sum_of(band: str) -> Column:
    return F.aggregate(band, F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)))


def named_plot(chunks: DataFrame, plots: DataFrame, name: str) -> DataFrame:
    """The cells in the plot (name, xmin, ymin, xmax, ymax) of that name; the one row is read first, so that scans skip."""
    plot = plots.where(F.col("name") == name).first()
    if plot is None:
        raise ValueError(f"no plot is named {name}")
    return crop_box(chunks, plot.xmin, plot.ymin, plot.xmax, plot.ymax)


def tiles_along(chunks: DataFrame, size: int) -> tuple[int, int]:
    """How many rows and columns of tiles the chunks reach over, from their bounds."""
    most = chunks.agg(F.max("row1").alias("r"), F.max("col1").alias("c")).first()
    return (most.r or 0) // size + 1, (most.c or 0) // size + 1


def zonal_pixels(crowns: DataFrame, chunks: DataFrame, bands: list[str], pad: float | None = None, side: int = SIDE) -> DataFrame:
    """(id, yr, row_no, col, bands): the cells of each crown's date whose centres lie in the crown (id, yr, geom).

    With a pad: those in the crown's bounds and so far around them. Chunks are scanned within the bounds of all crowns;
    each meets its crowns as one row, or as one for each CROWNS_AT_ONCE of them, and one mask is made for each crown.
    """
    boxed = crowns.select("id", "yr", "geom", G.padded(G.bbox(F.col("geom")), pad or 0).alias("box")).where("geom is not null")
    span = lambda lo, hi: F.sequence(F.floor(lo / side).cast("int"), F.floor(hi / side).cast("int"))
    placed = boxed.withColumn("chunk_row", F.explode(span(F.col("box.ymin"), F.col("box.ymax")))).withColumn("chunk_col", F.explode(span(F.col("box.xmin"), F.col("box.xmax"))))
    hash_of = F.xxhash64("id")
    loads = placed.groupBy(*KEYS).agg(F.ceil(F.count("*") / CROWNS_AT_ONCE).alias("loads"))
    grouped = placed.join(loads, KEYS).groupBy(*KEYS, F.pmod(hash_of, F.col("loads")).alias("load")).agg(F.collect_list(F.struct("id", "geom", "box")).alias("crowns")).drop("load")
    whole = boxed.agg(*[f(f"box.{c}").alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]).first()
    scanned = reaching(chunks, *whole) if whole.xmin is not None else chunks.where("false")
    met = scanned.select(*KEYS, "side", *bands).join(grouped, KEYS)
    kinds = {b: chunks.schema[b].dataType.elementType for b in bands}
    schema = T.StructType([T.StructField("id", crowns.schema["id"].dataType), *[T.StructField(c, T.IntegerType()) for c in ("yr", "row_no", "col")], *[T.StructField(b, k) for b, k in kinds.items()]])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for first in range(0, whole_batch.num_rows, 64):
                batch = whole_batch.slice(first, 64)
                taken, rows_of, cols_of, ids, years, start = [], [], [], [], [], 0
                for yr, chunk_row, chunk_col, size, zones in zip(*(batch.column(c).to_pylist() for c in (*KEYS, "side", "crowns")), strict=True):
                    for z in zones:
                        box = z["box"]
                        first_row, last_row = max(chunk_row * size, math.ceil(box["ymin"] - 0.5)), min(chunk_row * size + size - 1, math.floor(box["ymax"] - 0.5))
                        first_col, last_col = max(chunk_col * size, math.ceil(box["xmin"] - 0.5)), min(chunk_col * size + size - 1, math.floor(box["xmax"] - 0.5))
                        if first_row > last_row or first_col > last_col:
                            continue
                        rows, cols = np.arange(first_row, last_row + 1), np.arange(first_col, last_col + 1)
                        rings = [np.array([(p["x"], p["y"]) for p in r]) for r in z["geom"]]
                        r, c = np.nonzero(inside(rings, rows, cols) if pad is None else np.ones((len(rows), len(cols)), bool))
                        taken.append(start + (rows[r] - chunk_row * size) * size + cols[c] - chunk_col * size)
                        rows_of.append(rows[r])
                        cols_of.append(cols[c])
                        ids += [z["id"]] * len(r)
                        years += [yr] * len(r)
                    start += size * size
                if not ids:
                    continue
                at = pa.array(np.concatenate(taken))
                values = [batch.column(b).flatten().take(at) for b in bands]
                full = values[0].is_valid()
                for v in values[1:]:
                    full = pc.or_(full, v.is_valid())
                columns = [pa.array(ids), pa.array(years, pa.int32()), pa.array(np.concatenate(rows_of), pa.int32()), pa.array(np.concatenate(cols_of), pa.int32()), *values]
                yield pa.RecordBatch.from_arrays([c.filter(full) for c in columns], names=schema.names)

    return met.mapInArrow(pick, schema)
