"""Alignment of a series of rasters: shifts from tie points, chains and stars of dates, vertical offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopylens.operators import raster, timeseries
from canopylens.sources.tables import round_trip_parquet


def mean_shift(points: DataFrame, k: int = 10, keys: list[str] = ["pair"]) -> DataFrame:  # noqa: B006
    """Mean shift of the k most reliable tie points of each pair; ties go to the smaller event."""
    best = timeseries.top_by(points, keys, k, F.desc("reliability"), F.col("event_id"))
    return best.groupBy(*keys).agg(F.round(F.avg("x_shift"), 4).alias("xs"), F.round(F.avg("y_shift"), 4).alias("ys"), F.count("*").alias("n_points"))


def align_global(shifts: DataFrame, anchor: int, mode: str = "chain") -> DataFrame:
    """(pair, xs, ys) with total_x and total_y.

    star: every date was compared with the anchor, its shift is the total. chain: every date was compared with its
    neighbour towards the anchor, and the shifts add up along the way.
    """
    if mode == "star":
        return shifts.withColumns({"total_x": F.col("xs"), "total_y": F.col("ys")})
    side = F.signum(F.col("pair") - anchor)
    way = Window.partitionBy("_side").orderBy(F.abs(F.col("pair") - anchor)).rowsBetween(Window.unboundedPreceding, 0)
    moved = shifts.withColumn("_side", side).withColumns({f"_{c}": F.when(F.col("pair") == anchor, 0.0).otherwise(F.col(c)) for c in ("xs", "ys")})
    return moved.withColumns({"total_x": F.round(F.sum("_xs").over(way), 4), "total_y": F.round(F.sum("_ys").over(way), 4)}).drop("_side", "_xs", "_ys")


def pick_reference(attempts: DataFrame) -> DataFrame:
    """attempts (date, ok) with the last date before that succeeded: what a failed one falls back on."""
    before = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return attempts.withColumn("reference", F.last(F.when(F.col("ok"), F.col("date")), ignorenulls=True).over(before))


def vertical_offsets(pixels: DataFrame, ref: int, band: str = "h") -> DataFrame:
    """(yr, median, offset): what to add to each date so that its median is that of the reference date."""
    medians = raster.median_of_band(pixels, band, ["yr"])
    target = F.max(F.when(F.col("yr") == ref, F.col("median"))).over(Window.partitionBy(F.lit(0)))
    return medians.withColumn("offset", target - F.col("median"))


def align_vertical(pixels: DataFrame, ref: int, band: str = "h") -> DataFrame:
    """pixels with every date's median moved to that of the reference; nodata stays nodata."""
    valid = raster.mask_nodata(pixels, [band], 0)
    return raster.add_offset(valid, vertical_offsets(pixels, ref, band), band)


def delta_offset(target: DataFrame, ref: DataFrame, band: str = "h") -> DataFrame:
    """The median of the cell-wise difference, from the counts of each difference."""
    return raster.median_of(raster.difference(ref, target, band), "delta", []).select(F.round("median", 4).alias("offset"))


#: Attempts at a window: with its edges faded out, as it is, and its middle half alone.
TAPERS = ("faded", "plain", "middle")


def cut_windows(ref: DataFrame, tgt: DataFrame, band: str, size: int, reach: int, spacing: int = 0, at: tuple[int, int] = (0, 0)) -> DataFrame:
    """(pair, grid_row, grid_col, parts): the chunks of both rasters that a window of size x size cells needs.

    ref, tgt: chunks of the pairs (yr is the pair). Windows begin at the grid's points, spacing cells apart, or with
    spacing 0 once, at a place. The target's chunks reach so many cells further on all sides. parts: (side, chunk_row,
    chunk_col, width, v), side 0 the reference and 1 the target; bands travel as arrays, a chunk once for each window.
    """

    def touched(chunks: DataFrame, side: int, more: int) -> DataFrame:
        def points(lo: str, hi: str, first: int) -> Column:
            if not spacing:
                near = (F.col(lo) < first + size + more) & (F.col(hi) >= first - more)
                return F.filter(F.array(F.lit(0)), lambda k: near)
            low = F.greatest(F.lit(0), F.ceil((F.col(lo) - first - size - more + 1) / spacing)).cast("int")
            high = F.floor((F.col(hi) - first + more) / spacing).cast("int")
            return F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<int>)"))

        part = F.struct(F.lit(side).alias("side"), "chunk_row", "chunk_col", F.col("side").alias("width"), F.col(band).cast("array<double>").alias("v"))
        out = chunks.select(F.col("yr").alias("pair"), part.alias("part"), points("row0", "row1", at[0]).alias("rows"), F.explode(points("col0", "col1", at[1])).alias("grid_col"))
        return out.select("pair", F.explode("rows").alias("grid_row"), "grid_col", "part")

    both = touched(ref, 0, 0).unionByName(touched(tgt, 1, reach))
    return both.groupBy("pair", "grid_row", "grid_col").agg(F.collect_list("part").alias("parts"))  # a window's chunks, a fixed number


def correlate(ref: np.ndarray, tgt: np.ndarray) -> tuple[int, int, float, float, float]:
    """(rows, columns, part of a row, part of a column, reliability) by which tgt lies beside ref, by phase correlation.

    The peak of the normalised cross-power spectrum is the shift. A shift by part of a cell divides the peak between two
    cells in proportion, so that the higher neighbour gives the part. How far the highest value beyond the peak's neighbours lies below it, in percent, is the reliability.
    """
    size = len(ref)
    if ref.std() == 0 or tgt.std() == 0:
        return 0, 0, 0.0, 0.0, 0.0
    cross = np.conj(np.fft.fft2(ref - ref.mean())) * np.fft.fft2(tgt - tgt.mean())
    peak = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-9 * np.abs(cross).max())).real
    row, col = np.unravel_index(int(peak.argmax()), peak.shape)
    top = peak[row, col]
    near = [(row + i) % size for i in (-1, 0, 1)], [(col + j) % size for j in (-1, 0, 1)]
    part_of = lambda before, after: float(np.sign(after - before) * max(before, after, 0) / (top + max(before, after, 0))) if top > 0 else 0.0
    part = part_of(peak[near[0][0], col], peak[near[0][2], col]), part_of(peak[row, near[1][0]], peak[row, near[1][2]])
    peak[np.ix_(*near)] = 0
    dy, dx = (int(v) - size if v > size // 2 else int(v) for v in (row, col))
    return dy, dx, *part, float(100 * (1 - max(peak.max(), 0) / top)) if top > 0 else 0.0


def follow(ref: np.ndarray, around: np.ndarray, reach: int, least: float, max_iter: int) -> tuple[float, float, float]:
    """(x_shift, y_shift, reliability) of a window in the target's surroundings, reach cells wider on all sides.

    The target's window is cut anew where the shift so far points to, until it stays, at most max_iter times; a shift
    beyond reach, or one that never stays, has failed. Then the next of TAPERS is tried; the first that is reliable
    counts, else the most reliable one.
    """
    size, best = len(ref), (0.0, 0.0, 0.0)
    fade = np.hanning(size + 2)[1:-1]
    for attempt in TAPERS:
        cut = slice(size // 4, size - size // 4) if attempt == "middle" else slice(None)
        weight = np.outer(fade, fade) if attempt == "faded" else 1.0
        y = x = 0
        for _ in range(max_iter):
            tgt = around[reach + y : reach + y + size, reach + x : reach + x + size]
            own, other = ref - ref.mean(), tgt - tgt.mean()
            dy, dx, part_y, part_x, sure = correlate((own * weight)[cut, cut], (other * weight)[cut, cut])
            y, x = y + dy, x + dx
            if max(abs(y), abs(x)) > reach:
                break
            if dy == dx == 0:
                if sure > best[2]:
                    best = (x + part_x, y + part_y, sure)
                break
        if best[2] >= least:
            break
    return best


def estimate_tie_points(windows: DataFrame, size: int, reach: int, spacing: int = 0, at: tuple[int, int] = (0, 0), least: float = 30, max_iter: int = 20) -> DataFrame:
    """(pair, grid_row, grid_col, x_shift, y_shift, reliability) of the windows of cut_windows(), in cells.

    Windows in which no attempt succeeds have reliability 0; those without a value in the reference are left out.
    Missing cells count as 0. A task holds the chunks of a few windows at a time.
    """
    schema = "pair int, grid_row int, grid_col int, x_shift double, y_shift double, reliability double"

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 50):
                batch = whole.slice(first, 50)
                parts = batch.column("parts").flatten()
                side, chunk_row, chunk_col, width, v = parts.flatten()
                place = np.stack([c.to_numpy() for c in (side, chunk_row, chunk_col, width)], 1)
                values = np.nan_to_num(v.flatten().to_numpy(zero_copy_only=False).astype(float))
                starts = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy())])
                out, k = [], 0
                for pair, i, j, n in zip(*(batch.column(c).to_pylist() for c in ("pair", "grid_row", "grid_col")), batch.column("parts").value_lengths().to_pylist(), strict=True):
                    row, col = at[0] + i * spacing, at[1] + j * spacing
                    dense = [np.zeros((size, size)), np.zeros((size + 2 * reach, size + 2 * reach))]
                    held = False
                    for p in range(k, k + n):
                        s, cr, cc, w = place[p]
                        cells, more = values[starts[p] : starts[p + 1]].reshape(w, w), reach if s else 0
                        top, left = cr * w - row + more, cc * w - col + more
                        r0, r1, c0, c1 = max(0, -top), min(w, len(dense[s]) - top), max(0, -left), min(w, len(dense[s]) - left)
                        if r0 < r1 and c0 < c1:
                            dense[s][top + r0 : top + r1, left + c0 : left + c1] = cells[r0:r1, c0:c1]
                            held |= s == 0 and bool(cells[r0:r1, c0:c1].any())
                    k += n
                    if held:
                        out.append((pair, i, j, *follow(dense[0], dense[1], reach, least, max_iter)))
                columns = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 3 + [pa.float64()] * 3, strict=True)], names=[f.split(" ")[0] for f in schema.split(", ")])

    return windows.mapInArrow(estimate, schema)


def on_the_map(points: DataFrame, spacing: int, size: int, res: float, left: float, top: float) -> DataFrame:
    """points with X_MAP, Y_MAP, the middle of each window, and shifts and reliability under their table's names."""
    middle = lambda c: F.col(c) * spacing + size / 2
    return points.select(
        "pair", "grid_row", "grid_col", (left + middle("grid_col") * res).alias("X_MAP"), (top - middle("grid_row") * res).alias("Y_MAP"),
        (F.col("x_shift") * res).alias("X_SHIFT_M"), (-F.col("y_shift") * res).alias("Y_SHIFT_M"), F.col("reliability").alias("RELIABILITY"),
    )


def nearest_reliable(squares: DataFrame, points: DataFrame) -> DataFrame:
    """(yr, square_row, square_col, points): the reliable points of the first ring around a square that has any.

    squares: (yr, square_row, square_col), each between the grid points of its numbers and the next ones. Ring 0 are its
    own corners, ring k those k points further out. Rings grow from the reliable points, so that a round has a few rows
    for each of them; squares that are settled are done with, and those of dates without a reliable point have no row.
    """
    state = round_trip_parquet(squares.join(points.select("yr").distinct(), "yr"), [])
    settled, k = [], 0
    while not state.isEmpty():
        ring = F.filter(
            F.flatten(F.transform(F.sequence(F.lit(-k - 1), F.lit(k)), lambda i: F.transform(F.sequence(F.lit(-k - 1), F.lit(k)), lambda j: F.struct(i.alias("i"), j.alias("j"))))),
            lambda p: (p["i"].isin(-k - 1, k)) | (p["j"].isin(-k - 1, k)),
        )
        near = points.withColumn("p", F.explode(ring)).withColumns({"square_row": F.col("grid_row") + F.col("p.i"), "square_col": F.col("grid_col") + F.col("p.j")})
        point = F.struct("grid_row", "grid_col", F.col("x_shift").cast("double").alias("x"), F.col("y_shift").cast("double").alias("y"))
        keys = ["yr", "square_row", "square_col"]
        found = round_trip_parquet(state.join(near, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("points")), [])  # at most 8 k + 4
        settled.append(found)
        state, k = round_trip_parquet(state.join(found, keys, "left_anti"), []), k + 1
    out = settled[0] if settled else state.withColumn("points", F.lit(None).cast("array<struct<grid_row:int,grid_col:int,x:double,y:double>>"))
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def align_local(pixels: DataFrame, points: DataFrame, spacing: int, least: float = 30) -> DataFrame:
    """pixels resampled through a field of shifts: (yr, row_no, col, h) at the place that the shift points to.

    points: (yr, grid_row, grid_col, x_shift, y_shift, reliability) at the corners of squares of spacing cells. A cell's
    shift is the mean of the reliable points nearest to its square, its corners or else the first ring of grid points
    that has any, weighted by closeness. Cells of a date without reliable points stay.
    """
    good = round_trip_parquet(points.where(F.col("reliability") >= least).select("yr", F.col("grid_row").cast("int").alias("grid_row"), F.col("grid_col").cast("int").alias("grid_col"), "x_shift", "y_shift"), [])
    cells = pixels.withColumns({"square_row": F.floor(F.col("row_no") / spacing).cast("int"), "square_col": F.floor(F.col("col") / spacing).cast("int")})
    keys = ["yr", "square_row", "square_col"]
    field = nearest_reliable(cells.select(*keys).distinct(), good)
    weight = lambda p: 1 / (1 + F.sqrt((F.col("row_no") - p["grid_row"] * spacing) ** 2 + (F.col("col") - p["grid_col"] * spacing) ** 2))
    total = lambda f: F.aggregate("points", F.lit(0.0), lambda s, p: s + f(p))
    moved = {f"_{a}": F.coalesce(F.round(total(lambda p, a=a: weight(p) * p[a]) / total(weight)).cast("int"), F.lit(0)) for a in "xy"}
    asked = cells.select(*keys, "row_no", "col").join(field, keys, "left").withColumns(moved)
    asked = asked.select("yr", "row_no", "col", (F.col("row_no") + F.col("_y")).alias("sr"), (F.col("col") + F.col("_x")).alias("sc"))
    source = pixels.select("yr", F.col("row_no").alias("sr"), F.col("col").alias("sc"), "h")
    return asked.join(source, ["yr", "sr", "sc"], "left").select("yr", "row_no", "col", "h")
