"""Map algebra on pixels: one row for each (raster, row, column), one column for each band. Chunks are in chunks.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopylens.sources.tables import round_trip_parquet

CELL = ["yr", "row_no", "col"]


def mask_nodata(df: DataFrame, bands: list[str], nodata: float) -> DataFrame:
    return df.withColumns({b: F.when(F.col(b) != nodata, F.col(b)) for b in bands})


def map_coordinates(df: DataFrame, a: float, c: float, e: float, f: float) -> DataFrame:
    """df with x and y of the cell centres under the transform (a, c; e, f)."""
    return df.withColumns({"x": c + a * (F.col("col") + 0.5), "y": f + e * (F.col("row_no") + 0.5)})


def cell_at(x: Column, y: Column, a: float, c: float, e: float, f: float) -> tuple[Column, Column]:
    """Row and column of the cell that holds a map point."""
    return F.floor((y - f) / e).cast("int"), F.floor((x - c) / a).cast("int")


#: A transform (a, b, c, d, e, f): x = a col + b row + c and y = d col + e row + f, for corners of cells.
Affine = tuple[float, float, float, float, float, float]


def resample(target: DataFrame, at: Affine, source: DataFrame, of: Affine, bands: list[str], keys: list[str] | None = None) -> DataFrame:
    """target with the bands of the source cell that holds each target centre; null outside the source.

    at, of: the transforms of target and source. Rows meet by the source's row and column, and by keys, such as the date.
    """
    col, row = F.col("col") + 0.5, F.col("row_no") + 0.5
    x, y = at[0] * col + at[1] * row + at[2], at[3] * col + at[4] * row + at[5]
    a, b, c, d, e, f = of
    size = a * e - b * d
    place = {"_col": F.floor((e * (x - c) - b * (y - f)) / size).cast("int"), "_row": F.floor((a * (y - f) - d * (x - c)) / size).cast("int")}
    given = source.select(*(keys or []), F.col("row_no").alias("_row"), F.col("col").alias("_col"), *bands)
    return target.withColumns(place).join(given, [*(keys or []), "_row", "_col"], "left").drop("_row", "_col")


def canopy_height(df: DataFrame, surface: str, terrain: str, most: float = 150) -> DataFrame:
    """chm: surface above terrain; below 0 and over most it is 0."""
    height = F.col(surface) - F.col(terrain)
    return df.withColumn("chm", F.when((height > most) | (height < 0), 0.0).otherwise(height))


def mosaic(df: DataFrame, order: str, bands: list[str]) -> DataFrame:
    """Of rasters that overlap, each cell's first value that isn't null."""
    return df.groupBy("row_no", "col").agg(*[F.min_by(b, F.when(F.col(b).isNotNull(), F.col(order))).alias(b) for b in bands])


def tile_size(extent: float, size: float) -> tuple[int, float]:
    """Number and size of tiles along an extent: as many as fit with one more for a rest, evenly large."""
    n = max(1, -(-extent // size))
    return int(n), extent / n


def tile_grid(spark, xmin: float, ymin: float, xmax: float, ymax: float, size: float) -> DataFrame:
    """(tile_id, xmin, ymin, xmax, ymax): tiles of about the size that cover the extent."""
    if size <= 0:
        raise ValueError("tile size must be positive")
    (nx, dx), (ny, dy) = tile_size(xmax - xmin, size), tile_size(ymax - ymin, size)
    grid = spark.range(nx * ny).select("id", (F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx).alias("j"))
    return grid.select(F.col("id").alias("tile_id"), (xmin + F.col("i") * dx).alias("xmin"), (ymin + F.col("j") * dy).alias("ymin"), (xmin + (F.col("i") + 1) * dx).alias("xmax"), (ymin + (F.col("j") + 1) * dy).alias("ymax"))


def shift_transform(rasters: DataFrame, shifts: DataFrame, key: str) -> DataFrame:
    """rasters (key, c, f) moved by (xs, ys): only the origin changes, no cell is read."""
    moved = rasters.join(shifts, key, "left")
    return moved.withColumns({"c": F.col("c") + F.coalesce("xs", F.lit(0.0)), "f": F.col("f") + F.coalesce("ys", F.lit(0.0))}).drop("xs", "ys")


def add_offset(df: DataFrame, offsets: DataFrame, band: str) -> DataFrame:
    """band plus its date's offset; null stays null."""
    return df.join(offsets.select("yr", "offset"), "yr").withColumn(band, F.col(band) + F.col("offset")).drop("offset")


def difference(a: DataFrame, b: DataFrame, band: str) -> DataFrame:
    return a.select("row_no", "col", F.col(band).alias("_a")).join(b.select("row_no", "col", F.col(band).alias("_b")), ["row_no", "col"]).select("row_no", "col", (F.col("_a") - F.col("_b")).alias("delta"))


def fixed_bins(df: DataFrame, value: str, width: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))


def stretch(df: DataFrame, band: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """band clipped to its date's percentiles and stretched over 0 to 255."""
    ends = df.groupBy("yr").agg(F.percentile(band, F.array(F.lit(low), F.lit(high))).alias("p"))
    lo, hi, v = F.col("p")[0], F.col("p")[1], F.col(band)
    return df.join(ends, "yr").withColumn("stretched", F.try_divide(F.greatest(lo, F.least(hi, v)) - lo, hi - lo) * 255).drop("p")


def grey(r: Column, g: Column, b: Column) -> Column:
    """Grey with the weights of blue and red in the places that the surveys used."""
    return F.floor(0.114 * r + 0.587 * g + 0.299 * b + 0.5).cast("double")


#: Ranges that values are counted in at a time, and values of a group that are sorted at once.
RANGES, FEW = 1024, 4096


def median_of(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, median): the exact median, by selection. Null and NaN don't count.

    The values of each group are counted in ranges between its smallest and largest one; only the range that holds the
    middle is looked at again, between the smallest and largest value in it, until it holds one value, or few that are
    sorted. A window never has more than RANGES rows, whatever the number of values, and each round is one pass.
    """
    keyed = df.select(*keys, F.lit(0).alias("_all"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    values, names = round_trip_parquet(keyed, []), ["_all", *keys]
    rank = {"_left": F.floor((F.col("_n") - 1) / 2), "_right": F.floor(F.col("_n") / 2)}
    state = values.groupBy(*names).agg(F.count("*").alias("_n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    state = round_trip_parquet(state.withColumns({**rank, "_below": F.lit(0).cast("long"), "_in": F.col("_n"), "median": F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))}), [])
    within = lambda of: of.join(values.withColumnsRenamed({c: f"_v{c}" for c in names}), [F.col(c).eqNullSafe(F.col(f"_v{c}")) for c in names]).where(F.col("v").between(F.col("_lo"), F.col("_hi")))
    is_open = F.col("median").isNull() & (F.col("_in") > FEW)
    while not state.where(is_open).isEmpty():
        place = F.least(F.floor((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * RANGES), F.lit(RANGES - 1))
        counts = within(state.where(is_open)).groupBy(*names, "_n", "_left", "_right", "_below", place.alias("_at")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.col("_below") + F.sum("c").over(Window.partitionBy(*names).orderBy("_at"))
        met = counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("_left")) & (F.col("_upto") - F.col("c") <= F.col("_right")))
        # the middle lies in one range, or between the largest value of one and the smallest of the next that isn't empty
        one = met.groupBy(*names, "_n", "_left", "_right").agg(
            F.count("*").alias("ranges"), F.min("least").alias("_lo"), F.max("most").alias("_hi"), F.min(F.col("_upto") - F.col("c")).alias("_below"), F.sum("c").alias("_in"),
            F.min("most").alias("low_end"), F.max("least").alias("high_start"),
        )
        settled = F.when(F.col("ranges") == 2, (F.col("low_end") + F.col("high_start")) / 2).when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
        state = round_trip_parquet(state.where(~is_open).unionByName(one.withColumn("median", settled).select(*state.columns)), [])
    last = within(state.where("median is null")).groupBy(*names, "_left", "_right", "_below").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # at most FEW
    middle = (F.get("vs", (F.col("_left") - F.col("_below")).cast("int")) + F.get("vs", (F.col("_right") - F.col("_below")).cast("int"))) / 2
    return state.where("median is not null").select(*keys, "median").union(last.select(*keys, middle.alias("median")))


def median_of_band(df: DataFrame, band: str, keys: list[str]) -> DataFrame:
    """Median of the values that are not 0."""
    return median_of(df.where(F.col(band) != 0), band, keys)


def total_bounds(df: DataFrame, keys: list[str], box: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(f"{box}.xmin").alias("xmin"), F.min(f"{box}.ymin").alias("ymin"), F.max(f"{box}.xmax").alias("xmax"), F.max(f"{box}.ymax").alias("ymax"))
