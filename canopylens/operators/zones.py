"""Cells of crowns from pixels as rows, (yr, row_no, col, bands): what the surveys' canopies are, sparse around crowns.

Crowns and pixels meet by date and block of the grid in an equi-join; then rows and columns, and last the outline, are
compared. Rasters that come as dense chunks have chunks.zonal_pixels, which makes one mask for each crown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopylens.functions import geometry as G

#: Rows and columns of a block: about the size of a crown's box, so that few pixels meet crowns that they aren't near.
BLOCK = 16


def crossings(geom: Column) -> Column:
    """The edges of all rings that a row of cells can cross, as (ax, ay, bx, by)."""
    lines = F.filter(F.flatten(F.transform(geom, G.edges)), lambda e: e["a"]["y"] != e["b"]["y"])
    return F.transform(lines, lambda e: F.struct(e["a"]["x"].alias("ax"), e["a"]["y"].alias("ay"), e["b"]["x"].alias("bx"), e["b"]["y"].alias("by")))


def inside(lines: Column, x: Column, y: Column) -> Column:
    """The even-odd rule over crossings()."""
    met = F.filter(lines, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]))
    return F.size(met) % 2 == 1


def zonal_cells(crowns: DataFrame, pixels: DataFrame, bands: list[str], pad: float | None = None, others: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(id, yr, row_no, col, bands, others): the cells of each crown's date whose centres lie in the crown (id, yr, geom).

    With a pad: those in the crown's bounds and so far around them. others: columns of the crowns that go along. Cells
    without a value in any band don't count.
    """
    box = G.padded(G.bbox(F.col("geom")), pad or 0)
    ends = {"_row0": F.ceil(box["ymin"] - 0.5), "_row1": F.floor(box["ymax"] - 0.5), "_col0": F.ceil(box["xmin"] - 0.5), "_col1": F.floor(box["xmax"] - 0.5)}
    outline = [crossings(F.col("geom")).alias("_lines")] if pad is None else []
    known = crowns.where("geom is not null").select("id", "yr", *others, *[c.cast("int").alias(n) for n, c in ends.items()], *outline).where("_row0 <= _row1 and _col0 <= _col1")
    at = lambda c: F.floor(F.col(c) / block).cast("int")
    placed = known.withColumn("_block_row", F.explode(F.sequence(at("_row0"), at("_row1")))).withColumn("_block_col", F.explode(F.sequence(at("_col0"), at("_col1"))))
    cells = pixels.select("yr", "row_no", "col", *bands, at("row_no").alias("_block_row"), at("col").alias("_block_col")).where(F.coalesce(*bands).isNotNull())
    near = F.col("row_no").between(F.col("_row0"), F.col("_row1")) & F.col("col").between(F.col("_col0"), F.col("_col1"))
    if pad is None:
        near = near & inside(F.col("_lines"), F.col("col") + 0.5, F.col("row_no") + 0.5)
    # a block has few pixels, but may have any number of crowns: these are the side that is streamed
    return placed.join(cells, ["yr", "_block_row", "_block_col"]).where(near).select("id", "yr", "row_no", "col", *bands, *others)


def crown_chips(crowns: DataFrame, pixels: DataFrame, bands: list[str], pad: int, draw=lambda outline: outline) -> DataFrame:
    """The cells around each crown for pictures of it, with their place in the picture and the outline drawn in it.

    (id, yr, row_no, col, bands, chip_row, chip_col, outline: an array of points in cells from the picture's corner, or
    what draw, called once for each crown, makes of it).
    """
    corner = G.bbox(F.col("geom"))
    framed = crowns.select("id", "yr", "geom", (F.floor(corner["xmin"]) - pad).cast("int").alias("_left"), (F.floor(corner["ymin"]) - pad).cast("int").alias("_top"))
    framed = framed.withColumn("outline", draw(G.to_pixels(F.col("geom"), F.col("_left"), F.col("_top"), 1.0)[0]))
    cells = zonal_cells(framed, pixels, bands, pad, ("_left", "_top", "outline"))
    return cells.withColumns({"chip_row": F.col("row_no") - F.col("_top"), "chip_col": F.col("col") - F.col("_left")}).drop("_left", "_top")
