"""Table functions for SQL users."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from canopylens.operators.raster import tile_size


@udtf(returnType="tile_id: long, xmin: double, ymin: double, xmax: double, ymax: double")
class TileGrid:
    """Tiles of about a size that cover an extent, row by row."""

    def eval(self, xmin: float, ymin: float, xmax: float, ymax: float, size: float) -> Iterator[tuple]:
        xmin, ymin, xmax, ymax, size = map(float, (xmin, ymin, xmax, ymax, size))
        if size <= 0:
            raise ValueError("tile size must be positive")
        (nx, dx), (ny, dy) = tile_size(xmax - xmin, size), tile_size(ymax - ymin, size)
        for j in range(ny):
            for i in range(nx):
                yield j * nx + i, xmin + i * dx, ymin + j * dy, xmin + (i + 1) * dx, ymin + (j + 1) * dy


@udtf(returnType="tile_id: long")
class TilesAt:
    """The tiles of TileGrid that a box meets, a tile's lower edges being its own: by arithmetic, for a lateral call."""

    def eval(self, xmin: float, ymin: float, xmax: float, ymax: float, left: float, bottom: float, right: float, top: float, size: float) -> Iterator[tuple]:
        (nx, dx), (ny, dy) = tile_size(float(right - left), float(size)), tile_size(float(top - bottom), float(size))

        def place(v: float, start: float, step: float, n: int) -> int:
            """The tile that holds v, by the edges that TileGrid gives; the division may be one off."""
            k = int((v - start) // step)
            k += (start + (k + 1) * step <= v) - (start + k * step > v)
            return min(n - 1, k)

        for j in range(max(0, place(ymin, bottom, dy, ny)), place(ymax, bottom, dy, ny) + 1):
            for i in range(max(0, place(xmin, left, dx, nx)), place(xmax, left, dx, nx) + 1):
                yield (j * nx + i,)


def register(spark: SparkSession) -> None:
    """Make tile_grid(xmin, ymin, xmax, ymax, size) and tiles_at(box, extent, size) known to spark.sql."""
    spark.udtf.register("tile_grid", TileGrid)
    spark.udtf.register("tiles_at", TilesAt)
