"""Scans and sinks: rasters and crowns as Parquet or GeoJSON, delimited text, file listings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopylens.functions import geometry as G
from canopylens.operators import chunks
from canopylens.sources.tables import round_trip_parquet, shared_path  # noqa: F401


def raster_table(pixels: DataFrame, bands: list[str], side: int = chunks.SIDE, per_file: int = 256) -> DataFrame:
    """Write pixels in chunks, partitioned by date, and open what was written.

    Neighbouring chunks lie together, in files of at most per_file chunks, so that scans of a window skip files by the
    bounds that their footers hold.
    """
    path = shared_path(pixels.sparkSession, "raster")
    built = chunks.to_chunks(pixels, bands, side)
    near = chunks.along_a_curve()
    dealt = built.repartition("yr", F.floor(near / per_file)).sortWithinPartitions("yr", near)
    dealt.write.option("maxRecordsPerFile", per_file).partitionBy("yr").parquet(path)
    return pixels.sparkSession.read.schema(built.schema).parquet(path)


def read_raster(table: DataFrame, bands: list[str]) -> DataFrame:
    """The pixels of some bands; the other bands' columns are not read."""
    return chunks.cells_of(table, bands)


def as_geojson(shapes: DataFrame) -> DataFrame:
    """L-shaped crowns as GeoJSON features, one text line for each."""
    g = G.l_shape(F.col("x0"), F.col("y0"), F.col("arm"), F.col("width"))
    coordinates = F.transform(g, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    return shapes.select(F.to_json(F.struct(F.struct("id").alias("properties"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"))).alias("value"))


def read_geojson(lines: DataFrame) -> DataFrame:
    """(id, geom) of GeoJSON features; a geometry that is no polygon is null."""
    schema = "properties struct<id: bigint>, geometry struct<type: string, coordinates: array<array<array<double>>>>"
    feature = lines.select(F.from_json("value", schema).alias("f"))
    rings = F.transform("f.geometry.coordinates", lambda r: F.transform(r, lambda p: G.point(p[0], p[1])))
    return feature.select("f.properties.id", F.when(F.col("f.geometry.type") == "Polygon", rings).alias("geom"))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.csv(path, header=True, sep=sep)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Delimited text under a fixed schema: no type is guessed, ids keep their zeros."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep)


def with_lines_above(lines: list[str]):
    """For mapInArrow, on rows of text: each file that a task writes begins with these lines."""

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("value")], names=["value"])

    return above


def read_csv_after(spark: SparkSession, path: str, schema: str, skip: int, sep: str = ",") -> DataFrame:
    """read_csv() of files whose header comes after some leading lines: these go by their place in each file.

    A file's first split holds its beginning, in order, so that counting there is enough; no file is read twice. Rows
    are single lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            keep = []
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                seen[file] = seen.get(file, 0) + 1
                keep.append(start > 0 or seen[file] > skip + 1)
            yield batch.select(["value"]).filter(pa.array(keep, pa.bool_()))

    rows = lines.mapInArrow(after, "value string").where("trim(value) <> ''")
    return rows.select(F.from_csv("value", schema, {"sep": sep}).alias("r")).select("r.*")


def round_trip_csv(df: DataFrame, sep: str) -> DataFrame:
    path = shared_path(df.sparkSession, "csv")
    write_csv(df, path, sep)
    return read_csv(df.sparkSession, path, df.schema, sep)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of all files under a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def named_like(files: DataFrame, beginning: str = "", endings: tuple[str, ...] = ("",)) -> DataFrame:
    """Files whose name, the last part of the path, begins and ends as asked."""
    name = F.element_at(F.split("path", "/"), -1)
    ends = [name.endswith(e) for e in endings]
    return files.where(name.startswith(beginning) & F.array_contains(F.array(*ends), F.lit(True)))
