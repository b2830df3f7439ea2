"""Incremental intake of missions with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the Parquet files of a table, which is one file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    # as a pattern, since a stream's plain path can't be a file
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}").withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, target: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Process what has arrived since the last run with this target, and return all that has been written there.

    keys: rows whose keys are in the table already are left out, however late they come or however often; of the new
    rows of a batch one for each key is kept, the first by time. The table is the manifest: what a batch wrote before
    it failed doesn't count when it is repeated. Only the keys of the table are read.

    target: a folder that all executors share. It holds the state of the stream, so that a run after this one takes up
    where it stopped; table, the rows; and audit, how many rows each batch wrote. A batch is written under its number, so
    that one that is repeated after a failure replaces itself. With mode complete each batch replaces the one before.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        place = f"batch={number if mode == 'append' else 0}"
        if keys:
            batch = unseen(batch, keys, f"{target}/table", number)
        batch.write.mode("overwrite").parquet(f"{target}/table/{place}")
        written = spark.read.schema(batch.schema).parquet(f"{target}/table/{place}")
        written.agg(F.count("*").alias("n_rows")).withColumn("arrived", F.current_timestamp()).write.mode("overwrite").parquet(f"{target}/audit/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/table").select(*stream.columns)


def unseen(batch: DataFrame, keys: list[str], table: str, number: int) -> DataFrame:
    """The first row by ts of each key in batch that no batch but this one has written into table; null keys are one."""
    spark, columns = batch.sparkSession, batch.columns
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*columns), "ts").alias("row")).select("row.*")
    if number == 0:
        return first
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.select(*keys).schema)
    had = spark.read.schema(f"{kinds}, batch long").parquet(table).where(F.col("batch") != number)
    had = had.select(*[F.col(k).alias(f"_had_{k}") for k in keys])
    same = [first[k].eqNullSafe(had[f"_had_{k}"]) for k in keys]
    return first.join(had, same, "left_anti")


def audit(spark: SparkSession, target: str) -> DataFrame:
    """(batch, n_rows, arrived) of the batches that runs with this target have written."""
    return spark.read.parquet(f"{target}/audit")


def first_deliveries(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first delivery of each key within the time that late ones may take."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def delivery_times(stream: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, last, n): when each key was delivered first and last, and how often; its state is one row a key."""
    return stream.groupBy(*keys).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


def area_statistics(stream: DataFrame, lengths: list[int]) -> DataFrame:
    """(days, start, n, total, mean): count, sum and mean of the values of each period, kept up as observations arrive.

    lengths: days of a period; each length has periods of its own, counted from 1970-01-01. The date is that of the
    session's time zone; observations without a time are one period, with no start. For mode complete; its state is one
    row a period.
    """
    rows = stream.select("value", F.unix_date(F.col("ts").cast("date")).alias("day"), F.explode(F.array(*map(F.lit, lengths))).alias("days"))
    start = F.date_from_unix_date(F.col("day") - F.pmod("day", "days")).alias("start")
    return rows.groupBy("days", start).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 4).alias("mean"))
