"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable
from tempfile import mkdtemp
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where that is unset, a local session (tests) makes one; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later work starts from the files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What the tasks of a Python worker keep for later ones, of one operator at a time.
_kept: dict[str, object] = {}


def keep(name: str, make: Callable[[], object]) -> object:
    """What make() gives, made once in a worker for as long as its tasks are of one operator."""
    if name not in _kept:
        forget()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    """Drop what tasks of other operators have kept in this worker, and give freed memory back to the system."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def words_of(text: Column) -> Column:
    """Array of a text's words; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: Rows up to which a table of a few numbers a row is sent to all executors; beyond, it is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def sent_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; it is counted for that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Keys that get several tasks in a join: those with more than one in so many of all rows.
HOT_SHARE = 200


def hot_keys_split(rows: DataFrame, found: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows joined with found, a written table of one row for each key, which has in n how many of the rows have it.

    Keys of more than 1 / HOT_SHARE of the rows, of which there are fewer than HOT_SHARE, are dealt to several tasks
    each: those of rows by a hash of the whole row, and found's row goes to all of them. They alone are broadcast.
    """
    total = found.agg(F.sum(n)).first()[0] or 0
    hot = found.where(F.col(n) * HOT_SHARE > total).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.ceil(F.col(n) * HOT_SHARE / max(total, 1)).alias("_deal"))
    same = lambda other: [F.col(k) == other[f"_hot_{k}"] for k in keys]
    dealt = rows.join(F.broadcast(hot), same(hot), "left").withColumn("_to", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_deal", F.lit(1)))).select(*rows.columns, "_to")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_deal", F.lit(1)) - 1))
    spread = found.join(F.broadcast(hot), same(hot), "left").select(*keys, *[c for c in found.columns if c not in keys and c != n], copies.alias("_to"))
    return dealt.join(spread, [*keys, "_to"]).drop("_to")


def hashable(docs: DataFrame, name: str) -> Column:
    """A column of docs, as JSON if there are maps or variants anywhere in it, which Spark doesn't hash."""
    kind = docs.schema[name].dataType
    return F.to_json(F.struct(F.col(name))) if re.search(r"\b(map<|variant\b)", kind.simpleString()) else F.col(name)


#: Copies of one row that a task makes at a time.
COPIES = 1_000


def numbered(rows: DataFrame) -> DataFrame:
    """rows with _row, a hash of all columns and of a number: 0, or for rows that repeat 0, 1, 2, ..., one for each copy.

    Copies are interchangeable, so that one of each is kept and made again as often as it was there, in loads of COPIES
    that are dealt to tasks. So copies of a row are told apart, whatever partitions they come from, and no window counts
    them. Only where rows repeat at all is more done than to count hashes.
    """
    columns = [hashable(rows, c) for c in rows.columns]
    known = rows.withColumn("_key", F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b")))
    again = cut(known.groupBy(F.col("_key").alias("_again")).agg(F.count("*").alias("_copies")).where("_copies > 1"), "repeated-rows")
    named = lambda df: df.withColumn("_row", F.xxhash64("_key", "_nth")).drop("_key", "_nth")
    if again.isEmpty():
        return named(known.withColumn("_nth", F.lit(0).cast("long")))
    same = F.col("_key") == F.col("_again")
    once = known.join(again, same, "left_anti").withColumn("_nth", F.lit(0).cast("long"))
    one = known.join(again, same).drop("_again").dropDuplicates(["_key"])
    loads = one.withColumn("_load", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / COPIES)))).repartition("_key", "_load")
    last = F.least(F.col("_copies"), (F.col("_load") + 1) * COPIES) - 1
    return named(once.unionByName(loads.withColumn("_nth", F.explode(F.sequence(F.col("_load") * COPIES, last))).drop("_load", "_copies")))


def fenced(df: DataFrame) -> DataFrame:
    """df behind a column that is not deterministic: filters on df's columns stay above it.

    Moved below, a filter would take the columns' expressions with it, and inside a lambda compute them for each element.
    """
    return df.withColumn("_fence", F.monotonically_increasing_id()).where("_fence >= 0").drop("_fence")


def shielded(docs: DataFrame, used: tuple[str, ...], work: Callable[[DataFrame], DataFrame], new: list[str] | None = None) -> DataFrame:
    """The columns of docs, and those that are new, from work(docs).

    Meanwhile all columns but those used are named _user_0, _user_1, ..., so that they meet no name of work's own.
    """
    names = {c: f"_user_{k}" for k, c in enumerate(docs.columns) if c not in used}
    out = work(docs.withColumnsRenamed(names))
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns], *(new or []))
