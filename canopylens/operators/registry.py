"""The tree registry: field crowns with the names, sizes and dates of the trees that they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopylens.functions import names


def first_stems(oldtree: DataFrame) -> DataFrame:
    """One row for each tag: stems numbered 1 or without number, the first in the order of all columns."""
    stem = F.col("stem_tag").try_cast("double")
    order = Window.partitionBy("tag").orderBy(*[F.col(c).asc_nulls_first() for c in oldtree.columns])
    return oldtree.where(stem.isNull() | (stem == 1)).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def last_names(species: DataFrame) -> DataFrame:
    """One latin name for each mnemonic; of several the last one counts."""
    return species.groupBy("spp").agg(F.max("latin").alias("latin"))


def registry_mnemonic(crowns: DataFrame, stems: DataFrame) -> DataFrame:
    """crowns with the registry's mnemonic, or their own where the registry has none."""
    known = stems.select("tag", F.col("mnemonic").alias("_m"))
    return crowns.join(known, "tag", "left").withColumn("mnemonic", F.coalesce("_m", "mnemonic")).drop("_m")


def add_latin(crowns: DataFrame, species: DataFrame) -> DataFrame:
    return crowns.join(F.broadcast(last_names(species)) if species.limit(100_001).count() <= 100_000 else last_names(species), crowns["mnemonic"] == F.col("spp"), "left").drop("spp")


def add_diameter(crowns: DataFrame, stems: DataFrame) -> DataFrame:
    return crowns.join(stems.select("tag", "dbh", F.col("exactdate").alias("dbh_date")), "tag", "left")


def build_registry(raw: DataFrame, oldtree: DataFrame, species: DataFrame, field: int | None = None) -> DataFrame:
    """raw field crowns, each once, with registry mnemonic, latin name, diameter and its date.

    field: characters of a tag in oldtree, if its tags are cut to a fixed number; the crowns' tags then are too.
    """
    stems = first_stems(oldtree)
    crowns = registry_mnemonic(raw.withColumn("tag", names.normal_tag(F.col("tag"), field)), stems)
    return add_diameter(add_latin(crowns, species), stems)


def without_mnemonic(crowns: DataFrame) -> DataFrame:
    return crowns.where(F.col("mnemonic").isNull())
