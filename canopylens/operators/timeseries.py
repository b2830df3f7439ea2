"""Crown observations over time: outliers, replacement, species tables, rankings, slices of the series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stack(layers: dict[int, DataFrame], label: str = "yr") -> DataFrame:
    """Layers of several dates as one table with a column that says which."""
    out = None
    for key, layer in layers.items():
        layer = layer.withColumn(label, F.lit(key))
        out = layer if out is None else out.unionByName(layer, allowMissingColumns=True)
    return out


def flag_outliers(obs: DataFrame, key: str = "tag", value: str = "area", width: float = 2.0) -> DataFrame:
    """obs with outlier: further than width standard deviations from the mean of its key. One value is none."""
    own = Window.partitionBy(key)
    far = F.abs(F.col(value) - F.avg(value).over(own)) > width * F.stddev_samp(value).over(own)
    return obs.withColumn("outlier", F.coalesce(far, F.lit(False)))


def replace_outliers(obs: DataFrame, ref: int, key: str = "tag", value: str = "area") -> DataFrame:
    """Outliers take the value of the reference date; without one they keep their own."""
    at_ref = F.max(F.when(F.col("yr") == ref, F.col(value))).over(Window.partitionBy(key))
    return obs.withColumn("used", F.when(F.col("outlier"), F.coalesce(at_ref, value)).otherwise(F.col(value)))


def best_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_by(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def species_summary(obs: DataFrame, thresholds: list[int]) -> DataFrame:
    """For each species how many tags ever were larger than each threshold; species with none are listed with 0."""
    largest = obs.where("latin is not null").groupBy("latin", "tag").agg(F.max("area").alias("area"))
    return largest.groupBy("latin").agg(*[F.count_if(F.col("area") > t).alias(f"over_{t}") for t in thresholds])


def ever_larger(obs: DataFrame, threshold: float) -> DataFrame:
    """All rows of the tags that exceeded the threshold on any date."""
    return obs.join(obs.where(F.col("area") > threshold).select("tag").distinct(), "tag", "left_semi")


def layer_summary(obs: DataFrame, plot_area: float) -> DataFrame:
    mapped = F.sum("area")
    return obs.groupBy("yr").agg(F.countDistinct("latin").alias("n_species"), F.countDistinct("tag").alias("n_tags"), mapped.alias("mapped_area"), F.round(mapped / plot_area * 100, 4).alias("percent"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def most_frequent(df: DataFrame, column: str, k: int) -> DataFrame:
    return frequencies(df, column).orderBy(F.desc("n"), column).limit(k)


def kth_species_largest(obs: DataFrame, k: int, n: int) -> DataFrame:
    """The n largest crowns of the k-th most frequent species."""
    rank = frequencies(obs, "latin").withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "latin")))
    crowns = obs.join(F.broadcast(rank.where(F.col("rank") == k).select("latin").limit(1)), "latin", "left_semi")
    return crowns.orderBy(F.desc("area"), "tag", "yr").limit(n)


def outward(dates: DataFrame, anchor: int, date: str = "yr") -> DataFrame:
    """Dates with their direction from the anchor and their step away from it; the anchor itself has step 0."""
    side = F.when(F.col(date) < anchor, "backward").when(F.col(date) > anchor, "forward").otherwise("anchor")
    far = Window.partitionBy("direction").orderBy(F.abs(F.col(date) - anchor))
    return dates.select(date).distinct().withColumn("direction", side).withColumn("step", F.when(F.col("direction") == "anchor", 0).otherwise(F.row_number().over(far)))


def adjacent(dates: DataFrame, anchor: int, date: str = "yr") -> DataFrame:
    """Each date with the next one towards the anchor, which it is aligned to."""
    order = Window.partitionBy("direction").orderBy("step")
    return outward(dates, anchor, date).where("step > 0").withColumn("reference", F.coalesce(F.lag(date).over(order), F.lit(anchor)))


def every_nth(dates: DataFrame, n: int, date: str = "yr") -> DataFrame:
    order = Window.partitionBy(F.lit(0)).orderBy(date)
    return dates.select(date).distinct().withColumn("_n", F.row_number().over(order) - 1).where(F.pmod("_n", F.lit(n)) == 0).select(date)


def pages(obs: DataFrame, size: int) -> DataFrame:
    """Each year's crowns in pages of so many, largest first."""
    order = Window.partitionBy("yr").orderBy(F.desc("area"), "tag")
    return obs.withColumn("page", F.floor((F.row_number().over(order) - 1) / size))


def area_band(obs: DataFrame) -> DataFrame:
    """Area with the band of one standard deviation of its tag."""
    spread = F.stddev_samp("area").over(Window.partitionBy("tag"))
    return obs.select("tag", "yr", "area", F.round(F.col("area") - spread, 4).alias("lower"), F.round(F.col("area") + spread, 4).alias("upper"))


def with_attributes(obs: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    return obs.join(attributes, key, "left")
