"""Mission inventory: which files and products there are, which are missing, what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopylens.functions import names

#: Folders that a raw mission, and a finished product, may hold; each list by itself is right.
RAW_FOLDERS = (("Images", "Images_extra"), ("Images", "Images_extra", "Videos"))
PRODUCT_FOLDERS = (("Cloudpoint", "DSM", "Orthophoto", "Project"), ("Cloudpoint", "DSM", "Model", "Orthophoto", "Project"))
IMAGES = "[.](jpg|jpeg|tif)$"


def unmatched_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two lists has, and which one."""
    a, b = left.select(key).distinct().withColumn("in_left", F.lit(True)), right.select(key).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, key, "full").where("in_left is null or in_right is null").select(key, F.when(F.col("in_right").isNull(), "left").otherwise("right").alias("only_in"))


def surrogate_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with a GlobalID that the same key columns always get again."""
    return df.withColumn("GlobalID", F.md5(F.concat_ws("|", *keys)))


def pending(catalogue: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the catalogue whose output isn't there yet."""
    return catalogue.join(done.select(*keys).distinct(), keys, "left_anti")


def missing_products(files: DataFrame, missions: DataFrame, kind: str) -> DataFrame:
    """Missions without the file that their product of this kind should be; unknown drones have no such name."""
    there = files.where(F.col("kind") == kind).select("mission", F.element_at(F.split("path", "/"), -1).alias("expected"))
    wanted = missions.select("yr", "mission", names.expected_product(F.col("mission"), kind).alias("expected"))
    return wanted.join(there.distinct(), ["mission", "expected"], "left_anti").select("yr", "mission", "expected")


def names_by_kind(files: DataFrame) -> DataFrame:
    """(yr, mission, kind, names): file names in order, joined by commas; null for a kind without files."""
    joined = F.array_join(F.sort_array(F.collect_list(F.element_at(F.split("path", "/"), -1))), ", ")
    return files.groupBy("yr", "mission", "kind").agg(F.nullif(joined, F.lit("")).alias("names"))


def folder_check(folders: DataFrame, allowed: tuple[tuple[str, ...], ...]) -> DataFrame:
    """(yr, mission, ok): whether a mission's folders (yr, mission, folder) are just those of one of the allowed lists."""
    lists = F.array(*[F.array(*[F.lit(k) for k in sorted(one)]) for one in allowed])
    return folders.groupBy("yr", "mission").agg(F.sort_array(F.collect_set("folder")).alias("own")).select("yr", "mission", F.array_contains(lists, F.col("own")).alias("ok"))


def image_check(missions: DataFrame, files: DataFrame) -> DataFrame:
    """(yr, mission, n_images, has_images)."""
    images = files.where((F.col("kind") == "Images") & F.lower("path").rlike(IMAGES)).groupBy("mission").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return missions.join(images, "mission", "left").select("yr", "mission", n.alias("n_images"), (n > 0).alias("has_images"))


def work_queue(missions: DataFrame, files: DataFrame) -> DataFrame:
    """Missions without an orthomosaic that have at least one photograph."""
    ortho = files.where("kind = 'Orthophoto'").select("mission").distinct()
    photos = files.where("kind = 'Images' and lower(path) rlike '[.]jpe?g$'").select("mission")
    return missions.join(ortho, "mission", "left_anti").join(photos, "mission", "left_semi").select("yr", "mission")


def mission_audit(missions: DataFrame, products: DataFrame, files: DataFrame, folders: DataFrame) -> DataFrame:
    """One row for each mission with every check and the verdict over all of them, by one grouping of all that is told.

    folders: (yr, mission, part, folder), part raw or product. A mission without folders has no right structure, and a
    file counts for its kind if it has the name that the mission's product should have.
    """
    none, no_year = F.lit(None).cast("string"), F.lit(None).cast(missions.schema["yr"].dataType)

    def told(df: DataFrame, what: str, name: Column = none, kind: Column = none, yr: Column = no_year) -> DataFrame:
        return df.select("mission", F.lit(what).alias("what"), name.alias("name"), kind.alias("kind"), yr.alias("yr"))

    rows = told(missions, "mission", yr=F.col("yr")).unionByName(told(products, "product"))
    rows = rows.unionByName(told(files, "file", F.element_at(F.split("path", "/"), -1), F.col("kind"))).unionByName(told(folders, "folder", F.col("folder"), F.col("part")))
    is_a = lambda what, kind=None: (F.col("what") == what) & (F.lit(True) if kind is None else F.col("kind") == kind)
    folder_list = lambda part: F.sort_array(F.collect_set(F.when(is_a("folder", part), F.col("name"))))
    is_list = lambda part, allowed: F.array_contains(F.array(*[F.array(*[F.lit(k) for k in sorted(one)]) for one in allowed]), folder_list(part))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    has = {f"has_{n}": any_of(is_a("file", k) & (F.col("name") == names.expected_product(F.col("mission"), k))) for n, k in (("ortho", "Orthophoto"), ("dsm", "DSM"), ("cloud", "Cloudpoint"), ("report", "Report"))}
    checks = {
        "in_products": any_of(is_a("product")), "raw_structure_ok": is_list("raw", RAW_FOLDERS), "has_images": any_of(is_a("file", "Images") & F.lower("name").rlike(IMAGES)),
        "product_structure_ok": is_list("product", PRODUCT_FOLDERS), **has,
    }
    years = F.collect_set(F.when(is_a("mission"), F.struct("yr"))).alias("years")
    out = rows.groupBy("mission").agg(years, *[c.alias(n) for n, c in checks.items()]).select(F.explode("years.yr").alias("yr"), "mission", *checks)
    return out.withColumn("all_ok", F.expr(" and ".join(checks)))


def year_verdict(audit: DataFrame) -> DataFrame:
    return audit.groupBy("yr").agg(F.bool_and("all_ok").alias("all_ok"), F.count("*").alias("missions"), F.count_if("all_ok").alias("complete"))


def corrected_cameras(cameras: DataFrame, ppk: DataFrame, fallback: bool = False) -> DataFrame:
    """cameras with the corrected coordinates. Without a match they are null, or with fallback the old ones."""
    new = ppk.select("label", *[F.col(c).alias(f"_{c}") for c in "xyz"])
    place = lambda c: F.coalesce(f"_{c}", c) if fallback else F.col(f"_{c}")
    return cameras.join(new, "label", "left").select("label", *[place(c).alias(c) for c in "xyz"], "yaw")
