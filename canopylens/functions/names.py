"""Columns from file and crown names. An input that lacks the asked-for part gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the drones that name a mission, and the words for its products.
DRONES = ("P4P", "EBEE", "INSPIRE", "SOLO", "M3E")
PRODUCTS = {"Orthophoto": ("orthomosaic", "tif"), "DSM": ("dsm", "tif"), "Cloudpoint": ("cloud", "las"), "Report": ("report", "pdf")}
#: Ends of the companion band images of an RGB image.
BANDS = ("MS_G.TIF", "MS_R.TIF", "MS_NIR.TIF", "MS_RE.TIF")


def date_at(name: Column, start: int = 10) -> Column:
    """The date written as yyyy_MM_dd at a fixed place, counted from 1."""
    return F.try_to_timestamp(F.substring(name, start, 10), F.lit("yyyy_MM_dd")).cast("date")


def date_tokens(name: Column, first: int = 3) -> Column:
    """Three '_' tokens of the name, joined again."""
    return F.array_join(F.slice(F.split(name, "_"), first, 3), "_")


def site_of(mission: Column) -> Column:
    return F.array_join(F.slice(F.split(mission, "_"), 1, 2), "_")


def expected_product(mission: Column, kind: str) -> Column:
    """The file name that a mission's product should have; null for an unknown drone."""
    word, ending = PRODUCTS[kind]
    drone = "(" + "|".join(DRONES) + ")$"
    return F.when(mission.rlike(drone), F.concat(F.regexp_replace(mission, drone, word), F.lit(f".{ending}")))


def stage_path(path: Column, renames: dict[str, str]) -> Column:
    for old, new in renames.items():
        path = F.replace(path, F.lit(old), F.lit(new))
    return path


def genus(latin: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(latin, " "), F.lit(1)), F.lit("unknown"))


def species(latin: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(latin, " "), F.lit(2)), F.lit("unknown"))


def crown_label(latin: Column, tag: Column, global_id: Column) -> Column:
    """genus_species_tag; crowns without a tag ('000000') are called by their global id."""
    return F.concat_ws("_", genus(latin), species(latin), F.when(tag == "000000", global_id).otherwise(tag))


def parse_label(label: Column) -> dict[str, Column]:
    """genus, species, crown_id and date of a label that ends in a year, month and day."""
    t = F.split(label, "_")
    part = lambda k: F.try_element_at(t, F.lit(k))
    return {"genus": part(1), "species": part(2), "crown_id": part(3), "date": F.try_to_date(F.concat_ws("-", part(-3), part(-2), part(-1)), "yyyy-M-d")}


def normal_tag(tag: Column, field: int | None = None) -> Column:
    """Null as 0, then zero-filled to six digits; longer tags stay.

    field: characters that a table's field of tags holds, if it is fixed. Longer tags are cut to it, as the table's are,
    so that tags which begin alike become one; leave it out wherever the table has room for them.
    """
    number = F.coalesce(tag.try_cast("long"), F.lit(0)).cast("string")
    filled = F.when(F.length(number) <= 6, F.lpad(number, 6, "0")).otherwise(number)
    return filled if field is None else F.substring(filled, 1, field)


def companion_bands(name: Column) -> Column:
    """Array of an RGB image's name and those of its four bands."""
    return F.array(name, *[F.replace(name, F.lit("D.JPG"), F.lit(b)) for b in BANDS])


def file_class(name: Column) -> Column:
    """Multispectral for TIF, RGB for JPG (as written), Georeference for the positioning files in any case."""
    low = F.lower(name)
    return F.when(name.endswith("TIF"), "Multispectral").when(name.endswith("JPG"), "RGB").when(low.rlike("(nav|obs|bin|mrk)$"), "Georeference")
