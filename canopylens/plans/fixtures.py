"""Survey tables derived from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Characters of a tag in the tables and in the SQL, whose lpad cuts longer ones.
TAG_FIELD = 6

FIXTURES = {
    # one row for each crown and year: what a segmentation of every date gives
    "crown_obs": (
            "select l_partkey as tag, cast(year(l_shipdate) as int) as yr, sum(l_quantity) as area, max(p_name) as latin, max(p_brand) as "
            "mnemonic, max(p_size) as size from {lineitem} join {part} on l_partkey = p_partkey group by l_partkey, year(l_shipdate)"
        ),
    "raw_crowns": (
            "select case when p_partkey % 50 = 0 then null else concat('', p_partkey) end as tag, p_size * 1e0 as crown_area, p_type as crown, "
            "p_container as note, case when p_partkey % 7 = 0 then null else p_brand end as mnemonic, p_partkey as field_id from {part_c}"
        ),
    "part_c": "select p_partkey, p_name, p_brand, p_type, p_size, case when p_size % 2 = 0 then 'even' else 'odd' end as p_container from {part}",
    "oldtree": (
            "select lpad(concat('', l_partkey), 6, '0') as tag, case when l_linenumber = 7 then 'x' else concat('', l_linenumber) end as "
            "stem_tag, p_brand as mnemonic, l_quantity as dbh, cast(l_shipdate as date) as exactdate, l_orderkey, l_extendedprice, l_discount, "
            "l_suppkey from {lineitem} join {part} on l_partkey = p_partkey"
        ),
    "species": "select p_brand as spp, min(p_name) as latin from {part} group by p_brand",
    # one row for each pixel and year; b = 0 is nodata, and the grid has holes; it gets more rows with more parts
    "pixels": (
            "select cast(l_orderkey % 100 as int) as col, cast(l_partkey % 100 + 100 * floor(l_partkey / 2000) as int) as row_no, "
            "cast(year(l_shipdate) as int) as yr, cast(max(l_quantity) * 5 as int) as r, cast(max(l_linenumber) * 30 as int) as g, "
            "cast(max(round(l_discount * 1000)) as int) as b, floor(max(l_extendedprice) / 100) / 10 as h from {lineitem} group by l_orderkey "
            "% 100, l_partkey % 100 + 100 * floor(l_partkey / 2000), year(l_shipdate)"
        ),
    # cells around the crowns, more with more crowns
    "canopy": (
            "select cast(x0 + l_orderkey % 9 as int) as col, cast(y0 + floor(l_orderkey / 9) % 9 as int) as row_no, cast(year(l_shipdate) as "
            "int) as yr, cast(max(l_quantity) * 5 as int) as r, cast(max(l_linenumber) * 30 as int) as g, cast(max(round(l_discount * 1000)) "
            "as int) as b from {lineitem} join {shapes} on l_partkey = id group by x0 + l_orderkey % 9, y0 + floor(l_orderkey / 9) % 9, "
            "year(l_shipdate)"
        ),
    # a terrain grid at twice the pixel size
    "dtm": "select cast(p_partkey % 50 as int) as col, cast(floor(p_partkey / 50) as int) as row_no, p_size * 1e0 as t from {part}",
    # a surface grid at twice the pixel size
    "dsm": (
            "select yr, cast(floor(row_no / 2) as int) as row_no, cast(floor(col / 2) as int) as col, max(h) as h from {pixels} group by yr, "
            "floor(row_no / 2), floor(col / 2)"
        ),
    "plots": (
            "select n_name as name, cast(n_nationkey % 5 * 20 as int) as xmin, cast(floor(n_nationkey / 5) * 20 as int) as ymin, "
            "cast(n_nationkey % 5 * 20 + 20 as int) as xmax, cast(floor(n_nationkey / 5) * 20 + 20 as int) as ymax from {nation}"
        ),
    # L-shaped crowns: corner, arm length and arm width; 2,000 of them to a plot of 1000 x 500, plots side by side
    "shapes": (
            "select p_partkey as id, cast(p_partkey * 37 % 1000 + 1000 * floor(p_partkey / 2000) as int) as x0, cast(p_partkey * 91 % 500 as "
            "int) as y0, cast(3 + p_size % 7 as int) as arm, cast(1 + p_size % 3 as int) as width, p_brand as mnemonic from {part}"
        ),
    "shape_obs": (
            "select s.id, o.yr, s.x0 + o.yr % 3 as x0, s.y0, s.arm, s.width from {shapes} s join (select distinct l_partkey, "
            "cast(year(l_shipdate) as int) as yr from {lineitem}) o on s.id = o.l_partkey"
        ),
    # squares so close that each meets its neighbours, many of the same size
    "crowd": (
            "select p_partkey as id, cast(p_partkey % 40 * 3 as int) as x0, cast(floor(p_partkey / 40) * 3 as int) as y0, cast(4 + p_size % 3 "
            "as int) as arm, cast(4 + p_size % 3 as int) as width from {part}"
        ),
    "tie_points": (
            "select cast(day(ts) as int) as pair, user_id as x_map, round(value - 245, 2) as x_shift, cast(event_id % 21 as int) - 10 as "
            "y_shift, cast(event_id % 101 as int) as reliability, event_id from {events}"
        ),
    "missions_raw": (
            "select distinct cast(year(o_orderdate) as int) as yr, concat('BCI_50ha_', replace(substring(concat('', cast(o_orderdate as "
            "date)), 1, 10), '-', '_'), '_', case o_orderkey % 5 when 0 then 'P4P' when 1 then 'EBEE' when 2 then 'INSPIRE' when 3 then 'SOLO' "
            "else 'M3E' end) as mission from {orders}"
        ),
    "missions_product": (
            "select distinct cast(year(o_orderdate) as int) as yr, concat('BCI_50ha_', replace(substring(concat('', cast(o_orderdate as "
            "date)), 1, 10), '-', '_'), '_', case o_orderkey % 5 when 0 then 'P4P' when 1 then 'EBEE' when 2 then 'INSPIRE' when 3 then 'SOLO' "
            "else 'M3E' end) as mission from {orders} where o_orderstatus = 'F'"
        ),
    "files": (
            "select distinct m.yr, m.mission, k.kind, concat(m.mission, '/', k.kind, '/', case k.kind when 'Images' then 'DJI_0001.JPG' when "
            "'Orthophoto' then concat(substring(m.mission, 1, 20), 'orthomosaic.tif') when 'DSM' then concat(substring(m.mission, 1, 20), "
            "'dsm.tif') when 'Cloudpoint' then concat(substring(m.mission, 1, 20), 'cloud.las') else concat(substring(m.mission, 1, 20), "
            "'report.pdf') end) as path from {missions_raw} m join (select 'Images' as kind, 1 as n union all select 'Orthophoto', 2 union all "
            "select 'DSM', 3 union all select 'Cloudpoint', 4 union all select 'Report', 5) k on (ascii(substring(m.mission, 19, 1)) + n) % 4 "
            "<> 0"
        ),
    "folders": (
            "select yr, mission, part, folder from (select yr, mission, ascii(substring(mission, 19, 1)) % 6 as n from {missions_raw}) m join "
            "(select 'raw' as part, 'Images' as folder, 7 as miss union all select 'raw', 'Images_extra', 3 union all select 'raw', 'Videos', "
            "2 union all select 'product', 'Cloudpoint', 7 union all select 'product', 'DSM', 5 union all select 'product', 'Orthophoto', 7 "
            "union all select 'product', 'Project', 4 union all select 'product', 'Model', 1) k on n <> miss"
        ),
    "camera_ref": "select c_name as label, c_acctbal as x, c_custkey * 1e0 as y, c_nationkey * 1e0 as z, c_acctbal / 100 as yaw from {customer}",
    "ppk_ref": "select c_name as label, c_acctbal + 1 as x, c_custkey + 0.5e0 as y, c_nationkey + 0.25e0 as z from {customer} where c_custkey % 4 <> 0",
    "masks": (
            "select p_partkey as id, k, cast(p_partkey * (k + 3) % 11 as double) / 10 as score, cast(3 + p_size % 7 as int) + k as arm, cast(1 "
            "+ p_size % 3 as int) as width, cast(p_partkey * 37 % 1000 + 1000 * floor(p_partkey / 2000) as int) as x0, cast(p_partkey * 91 % "
            "500 as int) as y0 from {part} cross join (select 0 as k union all select 1 union all select 2) ks"
        ),
}


def expand(sql: str) -> str:
    """DuckDB SQL: each {name} of a fixture replaced by its query, each {name} of a table by its name."""
    while m := re.search(r"\{(\w+)\}", sql):
        name = m[1]
        sql = sql.replace(m[0], f"({FIXTURES[name]})" if name in FIXTURES else name)
    return sql


class Inputs:
    """The tables and fixtures of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURES:
            needed = set(re.findall(r"\{(\w+)\}", FIXTURES[name]))
            return self.spark.sql(FIXTURES[name], **{n: getattr(self, n) for n in needed})
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
