"""Queries of crown time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopylens.operators import align, timeseries as T
from canopylens.plans.fixtures import Inputs

C = F.col
ANCHOR = 1998
OUT = (
    "select tag, yr, area, latin, mnemonic, size, coalesce(abs(area - avg(area) over (partition by tag)) > {w} * stddev_samp(area) "
    "over (partition by tag), false) as outlier from {{crown_obs}}"
)
FREQ = "select latin, count(*) as n from {crown_obs} where latin is not null group by latin"
SHIFTS = (
    "select pair, round(avg(x_shift), 4) as xs, round(avg(y_shift), 4) as ys, count(*) as n_points from (select *, row_number() over "
    "(partition by pair order by reliability desc, event_id) as n from {tie_points}) where n <= 10 group by pair"
)
OUTWARD = (
    "select yr, case when yr < 1998 then 'backward' when yr > 1998 then 'forward' else 'anchor' end as direction, case when yr = 1998 "
    "then 0 else abs(yr - 1998) end as step from (select distinct yr from {crown_obs})"
)


def flagged(f: Inputs):
    return T.flag_outliers(f.crown_obs, width=1.5)


def years(f: Inputs):
    return f.crown_obs.select("yr")


def attempts(f: Inputs):
    return years(f).distinct().select(C("yr").alias("date"), (C("yr") % 3 != 0).alias("ok"))


QUERIES = {
    "op_u1_stack": (
        lambda f: T.stack({y: f.crown_obs.where(C("yr") == y).select("tag", "area") for y in (1996, 1997)}),
        "select tag, area, yr from {crown_obs} where yr in (1996, 1997)",
    ),
    "op_w1_best": (
        lambda f: T.best_by(f.crown_obs, ["tag"], F.desc("area"), C("yr")).select("tag", "yr", "area"),
        "select tag, yr, area from (select *, row_number() over (partition by tag order by area desc, yr) n from {crown_obs}) where n = 1",
    ),
    "op_w2_best_score": (
        lambda f: T.best_by(f.masks, ["id"], F.desc("score"), C("k")).select("id", "k", "score", "arm"),
        "select id, k, score, arm from (select *, row_number() over (partition by id order by score desc, k) n from {masks}) where n = 1",
    ),
    "op_w3_outliers": (lambda f: T.flag_outliers(f.crown_obs, width=1.5), OUT.format(w=1.5)),
    "op_w4_replace_outliers": (
        lambda f: T.replace_outliers(flagged(f), ANCHOR).select("tag", "yr", "used", "outlier"), (

        f"select tag, yr, outlier, case when outlier then coalesce(max(case when yr = {ANCHOR} then area end) over (partition by tag), "
            f"area) else area end as used from ({OUT.format(w=1.5)})"
        ),
    ),
    "op_w8_top_tie_points": (
        lambda f: T.top_by(f.tie_points, ["pair"], 10, F.desc("reliability"), C("event_id")).select("pair", "event_id", "rank"), (

        "select pair, event_id, n as rank from (select pair, event_id, row_number() over (partition by pair order by reliability desc, "
            "event_id) n from {tie_points}) where n <= 10"
        ),
    ),
    "op_f1_species_counts": (
        lambda f: T.species_summary(f.crown_obs, [500, 200, 100]), (

        "select latin, count(*) filter (a > 500) as over_500, count(*) filter (a > 200) as over_200, count(*) filter (a > 100) as over_100 "
            "from (select latin, tag, max(area) a from {crown_obs} where latin is not null group by latin, tag) group by latin"
        ),
    ),
    "op_g11_species_summary": (
        lambda f: T.species_summary(T.ever_larger(f.crown_obs, 100), [300, 200, 100]), (

        "select latin, count(*) filter (a > 300) as over_300, count(*) filter (a > 200) as over_200, count(*) filter (a > 100) as over_100 "
            "from (select latin, tag, max(area) a from {crown_obs} where latin is not null group by latin, tag) where a > 100 group by latin"
        ),
    ),
    "op_j13_ever_larger": (
        lambda f: T.ever_larger(f.crown_obs, 200).select("tag", "yr", "area"),
        "select tag, yr, area from {crown_obs} where tag in (select tag from {crown_obs} where area > 200)",
    ),
    "op_j4_species": (
        lambda f: T.with_attributes(f.crown_obs.select("tag", "yr", "mnemonic"), f.species.withColumnsRenamed({"spp": "mnemonic", "latin": "name"}), "mnemonic"),
        "select o.mnemonic, tag, yr, s.latin as name from {crown_obs} o left join {species} s on o.mnemonic = s.spp",
    ),
    "op_j5_attributes": (
        lambda f: T.with_attributes(f.crown_obs.select("tag", "yr"), f.part.select(C("p_partkey").alias("tag"), "p_type", "p_brand").where("tag % 3 = 0"), "tag"),
        "select tag, yr, p_type, p_brand from {crown_obs} left join (select * from part where p_partkey % 3 = 0) on tag = p_partkey",
    ),
    "op_f11_layer_summary": (
        lambda f: T.layer_summary(f.crown_obs, 500_000), (

        "select yr, count(distinct latin) as n_species, count(distinct tag) as n_tags, sum(area) as mapped_area, round(sum(area) / 500000 "
            "* 100, 4) as percent from {crown_obs} group by yr"
        ),
    ),
    "op_f13_frequencies": (lambda f: T.frequencies(f.crown_obs, "latin"), FREQ),
    "op_f19_area_band": (
        lambda f: T.area_band(f.crown_obs), (

        "select tag, yr, area, round(area - stddev_samp(area) over (partition by tag), 4) as lower, round(area + stddev_samp(area) over "
            "(partition by tag), 4) as upper from {crown_obs}"
        ),
    ),
    "op_f20_per_tile": (
        lambda f: f.shapes.groupBy(F.floor(C("x0") / 100).alias("tx"), F.floor(C("y0") / 100).alias("ty")).agg(F.count("*").alias("n")),
        "select cast(floor(x0 / 100) as bigint) as tx, cast(floor(y0 / 100) as bigint) as ty, count(*) as n from {shapes} group by 1, 2",
    ),
    "op_l1_by_date": (lambda f: f.crown_obs.orderBy("yr", "tag").select("yr", "tag"), "select yr, tag from {crown_obs} order by yr, tag"),
    "op_l2_top_species": (lambda f: T.most_frequent(f.crown_obs, "latin", 10), f"{FREQ} order by n desc, latin limit 10"),
    "op_l3_kth_species": (
        lambda f: T.kth_species_largest(f.crown_obs, 4, 9).select("latin", "tag", "yr", "area"), (

        f"select latin, tag, yr, area from {{crown_obs}} where latin = (select latin from ({FREQ}) order by n desc, latin limit 1 offset 3) "
            f"order by area desc, tag, yr limit 9"
        ),
    ),
    "op_l4_outward": (lambda f: T.outward(years(f), ANCHOR), OUTWARD),
    "op_l5_every_nth": (
        lambda f: T.every_nth(years(f), 3),
        "select yr from (select yr, row_number() over (order by yr) - 1 as n from (select distinct yr from {crown_obs})) where n % 3 = 0",
    ),
    "op_l6_pages": (
        lambda f: T.pages(f.crown_obs, 12).select("tag", "yr", "page"),
        "select tag, yr, (row_number() over (partition by yr order by area desc, tag) - 1) // 12 as page from {crown_obs}",
    ),
    "op_p2_threshold": (
        lambda f: f.crown_obs.where("area > 150 and mnemonic like 'Brand#1%'").select("tag", "yr", "area"),
        "select tag, yr, area from {crown_obs} where area > 150 and mnemonic like 'Brand#1%'",
    ),
    "op_p3_drop_null_keys": (
        lambda f: f.raw_crowns.dropna(subset=["tag", "mnemonic"]),
        "select * from {raw_crowns} where tag is not null and mnemonic is not null",
    ),
    "op_p7_one_series": (lambda f: f.crown_obs.where("tag = 77").select("tag", "yr", "area"), "select tag, yr, area from {crown_obs} where tag = 77"),
    "op_j15_adjacent": (
        lambda f: T.adjacent(years(f), ANCHOR),
        "select yr, direction, step, case when direction = 'backward' then yr + 1 else yr - 1 end as reference from (" + OUTWARD + ") where step > 0",
    ),
    "op_j3_first_reference": (
        lambda f: f.crown_obs.select("tag", "yr", "area").join(T.best_by(f.crown_obs, ["tag"], C("yr")).select("tag", C("area").alias("ref_area")), "tag"),
        "select tag, yr, area, first_value(area) over (partition by tag order by yr) as ref_area from {crown_obs}",
    ),
    "op_f14_mean_shift": (lambda f: align.mean_shift(f.tie_points), SHIFTS),
    "op_a3_align_chain": (
        lambda f: align.align_global(align.mean_shift(f.tie_points), 15), (

        f"select pair, xs, ys, n_points, round(sum(case when pair = 15 then 0 else xs end) over w, 4) as total_x, round(sum(case when pair "
            f"= 15 then 0 else ys end) over w, 4) as total_y from ({SHIFTS}) window w as (partition by sign(pair - 15) order by abs(pair - 15))"
        ),
    ),
    "op_a3_align_star": (
        lambda f: align.align_global(align.mean_shift(f.tie_points), 15, "star"),
        f"select pair, xs, ys, n_points, xs as total_x, ys as total_y from ({SHIFTS})",
    ),
    "op_a4_fallback": (
        lambda f: align.pick_reference(attempts(f)), (

        "select yr as date, yr % 3 <> 0 as ok, (select max(p.yr) from (select distinct yr from {crown_obs}) p where p.yr < d.yr and p.yr % "
            "3 <> 0) as reference from (select distinct yr from {crown_obs}) d"
        ),
    ),
}
