"""Queries of map algebra, zonal statistics, colour scores and vertical alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopylens.functions import geometry as G
from canopylens.functions.tables import register
from canopylens.operators import align, chunks as K, colour, raster as R, zones as Z
from canopylens.plans.fixtures import Inputs
from canopylens.sources.files import raster_table, round_trip_parquet

C = F.col
EXTENT = (
    "(select min(x0) as w, min(y0) as s, max(x0 + arm) as e, max(y0 + arm) as n, cast(ceil((max(x0 + arm) - min(x0)) / 100e0) as "
    "bigint) as nx, cast(ceil((max(y0 + arm) - min(y0)) / 100e0) as bigint) as ny from {shapes})"
)
GRID = (
    f"select j * nx + i as tile_id, w + i * ((e - w) * 1e0 / nx) as xmin, s + j * ((n - s) * 1e0 / ny) as ymin, w + (i + 1) * ((e - w) "
    f"* 1e0 / nx) as xmax, s + (j + 1) * ((n - s) * 1e0 / ny) as ymax from {EXTENT}, lateral (select unnest(range(nx)) as i) a, lateral "
    f"(select unnest(range(ny)) as j) b"
)
TILE_OF = (
    f"select tile_id, count(*) as n from {{shapes}} s join ({GRID}) t on s.x0 >= t.xmin and s.x0 < t.xmax and s.y0 >= t.ymin and s.y0 < "
    f"t.ymax group by tile_id"
)
#: The cells of each crown and date by the shape's rule, and their pixels.
INSIDE = (
    "(select id, yr, x0 + dx as col, y0 + dy as row_no from {shape_obs} s, lateral (select unnest(range(s.arm)) as dx) a, lateral "
    "(select unnest(range(s.arm)) as dy) b where dx < width or dy < width)"
)
ZONE, RGB, BANDS = ["id", "yr"], ["r", "g", "b"], ["r", "g", "b", "h"]
ZSQL = f"select z.id, x.* from {INSIDE} z join {{canopy}} x on z.yr = x.yr and z.col = x.col and z.row_no = x.row_no"
MED = "select yr, median(h) as median from {pixels} where h <> 0 group by yr"
ZGREY = f"(select *, floor(0.114::double * r + 0.587::double * g + 0.299::double * b + 0.5) as grey from ({ZSQL}))"
GREYS = "(select *, floor(0.114::double * r + 0.587::double * g + 0.299::double * b + 0.5) as grey from {pixels})"
PALETTE = "select distinct r, g, b from {pixels} where yr = 1996 and row_no < 40 and not (r = 0 and g = 0 and b = 0)"
CANOPY_PALETTE = "select distinct r, g, b from {canopy} where yr = 1996 and not (r = 0 and g = 0 and b = 0) and r > 150"
LONG = f"(select id, yr, 'r' as band, r::double as v from ({ZSQL}) union all select id, yr, 'g', g from ({ZSQL}) union all select id, yr, 'b', b from ({ZSQL}))"
HIST = f"(select id, yr, cast(grey as int) as bin, count(*) as n from {ZGREY} where grey <> 0 group by 1, 2, 3)"
NORM = (
    f"(select id, yr, bin, n, (n - lo) * 1.0 / nullif(hi - lo, 0) as v from (select *, case when count(*) over (partition by id, yr) < "
    f"256 then 0 else min(n) over (partition by id, yr) end as lo, max(n) over (partition by id, yr) as hi from {HIST}))"
)
SAMPLE = (
    f"(select cast(b.bin as int) as bin, coalesce(n * 1.0 / max(n) over (), 0) as s from (select unnest(range(256)) as bin) b left join "
    f"(select cast(grey as int) as bin, count(*) as n from {ZGREY} where grey <> 0 and yr = 1996 group by 1) c on b.bin = c.bin)"
)
FULL = (
    f"(select z.id, z.yr, s.bin, s.s, coalesce(h.v, 0) as v from (select distinct id, yr from {HIST}) z cross join {SAMPLE} s left join "
    f"{NORM} h on z.id = h.id and z.yr = h.yr and s.bin = h.bin)"
)
SIM = (
    f"select id, yr, round(corr(s, v), 4) as sim_correl, round(sum(case when s > 0 then (s - v) * (s - v) / s end), 4) as sim_chisq, "
    f"round(sum(least(s, v)), 4) as sim_intersect, round(sqrt(greatest(0, 1 - sum(sqrt(s * v)) / sqrt(sum(s) * sum(v)))), 4) as "
    f"sim_bhatt from {FULL} group by id, yr"
)
SCORE = "count(*) filter (p.r is not null and not (x.r = 0 and x.g = 0 and x.b = 0))"
PSCORE = (
    f"select id, yr, {SCORE} as match_pixels, count(*) as total_pixels, count(*) filter (x.r = 0 and x.g = 0 and x.b = 0) as "
    f"black_pixels, round({SCORE} * 100.0 / nullif(count(*) filter (not (x.r = 0 and x.g = 0 and x.b = 0)), 0), 4) as score_pct from "
    f"({ZSQL}) x left join ({CANOPY_PALETTE}) p on x.r = p.r and x.g = p.g and x.b = p.b group by id, yr"
)
#: Terrain cells are twice as large and lie a little aside: centres meet them as the transforms say.
PIXEL_AT, TERRAIN_AT = (0.5, 0.0, 100.0, 0.0, -0.5, 900.0), (1.0, 0.0, 99.7, 0.0, -1.0, 900.3)
PLACE = (
    "cast(floor((100 + 0.5 * (p.col + 0.5) - 99.7) / 1.0) as int) = {t}.col and cast(floor((900 - 0.5 * (p.row_no + 0.5) - 900.3) / "
    "-1.0) as int) = {t}.row_no"
)
NEAREST = f"from {{pixels}} p left join {{dtm}} d on {PLACE.format(t='d')}"
SURFACE = f"left join {{dsm}} m on m.yr = p.yr and {PLACE.format(t='m')}"


def observed(f: Inputs):
    """Crowns of each date as polygons."""
    return f.shape_obs.select("id", "yr", G.l_shape(C("x0"), C("y0"), C("arm"), C("width")).alias("geom"))


def zones(f: Inputs):
    """The pixels of each crown of the same date."""
    return Z.zonal_cells(observed(f), f.canopy, RGB)


def with_terrain(f: Inputs, pixels=None):
    return R.resample(f.pixels if pixels is None else pixels, PIXEL_AT, f.dtm, TERRAIN_AT, ["t"])


def with_surface(f: Inputs):
    return R.resample(f.pixels.select("yr", "row_no", "col", "r", "g", "b"), PIXEL_AT, f.dsm, TERRAIN_AT, ["h"], ["yr"])


def sample_palette(f: Inputs):
    return colour.palette(f.pixels.where("yr = 1996 and row_no < 40"))


def canopy_palette(f: Inputs):
    return colour.palette(f.canopy.where("yr = 1996 and r > 150"))


def greys(f: Inputs):
    return f.pixels.withColumn("grey", R.grey(C("r"), C("g"), C("b")))


def zone_greys(f: Inputs, of=None):
    return (zones(f) if of is None else of).withColumn("grey", R.grey(C("r"), C("g"), C("b")))


def similarity(f: Inputs, of=None):
    """Each crown's histogram against that of all crowns' pixels of one date."""
    counts = round_trip_parquet(colour.grey_counts(zone_greys(f, of), ZONE, "grey"), [])  # written once; the sample is a sum of them
    sample = colour.scaled(counts.where("yr = 1996").groupBy("bin").agg(F.sum("n").alias("n")), [])
    return colour.histogram_similarity(colour.scaled(counts, ZONE), sample, ZONE)


def colour_scores(f: Inputs):
    own = round_trip_parquet(zones(f), [])  # written once, and grouped thrice
    return colour.palette_score(own, canopy_palette(f), ZONE).join(similarity(f, own), ZONE, "left")


def species_means(f: Inputs):
    """Mean colours of each crown and date, with its species."""
    return colour.zonal_means(zones(f), ZONE).join(f.shapes.select("id", "mnemonic"), "id")


def chips(f: Inputs, **draw):
    return Z.crown_chips(observed(f), f.canopy, RGB, 5, **draw)


def as_text(outline):
    return F.array_join(F.transform(outline, lambda p: F.concat_ws(" ", p["x"].cast("int"), p["y"].cast("int"))), ",")


def tiled(f: Inputs):
    table = raster_table(f.pixels, ["r"])
    return K.cut_tiles(table, 25, 5, *K.tiles_along(table, 25))


def tile_counts(f: Inputs):
    """Cells and the sum of a band for each tile and date, added up chunk by chunk."""
    each = tiled(f).select("tile_row", "tile_col", "yr", K.values_in("r").alias("n"), K.sum_of("r").alias("r")).where("n > 0")
    return each.groupBy("tile_row", "tile_col", "yr").agg(F.sum("n").alias("n"), F.sum("r").cast("long").alias("r"))


def neighbouring_tiles(f: Inputs):
    now = tile_counts(f).select("tile_row", "tile_col", "yr", "n")
    before = now.select("tile_row", "tile_col", (C("yr") + 1).alias("yr"), C("n").alias("n_before"))
    return now.join(before, ["tile_row", "tile_col", "yr"])


def extent(f: Inputs):
    """West, south, east and north of all crowns."""
    return f.shapes.agg(F.min("x0").alias("w"), F.min("y0").alias("s"), F.max(C("x0") + C("arm")).alias("e"), F.max(C("y0") + C("arm")).alias("n")).first()


def grid(f: Inputs):
    x = extent(f)
    return R.tile_grid(f.spark, x.w, x.s, x.e, x.n, 100)


def tiles_by_sql(f: Inputs):
    """Crown corners in each tile; each crown asks the SQL table function for the tiles that its corner lies in."""
    register(f.spark)
    x = extent(f)
    return f.spark.sql((
            f"select tile_id, count(*) as n from {{shapes}} s, lateral tiles_at(s.x0, s.y0, s.x0, s.y0, {x.w}, {x.s}, {x.e}, {x.n}, 100) t "
            f"group by tile_id"
        ), shapes=f.shapes)


TILES = (
    "select yr, row_no, col, tr as tile_row, tc as tile_col from {pixels}, (select unnest(range((select max(row_no) // 25 + 1 from "
    "{pixels}))) as tr) a, (select unnest(range((select max(col) // 25 + 1 from {pixels}))) as tc) b where row_no >= tr * 25 - 5 and "
    "row_no < tr * 25 + 25 + 5 and col >= tc * 25 - 5 and col < tc * 25 + 25 + 5"
)
TILE_N = f"select tile_row, tile_col, yr, count(*) as n from ({TILES}) group by 1, 2, 3"
MEANS = f"select z.id, z.yr, s.mnemonic, round(avg(nullif(r, 0)), 4) as mean_r from ({ZSQL}) z join {{shapes}} s on z.id = s.id group by 1, 2, 3"
CHIP = (
    "select s.id, p.yr, p.row_no, p.col, r, p.row_no - y0 + 5 as chip_row, p.col - x0 + 5 as chip_col, concat('5 5,', arm + 5, ' 5,', "
    "arm + 5, ' ', width + 5, ',', width + 5, ' ', width + 5, ',', width + 5, ' ', arm + 5, ',5 ', arm + 5) as outline from "
    "{shape_obs} s join {canopy} p on s.yr = p.yr and p.col + 0.5 between x0 - 5 and x0 + arm + 5 and p.row_no + 0.5 between y0 - 5 "
    "and y0 + arm + 5"
)

LIGHT = (
    "select yr, row_no, col, round((case when y <= 216.0::double / 24389 then y * 24389 / 27 else 116 * cbrt(y) - 16 end) * "
    "2.55::double, 4) as light from (select yr, row_no, col, 0.2126::double * case when r / 255 <= 0.04045 then r / 255 / "
    "12.92::double else pow((r / 255 + 0.055::double) / 1.055::double, 2.4) end + 0.7152::double * case when g / 255 <= 0.04045 then g "
    "/ 255 / 12.92::double else pow((g / 255 + 0.055::double) / 1.055::double, 2.4) end + 0.0722::double * case when b / 255 <= "
    "0.04045 then b / 255 / 12.92::double else pow((b / 255 + 0.055::double) / 1.055::double, 2.4) end as y from {pixels})"
)
#: The curve of a date as one block: with c of the highest bins at the limit, all others get the same share of the excess.
CURVE = (
    f"with h as (select yr, cast(greatest(0, least(255, round(light))) as int) as bin, count(*) as n from ({LIGHT}) group by 1, 2),"
    " a as (select y.yr, cast(b as int) as bin, coalesce(n, 0) as n, greatest(1, 2 * sum(coalesce(n, 0)) over (partition by y.yr) / 256.0::double) as lim, sum(coalesce(n, 0)) over (partition by y.yr) as total from (select distinct yr from h) y, (select unnest(range(256)) as b) left join h on h.yr = y.yr and h.bin = b),"
    " k as (select *, row_number() over (partition by yr order by n desc, bin) - 1 as c, coalesce(sum(n) over (partition by yr order by n desc, bin rows between unbounded preceding and 1 preceding), 0) as above from a),"
    " lev as (select yr, min_by((above - c * lim) / (256 - c), c) as level from k where n + (above - c * lim) / (256 - c) <= lim + 1e-9 group by yr)"
    " select a.yr, bin, round(sum(least(n + level, lim)) over (partition by a.yr order by bin) / total * 255, 4) as y from a join lev on a.yr = lev.yr"
)

QUERIES = {
    "op_r1_coordinates": (
    lambda f: R.map_coordinates(f.pixels, 0.5, 100, -0.5, 900).select("yr", "row_no", "col", "x", "y"),
    "select yr, row_no, col, 100 + 0.5 * (col + 0.5) as x, 900 - 0.5 * (row_no + 0.5) as y from {pixels}",
    ),
    "op_r2_crop_polygon": (
    lambda f: K.cells_of(K.crop_polygon(raster_table(f.pixels, BANDS), [[(10, 10), (70, 10), (70, 30), (30, 30), (30, 70), (10, 70)]]), BANDS),
    "select * from {pixels} where col >= 10 and col < 70 and row_no >= 10 and row_no < 70 and (col < 30 or row_no < 30)",
    ),
    "op_r3_crop_box": (
    lambda f: K.cells_of(K.crop_box(raster_table(f.pixels, BANDS), 20, 20, 40, 40, 5), BANDS),
    "select * from {pixels} where col between 15 and 44 and row_no between 15 and 44",
    ),
    "op_r4_resample": (lambda f: with_terrain(f).select("yr", "row_no", "col", "t"), f"select p.yr, p.row_no, p.col, t {NEAREST}"),
    "op_r5_bands_and_surface": (with_surface, f"select p.yr, p.row_no, p.col, r, g, b, m.h from {{pixels}} p {SURFACE}"),
    "op_r6_five_bands": (lambda f: with_terrain(f, with_surface(f)), f"select p.yr, p.row_no, p.col, r, g, b, m.h, t {NEAREST} {SURFACE}"),
    "op_r7_canopy_height": (
    lambda f: R.canopy_height(with_terrain(f), "h", "t", 50).select("yr", "row_no", "col", F.round("chm", 4).alias("chm")),
    f"select p.yr, p.row_no, p.col, round(case when h - t > 50 or h - t < 0 then 0 else h - t end, 4) as chm {NEAREST}",
    ),
    "op_r8_mosaic": (
    lambda f: R.mosaic(R.mask_nodata(f.pixels, ["b"], 0), "yr", ["b"]),
    "select row_no, col, min_by(b, yr) filter (b <> 0) as b from {pixels} group by row_no, col",
    ),
    "op_r9_tile_grid": (
    lambda f: grid(f).select("tile_id", *[F.round(c, 4).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]),
    f"select tile_id, round(xmin, 4) as xmin, round(ymin, 4) as ymin, round(xmax, 4) as xmax, round(ymax, 4) as ymax from ({GRID})",
    ),
    "op_x4_tiles_per_crown": (tiles_by_sql, TILE_OF),
    "op_r10_cut_tiles": (lambda f: K.cells_of(tiled(f), ["r"], ("tile_row", "tile_col")).drop("r"), TILES),
    "op_r11_tiles_by_date": (
    tile_counts, (

    f"select tile_row, tile_col, t.yr, count(*) as n, cast(sum(r) as bigint) as r from ({TILES}) t join {{pixels}} p on t.yr = p.yr and "
        f"t.row_no = p.row_no and t.col = p.col group by 1, 2, 3"
    ),
    ),
    "op_r12_shift": (
    lambda f: R.shift_transform(f.pixels.select("yr").distinct().select(C("yr").alias("pair"), F.lit(100.0).alias("c"), F.lit(900.0).alias("f")), align.mean_shift(f.tie_points).select((C("pair") + 1990).alias("pair"), "xs", "ys"), "pair"), (

    "select y.yr as pair, 100 + coalesce(s.xs, 0) as c, 900 + coalesce(s.ys, 0) as f from (select distinct yr from {pixels}) y left "
        "join (select pair, round(avg(x_shift), 4) as xs, round(avg(y_shift), 4) as ys from (select *, row_number() over (partition by "
        "pair order by reliability desc, event_id) as n from {tie_points}) where n <= 10 group by pair) s on y.yr = s.pair + 1990"
    ),
    ),
    "op_r13_add_offset": (
    lambda f: R.add_offset(f.pixels, f.pixels.select("yr").distinct().withColumn("offset", C("yr") - 1990.0), "h").select("yr", "row_no", "col", F.round("h", 3).alias("h")),
    "select yr, row_no, col, round(h + yr - 1990, 3) as h from {pixels}",
    ),
    "op_r14_difference": (
    lambda f: R.fixed_bins(R.difference(f.pixels.where("yr = 1996"), f.pixels.where("yr = 1997"), "r"), "delta", 10), (

    "select cast(floor((a.r - b.r) / 10) as bigint) as bin, count(*) as n from {pixels} a join {pixels} b on a.row_no = b.row_no and "
        "a.col = b.col where a.yr = 1996 and b.yr = 1997 group by 1"
    ),
    ),
    "op_r15_stretch": (
    lambda f: R.stretch(f.pixels, "r").select("yr", "row_no", "col", F.round("stretched", 3).alias("stretched")), (

    "select yr, row_no, col, round((greatest(lo, least(hi, r)) - lo) / nullif(hi - lo, 0) * 255, 3) as stretched from (select *, "
        "quantile_cont(r, 0.05) over (partition by yr) as lo, quantile_cont(r, 0.95) over (partition by yr) as hi from {pixels})"
    ),
    ),
    "op_r16_grey": (lambda f: greys(f).select("yr", "row_no", "col", "grey"), f"select yr, row_no, col, grey from {GREYS}"),
    "op_r17_contrast": (
    lambda f: colour.normalise_contrast(chips(f).select("id", "yr", C("chip_row").alias("row_no"), C("chip_col").alias("col"), *RGB), ZONE),
    None,
    ),
    "op_r17_curve": (
    lambda f: colour.curves(f.pixels.withColumn("light", F.round(colour.lightness(C("r"), C("g"), C("b")), 4)), ["yr"], "light").select("yr", "bin", F.round("y", 4).alias("y")),
    CURVE,
    ),
    "op_r17_lightness": (lambda f: f.pixels.select("yr", "row_no", "col", F.round(colour.lightness(C("r"), C("g"), C("b")), 4).alias("light")), LIGHT),
    "op_s11_crown_chips": (
    lambda f: chips(f, draw=as_text).select("id", "yr", "row_no", "col", "r", "chip_row", "chip_col", "outline"),
    CHIP,
    ),
    "op_p6_named_plot": (
    lambda f: K.cells_of(K.named_plot(raster_table(f.pixels, ["h"]), f.plots, "NATION_7"), ["h"]), (

    "select yr, row_no, col, h from {pixels} p join {plots} q on name = 'NATION_7' and col >= xmin and col < xmax and row_no >= ymin "
        "and row_no < ymax"
    ),
    ),
    "op_f2_median": (
    lambda f: R.median_of_band(f.pixels, "h", ["yr"]).select("yr", F.round("median", 4).alias("median")),
    f"select yr, round(median, 4) as median from ({MED})",
    ),
    "op_f3_zonal_means": (
    lambda f: colour.zonal_means(zones(f), ZONE), (

    f"select id, yr, round(avg(nullif(r, 0)), 4) as mean_r, round(avg(nullif(g, 0)), 4) as mean_g, round(avg(nullif(b, 0)), 4) as "
        f"mean_b from ({ZSQL}) group by id, yr"
    ),
    ),
    "op_f4_zonal_boxes": (
    lambda f: colour.zonal_boxes(zones(f), ZONE, "r"), (

    f"select z.id, z.yr, min(r) filter (r between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as low, any_value(q1) as q1, "
        f"any_value(q2) as median, any_value(q3) as q3, max(r) filter (r between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as high "
        f"from ({ZSQL}) z join (select id, yr, quantile_cont(r, 0.25) q1, quantile_cont(r, 0.5) q2, quantile_cont(r, 0.75) q3 from ({ZSQL}) "
        f"where r <> 0 group by 1, 2) q on z.id = q.id and z.yr = q.yr where r <> 0 group by 1, 2"
    ),
    ),
    "op_f5_zonal_histogram": (
    lambda f: colour.zonal_histogram(zones(f), ZONE), (

    f"select l.id, l.yr, band, cast(case when hi > lo then least(floor((v - lo) / (hi - lo) * 50), 49) else 0 end as int) as bin, "
        f"count(*) as n from {LONG} l join (select id, yr, min(v) lo, max(v) hi from {LONG} where v <> 0 group by 1, 2) e on l.id = e.id "
        f"and l.yr = e.yr where v <> 0 group by 1, 2, 3, 4"
    ),
    ),
    "op_f6_mean_histogram": (
    lambda f: colour.mean_histogram(species_means(f), "mnemonic", "mean_r"), (

    f"select m.mnemonic, cast(case when hi > lo then least(floor((mean_r - lo) / (hi - lo) * 50), 49) else 0 end as int) as bin, "
        f"count(*) as n from ({MEANS}) m join (select mnemonic, min(mean_r) lo, max(mean_r) hi from ({MEANS}) group by mnemonic) e on "
        f"m.mnemonic = e.mnemonic where mean_r is not null group by 1, 2"
    ),
    ),
    "op_f7_palette": (
    lambda f: colour.palette(f.pixels.where("yr = 1996 and row_no < 10"), f.pixels.where("yr = 1997 and col < 10")), (

    "select distinct r, g, b from {pixels} where (yr = 1996 and row_no < 10 or yr = 1997 and col < 10) and not (r = 0 and g = 0 and b "
        "= 0)"
    ),
    ),
    "op_u2_colour_union": (
    lambda f: f.pixels.where("yr = 1996").select("r", "g").union(f.pixels.where("yr = 1997").select("r", "g")).distinct(),
    "select r, g from {pixels} where yr = 1996 union select r, g from {pixels} where yr = 1997",
    ),
    "op_f8_palette_score": (lambda f: colour.palette_score(zones(f), canopy_palette(f), ZONE), PSCORE),
    "op_j14_palette_membership": (
    lambda f: f.pixels.join(sample_palette(f), ["r", "g", "b"], "left_semi").select("yr", "row_no", "col"),
    f"select yr, row_no, col from {{pixels}} x join ({PALETTE}) p on x.r = p.r and x.g = p.g and x.b = p.b",
    ),
    "op_f9_grey_histogram": (
    lambda f: colour.grey_histogram(zone_greys(f), ZONE, "grey").select("id", "yr", "bin", "n", F.round("v", 4).alias("v")),
    f"select id, yr, bin, n, round(v, 4) as v from {NORM}",
    ),
    "op_f10_similarity": (similarity, SIM),
    "op_g10_colour_score": (colour_scores, f"select * from ({PSCORE}) left join ({SIM}) using (id, yr)"),
    "op_f12_total_bounds": (
    lambda f: R.total_bounds(observed(f).withColumn("bounds", G.bbox(C("geom"))), ["yr"], "bounds"), (

    "select yr, min(x0)::double as xmin, min(y0)::double as ymin, max(x0 + arm)::double as xmax, max(y0 + arm)::double as ymax from "
        "{shape_obs} group by yr"
    ),
    ),
    "op_j10_same_date": (
    lambda f: zones(f).groupBy("id", "yr").agg(F.count("*").alias("cells")),
    f"select id, yr, count(*) as cells from ({ZSQL}) group by id, yr",
    ),
    "op_j11_pair_products": (
    lambda f: f.files.where("kind = 'Orthophoto'").select("mission", C("path").alias("ortho")).join(f.files.where("kind = 'DSM'").select("mission", C("path").alias("dsm")), "mission"), (

    "select a.mission, a.path as ortho, b.path as dsm from {files} a join {files} b on a.mission = b.mission where a.kind = "
        "'Orthophoto' and b.kind = 'DSM'"
    ),
    ),
    "op_j16_tile_pairs": (
    neighbouring_tiles, (

    f"select a.tile_row, a.tile_col, a.yr, a.n, b.n as n_before from ({TILE_N}) a join ({TILE_N}) b on a.tile_row = b.tile_row and "
        f"a.tile_col = b.tile_col and a.yr = b.yr + 1"
    ),
    ),
    "op_a1_align_vertical": (
    lambda f: align.align_vertical(f.pixels, 1998).select("yr", "row_no", "col", F.round("h", 3).alias("h")), (

    f"select p.yr, row_no, col, round(nullif(h, 0) + (select median from ({MED}) where yr = 1998) - median, 3) as h from {{pixels}} p "
        f"join ({MED}) m on p.yr = m.yr"
    ),
    ),
    "op_a1_offsets": (
    lambda f: align.vertical_offsets(f.pixels, 1998).select("yr", F.round("median", 4).alias("median"), F.round("offset", 4).alias("offset")),
    f"select yr, round(median, 4) as median, round((select median from ({MED}) where yr = 1998) - median, 4) as offset from ({MED})",
    ),
    "op_a2_delta_offset": (
    lambda f: align.delta_offset(f.pixels.where("yr = 1997"), f.pixels.where("yr = 1998")), (

    "select round(median(a.h - b.h), 4) as offset from {pixels} a join {pixels} b on a.row_no = b.row_no and a.col = b.col where a.yr "
        "= 1998 and b.yr = 1997"
    ),
    ),
}
