"""Queries of polygon functions, spatial joins, crown linking and the alignment kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopylens.functions import geometry as G
from canopylens.operators import align, raster, spatial as P, timeseries
from canopylens.plans.fixtures import Inputs
from canopylens.sources.files import raster_table

C = F.col
CELLS = (
    "(select id, x0 + dx as cx, y0 + dy as cy from {shapes} s, lateral (select unnest(range(s.arm)) as dx) a, lateral (select "
    "unnest(range(s.arm)) as dy) b where dx < width or dy < width)"
)
OBS = CELLS.replace("{shapes}", "{shape_obs}").replace("select id,", "select id, yr,")
AREA = "(2 * arm * width - width * width)"
IOU = (
    "select a.id, a.yr, coalesce(i, 0) as inter_area, na + nb - coalesce(i, 0) as union_area, round(coalesce(i, 0) * 1.0 / (na + nb - "
    "coalesce(i, 0)), 4) as iou from (select id, yr, count(*) na from {new} group by 1, 2) a join (select id, yr, count(*) nb from "
    "{ref} group by 1, 2) b on a.id = b.id and a.yr = b.yr left join (select x.id, x.yr, count(*) i from {new} x join {ref} y on x.id "
    "= y.id and x.yr = y.yr and x.cx = y.cx and x.cy = y.cy group by 1, 2) c on a.id = c.id and a.yr = c.yr"
)
SHARED = f"select a.id as a, b.id as b, count(*) as shared from {CELLS} a join {CELLS} b on a.cx = b.cx and a.cy = b.cy and a.id < b.id group by 1, 2"


def avoided(cells: str) -> str:
    """SQL of one round: of each cell only its smallest crowns stay."""
    return (
            f"(select id, cx, cy from (select *, min(n) over (partition by cx, cy) as least from (select *, count(*) over (partition by id) as "
            f"n from {cells})) where n = least)"
        )


AVOID, CROWD = avoided(CELLS), CELLS.replace("{shapes}", "{crowd}")
ROUNDS = CROWD
for _ in range(10):
    ROUNDS = avoided(ROUNDS)


def geom(df):
    return df.withColumn("geom", G.l_shape(C("x0"), C("y0"), C("arm"), C("width")))


def crowns(f: Inputs):
    return geom(f.shapes).select("id", "geom")


def cells(f: Inputs):
    return P.crown_cells(crowns(f), [])


def parts(f: Inputs):
    """L-shaped crowns; every fifth with a square as a second part, every 97th null."""
    square = G.box(C("x0") + 100, C("y0"), C("x0") + 105, C("y0") + 5)
    g = geom(f.shapes)
    return g.withColumn("parts", F.when(C("id") % 97 != 0, F.when(C("id") % 5 == 0, F.array("geom", square)).otherwise(F.array("geom"))))


def pairs(f: Inputs):
    c = crowns(f)
    near = P.overlap_candidates(c, [], 16)
    return near.join(c.select(C("id").alias("a"), C("geom").alias("geom_a")), "a").join(c.select(C("id").alias("b"), C("geom").alias("geom_b")), "b")


def observed(f: Inputs):
    return geom(f.shape_obs).select("id", "yr", "geom")


def overlap_with_reference(f: Inputs):
    """Each crown of the other dates against its own of the reference date."""
    c = observed(f)
    return P.crown_iou(c.where("yr <> 1996"), c.where("yr = 1996"), ["id"]).select("id", "yr", "inter_area", "union_area", "iou")


def union_areas(f: Inputs):
    area = crowns(f).select("id", G.area(C("geom")).alias("area"))
    both = P.shared_cells(crowns(f), []).join(area.toDF("a", "area_a"), "a").join(area.toDF("b", "area_b"), "b")
    return both.select("a", "b", (C("area_a") + C("area_b") - C("shared")).alias("union_area"))


def even_without_odd(f: Inputs):
    c = cells(f)
    return c.where("id % 2 = 0").join(c.where("id % 2 = 1").select("cx", "cy").distinct(), ["cx", "cy"], "left_anti").select("id", "cx", "cy")


def resolved(packed, resolve):
    """Crowns before and after: areas, and the bounds of the polygon that is left."""
    b = G.bbox(C("geom"))
    out = P.avoid_report(packed, resolve(packed, []), [])
    return out.select("id", "area_before", "area_left", "area_after", *[b[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def bow_ties(f: Inputs):
    """Outlines that cross themselves."""
    x, y = C("x0"), C("y0")
    tie = G.polygon(G.ring((x, y), (x + 6, y + 6), (x + 6, y), (x, y + 6)))
    return f.shapes.select("id", tie.alias("geom"))


def mask_cells(f: Inputs):
    """Three masks for each crown: its shape, larger with each, and a speck aside."""
    shape = G.cell_cover(G.l_shape(C("x0"), C("y0"), C("arm"), C("width")))
    speck = F.array(F.struct((C("x0") + 30).alias("cx"), C("y0").alias("cy")))
    return f.masks.select("id", "k", "score", F.concat(shape, speck).alias("cells"))


def mask_crowns(f: Inputs):
    tagged = f.shapes.select("id", F.lpad(C("id").cast("string"), 6, "0").alias("tag"), F.md5(C("id").cast("string")).alias("GlobalID"))
    out = P.masks_to_crowns(mask_cells(f), tagged, 0.5, 1000, 5000)
    b = G.bbox(C("geom"))
    return out.select("id", "tag", "GlobalID", "score", "area", G.area(C("geom")).alias("outline_area"), F.size(C("geom")[0]).alias("corners"), *[b[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


#: Windows of the alignment: their size in cells, and the shift that the targets are moved by.
SIZE, SPACING, RES = 64, 25, 0.5


REACH = 10


def moved_series(f: Inputs):
    """Each date's raster, and the same one moved by a few cells, as chunks: reference and target."""
    moved = f.pixels.select("yr", (C("row_no") + C("yr") % 3).alias("row_no"), (C("col") + C("yr") % 5 - 2).alias("col"), "r")
    return raster_table(f.pixels, ["r"]), raster_table(moved, ["r"])


def tie_points(f: Inputs):
    """Every window of the grid, on the map."""
    found = align.estimate_tie_points(align.cut_windows(*moved_series(f), "r", SIZE, REACH, SPACING), SIZE, REACH, SPACING)
    out = align.on_the_map(found, SPACING, SIZE, RES, 100, 900)
    return out.withColumns({c: F.round(c, 3) + 0.0 for c in ("X_SHIFT_M", "Y_SHIFT_M", "RELIABILITY")})


def single_window(f: Inputs):
    at = (10, 10)
    found = align.estimate_tie_points(align.cut_windows(*moved_series(f), "r", 80, 20, at=at), 80, 20, at=at)
    return found.select("pair", F.round("x_shift", 3).alias("x_shift"), F.round("y_shift", 3).alias("y_shift"))


def local_field(f: Inputs):
    return f.pixels.select("yr", F.floor(C("row_no") / 10).cast("int").alias("grid_row"), F.floor(C("col") / 10).cast("int").alias("grid_col")).distinct().select("yr", "grid_row", "grid_col", (C("grid_row") % 3 - 1).alias("x_shift"), (C("grid_col") % 3 - 1).alias("y_shift"), F.lit(50).alias("reliability"))


def tiles(f: Inputs):
    return raster.tile_grid(f.spark, 0, 0, 1000 * (f.shapes.agg(F.max("id")).first()[0] // 2000 + 1), 500, 100)


#: Two L shapes have a point in common if two of their arms, as closed boxes, do.
ARM = ("{s}.x0, {s}.x0 + {s}.arm, {s}.y0, {s}.y0 + {s}.width", "{s}.x0, {s}.x0 + {s}.width, {s}.y0, {s}.y0 + {s}.arm")


def _arms_meet(p: str, q: str) -> str:
    (a, b, c, d), (e, g, h, k) = p.split(", "), q.split(", ")
    return f"({a} <= {g} and {e} <= {b} and {c} <= {k} and {h} <= {d})"


MEET = " or ".join(_arms_meet(p.format(s="a"), q.format(s="b")) for p in ARM for q in ARM)
NEIGHBOUR = "abs(c.cx - r.cx) + abs(c.cy - r.cy) = 1"
PARTS = (
    "with recursive c as materialized (select * from {left}), r(id, cx, cy, px, py) as (select id, cx, cy, cx, cy from c union select "
    "r.id, c.cx, c.cy, r.px, r.py from r join c on c.id = r.id and "
    ) + NEIGHBOUR + ")"
PARTS_OF = PARTS.replace("{left}", AVOID)
#: Crowns before and after their overlaps are resolved, and the bounds of the largest part that is left.
RESOLVED = (
    PARTS + ", p as (select id, px, py, count(*) as n, min(cx)::double as xmin, min(cy)::double as ymin, max(cx) + 1::double as xmax, max(cy) + 1::double as ymax from r group by 1, 2, 3),"
    " best as (select * from (select *, row_number() over (partition by id order by n desc, px, py) as k from p) where k = 1)"
    " select a.id, a.n as area_before, coalesce(l.n, 0) as area_left, coalesce(b.n, 0) as area_after, xmin, ymin, xmax, ymax from (select id, count(*) as n from {before} group by id) a"
    " left join (select id, count(*) as n from c group by id) l on a.id = l.id left join best b on a.id = b.id"
)
REFERENCE = (
    f"select a.id, a.yr, coalesce(i, 0) as inter_area, na + nb - coalesce(i, 0) as union_area, round(coalesce(i, 0) * 1.0 / (na + nb - "
    f"coalesce(i, 0)), 4) as iou from (select id, yr, count(*) na from {OBS} where yr <> 1996 group by 1, 2) a join (select id, "
    f"count(*) nb from {OBS} where yr = 1996 group by 1) b on a.id = b.id left join (select x.id, x.yr, count(*) i from {OBS} x join "
    f"{OBS} y on x.id = y.id and x.cx = y.cx and x.cy = y.cy where x.yr <> 1996 and y.yr = 1996 group by 1, 2) c on a.id = c.id and "
    f"a.yr = c.yr"
)
LINKED = (
    "(select yr, case when yr < 1998 then yr + 1 else yr - 1 end as prev_yr, case when yr < 1998 then 'backward' else 'forward' end as "
    "direction from (select distinct yr from {shape_obs}) where yr <> 1998)"
)
TRACK = f"select i.id, i.yr, l.prev_yr, l.direction, s.n::double as area, i.inter_area, i.union_area, i.iou from (" + IOU.format(new=OBS, ref=f"(select id, y.yr, cx, cy from {OBS} o join {LINKED} y on o.yr = y.prev_yr)") + f") i join {LINKED} l on i.yr = l.yr join (select id, {AREA} as n from {{shapes}}) s on i.id = s.id"
#: The same series in SQL: third flattening n, and what follows from it.
N = 1 / 298.257223563 / (2 - 1 / 298.257223563)
E, RADIUS = 2 * N**0.5 / (1 + N), 6378137.0 / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
EAST = " + ".join(f"{a!r}::double * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in enumerate(ALPHA, 1))
NORTH = " + ".join(f"{a!r}::double * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in enumerate(ALPHA, 1))
UTM = (
    f"select c_custkey, round(500000 + 0.9996::double * {RADIUS!r}::double * (eta + {EAST}), 2) as easting, round(0.9996::double * {RADIUS!r}::double * (xi + {NORTH}), 2) as northing from ("
    f"select c_custkey, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t * t)) as eta from (select c_custkey, lam, sinh(atanh(sin(phi)) - {E!r}::double * atanh({E!r}::double * sin(phi))) as t from ("
    "select c_custkey, radians(-79.9::double + c_nationkey / 100 + 81) as lam, radians(9.1::double + (c_custkey % 100) / 1000) as phi from customer)))"
)
QUERIES = {
    "op_v1_area": (lambda f: crowns(f).select("id", G.area(C("geom")).alias("area")), f"select id, {AREA}::double as area from {{shapes}}"),
    "op_v1_area_with_hole": (
    lambda f: f.shapes.select("id", G.area(F.concat(G.box(C("x0"), C("y0"), C("x0") + 10, C("y0") + 10), G.box(C("x0") + 1, C("y0") + 1, C("x0") + 1 + C("width"), C("y0") + 1 + C("width")))).alias("area")),
    "select id, (100 - width * width)::double as area from {shapes}",
    ),
    "op_v2_bounds": (
    lambda f: crowns(f).select("id", G.bbox(C("geom")).alias("b")).select("id", "b.*"),
    "select id, x0::double as xmin, y0::double as ymin, (x0 + arm)::double as xmax, (y0 + arm)::double as ymax from {shapes}",
    ),
    "op_v3_padded": (
    lambda f: crowns(f).select("id", G.padded(G.bbox(C("geom")), 3).alias("b")).select("id", "b.*"), (

    "select id, x0 - 3.0::double as xmin, y0 - 3.0::double as ymin, x0 + arm + 3.0::double as xmax, y0 + arm + 3.0::double as ymax "
        "from {shapes}"
    ),
    ),
    "op_v4_envelope": (
    lambda f: crowns(f).select("id", G.area(G.envelope(C("geom"))).alias("area"), F.size(G.envelope(C("geom"))[0]).alias("points")),
    "select id, (arm * arm)::double as area, 5 as points from {shapes}",
    ),
    "op_v5_largest_part": (
    lambda f: parts(f).select("id", G.area(G.largest_part(C("parts"))).alias("area")), (

    f"select id, case when id % 97 = 0 then null when id % 5 = 0 then greatest(25, {AREA}) else {AREA} end::double as area from "
        f"{{shapes}}"
    ),
    ),
    "op_v6_point_in_polygon": (
    lambda f: crowns(f).join(f.shapes.select("id", "x0", "y0"), "id").select("id", *[G.contains_point(C("geom"), C("x0") + k + 0.5, C("y0") + k + 0.5).alias(f"in{k}") for k in (0, 1, 2)]),
    "select id, true as in0, 1 < width as in1, 2 < width as in2 from {shapes}",
    ),
    "op_v7_within_box": (
    lambda f: crowns(f).where(G.within_box(C("geom"), 100, 100, 400, 300)).select("id"),
    "select id from {shapes} where x0 >= 100 and y0 >= 100 and x0 + arm <= 400 and y0 + arm <= 300",
    ),
    "op_v8_intersects": (
    lambda f: P.intersecting(crowns(f), []),
    f"select a.id as a, b.id as b from {{shapes}} a join {{shapes}} b on a.id < b.id and ({MEET})",
    ),
    "op_v9_shared_cells": (lambda f: P.shared_cells(crowns(f), []), SHARED),
    "op_v9_exact_overlap": (
    lambda f: P.exact_overlap(pairs(f)).where("inter_area > 1e-9").select("a", "b", F.round("inter_area", 4).alias("inter_area")),
    f"select a, b, shared::double as inter_area from ({SHARED})",
    ),
    "op_v10_union_area": (
    union_areas, (

    f"select s.a, s.b, (x.n + y.n - shared)::double as union_area from ({SHARED}) s join (select id, {AREA} n from {{shapes}}) x on s.a "
        f"= x.id join (select id, {AREA} n from {{shapes}}) y on s.b = y.id"
    ),
    ),
    "op_v11_difference": (
    even_without_odd,
    f"select id, cx, cy from {CELLS} where id % 2 = 0 and (cx, cy) not in (select (cx, cy) from {CELLS} where id % 2 = 1)",
    ),
    "op_v12_repair": (
    lambda f: P.largest_component(P.crown_cells(bow_ties(f), []), []), (

    "select id, x0 + dx as cx, y0 + dy as cy from {shapes}, (select unnest(range(6)) as dx) a, (select unnest(range(6)) as dy) b where "
        "dx + 0.5 >= greatest(dy + 0.5, 5.5 - dy)"
    ),
    ),
    "op_v13_first_polygon": (
    lambda f: geom(f.shapes).select("id", F.array(F.struct(F.lit("LineString").alias("kind"), C("geom").alias("rings")), F.struct(F.when(C("id") % 4 != 0, "Polygon").otherwise("Point").alias("kind"), C("geom").alias("rings"))).alias("c")).select("id", G.area(G.first_polygon(C("c"))).alias("area")),
    f"select id, case when id % 4 <> 0 then {AREA}::double end as area from {{shapes}}",
    ),
    "op_v14_to_pixels": (
    lambda f: geom(f.shapes).select("id", G.bbox(G.to_pixels(C("geom"), F.lit(10), F.lit(20), 0.5)).alias("b")).select("id", "b.*"), (

    "select id, (x0 - 10) / 0.5::double as xmin, (y0 - 20) / 0.5::double as ymin, (x0 + arm - 10) / 0.5::double as xmax, (y0 + arm - "
        "20) / 0.5::double as ymax from {shapes}"
    ),
    ),
    "op_v15_prompt_boxes": (
    lambda f: crowns(f).select("id", G.prompt_box(G.bbox(C("geom")), 0, 600, 0.5).alias("b")).select("id", "b.*"), (

    "select id, x0 / 0.5::double as \"left\", (600 - y0 - arm) / 0.5::double as top, (x0 + arm) / 0.5::double as \"right\", (600 - y0) "
        "/ 0.5::double as bottom from {shapes}"
    ),
    ),
    "op_v16_utm": (
    lambda f: (lambda xy: f.customer.select("c_custkey", F.round(xy[0], 2).alias("easting"), F.round(xy[1], 2).alias("northing")))(G.utm17(-79.9 + C("c_nationkey") / 100, 9.1 + (C("c_custkey") % 100) / 1000)),
    UTM,
    ),
    "op_v17_boundary": (
    lambda f: crowns(f).select("id", F.posexplode(G.edges(C("geom")[0])).alias("k", "e")).select("id", "k", F.sqrt((C("e.a.x") - C("e.b.x")) ** 2 + (C("e.a.y") - C("e.b.y")) ** 2).alias("length")), (

    "select id, k::int as k, [arm, width, arm - width, arm - width, width, arm][k + 1]::double as length from {shapes}, (select "
        "unnest(range(6)) as k)"
    ),
    ),
    "op_v18_cell_cover": (cells, CELLS[1:-1]),
    "op_j1_within_tiles": (
    lambda f: P.within_tiles(crowns(f), tiles(f), 100), (

    "select (y0 // 100) * (10 * ((select max(id) from {shapes}) // 2000 + 1)) + x0 // 100 as tile_id, id from {shapes} where x0 // 100 "
        "= (x0 + arm - 1) // 100 and y0 // 100 = (y0 + arm - 1) // 100"
    ),
    ),
    "op_j2_candidates": (
    lambda f: P.overlap_candidates(crowns(f), [], 16), (

    "select a.id as a, b.id as b from {shapes} a join {shapes} b on a.id < b.id and a.x0 <= b.x0 + b.arm and b.x0 <= a.x0 + a.arm and "
        "a.y0 <= b.y0 + b.arm and b.y0 <= a.y0 + a.arm"
    ),
    ),
    "op_g1_iou": (overlap_with_reference, REFERENCE),
    "op_g2_best_per_crown": (
    lambda f: timeseries.best_by(overlap_with_reference(f).withColumn("piece", C("id") % 500), ["piece", "yr"], F.desc("iou"), C("id")).select("piece", "yr", "id", "iou"), (

    f"select piece, yr, id, iou from (select *, row_number() over (partition by id % 500, yr order by iou desc, id) n, id % 500 as "
        f"piece from ({REFERENCE})) where n = 1"
    ),
    ),
    "op_g3_crown_avoid": (lambda f: resolved(P.packed_crowns(crowns(f), []), P.crown_avoid), RESOLVED.replace("{left}", AVOID).replace("{before}", CELLS)),
    "op_g4_crown_avoid_rounds": (
    lambda f: resolved(P.packed_crowns(geom(f.crowd), []), P.crown_avoid_rounds),
    RESOLVED.replace("{left}", ROUNDS).replace("{before}", CROWD),
    ),
    "op_g5_largest_component": (
    lambda f: P.largest_parts(P.crown_avoid(P.packed_crowns(crowns(f), []), []).select("id", "cells")).where(F.size("cells") > 0).select("id", F.size("cells").cast("long").alias("n")),
    f"{PARTS_OF} select id, max(n) as n from (select id, px, py, count(*) as n from r group by 1, 2, 3) group by id",
    ),
    "op_g6_masks_to_crowns": (
    mask_crowns, (

    "select id, lpad(cast(id as varchar), 6, '0') as tag, md5(cast(id as varchar)) as \"GlobalID\", score, (2 * arm * width - width * "
        "width) * 0.25::double as area, (2 * arm * width - width * width) * 0.25::double as outline_area, case when arm = width then 4 "
        "else 6 end as corners, 1000 + x0 * 0.5::double as xmin, 5000 - (y0 + arm) * 0.5::double as ymin, 1000 + (x0 + arm) * 0.5::double "
        "as xmax, 5000 - y0 * 0.5::double as ymax from (select *, row_number() over (partition by id order by score desc, k) n from "
        "{masks}) where n = 1"
    ),
    ),
    "op_w5_best_mask": (
    lambda f: P.best_masks(mask_cells(f)).select("id", "k", "score", F.size("cells").alias("cells")), (

    "select id, k, score, cast(2 * arm * width - width * width + 1 as int) as cells from (select *, row_number() over (partition by id "
        "order by score desc, k) n from {masks}) where n = 1"
    ),
    ),
    "op_w7_largest_outline": (
    lambda f: (lambda p: p.select("id", G.area(C("part")).alias("area"), F.size(C("part")[0]).alias("points"), G.bbox(C("part"))["xmin"].alias("xmin")))(parts(f).where("parts is not null").select("id", G.largest_part(C("parts")).alias("part"))), (

    f"select id, case when id % 5 = 0 then greatest(25, {AREA}) else {AREA} end::double as area, case when id % 5 = 0 and {AREA} < 25 "
        f"then 5 else 6 end as points, (case when id % 5 = 0 and {AREA} < 25 then x0 + 100 else x0 end)::double as xmin from {{shapes}} "
        f"where id % 97 <> 0"
    ),
    ),
    "op_g7_track_crowns": (lambda f: P.track_crowns(observed(f), timeseries.adjacent(f.shape_obs.select("yr"), 1998)), TRACK),
    "op_a5_tie_points": (
    tie_points, (

    "select distinct yr as pair, cast(i as int) as grid_row, cast(j as int) as grid_col, 100 + (j * 25 + 32) * 0.5::double as "
        "\"X_MAP\", 900 - (i * 25 + 32) * 0.5::double as \"Y_MAP\", (yr % 5 - 2) * 0.5::double as \"X_SHIFT_M\", -(yr % 3) * 0.5::double "
        "as \"Y_SHIFT_M\", 100::double as \"RELIABILITY\" from {pixels} p, lateral (select unnest(range(greatest(0, (p.row_no - 63 + 24) "
        "// 25), p.row_no // 25 + 1)) as i) a, lateral (select unnest(range(greatest(0, (p.col - 63 + 24) // 25), p.col // 25 + 1)) as j) "
        "b where r <> 0"
    ),
    ),
    "op_a6_single_window": (single_window, "select distinct yr as pair, (yr % 5 - 2)::double as x_shift, (yr % 3)::double as y_shift from {pixels}"),
    "op_a7_align_local": (lambda f: align.align_local(f.pixels, local_field(f), 10), None),
}
