"""Cells of crowns from pixels as rows, against plain comparisons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopylens.functions import geometry as G
from canopylens.operators import colour, zones
from canopylens.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pixels(spark):
    """Three dates, with holes, places below 0, and cells that lack one band or both."""
    r = np.random.default_rng(4)
    rows = [(1996 + k % 3, i, j, *(int(v) if r.random() > 0.1 else None for v in r.integers(0, 256, 2))) for k in range(3) for i in range(-20, 50) for j in range(-30, 60) if r.random() > 0.4]
    return spark.createDataFrame(rows, "yr int, row_no int, col int, v int, w int").cache()


@pytest.fixture(scope="module")
def crowns(spark):
    r = np.random.default_rng(5)
    rows = [(f"c{k}", 1996 + k % 4, *(float(v) for v in (r.uniform(-40, 60), r.uniform(-30, 50), r.uniform(0.2, 40)))) for k in range(80)]
    some = spark.createDataFrame(rows, "id string, yr int, x double, y double, a double").withColumn("a", F.when(F.col("id") < "c3", F.floor("a").cast("double")).otherwise(F.col("a")))
    x, y, a = F.col("x"), F.col("y"), F.col("a")
    hole = G.ring((x + a / 4, y + a / 4), (x + a / 2, y + a / 4), (x + a / 2, y + a / 2), (x + a / 4, y + a / 2))
    leaning = G.ring((x, y), (x + a, y + a / 5), (x + a / 2, y + a), (x - a / 3, y + a / 2))
    some = some.withColumn("geom", F.when(F.col("id") < "c5", G.polygon(leaning, hole)).otherwise(G.l_shape(x, y, a, a / 3)))
    return some.unionByName(some.limit(1).withColumns({"id": F.lit("none"), "geom": F.lit(None).cast(G.RINGS)})).cache()


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).fillna(-1).collect())


def test_cells_of_crowns(pixels, crowns):
    full = pixels.where("v is not null or w is not null")
    want = full.join(crowns, "yr").where(G.contains_point(F.col("geom"), F.col("col") + 0.5, F.col("row_no") + 0.5))
    columns = ("id", "yr", "row_no", "col", "v", "w")
    assert rows_of(zones.zonal_cells(crowns, pixels, ["v", "w"]), *columns) == rows_of(want, *columns) and want.count() > 500
    assert zones.zonal_cells(crowns.where("false"), pixels, ["v"]).count() == 0


def test_cells_around_crowns(pixels, crowns):
    b = G.padded(G.bbox(F.col("geom")), 3)
    near = (F.col("col") + 0.5).between(b["xmin"], b["xmax"]) & (F.col("row_no") + 0.5).between(b["ymin"], b["ymax"])
    want = pixels.where("v is not null").join(crowns.where("geom is not null"), "yr").where(near)
    place = {"chip_row": (F.col("row_no") - F.floor(b["ymin"])).cast("int"), "chip_col": (F.col("col") - F.floor(b["xmin"])).cast("int")}
    got = zones.crown_chips(crowns, pixels, ["v"], 3, draw=lambda o: F.size(o))
    columns = ("id", "yr", "row_no", "col", "v", "chip_row", "chip_col")
    assert rows_of(got, *columns) == rows_of(want.withColumns(place), *columns) and want.count() > 500
    assert {r[0] for r in got.select("outline").distinct().collect()} <= {4, 6}


@pytest.mark.parametrize("name", ["op_s11_crown_chips", "op_f4_zonal_boxes"])
def test_pixels_are_read_once(spark, name):
    """Two scans of the lines, one for the crowns' dates and one for the pixels, and no step in between."""
    plan = catalogue.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [l_orderkey" in line for line in plan.splitlines()) == 2


def test_boxes_with_far_values(spark):
    r = np.random.default_rng(6)
    values = {k: [int(v) for v in np.clip(r.normal(120, 4 + k, n), 0, 250)] + [0, 1, 250] for k, n in enumerate((1, 2, 5, 300))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [(9, 0)], "k int, v int")
    got = {x.k: (x.low, x.q1, x.median, x.q3, x.high) for x in colour.zonal_boxes(df, ["k"], "v").collect()}
    assert got.keys() == values.keys()
    for k, vs in values.items():
        full = np.array([v for v in vs if v])
        q1, q2, q3 = np.quantile(full, [0.25, 0.5, 0.75])
        near = full[(full >= q1 - 1.5 * (q3 - q1)) & (full <= q3 + 1.5 * (q3 - q1))]
        assert got[k] == (near.min(), q1, q2, q3, near.max()), k


def test_contrast_of_many_pictures_at_once():
    """Blocks of one cell, of one value, of all values and of more cells than values, by the curve of each block alone."""
    r = np.random.default_rng(7)
    sizes = [(1, 1, 1.0), (5, 9, 0.5), (19, 19, 0.03), (40, 33, 0.9), (200, 180, 1.0)]
    cells = [(k, i - 3, j + 11) for k, (h, w, share) in enumerate(sizes * 3) for i in range(h) for j in range(w) if r.random() < share or i == j == 0]
    picture, row, col = (np.array(c) for c in zip(*cells, strict=True))
    light = np.where(picture % 5 == 3, 77.0, np.where(picture > 9, r.uniform(0, 255, len(cells)), np.clip(r.normal(60, 6, len(cells)), 0, 255)))
    got = colour.equalised(light, picture, row, col)
    for k in range(len(sizes) * 3):
        own = picture == k
        y, x, v = row[own] - row[own].min(), col[own] - col[own].min(), np.round(light[own]).astype(int)
        h, w = y.max() + 1, x.max() + 1
        curves = {}
        for b in {(p, q) for p, q in zip(y * 8 // h, x * 8 // w, strict=True)}:
            curves[b] = colour.clipped_curve(np.bincount(v[(y * 8 // h == b[0]) & (x * 8 // w == b[1])], minlength=256))
        total, weight = np.zeros(len(v)), np.zeros(len(v))
        at_y, at_x = (y + 0.5) * 8 / h - 0.5, (x + 0.5) * 8 / w - 0.5
        for n in range(len(v)):
            for i in (int(np.floor(at_y[n])), int(np.floor(at_y[n])) + 1):
                for j in (int(np.floor(at_x[n])), int(np.floor(at_x[n])) + 1):
                    near = min(max(i, 0), 7), min(max(j, 0), 7)
                    if near in curves:
                        u = (1 - abs(at_y[n] - i)) * (1 - abs(at_x[n] - j))
                        total[n], weight[n] = total[n] + u * curves[near][v[n]], weight[n] + u
        want = np.where(weight > 0, total / np.where(weight > 0, weight, 1), light[own])
        assert np.abs(got[own] - want).max() < 1e-8, k


def test_similarity_counts_pixels_once(spark):
    """The plan starts at the written counts, and histograms aren't dealt by their few bins."""
    plan = catalogue.queries()["op_f10_similarity"](spark, DIR)._jdf.queryExecution()
    assert "Relation [l_orderkey" not in plan.optimizedPlan().toString()
    assert "SortMergeJoin" not in plan.executedPlan().toString()
