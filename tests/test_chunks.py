"""Chunked rasters against plain pixels: kernels, pruned scans, medians by selection."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopylens.functions import geometry as G
from canopylens.operators import chunks, raster
from canopylens.sources import files

SIZE = 200
RING = [(20.3, 10.2), (150.7, 30.1), (90.5, 180.9), (60.2, 60.6)]


@pytest.fixture(scope="module")
def pixels(spark):
    """Two dates of 200 x 200 cells, a tenth of which are missing, with integers, continuous heights and some nulls."""
    r = np.random.default_rng(1)
    rows = [(yr, i, j, int(r.integers(0, 256)), float(r.normal(20, 5)) if r.random() > 0.05 else None) for yr in (1996, 1997) for i in range(SIZE) for j in range(SIZE) if r.random() > 0.1]
    return spark.createDataFrame(rows, "yr int, row_no int, col int, v int, h double").cache()


@pytest.fixture(scope="module")
def table(pixels):
    return files.raster_table(pixels, ["v", "h"], 16, per_file=8)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def scanned(df):
    """How many chunks the scan of df's plan gave, after a run."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan"):
            out.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif hasattr(node, "plan") and "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sum(out)


def test_chunks_hold_every_cell(pixels, table):
    assert rows_of(chunks.cells_of(table, ["v", "h"]), "yr", "row_no", "col", "v", "h") == rows_of(pixels, "yr", "row_no", "col", "v", "h")
    assert rows_of(files.read_raster(table, ["h"]), "yr", "row_no", "col", "h") == rows_of(pixels.where("h is not null"), "yr", "row_no", "col", "h")
    r = table.agg(F.sum("n").alias("n"), F.max("row1").alias("row1"), F.min("v_min").alias("lo"), F.max("h_max").alias("hi")).first()
    want = pixels.agg(F.count("*"), F.max("row_no"), F.min("v"), F.max("h")).first()
    assert tuple(r) == tuple(want)


def test_windows_skip_chunks(spark, pixels, table):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    every = table.count()
    box = chunks.crop_box(table, 100, 40, 120, 60, 2)
    plan = box._jdf.queryExecution().toString()
    assert all(f"{op}({c}" in plan for op, c in (("GreaterThanOrEqual", "col1"), ("LessThanOrEqual", "col0"), ("GreaterThanOrEqual", "row1"), ("LessThanOrEqual", "row0")))
    assert rows_of(chunks.cells_of(box, ["v", "h"]), "yr", "row_no", "col", "v", "h") == rows_of(pixels.where("col between 98 and 121 and row_no between 38 and 61"), "yr", "row_no", "col", "v", "h")
    assert scanned(box.where("yr = 1996")) <= every // 8 and scanned(table) == every
    assert chunks.cells_of(chunks.crop_box(table, 1000, 0, 1100, 10), ["v"]).count() == 0


def test_cells_in_polygons(spark, pixels, table):
    g = G.polygon(G.ring(*RING))
    want = pixels.where(G.contains_point(g, F.col("col") + 0.5, F.col("row_no") + 0.5))
    cropped = chunks.crop_polygon(table, [RING])
    assert rows_of(chunks.cells_of(cropped, ["v", "h"]), "yr", "row_no", "col", "v", "h") == rows_of(want, "yr", "row_no", "col", "v", "h") and want.count() > 1000
    assert cropped.where(F.array_max("v") != F.col("v_max")).count() == 0
    hole = [(70, 50), (90, 50), (90, 70), (70, 70)]
    holed = chunks.cells_of(chunks.crop_polygon(table, [RING, hole]), ["v"])
    inside_hole = F.col("col").between(70, 89) & F.col("row_no").between(50, 69)
    assert rows_of(holed, "yr", "row_no", "col") == rows_of(want.where(~inside_hole), "yr", "row_no", "col")


def test_zonal_pixels_of_many_crowns(spark, pixels, table, monkeypatch):
    monkeypatch.setattr(chunks, "CROWNS_AT_ONCE", 7)
    r = np.random.default_rng(2)
    rows = [(f"c{k}", 1996 + k % 3, float(x), float(y), float(a)) for k, (x, y, a) in enumerate(zip(r.uniform(-10, 210, 120), r.uniform(-10, 210, 120), r.uniform(0.2, 25, 120), strict=True))]
    crowns = spark.createDataFrame(rows, "id string, yr int, x double, y double, a double")
    crowns = crowns.withColumn("geom", G.l_shape(F.col("x"), F.col("y"), F.col("a"), F.col("a") / 3))
    crowns = crowns.unionByName(crowns.limit(1).withColumns({"id": F.lit("none"), "geom": F.lit(None).cast(G.RINGS)}))
    got = chunks.zonal_pixels(crowns, table, ["v", "h"], side=16)
    met = pixels.join(crowns, "yr").where(G.contains_point(F.col("geom"), F.col("col") + 0.5, F.col("row_no") + 0.5))
    assert rows_of(got, "id", "yr", "row_no", "col", "v", "h") == rows_of(met, "id", "yr", "row_no", "col", "v", "h") and met.count() > 500
    assert chunks.zonal_pixels(crowns.where("false"), table, ["v"], side=16).count() == 0


def test_nodata_touches_only_chunks_that_hold_it(pixels, table):
    out = chunks.mask_nodata(table, ["v"], 7)
    assert rows_of(chunks.cells_of(out, ["v"]), "yr", "row_no", "col", "v") == rows_of(pixels.where("v <> 7"), "yr", "row_no", "col", "v")
    assert out.agg(F.sum(chunks.values_in("v"))).first()[0] == pixels.where("v <> 7").count()
    assert chunks.mask_nodata(table, ["h"], -32767).exceptAll(table).count() == 0


def test_tiles_with_halos(pixels, table):
    got = chunks.cells_of(chunks.cut_tiles(table, 60, 7, *chunks.tiles_along(table, 60)), ["v"], ("tile_row", "tile_col"))
    near = lambda c, k: f"{c} between {k * 60 - 7} and {k * 60 + 66}"
    want = [(i, j, pixels.where(near("row_no", i)).where(near("col", j)).count()) for i in range(4) for j in range(4)]
    assert sorted(map(tuple, got.groupBy("tile_row", "tile_col").count().collect())) == want


@pytest.mark.parametrize("few", [4096, 3])
def test_medians_by_selection(spark, pixels, monkeypatch, few):
    monkeypatch.setattr(raster, "FEW", few)
    monkeypatch.setattr(raster, "RANGES", 16)
    got = {r.yr: r.median for r in raster.median_of(pixels, "h", ["yr"]).collect()}
    for yr in (1996, 1997):
        assert got[yr] == pytest.approx(statistics.median(r.h for r in pixels.where(f"yr = {yr} and h is not null").collect()), abs=1e-12)
    odd = [(1, 5.0), (1, 5.0), (1, None), (2, None), (3, float("nan")), (3, -1.0), (4, 1.0), (4, 2.0), (4, 1e300), (4, -1e300), (5, 1.0), (5, 9.0), (None, 3.0)]
    odd += [(6, float(k % 2)) for k in range(50)] + [(7, 2.0**k) for k in range(-60, 60)] + [(8, 1.0)] * 40 + [(8, 2.0)] * 39
    table = spark.createDataFrame(odd, "k int, v double")
    want = {}
    for k, v in odd:
        if v is not None and v == v:
            want.setdefault(k, []).append(v)
    assert {r.k: r.median for r in raster.median_of(table, "v", ["k"]).collect()} == {k: statistics.median(v) for k, v in want.items()}
    assert raster.median_of(table.where("k = 7"), "v", []).first().median == statistics.median(want[7]) and raster.median_of(table.where("false"), "v", []).count() == 0
