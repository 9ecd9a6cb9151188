"""Sinks, rings as pixel runs, zones of polygons and look-ups by buckets, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverine.operators import catalog, footprints, rain, zones
from riverine.sources import sinks
from test_lookups import joined_rows


def test_index_keeps_the_last_complete_version(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = lambda *r: spark.createDataFrame(list(r), "dir string, n int")
    assert sinks.read_index(spark, path) is None
    sinks.replace_index(rows(("a", 1), ("b", 1)), path, "dir")
    sinks.replace_index(rows(("b", 2)), path, "dir")
    rows(("c", 9)).write.parquet(f"{path}/version=3")
    (tmp_path / "index" / "version=3" / "_SUCCESS").unlink()  # a run that was lost
    assert sorted(map(tuple, sinks.read_index(spark, path).collect())) == [("a", 1), ("b", 2)]
    sinks.replace_index(rows(("d", 4)), path, "dir")
    assert sinks.read_index(spark, path).count() == 3


def test_tiles_are_folders(spark, tmp_path):
    cells = spark.range(40).select((F.col("id") % 8).alias("r"), F.floor(F.col("id") / 8).alias("c"), F.lit(1).alias("v"))
    sinks.write_tiles(cells, str(tmp_path / "t"), 4)
    assert sorted(p.name for p in (tmp_path / "t").glob("tile_r=*/tile_c=*")) == ["tile_c=0", "tile_c=0", "tile_c=1", "tile_c=1"]
    assert spark.read.parquet(str(tmp_path / "t")).where("tile_r = 1 AND tile_c = 1").count() == 4


def even_odd(y, x, ring):
    odd = False
    for (y0, x0), (y1, x1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            odd = not odd
    return odd


@pytest.mark.parametrize("tile", [5, 64])
def test_rings_of_any_shape(spark, tile):
    rng = np.random.default_rng(3)
    rings = [[(float(a), float(b)) for a, b in np.round(rng.random((n, 2)) * 24 - 4, 1)] for n in (3, 4, 5, 7, 12)]
    rows = [("f", i, 100 * i, [{"y": y, "x": x} for y, x in ring]) for i, ring in enumerate([*rings, [(2.0, 2.0)] * 3])]
    got = footprints.rasterised(spark.createDataFrame(rows, "file string, seq bigint, height_cm bigint, ring array<struct<y:double,x:double>>"), tile)
    want = {(r, c): 100 * i for i, ring in enumerate(rings) for r in range(-5, 21) for c in range(-5, 21) if even_odd(r + 0.5, c + 0.5, ring)}
    assert {(r.r, r.c): r.height_cm for r in got.collect()} == want


def test_pixels_of_many_rings_are_thinned_where_they_are_painted(spark):
    """Rings over the same places, in no order and over a tile's edge: of each pixel few go on to the aggregation."""
    square = lambda y, x: [{"y": y + a, "x": x + b} for a, b in ((0.0, 0.0), (0.0, 6.0), (6.0, 6.0), (6.0, 0.0))]
    rows = [(f"f{i % 2}", i, i, square(float(i % 5), float(i % 3))) for i in np.random.default_rng(9).permutation(3000).tolist()]
    before = joined_rows(spark)[1]
    got = footprints.rasterised(spark.createDataFrame(rows, "file string, seq bigint, height_cm bigint, ring array<struct<y:double,x:double>>"), 8).collect()
    want = {}
    for _, i, _, _ in sorted(rows, key=lambda b: b[:2]):
        want |= {(i % 5 + a, i % 3 + b): i for a in range(6) for b in range(6)}
    assert {(r.r, r.c): r.height_cm for r in got} == want
    assert 0 < joined_rows(spark, before, "MapInArrow")[0] < len(rows) * 36 / 20


def test_no_buildings(spark):
    none = spark.createDataFrame([], "file string, seq bigint, height_cm bigint, ring array<struct<y:double,x:double>>")
    assert footprints.rasterised(none).count() == 0


def test_polygon_boxes_include_their_ends(spark):
    cells = spark.range(36).select(F.floor(F.col("id") / 6).alias("r"), (F.col("id") % 6).alias("c"))
    triangle = [(9, [(130.0, 0.0), (130.0 + 2 / 111_320.0, 0.0), (130.0, -3.5 / 111_320.0)])]
    got = zones.in_polygons(cells, spark.createDataFrame(triangle, "zone int, polygon array<struct<lon:double,lat:double>>"), 130.0, 0.0, 1.0)
    assert {(r.r, r.c) for r in got.collect()} == {(r, c) for r in range(4) for c in range(3)}


def test_rates_across_buckets(spark):
    t, v = [100.0, 4000.0, 4000.5, 30000.0], [2.0, 6.0, 1.0, 9.0]
    series = spark.createDataFrame([("k", a, b) for a, b in zip(t, v, strict=True)], "k string, t_s double, mm_h double")
    asked = [-5.0, 100.0, 3600.0, 4000.0, 4000.2, 7200.0, 29999.0, 30000.0, 30001.0]
    at = spark.createDataFrame([("k", a) for a in asked] + [("other", 1.0)], "k string, t_s double")
    got = {(r.k, r.t_s): r.rate for r in rain.rate_at(at, series, ["k"]).collect()}
    want = {("k", a): (0.0 if a > t[-1] else float(np.interp(a, t, v))) for a in asked} | {("other", 1.0): 0.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_recent_days(spark):
    rows = spark.createDataFrame([(i,) for i in range(-2, 10)], "age int").withColumn("day", F.date_sub(F.lit("2020-05-20").cast("date"), F.col("age")))
    today = spark.sql("SELECT DATE'2020-05-20' AS today")
    assert sorted(r.age for r in catalog.recent(rows, today).collect()) == list(range(8))
