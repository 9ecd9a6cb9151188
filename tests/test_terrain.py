"""Rasters, voids, drainage and footprints against plain sequential versions."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from riverine.operators import drainage, footprints, raster, voids
from riverine.operators.drainage import NEIGHBOURS
from riverine.sources import landing
from test_lookups import recorded


def table(spark, grid, name="z"):
    return spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(grid)], f"r bigint, c bigint, {name} double")


def grid_of(df, shape, col):
    out = np.full(shape, np.nan)
    for r in df.select("r", "c", col).collect():
        if r[2] is not None:
            out[r.r, r.c] = r[2]
    return out


def flooded(dem, eps=0.001):
    """The fixed point by relaxation from above: an inner cell is its own height, or eps above its lowest neighbour."""
    inner = np.zeros(dem.shape, bool)
    inner[1:-1, 1:-1] = True
    ground, f = np.where(np.isnan(dem), -np.inf, dem), np.where(inner, np.inf, np.nan_to_num(dem, nan=0.0))
    while True:
        wide = np.pad(f, 1, constant_values=np.inf)
        least = np.min([wide[1 + a : wide.shape[0] - 1 + a, 1 + b : wide.shape[1] - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b], axis=0)
        new = np.where(inner, np.where(ground > least, ground, least + eps), f)
        if np.array_equal(new, f):
            return np.where(~inner & np.isnan(dem), np.nan, f)
        f = new


def accumulated(f, dx):
    """Sequential directions, accumulation and longest path, from high to low."""
    h, w = f.shape
    acc, path, to = np.ones(f.shape), np.zeros(f.shape), {}
    for y in range(h):
        for x in range(w):
            best = 0.0
            for ddx, ddy in NEIGHBOURS:
                v, u = y + ddy, x + ddx
                if 0 <= v < h and 0 <= u < w:
                    slope = (f[y, x] - f[v, u]) / (dx * (2**0.5 if ddx and ddy else 1))
                    if slope > best:
                        best, to[y, x] = slope, (v, u)
    for y, x in sorted(to, key=lambda k: -f[k]):
        v, u = to[y, x]
        acc[v, u] += acc[y, x]
        path[v, u] = max(path[v, u], path[y, x] + dx * (2**0.5 if v != y and u != x else 1))
    return acc, path


@pytest.mark.parametrize("seed", [1, 2])
def test_depressions_and_routing(spark, seed):
    rng = np.random.default_rng(seed)
    dem = np.round(rng.random((20, 26)) * 10, 2)
    dem[rng.random(dem.shape) < 0.05] = np.nan
    got = grid_of(voids.filled_depressions(table(spark, dem), tile=8), dem.shape, "z")
    want = flooded(dem)
    assert np.array_equal(np.isnan(got), np.isnan(want)) and np.allclose(got[~np.isnan(got)], want[~np.isnan(want)], atol=1e-12)
    smooth = np.nan_to_num(want, nan=0.0)
    tile = {1: 4, 2: 7}[seed]  # paths cross many tiles
    flow = drainage.directions(table(spark, smooth), 5.0, tile)
    routed = drainage.routed(flow, 5.0, tile)
    acc, path = accumulated(smooth, 5.0)
    whole = {(r.r, r.c): (r.acc, round(r.path_m, 6), r.head_z) for r in drainage.routed(flow, 5.0).collect()}
    assert whole == {(r.r, r.c): (r.acc, round(r.path_m, 6), r.head_z) for r in routed.collect()}
    assert np.array_equal(grid_of(routed, dem.shape, "acc"), acc) and np.allclose(grid_of(routed, dem.shape, "path_m"), path)
    ends = flow.where("to_r IS NULL").join(routed, ["r", "c"]).agg({"acc": "sum"}).first()[0]
    assert ends == dem.size


def test_hollows_drain_to_the_lowest_corner(spark):
    dem = 60 - 1.3 * np.arange(9.0)[:, None] - 0.9 * np.arange(7.0)[None, :]
    dem[2:4, 1:3], dem[6, 4] = 11.0, -4.0
    filled = voids.filled_depressions(table(spark, dem), tile=4)
    z = grid_of(filled, dem.shape, "z")
    assert (z[2:4, 1:3] > 11).all() and z[6, 4] > dem[7, 5] and np.array_equal(z, flooded(dem))
    assert drainage.routed(drainage.directions(filled, 5.0), 5.0).where("r = 8 AND c = 6").first().acc == dem.size


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([None, 1.0, 2.0, 5.0]), min_size=7, max_size=7), min_size=6, max_size=6))
def test_filling_is_idempotent_and_never_lowers(spark, cells):
    dem = np.array([[np.nan if v is None else v for v in line] for line in cells])
    once = grid_of(voids.filled_depressions(table(spark, dem), tile=4), dem.shape, "z")
    ok = ~np.isnan(dem)
    assert (once[ok] >= dem[ok]).all() and np.array_equal(once, flooded(dem), equal_nan=True)


def plain_fill(z, hole, rounds=500):
    """Rounds of 3 x 3 means over the whole grid at once; z has NaN in holes."""
    z = np.pad(z, 1, constant_values=np.nan)
    for _ in range(rounds):
        open_ = [(y, x) for y, x in np.argwhere(hole) if np.isnan(z[y + 1, x + 1])]
        new = {}
        for y, x in open_:
            around = z[y : y + 3, x : x + 3]
            if not np.isnan(around).all():
                new[y + 1, x + 1] = np.nanmean(around)
        if not new:
            break
        for at, v in new.items():
            z[at] = v
    z = z[1:-1, 1:-1]
    return np.where(hole & np.isnan(z), 0.0, z)


@pytest.mark.parametrize(("seed", "tile", "halo", "rounds"), [(0, 4, 2, 500), (1, 5, 5, 500), (2, 8, 3, 4), (3, 32, 8, 500)])
def test_holes_over_many_tiles(spark, seed, tile, halo, rounds):
    """A hole that spans several tiles, small ones, and sea, against the plain fill of the whole grid."""
    rng = np.random.default_rng(seed)
    dem = rng.normal(20, 5, (19, 23))
    dem[4:15, 3:20] = np.nan
    dem[9, 10] = 3.0
    dem[rng.random(dem.shape) < 0.1] = np.nan
    dem[0:2, 5:8] = np.nan
    got = voids.classified(table(spark, dem, "elev"), tile=tile)
    sea = np.zeros(dem.shape, bool)
    for r in got.where("sea").collect():
        sea[r.r, r.c] = True
    assert sea[0, 6] and np.isnan(dem[sea]).all()
    want = plain_fill(np.where(sea, 0.0, dem), np.isnan(dem) & ~sea, rounds)
    filled = voids.filled_holes(got, tile=tile, rounds=rounds, halo=halo)
    assert np.allclose(grid_of(filled, dem.shape, "elev"), want, atol=1e-9)
    assert filled.where("sea").count() == sea.sum()


def test_hole_without_anything_known(spark):
    cells = table(spark, np.full((5, 5), np.nan), "elev").selectExpr("r", "c", "elev", "false AS sea")
    assert {r.elev for r in voids.filled_holes(cells, tile=2, halo=1).collect()} == {0.0}


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("seed", range(6))
def test_labels(seed, diagonal):
    mask = np.random.default_rng(seed).random((13, 17)) < 0.25 + 0.1 * seed
    got = voids._labels(mask, diagonal)
    seen = np.full(mask.shape, -1)
    for y, x in np.argwhere(mask):
        if seen[y, x] < 0:
            todo = [(y, x)]
            while todo:
                v, u = todo.pop()
                if 0 <= v < 13 and 0 <= u < 17 and mask[v, u] and seen[v, u] < 0:
                    seen[v, u] = y * 17 + x
                    todo += [(v + a, u + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if diagonal or not (a and b)]
    assert (got == seen).all()
    assert (voids._labels(np.zeros((4, 4), bool), diagonal) == -1).all()


def test_sea_group_across_tiles(spark):
    dem = np.ones((12, 12))
    dem[5, :11] = np.nan  # reaches the west border through three tiles
    dem[7, 5:8] = np.nan
    sea = voids.classified(table(spark, dem, "elev"), tile=4).where("sea").count()
    assert sea == 11


def test_blocks(spark):
    cells = table(spark, np.arange(16.0).reshape(4, 4), "elev")
    assert sorted(r.elev for r in raster.pooled(cells, 2, "elev").collect()) == [2.5, 4.5, 10.5, 12.5]
    coast = np.full((10, 10), 50.0)
    coast[0, :] = 1.0
    coast[5, 5] = 1.0
    assert raster.coastal(table(spark, coast, "elev")).where("coastal").count() == 10
    heights = spark.createDataFrame([(r, c, 300 if 1 <= r <= 3 and 1 <= c <= 2 else (200 if (r, c) == (0, 0) else 0)) for r in range(5) for c in range(5)], "r bigint, c bigint, height_cm bigint")
    assert [tuple(x) for x in raster.rectangles(heights).collect()] == [(1, 1, 2, 3, 300, 6)]


def test_channels_and_lag(spark):
    y, x = np.indices((18, 15))
    dem = 12 - y / 7 + (x - 4) ** 2 / 40
    got = drainage.channels(table(spark, dem), 5.0, 40.0)
    rows = got.collect()
    assert rows and all(r.width_m > 0 and r.slope >= 1e-4 and r.lag_s > 0 for r in rows)
    steady = spark.createDataFrame([(0.0, 50.0), (1e9, 50.0)], "t_s double, mm_h double")
    times = spark.createDataFrame([(50000.0,)], "t_s double")
    assert all(abs(r.rate - 50.0) < 1e-9 for r in drainage.lagged_rates(got, times, steady).collect())


def test_lagged_rates_are_not_stored(spark, monkeypatch):
    """Against plain interpolation, with a key that has no series; rates are neither written nor joined on the way to overflow."""
    rng = np.random.default_rng(4)
    series = {k: sorted((float(t), float(rng.integers(0, 90))) for t in rng.choice(4000, n, replace=False)) for k, n in (("a", 1), ("b", 2), ("c", 25))}
    lags = [(i, i + 1, float(rng.integers(0, 3000)) / 2, 25.0 * i, 1.0, 0.01, 0.1) for i in range(40)]
    channel = spark.createDataFrame(lags, "r long, c long, lag_s double, area_m2 double, width_m double, slope double, depth_m double")
    times = spark.createDataFrame([(k, float(t)) for k in ("a", "b", "c", "none") for t in range(0, 6000, 250)], "day string, t_s double")
    rows = recorded(monkeypatch, drainage)
    rates = drainage.lagged_rates(channel, times, spark.createDataFrame([(k, t, v) for k, p in series.items() for t, v in p], "day string, t_s double, mm_h double"), ["day"])

    def at(points, q):
        i = sum(t < q for t, _ in points)
        if not points or i == len(points):
            return 0.0
        (a, u), (b, v) = points[max(i - 1, 0)], points[i]
        return v if i == 0 else u + (v - u) * (q - a) / (b - a)

    lag = {r: x for r, _, x, *_ in lags}
    got = drainage.overflow(rates, ["day"]).collect()
    assert len(got) == 40 * 4 * 24 and max(rows) <= 4
    for g in got:
        want = sum(w * at(series.get(g.day, []), g.t_s - k * lag[g.r]) for w, k in drainage.TAPS)
        assert abs(g.rate - want) < 1e-9 and g.excess_m >= 0


def test_footprints(spark):
    ring = [(1.0, 1.0), (1.0, 4.0), (4.0, 4.0), (4.0, 1.0)]
    rows = [("a", 1, 1000, [{"y": y, "x": x} for y, x in ring]), ("a", 2, 500, [{"y": y + 2, "x": x} for y, x in ring])]
    got = footprints.rasterised(spark.createDataFrame(rows, "file string, seq bigint, height_cm bigint, ring array<struct<y:double,x:double>>"), 3)
    cells = {(r.r, r.c): r.height_cm for r in got.collect()}
    assert len(cells) == 15 and cells[1, 1] == 1000 and cells[3, 3] == 500


def test_elevation_text(spark):
    text = "\n".join(",".join("e" if (r, c) == (1, 1) else str(r * 10 + c) for c in range(5)) for r in range(4))
    files = spark.createDataFrame([("/x/7_9.txt", text), ("/x/1_1.txt", "1,2\n3"), ("/x/2_2.txt", "1,2,3,4\n1,2,3,4\n1,2,3\n1,2,3,4"), ("/x/3_3.txt", "")], "path string, value string")
    cells, bad = landing.elevation_tiles(files, 4)
    got = {(r.r, r.c): r.elev for r in cells.collect()}
    assert len(got) == 16 and got[1, 1] is None and got[3, 3] == 33.0
    assert sorted(tuple(r) for r in bad.collect()) == [("/x/1_1.txt", "wrong number of rows"), ("/x/2_2.txt", "short row")]


def test_positions(spark):
    square = "35.0 136.0 35.0 136.1 35.1 136.1 35.1 136.0"
    solid = " ".join(f"{a} {b} 12.0" for a, b in zip(square.split()[::2], square.split()[1::2], strict=True))
    lists = spark.createDataFrame([("2d", square), ("3d", solid), ("short", "1 2 3"), ("two", "1 2 3 4")], "k string, text string")
    got = {r.k: r.ring and len(r.ring) for r in landing.positions(lists).collect()}
    assert got == {"2d": 4, "3d": 4, "short": None, "two": None}
    assert landing.positions(lists).where("k = '3d'").first().ring[1].lon == 136.1


def test_city_gml(spark, tmp_path):
    from riverine.sources.buildings import buildings

    ring = lambda t: f"<gml:LinearRing><gml:posList>{t}</gml:posList></gml:LinearRing>"
    square, hole = "35.0 136.0 0 35.0 136.1 0 35.1 136.1 0 35.0 136.0 0", "35.01 136.01 0 35.01 136.02 0 35.02 136.02 0"
    one = lambda h, t: f'<bldg:Building gml:id="b{h}">{f"<bldg:measuredHeight uom=" + chr(34) + "m" + chr(34) + f">{h}</bldg:measuredHeight>" if h else ""}<bldg:lod0FootPrint><gml:MultiSurface><gml:surfaceMember><gml:Polygon><gml:exterior>{ring(t)}</gml:exterior><gml:interior>{ring(hole)}</gml:interior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></bldg:lod0FootPrint></bldg:Building>'
    (tmp_path / "a.gml").write_text(f'<core:CityModel xmlns:core="c" xmlns:bldg="b" xmlns:gml="g">{one("10.0", square)}{one("tall", square)}{one("999", square)}{one("", square)}</core:CityModel>')
    rows = buildings(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.id for r in rows] == ["b10.0", "b10.0", "b999", "b999"] and len({r.seq for r in rows}) == 4
    got = sorted((r.height_cm, len(r.ring)) for r in rows)
    assert got == [(1000, 3), (1000, 4), (32000, 3), (32000, 4)]


def png(path, pixels):
    import struct
    import zlib

    h, w = pixels.shape[:2]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    from pyspark.sql import functions as F

    from riverine.sources import images

    rgb = np.zeros((2, 3, 3), np.uint8)
    rgb[1, 2] = (1, 2, 3)
    png(tmp_path / "5_6.png", rgb)
    got = images.pixels(spark, str(tmp_path)).select("r", "c", images.elevation_cm(F.col("red"), F.col("green"), F.col("blue")).alias("cm"), images.tile_of(F.col("path"))[0].alias("x"), images.hexadecimal(F.col("red"), F.col("green"), F.col("blue")).alias("hex"))
    cells = {(r.r, r.c): (r.cm, r.x, r.hex) for r in got.collect()}
    assert len(cells) == 6 and cells[1, 2] == (65536 + 512 + 3, 5, "010203") and cells[0, 0] == (0, 5, "000000")
