"""Gauge, series, model and radar operators against closed forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riverine.operators import calibration, radar, rain
from riverine.sources import landing

DAY = dt.date(2024, 9, 8)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect()) if cols else sorted(map(tuple, df.collect()))


@pytest.fixture
def gauge(spark):
    values = {h: 1.0 for h in range(1, 25)} | {5: None, 16: 67.0, 17: 97.5, 18: 33.0}
    return spark.createDataFrame([("s", DAY, h, v) for h, v in values.items()], "station string, day date, hour int, mm double")


def test_summary_and_hyetograph(gauge):
    got = rain.gauge_summary(gauge, ["station", "day"]).first()
    assert (got.total_mm, got.peak_mmh, got.peak_hour, got.missing_hours) == (217.5, 97.5, 17, 1)
    points = rows(rain.hyetograph(gauge, ["station", "day"]), "t_s", "mm_h")
    assert len(points) == 25 and points[-1] == (86400.0, 0.0) and points[4] == (14400.0, 0.0) and points[16] == (57600.0, 97.5)


def test_gauge_without_observations(spark):
    dry = spark.createDataFrame([("s", DAY, h, None) for h in range(1, 25)], "station string, day date, hour int, mm double")
    got = rain.gauge_summary(dry, ["station", "day"]).first()
    assert (got.total_mm, got.peak_mmh, got.peak_hour, got.missing_hours) == (0.0, 0.0, None, 24)


def test_page_parse(spark):
    row = lambda h, v: f"<tr class='m'><td> {h}\n</td><td>1</td><td>2</td><td><b>{v}</b></td></tr>"
    page = "".join(row(h, h / 2) for h in range(1, 25)) + row(5, "--") + row(25, 9) + row("x", 9)
    pages = spark.createDataFrame([("s", page), ("bad", row(1, 2))], "station string, html string")
    good, bad = landing.gauge_pages(pages, ["station"])
    got = dict(rows(good, "hour", "mm"))
    assert len(got) == 24 and got[5] is None and got[24] == 12.0
    assert rows(bad) == [("bad",)]


@pytest.fixture
def series(spark):
    return spark.createDataFrame([("a", 0.0, 0.0), ("a", 3600.0, 10.0), ("a", 7200.0, 30.0), ("a", 10800.0, 0.0)], "k string, t_s double, mm_h double")


def test_rate_and_accumulation(spark, series):
    at = spark.createDataFrame([("a", t) for t in (-1.0, 1800.0, 3600.0, 7200.0, 10800.0, 99999.0)], "k string, t_s double")
    got = {r.t_s: (r.rate, round(r.fallen_mm, 6)) for r in rain.rate_at(at, series, ["k"]).collect()}
    assert got == {-1.0: (0.0, 0.0), 1800.0: (5.0, 1.25), 3600.0: (10.0, 5.0), 7200.0: (30.0, 25.0), 10800.0: (0.0, 40.0), 99999.0: (0.0, 40.0)}


def test_first_rate_holds_before_the_start(spark):
    s = spark.createDataFrame([("a", 100.0, 7.0), ("a", 200.0, 0.0)], "k string, t_s double, mm_h double")
    at = spark.createDataFrame([("a", 0.0), ("a", 100.0)], "k string, t_s double")
    assert {r.rate for r in rain.rate_at(at, s, ["k"]).collect()} == {7.0}


def test_window_bins_and_last_sample(spark, series):
    w = rain.active_window(series, ["k"]).first()
    assert (w.start_s, w.end_s) == (0.0, 10800.0)
    bins = dict(rows(rain.uniform_bins(series, ["k"], 3600.0), "bin", "rate"))
    assert bins == {0: 0.0, 1: 10.0, 2: 30.0, 3: 0.0, 4: 0.0}
    at = spark.createDataFrame([("a", -5.0), ("a", 3600.0), ("a", 5000.0), ("a", 20000.0)], "k string, t_s double")
    assert [r.mm_h for r in rain.last_sample(at, series, ["k"], "mm_h").orderBy("t_s").collect()] == [0.0, 10.0, 10.0, 0.0]


def test_frames(spark):
    cells = spark.createDataFrame([("d", 0, 0.5), ("d", 0, 4.5), ("d", 1800, None), ("d", 1800, 9.0)], "k string, t_s bigint, mm_h double")
    s = rain.frame_series(cells, ["k"], 1800)
    assert rows(s, "t_s", "mm_h") == [(0, 2.5), (1800, 9.0), (3600, 0.0)]
    got = rain.spatial_summary(s, ["k"], 1800).first()
    assert (got.total_mm, got.peak_mmh) == (5.8, 9.0)
    q = spark.createDataFrame([(0.2,), (0.3,), (1.1,), (3.3,), (130.0,)], "mm_h double")
    assert [r.decoded for r in rain.quantised(q).orderBy("mm_h").collect()] == [0.0, 0.5, 1.0, 3.5, 127.5]


def model(spark, hours):
    return spark.createDataFrame([(DAY, h, y, x, 35.15 + y * 0.05, 136.90 + x * 0.05, v) for h, grid in hours.items() for y, line in enumerate(grid) for x, v in enumerate(line)], "day date, hour int, iy int, ix int, lat double, lon double, mm_h double")


def test_factors(spark):
    m = model(spark, {1: [[8.0]], 2: [[6.0]], 3: [[0.09]], 4: [[7.0]], 5: [[0.2]], 6: [[0.1]]})
    observed = spark.createDataFrame([(DAY, 1, 6.0), (DAY, 2, -1.0), (DAY, 3, 12.0), (DAY, 4, None), (DAY, 5, 80.0), (DAY, 6, 0.3)], "day date, hour int, mm double")
    got = dict(rows(calibration.hourly_factors(m, observed), "hour", "factor"))
    assert {h: round(f, 9) for h, f in got.items()} == {1: 0.75, 2: 0.0, 3: 1.0, 4: 0.0, 5: 150.0, 6: 3.0}


def test_bilinear(spark):
    m = model(spark, {1: [[2.0, 8.0, 20.0], [6.0, 16.0, 0.0]]})
    points = spark.createDataFrame([(1, 35.1625, 136.9125), (2, 35.0, 138.0), (3, 36.0, 136.0), (4, 35.175, 136.975)], "point int, lat double, lon double")
    got = {r.point: round(r.mm_h, 6) for r in calibration.resample(points, m, ["day", "hour"]).collect()}
    assert got == {1: 4.75, 2: 20.0, 3: 6.0, 4: 11.0}
    raster = m.select("iy", "ix", F.col("lat").alias("y"), F.col("lon").alias("x"), F.col("mm_h").alias("value"))
    got = {r.point: r.value and round(r.value, 6) for r in calibration.sample_bilinear(points.select("point", F.col("lat").alias("y"), F.col("lon").alias("x")), raster).collect()}
    assert got == {1: 4.75, 2: None, 3: None, 4: 11.0}


def test_model_grids(spark):
    import json

    entry = lambda lat, v: {"latitude": lat, "longitude": 136.9, "hourly": {"precipitation": v}}
    body = json.dumps([entry(35.0, [1.0] * 24), entry(35.0, [None] + [2.0] * 23)])
    responses = spark.createDataFrame([(DAY, body), (dt.date(2024, 9, 9), json.dumps([entry(35.0, [1.0] * 5)]))], "day date, body string")
    good, bad = landing.model_grids(responses)
    assert rows(good, "hour", "mm_h")[:2] == [(1, 0.0), (2, 2.0)] and good.count() == 24 and bad.count() == 1


def test_radar(spark):
    mesh = spark.createDataFrame([(1, 5437, 5437), (2, 5538, 5539)], "seq int, mesh_from int, mesh_to int")
    tiles = radar.with_bounds(mesh)
    first = tiles.where("seq = 1").first()
    assert [round(first[c], 4) for c in ("lat_min", "lat_max", "lon_min", "lon_max")] == [36.0, 36.6667, 137.0, 138.0]
    boxes = spark.createDataFrame([(0, 36.1, 36.4, 137.2, 137.6)], "box int, lat_min double, lat_max double, lon_min double, lon_max double")
    assert rows(radar.overlapping(tiles, boxes)) == [(0, 1)]
    colours = spark.createDataFrame([("99ffff",), ("0038ff",), ("9a0079",), ("c8c8cb",), ("123456",)], "rgb string")
    assert {r.rgb: r.mm_h for r in radar.rates(colours).collect()} == {"99ffff": 3.0, "0038ff": 25.0, "9a0079": 110.0, "c8c8cb": None, "123456": 0.0}
    two = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0), (2, 0.0, 1.0, 0.0, 1.0)], "seq int, lat_min double, lat_max double, lon_min double, lon_max double")
    px = spark.createDataFrame([(0, 1, 0, 0, 5.0), (0, 2, 0, 0, None)], "slot int, seq int, row bigint, col bigint, mm_h double")
    points = spark.createDataFrame([(7, 1.0, 0.0), (8, 5.0, 5.0)], "point int, lat double, lon double")
    assert [tuple(r) for r in radar.sampled(points, two, px, 2, 2).collect()] == [(7, 0, None)]  # the later tile wins, missing or not
    slots = spark.createDataFrame([(DAY, 0), (DAY, 5)], "day date, slot int")
    seen = spark.createDataFrame([(DAY, "0003"), (DAY, "0004"), (DAY, "0002")], "day date, stamp string")
    assert rows(radar.first_stamps(slots, seen), "slot", "stamp") == [(0, "0002"), (5, "0004")]


def test_index_and_upsert(spark):
    docs = spark.createDataFrame([("b.json", "observed-rain", DAY, "N", 97.5, 219.5), ("a.json", "xrain", DAY, None, 6.0, 8.0), ("c.json", "new", DAY, None, None, None)], "file string, kind string, date date, station string, peak_mmh double, total_mm double")
    got = [tuple(r) for r in rain.scenario_index(docs).collect()]
    assert got[0] == ("a.json", "名古屋 XRAINレーダー 2024-09-08", "最大 6 mm/h・合計 8 mm (XRAINレーダー)")
    assert got[1] == ("b.json", "N 2024-09-08", "最大 97.5 mm/h・合計 219.5 mm (AMeDAS実測)") and got[2][1] == "2024-09-08"
    old, new = (spark.createDataFrame(x, "dir string, name string") for x in ([("r1", "x"), ("r2", "y")], [("r1", "z")]))
    assert rows(rain.upsert(old, new, "dir")) == [("r1", "z"), ("r2", "y")]


def test_short_numbers(spark):
    values = [0.0, 0.5, 12.34, 97.5, 100.0, 123.456789, 999999.4, 1200.0, 54321.98]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", rain.short_number(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in got} == {v: f"{v:g}" for v in values}


def test_messages_older_than_the_watermark_are_dropped(spark, tmp_path):
    """STR2: a message more than 8 days behind the newest of the batches before the last one doesn't count."""
    from riverine.streaming import feeds

    at = lambda d, m=0: dt.datetime(2024, 9, d, 0, m)
    batches = [[(at(1), 1, 4.0)], [(at(20), 1, 6.0)], [(at(20, 30), 1, 6.0)], [(at(2), 1, 8.0), (at(13), 1, 2.0)], [(at(29), 1, 1.0)], [(at(29, 30), 1, 1.0)]]
    schema = "ts timestamp, pixel int, mm_h double"
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{n}")
    rows_in = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"file://{tmp_path}/in/*")
    made = feeds.radar_slots(rows_in).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").outputMode("append")
    made.trigger(availableNow=True).start().awaitTermination()
    days = {r.slot.day for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert 1 in days and 13 in days and 2 not in days
