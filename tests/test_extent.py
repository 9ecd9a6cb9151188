"""Frames, satellite comparison, zones and catalogues against closed forms."""

import pytest
from pyspark.sql import functions as F

from riverine.functions import hydraulics
from riverine.operators import catalog, extent, frames, zones


def one(df):
    return df.first().asDict()


@pytest.fixture
def stored(spark):
    rows = [("a", i, 60.0 * i, r, c, h, 0.1, -0.2) for i, grid in enumerate([[0.06, 0.5, 1.5, 0.0], [0.0, 0.6, 1.0, 0.0]]) for (r, c), h in zip([(0, 0), (0, 1), (1, 0), (1, 1)], grid, strict=True)]
    return spark.createDataFrame(rows, "region string, frame int, t_s double, r bigint, c bigint, h double, qe double, qs double")


def test_statistics(stored):
    got = one(frames.statistics(stored, 10.0).where("frame = 0"))
    assert (got["a5"], got["a30"], got["a100"], got["volume"]) == (300.0, 200.0, 100.0, 206.0)


def test_bytes(stored):
    b = one(frames.encoded(stored).where("frame = 0 AND r = 0 AND c = 1"))
    assert (b["red"], b["green"], b["blue"]) == (50, 138, 108)
    back = frames.decoded(frames.encoded(stored)).join(stored.withColumnRenamed("h", "was"), ["region", "frame", "r", "c"])
    assert back.where("abs(h - was) > 0.011").count() == 0


def test_maxima_and_fronts(stored):
    top = {(r.r, r.c): r.h_max for r in frames.final_maximum(stored).collect()}
    assert top == {(0, 0): 0.06, (0, 1): 0.6, (1, 0): 1.5, (1, 1): 0.0}
    age = {(r.r, r.c, r.frame): r.age for r in frames.wet_age(stored).collect()}
    assert age[0, 0, 0] == 0.0 and age[0, 1, 1] == 60.0 and age[1, 1, 1] == 1e9


def test_key_and_nearest_frames(spark):
    stats = spark.createDataFrame([("a", i, 60.0 * i, v) for i, v in enumerate([0.0, 5.0, 9.0, 9.0, 1.0, 0.0])], "region string, frame int, t_s double, a5 double")
    assert sorted(r.frame for r in frames.key_frames(stats, 4).collect()) == [0, 2, 4, 5]
    at = spark.createDataFrame([("a", -9.0), ("a", 30.0), ("a", 29.0), ("a", 9999.0)], "region string, t_s double")
    assert {r.t_s: r.frame for r in frames.nearest_frame(at, stats.select("region", "frame", "t_s")).collect()} == {-9.0: 0, 30.0: 1, 29.0: 0, 9999.0: 5}


def test_change(spark):
    pairs = spark.createDataFrame([(1, 1.0, 0.5), (2, 1.0, 1.0), (3, 1.0, 2.0), (4, None, 0.1), (5, 1e-4, 1e-9)], "cell int, pre double, post double")
    assert {r.cell: r.darkened for r in extent.change(pairs).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_confusion_over_the_grid(spark):
    """Masks on grids wider than a word, one of them without any water, against sets."""
    import random

    rng = random.Random(4)
    sizes = {"p": (7, 150), "q": (3, 64), "dry": (2, 5)}
    grids = spark.createDataFrame([(k, h, w) for k, (h, w) in sizes.items()], "product string, height bigint, width bigint")
    place = lambda k: (rng.randrange(sizes[k][0]), rng.randrange(sizes[k][1]))
    model = {(k, *place(k)): rng.choice([0.0, 0.05, 0.1, 2.0]) for k in ("p", "q") for _ in range(200)}
    water = {(k, *place(k)): rng.choice([0.2, 0.4, 0.5, 0.9]) for k in ("p", "q") for _ in range(150)}
    make = lambda d, name: spark.createDataFrame([(*k, v) for k, v in d.items()], f"product string, r bigint, c bigint, {name} double")
    masks = extent.compared(make(model, "h_max"), make(water, "value"), ["product"])
    got = {r["product"]: r for r in extent.confusion(masks, grids, ["product"]).collect()}
    swept = {(r["product"], r["threshold"]): r for r in extent.sweep(make(model, "h_max"), make(water, "value"), grids, ["product"]).collect()}
    cells = {(r["product"], r.r, r.c): r.kind for r in extent.overlay(masks, grids, ["product"]).collect()}
    agreed = {tuple(r) for r in extent.agreement(masks, ["product"]).collect()}
    assert len(cells) == sum(h * w for h, w in sizes.values()) and len(swept) == 9
    for k, (h, w) in sizes.items():
        m = {x for x, v in model.items() if v >= 0.1 and x[0] == k}
        for t in (0.3, 0.5, 0.7):
            s = {x for x, v in water.items() if v >= t and x[0] == k}
            want = (len(m & s), len(m - s), len(s - m), h * w - len(m | s), len(m), len(s))
            assert tuple(swept[k, t][n] for n in ("tp", "fp", "fn", "tn", "model_cells", "sat_cells")) == want
        s = {x for x, v in water.items() if v >= 0.5 and x[0] == k}
        assert tuple(got[k][n] for n in ("tp", "fp", "fn", "tn")) == (len(m & s), len(m - s), len(s - m), h * w - len(m | s))
        assert {x for x in agreed if x[0] == k} == m & s
        for kind, own in (("both", m & s), ("model", m - s), ("satellite", s - m)):
            assert {x for x, v in cells.items() if v == kind and x[0] == k} == own


def test_scores(spark):
    counts = spark.createDataFrame([(3, 1, 2), (0, 0, 4), (0, 2, 0)], "tp bigint, fp bigint, fn bigint")
    assert sorted(((r.tp, r.precision, r.recall, r.f1 and round(r.f1, 6)) for r in extent.scores(counts).collect()), key=repr) == sorted([(3, 0.75, 0.6, round(2 / 3, 6)), (0, None, 0.0, None), (0, 0.0, None, None)], key=repr)


def test_nearest_cells(spark):
    px = spark.createDataFrame([("p", 1, 0.4, 0.0, 1.0), ("p", 2, 0.0, 0.3, 2.0), ("p", 3, 2.0, 2.0, None), ("p", 4, 9.0, 0.0, 5.0), ("p", 5, 1.5, 2.5, 7.0)], "product string, pixel long, x double, y double, value double")
    assert sorted(tuple(r) for r in extent.nearest_cells(px, ["product"], 3, 3).collect()) == [("p", 0, 0, 2.0), ("p", 2, 2, 7.0)]


def test_masks(spark):
    got = spark.createDataFrame([(0.0,), (0.1,), (None,)], "h double").select(hydraulics.at_least(F.col("h"), 0.1).alias("m")).collect()
    assert [r.m for r in got] == [False, True, False]


def test_tank():
    assert zones.step(0.0, 0.5, 0.0, 1.0, 8.0, 0.15, 60.0) == 0.0
    filled = zones.step(0.0, 0.5, 100.0, 10.0, 8.0, 0.15, 60.0)
    assert 0 < filled <= 25.0 and zones.step(filled, 0.0, 100.0, 10.0, 8.0, 0.15, 60.0) < filled
    assert zones.step(799.0, 5.0, 100.0, 1e6, 8.0, 0.15, 60.0) == 800.0


def test_catalogues(spark):
    body = spark.createDataFrame([(1, '[[{"id": "a", "size": 1}, 5], {"id": "b", "size": 2}, null]'), (2, '{"x": 1}'), (3, "oops")], "response int, body string")
    assert sorted(tuple(r) for r in catalog.nested_scenes(body).collect()) == [(1, "a", 1), (1, "b", 2)]
    feed = spark.createDataFrame([(1, '{"feed": {"entry": [{"id": "a", "size": 3}, 7]}}'), (2, "[]")], "response int, body string")
    assert [tuple(r) for r in catalog.listed_entries(feed, "feed.entry").collect()] == [(1, "a", 3)]
    listed = spark.createDataFrame([(1, 5, 2, False, "plain", "23100", "bldg"), (2, 5, 2, True, "first", "23100", "bldg"), (3, 5, 2, True, "last", "23100", "bldg"), (4, 5, 1, False, "a", "23100", "bldg"), (5, 5, 1, False, "b", "23100", "bldg"), (6, 5, 1, True, "no", "1", "bldg")], "pos long, ward long, lod int, texture boolean, url string, city_code string, type_en string")
    assert {(r.ward, r.lod): r.url for r in catalog.tileset_urls(listed).collect()} == {(5, 2): "last", (5, 1): "a"}
