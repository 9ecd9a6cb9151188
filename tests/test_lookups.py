"""Range and as-of look-ups against plain loops, and plans without nested loops."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from riverine.operators import catalog, frames, lookups, radar, rain, zones

NESTED = ("BroadcastNestedLoopJoin", "CartesianProduct")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bucket", [1.0, 10.0, 1e6])
def test_last_before(spark, bucket):
    rng = random.Random(bucket)
    samples = [(k, float(t), rng.choice([None, 1.5, 2.5])) for k in ("a", "b") for t in rng.sample(range(-50, 200), 20)] + [("a", None, 9.0)]
    at = [(k, rng.choice([float(rng.randint(-80, 260)), rng.random() * 200]), i) for i in range(150) for k in ("a", "b", "none", None)]
    got = lookups.last_before(spark.createDataFrame(at, "k string, t_s double, i int"), spark.createDataFrame(samples, "k string, t_s double, v double"), ["k"], ["v"], bucket=bucket)
    rows = got.collect()
    assert len(rows) == len(at)
    for r in rows:
        own = sorted((t, v) for k, t, v in samples if k == r.k and t is not None and t <= r.t_s)
        assert (r["__last"] is None) == (not own) and (not own or r["__last"].v == own[-1][1])
    assert not any(n in plan(got) for n in NESTED)


def test_between_points(spark):
    rng = random.Random(1)
    for n in (1, 2, 3, 8, 9, 40):
        points = sorted((float(t), float(rng.randint(0, 9))) for t in rng.sample(range(100), n))
        asked = [-1.0, 101.0, *[t for t, _ in points], *[rng.random() * 100 for _ in range(20)]]
        df = spark.createDataFrame([(q, [{"t": t, "v": v} for t, v in points]) for q in asked], "q double, p array<struct<t:double,v:double>>")
        for r in df.select("q", lookups.between_points(F.col("p"), F.col("q")).alias("x")).collect():
            i = bisect.bisect_left([t for t, _ in points], r.q)
            if i == 0:
                want = points[0][1]
            elif i == n:
                want = 0.0
            else:
                (a, u), (b, v) = points[i - 1], points[i]
                want = u + (v - u) * (r.q - a) / (b - a)
            assert abs(r.x - want) < 1e-9
    assert spark.sql("SELECT cast(NULL AS array<struct<t:double,v:double>>) AS p").select(lookups.between_points(F.col("p"), F.lit(1.0)).alias("x")).first().x == 0.0


@pytest.mark.parametrize("cell", [0.003, 0.05, 7.0])
def test_nearest_ward_with_ties(spark, cell):
    """Whole thousandths, so that many gaps are equal; some points lie far from all centres."""
    rng = random.Random(2)
    wards = [(i, rng.randint(0, 60) / 1000 + 136, rng.randint(0, 60) / 1000 + 35) for i in range(40)]
    points = [(i, rng.randint(-300, 300) / 1000 + 136, rng.randint(-40, 90) / 1000 + 35) for i in range(200)] + [(900, None, 35.0), (901, 170.0, -20.0)]
    w, p = spark.createDataFrame(wards, "ward long, lon double, lat double"), spark.createDataFrame(points, "point long, lon double, lat double")
    whole = lambda v: round(v * 1_000_000)
    want = {i: min(((whole(x) - whole(a)) ** 2 + (whole(y) - whole(b)) ** 2, k) for k, a, b in wards)[1] for i, x, y in points if x is not None}
    got = catalog.nearest_ward(p, w, cell)
    assert {r.point: r.ward for r in got.collect()} == want and got.count() == len(want)
    assert not any(n in plan(got) for n in NESTED)
    assert catalog.nearest_ward(p.limit(0), w).collect() == [] and catalog.nearest_ward(p, w.limit(0)).collect() == []


def test_wards_near(spark):
    rng = random.Random(3)
    wards = [(i, rng.randint(0, 900) / 1000, rng.randint(0, 900) / 1000) for i in range(60)]
    boxes = [(i, x, y, x + 0.05, y + 0.02) for i, (x, y) in enumerate((rng.randint(-400, 1300) / 1000, rng.randint(0, 900) / 1000) for _ in range(50))]
    got = catalog.wards_near(spark.createDataFrame(boxes, "box long, west double, south double, east double, north double"), spark.createDataFrame(wards, "ward long, lon double, lat double"))
    m = lambda v: round(v * 1_000_000)
    want = set()
    for b, west, south, east, north in boxes:
        gap = lambda lo, v, hi: max(m(lo) - m(v), 0, m(v) - m(hi))
        near = {k for k, x, y in wards if gap(west, x, east) ** 2 + gap(south, y, north) ** 2 <= 80_000**2}
        cx, cy = (m(west) + m(east)) // 2, (m(south) + m(north)) // 2
        want |= {(b, k) for k in near or {min(((m(x) - cx) ** 2 + (m(y) - cy) ** 2, k) for k, x, y in wards)[1]}}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert not any(n in plan(got) for n in NESTED)


def joined_rows(spark, after=-1, kind="Join"):
    """Rows that joins, or other nodes, gave out in the executions after one, and the number of the last one."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, total, last = spark._jsparkSession.sharedState().statusStore(), 0, after
    every = store.executionsList()
    for i in range(every.size()):
        number = every.apply(i).executionId()
        last = max(last, number)
        if number <= after:
            continue
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            for m in range(node.metrics().size()):
                metric = node.metrics().apply(m)
                if kind in node.name() and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total, last


def spread(df):
    """Rows of each task."""
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def recorded(monkeypatch, module):
    """Numbers of rows that a module's scratch writes."""
    rows, original = [], module.scratch

    def noting(session):
        write = original(session)

        def noted(df):
            kept = write(df)
            rows.append(kept.count())
            return kept

        return noted

    monkeypatch.setattr(module, "scratch", noting)
    return rows


def test_nearest_ward_meets_few(spark):
    """Places among the centres, far from all of them, and a crowd of centres within one cell of the first grid."""
    rng = random.Random(6)
    wards = [(i, 136 + rng.randint(0, 4000) / 1e6, 35 + rng.randint(0, 4000) / 1e6) for i in range(3000)] + [(5000, 137.5, 36.0)]
    points = [(i, 136 + rng.randint(0, 4000) / 1e6, 35 + rng.randint(0, 4000) / 1e6) for i in range(100)] + [(i, 134.5 + rng.randint(0, 9) / 1000, 35 + rng.randint(0, 9) / 1000) for i in range(100, 200)]
    w, p = spark.createDataFrame(wards, "ward long, lon double, lat double"), spark.createDataFrame(points, "point long, lon double, lat double")
    m = lambda v: round(v * 1_000_000)
    want = {i: min(((m(x) - m(a)) ** 2 + (m(y) - m(b)) ** 2, k) for k, a, b in wards)[1] for i, x, y in points}
    before = joined_rows(spark)[1]
    assert {r.point: r.ward for r in catalog.nearest_ward(p, w).collect()} == want
    met = joined_rows(spark, before)[0]
    assert 0 < met < len(points) * len(wards) / 5


def test_near_pairs_are_not_stored(spark, monkeypatch):
    """Equal boxes and equal centres meet once, and what is written by the way is no longer than the tables."""
    boxes = [(i, x, 0.0, x + 0.02, 0.02) for i, x in enumerate(k % 7 / 1000 for k in range(210))]
    wards = [(i, i % 11 / 1000, 0.01) for i in range(330)]
    rows, before = recorded(monkeypatch, catalog), joined_rows(spark)[1]
    got = catalog.wards_near(spark.createDataFrame(boxes, "box long, west double, south double, east double, north double"), spark.createDataFrame(wards, "ward long, lon double, lat double"))
    assert got.distinct().count() == got.count() == 210 * 330
    assert max(rows) <= 330 and joined_rows(spark, before)[0] < 210 * 330 / 10


@pytest.mark.parametrize("most", [0, lookups.BROADCAST_BYTES])
def test_wards_near_in_even_tasks(spark, monkeypatch, most):
    """Few cells, so that tasks by cell would be uneven; of equal boxes few are written out from one row."""
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", most)
    boxes = [(i, x, 0.0, x + 0.001, 0.001) for i, x in enumerate(k % 900 / 1e5 + 0.02 for k in range(1800))] + [(i, 0.05, 0.01, 0.051, 0.011) for i in range(2000, 2400)]
    wards = [(i, 0.03, 0.04) for i in range(40)] + [(99, 5.0, 5.0)]
    b, w = spark.createDataFrame(boxes, "box long, west double, south double, east double, north double"), spark.createDataFrame(wards, "ward long, lon double, lat double")
    before, got = joined_rows(spark)[1], catalog.wards_near(b, w)
    built = joined_rows(spark, before)[1]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == [(x[0], k) for x in boxes for k in range(40)] and not any(n in plan(got) for n in NESTED)
    assert joined_rows(spark, built)[0] == 900 + 400 / lookups.FEW
    if most:
        counts = spread(got)
        assert len(counts) == lookups.tasks(b) and counts[-1] < 2 * sum(counts) / len(counts)


def test_picks_near_is_meeting_picks_of_wards_near(spark, monkeypatch):
    rng = random.Random(7)
    wards = []
    for i in range(80):
        x, y = rng.randint(0, 300) / 1000, rng.randint(0, 90) / 1000
        wards.append((i, x, y, *((None,) * 4 if i % 9 == 0 and x < 0.2 else (x, y, x + 0.01, y + 0.01))))
    boxes = [(i, x, y, x + 0.02, y + 0.02) for i, (x, y) in enumerate((rng.choice([-1.0, 0.0, 0.11, 0.25]) + rng.randint(0, 5) / 100, rng.randint(0, 9) / 100) for _ in range(60))]
    b = spark.createDataFrame(boxes, "box long, west double, south double, east double, north double")
    w = spark.createDataFrame(wards, "ward long, lon double, lat double, west double, south double, east double, north double")
    want = catalog.meeting_picks(catalog.wards_near(b, w).join(w.drop("lon", "lat"), "ward"), b)
    rows = recorded(monkeypatch, catalog)
    got = catalog.picks_near(b, w)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and max(rows) < catalog.wards_near(b, w).count()


def test_boxes_meet_once(spark):
    rng = random.Random(4)
    made = lambda n, k: [(i, y, y + rng.random(), x, x + rng.random()) for i, (x, y) in enumerate((rng.random() * k, rng.random() * k) for _ in range(n))]
    names = "lat_min double, lat_max double, lon_min double, lon_max double"
    tiles, boxes = made(40, 3), made(30, 3) + [(99, 0.0, 1.0, 1.0, 2.0)]
    tiles.append((99, 1.0, 2.0, 1.0, 2.0))  # touches box 99 and doesn't meet it
    got = radar.overlapping(spark.createDataFrame(tiles, f"seq int, {names}"), spark.createDataFrame(boxes, f"box int, {names}"))
    want = {(b[0], t[0]) for b in boxes for t in tiles if t[1] < b[2] and t[2] > b[1] and t[3] < b[4] and t[4] > b[3]}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and (99, 99) not in want
    assert not any(n in plan(got) for n in NESTED)


def test_equal_tiles_and_boxes_meet_once(spark):
    names = "lat_min double, lat_max double, lon_min double, lon_max double"
    tiles = spark.createDataFrame([(i, i % 3 / 1.5, (i % 3 + 1) / 1.5, 0.0, 1.0) for i in range(300)], f"seq int, {names}")
    boxes = spark.createDataFrame([(i, i % 7 / 10, i % 7 / 10 + 0.1, 0.5, 0.7) for i in range(140)], f"box int, {names}")
    before, got = joined_rows(spark)[1], radar.overlapping(tiles, boxes)
    rows = [tuple(r) for r in got.collect()]
    want = [(b, t) for b in range(140) for t in range(300) if t % 3 / 1.5 < b % 7 / 10 + 0.1 and (t % 3 + 1) / 1.5 > b % 7 / 10]
    assert sorted(rows) == sorted(want) and 0 < joined_rows(spark, before)[0] < len(want) / 10


@pytest.mark.parametrize("most", [0, lookups.BROADCAST_BYTES])
def test_overlapping_in_even_tasks(spark, monkeypatch, most):
    """Few cells and bounds, so that tasks by cell would be uneven; of equal boxes few are written out from one row."""
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", most)
    names = "lat_min double, lat_max double, lon_min double, lon_max double"
    tiles = spark.createDataFrame([(i, 0.1, 0.9, 0.1, 0.9) for i in range(50)] + [(i, 1.1, 1.9, 0.1, 0.9) for i in range(50, 90)], f"seq int, {names}")
    boxes = spark.createDataFrame([(i, 0.2 + i % 900 / 2000, 0.3 + i % 900 / 2000, 0.2, 0.3) for i in range(1800)] + [(i, 1.5, 1.6, 0.5, 0.6) for i in range(2000, 2400)], f"box int, {names}")
    before, got = joined_rows(spark)[1], radar.overlapping(tiles, boxes)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == [(b, t) for b in range(1800) for t in range(50)] + [(b, t) for b in range(2000, 2400) for t in range(50, 90)]
    assert joined_rows(spark, before)[0] == 900 + 400 / lookups.FEW and not any(n in plan(got) for n in NESTED)
    if most:
        counts = spread(got)
        assert len(counts) == lookups.tasks(boxes) and counts[-1] < 2 * sum(counts) / len(counts)


def test_points_meet_different_bounds(spark):
    """Many tiles of equal bounds, few of which have pixels; of these the last counts, slot by slot."""
    names = "lat_min double, lat_max double, lon_min double, lon_max double"
    tiles = spark.createDataFrame([(i, float(i % 2), i % 2 + 1.0, 0.0, 1.0) for i in range(400)], f"seq int, {names}")
    points = spark.createDataFrame([(i, i % 9 / 4, i % 5 / 4) for i in range(90)], "point int, lat double, lon double")
    rng = random.Random(8)
    pixels = [(s, i, r, c, rng.choice([None, 1.0, 2.0, 3.0])) for s in (0, 1) for i in range(40) for r in (0, 1) for c in (0, 1) if rng.random() < 0.4]
    want = {}
    for s, i, r, c, mm in pixels:
        for p in range(90):
            y, x, low = p % 9 / 4, p % 5 / 4, i % 2
            if low <= y <= low + 1 and 0 <= x <= 1 and (min(max(int((low + 1 - y) * 2), 0), 1), min(max(int(x * 2), 0), 1)) == (r, c):
                want[p, s] = max(want.get((p, s), (-1, None)), (i, mm), key=lambda v: v[0])
    before = joined_rows(spark)[1]
    got = radar.sampled(points, tiles, spark.createDataFrame(pixels, "slot int, seq int, row bigint, col bigint, mm_h double"), 2, 2).collect()
    assert {(r.point, r.slot): r.mm_h for r in got} == {k: mm for k, (_, mm) in want.items()} and len(got) == len(want)
    assert 0 < joined_rows(spark, before)[0] < 90 * 400 / 10


def test_plans_without_nested_loops(spark):
    cells = spark.range(100).selectExpr("1L AS region", "0 AS frame", "0D AS t_s", "id AS r", "id AS c", "1D AS h")
    zone = spark.createDataFrame([(1, 5, 40, 3, 20)], "zone long, r0 long, r1 long, c0 long, c1 long")
    assert zones.in_zones(cells, zone).count() == 16
    at, times = spark.createDataFrame([("x", 1.0)], "region string, t_s double"), spark.createDataFrame([("x", 1, 0.0), ("x", 2, 2.0)], "region string, frame int, t_s double")
    assert frames.nearest_frame(at, times).first().frame == 2
    samples = spark.createDataFrame([("x", 0.0, 4.0)], "region string, t_s double, mm double")
    for df in (zones.in_zones(cells, zone), zones.zone_means(cells, zone, 1.0), frames.nearest_frame(at, times), rain.last_sample(at, samples, ["region"], "mm")):
        assert not any(n in plan(df) for n in NESTED)


def test_tank_never_beyond_its_bounds():
    rng = random.Random(5)
    for _ in range(500):
        volume, h, area, dt = rng.uniform(0, 400), rng.choice([0.0, 0.2, rng.uniform(0, 3)]), rng.choice([0.0, 50.0]), rng.choice([0.0, 5.0, 500.0])
        got = zones.step(volume, h, area, dt, 6.0, 0.2, 60.0)
        if area == 0:
            assert got == volume
            continue
        assert got <= 300.0
        if h > 0.2:
            assert min(volume, 300.0) <= got <= max(min(volume, 300.0), min(300.0, volume + 0.5 * h * area)) + 1e-9
        elif h < 0.2:
            assert 0 <= got <= volume
        else:
            assert got == min(volume, 300.0)
