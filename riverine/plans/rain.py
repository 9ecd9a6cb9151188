"""Queries on gauges, series, scenarios, model grids and radar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverine.operators import calibration, radar, rain
from riverine.operators.drainage import scratch
from riverine.plans.testdata import collection, frame

KEYS = ["station", "day"]
QUERIES, ORACLE_SQL, query = collection()

# pieces of SQL that several oracles share
_HYETO = "hy AS (SELECT station, day, CAST((hour - 1) * 3600 AS DOUBLE) AS t_s, coalesce(mm, 0.0) AS mm_h FROM gauge UNION ALL SELECT DISTINCT station, day, 86400.0, 0.0 FROM gauge)"
_SUMMARY = """pk AS (SELECT station, day, max(mm) AS peak FROM gauge GROUP BY station, day),
    sm AS (SELECT g.station, g.day, coalesce(CAST(sum(CAST(round(mm * 10) AS BIGINT)) AS DOUBLE) / 10, 0.0) AS total_mm, coalesce(max(mm), 0.0) AS peak_mmh,
      min(CASE WHEN mm = peak THEN hour END) AS peak_hour, CAST(sum(CASE WHEN mm IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_hours
      FROM gauge g JOIN pk ON g.station = pk.station AND g.day = pk.day GROUP BY g.station, g.day)"""
_SEG = """seg AS (SELECT station, day, lag(t_s) OVER w AS lo, t_s AS hi, lag(mm_h) OVER w AS r0, mm_h AS r1 FROM series WINDOW w AS (PARTITION BY station, day ORDER BY t_s)),
    mo AS (SELECT m.event_id, m.t_s, s.lo, s.hi, s.r0, s.r1, m.station, m.day FROM moments m LEFT JOIN seg s ON s.station = m.station AND s.day = m.day AND m.t_s <= s.hi AND m.t_s > coalesce(s.lo, -1e300)),
    rt AS (SELECT *, CASE WHEN hi IS NULL THEN 0.0 WHEN lo IS NULL THEN r1 ELSE r0 + (r1 - r0) * (t_s - lo) / greatest(hi - lo, 1e-6) END AS rate FROM mo)"""


@query(f"+ {_HYETO}, {_SUMMARY} SELECT s.station, s.day, total_mm, peak_mmh, peak_hour, missing_hours, count(*) AS breakpoints, max(hy.mm_h) AS top_rate, n.events FROM sm s JOIN hy ON hy.station = s.station AND hy.day = s.day JOIN (SELECT station, day, count(*) AS events FROM moments GROUP BY station, day) n ON n.station = s.station AND n.day = s.day GROUP BY ALL", "gauge", "moments")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    gauge = frame(spark, sf, "gauge")
    series = rain.hyetograph(gauge, KEYS).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("breakpoints"), F.max("mm_h").alias("top_rate"))
    events = frame(spark, sf, "moments").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("events"))
    return rain.gauge_summary(gauge, KEYS).join(series, KEYS).join(events, KEYS)


@query(f"+ {_HYETO} SELECT * FROM hy", "gauge")
def win1_hyetograph(spark: SparkSession, sf: str) -> DataFrame:
    return rain.hyetograph(frame(spark, sf, "gauge"), KEYS)


@query(f"+ {_SUMMARY} SELECT * FROM sm", "gauge")
def agg1_gauge_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rain.gauge_summary(frame(spark, sf, "gauge"), KEYS)


@query(f"+ {_SEG} SELECT event_id, round(rate, 6) AS rate FROM rt", "series", "moments")
def jon9_rate_at(spark: SparkSession, sf: str) -> DataFrame:
    return rain.rate_at(frame(spark, sf, "moments"), frame(spark, sf, "series"), KEYS).select("event_id", F.round("rate", 6).alias("rate"))


@query(f"""+ {_SEG} SELECT rt.event_id, round(coalesce(sum(CASE WHEN s.lo IS NULL THEN 0.0 WHEN s.hi <= rt.t_s THEN (s.r0 + s.r1) / 2 * (s.hi - s.lo) / 3600
       WHEN s.lo < rt.t_s THEN (s.r0 + rt.rate) / 2 * (rt.t_s - s.lo) / 3600 ELSE 0.0 END), 0.0), 3) AS fallen_mm FROM rt LEFT JOIN seg s ON s.station = rt.station AND s.day = rt.day GROUP BY rt.event_id""", "series", "moments")
def win3_accumulated(spark: SparkSession, sf: str) -> DataFrame:
    return rain.rate_at(frame(spark, sf, "moments"), frame(spark, sf, "series"), KEYS).select("event_id", F.round("fallen_mm", 3).alias("fallen_mm"))


_WINDOW = "aw AS (SELECT station, day, greatest(min(t_s), min(CASE WHEN mm_h > 1 THEN t_s END) - 3600) AS start_s, least(max(t_s), max(CASE WHEN mm_h > 1 THEN t_s END) + 10800) AS end_s FROM series GROUP BY station, day HAVING count(CASE WHEN mm_h > 1 THEN 1 END) > 0)"


@query(f"+ {_WINDOW} SELECT s.station, s.day, s.t_s - start_s AS t_s, mm_h, end_s FROM series s JOIN aw ON s.station = aw.station AND s.day = aw.day WHERE s.t_s >= start_s", "series")
def win4_active_window(spark: SparkSession, sf: str) -> DataFrame:
    series = frame(spark, sf, "series")
    window = rain.active_window(series, KEYS)
    return rain.rebased(series, window, KEYS).join(window.select(*KEYS, "end_s"), KEYS)


@query("""+ b AS (SELECT station, day, unnest(range(0, 1442)) AS bin FROM (SELECT DISTINCT station, day FROM series)),
    seg AS (SELECT station, day, lag(t_s) OVER w AS lo, t_s AS hi, lag(mm_h) OVER w AS r0, mm_h AS r1 FROM series WINDOW w AS (PARTITION BY station, day ORDER BY t_s))
    SELECT b.station, b.day, b.bin, round(CASE WHEN b.bin = 1441 THEN 0.0 WHEN s.lo IS NULL THEN s.r1 ELSE r0 + (r1 - r0) * (b.bin * 60.0 - lo) / (hi - lo) END, 6) AS rate
    FROM b LEFT JOIN seg s ON s.station = b.station AND s.day = b.day AND b.bin * 60.0 <= s.hi AND b.bin * 60.0 > coalesce(s.lo, -1e300)""", "series")
def win7_uniform_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rain.uniform_bins(frame(spark, sf, "series"), KEYS).withColumn("rate", F.round("rate", 6))


@query("""+ s AS (SELECT *, lead(t_s) OVER (PARTITION BY station, day ORDER BY t_s) AS nx FROM series)
    SELECT m.event_id, coalesce(s.mm_h, 0.0) AS mm_h FROM moments m LEFT JOIN s ON s.station = m.station AND s.day = m.day AND m.t_s >= s.t_s AND (s.nx IS NULL OR m.t_s < s.nx)""", "series", "moments")
def jon11_last_sample(spark: SparkSession, sf: str) -> DataFrame:
    return rain.last_sample(frame(spark, sf, "moments"), frame(spark, sf, "series"), KEYS, "mm_h").select("event_id", "mm_h")


_MODEL_RAIN = "mr AS (SELECT day, CAST(hour * 3600 AS BIGINT) AS t_s, iy * 12 + ix AS cell, mm_h FROM model)"


def _model_rain(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "model").select("day", (F.col("hour") * 3600).cast("bigint").alias("t_s"), (F.col("iy") * 12 + F.col("ix")).alias("cell"), "mm_h")


@query(f"+ {_MODEL_RAIN} SELECT t_s, cell, day, mm_h, CAST(least(greatest(round_even(mm_h / 0.5, 0), 0), 255) AS INTEGER) AS count, CAST(least(greatest(round_even(mm_h / 0.5, 0), 0), 255) AS INTEGER) * CAST(0.5 AS DOUBLE) AS decoded FROM mr", "model")
def snk1_quantised(spark: SparkSession, sf: str) -> DataFrame:
    return rain.quantised(_model_rain(spark, sf))


# exact means: tenths are summed as integers
_MEANS = "fs AS (SELECT day, t_s, round_even(CAST(sum(CAST(round(mm_h * 100) AS BIGINT)) AS DOUBLE) / count(mm_h), 0) / 100 AS mm_h FROM mr GROUP BY day, t_s), fz AS (SELECT * FROM fs UNION ALL SELECT day, max(t_s) + 3600, 0.0 FROM fs GROUP BY day)"


@query(f"+ {_MODEL_RAIN}, {_MEANS} SELECT * FROM fz", "model")
def agg2_frame_series(spark: SparkSession, sf: str) -> DataFrame:
    return rain.frame_series(_model_rain(spark, sf), ["day"], 3600)


@query(f"+ {_MODEL_RAIN}, {_MEANS} SELECT day, round_even(CAST(sum(CAST(round(mm_h * 100) AS BIGINT)) AS DOUBLE) * 3600 / 3600.0 / 100, 1) AS total_mm, max(mm_h) AS peak_mmh FROM fz GROUP BY day", "model")
def agg3_spatial_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rain.spatial_summary(rain.frame_series(_model_rain(spark, sf), ["day"], 3600), ["day"], 3600)


_SCENARIOS = """sc AS (SELECT 'rain_' || strftime(day, '%Y%m%d') || '_' || CASE WHEN station % 4 = 0 THEN CAST(station AS VARCHAR) WHEN station % 4 = 1 THEN 'xrain' WHEN station % 4 = 2 THEN 'msm' ELSE 'other' END || '.json' AS file,
    CASE WHEN station % 4 = 0 THEN 'observed-rain' WHEN station % 4 = 1 THEN 'xrain' WHEN station % 4 = 2 THEN 'msm' ELSE 'other' END AS kind, day AS date, 'S' || CAST(station AS VARCHAR) AS station, total_mm, peak_mmh FROM sm)"""


def _scenarios(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.expr("CASE station % 4 WHEN 0 THEN 'observed-rain' WHEN 1 THEN 'xrain' WHEN 2 THEN 'msm' ELSE 'other' END")
    summary = rain.gauge_summary(frame(spark, sf, "gauge"), KEYS)
    return summary.select(rain.scenario_file(kind, F.col("day"), F.col("station").cast("string")).alias("file"), kind.alias("kind"), F.col("day").alias("date"), F.concat(F.lit("S"), F.col("station").cast("string")).alias("station"), "total_mm", "peak_mmh")


_G = "printf('%g', {0})"


@query(f"""+ {_SUMMARY}, {_SCENARIOS}, l AS (SELECT * FROM (VALUES ('observed-rain', 'AMeDAS実測', NULL), ('xrain', 'XRAINレーダー', '名古屋'), ('msm', 'MSM較正', '名古屋')) v(kind, label, place))
    SELECT file, CASE WHEN place IS NOT NULL THEN place || ' ' || label || ' ' || CAST(date AS VARCHAR) ELSE station || ' ' || CAST(date AS VARCHAR) END AS name,
      '最大 ' || {_G.format('peak_mmh')} || ' mm/h・合計 ' || {_G.format('total_mm')} || ' mm (' || coalesce(label, sc.kind) || ')' AS description FROM sc LEFT JOIN l ON l.kind = sc.kind""", "gauge")
def snk7_scenario_index(spark: SparkSession, sf: str) -> DataFrame:
    return rain.scenario_index(_scenarios(spark, sf))


@query(f"+ {_SUMMARY}, {_SCENARIOS} SELECT file, kind, date, total_mm FROM sc UNION ALL SELECT 'day_' || strftime(day, '%Y%m%d') || '.json', 'model', day, CAST(sum(CAST(round(mm_h * 10) AS BIGINT)) AS DOUBLE) / 10 FROM model GROUP BY day", "gauge", "model")
def set1_all_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    modelled = frame(spark, sf, "model").groupBy("day").agg((F.sum(F.round(F.col("mm_h") * 10).cast("bigint")) / 10.0).alias("total_mm"))
    modelled = modelled.select(F.concat(F.lit("day_"), F.date_format("day", "yyyyMMdd"), F.lit(".json")).alias("file"), F.lit("model").alias("kind"), F.col("day").alias("date"), "total_mm")
    return rain.all_kinds(_scenarios(spark, sf).select("file", "kind", "date", "total_mm"), modelled)


@query(f"""+ {_SUMMARY} SELECT 'rain_' || strftime(s.day, '%Y%m%d') || '_' || CAST(s.station AS VARCHAR) || '.json' AS file, s.station, s.day, total_mm, peak_mmh, n AS points, total AS series_sum
    FROM sm s JOIN (SELECT station, day, count(*) AS n, CAST(round(sum(mm_h) * 10) AS BIGINT) AS total FROM series GROUP BY station, day) x ON x.station = s.station AND x.day = s.day""", "series", "gauge")
def snk6_scenario_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents are written as JSON text and read back with their schema (SRC9)."""
    docs = rain.scenario_documents(frame(spark, sf, "series"), rain.gauge_summary(frame(spark, sf, "gauge"), KEYS), KEYS, F.lit("observed-rain"), F.col("day"), F.col("station").cast("string"))
    schema = "kind STRING, date STRING, series ARRAY<STRUCT<t_s: DOUBLE, mm_h: DOUBLE>>, total_mm DOUBLE, peak_mmh DOUBLE"
    read = docs.withColumn("d", F.from_json("document", schema))
    total = F.aggregate("d.series", F.lit(0.0), lambda s, x: s + x["mm_h"])
    return read.select("file", "station", F.to_date("d.date").alias("day"), "d.total_mm", "d.peak_mmh", F.size("d.series").cast("bigint").alias("points"), F.round(total * 10).cast("bigint").alias("series_sum"))


@query("""SELECT CAST(user_id AS VARCHAR) AS dir, CASE WHEN max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) = 1 THEN CAST('new' AS VARCHAR) ELSE 'old' END AS label FROM events GROUP BY user_id""")
def snk8_replay_upsert(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("dir"), "event_type")
    old = events.select("dir", F.lit("old").alias("label")).distinct()
    return rain.upsert(old, events.where("event_type = 'signup'").select("dir", F.lit("new").alias("label")).distinct(), "dir")


@query("SELECT c.c_custkey AS entry, x.first_order FROM customer c LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_order FROM orders GROUP BY o_custkey) x ON x.o_custkey = c.c_custkey")
def jon23_lookup(spark: SparkSession, sf: str) -> DataFrame:
    left = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("entry"))
    right = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("entry"), "o_orderkey", F.col("o_orderpriority").alias("first_order"))
    return rain.first_match(left, right, "entry", "o_orderkey", "first_order")


@query("""+ ev AS (SELECT DISTINCT 'e' || CAST(user_id AS VARCHAR) AS event, CAST(user_id % 13 AS BIGINT) AS station, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase')
    SELECT ev.event, g.station, g.day, g.hour, g.mm FROM ev LEFT JOIN gauge g ON g.station = ev.station AND g.day = ev.day""", "gauge")
def jon24_event_rows(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'purchase'")
    events = events.select(F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("event"), (F.col("user_id") % 13).alias("station"), F.to_date("ts").alias("day")).distinct()
    rows, unknown = rain.event_rows(events, frame(spark, sf, "gauge"))
    return rows.select("event", "station", "day", "hour", "mm").unionByName(unknown.select("event", F.lit(None).cast("bigint").alias("station"), F.lit(None).cast("date").alias("day"), F.lit(None).cast("int").alias("hour"), F.lit(None).cast("double").alias("mm")))


# model calibration: the gauge is station 3 of each day, and a place inside the model's axes
_OBS = "ob AS (SELECT day, hour, mm FROM gauge WHERE station = 3)"
_FACTORS = f"""{_OBS}, ax AS (SELECT (SELECT arg_min(iy, (abs(lat - 35.17), iy)) FROM model) AS iy, (SELECT arg_min(ix, (abs(lon - 136.41), ix)) FROM model) AS ix),
    fa AS (SELECT m.day, m.hour, coalesce(ob.mm, 0.0) AS observed, x.most, CASE WHEN coalesce(ob.mm, 0.0) <= 0 THEN 0.0 WHEN m.mm_h < 0.1 THEN 1.0 ELSE least(ob.mm / m.mm_h, 150.0) END AS factor
      FROM model m JOIN ax ON m.iy = ax.iy AND m.ix = ax.ix JOIN (SELECT day, hour, max(mm_h) AS most FROM model GROUP BY day, hour) x ON x.day = m.day AND x.hour = m.hour
      LEFT JOIN ob ON ob.day = m.day AND ob.hour = m.hour)"""
_AXES = """tg AS (SELECT s_suppkey AS point, 34.9 + (s_suppkey * 37 % 1000) / 1000.0 AS lat, 135.9 + (s_suppkey * 53 % 1000) / 1000.0 AS lon FROM supplier),
    la AS (SELECT iy, lat AS p, lead(iy) OVER (ORDER BY iy) AS j, lead(lat) OVER (ORDER BY iy) AS q FROM (SELECT DISTINCT iy, lat FROM model)),
    lo AS (SELECT ix, lon AS p, lead(ix) OVER (ORDER BY ix) AS j, lead(lon) OVER (ORDER BY ix) AS q FROM (SELECT DISTINCT ix, lon FROM model)),
    br AS (SELECT tg.point, la.iy AS y0, coalesce(la.j, la.iy) AS y1, CASE WHEN la.q IS NULL THEN 0.0 ELSE least(greatest((tg.lat - la.p) / (la.q - la.p), 0.0), 1.0) END AS wy,
        lo.ix AS x0, coalesce(lo.j, lo.ix) AS x1, CASE WHEN lo.q IS NULL THEN 0.0 ELSE least(greatest((tg.lon - lo.p) / (lo.q - lo.p), 0.0), 1.0) END AS wx
      FROM tg JOIN la ON (tg.lat >= la.p OR la.iy = 0) AND (la.q IS NULL OR tg.lat < la.q) JOIN lo ON (tg.lon >= lo.p OR lo.ix = 0) AND (lo.q IS NULL OR tg.lon < lo.q))"""
_BILINEAR = "({v}00.mm_h * (1 - wy) * (1 - wx) + {v}01.mm_h * (1 - wy) * wx + {v}10.mm_h * wy * (1 - wx) + {v}11.mm_h * wy * wx)"


def _corners(table: str) -> str:
    return " ".join(f"JOIN {table} m{a}{b} ON m{a}{b}.day = k.day AND m{a}{b}.hour = k.hour AND m{a}{b}.iy = br.y{a} AND m{a}{b}.ix = br.x{b}" for a in (0, 1) for b in (0, 1))


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    return s.select(F.col("s_suppkey").alias("point"), F.expr("34.9D + (s_suppkey * 37 % 1000) / 1000D").alias("lat"), F.expr("135.9D + (s_suppkey * 53 % 1000) / 1000D").alias("lon"))


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "gauge").where("station = 3").select("day", "hour", "mm")


@query(f"+ {_FACTORS} SELECT day, hour, observed, most, round(factor, 6) AS factor FROM fa", "gauge", "model")
def jon4_hourly_factors(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.hourly_factors(frame(spark, sf, "model"), _observed(spark, sf), 35.17, 136.41).withColumn("factor", F.round("factor", 6))


@query("SELECT x.iy, y.ix FROM (SELECT arg_min(iy, (abs(lat - 35.17), iy)) AS iy FROM model) x, (SELECT arg_min(ix, (abs(lon - 136.41), ix)) AS ix FROM model) y", "model")
def jon3_nearest_index(spark: SparkSession, sf: str) -> DataFrame:
    model = frame(spark, sf, "model")
    return calibration.nearest_index(model, "iy", "lat", 35.17).crossJoin(calibration.nearest_index(model, "ix", "lon", 136.41))


@query(f"+ {_AXES}, k AS (SELECT DISTINCT day, hour FROM model) SELECT k.day, k.hour, br.point, round(greatest({_BILINEAR.format(v='m')}, 0.0), 6) AS mm_h FROM k CROSS JOIN br {_corners('model')}", "model")
def jon5_resample(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.resample(_targets(spark, sf), scratch(spark)(frame(spark, sf, "model")), ["day", "hour"]).withColumn("mm_h", F.round("mm_h", 6))


@query(f"""+ {_FACTORS}, {_AXES} SELECT k.day, k.hour, br.point, round(CASE WHEN k.factor = 0 THEN 0.0 WHEN k.most < 0.1 THEN k.observed ELSE greatest({_BILINEAR.format(v='m')} * k.factor, 0.0) END, 5) AS mm_h
    FROM fa k CROSS JOIN br {_corners('model')}""", "gauge", "model")
def jon4_calibrated(spark: SparkSession, sf: str) -> DataFrame:
    model = scratch(spark)(frame(spark, sf, "model"))
    gauge_lon = model.withColumn("lon", F.col("lon") + (calibration.GAUGE_LON - 136.41))
    targets = _targets(spark, sf).withColumn("lon", F.col("lon") + (calibration.GAUGE_LON - 136.41))
    return calibration.calibrated(targets, gauge_lon, _observed(spark, sf)).withColumn("mm_h", F.round("mm_h", 5))


@query(f"""+ {_AXES}, ks AS (SELECT DISTINCT day, hour FROM model) SELECT ks.day, ks.hour, tg.point, round(v.value, 6) AS value
    FROM ks CROSS JOIN tg LEFT JOIN (SELECT k.day, k.hour, br.point, {_BILINEAR.format(v='m')} AS value FROM br CROSS JOIN ks k {_corners('model')}) v
    ON v.day = ks.day AND v.hour = ks.hour AND v.point = tg.point AND tg.lat BETWEEN (SELECT min(lat) FROM model) AND (SELECT max(lat) FROM model) AND tg.lon BETWEEN (SELECT min(lon) FROM model) AND (SELECT max(lon) FROM model)""", "model")
def jon6_sample_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    """Every raster of the model."""
    model = scratch(spark)(frame(spark, sf, "model"))
    raster = model.select("day", "hour", "iy", "ix", F.col("lat").alias("y"), F.col("lon").alias("x"), F.col("mm_h").alias("value"))
    targets = _targets(spark, sf).select("point", F.col("lat").alias("y"), F.col("lon").alias("x"))
    return calibration.sample_bilinear(targets, raster, ["day", "hour"]).select("day", "hour", "point", F.round("value", 6).alias("value"))


# radar: meshes from suppliers, pixels from events
_MESH = "ms AS (SELECT s_suppkey AS seq, 5000 + (s_suppkey * 3 % 5) * 100 + 35 + s_suppkey % 3 AS mesh_from FROM supplier), mb AS (SELECT seq, floor(mesh_from / 100) / 1.5 AS lat_min, (floor(mesh_from / 100) + 1) / 1.5 AS lat_max, mesh_from % 100 + 100.0 AS lon_min, mesh_from % 100 + 101.0 AS lon_max FROM ms)"


def _mesh(spark: SparkSession, sf: str) -> DataFrame:
    code = F.expr("5000 + (s_suppkey * 3 % 5) * 100 + 35 + s_suppkey % 3")
    return radar.with_bounds(spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("seq"), code.alias("mesh_from"), code.alias("mesh_to")))


@query(f"+ {_MESH} SELECT seq, round(lat_min, 6) AS lat_min, round(lat_max, 6) AS lat_max, CAST(lon_min AS DOUBLE) AS lon_min, CAST(lon_max AS DOUBLE) AS lon_max FROM mb".replace("+", "WITH", 1))
def sca6_mesh_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return _mesh(spark, sf).select("seq", F.round("lat_min", 6).alias("lat_min"), F.round("lat_max", 6).alias("lat_max"), "lon_min", "lon_max")


@query(f"+ {_MESH} SELECT p.point AS box, mb.seq FROM points p JOIN mb ON lat_min < p.lat + 0.1 AND lat_max > p.lat AND lon_min < p.lon + 0.2 AND lon_max > p.lon", "points")
def jon1_overlapping(spark: SparkSession, sf: str) -> DataFrame:
    boxes = frame(spark, sf, "points").select(F.col("point").alias("box"), F.col("lat").alias("lat_min"), (F.col("lat") + 0.1).alias("lat_max"), F.col("lon").alias("lon_min"), (F.col("lon") + 0.2).alias("lon_max"))
    return radar.overlapping(_mesh(spark, sf), boxes)


_COLOURS = ["99ffff", "66ccff", "2198ff", "0038ff", "faf500", "ff9900", "e72800", "9a0079", "c8c8cb", "000000"]
_PIXELS = "px AS (SELECT CAST(event_id % 4 AS INTEGER) AS slot, CAST(user_id % 100 AS BIGINT) AS seq, CAST(event_id % 8 AS BIGINT) AS row, CAST(floor(event_id / 8) AS BIGINT) % 8 AS col, max(CAST(floor(value) AS BIGINT) % 10) AS k FROM events GROUP BY 1, 2, 3, 4)"
_RATE = "CASE k " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate((3.0, 7.0, 15.0, 25.0, 40.0, 65.0, 90.0, 110.0))) + " WHEN 9 THEN 0.0 END"


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    got = e.groupBy((F.col("event_id") % 4).cast("int").alias("slot"), (F.col("user_id") % 100).alias("seq"), (F.col("event_id") % 8).alias("row"), (F.floor(F.col("event_id") / 8) % 8).alias("col")).agg(F.max(F.floor("value") % 10).alias("k"))
    return radar.rates(got.withColumn("rgb", F.element_at(F.array(*map(F.lit, _COLOURS)), (F.col("k") + 1).cast("int"))))


@query(f"WITH {_PIXELS} SELECT slot, seq, row, col, CAST({_RATE} AS DOUBLE) AS mm_h FROM px")
def src4_pixel_rates(spark: SparkSession, sf: str) -> DataFrame:
    return _pixels(spark, sf).select("slot", "seq", "row", "col", "mm_h")


@query(f"""+ {_MESH}, {_PIXELS}, pl AS (SELECT p.point, mb.seq, CAST(least(greatest(floor((lat_max - p.lat) / (lat_max - lat_min) * 8), 0), 7) AS BIGINT) AS row,
      CAST(least(greatest(floor((p.lon - lon_min) / (lon_max - lon_min) * 8), 0), 7) AS BIGINT) AS col FROM points p JOIN mb ON p.lat BETWEEN lat_min AND lat_max AND p.lon BETWEEN lon_min AND lon_max),
    rk AS (SELECT pl.point, px.slot, CAST({_RATE} AS DOUBLE) AS mm_h, row_number() OVER (PARTITION BY pl.point, px.slot ORDER BY px.seq DESC) AS n FROM pl JOIN px ON px.seq = pl.seq AND px.row = pl.row AND px.col = pl.col)
    SELECT point, slot, mm_h FROM rk WHERE n = 1""", "points")
def jon2_sampled(spark: SparkSession, sf: str) -> DataFrame:
    return radar.sampled(frame(spark, sf, "points"), _mesh(spark, sf), _pixels(spark, sf), 8, 8)


_STAMP = "printf('%02d%02d', CAST(floor(m / 60) AS INTEGER), CAST(m % 60 AS INTEGER))"


@query(f"""WITH av AS (SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS m FROM events), sl AS (SELECT d.day, s.slot FROM (SELECT DISTINCT day FROM av) d, (SELECT unnest(range(0, 1440, 5)) AS slot) s),
    c AS (SELECT sl.day, sl.slot, k.n, sl.slot + k.d AS m FROM sl, (VALUES (0, 0), (1, 1), (2, 2), (3, -1), (4, -2), (5, 3), (6, -3)) k(n, d) WHERE sl.slot + k.d >= 0)
    SELECT c.day, CAST(c.slot AS INTEGER) AS slot, arg_min({_STAMP.replace('m ', 'c.m ')}, c.n) AS stamp FROM c JOIN av ON av.day = c.day AND av.m = c.m GROUP BY c.day, c.slot""")
def jon25_first_stamps(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.to_date("ts").alias("day"), F.date_format("ts", "HHmm").alias("stamp")).distinct()
    slots = e.select("day").distinct().select("day", F.explode(F.sequence(F.lit(0), F.lit(1435), F.lit(5))).alias("slot"))
    return radar.first_stamps(slots, e)
