"""Queries on depth frames, satellite comparison and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverine.functions import hydraulics
from riverine.operators import extent, frames, zones
from riverine.plans.testdata import collection, frame

QUERIES, ORACLE_SQL, query = collection()
DX = 10.0
CELL = ["region", "r", "c"]

_F = "fr AS (SELECT region, frame, t_s, r, c, CAST(h_cm AS DOUBLE) / 1000 AS h, CASE WHEN c = 29 THEN NULL ELSE CAST(qe_cm AS DOUBLE) / 100 END AS qe, CASE WHEN r = 19 THEN NULL ELSE CAST(qs_cm AS DOUBLE) / 100 END AS qs FROM frames)"
_ST = "st AS (SELECT region, frame, t_s, CAST(sum(CAST(round(h * 100) AS BIGINT)) AS DOUBLE) / 100 * 100 AS volume, count(*) FILTER (h > 0.05) * CAST(100 AS DOUBLE) AS a5, count(*) FILTER (h > 0.3) * CAST(100 AS DOUBLE) AS a30, count(*) FILTER (h > 1.0) * CAST(100 AS DOUBLE) AS a100 FROM fr GROUP BY region, frame, t_s)"


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "frames").select(
        "region", "frame", "t_s", "r", "c", (F.col("h_cm") / 1000.0).alias("h"), F.when(F.col("c") != 29, F.col("qe_cm") / 100.0).alias("qe"), F.when(F.col("r") != 19, F.col("qs_cm") / 100.0).alias("qs")
    )


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return frames.statistics(_frames(spark, sf), DX)


@query(f"+ {_F}, {_ST} SELECT * FROM st", "frames")
def agg7_frame_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(spark, sf)


@query(f"+ {_F}, {_ST} SELECT st.region, st.frame, round(a5 / (n * 100.0), 6) AS share FROM st JOIN (SELECT region, count(DISTINCT r * 1000 + c) AS n FROM fr GROUP BY region) x ON x.region = st.region", "frames")
def agg18_flooded_share(spark: SparkSession, sf: str) -> DataFrame:
    cells = _frames(spark, sf).select(*CELL).distinct().groupBy("region").agg(F.count(F.lit(1)).alias("cells"))
    return frames.flooded_share(_stats(spark, sf), cells, DX).withColumn("share", F.round("share", 6))


@query(f"+ {_F} SELECT region, r, c, max(h) AS h_max FROM fr GROUP BY region, r, c", "frames")
def agg19_final_maximum(spark: SparkSession, sf: str) -> DataFrame:
    return frames.final_maximum(_frames(spark, sf))


@query(f"+ {_F} SELECT region, r, c, frame, max(h) OVER (PARTITION BY region, r, c ORDER BY frame ROWS UNBOUNDED PRECEDING) AS h_max FROM fr", "frames")
def win2_running_maximum(spark: SparkSession, sf: str) -> DataFrame:
    return frames.running_maximum(_frames(spark, sf)).select(*CELL, "frame", "h_max")


@query(f"""+ {_F}, w AS (SELECT *, h > 0.05 AS wet, lag(h > 0.05) OVER (PARTITION BY region, r, c ORDER BY frame) AS was FROM fr), o AS (SELECT *, CASE WHEN wet AND NOT coalesce(was, false) THEN t_s END AS onset FROM w)
    SELECT region, r, c, frame, coalesce(t_s - max(onset) OVER (PARTITION BY region, r, c ORDER BY frame ROWS UNBOUNDED PRECEDING), CAST(1e9 AS DOUBLE)) AS age FROM o""", "frames")
def win6_wet_age(spark: SparkSession, sf: str) -> DataFrame:
    return frames.wet_age(_frames(spark, sf))


@query(f"+ {_F}, {_ST} SELECT region, min(t_s) AS first_s FROM st WHERE a5 > 15000 GROUP BY region", "frames")
def win9_first_flooded(spark: SparkSession, sf: str) -> DataFrame:
    return frames.first_flooded(_stats(spark, sf), 15000.0)


_KEY = "kf AS (SELECT region, frame FROM st WHERE frame % 3 = 0 UNION SELECT region, arg_min(frame, (-a5, frame)) FROM st GROUP BY region UNION SELECT region, max(frame) FROM st GROUP BY region)"


@query(f"+ {_F}, {_ST}, {_KEY} SELECT * FROM kf", "frames")
def top1_key_frames(spark: SparkSession, sf: str) -> DataFrame:
    return frames.key_frames(_stats(spark, sf), 3)


@query(f"+ {_F}, {_ST}, {_KEY} SELECT fr.region, count(DISTINCT fr.frame) AS frames, count(*) AS cells, max(h) AS deepest FROM fr JOIN kf ON kf.region = fr.region AND kf.frame = fr.frame GROUP BY fr.region", "frames")
def snk10_export_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return frames.export_set(_frames(spark, sf), _stats(spark, sf), 3)[1]


_AT = "mo AS (SELECT s_suppkey AS point, CAST(s_suppkey % 12 + 1 AS BIGINT) AS region, CAST(s_suppkey * 7 % 500 AS DOUBLE) - 30 AS t_s FROM supplier)"


def _moments(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("point"), (F.col("s_suppkey") % 12 + 1).cast("bigint").alias("region"), (F.col("s_suppkey") * 7 % 500).cast("double").alias("t_s")).withColumn("t_s", F.col("t_s") - 30)


@query(f"+ {_AT} SELECT mo.point, arg_min(x.frame, (abs(x.t_s - mo.t_s), -x.t_s)) AS frame FROM mo JOIN (SELECT DISTINCT region, frame, t_s FROM frames) x ON x.region = mo.region GROUP BY mo.point", "frames")
def jon10_nearest_frame(spark: SparkSession, sf: str) -> DataFrame:
    times = frame(spark, sf, "frames").select("region", "frame", "t_s").distinct()
    return frames.nearest_frame(_moments(spark, sf), times).select("point", "frame")


@query(f"+ {_AT} SELECT mo.point, CAST(least(greatest(floor(t_s / 60), 0), n - 1) AS INTEGER) AS frame FROM mo JOIN (SELECT region, count(DISTINCT frame) AS n FROM frames GROUP BY region) x ON x.region = mo.region", "frames")
def jon12_covering_frame(spark: SparkSession, sf: str) -> DataFrame:
    counts = frame(spark, sf, "frames").select("region", "frame").distinct().groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    return frames.covering_frame(_moments(spark, sf), counts, 60.0).select("point", "frame")


_ENC = f"""{_F}, fe AS (SELECT *, coalesce(qe, lag(qe) OVER (PARTITION BY region, frame, r ORDER BY c), 0.0) AS e, coalesce(qs, lag(qs) OVER (PARTITION BY region, frame, c ORDER BY r), 0.0) AS s FROM fr),
    en AS (SELECT region, frame, r, c, CAST(floor(least(greatest(h * 100, 0), 255)) AS INTEGER) AS red, CAST(floor(least(greatest(e * 100 + 128, 0), 255)) AS INTEGER) AS green, CAST(floor(least(greatest(s * 100 + 128, 0), 255)) AS INTEGER) AS blue FROM fe)"""


@query(f"+ {_ENC} SELECT * FROM en", "frames")
def snk4_encoded(spark: SparkSession, sf: str) -> DataFrame:
    return frames.encoded(_frames(spark, sf))


@query(f"+ {_ENC} SELECT region, frame, r, c, red / CAST(100 AS DOUBLE) AS h, (green - 128) / CAST(100 AS DOUBLE) AS qe, (blue - 128) / CAST(100 AS DOUBLE) AS qs FROM en", "frames")
def src8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    return frames.decoded(frames.encoded(_frames(spark, sf)))


@query(f"""+ {_F}, bk AS (SELECT region, frame, CAST(floor(r / 16.0) AS BIGINT) AS br, CAST(floor(c / 16.0) AS BIGINT) AS bc, count(*) AS cells, avg(h) AS h, avg(coalesce(qe, 0.0)) AS qe, avg(coalesce(qs, 0.0)) AS qs FROM fr GROUP BY 1, 2, 3, 4)
    SELECT bk.region, bk.frame, br, bc, cells, CAST(round(h * cells * 1000) AS BIGINT) AS h, CAST(round(qe * cells * 100) AS BIGINT) AS qe, CAST(round(qs * cells * 100) AS BIGINT) AS qs,
      round(coalesce(max(CASE WHEN h > 0.02 THEN sqrt(qe * qe + qs * qs) / h END) OVER (PARTITION BY bk.region, bk.frame), 0.0), 4) AS speed FROM bk""", "frames")
def agg8_flow_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Means come back as whole sums, which don't depend on the order of addition."""
    blocks = frames.flow_blocks(_frames(spark, sf).fillna(0.0, ["qe", "qs"]))
    speed = frames.largest_speed(blocks).withColumn("speed", F.round("speed", 4))
    sums = [F.round(F.col(x) * F.col("cells") * k).cast("bigint").alias(x) for x, k in (("h", 1000), ("qe", 100), ("qs", 100))]
    return blocks.join(speed, ["region", "frame"]).select("region", "frame", "br", "bc", "cells", *sums, "speed")


@query(f"+ {_F} SELECT region, frame, r, c, round(CASE WHEN h >= 0.02 THEN coalesce(qe, 0.0) / h END, 6) AS vx, h >= 0.1 AS flooded FROM fr", "frames")
def sca13_velocity(spark: SparkSession, sf: str) -> DataFrame:
    """SCA13 and SCA10."""
    f = _frames(spark, sf)
    return f.select("region", "frame", "r", "c", F.round(hydraulics.velocity(F.coalesce("qe", F.lit(0.0)), F.col("h")), 6).alias("vx"), hydraulics.at_least(F.col("h"), 0.1).alias("flooded"))


@query("SELECT CAST(frame AS INTEGER) AS frame, '+' || CAST(CAST(floor(t / 3600) AS INTEGER) AS VARCHAR) || ':' || printf('%02d', CAST(floor((t % 3600) / 60) AS INTEGER)) AS clock FROM (SELECT DISTINCT frame, CAST(frame AS DOUBLE) * 1234 AS t FROM frames)", "frames")
def sca17_clock(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "frames").select("frame").distinct().select("frame", hydraulics.clock(F.col("frame").cast("double") * 1234).alias("clock"))


# satellite pixels on a 20 x 30 grid
_NEAR = """ne AS (SELECT region, CAST(round_even(y, 0) AS BIGINT) AS r, CAST(round_even(x, 0) AS BIGINT) AS c, arg_max(value, pixel) AS value, max(pixel) AS pixel FROM pixels
    WHERE value IS NOT NULL AND round_even(x, 0) BETWEEN 0 AND 29 AND round_even(y, 0) BETWEEN 0 AND 19 GROUP BY 1, 2, 3)"""
_MX = f"{_F}, mx AS (SELECT region, r, c, max(h) AS h_max FROM fr GROUP BY region, r, c)"
_GRID = "gr AS (SELECT region, unnest(range(0, 20)) AS r FROM (SELECT region FROM frames UNION SELECT region FROM pixels)), gc AS (SELECT region, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c FROM gr, (SELECT unnest(range(0, 30)) AS c))"
_BOTH = f"""{_MX}, {_NEAR}, {_GRID}, bo AS (SELECT gc.region, gc.r, gc.c, coalesce(h_max >= 0.1, false) AS m, coalesce(value >= 0.5, false) AS s, value FROM gc
    LEFT JOIN mx ON mx.region = gc.region AND mx.r = gc.r AND mx.c = gc.c LEFT JOIN ne ON ne.region = gc.region AND ne.r = gc.r AND ne.c = gc.c)"""
_CONF = """co AS (SELECT region, count(*) FILTER (m AND s) AS tp, count(*) FILTER (m AND NOT s) AS fp, count(*) FILTER (NOT m AND s) AS fn, count(*) FILTER (NOT m AND NOT s) AS tn,
    count(*) FILTER (m) AS model_cells, count(*) FILTER (s) AS sat_cells FROM bo GROUP BY region)"""
_SCORE = "round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * CAST(tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1"


def _maxima(spark: SparkSession, sf: str) -> DataFrame:
    return frames.final_maximum(_frames(spark, sf))


def _near(spark: SparkSession, sf: str) -> DataFrame:
    return extent.nearest_cells(frame(spark, sf, "pixels"), ["region"], 20, 30)


def _both(spark: SparkSession, sf: str) -> DataFrame:
    return extent.compared(_maxima(spark, sf), _near(spark, sf), ["region"])


def _grids(spark: SparkSession, sf: str) -> DataFrame:
    """Every region's grid of 20 x 30."""
    regions = _frames(spark, sf).select("region").union(frame(spark, sf, "pixels").select("region")).distinct()
    return regions.select("region", F.lit(20).cast("bigint").alias("height"), F.lit(30).cast("bigint").alias("width"))


@query(f"+ {_NEAR} SELECT region, r, c, value FROM ne", "pixels")
def jon7_nearest_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf)


@query(f"+ {_NEAR.replace('value IS NOT NULL AND ', '')} SELECT region, r, c, pixel FROM ne", "pixels")
def jon8_cell_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return extent.cell_pixels(frame(spark, sf, "pixels"), ["region"], 20, 30)


@query(f"+ {_BOTH} SELECT region, r, c, m, s, CASE WHEN m AND s THEN 'both' WHEN s THEN 'satellite' WHEN m THEN 'model' ELSE 'neither' END AS kind FROM bo", "frames", "pixels")
def jon22_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """JON22 and SCA19."""
    return extent.overlay(_both(spark, sf), _grids(spark, sf), ["region"])


@query(f"+ {_BOTH}, {_CONF} SELECT * FROM co", "frames", "pixels")
def agg10_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return extent.confusion(_both(spark, sf), _grids(spark, sf), ["region"])


@query(f"+ {_BOTH}, {_CONF} SELECT *, {_SCORE} FROM co", "frames", "pixels")
def agg11_scores(spark: SparkSession, sf: str) -> DataFrame:
    got = extent.scores(extent.confusion(_both(spark, sf), _grids(spark, sf), ["region"]))
    return got.select("region", "tp", "fp", "fn", "tn", "model_cells", "sat_cells", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query(f"""+ {_BOTH}, sw AS (SELECT region, t AS threshold, count(*) FILTER (m AND coalesce(value >= t, false)) AS tp, count(*) FILTER (m AND NOT coalesce(value >= t, false)) AS fp, count(*) FILTER (NOT m AND coalesce(value >= t, false)) AS fn,
    count(*) FILTER (NOT m AND NOT coalesce(value >= t, false)) AS tn, count(*) FILTER (m) AS model_cells, count(*) FILTER (coalesce(value >= t, false)) AS sat_cells FROM bo, (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS t) GROUP BY region, t)
    SELECT *, {_SCORE} FROM sw""", "frames", "pixels")
def agg12_sweep(spark: SparkSession, sf: str) -> DataFrame:
    got = extent.sweep(_maxima(spark, sf), _near(spark, sf), _grids(spark, sf), ["region"])
    return got.select("region", "threshold", "tp", "fp", "fn", "tn", "model_cells", "sat_cells", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


_IDS = _NEAR.replace("ne AS", "id AS").replace("value IS NOT NULL AND ", "")
_FOOT = f"{_MX}, {_IDS}, ff AS (SELECT id.region, id.pixel, avg(CASE WHEN h_max >= 0.1 THEN 1.0 ELSE 0.0 END) AS fraction FROM id JOIN mx ON mx.region = id.region AND mx.r = id.r AND mx.c = id.c GROUP BY id.region, id.pixel)"


def _fractions(spark: SparkSession, sf: str) -> DataFrame:
    masks = _maxima(spark, sf).select(*CELL, hydraulics.at_least(F.col("h_max"), 0.1).alias("m"))
    return extent.footprint_fractions(masks, extent.cell_pixels(frame(spark, sf, "pixels"), ["region"], 20, 30), CELL, ["region"])


@query(f"+ {_FOOT} SELECT region, pixel, round(fraction, 6) AS fraction FROM ff", "frames", "pixels")
def agg13_footprint_fractions(spark: SparkSession, sf: str) -> DataFrame:
    return _fractions(spark, sf).withColumn("fraction", F.round("fraction", 6))


@query(f"+ {_FOOT} SELECT ff.region, round(corr(fraction, value), 5) AS r, count(*) AS n FROM ff JOIN pixels p ON p.region = ff.region AND p.pixel = ff.pixel GROUP BY ff.region", "frames", "pixels")
def agg14_footprint_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return extent.footprint_correlation(_fractions(spark, sf), frame(spark, sf, "pixels"), ["region"]).withColumn("r", F.round("r", 5))


_DB = "10 * log10(greatest({0}, 1e-9))"


@query(f"""SELECT region, cell, coalesce(pre IS NOT NULL AND post IS NOT NULL AND {_DB.format('post')} - {_DB.format('pre')} <= -3 AND {_DB.format('pre')} >= -25, false) AS darkened,
    coalesce(pre IS NOT NULL AND post IS NOT NULL AND {_DB.format('post')} - {_DB.format('pre')} > 3, false) AS brightened, round({_DB.format('pre')}, 6) AS pre_db FROM backscatter""", "backscatter")
def jon20_change(spark: SparkSession, sf: str) -> DataFrame:
    """JON20 (dates joined by cell), JON21 and SCA9."""
    both = frame(spark, sf, "backscatter")
    pairs = both.select("region", "cell", "pre").join(both.select("region", "cell", "post"), ["region", "cell"])
    got = extent.brightening(extent.change(pairs))
    return got.select("region", "cell", "darkened", "brightened", F.round(F.when(F.col("pre").isNotNull(), hydraulics.decibel(F.col("pre"))), 6).alias("pre_db"))


ORACLE_SQL["jon20_change"] = ORACLE_SQL["jon20_change"].replace("round(10 * log10(greatest(pre, 1e-9)), 6) AS pre_db", "round(CASE WHEN pre IS NOT NULL THEN 10 * log10(greatest(pre, 1e-9)) END, 6) AS pre_db")


@query(f"+ {_F} SELECT DISTINCT frame, region, r, c FROM fr WHERE (region, frame - 1) IN (SELECT (region, frame) FROM fr) AND h >= 0.1 EXCEPT SELECT frame + 1, region, r, c FROM fr WHERE h >= 0.1", "frames")
def set2_new_water(spark: SparkSession, sf: str) -> DataFrame:
    """New water of every frame that follows another of its region."""
    f = _frames(spark, sf)
    follows = f.select("region", (F.col("frame") + 1).alias("frame")).distinct()
    wet = f.where("h >= 0.1")
    return extent.new_water(wet.join(follows, ["region", "frame"]), wet.withColumn("frame", F.col("frame") + 1), ["frame", *CELL])


@query(f"+ {_MX}, {_NEAR} SELECT region, r, c FROM mx WHERE h_max >= 0.1 INTERSECT SELECT region, r, c FROM ne WHERE value >= 0.5", "frames", "pixels")
def set3_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return extent.agreement(_both(spark, sf), ["region"])


@query("SELECT product, region, pixel, CASE WHEN abs(v) > 1e30 THEN NULL ELSE v END AS value FROM (SELECT product, region, pixel, CASE WHEN pixel % 31 = 0 THEN CAST(9.96921e36 AS DOUBLE) ELSE value END AS v FROM pixels)", "pixels")
def src12_fill_values(spark: SparkSession, sf: str) -> DataFrame:
    from riverine.sources.landing import without_fill

    raw = frame(spark, sf, "pixels").withColumn("value", F.when(F.col("pixel") % 31 == 0, F.lit(9.96921e36)).otherwise(F.col("value")))
    return without_fill(raw, "value").select("product", "region", "pixel", "value")


_ZM = "zm AS (SELECT zone, region, frame, t_s, CAST(sum(CAST(round(h * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS mean_h, count(*) AS cells, count(*) * CAST(100 AS DOUBLE) AS area FROM fr JOIN zones ON r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 GROUP BY zone, region, frame, t_s)"


@query(f"+ {_F} SELECT DISTINCT zone, region, r, c FROM fr JOIN zones ON r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1", "frames", "zones")
def jon14_in_zones(spark: SparkSession, sf: str) -> DataFrame:
    return zones.in_zones(_frames(spark, sf), frame(spark, sf, "zones"))


@query(f"+ {_F}, {_ZM} SELECT zone, region, frame, t_s, round(mean_h, 6) AS mean_h, cells, area FROM zm", "frames", "zones")
def agg17_zone_means(spark: SparkSession, sf: str) -> DataFrame:
    return zones.zone_means(_frames(spark, sf), frame(spark, sf, "zones"), DX).withColumn("mean_h", F.round("mean_h", 6))


_FO = f"""{_F}, {_ZM}, sq AS (SELECT zm.*, floor_depth_m, threshold_m, coupling_s, row_number() OVER w AS n, coalesce(t_s - lag(t_s) OVER w, 0.0) AS dt FROM zm JOIN zones USING (zone) WINDOW w AS (PARTITION BY zm.zone, zm.region ORDER BY t_s)),
    fo AS (SELECT zone, region, n, t_s, area, CAST(0 AS DOUBLE) AS volume FROM sq WHERE n = 1 UNION ALL
      SELECT s.zone, s.region, s.n, s.t_s, s.area, least(CASE WHEN s.mean_h > s.threshold_m THEN fo.volume + least(least((s.mean_h - s.threshold_m) / s.coupling_s * s.area * s.dt, greatest(0.0, (s.floor_depth_m - fo.volume / s.area) * s.area)), s.mean_h * s.area * 0.5)
        WHEN fo.volume / s.area > 0 AND s.mean_h < s.threshold_m THEN fo.volume - least(fo.volume / s.area / s.coupling_s * s.area * s.dt, fo.volume) ELSE fo.volume END, s.floor_depth_m * s.area)
      FROM fo JOIN sq s ON s.zone = fo.zone AND s.region = fo.region AND s.n = fo.n + 1)
"""


@query(f"""+ {_FO} SELECT zone, region, t_s, round(volume, 4) AS volume, round(volume / area, 6) AS depth FROM fo""", "frames", "zones")
def str4_zone_storage(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of STR4."""
    z = frame(spark, sf, "zones")
    got = zones.storage(zones.zone_means(_frames(spark, sf), z, DX), z)
    return got.select("zone", "region", "t_s", F.round("volume", 4).alias("volume"), F.round("depth", 6).alias("depth"))


ORACLE_SQL["str4_zone_storage"] = ORACLE_SQL["str4_zone_storage"].replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"+ {_F} SELECT zone, region, frame, round(mean_h / 2, 6) AS depth, cells FROM (SELECT zone, region, frame, CAST(sum(CAST(round(h * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS mean_h, count(*) AS cells FROM fr JOIN zones ON r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 GROUP BY zone, region, frame)", "frames", "zones")
def agg17_depth_map(spark: SparkSession, sf: str) -> DataFrame:
    """Half the mean depth as a tank's volume, spread over the zone's cells."""
    z, f = frame(spark, sf, "zones"), _frames(spark, sf)
    means = zones.zone_means(f, z, DX).select("zone", "region", "frame", "t_s", (F.col("mean_h") / 2).alias("depth"), "cells")
    cells = zones.hits(f, z).select("zone", "region", "frame", "r", "c")
    spread = cells.join(means, ["zone", "region", "frame"]).groupBy("zone", "region", "frame").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("cells"))
    return spread.withColumn("depth", F.round("depth", 6))


@query(f"""+ {_FO}, hit AS (SELECT DISTINCT zone, region, r, c FROM fr JOIN zones ON r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1)
    SELECT hit.region, hit.r, hit.c, fo.t_s, round(arg_max(fo.volume / fo.area, fo.zone), 6) AS depth FROM hit JOIN fo ON fo.zone = hit.zone AND fo.region = hit.region GROUP BY hit.region, hit.r, hit.c, fo.t_s""", "frames", "zones")
def agg17_depth_cells(spark: SparkSession, sf: str) -> DataFrame:
    z, f = frame(spark, sf, "zones"), _frames(spark, sf)
    return zones.depth_map(zones.storage(zones.zone_means(f, z, DX), z), zones.in_zones(f, z)).withColumn("depth", F.round("depth", 6))


ORACLE_SQL["agg17_depth_cells"] = ORACLE_SQL["agg17_depth_cells"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("""+ b AS (SELECT n_nationkey AS zone, 136.9 + n_regionkey / 3000.0 AS x0, 136.9 + n_regionkey / 3000.0 + 0.0009 AS x1, 35.17 - n_nationkey / 9000.0 - 0.0007 AS y0, 35.17 - n_nationkey / 9000.0 AS y1 FROM nation)
    SELECT CAST(zone AS BIGINT) AS zone, r, c FROM cells JOIN b ON 136.9 + c * 5.0 / (111320.0 * cos(radians(35.17))) BETWEEN x0 AND x1 AND 35.17 - r * 5.0 / 111320.0 BETWEEN y0 AND y1""".replace("136.9", "CAST(136.9 AS DOUBLE)").replace("35.17", "CAST(35.17 AS DOUBLE)").replace("3000.0", "CAST(3000 AS DOUBLE)").replace("9000.0", "CAST(9000 AS DOUBLE)").replace("111320.0", "CAST(111320 AS DOUBLE)"), "cells")
def jon14_in_polygons(spark: SparkSession, sf: str) -> DataFrame:
    x, y = 136.9 + F.col("n_regionkey") / 3000.0, 35.17 - F.col("n_nationkey") / 9000.0
    corner = lambda a, b: F.struct(a.alias("lon"), b.alias("lat"))
    ring = F.array(corner(x, y), corner(x + 0.0009, y), corner(x + 0.0009, y - 0.0007), corner(x, y - 0.0007))
    wanted = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("zone"), ring.alias("polygon"))
    return zones.in_polygons(frame(spark, sf, "cells"), wanted, 136.9, 35.17, 5.0)
