"""Queries on elevation, buildings and drainage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverine.functions import hydraulics
from riverine.operators import drainage, raster, voids
from riverine.plans.testdata import collection, frame

QUERIES, ORACLE_SQL, query = collection()
DX = 5.0

_TERRAIN = "te AS (SELECT c.r, c.c, elev, coalesce(height_cm, 0) AS height_cm, elev IS NULL AND (c.r < 3 OR c.c < 2) AS sea FROM cells c LEFT JOIN heights h ON h.r = c.r AND h.c = c.c)"


def _terrain(spark: SparkSession, sf: str) -> DataFrame:
    got = frame(spark, sf, "cells").join(frame(spark, sf, "heights"), ["r", "c"], "left")
    return got.select("r", "c", "elev", F.coalesce("height_cm", F.lit(0).cast("bigint")).alias("height_cm"), F.expr("elev IS NULL AND (r < 3 OR c < 2)").alias("sea"))


def _block(k: int) -> str:
    return f"(SELECT *, CAST(floor(r / {k}.0) AS BIGINT) AS br, CAST(floor(c / {k}.0) AS BIGINT) AS bc FROM te WHERE floor(r / {k}.0) < (SELECT floor((max(r) + 1) / {k}.0) FROM te) AND floor(c / {k}.0) < (SELECT floor((max(c) + 1) / {k}.0) FROM te))"


@query(f"+ {_TERRAIN} SELECT br, bc, round(avg(elev), 6) AS elev FROM {_block(2)} GROUP BY br, bc", "cells", "heights")
def agg4_pooled(spark: SparkSession, sf: str) -> DataFrame:
    return raster.pooled(_terrain(spark, sf), 2, "elev").withColumn("elev", F.round("elev", 6))


@query(f"""+ {_TERRAIN} SELECT br, bc, round(coalesce(avg(elev), 0.0), 6) AS elev, avg(CASE WHEN sea THEN 1.0 ELSE 0.0 END) > 0.5 AS sea,
    CAST(CASE WHEN avg(CASE WHEN sea THEN 1.0 ELSE 0.0 END) > 0.5 THEN 0 ELSE least(greatest(max(height_cm), 0), 25000) END AS BIGINT) AS height_cm FROM {_block(4)} GROUP BY br, bc""", "cells", "heights")
def agg5_overview(spark: SparkSession, sf: str) -> DataFrame:
    return raster.overview(_terrain(spark, sf)).withColumn("elev", F.round("elev", 6))


@query(f"""+ {_TERRAIN} SELECT br, bc, round(avg(coalesce(elev, 0.0)), 6) AS elev, count(*) FILTER (height_cm > 0) / 4.0 >= 0.75 AS wall,
    round(CASE WHEN count(*) FILTER (height_cm > 0) = 0 THEN 0.0 ELSE CAST(sum(height_cm) AS DOUBLE) / count(*) FILTER (height_cm > 0) END, 6) AS mean_cm FROM {_block(2)} GROUP BY br, bc""", "cells", "heights")
def agg6_region_grid(spark: SparkSession, sf: str) -> DataFrame:
    return raster.region_grid(_terrain(spark, sf)).withColumn("elev", F.round("elev", 6)).withColumn("mean_cm", F.round("mean_cm", 6))


@query(f"""+ {_TERRAIN} SELECT round(count(*) FILTER (elev > 0.5) * 15.358561 / 1e6, 6) AS land_km2, round(count(*) FILTER (height_cm > 0) * 15.358561 / 1e6, 6) AS built_km2,
    round(count(*) FILTER (elev IS NULL) / CAST(count(*) AS DOUBLE), 6) AS void_share, count(*) FILTER (elev IS NULL) AS voids FROM te""", "cells", "heights")
def agg15_coverage(spark: SparkSession, sf: str) -> DataFrame:
    got = raster.coverage(_terrain(spark, sf), 15.358561)
    return got.select(*[F.round(c, 6).alias(c) for c in ("land_km2", "built_km2", "void_share")], "voids")


@query("SELECT CASE WHEN c_acctbal < 0 THEN 'missing' WHEN c_nationkey % 2 = 0 THEN 'cached' ELSE 'ok' END AS status, count(*) AS n FROM customer GROUP BY 1")
def agg16_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    tiles = spark.read.parquet(f"{sf}/customer.parquet").select(F.expr("CASE WHEN c_acctbal < 0 THEN 'missing' WHEN c_nationkey % 2 = 0 THEN 'cached' ELSE 'ok' END").alias("status"))
    return raster.status_counts(tiles)


@query(f"+ {_TERRAIN} SELECT r, c, coalesce(elev < 5 AND (r < 1 OR r >= (SELECT max(r) FROM te) OR c < 1 OR c >= (SELECT max(c) FROM te)), false) AS coastal, least(greatest(elev, -3.0), 3000.0) AS clipped FROM te", "cells", "heights")
def sca14_coastal(spark: SparkSession, sf: str) -> DataFrame:
    return raster.coastal(_terrain(spark, sf)).select("r", "c", "coastal", raster.clipped(F.col("elev")).alias("clipped"))


@query(f"""+ {_TERRAIN}, cm AS (SELECT r, c, CAST(least(greatest(round_even(elev * 100, 0), 0), 16777215) AS BIGINT) AS v, CAST(floor(least(greatest(elev * 100, 0), 16777215)) AS BIGINT) AS d FROM te WHERE elev IS NOT NULL)
    SELECT r, c, CAST((v >> 16) & 255 AS INTEGER) AS r8, CAST((v >> 8) & 255 AS INTEGER) AS g8, CAST(v & 255 AS INTEGER) AS b8, CAST(d & 255 AS INTEGER) AS low FROM cm""", "cells", "heights")
def snk2_elevation_bytes(spark: SparkSession, sf: str) -> DataFrame:
    cells = _terrain(spark, sf).where("elev IS NOT NULL").select("r", "c", hydraulics.elevation_bytes(F.col("elev")).alias("x"), hydraulics.elevation_bytes(F.col("elev"), down=True).alias("y"))
    return cells.select("r", "c", F.col("x.r").alias("r8"), F.col("x.g").alias("g8"), F.col("x.b").alias("b8"), F.col("y.b").alias("low"))


@query(f"+ {_TERRAIN} SELECT r, c, CAST((least(height_cm * 20, 25000) >> 8) & 255 AS INTEGER) AS r8, CAST(least(height_cm * 20, 25000) & 255 AS INTEGER) AS g8 FROM te", "cells", "heights")
def snk3_height_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return _terrain(spark, sf).select("r", "c", hydraulics.height_bytes(F.col("height_cm") * 20).alias("x")).select("r", "c", F.col("x.r").alias("r8"), F.col("x.g").alias("g8"))


_RECTS = f"""{_TERRAIN}, g1 AS (SELECT *, r - row_number() OVER (PARTITION BY c, height_cm ORDER BY r) AS g FROM te WHERE height_cm > 0), g2 AS (SELECT c, height_cm, min(r) AS r, count(*) AS h FROM g1 GROUP BY c, height_cm, g),
    g3 AS (SELECT *, c - row_number() OVER (PARTITION BY r, h, height_cm ORDER BY c) AS k FROM g2), rects AS (SELECT r, min(c) AS c, count(*) AS w, h, height_cm, count(*) * h AS area FROM g3 GROUP BY r, h, height_cm, k HAVING count(*) >= {{0}} AND h >= {{0}})"""


@query(f"+ {_RECTS.format(2)} SELECT * FROM rects", "cells", "heights")
def win5_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    return raster.rectangles(_terrain(spark, sf))


@query(f"+ {_RECTS.format(1)} SELECT * FROM rects ORDER BY area DESC, r, c LIMIT 50", "cells", "heights")
def top2_largest(spark: SparkSession, sf: str) -> DataFrame:
    return raster.largest(raster.rectangles(_terrain(spark, sf), 1), 50)


@query(f"""+ {_RECTS.format(1)}, mx AS (SELECT max(r) AS mr, max(c) AS mc FROM te), sp AS (
      SELECT r, c, height_cm, r AS y, c AS x FROM rects UNION ALL SELECT r, c, height_cm, r, least(c + w, mc) FROM rects, mx UNION ALL SELECT r, c, height_cm, least(r + h, mr), c FROM rects, mx
      UNION ALL SELECT r, c, height_cm, least(r + h, mr), least(c + w, mc) FROM rects, mx UNION ALL SELECT r, c, height_cm, least(floor(r + h / 2.0 + 0.5), mr), least(floor(c + w / 2.0 + 0.5), mc) FROM rects, mx)
    SELECT sp.r, sp.c, round(min(coalesce(te.elev, 0.0)) - 0.6, 6) AS base_m, round(avg(coalesce(te.elev, 0.0)) + any_value(sp.height_cm) / 100.0, 6) AS top_m FROM sp LEFT JOIN te ON te.r = sp.y AND te.c = sp.x GROUP BY sp.r, sp.c, sp.height_cm""", "cells", "heights")
def jon26_box_ground(spark: SparkSession, sf: str) -> DataFrame:
    cells = _terrain(spark, sf)
    return raster.box_ground(raster.rectangles(cells, 1), cells).select("r", "c", F.round("base_m", 6).alias("base_m"), F.round("top_m", 6).alias("top_m"))


@query("""+ bx AS (SELECT s_suppkey AS box, CAST((s_suppkey * 7) % 40 AS BIGINT) AS l, CAST((s_suppkey * 11) % 30 AS BIGINT) AS t FROM supplier)
    SELECT bx.box, cells.r - bx.t AS r, cells.c - bx.l AS c, cells.elev FROM bx JOIN cells ON cells.c >= bx.l AND cells.c < bx.l + 9 AND cells.r >= bx.t AND cells.r < bx.t + 13""", "cells")
def jon13_crop(spark: SparkSession, sf: str) -> DataFrame:
    cells = frame(spark, sf, "cells").withColumn("tile_r", F.floor(F.col("r") / 8)).withColumn("tile_c", F.floor(F.col("c") / 8))
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("box"), ((F.col("s_suppkey") * 7) % 40).alias("left"), ((F.col("s_suppkey") * 11) % 30).alias("top"))
    return raster.crop(cells, s.withColumn("right", F.col("left") + 9).withColumn("bottom", F.col("top") + 13), 8)


# drainage: elevations in tenths of a metre, voids as they are
_Z = "z AS (SELECT r, c, elev AS z FROM cells)"
_N = "nb AS (SELECT * FROM (VALUES (0, -1, -1), (1, 0, -1), (2, 1, -1), (3, -1, 0), (4, 1, 0), (5, -1, 1), (6, 0, 1), (7, 1, 1)) v(i, dx, dy))"
_FLOW = f"""{_Z}, {_N}, st AS (SELECT a.r, a.c, nb.i, b.r AS tr, b.c AS tc, (a.z - b.z) / (5.0 * CASE WHEN dx <> 0 AND dy <> 0 THEN 1.4142135623730951 ELSE 1.0 END) AS slope
      FROM z a CROSS JOIN nb JOIN z b ON b.r = a.r + dy AND b.c = a.c + dx WHERE a.z IS NOT NULL AND b.z IS NOT NULL),
    bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY slope DESC, i) AS n FROM st WHERE slope > 0) WHERE n = 1),
    fl AS (SELECT z.r, z.c, z.z, bs.i, bs.tr, bs.tc, bs.slope FROM z LEFT JOIN bs ON bs.r = z.r AND bs.c = z.c)"""
_ROUTE = f"""{_FLOW}, up AS (SELECT r, c, r AS sr, c AS sc, CAST(z AS DOUBLE) AS head, CAST(0 AS DOUBLE) AS path FROM fl UNION ALL
      SELECT fl.tr, fl.tc, up.sr, up.sc, up.head, up.path + CAST(5 AS DOUBLE) * CASE WHEN fl.tr <> fl.r AND fl.tc <> fl.c THEN CAST(1.4142135623730951 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END FROM up JOIN fl ON fl.r = up.r AND fl.c = up.c WHERE fl.tr IS NOT NULL),
    ro AS (SELECT r, c, count(*) AS acc, max(path) AS path_m FROM up GROUP BY r, c)"""
_RECURSIVE = lambda sql: sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _elevations(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "cells").select("r", "c", F.col("elev").alias("z"))


@query(f"+ {_FLOW} SELECT r, c, CAST(CASE WHEN i IS NULL THEN 0 ELSE 1 << i END AS SMALLINT) AS flag FROM fl", "cells")
def grf4_directions(spark: SparkSession, sf: str) -> DataFrame:
    return drainage.directions(_elevations(spark, sf), DX).select("r", "c", "flag")


@query(f"+ {_FLOW} SELECT r, c, round(greatest(coalesce(slope, 1e-4), 1e-4), 6) AS slope FROM fl", "cells")
def grf7_slopes(spark: SparkSession, sf: str) -> DataFrame:
    return drainage.directions(_elevations(spark, sf), DX).select("r", "c", F.round(F.greatest(F.coalesce("slope", F.lit(1e-4)), F.lit(1e-4)), 6).alias("slope"))


def _routed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    flow = drainage.directions(_elevations(spark, sf), DX)
    return flow, drainage.routed(flow, DX)


@query(f"+ {_ROUTE} SELECT r, c, acc FROM ro", "cells")
def grf5_accumulation(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf)[1].select("r", "c", "acc")


@query(f"+ {_ROUTE} SELECT r, c, round(path_m, 4) AS path_m FROM ro", "cells")
def grf8_longest_path(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf)[1].select("r", "c", F.round("path_m", 4).alias("path_m"))


@query(f"+ {_ROUTE} SELECT r, c FROM ro WHERE acc >= 8 AND (r, c) NOT IN (SELECT (r, c) FROM z WHERE z IS NULL)", "cells")
def grf6_streams(spark: SparkSession, sf: str) -> DataFrame:
    return drainage.streams(_routed(spark, sf)[1], _elevations(spark, sf).where("z IS NULL"), 8)


@query(f"+ {_ROUTE}, sh AS (SELECT r, c, acc, CASE WHEN acc >= 5 THEN acc ELSE 0 END AS a FROM ro) SELECT r, c, round(ln(1.0 + a) / ln(1.0 + (SELECT greatest(max(a), 1) FROM sh)), 6) AS intensity, CAST(floor(least(greatest(acc / 4.0, 1.0), 12.0) / 12.0 * 255.0) AS INTEGER) AS weight FROM sh", "cells")
def sca18_stream_intensity(spark: SparkSession, sf: str) -> DataFrame:
    acc = _routed(spark, sf)[1]
    return drainage.stream_intensity(acc, 5.0).join(acc.select("r", "c", hydraulics.stream_weight(F.col("acc"), 4.0).alias("weight")), ["r", "c"]).withColumn("intensity", F.round("intensity", 6))


_CHANNEL = f"""{_ROUTE}, hd AS (SELECT up.r, up.c, max(up.head) AS head FROM up JOIN ro ON ro.r = up.r AND ro.c = up.c AND abs(up.path - ro.path_m) < 1e-6 GROUP BY up.r, up.c),
    ch AS MATERIALIZED (SELECT ro.r, ro.c, CAST(acc * 25 AS DOUBLE) AS area_m2, greatest(coalesce(slope, 1e-4), 1e-4) AS slope, 2.5 * pow(acc * 25.0 / 1e6, 0.5) AS width_m, 0.3 * pow(acc * 25.0 / 1e6, 0.4) AS depth_m,
      path_m / least(greatest(1.5 * sqrt(greatest((head - z) / greatest(path_m, 1e-6), 1e-6) / 0.01), 0.3), 3.0) AS lag_s FROM ro JOIN fl ON fl.r = ro.r AND fl.c = ro.c JOIN hd ON hd.r = ro.r AND hd.c = ro.c WHERE acc >= 6)"""


@query(f"+ {_CHANNEL} SELECT r, c, area_m2, round(slope, 6) AS slope, round(width_m, 6) AS width_m, round(depth_m, 6) AS depth_m, round(lag_s, 3) AS lag_s FROM ch", "cells")
def grf9_channels_unfilled(spark: SparkSession, sf: str) -> DataFrame:
    got = drainage.channels(_elevations(spark, sf), DX, 6)
    return got.select("r", "c", "area_m2", *[F.round(x, 6).alias(x) for x in ("slope", "width_m", "depth_m")], F.round("lag_s", 3).alias("lag_s"))


_SERIES = "se AS (SELECT day, t_s, sum(mm_h) AS mm_h FROM series GROUP BY day, t_s), sg AS (SELECT day, lag(t_s) OVER w AS lo, t_s AS hi, lag(mm_h) OVER w AS r0, mm_h AS r1 FROM se WINDOW w AS (PARTITION BY day ORDER BY t_s))"


@query(f"""+ {_CHANNEL}, {_SERIES}, ta AS (SELECT day, r, c, t, w, t - k * lag_s AS q FROM ch, (VALUES (0.25, 0.5), (0.5, 1.0), (0.25, 1.5)) v(w, k), (SELECT DISTINCT day, t_s AS t FROM series) u),
    lr AS (SELECT ta.day AS day, r, c, t, sum(w * CASE WHEN hi IS NULL THEN 0.0 WHEN lo IS NULL THEN r1 ELSE r0 + (r1 - r0) * (q - lo) / (hi - lo) END) AS rate FROM ta LEFT JOIN sg ON sg.day = ta.day AND q <= hi AND q > coalesce(lo, -1e300) GROUP BY ta.day, r, c, t)
    SELECT lr.day, lr.r, lr.c, CAST(t AS DOUBLE) AS t_s, round(rate, 9) AS rate, round(greatest(pow(0.65 * (rate / 1000.0 / 3600.0) * area_m2 * 0.035 / greatest(width_m * sqrt(slope), 1e-9), 0.6) - depth_m, 0.0), 5) AS excess_m
    FROM lr JOIN ch ON ch.r = lr.r AND ch.c = lr.c""", "cells", "series")
def grf10_overflow(spark: SparkSession, sf: str) -> DataFrame:
    """WIN8 and GRF10: lagged rates and what they make channels overflow by, at every time of every day's series."""
    channel = drainage.scratch(spark)(drainage.channels(_elevations(spark, sf), DX, 6))
    series = frame(spark, sf, "series").groupBy("day", "t_s").agg(F.sum("mm_h").alias("mm_h"))
    rates = drainage.lagged_rates(channel, series.select("day", "t_s"), series, ["day"])
    return drainage.overflow(rates, ["day"]).select("day", "r", "c", "t_s", F.round("rate", 9).alias("rate"), F.round("excess_m", 5).alias("excess_m"))


for _name in ("grf5_accumulation", "grf8_longest_path", "grf6_streams", "sca18_stream_intensity", "grf9_channels_unfilled", "grf10_overflow"):
    ORACLE_SQL[_name] = _RECURSIVE(ORACLE_SQL[_name])


@query("""+ v AS (SELECT r, c FROM cells WHERE elev IS NULL), rc AS (SELECT r, c FROM v WHERE r = 0 OR c = 0 OR r = (SELECT max(r) FROM cells) OR c = (SELECT max(c) FROM cells)
      UNION SELECT v.r, v.c FROM rc JOIN v ON abs(v.r - rc.r) + abs(v.c - rc.c) = 1) SELECT cells.r, cells.c, rc.r IS NOT NULL AS sea FROM cells LEFT JOIN rc ON rc.r = cells.r AND rc.c = cells.c""", "cells")
def grf1_sea(spark: SparkSession, sf: str) -> DataFrame:
    return voids.classified(frame(spark, sf, "cells"), tile=16).select("r", "c", "sea")


ORACLE_SQL["grf1_sea"] = _RECURSIVE(ORACLE_SQL["grf1_sea"])


@query("""+ v AS (SELECT r, c FROM cells WHERE elev IS NULL), rc AS (SELECT r, c FROM v WHERE r = 0 OR c = 0 OR r = (SELECT max(r) FROM cells) OR c = (SELECT max(c) FROM cells)
      UNION SELECT v.r, v.c FROM rc JOIN v ON abs(v.r - rc.r) + abs(v.c - rc.c) = 1),
    kn AS (SELECT cells.r, cells.c, rc.r IS NOT NULL AS sea, CASE WHEN rc.r IS NOT NULL THEN 0.0 ELSE elev END AS z FROM cells LEFT JOIN rc ON rc.r = cells.r AND rc.c = cells.c),
    fi AS (SELECT 0 AS i, r, c, z FROM kn UNION ALL
      SELECT i, r, c, coalesce(z, CASE WHEN n > 0 THEN s / n END) FROM (SELECT a.i + 1 AS i, a.r, a.c, a.z, count(b.z) AS n, sum(b.z) AS s FROM fi a LEFT JOIN fi b ON a.z IS NULL AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1
        WHERE a.i < 500 AND EXISTS (SELECT 1 FROM fi WHERE z IS NULL) GROUP BY ALL))
    SELECT kn.r, kn.c, kn.sea, round(coalesce(fi.z, 0.0), 6) AS elev FROM kn JOIN fi ON fi.r = kn.r AND fi.c = kn.c AND fi.i = (SELECT max(i) FROM fi)""", "cells")
def grf2_filled_holes(spark: SparkSession, sf: str) -> DataFrame:
    return voids.filled_holes(voids.classified(frame(spark, sf, "cells"), tile=16), tile=16, halo=4).withColumn("elev", F.round("elev", 6))


ORACLE_SQL["grf2_filled_holes"] = _RECURSIVE(ORACLE_SQL["grf2_filled_holes"])


@query(None)
def grf3_filled_depressions(spark: SparkSession, sf: str) -> DataFrame:
    return voids.filled_depressions(_elevations(spark, sf), tile=64)


@query(None)
def grf9_channels(spark: SparkSession, sf: str) -> DataFrame:
    return drainage.channels(voids.filled_depressions(_elevations(spark, sf), tile=64), DX, 20)
