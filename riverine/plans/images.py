"""Queries that write image files to the shared folder and read them back: radar classes, tiles, frames, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverine.functions import geo, hydraulics
from riverine.operators import radar, raster
from riverine.plans.extent import _F, _KEY, _ST, _frames, _stats
from riverine.plans.files import _folder
from riverine.plans.places import _LAT, _LON
from riverine.plans.terrain import _TERRAIN, _terrain
from riverine.plans.testdata import collection, frame
from riverine.sources import exports, images, tiles

QUERIES, ORACLE_SQL, query = collection()
ROWS, COLS = 20, 30

_CLASSES = ", ".join(f"({i}, CAST({rate} AS DOUBLE))" for i, (_, rate) in enumerate(radar.LEGEND))


@query(f"""+ k AS (SELECT station, day, hour, CASE WHEN mm IS NULL THEN 8 ELSE CAST(floor(mm * 10) AS BIGINT) % 10 END AS k FROM gauge), lg AS (SELECT * FROM (VALUES {_CLASSES}) v(i, rate))
    SELECT station, day, hour, CASE WHEN k = 8 THEN NULL ELSE coalesce(rate, 0.0) END AS mm_h FROM k LEFT JOIN lg ON lg.i = k.k""", "gauge")
def src4_radar_images(spark: SparkSession, sf: str) -> DataFrame:
    """An image of 2 x 12 pixels a station and day: its hours in the legend's colours, one for missing, one of no class."""
    path = _folder(spark)
    colours = F.array(*[F.lit(c) for c, _ in radar.LEGEND], F.lit(radar.MISSING), F.lit("123456"))
    k = F.when(F.col("mm").isNull(), 8).otherwise(F.floor(F.col("mm") * 10) % 10).cast("int")
    byte = lambda i: F.conv(F.substring("rgb", 2 * i + 1, 2), 16, 10).cast("int")
    hours = frame(spark, sf, "gauge").select("station", "day", (F.col("hour") - 1).alias("h"), colours[k].alias("rgb"))
    layer = F.concat_ws("/", F.col("station").cast("string"), F.col("day").cast("string"))
    pixels = hours.select(layer.alias("layer"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(None).alias("t_s"), F.floor(F.col("h") / 12).alias("r"), (F.col("h") % 12).alias("c"), byte(0).alias("red"), byte(1).alias("green"), byte(2).alias("blue"))
    tiles.write_images(tiles.images_of(pixels, ["red", "green", "blue"], 2, 12), path)
    read = tiles.read_tiles(spark, path).withColumn("rgb", images.hexadecimal(F.col("red"), F.col("green"), F.col("blue")))
    name = F.split("layer", "/")
    return radar.rates(read).select(name[0].cast("bigint").alias("station"), name[1].cast("date").alias("day"), (F.col("r") * 12 + F.col("c") + 1).cast("int").alias("hour"), "mm_h")


_GONE = "(floor({0} / 16.0) * 3 + floor({1} / 16.0)) % 5 = 2"


@query(f"""+ {_TERRAIN}, mx AS (SELECT max(r) AS m FROM te), px AS (SELECT r, c FROM (SELECT CAST(unnest(range(3, m - 1)) AS BIGINT) AS r FROM mx), (SELECT CAST(unnest(range(5, 45)) AS BIGINT) AS c))
    SELECT px.r, px.c, CASE WHEN {_GONE.format('px.r', 'px.c')} THEN 0 ELSE coalesce(CAST(least(greatest(round_even(elev * 100, 0), 0), 16777215) AS INTEGER), 0) END AS elev_cm,
      CASE WHEN {_GONE.format('px.r', 'px.c')} THEN 0 ELSE coalesce(CAST(least(height_cm * 20, 25000) AS INTEGER), 0) END AS height_cm FROM px LEFT JOIN te ON te.r = px.r AND te.c = px.c""", "cells", "heights")
def src7_tile_window(spark: SparkSession, sf: str) -> DataFrame:
    """Elevations and heights as image tiles, some of which are missing; a window of them, where what is missing is 0."""
    path = _folder(spark)
    cells = _terrain(spark, sf).where(f"NOT {_GONE.format('r', 'c')}").select("r", "c", hydraulics.elevation_bytes(F.coalesce("elev", F.lit(0.0))).alias("e"), hydraulics.height_bytes(F.col("height_cm") * 20).alias("h"))
    place = [F.floor(F.col("c") / 16).alias("x"), F.floor(F.col("r") / 16).alias("y"), F.lit(None).alias("t_s"), (F.col("r") % 16).alias("r"), (F.col("c") % 16).alias("c")]
    layer = lambda n, *v: cells.select(F.lit(n).alias("layer"), *place, *[x.cast("int").alias(k) for x, k in zip(v, ("red", "green", "blue"), strict=True)])
    both = layer("elevation", F.col("e.r"), F.col("e.g"), F.col("e.b")).unionByName(layer("building", F.col("h.r"), F.col("h.g"), F.lit(0)))
    tiles.write_images(tiles.images_of(both, ["red", "green", "blue"], 16, 16), path)
    bottom = frame(spark, sf, "cells").agg(F.max("r")).first()[0] - 1
    part = lambda n: tiles.window(spark, path, n, 5, 3, 45, bottom, 16)
    high = part("elevation").select("r", "c", images.elevation_cm(F.col("red"), F.col("green"), F.col("blue")).alias("elev_cm"))
    return high.join(part("building").select("r", "c", images.height_cm(F.col("red"), F.col("green")).alias("height_cm")), ["r", "c"])


_ENC = f"""{_F}, fe AS (SELECT *, coalesce(qe, lag(qe) OVER (PARTITION BY region, frame, r ORDER BY c), 0.0) AS e, coalesce(qs, lag(qs) OVER (PARTITION BY region, frame, c ORDER BY r), 0.0) AS s FROM fr),
    en AS (SELECT region, frame, r, c, floor(least(greatest(h * 100, 0), 255)) AS red, floor(least(greatest(e * 100 + 128, 0), 255)) AS green, floor(least(greatest(s * 100 + 128, 0), 255)) AS blue FROM fe),
    gd AS (SELECT region, frame, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c FROM (SELECT DISTINCT region, frame FROM fr), (SELECT unnest(range(0, {ROWS})) AS r), (SELECT unnest(range(0, {COLS})) AS c))"""


@query(f"""+ {_ENC} SELECT gd.region, gd.frame, gd.r, gd.c, coalesce(red, 0) / CAST(100 AS DOUBLE) AS h, (coalesce(green, 0) - 128) / CAST(100 AS DOUBLE) AS qe, (coalesce(blue, 0) - 128) / CAST(100 AS DOUBLE) AS qs
    FROM gd LEFT JOIN en ON en.region = gd.region AND en.frame = gd.frame AND en.r = gd.r AND en.c = gd.c""", "frames")
def src8_frame_images(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame as an image file, read back; cells without a row have bytes of 0."""
    path = _folder(spark)
    tiles.write_images(exports.frame_images(_frames(spark, sf), ROWS, COLS), path)
    return exports.read_frames(spark, path)


@query(f"""+ {_F}, rg AS (SELECT DISTINCT region FROM fr), gd AS (SELECT region, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c FROM rg, (SELECT unnest(range(0, {ROWS})) AS r), (SELECT unnest(range(0, {COLS})) AS c))
    SELECT gd.region, gd.r, gd.c, floor(least(greatest(coalesce(max(h), 0.0) * 100, 0), 255)) / CAST(100 AS DOUBLE) AS h_max FROM gd LEFT JOIN fr ON fr.region = gd.region AND fr.r = gd.r AND fr.c = gd.c GROUP BY ALL""", "frames")
def src8_last_maximum(spark: SparkSession, sf: str) -> DataFrame:
    """Images of maxima so far; the last one of each region is read."""
    path = _folder(spark)
    tiles.write_images(exports.maximum_images(_frames(spark, sf), ROWS, COLS), path)
    return exports.last_maxima(spark, path)


_SIDE = "CAST({0} AS DOUBLE) * 5 / (CAST(40075016.686 AS DOUBLE) * cos(radians(CAST(35.15 AS DOUBLE))) / 32768 / 256)"
_LEFT, _TOP = "28830 * 256 + region * 100", "12945 * 256 + region * 50"


@query(f"""+ {_F}, {_ST}, {_KEY}, ti AS (SELECT DISTINCT region, frame, t_s FROM fr)
    SELECT kf.region, count(*) AS n_frames, string_agg('r' || kf.region || '/' || kf.frame || '_0.png', ',' ORDER BY 'r' || kf.region || '/' || kf.frame || '_0.png') AS files, min(t_s) AS first_s, max(t_s) AS last_s,
      round({_LON.format(f'(({_LEFT}) / CAST(256 AS DOUBLE))')}, 6) AS west, round({_LAT.format(f'((({_TOP}) + {_SIDE.format(ROWS)}) / CAST(256 AS DOUBLE))')}, 6) AS south,
      round({_LON.format(f'((({_LEFT}) + {_SIDE.format(COLS)}) / CAST(256 AS DOUBLE))')}, 6) AS east, round({_LAT.format(f'(({_TOP}) / CAST(256 AS DOUBLE))')}, 6) AS north
    FROM kf JOIN ti ON ti.region = kf.region AND ti.frame = kf.frame GROUP BY kf.region""".replace("region * ", "kf.region * "), "frames")
def snk10_export(spark: SparkSession, sf: str) -> DataFrame:
    """Key frames as image files, and the manifest's rows: files, times and the region's bounds."""
    f, path = _frames(spark, sf), _folder(spark)
    side = lambda n: geo.grid_size_pixels(F.lit(float(n)), F.lit(5.0), F.lit(35.15))
    box = geo.region_bounds((F.col("region") * 100).cast("double"), (F.col("region") * 50).cast("double"), side(COLS), side(ROWS), 28830, 12945)
    bounds = f.select("region").distinct().select("region", box.alias("b")).select("region", *[F.round(F.col(f"b.{k}"), 6).alias(k) for k in ("west", "south", "east", "north")])
    return exports.export_frames(f, _stats(spark, sf), bounds, path, 3, ROWS, COLS).drop("bytes")


_AREA = 15.358561


@query(f"""+ {_TERRAIN}, e AS (SELECT CAST(min(floor(r / 16.0)) AS BIGINT) AS y0, CAST(max(floor(r / 16.0)) AS BIGINT) AS y1, CAST(min(floor(c / 16.0)) AS BIGINT) AS x0, CAST(max(floor(c / 16.0)) AS BIGINT) AS x1, max(c) + 1 AS width, max(r) + 1 AS height,
      round(count(*) FILTER (elev > 0.5) * {_AREA} / 1e6, 6) AS land_km2, count(*) FILTER (height_cm > 0) > 0 AS buildings FROM te)
    SELECT *, round({_LON.format('(28830 + x0)')}, 6) AS lon_min, round({_LAT.format('(12945 + y1 + 1)')}, 6) AS lat_min, round({_LON.format('(28830 + x1 + 1)')}, 6) AS lon_max, round({_LAT.format('(12945 + y0)')}, 6) AS lat_max, 'r*65536+g*256+b' AS elevation_encoding, 'r*256+g' AS building_encoding FROM e""", "cells", "heights")
def snk9_dataset_row(spark: SparkSession, sf: str) -> DataFrame:
    row = raster.dataset_row(_terrain(spark, sf), 16, _AREA, 28830, 12945)
    return row.withColumns({k: F.round(k, 6) for k in ("land_km2", "lon_min", "lat_min", "lon_max", "lat_max")})
