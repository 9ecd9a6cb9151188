"""Queries on geography, catalogues, landed documents and footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverine.functions import geo, hydraulics
from riverine.operators import catalog, footprints
from riverine.plans.testdata import collection, frame
from riverine.sources import landing

QUERIES, ORACLE_SQL, query = collection()
GRID = {"left": 4479.0, "top": 3688.0, "tile_x0": 28830.0, "tile_y0": 12945.0, "dx": 7.8119, "downsample": 2.0, "lat0": 35.1546}

_TX = "(({0}) + 180) / CAST(360 AS DOUBLE) * 32768"
_TY = "(1 - asinh(tan(radians({0}))) / pi()) / 2 * 32768"
_LON = "({0}) / CAST(32768 AS DOUBLE) * 360 - 180"
_LAT = "degrees(atan(sinh(pi() * (1 - 2 * ({0}) / CAST(32768 AS DOUBLE)))))"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "points")


@query(f"SELECT point, round({_TX.format('lon')}, 5) AS x, round({_TY.format('lat')}, 5) AS y, round({_LON.format(_TX.format('lon'))}, 6) AS lon_back, round({_LAT.format(_TY.format('lat'))}, 6) AS lat_back FROM points", "points")
def sca1_tiles(spark: SparkSession, sf: str) -> DataFrame:
    x, y = geo.tile_x(F.col("lon")), geo.tile_y(F.col("lat"))
    return _points(spark, sf).select("point", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"), F.round(geo.tile_lon(x), 6).alias("lon_back"), F.round(geo.tile_lat(y), 6).alias("lat_back"))


@query(f"""+ b AS (SELECT point, CAST(floor({_TX.format('lon')}) AS INTEGER) AS x0, CAST(floor({_TX.format('lon + 0.03')}) AS INTEGER) AS x1, CAST(floor({_TY.format('lat + 0.02')}) AS INTEGER) AS y0, CAST(floor({_TY.format('lat')}) AS INTEGER) AS y1 FROM points)
    SELECT point, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT point, y0, y1, unnest(range(x0, x1 + 1)) AS x FROM b), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y)""", "points")
def sca2_box_tiles(spark: SparkSession, sf: str) -> DataFrame:
    box = geo.tile_range(F.col("lon"), F.col("lat"), F.col("lon") + 0.03, F.col("lat") + 0.02)
    got = _points(spark, sf).select("point", box.alias("b")).select("point", "b.*")
    return got.select("point", F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1").select("point", "x", F.explode(F.sequence("y0", "y1")).alias("y"))


@query(f"SELECT point, round(({_TX.format('lon')} - 28830) * 256, 4) AS px, round(({_TY.format('lat')} - 12945) * 256, 4) AS py, round(40075016.686 * cos(radians(lat)) / 32768 / 256, 6) AS m_per_px FROM points", "points")
def sca3_pixels(spark: SparkSession, sf: str) -> DataFrame:
    px, py = geo.pixel(F.col("lon"), F.col("lat"), F.lit(28830), F.lit(12945))
    return _points(spark, sf).select("point", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"), F.round(geo.metres_per_pixel(F.col("lat")), 6).alias("m_per_px"))


@query(f"SELECT r, c, round({_LON.format('(28830 * 256 + c * 4 + 2) / CAST(256 AS DOUBLE)')}, 6) AS lon, round({_LAT.format('(12945 * 256 + r * 4 + 2) / CAST(256 AS DOUBLE)')}, 6) AS lat FROM cells", "cells")
def sca4_overview_places(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = geo.pixel_to_lonlat(28830 * 256 + F.col("c") * 4 + 2.0, 12945 * 256 + F.col("r") * 4 + 2.0)
    return frame(spark, sf, "cells").select("r", "c", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("SELECT r, c, round((28830 * 256 + c) * (40075016.686 / (32768 * 256)) - 40075016.686 / 2, 3) AS x, round(40075016.686 / 2 - (12945 * 256 + r) * (40075016.686 / (32768 * 256)), 3) AS y FROM cells".replace("40075016.686", "CAST(40075016.686 AS DOUBLE)"), "cells")
def sca5_mercator(spark: SparkSession, sf: str) -> DataFrame:
    x, y = geo.pixel_to_mercator(28830.0 * 256 + F.col("c"), 12945.0 * 256 + F.col("r"))
    return frame(spark, sf, "cells").select("r", "c", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


_EM = "CAST(40075016.686 AS DOUBLE)"


@query(f"""+ b AS (SELECT point, 28830 * 256 + CAST(point % 700 AS DOUBLE) AS x, 12945 * 256 + CAST(point % 900 AS DOUBLE) AS y, CAST(point % 50 + 40 AS DOUBLE) * 5 / ({_EM} * cos(radians(lat)) / 32768 / 256) AS w, CAST(point % 33 + 20 AS DOUBLE) * 5 / ({_EM} * cos(radians(lat)) / 32768 / 256) AS h FROM points)
    SELECT point, round(x * ({_EM} / 8388608) - {_EM} / 2, 3) AS xmin, round({_EM} / 2 - (y + h) * ({_EM} / 8388608), 3) AS ymin, round((x + w) * ({_EM} / 8388608) - {_EM} / 2, 3) AS xmax, round({_EM} / 2 - y * ({_EM} / 8388608), 3) AS ymax,
      round({_LON.format('x / 256')}, 6) AS west, round({_LAT.format('(y + h) / 256')}, 6) AS south, round({_LON.format('(x + w) / 256')}, 6) AS east, round({_LAT.format('y / 256')}, 6) AS north FROM b""", "points")
def sca5_region_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes whose sides are given in cells of five metres."""
    k, side = F.col("point"), lambda m, n: geo.grid_size_pixels((F.col("point") % m + n).cast("double"), F.lit(5.0), F.col("lat"))
    box = geo.region_bounds((k % 700).cast("double"), (k % 900).cast("double"), side(50, 40), side(33, 20), 28830, 12945)
    got = _points(spark, sf).select("point", box.alias("b")).select("point", "b.*")
    return got.select("point", *[F.round(n, 3).alias(n) for n in ("xmin", "ymin", "xmax", "ymax")], *[F.round(n, 6).alias(n) for n in ("west", "south", "east", "north")])


@query("""+ e AS (SELECT min(lat) - s AS y0, min(lon) - s AS x0, CAST(ceil((max(lat) + s - (min(lat) - s)) / s) AS BIGINT) AS ny, CAST(ceil((max(lon) + s - (min(lon) - s)) / s) AS BIGINT) AS nx, any_value(s) AS s FROM (SELECT *, CAST(0.05 AS DOUBLE) AS s FROM points) GROUP BY s)
    SELECT round(y0 + i * s, 4) AS lat, round(x0 + j * s, 4) AS lon FROM (SELECT *, unnest(range(0, ny)) AS i FROM e), LATERAL (SELECT unnest(range(0, nx)) AS j)""", "points")
def sca5_request_grid(spark: SparkSession, sf: str) -> DataFrame:
    ends = _points(spark, sf).agg(*[f(k).alias(f"{k}_{n}") for k in ("lat", "lon") for f, n in ((F.min, "min"), (F.max, "max"))])
    lat, lon = (geo.request_axis(F.col(f"{k}_min"), F.col(f"{k}_max"), 0.05) for k in ("lat", "lon"))
    return ends.select(F.explode(lat).alias("lat"), lon.alias("axis")).select("lat", F.explode("axis").alias("lon"))


_SCALE = "(CAST(40075016.686 AS DOUBLE) * cos(radians(CAST(35.1546 AS DOUBLE))) / 32768 / 256)"


@query(f"SELECT point, round((({_TX.format('lon')} - 28830) * 256 - 4479) * {_SCALE} / 7.8119 / 2, 4) AS x, round((({_TY.format('lat')} - 12945) * 256 - 3688) * {_SCALE} / 7.8119 / 2, 4) AS y, round(lon, 6) AS lon_back, round(lat, 6) AS lat_back FROM points", "points")
def sca8_grid_pixels(spark: SparkSession, sf: str) -> DataFrame:
    x, y = geo.grid_pixel(F.col("lon"), F.col("lat"), GRID)
    lon, lat = geo.grid_lonlat(y - 0.5, x - 0.5, GRID)
    return _points(spark, sf).select("point", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(lon, 6).alias("lon_back"), F.round(lat, 6).alias("lat_back"))


@query("""SELECT l_orderkey, l_linenumber, round(2.5 * pow(a / 1e6, 0.5), 6) AS width_m, round(0.3 * pow(a / 1e6, 0.4), 6) AS depth_m, round(least(greatest(1.5 * sqrt(greatest(l_discount, 1e-6) / 0.01), 0.3), 3.0), 6) AS velocity,
    round(greatest(pow(0.65 * (l_quantity / 1000.0 / 3600.0) * a * 0.035 / greatest(2.5 * pow(a / 1e6, 0.5) * sqrt(greatest(l_tax, 1e-4)), 1e-9), 0.6) - 0.3 * pow(a / 1e6, 0.4), 0.0), 6) AS excess_m
    FROM (SELECT *, l_extendedprice * 100 AS a FROM lineitem)""")
def sca12_overflow(spark: SparkSession, sf: str) -> DataFrame:
    """SCA11 and SCA12."""
    area, slope = F.col("l_extendedprice") * 100, F.greatest(F.col("l_tax"), F.lit(1e-4))
    width, depth = hydraulics.channel_width(area), hydraulics.channel_depth(area)
    excess = hydraulics.overflow_depth(F.col("l_quantity"), area, width, slope, depth)
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.round(width, 6).alias("width_m"), F.round(depth, 6).alias("depth_m"), F.round(hydraulics.path_velocity(F.col("l_discount")), 6).alias("velocity"), F.round(excess, 6).alias("excess_m"))


@query("""+ a AS (SELECT c_custkey, CAST(c_custkey % 2200 AS DOUBLE) AS x0, CAST(c_custkey * 13 % 2500 AS DOUBLE) AS y0, CAST(c_custkey * 7 % 2300 AS DOUBLE) AS x1, CAST(c_custkey * 3 % 2400 AS DOUBLE) AS y1 FROM customer),
    p AS (SELECT c_custkey, least(greatest(floor(least(x0, x1) * 4 + 0.5), 0), 8448) AS px0, least(greatest(floor(greatest(x0, x1) * 4 + 0.5), 0), 8448) AS px1, least(greatest(floor(least(y0, y1) * 4 + 0.5), 0), 9728) AS py0, least(greatest(floor(greatest(y0, y1) * 4 + 0.5), 0), 9728) AS py1 FROM a),
    s AS (SELECT *, least(px1 - px0, 4600, 8448) AS w0, least(py1 - py0, 4600, 9728) AS h0 FROM p), t AS (SELECT *, least(1.0, sqrt(20e6 / greatest(w0 * h0, 1))) AS k FROM s), u AS (SELECT *, greatest(32, floor(w0 * k)) AS w, greatest(32, floor(h0 * k)) AS h FROM t)
    SELECT c_custkey, CAST(least(greatest(floor((px0 + px1) / 2 - w / 2 + 0.5), 0), 8448 - w) AS BIGINT) AS left_px, CAST(least(greatest(floor((py0 + py1) / 2 - h / 2 + 0.5), 0), 9728 - h) AS BIGINT) AS top_px, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h FROM u""".replace("+ a AS", "WITH a AS"))
def sca15_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    box = geo.clamped_rectangle(*[(k * m % n).cast("double") for m, n in ((1, 2200), (13, 2500), (7, 2300), (3, 2400))], max_x=8448, max_y=9728)
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", box.alias("b")).select("c_custkey", F.col("b.left").alias("left_px"), F.col("b.top").alias("top_px"), "b.w", "b.h")


@query("SELECT event_id FROM events WHERE date_diff('day', CAST(ts AS DATE), (SELECT max(CAST(ts AS DATE)) FROM events)) BETWEEN 0 AND 7")
def sca16_recent(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.to_date("ts").alias("day"))
    return catalog.recent(events, events.agg(F.max("day").alias("today"))).select("event_id")


_MICRO = lambda v: f"CAST(round(({v}) * 1000000) AS BIGINT)"
_GAP = lambda a, b, x, y: f"({_MICRO(a)} - {x}) * ({_MICRO(a)} - {x}) + ({_MICRO(b)} - {y}) * ({_MICRO(b)} - {y})"


@query(f"+ g AS (SELECT p.point, w.ward, {_GAP('w.lon', 'w.lat', _MICRO('p.lon'), _MICRO('p.lat'))} AS d FROM points p, wards w) SELECT point, arg_min(ward, (d, ward)) AS ward FROM g GROUP BY point", "points", "wards")
def jon16_nearest_ward(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.nearest_ward(_points(spark, sf), frame(spark, sf, "wards"))


_BOXES = f"""bx AS (SELECT point AS box, lon - 1.5 * (point % 3) AS west, lon - 1.5 * (point % 3) + 0.02 AS east, lat AS south, lat + 0.02 AS north FROM points),
    bm AS (SELECT box, {_MICRO('west')} AS west, {_MICRO('east')} AS east, {_MICRO('south')} AS south, {_MICRO('north')} AS north FROM bx),
    wm AS (SELECT ward, {_MICRO('lon')} AS u, {_MICRO('lat')} AS v FROM wards)"""
_NEARW = """nr AS (SELECT box, ward FROM (SELECT box, ward, greatest(west - u, 0, u - east) AS dx, greatest(south - v, 0, v - north) AS dy FROM bm, wm) WHERE dx * dx + dy * dy <= 80000 * 80000::BIGINT),
    ct AS (SELECT box, CAST(floor((west + east) / 2) AS BIGINT) AS x, CAST(floor((south + north) / 2) AS BIGINT) AS y FROM bm WHERE box NOT IN (SELECT box FROM nr)),
    al AS (SELECT box, arg_min(ward, ((u - x) * (u - x) + (v - y) * (v - y), ward)) AS ward FROM ct, wm GROUP BY box), pk AS (SELECT * FROM nr UNION ALL SELECT * FROM al)"""


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    west = F.col("lon") - 1.5 * (F.col("point") % 3)
    return _points(spark, sf).select(F.col("point").alias("box"), west.alias("west"), (west + 0.02).alias("east"), F.col("lat").alias("south"), (F.col("lat") + 0.02).alias("north"))


@query(f"+ {_BOXES}, {_NEARW} SELECT * FROM pk", "points", "wards")
def jon17_wards_near(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.wards_near(_boxes(spark, sf), frame(spark, sf, "wards"))


@query(f"""+ {_BOXES}, {_NEARW}, te AS (SELECT pk.box, pk.ward, CASE WHEN pk.ward % 9 = 0 THEN true ELSE w.lon <= east AND w.lon + 0.03 >= west AND w.lat <= north AND w.lat + 0.03 >= south END AS meets FROM pk JOIN wards w ON w.ward = pk.ward JOIN bx ON bx.box = pk.box)
    SELECT box, ward FROM te WHERE meets OR box NOT IN (SELECT box FROM te WHERE meets)""", "points", "wards")
def jon19_meeting_picks(spark: SparkSession, sf: str) -> DataFrame:
    boxes, wards = _boxes(spark, sf), frame(spark, sf, "wards")
    own = wards.select("ward", "lon", "lat", *[F.when(F.col("ward") % 9 != 0, e).alias(n) for n, e in (("west", F.col("lon")), ("east", F.col("lon") + 0.03), ("south", F.col("lat")), ("north", F.col("lat") + 0.03))])
    return catalog.picks_near(boxes, own)


_URLS = "ur AS (SELECT ward, lod, arg_max(url, (CASE WHEN texture THEN 1 ELSE 0 END, CASE WHEN texture THEN pos ELSE -pos END)) AS url FROM tilesets WHERE city_code = '23100' AND type_en = 'bldg' AND url IS NOT NULL GROUP BY ward, lod)"


@query(f"+ {_URLS} SELECT * FROM ur", "tilesets")
def src11_tileset_urls(spark: SparkSession, sf: str) -> DataFrame:
    urls = catalog.tileset_urls(frame(spark, sf, "tilesets"))
    return catalog.url_map(urls).select("ward", F.explode("urls").alias("lod", "url")).withColumn("lod", F.col("lod").cast("int"))


@query(f"+ {_URLS} SELECT w.ward, coalesce(a.url, b.url, w.url) AS url FROM wards w LEFT JOIN ur a ON a.ward = w.ward AND a.lod = 2 LEFT JOIN ur b ON b.ward = w.ward AND b.lod = 1", "tilesets", "wards")
def jon18_picked_url(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.picked_url(frame(spark, sf, "wards"), catalog.tileset_urls(frame(spark, sf, "tilesets")))


@query("SELECT station, day, hour, mm FROM gauge", "gauge")
def src1_gauge_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages are written from the hours, one table row each, and parsed."""
    gauge = frame(spark, sf, "gauge")
    cell = lambda v: F.concat(F.lit("<td class='x'>"), v, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.concat(F.lit(" "), F.col("hour").cast("string"))), cell(F.lit("1000.1")), cell(F.lit("--")), cell(F.coalesce(F.concat(F.lit("<b>"), F.col("mm").cast("string"), F.lit("</b>")), F.lit("--"))), F.lit("</tr>\n"))
    pages = gauge.groupBy("station", "day").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hour", row.alias("t")))), lambda x: x["t"]), "").alias("rows"))
    html = pages.select("station", "day", F.concat(F.lit("<table><tr><th>hour</th></tr>"), "rows", F.lit("<tr><td>x</td><td>1</td><td>2</td><td>3</td></tr></table>")).alias("html"))
    return landing.gauge_pages(html, ["station", "day"])[0].select("station", "day", "hour", "mm")


@query("SELECT day, hour, lat, lon, mm_h FROM model", "model")
def src2_model_grids(spark: SparkSession, sf: str) -> DataFrame:
    """Responses are written from the model's cells as JSON and parsed; of every day a copy a century before lacks its last hour and is set aside."""
    model = frame(spark, sf, "model")
    damaged = model.where("hour < 24").withColumn("day", F.date_sub("day", 36500))
    model = model.unionByName(damaged)
    values = F.transform(F.sort_array(F.collect_list(F.struct("hour", "mm_h"))), lambda x: x["mm_h"])
    entry = F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.struct(F.col("v").alias("precipitation")).alias("hourly"))
    body = model.groupBy("day", "lat", "lon").agg(values.alias("v")).groupBy("day").agg(F.to_json(F.collect_list(entry)).alias("body"))
    return landing.model_grids(body)[0]


@query("SELECT CAST(s_suppkey AS INTEGER) AS seq, CAST(s_nationkey AS INTEGER) AS area, CAST(5000 + s_suppkey % 90 AS INTEGER) AS mesh_from, CAST(5001 + s_suppkey % 90 AS INTEGER) AS mesh_to FROM supplier")
def src3_mesh_master(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    entry = F.struct(F.col("s_suppkey").alias("seq"), F.col("s_nationkey").alias("areaCd"), (5000 + F.col("s_suppkey") % 90).alias("meshFrom"), (5001 + F.col("s_suppkey") % 90).alias("meshTo"))
    return landing.mesh_master(s.groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(entry).alias("areaInfo"))).alias("body")))


@query("""+ n AS (SELECT CAST(floor(r / 10.0) AS INTEGER) AS tile_y, CAST(floor(c / 10.0) AS INTEGER) AS k, count(*) AS n FROM cells GROUP BY 1, 2)
    SELECT CAST(28800 + k AS INTEGER) AS tile_x, n.tile_y, CAST(r % 10 AS INTEGER) AS r, CAST(c % 10 AS INTEGER) AS c, elev FROM cells JOIN n ON n.tile_y = floor(r / 10.0) AND n.k = floor(c / 10.0) WHERE n = 100""", "cells")
def src5_elevation_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """All cells as text tiles of 10 x 10, parsed; rows of odd tiles have an eleventh value, which doesn't count; incomplete tiles are set aside."""
    cells = frame(spark, sf, "cells").withColumns({"x": F.floor(F.col("c") / 10), "y": F.floor(F.col("r") / 10)})
    joined = lambda c, sep: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["t"]), sep)
    text = F.coalesce(F.col("elev").cast("string"), F.lit("e"))
    rows = cells.groupBy("x", "y", "r").agg(joined(F.struct("c", text.alias("t")), ",").alias("t")).withColumn("t", F.when(F.col("x") % 2 == 1, F.concat("t", F.lit(",0"))).otherwise(F.col("t")))
    name = F.concat(F.lit("/dem/"), (28800 + F.col("x")).cast("string"), F.lit("_"), F.col("y").cast("string"), F.lit(".txt"))
    return landing.elevation_tiles(rows.groupBy("x", "y").agg(joined(F.struct("r", "t"), "\n").alias("value")).select(name.alias("path"), "value"), 10)[0]


@query("SELECT CAST(c_nationkey AS BIGINT) AS response, c_name AS id, CAST(c_custkey AS BIGINT) AS size, kind FROM customer, (VALUES ('nested'), ('feed')) v(kind) WHERE c_custkey % 7 <> 0")
def src10_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Search responses of both shapes are written from customers, with entries that aren't objects, and flattened."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    item = F.when(F.col("c_custkey") % 7 == 0, F.to_json(F.array("c_custkey"))).otherwise(F.to_json(F.struct(F.col("c_name").alias("id"), F.col("c_custkey").alias("size"))))
    lists = c.groupBy(F.col("c_nationkey").cast("bigint").alias("response")).agg(F.array_join(F.collect_list(item), ",").alias("t"))
    nested = catalog.nested_scenes(lists.select("response", F.concat(F.lit("[["), "t", F.lit("], 5, null]")).alias("body")))
    feed = catalog.listed_entries(lists.select("response", F.concat(F.lit('{"feed": {"entry": ['), "t", F.lit("]}}")).alias("body")), "feed.entry")
    return nested.withColumn("kind", F.lit("nested")).unionByName(feed.withColumn("kind", F.lit("feed")))


@query("SELECT 'r' || CAST(station AS VARCHAR) || '-' || CAST(day AS VARCHAR) AS dir, t_s, mm_h FROM series", "series")
def src9_replay_documents(spark: SparkSession, sf: str) -> DataFrame:
    series = frame(spark, sf, "series")
    name = F.concat(F.lit("r"), F.col("station").cast("string"), F.lit("-"), F.col("day").cast("string"))
    bodies = series.groupBy(name.alias("dir")).agg(F.to_json(F.struct(F.lit(60.0).alias("interval"), F.collect_list(F.array("t_s", "mm_h")).alias("series"))).alias("body"))
    return landing.replay_series(bodies)


@query("""+ d AS (SELECT 'r' || CAST(station AS VARCHAR) || '-' || CAST(day AS VARCHAR) AS dir, station, count(*) AS n_times, max(t_s) AS last_s FROM series GROUP BY station, day)
    SELECT dir, 'rain' AS scenario, CAST(60 AS DOUBLE) AS interval_s, CAST(30 + station AS INTEGER) AS w, CAST(20 AS INTEGER) AS h, CAST(7.5 AS DOUBLE) AS dx, CAST(station * 10 AS INTEGER) AS left_px, CAST(5 AS INTEGER) AS top_px,
      CAST((30 + station) * 2 AS INTEGER) AS width_px, CAST(40 AS INTEGER) AS height_px, CAST(136.9 AS DOUBLE) AS lon0, CAST(35 AS DOUBLE) + station / CAST(8 AS DOUBLE) AS lat0, CAST(2 AS DOUBLE) AS downsample, CAST(n_times AS INTEGER) AS n_times, last_s FROM d""", "series")
def src9_replay_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Grid, bounds, origin and times of replay documents."""
    series, k = frame(spark, sf, "series"), F.col("station").cast("int")
    name = F.concat(F.lit("r"), F.col("station").cast("string"), F.lit("-"), F.col("day").cast("string"))
    box = F.struct((k * 10).alias("left"), F.lit(5).alias("top"), ((30 + k) * 2).alias("w"), F.lit(40).alias("h"))
    parts = [F.lit("rain").alias("scenario"), F.lit(60.0).alias("interval"), F.struct((30 + k).alias("w"), F.lit(20).alias("h"), F.lit(7.5).alias("dx")).alias("grid"), box.alias("bounds_px"), F.struct(F.lit(136.9).alias("lon"), (35 + F.col("station") / 8).alias("lat")).alias("origin")]
    bodies = series.groupBy(name.alias("dir"), "station").agg(F.sort_array(F.collect_list("t_s")).alias("times")).select("dir", F.to_json(F.struct(*parts, "times")).alias("body"))
    meta = landing.replay_metadata(bodies)
    return meta.select(*[c for c in meta.columns if c != "times"], F.size("times").alias("n_times"), F.array_max("times").alias("last_s"))


_RING = "CAST(35 AS DOUBLE) + c_custkey % 97 / CAST(1000 AS DOUBLE)"


@query(f"SELECT c_custkey, CAST(CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 4 END AS INTEGER) AS points, CASE WHEN c_custkey % 4 <> 3 THEN round({_RING}, 6) END AS lat0, CAST(least(round_even(c_acctbal / 10 * 100, 0), 32000) AS INTEGER) AS height_cm FROM customer")
def sca7_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Lists with and without heights, and lists too short to be rings."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_acctbal", F.expr("35D + c_custkey % 97 / 1000D").alias("y"), F.expr("136D + c_custkey % 89 / 1000D").alias("x"))
    corner = lambda dy, dx, z: F.concat_ws(" ", (F.col("y") + dy).cast("string"), (F.col("x") + dx).cast("string"), *([F.lit("12.5")] if z else []))
    square = lambda z: F.concat_ws(" ", *[corner(a, b, z) for a, b in ((0.0, 0.0), (0.0, 0.01), (0.01, 0.01), (0.01, 0.0))])
    text = F.when(F.col("c_custkey") % 4 == 3, "35.0 136.0 1").when(F.col("c_custkey") % 2 == 0, square(True)).otherwise(square(False))
    got = landing.positions(c.withColumn("text", text))
    return got.select("c_custkey", F.when(F.col("ring").isNotNull(), F.size("ring")).alias("points"), F.round(F.col("ring")[0]["lat"], 6).alias("lat0"), landing.height_cm(F.col("c_acctbal") / 10).alias("height_cm"))


@query(f"""+ b AS (SELECT c_custkey AS seq, CAST(c_custkey * 17 % 290 AS DOUBLE) + 0.25 AS y, CAST(c_custkey * 29 % 310 AS DOUBLE) + 0.25 AS x, CAST(c_custkey % 5 + 2 AS INTEGER) AS n, CAST(floor(abs(c_acctbal)) AS BIGINT) AS h FROM customer),
    p AS (SELECT b.seq, b.h, CAST(floor(b.y) AS BIGINT) + i AS r, CAST(floor(b.x) AS BIGINT) + j AS c FROM b, (SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, 8)) AS j) WHERE i < n AND j < n)
    SELECT r, c, arg_max(h, seq) AS height_cm FROM p GROUP BY r, c""".replace("+ b AS", "WITH b AS"))
def jon15_rasterised(spark: SparkSession, sf: str) -> DataFrame:
    """Square rings, so that SQL can say which pixel centres they hold."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.lit("f").alias("file"), F.col("c_custkey").alias("seq"), F.floor(F.abs("c_acctbal")).alias("height_cm"), F.expr("CAST(c_custkey * 17 % 290 AS DOUBLE) + 0.25D").alias("y"), F.expr("CAST(c_custkey * 29 % 310 AS DOUBLE) + 0.25D").alias("x"), F.expr("CAST(c_custkey % 5 + 2 AS DOUBLE)").alias("n"))
    corner = lambda a, b: F.struct((F.col("y") + a * F.col("n")).alias("y"), (F.col("x") + b * F.col("n")).alias("x"))
    return footprints.rasterised(c.select("file", "seq", "height_cm", F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0)).alias("ring")), 64)
