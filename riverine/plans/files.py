"""Queries that write files to the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverine.functions import hydraulics
from riverine.operators import footprints, rain
from riverine.operators.drainage import shared_folder
from riverine.plans.extent import _F, _frames
from riverine.plans.rain import _SUMMARY, KEYS
from riverine.plans.terrain import _TERRAIN, _terrain
from riverine.plans.testdata import collection, frame
from riverine.sources import sinks
from riverine.sources.buildings import buildings
from riverine.streaming.feeds import largest_hours

QUERIES, ORACLE_SQL, query = collection()


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT station, day, t_s, CAST(least(greatest(round_even(mm_h / 0.5, 0), 0), 255) AS INTEGER) AS count FROM series", "series")
def snk1_written_rates(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_partitions(rain.quantised(frame(spark, sf, "series")).select("station", "day", "t_s", "count"), path, ["day"])
    return spark.read.parquet(path).select("station", "day", "t_s", "count")


@query(f"""+ {_TERRAIN} SELECT r, c, CAST(floor(r / 16.0) AS INTEGER) AS tile_r, CAST(floor(c / 16.0) AS INTEGER) AS tile_c, CAST(least(greatest(round_even(elev * 100, 0), 0), 16777215) AS INTEGER) AS elev_cm,
    CAST(least(height_cm * 20, 25000) AS INTEGER) AS height_cm FROM te WHERE elev IS NOT NULL""", "cells", "heights")
def snk2_written_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """SNK2 and SNK3 as tiles of bytes; read back as SRC7 reads them: three bytes of an elevation, two of a height."""
    path = _folder(spark)
    coded = _terrain(spark, sf).where("elev IS NOT NULL").select("r", "c", hydraulics.elevation_bytes(F.col("elev")).alias("e"), hydraulics.height_bytes(F.col("height_cm") * 20).alias("h"))
    sinks.write_tiles(coded, path, 16)
    return spark.read.parquet(path).select("r", "c", "tile_r", "tile_c", F.expr("CAST(e.r AS INT) * 65536 + CAST(e.g AS INT) * 256 + CAST(e.b AS INT)").alias("elev_cm"), F.expr("CAST(h.r AS INT) * 256 + CAST(h.g AS INT)").alias("height_cm"))


@query(f"+ {_SUMMARY} SELECT station, s.day AS day, total_mm, peak_mmh, n AS points FROM sm s JOIN (SELECT station AS st, day, count(*) AS n FROM series GROUP BY station, day) x ON x.st = s.station AND x.day = s.day", "series", "gauge")
def snk6_written_documents(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    docs = rain.scenario_documents(frame(spark, sf, "series"), rain.gauge_summary(frame(spark, sf, "gauge"), KEYS), KEYS, F.lit("observed-rain"), F.col("day"), F.col("station").cast("string"))
    sinks.write_documents(docs, path)
    read = spark.read.parquet(path).withColumn("d", F.from_json("document", "series ARRAY<STRUCT<t_s: DOUBLE>>, total_mm DOUBLE, peak_mmh DOUBLE"))
    station = F.regexp_extract("file", r"_(\d+)\.json$", 1).cast("bigint")
    return read.select(station.alias("station"), "day", "d.total_mm", "d.peak_mmh", F.size("d.series").cast("bigint").alias("points"))


@query("SELECT CAST(user_id AS VARCHAR) AS dir, CAST(CASE WHEN bool_or(event_type = 'signup') THEN 'new' ELSE 'old' END AS VARCHAR) AS label FROM events GROUP BY user_id")
def snk8_written_index(spark: SparkSession, sf: str) -> DataFrame:
    """An index is written, then replaced by one in which the newer rows stand."""
    path = _folder(spark)
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("dir"), "event_type")
    sinks.replace_index(events.select("dir", F.lit("old").alias("label")).distinct(), path, "dir")
    sinks.replace_index(events.where("event_type = 'signup'").select("dir", F.lit("new").alias("label")).distinct(), path, "dir")
    return sinks.read_index(spark, path)


@query(f"+ {_F} SELECT region, frame, r, c, CAST(floor(least(greatest(h * 100, 0), 255)) AS INTEGER) AS h8 FROM fr", "frames")
def snk4_written_frames(spark: SparkSession, sf: str) -> DataFrame:
    """SNK4 written as a folder a region and frame, read back."""
    path = _folder(spark)
    coded = _frames(spark, sf).select("region", "frame", "r", "c", F.floor(F.least(F.greatest(F.col("h") * 100, F.lit(0.0)), F.lit(255.0))).cast("int").alias("h8"))
    sinks.write_partitions(coded, path, ["region", "frame"])
    return spark.read.parquet(path).select(F.col("region").cast("bigint").alias("region"), "frame", "r", "c", "h8")


@query("""SELECT station, CAST(start AS DATE) AS day, max(mm) AS most_mm FROM (SELECT start, station, sum(tenths) / 10.0 AS mm FROM
    (SELECT CAST(user_id % 10 AS BIGINT) AS station, CAST(floor(value * 10) AS BIGINT) AS tenths, time_bucket(INTERVAL '10 minutes', ts) - INTERVAL '10 minutes' * k AS start FROM events, (SELECT unnest(range(0, 6)) AS k)) GROUP BY ALL) GROUP BY ALL""".replace("/ 10.0", "/ CAST(10 AS DOUBLE)"))
def str5_sliding_maximum(spark: SparkSession, sf: str) -> DataFrame:
    messages = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("station"), (F.floor(F.col("value") * 10) / 10).alias("mm"))
    return largest_hours(messages).withColumn("most_mm", F.round("most_mm", 1))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(round_even((c_custkey % 90 + 3) * 100, 0) AS INTEGER) AS height_cm, CAST(4 AS BIGINT) AS corners, round(35.1 + c_custkey % 100 / 1000.0, 6) AS lat FROM customer WHERE c_custkey % 7 <> 0""")
def src6_buildings(spark: SparkSession, sf: str) -> DataFrame:
    """Buildings written as CityGML elements and read back; every seventh has no height."""
    path = _folder(spark)
    _write_city(spark.read.parquet(f"{sf}/customer.parquet"), path)
    got = buildings(spark, path)
    return got.select("id", "height_cm", F.size("ring").cast("bigint").alias("corners"), F.round(F.col("ring")[0]["lat"], 6).alias("lat"))


def _write_city(customers: DataFrame, path: str) -> None:
    """Folders of a mesh of 1000 buildings, each one document; their names grow with the mesh."""
    mesh = F.format_string("%09d", F.floor(F.col("c_custkey") / 1000))
    bodies = customers.groupBy(mesh.alias("mesh")).agg(F.array_join(F.sort_array(F.collect_list(_building())), "").alias("body"))
    root = '<core:CityModel xmlns:core="c" xmlns:bldg="b" xmlns:gml="g">'
    documents = bodies.select("mesh", F.concat(F.lit(root), "body", F.lit("</core:CityModel>")).alias("value"))
    documents.repartition("mesh").write.partitionBy("mesh").text(path)


def _building() -> Column:
    lat, lon, side = F.lit(35.1) + F.col("c_custkey") % 100 / 1000, F.lit(136.8) + F.floor(F.col("c_custkey") / 100) % 100 / 1000, 0.0004
    ring = [(0, 0), (0, side), (side, side), (side, 0)]
    places = F.concat_ws(" ", *[F.format_string("%.6f", v + d) for y, x in ring for v, d in ((lat, y), (lon, x))])
    height = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit('<bldg:measuredHeight uom="m">'), (F.col("c_custkey") % 90 + 3).cast("string"), F.lit("</bldg:measuredHeight>"))).otherwise("")
    around = "<bldg:lod0FootPrint><gml:MultiSurface><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>{}</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></bldg:lod0FootPrint></bldg:Building>"
    begin, end = around.split("{}")
    return F.concat(F.lit('<bldg:Building gml:id="'), F.col("c_custkey").cast("string"), F.lit('">'), height, F.lit(begin), places, F.lit(end)).alias("value")


@query("""+ b AS (SELECT c_custkey AS k, 35.1 + c_custkey % 100 / 1000.0 AS y, 136.8 + floor(c_custkey / 100) % 100 / 1000.0 AS x FROM customer WHERE c_custkey % 7 <> 0),
    p AS (SELECT k, (x + 180) / 360.0 * 32768 * 256 - 28830 * 256 AS x0, (x + 0.0004 + 180) / 360.0 * 32768 * 256 - 28830 * 256 AS x1,
      (1 - asinh(tan(radians(y + 0.0004))) / pi()) / 2 * 32768 * 256 - 12945 * 256 AS y0, (1 - asinh(tan(radians(y))) / pi()) / 2 * 32768 * 256 - 12945 * 256 AS y1 FROM b),
    n AS (SELECT k, CAST(ceil(y0 - 0.5) AS BIGINT) AS r0, CAST(ceil(y1 - 0.5) AS BIGINT) AS r1, CAST(ceil(x0 - 0.5) AS BIGINT) AS c0, CAST(ceil(x1 - 0.5) AS BIGINT) AS c1 FROM p)
    SELECT r, c, CAST(arg_max((k % 90 + 3) * 100, k) AS BIGINT) AS height_cm FROM (SELECT k, c0, c1, unnest(range(r0, r1)) AS r FROM n), LATERAL (SELECT unnest(range(c0, c1)) AS c) GROUP BY r, c""".replace("+ b", "WITH b"))
def jon15_city_raster(spark: SparkSession, sf: str) -> DataFrame:
    """The chain from CityGML to pixels. Places repeat every 10,000 buildings; the one in the later mesh counts."""
    path = _folder(spark)
    _write_city(spark.read.parquet(f"{sf}/customer.parquet"), path)
    return footprints.rasterised(footprints.in_pixels(buildings(spark, path), 28830, 12945))
