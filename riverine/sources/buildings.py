"""Buildings of CityGML files, by Spark's XML source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverine.sources.landing import height_cm, positions

_LIST = T.StructType([T.StructField("gml:LinearRing", T.StructType([T.StructField("gml:posList", T.StringType())]))])
_POLYGON = T.StructType([T.StructField("gml:exterior", _LIST), T.StructField("gml:interior", T.ArrayType(_LIST))])
_MEMBER = T.StructType([T.StructField("gml:Polygon", _POLYGON)])
_FOOTPRINT = T.StructType([T.StructField("gml:MultiSurface", T.StructType([T.StructField("gml:surfaceMember", T.ArrayType(_MEMBER))]))])
SCHEMA = T.StructType([
    T.StructField("_gml:id", T.StringType()),
    T.StructField("bldg:measuredHeight", T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_uom", T.StringType())])),
    T.StructField("bldg:lod0FootPrint", _FOOTPRINT),
])


def buildings(spark: SparkSession, path: str) -> DataFrame:
    """file (its path), seq, id, height_cm, ring of the position lists in the ground-level footprints of buildings with a numeric height.

    Holes are rings of their own, as every list is painted. seq grows along a file (not by one): a building's place
    is where its split begins plus its row in the task, which stays below the split's bytes; its lists follow, up to 65536.
    """
    rows = spark.read.format("xml").option("rowTag", "bldg:Building").schema(SCHEMA).load(path)
    place = F.col("_metadata.file_block_start") + F.expr("monotonically_increasing_id() & 8589934591")
    named = rows.select(F.col("_metadata.file_path").alias("file"), place.alias("place"), F.col("`_gml:id`").alias("id"), F.expr("try_cast(`bldg:measuredHeight`._VALUE AS double)").alias("m"), F.col("`bldg:lod0FootPrint`.`gml:MultiSurface`.`gml:surfaceMember`").alias("members")).where("m IS NOT NULL")
    polygons = named.select("file", "place", "id", "m", F.transform("members", lambda s: s["gml:Polygon"]).alias("ps"))
    outer = lambda p: F.array(p["gml:exterior"]["gml:LinearRing"]["gml:posList"])
    inner = lambda p: F.coalesce(F.transform(p["gml:interior"], lambda i: i["gml:LinearRing"]["gml:posList"]), F.array().cast("array<string>"))
    texts = F.flatten(F.transform("ps", lambda p: F.concat(outer(p), inner(p))))
    lists = polygons.select("file", "place", "id", "m", F.posexplode(texts).alias("n", "text")).where("text IS NOT NULL")
    seq = F.shiftleft("place", 16) + F.col("n")
    return positions(lists).where("ring IS NOT NULL").select("file", seq.alias("seq"), "id", height_cm(F.col("m")).alias("height_cm"), "ring")
