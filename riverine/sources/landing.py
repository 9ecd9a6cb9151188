"""Landed files as tables: gauge pages, model grids, meshes, elevation tiles, replay documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gauge_pages(pages: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """keys, hour, mm of complete pages (keys, html), and the keys of pages without 24 hours.

    A row counts if its first cell is a number of 1 to 24 once white space is stripped; the fourth cell holds the
    value, NULL if it isn't a number; the last row of an hour wins.
    """
    rows = pages.select(*keys, F.posexplode(F.split("html", "</tr>")).alias("pos", "row"))
    texts = F.transform(F.split("row", "</td>"), lambda c: F.regexp_replace(c, "(?s)^.*<td[^>]*>", ""))
    cells = rows.select(*keys, "pos", F.slice(texts, 1, F.size(texts) - 1).alias("cells")).where("size(cells) > 3")  # what follows the last cell is none
    first = F.regexp_replace(F.get("cells", 0), r"\s", "")
    hours = cells.where(first.rlike("^[0-9]+$")).withColumn("hour", first.try_cast("int")).where("hour BETWEEN 1 AND 24")
    bare = F.array_join(F.transform(F.split(F.get("cells", 3), "<"), lambda x: F.substring_index(x, ">", -1)), "")  # without tags
    value = F.trim(bare).try_cast("double")
    last = hours.groupBy(*keys, "hour").agg(F.max_by(F.struct(value.alias("v")), "pos")["v"].alias("mm"))
    full = last.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n = 24").drop("n")
    return last.join(full, keys).select(*keys, "hour", "mm"), pages.select(*keys).join(full, keys, "left_anti")


POINTS = "ARRAY<STRUCT<latitude: DOUBLE, longitude: DOUBLE, hourly: STRUCT<precipitation: ARRAY<DOUBLE>>>>"


def model_grids(responses: DataFrame, key: str = "day") -> tuple[DataFrame, DataFrame]:
    """key, hour, lat, lon, mm_h of responses (key, body) whose points all have 24 values, and the keys of the others.

    A missing value is 0; of entries with the same place the last counts.
    """
    entries = responses.select(key, F.posexplode(F.from_json("body", POINTS)).alias("pos", "p"))
    checked = entries.withColumn("n", F.coalesce(F.size("p.hourly.precipitation"), F.lit(-1)))
    good = checked.groupBy(key).agg(F.min(F.col("n") == 24).alias("good")).where("good").select(key)
    last = checked.join(good, key).groupBy(key, F.col("p.latitude").alias("lat"), F.col("p.longitude").alias("lon")).agg(F.max_by("p.hourly.precipitation", "pos").alias("values"))
    cells = last.select(key, "lat", "lon", F.posexplode("values").alias("i", "v"))
    return cells.select(key, (F.col("i") + 1).alias("hour"), "lat", "lon", F.coalesce("v", F.lit(0.0)).alias("mm_h")), responses.select(key).join(good, key, "left_anti")


MESH = "STRUCT<areaInfo: ARRAY<STRUCT<seq: INT, areaCd: INT, meshFrom: INT, meshTo: INT>>>"


def mesh_master(responses: DataFrame) -> DataFrame:
    """seq, area, mesh_from, mesh_to of a master document (body)."""
    return responses.select(F.explode(F.from_json("body", MESH)["areaInfo"]).alias("a")).select("a.seq", F.col("a.areaCd").alias("area"), F.col("a.meshFrom").alias("mesh_from"), F.col("a.meshTo").alias("mesh_to"))


def elevation_tiles(files: DataFrame, size: int = 256) -> tuple[DataFrame, DataFrame]:
    """tile_x, tile_y, r, c, elev of text tiles (path, value), and path and reason of those that don't fit.

    Rows of at least `size` comma-separated values, further ones dropped; e is a void (NULL); an empty file has no cells.
    """
    named = files.select("path", F.regexp_extract("path", r"(\d+)_(\d+)\.txt$", 1).cast("int").alias("tile_x"), F.regexp_extract("path", r"(\d+)_(\d+)\.txt$", 2).cast("int").alias("tile_y"), F.filter(F.split("value", r"\r?\n"), lambda l: F.trim(l) != "").alias("rows"))
    split = named.where("size(rows) > 0").withColumn("rows", F.transform("rows", lambda l: F.split(l, ",")))
    short = F.exists("rows", lambda v: F.size(v) < size)
    reason = F.when(F.size("rows") != size, "wrong number of rows").when(short, "short row")
    cells = split.where(reason.isNull()).select("tile_x", "tile_y", F.posexplode("rows").alias("r", "row")).select("tile_x", "tile_y", "r", F.posexplode(F.slice("row", 1, size)).alias("c", "v"))
    return cells.select("tile_x", "tile_y", "r", "c", F.expr("try_cast(v AS double)").alias("elev")), split.where(reason.isNotNull()).select("path", reason.alias("reason"))


REPLAY = "scenario STRING, interval DOUBLE, grid STRUCT<w: INT, h: INT, dx: DOUBLE>, bounds_px STRUCT<left: INT, top: INT, w: INT, h: INT>, origin STRUCT<lon: DOUBLE, lat: DOUBLE>, times ARRAY<DOUBLE>, series ARRAY<ARRAY<DOUBLE>>"


def replay_series(documents: DataFrame) -> DataFrame:
    """dir, t_s, mm_h of replay documents (dir, body)."""
    parsed = documents.select("dir", F.from_json("body", REPLAY).alias("m"))
    return parsed.select("dir", F.explode("m.series").alias("p")).select("dir", F.col("p")[0].alias("t_s"), F.col("p")[1].alias("mm_h"))


def replay_metadata(documents: DataFrame) -> DataFrame:
    """A row a replay document (dir, body): scenario, interval, the grid's size and cell, its box and the pixels a cell has, where it begins, and the times."""
    m = documents.select("dir", F.from_json("body", REPLAY).alias("m"))
    return m.select(
        "dir", "m.scenario", F.col("m.interval").alias("interval_s"), "m.grid.w", "m.grid.h", "m.grid.dx", F.col("m.bounds_px.left").alias("left_px"), F.col("m.bounds_px.top").alias("top_px"),
        F.col("m.bounds_px.w").alias("width_px"), F.col("m.bounds_px.h").alias("height_px"), F.col("m.origin.lon").alias("lon0"), F.col("m.origin.lat").alias("lat0"),
        F.try_divide(F.col("m.bounds_px.w").cast("double"), F.col("m.grid.w")).alias("downsample"), "m.times",
    )


def without_fill(pixels: DataFrame, value: str, most: float = 1e30) -> DataFrame:
    """Fill values, larger than `most` either way, become NULL."""
    return pixels.withColumn(value, F.when(F.abs(F.col(value)) <= most, F.col(value)))


def positions(lists: DataFrame) -> DataFrame:
    """lists (text) with ring: points (lat, lon) of a position list, NULL if there are fewer than 4 numbers or 3 points.

    Every third value is a height if the numbers divide by 3 and all of those are finite, above -100 and below 5000.
    """
    numbers = F.transform(F.filter(F.split(F.trim("text"), r"\s+"), lambda v: v != ""), lambda v: F.expr("0D") + v.cast("double"))
    got = lists.withColumn("__n", numbers)
    third = F.transform(F.sequence(F.lit(3), F.greatest(F.size("__n"), F.lit(3)), F.lit(3)), lambda i: F.try_element_at("__n", i))
    solid = (F.size("__n") % 3 == 0) & (F.size("__n") > 0) & F.coalesce((F.array_min(third) > -100) & (F.array_max(third) < 5000), F.lit(False))
    got = got.withColumn("__s", F.when(solid, 3).otherwise(2))
    starts = F.sequence(F.lit(1), F.greatest(F.size("__n") - 1, F.lit(1)), F.col("__s"))
    ring = F.transform(starts, lambda i: F.struct(F.try_element_at("__n", i).alias("lat"), F.try_element_at("__n", i + 1).alias("lon")))
    return got.withColumn("ring", F.when((F.size("__n") >= 4) & (F.size(ring) >= 3), ring)).drop("__n", "__s")


def height_cm(metres: F.Column) -> F.Column:
    return F.least(F.rint(metres * 100), F.lit(32000.0)).cast("int")
