"""Depth frames as image files with a manifest, and what reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverine.operators import frames as ops
from riverine.sources import tiles

#: Layers of a set: a region's frames, and its maxima so far.
FRAMES, MAXIMA = "r", "max"


def _layer(prefix: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col("region").cast("string"))


def _region(prefix: str) -> F.Column:
    return F.expr(f"CAST(substr(layer, {len(prefix) + 1}) AS BIGINT)")


def frame_images(frames: DataFrame, height: int, width: int) -> DataFrame:
    """An image a region and frame (x): bytes of depth and of both fluxes."""
    coded = ops.encoded(frames).join(frames.select("region", "frame", "t_s").distinct(), ["region", "frame"])
    return tiles.images_of(coded.select(_layer(FRAMES).alias("layer"), F.col("frame").alias("x"), F.lit(0).alias("y"), "t_s", "r", "c", "red", "green", "blue"), ["red", "green", "blue"], height, width)


def maximum_images(frames: DataFrame, height: int, width: int) -> DataFrame:
    """A grey image a region and frame (x): the deepest so far of every cell, in centimetres up to 255."""
    times = frames.select("region", F.col("frame").alias("x"), F.col("t_s").alias("at")).distinct()
    firsts = ops.running_maximum(frames).select("region", "r", "c", "frame", "h_max")  # a cell's maxima at its own frames
    so_far = firsts.join(times, "region").where("frame <= x").groupBy("region", "x", "at", "r", "c").agg(F.max_by("h_max", "frame").alias("h"))
    grey = F.floor(F.least(F.greatest(F.col("h") * 100, F.lit(0.0)), F.lit(255.0))).cast("int")
    return tiles.images_of(so_far.select(_layer(MAXIMA).alias("layer"), "x", F.lit(0).alias("y"), F.col("at").alias("t_s"), "r", "c", grey.alias("grey")), ["grey"], height, width)


def read_frames(spark: SparkSession, path: str, regions: list[int] | None = None, frames: tuple[int, int] | None = None) -> DataFrame:
    """region, frame, r, c, h, qe, qs of the frames of some regions, ends included; other files stay closed."""
    layers = None if regions is None else [f"{FRAMES}{k}" for k in regions]
    pixels = tiles.read_tiles(spark, path, layers, frames).where(F.col("layer").rlike(f"^{FRAMES}[0-9]+$"))
    return ops.decoded(pixels.select(_region(FRAMES).alias("region"), F.col("x").alias("frame"), "r", "c", "red", "green", "blue"))


def last_maxima(spark: SparkSession, path: str) -> DataFrame:
    """region, r, c, h_max of each region's last image of maxima; only those are opened."""
    listed = tiles.read_tiles(spark, path, listed=True).where(F.col("layer").startswith(MAXIMA))
    last = listed.groupBy("layer").agg(F.max("x").alias("x")).groupBy("x").agg(F.collect_list("layer").alias("layers")).collect()  # a row a region at most
    pixels = [tiles.read_tiles(spark, path, sorted(k.layers), (k.x, k.x)) for k in last]
    if not pixels:
        return spark.createDataFrame([], "region bigint, r bigint, c bigint, h_max double")
    out = pixels[0]
    for more in pixels[1:]:
        out = out.unionByName(more)
    return out.select(_region(MAXIMA).alias("region"), "r", "c", (F.col("red") / 100.0).alias("h_max"))


def export_frames(frames: DataFrame, stats: DataFrame, bounds: DataFrame, path: str, every: int, height: int, width: int) -> DataFrame:
    """Writes the key frames as images and returns a row a region: n_frames, files, first_s, last_s and the columns of bounds (region, ...).

    The files stand in a set that is visible only once all of them and the manifest are written, so a failed export
    leaves the one before. Files and times come from the lists that the tasks wrote.
    """
    chosen = ops.export_set(frames, stats, every)[0]
    tiles.write_images(frame_images(chosen, height, width), path)
    listed = tiles.read_tiles(frames.sparkSession, path, listed=True)
    rows = listed.groupBy(_region(FRAMES).alias("region")).agg(
        F.count(F.lit(1)).alias("n_frames"), F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"),  # key frames of a region
        F.min("t_s").alias("first_s"), F.max("t_s").alias("last_s"), F.sum("bytes").alias("bytes"),
    )
    return rows.join(bounds, "region")
