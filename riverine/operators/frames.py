"""Depth frames: statistics, maxima, key frames and encodings. Frames: region, frame, t_s, r, c, h (m), qe, qs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverine.functions.hydraulics import depth_byte, flux_byte
from riverine.operators.lookups import last_before

CELL = ["region", "r", "c"]


def statistics(frames: DataFrame, dx: float) -> DataFrame:
    """Volume and areas deeper than 5, 30 and 100 cm of every frame; volumes are summed in whole centimetres."""
    area = dx * dx
    return frames.groupBy("region", "frame", "t_s").agg(
        (F.sum(F.round(F.col("h") * 100).cast("bigint")) / 100.0 * area).alias("volume"),
        *[(F.count_if(F.col("h") > d) * area).alias(n) for n, d in (("a5", 0.05), ("a30", 0.30), ("a100", 1.00))],
    )


def flooded_share(stats: DataFrame, sizes: DataFrame, dx: float) -> DataFrame:
    """Share of each region (region, cells) that is deeper than 5 cm, by frame."""
    return stats.join(sizes, "region").select("region", "frame", (F.col("a5") / (F.col("cells") * dx * dx)).alias("share"))


def final_maximum(frames: DataFrame) -> DataFrame:
    return frames.groupBy(*CELL).agg(F.max("h").alias("h_max"))


def running_maximum(frames: DataFrame) -> DataFrame:
    """frames with h_max up to each frame."""
    so_far = Window.partitionBy(*CELL).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("h_max", F.max("h").over(so_far))


def wet_age(frames: DataFrame, wet: float = 0.05, never: float = 1e9) -> DataFrame:
    """region, r, c, frame, age: seconds since the cell last turned wet; `never` if it hasn't."""
    by = Window.partitionBy(*CELL).orderBy("frame")
    marked = frames.withColumn("__wet", F.col("h") > wet)
    turned = marked.withColumn("__onset", F.when(F.col("__wet") & ~F.coalesce(F.lag("__wet").over(by), F.lit(False)), F.col("t_s")))
    last = F.last("__onset", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return turned.select(*CELL, "frame", F.coalesce(F.col("t_s") - last, F.lit(never)).alias("age"))


def first_flooded(stats: DataFrame, area: float) -> DataFrame:
    """region and first_s: the first time at which more than `area` m2 are deeper than 5 cm."""
    return stats.where(F.col("a5") > area).groupBy("region").agg(F.min("t_s").alias("first_s"))


def key_frames(stats: DataFrame, every: int) -> DataFrame:
    """region, frame: every `every`-th frame, the first one of the largest flooded area, and the last."""
    regular = stats.where(F.col("frame") % every == 0).select("region", "frame")
    ends = stats.groupBy("region").agg(F.min(F.struct((-F.col("a5")).alias("a"), "frame"))["frame"].alias("peak"), F.max("frame").alias("last"))
    return regular.unionByName(ends.select("region", F.explode(F.array("peak", "last")).alias("frame"))).distinct()


def nearest_frame(at: DataFrame, times: DataFrame, t: str = "t_s") -> DataFrame:
    """at (region, t) with frame: the nearest in time, the later one of a tie. Regions without frames are left out."""
    before = Window.partitionBy("region").orderBy("t_s")
    starts = times.select("region", "frame", ((F.col("t_s") + F.lag("t_s").over(before)) / 2).alias(t))  # halfway from the frame before
    first = times.groupBy("region").agg(F.min_by("frame", "t_s").alias("__first"))
    found = last_before(at, starts, ["region"], ["frame"], t).join(first, "region")
    return found.select(*at.columns, F.coalesce(F.col("__last.frame"), F.col("__first")).alias("frame"))


def covering_frame(at: DataFrame, counts: DataFrame, step_s: float, t: str = "t_s") -> DataFrame:
    """at (region, t) with frame: floor(t / step), within the frames that the region has (region, n)."""
    return at.join(counts, "region").withColumn("frame", F.least(F.greatest(F.floor(F.col(t) / step_s), F.lit(0)), F.col("n") - 1).cast("int")).drop("n")


def encoded(frames: DataFrame) -> DataFrame:
    """region, frame, r, c and three bytes. A cell without a flux to the east (south) takes that of its western (northern) neighbour."""
    east, south = Window.partitionBy("region", "frame", "r").orderBy("c"), Window.partitionBy("region", "frame", "c").orderBy("r")
    full = frames.withColumn("qe", F.coalesce("qe", F.lag("qe").over(east), F.lit(0.0))).withColumn("qs", F.coalesce("qs", F.lag("qs").over(south), F.lit(0.0)))
    return full.select("region", "frame", "r", "c", depth_byte(F.col("h")).alias("red"), flux_byte(F.col("qe")).alias("green"), flux_byte(F.col("qs")).alias("blue"))


def decoded(bytes_: DataFrame) -> DataFrame:
    """The inverse of encoded, to a hundredth."""
    return bytes_.select("region", "frame", "r", "c", (F.col("red") / 100.0).alias("h"), ((F.col("green") - 128) / 100.0).alias("qe"), ((F.col("blue") - 128) / 100.0).alias("qs"))


def flow_blocks(frames: DataFrame, k: int = 16) -> DataFrame:
    """Cells and means of depth and fluxes of k x k blocks; blocks at the edge have fewer cells."""
    block = lambda c: F.floor(F.col(c) / k).alias(f"b{c}")
    return frames.groupBy("region", "frame", block("r"), block("c")).agg(F.count(F.lit(1)).alias("cells"), *[F.avg(x).alias(x) for x in ("h", "qe", "qs")])


def largest_speed(blocks: DataFrame, wet: float = 0.02) -> DataFrame:
    return blocks.groupBy("region", "frame").agg(F.coalesce(F.max(F.when(F.col("h") > wet, F.hypot("qe", "qs") / F.col("h"))), F.lit(0.0)).alias("speed"))


def export_set(frames: DataFrame, stats: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """Cells of the key frames, and one manifest row a region: frames and cells."""
    keys = key_frames(stats, every)
    chosen = frames.join(keys, ["region", "frame"])
    return chosen, chosen.groupBy("region").agg(F.count_distinct("frame").alias("frames"), F.count(F.lit(1)).alias("cells"), F.max("h").alias("deepest"))
