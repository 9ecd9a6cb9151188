"""Hourly model grids calibrated with a gauge and resampled to points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverine.operators.drainage import counted

#: The gauge's place, the step of the model's grid and the largest factor.
GAUGE_LAT, GAUGE_LON = 35.17, 136.90
GRID_STEP = 0.05
MOST_FACTOR = 150.0


def nearest_index(axis: DataFrame, idx: str, place: str, target: float) -> DataFrame:
    """One row: the index of the axis place nearest to target, the first of equals."""
    return axis.select(idx, place).distinct().agg(F.min(F.struct(F.abs(F.col(place) - target).alias("d"), F.col(idx).alias("i")))["i"].alias(idx))


def hourly_factors(model: DataFrame, observed: DataFrame, lat: float = GAUGE_LAT, lon: float = GAUGE_LON) -> DataFrame:
    """day, hour, observed, most, factor. model: day, hour, iy, ix, lat, lon, mm_h; observed: day, hour, mm.

    A dry or missing observation gives 0, a model below 0.1 at the gauge 1, else observed / model, 150 at most.
    """
    at = F.broadcast(nearest_index(model, "iy", "lat", lat).crossJoin(nearest_index(model, "ix", "lon", lon)))
    gauge = model.join(at, ["iy", "ix"]).select("day", "hour", F.col("mm_h").alias("modelled"))
    most = model.groupBy("day", "hour").agg(F.max("mm_h").alias("most"))
    both = gauge.join(most, ["day", "hour"]).join(observed, ["day", "hour"], "left").withColumn("observed", F.coalesce("mm", F.lit(0.0)))
    factor = F.when(F.col("observed") <= 0, F.lit(0.0)).when(F.col("modelled") < 0.1, F.lit(1.0)).otherwise(F.least(F.col("observed") / F.col("modelled"), F.lit(MOST_FACTOR)))
    return both.select("day", "hour", "observed", "most", factor.alias("factor"))


def brackets(targets: DataFrame, axis: DataFrame, idx: str, place: str, value: str, step: float = GRID_STEP) -> DataFrame:
    """targets with <idx>_lo, <idx>_hi, <idx>_w: the axis places around value and the weight of the upper one.

    Axes have a few hundred places and are broadcast by size. Beyond the ends the weight stays with the end.
    """
    places = axis.select(F.col(idx).alias("__i"), F.col(place).alias("__p")).distinct()
    by = Window.orderBy("__p")
    cells = places.select("__i", "__p", F.lead("__i").over(by).alias("__j"), F.lead("__p").over(by).alias("__q"), F.lag("__i").over(by).isNull().alias("__first"))
    inside = (F.col(value) >= F.col("__p")) | F.col("__first")
    below = F.col("__q").isNull() | (F.col(value) < F.col("__q"))
    joined = targets.join(F.broadcast(cells), inside & below, "left")
    weight = F.when(F.col("__q").isNull(), F.lit(0.0)).otherwise(F.least(F.greatest((F.col(value) - F.col("__p")) / (F.col("__q") - F.col("__p")), F.lit(0.0)), F.lit(1.0)))
    return joined.select(*targets.columns, F.col("__i").alias(f"{idx}_lo"), F.coalesce("__j", "__i").alias(f"{idx}_hi"), weight.alias(f"{idx}_w"))


def packed(grid: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, iy_lo, ix_lo and the values at the four corners of a model cell: v_ll, v_lh, v_hl, v_hh (y first), NULL without one.

    The last place of an axis is its own upper one. Only the grid is exchanged, which is small beside its targets.
    """
    spread = grid.select(*keys, "iy", "ix", F.col(value).alias("__v"))
    for idx, place in (("iy", "lat"), ("ix", "lon")):
        axis = grid.select(F.col(idx).alias("i"), F.col(place).alias("p")).distinct().select("i", F.coalesce(F.lead("i").over(Window.orderBy("p")), "i").alias("j"))
        sides = axis.select(F.col("i").alias(idx), F.col("i").alias(f"{idx}_lo"), F.lit("l").alias(f"{idx}_side")).unionByName(axis.select(F.col("j").alias(idx), F.col("i").alias(f"{idx}_lo"), F.lit("h").alias(f"{idx}_side")))
        spread = spread.join(F.broadcast(sides), idx)
    corner = lambda a, b: F.max(F.when((F.col("iy_side") == a) & (F.col("ix_side") == b), F.col("__v"))).alias(f"v_{a}{b}")
    return spread.groupBy(*keys, "iy_lo", "ix_lo").agg(*[corner(a, b) for a in "lh" for b in "lh"])


def _weighed(missing: float | None) -> Column:
    """The bilinear mean of packed corners; corners without weight don't count, missing ones count as `missing`."""
    total = None
    for a in "lh":
        for b in "lh":
            share = (F.col("iy_w") if a == "h" else 1 - F.col("iy_w")) * (F.col("ix_w") if b == "h" else 1 - F.col("ix_w"))
            part = F.when(share > 0, share * F.coalesce(F.col(f"v_{a}{b}"), F.lit(missing))).otherwise(F.lit(0.0))
            total = part if total is None else total + part
    return total


def resample(targets: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """keys, point and mm_h of every target (point, lat, lon) for every key: bilinear, flat outside, never negative.

    Brackets of a target are found once. Model cells carry their four corners and are broadcast if their counted rows
    are few, so that targets are neither exchanged nor grouped.
    """
    placed = brackets(brackets(targets, model, "iy", "lat", "lat"), model, "ix", "lon", "lon")
    cells = counted(packed(model, keys, "mm_h"))
    return placed.join(cells, ["iy_lo", "ix_lo"]).select(*keys, "point", F.greatest(_weighed(0.0), F.lit(0.0)).alias("mm_h"))


def calibrated(targets: DataFrame, model: DataFrame, observed: DataFrame) -> DataFrame:
    """day, hour, point, mm_h: 0 where the gauge is dry, the observed rate where the model's hour is, else the scaled field resampled."""
    factors = counted(hourly_factors(model, observed))
    scaled = model.join(factors.where("factor > 0 AND most >= 0.1"), ["day", "hour"]).withColumn("mm_h", F.col("mm_h") * F.col("factor"))
    uniform = counted(factors.where("factor = 0 OR most < 0.1").select("day", "hour", F.when(F.col("factor") == 0, F.lit(0.0)).otherwise(F.col("observed")).alias("mm_h")))
    return resample(targets, scaled, ["day", "hour"]).unionByName(targets.select("point").crossJoin(uniform).select("day", "hour", "point", "mm_h"))


def sample_bilinear(targets: DataFrame, raster: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, point and value at targets (point, y, x) of every raster (keys, iy, ix, y, x, value) on one regular grid; NULL outside or beside a missing value."""
    keys = keys or []
    box = raster.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    inside = targets.crossJoin(F.broadcast(box)).withColumn("__in", F.expr("y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1")).select("point", "y", "x", "__in")
    grid = raster.select(*keys, "iy", "ix", F.col("y").alias("lat"), F.col("x").alias("lon"), F.col("value"))
    asked = brackets(brackets(inside, grid, "iy", "lat", "y"), grid, "ix", "lon", "x")
    if keys:
        asked = asked.crossJoin(counted(raster.select(*keys).distinct()))
    cells = counted(packed(grid, keys, "value"))
    return asked.join(cells, [*keys, "iy_lo", "ix_lo"], "left").select(*keys, "point", F.when(F.col("__in"), _weighed(None)).alias("value"))
