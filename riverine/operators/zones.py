"""Zones below ground: which cells they have, what stands on them, and what flows into their tanks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverine.functions.geo import M_PER_DEGREE
from riverine.operators.drainage import counted
from riverine.operators.lookups import covered, placed


def cell_lonlat(r: Column, c: Column, lon: float, lat: float, dx: float) -> tuple[Column, Column]:
    """A local grid from its first cell at lon, lat, where degrees of longitude are shorter by that latitude; rows run south."""
    return lon + c * dx / (M_PER_DEGREE * math.cos(math.radians(lat))), lat - r * dx / M_PER_DEGREE


def in_polygons(cells: DataFrame, zones: DataFrame, lon: float, lat: float, dx: float, side: float = 0.001) -> DataFrame:
    """zone, r, c of the cells within the bounding box of each zone's polygon (array of struct lon, lat), ends included.

    Boxes are covered by cells of a grid of `side` degrees, by which they meet the places that lie in those.
    """
    x, y = cell_lonlat(F.col("r"), F.col("c"), lon, lat, dx)
    place = lambda end, k: end(F.transform("polygon", lambda p: p[k]))
    boxes = zones.select("zone", *[place(end, k).alias(f"{k}_{n}") for k in ("lon", "lat") for end, n in ((F.array_min, "min"), (F.array_max, "max"))])
    found = placed(cells.select("r", "c", x.alias("__x"), y.alias("__y")), F.col("__x"), F.col("__y"), side)
    met = found.join(covered(boxes, ("lon_min", "lon_max"), ("lat_min", "lat_max"), side), ["__bx", "__by"])
    return met.where("__x BETWEEN lon_min AND lon_max AND __y BETWEEN lat_min AND lat_max").select("zone", "r", "c")


#: Cells of the grid by which zones meet rasters.
SIDE = 16


def hits(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """rows (r, c, ...) with the columns of every zone whose box (r0..r1, c0..c1, inclusive) has them."""
    met = placed(rows, F.col("c"), F.col("r"), SIDE).join(covered(zones, ("c0", "c1"), ("r0", "r1"), SIDE), ["__bx", "__by"])
    return met.where("r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1").drop("__bx", "__by")


def in_zones(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """zone, region, r, c of the cells in each zone's box."""
    return hits(cells.select("region", "r", "c").distinct(), zones).select("zone", "region", "r", "c")


def zone_means(frames: DataFrame, zones: DataFrame, dx: float) -> DataFrame:
    """zone, region, frame, t_s, mean_h, cells, area. Depths are summed in whole centimetres."""
    got = hits(frames, zones).groupBy("zone", "region", "frame", "t_s").agg(F.sum(F.round(F.col("h") * 100).cast("bigint")).alias("cm"), F.count(F.lit(1)).alias("cells"))
    return got.select("zone", "region", "frame", "t_s", (F.col("cm") / 100.0 / F.col("cells")).alias("mean_h"), "cells", (F.col("cells") * dx * dx).alias("area"))


#: Fixed value: the share of what stands on a zone that can flow in at a time.
INFLOW_SHARE = 0.5


def step(volume: float, mean_h: float, area: float, dt: float, floor_depth: float, threshold: float, coupling: float) -> float:
    """A tank's volume after dt. It gains by the height above the threshold and loses by its own level below it, both over the
    coupling time; gains keep within what stands on the zone and what fits, losses within what is there."""
    if not area > 0:
        return volume
    gap, room = mean_h - threshold, max(floor_depth * area - volume, 0.0)
    pull = gap * area if gap > 0 else -max(volume, 0.0) * (gap < 0)
    most, least = min(room, INFLOW_SHARE * mean_h * area), -volume
    return min(volume + max(least, min(most, pull * dt / coupling)) if gap else volume, floor_depth * area)


SERIES = "zone bigint, region bigint, t_s double, volume double, depth double"


def storage(means: DataFrame, zones: DataFrame) -> DataFrame:
    """zone, region, t_s, volume, depth: each tank along its series of mean depths, from empty.

    The fold is sequential in one series; series run side by side.
    """

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t_s", kind="stable")
        volume, before, out = 0.0, None, []
        for row in part.itertuples():
            dt = 0.0 if before is None else row.t_s - before
            volume = step(volume, row.mean_h, row.area, dt, row.floor_depth_m, row.threshold_m, row.coupling_s)
            before = row.t_s
            out.append(volume)
        volumes = np.array(out)
        return pd.DataFrame({"zone": part["zone"], "region": part["region"], "t_s": part["t_s"], "volume": volumes, "depth": volumes / part["area"].to_numpy()})

    joined = means.join(counted(zones.select("zone", "floor_depth_m", "threshold_m", "coupling_s")), "zone")
    return joined.groupBy("zone", "region").applyInPandas(fold, SERIES)


def depth_map(stored: DataFrame, cells: DataFrame) -> DataFrame:
    """region, r, c, t_s and the depth below ground of every cell; of overlapping zones the last counts."""
    return cells.join(stored, ["zone", "region"]).groupBy("region", "r", "c", "t_s").agg(F.max_by("depth", "zone").alias("depth"))


