"""Column formulas of channels, depths, backscatter and their integer encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Width and depth against drained area (km2), roughness, run-off share, least slope.
WIDTH, WIDTH_POWER, DEPTH, DEPTH_POWER = 2.5, 0.5, 0.3, 0.4
ROUGHNESS, RUNOFF, LEAST_SLOPE = 0.035, 0.65, 1e-4


def decibel(power: Column, floor: float = 1e-9) -> Column:
    return 10.0 * F.log10(F.greatest(power, F.lit(floor)))


def at_least(col: Column, threshold: float) -> Column:
    """A mask in which a missing value is false: flooded from a depth of 0.10 m, water from a fraction of 0.5."""
    return F.coalesce(col >= threshold, F.lit(False))


def channel_width(area_m2: Column) -> Column:
    return WIDTH * F.pow(area_m2 / 1e6, F.lit(WIDTH_POWER))


def channel_depth(area_m2: Column) -> Column:
    return DEPTH * F.pow(area_m2 / 1e6, F.lit(DEPTH_POWER))


def path_velocity(slope: Column) -> Column:
    """1.5 m/s at a slope of 1 %, with its square root, between 0.3 and 3."""
    return F.least(F.greatest(1.5 * F.sqrt(F.greatest(slope, F.lit(1e-6)) / 0.01), F.lit(0.3)), F.lit(3.0))


def overflow_depth(rate_mm_h: Column, area_m2: Column, width_m: Column, slope: Column, depth_m: Column) -> Column:
    """What rational discharge, as a Manning stage, exceeds the bankfull depth by."""
    discharge = RUNOFF * (rate_mm_h / 1000.0 / 3600.0) * area_m2
    stage = F.pow(discharge * ROUGHNESS / F.greatest(width_m * F.sqrt(slope), F.lit(1e-9)), F.lit(0.6))
    return F.greatest(stage - depth_m, F.lit(0.0))


def velocity(flux: Column, depth: Column, least: float = 0.02) -> Column:
    """Flux over depth; NULL where it is nearly dry."""
    return F.when(depth >= least, flux / depth)


def clip(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def rain_count(mm_h: Column) -> Column:
    """Half millimetres an hour as 0 to 255, half to even."""
    return clip(F.rint(mm_h / 0.5), 0.0, 255.0).cast("int")


def elevation_bytes(metres: Column, down: bool = False) -> Column:
    """Struct r, g, b of centimetres, rounded half to even (or down); below zero is 0."""
    cm = clip(F.floor(clip(metres * 100.0, 0.0, float(2**24 - 1))) if down else F.rint(metres * 100.0), 0.0, float(2**24 - 1)).cast("bigint")
    return _three_bytes(cm)


def height_bytes(cm: Column) -> Column:
    """Struct r, g of a building height of 0 to 25000 cm."""
    v = F.least(F.greatest(cm, F.lit(0)), F.lit(25000)).cast("bigint")
    return F.struct(F.shiftright(v, 8).bitwiseAND(255).cast("int").alias("r"), v.bitwiseAND(255).cast("int").alias("g"))


def _three_bytes(v: Column) -> Column:
    at = lambda s: F.shiftright(v, s).bitwiseAND(255).cast("int")
    return F.struct(at(16).alias("r"), at(8).alias("g"), at(0).alias("b"))


def depth_byte(metres: Column) -> Column:
    return F.floor(clip(metres * 100.0, 0.0, 255.0)).cast("int")


def flux_byte(flux: Column) -> Column:
    return F.floor(clip(flux * 100.0 + 128.0, 0.0, 255.0)).cast("int")


def stream_weight(acc: Column, threshold: float = 800.0) -> Column:
    """0 to 255 for 1 to 12 times the threshold."""
    return F.floor(clip(acc / threshold, 1.0, 12.0) / 12.0 * 255.0).cast("int")


def clock(seconds: Column) -> Column:
    """+H:MM."""
    return F.format_string("+%d:%02d", F.floor(seconds / 3600).cast("int"), F.floor(F.pmod(seconds, F.lit(3600.0)) / 60).cast("int"))


#: The minutes from a slot at which its stamp is looked for, in order.
SLOT_OFFSETS = (0, 1, 2, -1, -2, 3, -3)


def slot_stamps(minute: Column) -> Column:
    """HHMM stamps to try for a slot, in order; those before midnight are left out."""
    tried = F.filter(F.transform(F.array(*map(F.lit, SLOT_OFFSETS)), lambda d: (minute + d).cast("int")), lambda m: m >= 0)
    return F.transform(tried, lambda m: F.format_string("%02d%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int")))
