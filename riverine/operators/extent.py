"""Modelled flood extent against satellite water."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverine.functions.hydraulics import at_least, decibel


def nearest_cells(pixels: DataFrame, keys: list[str], height: int, width: int, order: str = "pixel") -> DataFrame:
    """keys, r, c, value: pixels (x, y, value) at their nearest cell (half to even), the last pixel of a cell; missing values don't count."""
    at = pixels.withColumn("c", F.rint("x").cast("bigint")).withColumn("r", F.rint("y").cast("bigint"))
    inside = at.where(F.col("value").isNotNull() & F.col("c").between(0, width - 1) & F.col("r").between(0, height - 1))
    return inside.groupBy(*keys, "r", "c").agg(F.max_by("value", order).alias("value"))


def cell_pixels(pixels: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """keys, r, c, pixel: the pixel that each cell belongs to."""
    named = pixels.withColumn("value", F.col("pixel"))
    return nearest_cells(named, keys, height, width).withColumnRenamed("value", "pixel")


def change(pairs: DataFrame, drop_db: float = -3.0, least_pre_db: float = -25.0) -> DataFrame:
    """pairs (pre, post) with darkened: a fall of 3 dB or more from at least -25 dB; missing is false."""
    fell = (decibel(F.col("post")) - decibel(F.col("pre")) <= drop_db) & (decibel(F.col("pre")) >= least_pre_db)
    return pairs.withColumn("darkened", F.coalesce(fell & F.col("pre").isNotNull() & F.col("post").isNotNull(), F.lit(False)))


def brightening(pairs: DataFrame, rise_db: float = 3.0) -> DataFrame:
    rose = decibel(F.col("post")) - decibel(F.col("pre")) > rise_db
    return pairs.withColumn("brightened", F.coalesce(rose & F.col("pre").isNotNull() & F.col("post").isNotNull(), F.lit(False)))


#: Cells of a row that one word of a packed mask holds.
WORD = 64


def packed(cells: DataFrame, by: list[str], masks: dict[str, Column]) -> DataFrame:
    """by, r, w and a word of 64 bits a mask: bit c % 64 of word w = c div 64 is set where the mask holds at column c of row r.

    Bits are or-ed before the exchange, so that a row of 64 cells travels as one row; words without a bit are left out.
    """
    bit = F.expr(f"shiftleft(1L, cast(c % {WORD} AS int))")
    words = [F.coalesce(F.bit_or(F.when(mask, bit)), F.lit(0).cast("bigint")).alias(name) for name, mask in masks.items()]
    any_ = reduce(lambda a, b: a | b, [F.coalesce(m, F.lit(False)) for m in masks.values()])
    return cells.where(any_).groupBy(*by, F.col("r").cast("bigint").alias("r"), F.floor(F.col("c") / WORD).alias("w")).agg(*words)


def _met(model: DataFrame, satellite: DataFrame, by: list[str]) -> DataFrame:
    return model.join(satellite, [*by, "r", "w"], "full").na.fill(0)


def compared(model: DataFrame, satellite: DataFrame, by: list[str], depth: float = 0.10, fraction: float = 0.5) -> DataFrame:
    """by, r, w, m, s: packed masks of what the model (h_max) floods and the satellite (value) calls water; what is absent is dry."""
    return _met(packed(model, by, {"m": at_least(F.col("h_max"), depth)}), packed(satellite, by, {"s": at_least(F.col("value"), fraction)}), by)


def _counts(m: str, s: str) -> dict[str, Column]:
    each = {"tp": f"{m} & {s}", "fp": f"{m} & ~{s}", "fn": f"~{m} & {s}", "model_cells": m, "sat_cells": s}
    return {n: F.sum(F.bit_count(F.expr(e)).cast("bigint")) for n, e in each.items()}


def _with_rest(counts: DataFrame, grids: DataFrame, by: list[str]) -> DataFrame:
    """Counts with tn: what else the grid (by, height, width) has. A grid without any flooded cell is all tn."""
    full = grids.join(counts, by, "left").na.fill(0, ["tp", "fp", "fn", "model_cells", "sat_cells"])
    return full.withColumn("tn", F.col("height") * F.col("width") - F.col("tp") - F.col("fp") - F.col("fn")).drop("height", "width")


def confusion(masks: DataFrame, grids: DataFrame, by: list[str]) -> DataFrame:
    """by, tp, fp, fn, model_cells, sat_cells and tn over the whole grid of each group, by counting bits. Cells have to lie on their grid."""
    return _with_rest(masks.groupBy(*by).agg(*[c.alias(n) for n, c in _counts("m", "s").items()]), grids, by)


def scores(counts: DataFrame) -> DataFrame:
    """counts with precision, recall and f1; NULL where a denominator is 0."""
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def sweep(model: DataFrame, satellite: DataFrame, grids: DataFrame, by: list[str], thresholds: tuple[float, ...] = (0.3, 0.5, 0.7), depth: float = 0.10) -> DataFrame:
    """Confusion counts and scores by water-fraction threshold: a packed mask each, all from one join."""
    water = packed(satellite, by, {f"s{i}": at_least(F.col("value"), t) for i, t in enumerate(thresholds)})
    both = _met(packed(model, by, {"m": at_least(F.col("h_max"), depth)}), water, by)
    counts = both.groupBy(*by).agg(*[c.alias(f"{n}_{i}") for i in range(len(thresholds)) for n, c in _counts("m", f"s{i}").items()])
    names = list(_counts("m", "s0"))
    each = [F.struct(F.lit(t).alias("threshold"), *[F.coalesce(f"{n}_{i}", F.lit(0)).alias(n) for n in names]) for i, t in enumerate(thresholds)]
    rows = grids.join(counts, by, "left").select(*by, "height", "width", F.explode(F.array(*each)).alias("x")).select(*by, "height", "width", "x.*")
    return scores(rows.withColumn("tn", F.col("height") * F.col("width") - F.col("tp") - F.col("fp") - F.col("fn")).drop("height", "width"))


def footprint_fractions(cells: DataFrame, ids: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, pixel and the flooded share of the cells (keys, m) that belong to each pixel (keys, pixel)."""
    return ids.join(cells.select(*keys, "m"), keys).groupBy(*by, "pixel").agg(F.avg(F.col("m").cast("double")).alias("fraction"))


def footprint_correlation(fractions: DataFrame, pixels: DataFrame, by: list[str]) -> DataFrame:
    """r and n by group; r is NaN where a side is constant, for which Spark's corr divides by zero."""
    both = fractions.join(pixels.select(*by, "pixel", "value"), [*by, "pixel"])
    x, y = F.when(F.col("value").isNotNull(), F.col("fraction")), F.when(F.col("fraction").isNotNull(), F.col("value"))
    sums = both.groupBy(*by).agg(F.covar_pop("fraction", "value").alias("__cov"), (F.stddev_pop(x) * F.stddev_pop(y)).alias("__dev"), F.count(F.lit(1)).alias("n"))
    return sums.select(*by, F.when(F.col("__dev") > 0, F.col("__cov") / F.col("__dev")).when(F.col("__dev") == 0, float("nan")).alias("r"), "n")


def new_water(after: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of after that aren't in before."""
    return after.select(*keys).distinct().join(before.select(*keys).distinct(), keys, "left_anti")


def agreement(masks: DataFrame, by: list[str]) -> DataFrame:
    """by, r, c of the cells that both masks have."""
    both = masks.where("(m & s) <> 0")
    return _cells(both, by).where(F.expr("getbit(m & s, b) = 1")).select(*by, "r", "c")


def _cells(words: DataFrame, by: list[str]) -> DataFrame:
    """A row a bit (b, at column c) of each word."""
    return words.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1)))).withColumn("c", F.col("w") * WORD + F.col("b"))


def overlay(masks: DataFrame, grids: DataFrame, by: list[str]) -> DataFrame:
    """by, r, c, m, s and kind of every cell of the grids (by, height, width): in both masks, one, or neither."""
    last = F.floor((F.col("width") - 1) / WORD)
    words = grids.withColumn("r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height").cast("bigint") - 1))).withColumn("w", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    cells = _cells(words.join(masks, [*by, "r", "w"], "left").na.fill(0, ["m", "s"]), by).where(F.col("c") < F.col("width"))
    flags = cells.select(*by, "r", "c", *[F.expr(f"getbit({k}, b) = 1").alias(k) for k in ("m", "s")])
    kind = F.when(F.col("m") & F.col("s"), "both").when(F.col("s"), "satellite").when(F.col("m"), "model").otherwise("neither")
    return flags.withColumn("kind", kind)
