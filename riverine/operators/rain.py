"""Gauge hours, rain series and scenario documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverine.functions.hydraulics import rain_count
from riverine.operators.lookups import last_before

#: Display name and place of each kind of scenario.
KINDS = {"observed-rain": ("AMeDAS実測", None), "xrain": ("XRAINレーダー", "名古屋"), "msm": ("MSM較正", "名古屋"), "msm-afternoon": ("MSM較正 11時〜", "名古屋")}


def hyetograph(gauge: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t_s, mm_h: the rate from each hour's start, a missing hour as dry, and a closing zero at 24 h."""
    rates = gauge.select(*keys, ((F.col("hour") - 1) * 3600).cast("double").alias("t_s"), F.coalesce("mm", F.lit(0.0)).alias("mm_h"))
    return rates.unionByName(gauge.select(*keys).distinct().select(*keys, F.lit(86400.0).alias("t_s"), F.lit(0.0).alias("mm_h")))


def gauge_summary(gauge: DataFrame, keys: list[str]) -> DataFrame:
    """Total (one decimal), peak, its first hour (NULL if nothing was observed) and missing hours. Sums run over tenths."""
    tenths = F.sum(F.round(F.col("mm") * 10).cast("bigint"))
    return gauge.groupBy(*keys).agg(
        F.coalesce(tenths / 10.0, F.lit(0.0)).alias("total_mm"), F.coalesce(F.max("mm"), F.lit(0.0)).alias("peak_mmh"),
        F.min(F.when(F.col("mm").isNotNull(), F.struct((-F.col("mm")).alias("v"), "hour")))["hour"].alias("peak_hour"), F.count_if(F.col("mm").isNull()).alias("missing_hours"),
    )


def _segments(series: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of every series: (lo, hi] with the rates at both ends, and what has fallen before lo."""
    by = Window.partitionBy(*keys).orderBy("t_s")
    sided = series.select(*keys, F.lag("t_s").over(by).alias("lo"), F.col("t_s").alias("hi"), F.lag("mm_h").over(by).alias("r0"), F.col("mm_h").alias("r1"))
    fallen = F.coalesce((F.col("r0") + F.col("r1")) / 2 * (F.col("hi") - F.col("lo")) / 3600, F.lit(0.0))
    return sided.withColumn("before", F.coalesce(F.sum(fallen).over(Window.partitionBy(*keys).orderBy("hi").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def _rate(t: Column) -> Column:
    return F.col("r0") + (F.col("r1") - F.col("r0")) * (t - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))


def rate_at(at: DataFrame, series: DataFrame, keys: list[str], t: str = "t_s", bucket_s: float = 3600.0) -> DataFrame:
    """at with rate and fallen_mm: linear between breakpoints, the first rate before the start, 0 after the end.

    fallen_mm is the trapezoid sum up to t. Segments stand in every bucket of time that they touch, so that a look-up
    meets its key and bucket only, and a long or often asked series is spread over its buckets.
    """
    parts = _segments(series.select(*keys, F.col("t_s"), "mm_h"), keys)
    whole = F.col("before") + F.coalesce((F.col("r0") + F.col("r1")) / 2 * (F.col("hi") - F.col("lo")) / 3600, F.lit(0.0))
    ends = parts.groupBy(*keys).agg(F.min("hi").alias("__start"), F.min_by("r1", "hi").alias("__r"), F.max("hi").alias("__end"), F.max_by(whole, "hi").alias("__all"))
    bucket = lambda c: F.floor(F.col(c) / bucket_s)
    pieces = parts.where("lo < hi").withColumn("__b", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    a, p = at.withColumn("__b", bucket(t)).alias("a"), pieces.alias("p")
    on = [F.col(f"a.{k}") == F.col(f"p.{k}") for k in [*keys, "__b"]]
    inside = (F.col("p.lo") < F.col(f"a.{t}")) & (F.col(f"a.{t}") <= F.col("p.hi"))
    found = a.join(p, [*on, inside], "left").select("a.*", F.col("lo"), F.col("hi"), F.col("r0"), F.col("r1"), F.col("before")).join(ends, keys, "left")
    early, known = F.col(t) <= F.col("__start"), F.col("hi").isNotNull()
    rate = F.when(early, F.col("__r")).when(known, _rate(F.col(t))).otherwise(F.lit(0.0))
    part = (F.col("r0") + _rate(F.col(t))) / 2 * (F.col(t) - F.col("lo")) / 3600
    fallen = F.when(early, F.lit(0.0)).when(known, F.greatest(F.col("before") + part, F.lit(0.0))).otherwise(F.coalesce("__all", F.lit(0.0)))
    return found.select(*at.columns, F.coalesce(rate, F.lit(0.0)).alias("rate"), fallen.alias("fallen_mm"))


def active_window(series: DataFrame, keys: list[str], least: float = 1.0, lead_s: float = 3600.0, tail_s: float = 10800.0) -> DataFrame:
    """keys, start_s, end_s: from lead_s before the first rate above `least` to tail_s after the last, within the series. Dry series have none."""
    wet = F.when(F.col("mm_h") > least, F.col("t_s"))
    ends = series.groupBy(*keys).agg(F.min("t_s").alias("a"), F.max("t_s").alias("b"), F.min(wet).alias("f"), F.max(wet).alias("l")).where("f IS NOT NULL")
    return ends.select(*keys, F.greatest(F.col("a"), F.col("f") - lead_s).alias("start_s"), F.least(F.col("b"), F.col("l") + tail_s).alias("end_s"))


def rebased(series: DataFrame, window: DataFrame, keys: list[str]) -> DataFrame:
    """Breakpoints from the window's start on, with the start as zero."""
    return series.join(window, keys).where("t_s >= start_s").select(*keys, (F.col("t_s") - F.col("start_s")).alias("t_s"), "mm_h")


def uniform_bins(series: DataFrame, keys: list[str], step_s: float = 60.0) -> DataFrame:
    """keys, bin, rate: rates every step_s from the start, and a closing bin of zero."""
    span = series.groupBy(*keys).agg(F.min("t_s").alias("a"), F.max("t_s").alias("b"))
    n = F.greatest(F.lit(2), F.ceil((F.col("b") - F.col("a")) / step_s) + 2)
    bins = span.select(*keys, "a", F.explode(F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint"))).alias("bin"), n.alias("n"))
    timed = bins.withColumn("__t", F.col("a") + F.col("bin") * step_s)
    return rate_at(timed, series, keys, "__t").select(*keys, "bin", F.when(F.col("bin") == F.col("n") - 1, F.lit(0.0)).otherwise(F.col("rate")).alias("rate"))


def last_sample(at: DataFrame, samples: DataFrame, keys: list[str], value: str, t: str = "t_s") -> DataFrame:
    """at with the value of the last sample at or before t, 0 before the first."""
    found = last_before(at, samples, keys, [value], t)
    return found.select(*at.columns, F.coalesce(F.col("__last")[value], F.lit(0.0)).alias(value))


def frame_series(rain: DataFrame, keys: list[str], step_s: int) -> DataFrame:
    """keys, t_s, mm_h: the mean rate of each frame's cells (missing ones left out) and a closing zero.

    Cells are taken in whole hundredths, so that sums don't depend on their order, and means to two decimals, half to even.
    """
    hundredths = F.sum(F.round(F.col("mm_h") * 100).cast("bigint"))
    means = rain.groupBy(*keys, "t_s").agg((F.rint(hundredths / F.count("mm_h")) / 100).alias("mm_h"))
    return means.unionByName(means.groupBy(*keys).agg((F.max("t_s") + step_s).alias("t_s"), F.lit(0.0).alias("mm_h")))


def spatial_summary(series: DataFrame, keys: list[str], step_s: int) -> DataFrame:
    """Total (one decimal, half to even) and peak of a domain-mean series. Sums run over hundredths."""
    hundredths = F.sum(F.round(F.col("mm_h") * 100).cast("bigint"))
    return series.groupBy(*keys).agg(F.bround(hundredths * step_s / 3600.0 / 100.0, 1).alias("total_mm"), F.max("mm_h").alias("peak_mmh"))


def quantised(rain: DataFrame) -> DataFrame:
    """rain with count (half millimetres an hour, 0 to 255) and decoded, its rate."""
    return rain.withColumn("count", rain_count(F.col("mm_h"))).withColumn("decoded", F.col("count") * 0.5)


def scenario_file(kind: Column, day: Column, block: Column) -> Column:
    """rain_YYYYMMDD_<block>.json for observed rain, else the kind in place of the block."""
    return F.concat(F.lit("rain_"), F.date_format(day, "yyyyMMdd"), F.lit("_"), F.when(kind == "observed-rain", block).otherwise(kind), F.lit(".json"))


def short_number(col: Column) -> Column:
    """Six significant digits without trailing zeros, for values of 0 and of 0.1 to 999999."""
    rounded = F.bround(col, 0)
    for digits in range(1, 7):  # below 100000 one decimal, below 10000 two, and so on
        rounded = F.when(col < 10 ** (6 - digits), F.bround(col, digits)).otherwise(rounded)
    return F.regexp_replace(F.format_string("%.6f", rounded), r"\.?0+$", "")


def scenario_documents(series: DataFrame, summary: DataFrame, keys: list[str], kind: Column, day: Column, block: Column) -> DataFrame:
    """One JSON document a scenario: keys, file, document."""
    points = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t_s", "mm_h"))).alias("series"))
    joined = points.join(summary, keys)
    return joined.select(*keys, scenario_file(kind, day, block).alias("file"), F.to_json(F.struct(kind.alias("kind"), day.cast("string").alias("date"), "series", "total_mm", "peak_mmh")).alias("document"))


def scenario_index(scenarios: DataFrame) -> DataFrame:
    """file, name, description of scenarios (file, kind, date, station, peak_mmh, total_mm), in order of file."""
    labels = scenarios.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in KINDS.items()], "kind string, label string, place string")
    named = scenarios.join(F.broadcast(labels), "kind", "left").withColumn("label", F.coalesce("label", "kind"))
    name = F.when(F.col("place").isNotNull(), F.concat_ws(" ", "place", "label", F.col("date").cast("string"))).otherwise(F.trim(F.concat_ws(" ", F.coalesce("station", F.lit("")), F.col("date").cast("string"))))
    text = F.concat(F.lit("最大 "), short_number(F.coalesce("peak_mmh", F.lit(0.0))), F.lit(" mm/h・合計 "), short_number(F.coalesce("total_mm", F.lit(0.0))), F.lit(" mm ("), "label", F.lit(")"))
    return named.select("file", name.alias("name"), text.alias("description")).orderBy("file")


def all_kinds(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Scenarios of all kinds as one index; a column that a kind lacks is NULL."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def upsert(entries: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """entries without the keys in new, and new."""
    return entries.join(new.select(key), key, "left_anti").unionByName(new)


def first_match(left: DataFrame, right: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """left with the value of the first row of right (by order) of the same key, NULL without one."""
    first = right.groupBy(key).agg(F.min_by(value, order).alias(value))
    return left.join(first, key, "left")


def event_rows(events: DataFrame, gauge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gauge rows of catalogued events (event, station, day), and the events that have none."""
    return gauge.join(events, ["station", "day"]), events.join(gauge.select("station", "day").distinct(), ["station", "day"], "left_anti")
