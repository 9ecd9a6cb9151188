"""Streams of radar slots, depth frames, zone series and gauge messages."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riverine.functions.hydraulics import SLOT_OFFSETS
from riverine.operators.zones import SERIES, step


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """A session whose streams keep the state that transformWithState needs, until the block ends."""
    key, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, kind)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def slotted(messages: DataFrame, ts: str = "ts", minutes: int = 5, reach: int = 3) -> DataFrame:
    """messages with slot: the nearest slot whose candidates (3 minutes either way) hold the stamp; earlier slots of a tie win."""
    seconds = F.unix_timestamp(F.date_trunc("minute", ts))
    slot = F.round(seconds / (60 * minutes)) * (60 * minutes)
    return messages.withColumn("slot", F.timestamp_seconds(slot)).where(F.abs(seconds - slot) <= 60 * reach)


def radar_slots(messages: DataFrame, key: str = "pixel", retention: str = "8 days", minutes: int = 5) -> DataFrame:
    """Mean rate by slot and pixel of messages (ts, key, mm_h): what is older than the retention is dropped, and so are repeats.

    Windows lie around the slots, so a window's slot is that of `slotted`. In append mode a slot comes once the
    watermark has passed it; a finite input wants complete mode, which has the last slots too.
    """
    fresh = messages.withWatermark("ts", retention).dropDuplicatesWithinWatermark([key, "ts"])
    window = F.window("ts", f"{minutes} minutes", f"{minutes} minutes", f"{(minutes + 1) // 2} minutes")
    means = fresh.groupBy(window, key).agg(F.avg("mm_h").alias("mm_h"), F.count(F.lit(1)).alias("n"))
    return means.select((F.col("window.start") + F.make_interval(mins=F.lit(minutes // 2))).alias("slot"), key, "mm_h", "n")


def candidate_slots(messages: DataFrame, ts: str = "ts", minutes: int = 5) -> DataFrame:
    """messages with slot, place and stamp: a row for every slot of their day that tries their minute, and the place of that trial."""
    stamp = F.date_trunc("minute", ts)
    tried = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(o).alias("offset")) for i, o in enumerate(SLOT_OFFSETS)])
    rows = messages.withColumn("stamp", stamp).withColumn("__s", F.explode(tried))
    slot = F.timestamp_seconds(F.unix_timestamp("stamp") - 60 * F.col("__s.offset"))
    due = (F.unix_timestamp(slot) % (60 * minutes) == 0) & (F.to_date(slot) == F.to_date("stamp"))
    return rows.withColumn("slot", slot).where(due).withColumn("place", F.col("__s.place")).drop("__s")


ACCEPTED = "slot timestamp, stamp timestamp, pixel bigint, mm_h double"
_SECONDS = ACCEPTED.replace("timestamp", "bigint")  # inside the processor, whatever the session's time zone


class SlotChoice(StatefulProcessor):
    """Keeps a slot's messages of the best stamp so far; a timer gives them out when no better one can come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", T.StructType([T.StructField("place", T.IntegerType())]))
        self.rows = handle.getListState("rows", T.StructType([T.StructField("stamp", T.LongType()), T.StructField("pixel", T.LongType()), T.StructField("mm_h", T.DoubleType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = self.best.get()[0] if self.best.exists() else len(SLOT_OFFSETS)
        for part in rows:
            place = int(part["place"].min())
            if place < best:
                best = place
                self.best.update((best,))
                self.rows.clear()
            mine = part[part["place"] == best]
            if len(mine):
                self.rows.appendList([(int(t), int(p), float(v)) for t, p, v in zip(mine["stamp"], mine["pixel"], mine["mm_h"], strict=True)])
        self.handle.registerTimer(1000 * (int(key[0]) + 60 * (max(SLOT_OFFSETS) + 1)))  # the end of the last minute that it tries
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = [(key[0], *row) for row in self.rows.get()]
        self.best.clear()
        self.rows.clear()
        yield pd.DataFrame(kept, columns=["slot", "stamp", "pixel", "mm_h"])

    def close(self) -> None:
        pass


def accepted_stamps(messages: DataFrame, retention: str = "8 days") -> DataFrame:
    """slot, stamp, pixel, mm_h of the messages (ts, pixel, mm_h) of each slot's accepted stamp: of the minutes that it tries, the first in
    order that has messages. Slots come once the watermark has passed their last minute; what is older than the retention, by the
    watermark of the batch before, is rejected (`rejected_rows` counts it). Needs keyed_state; state is what a slot of seven minutes has."""
    seconds = [F.unix_timestamp(k).alias(k) for k in ("slot", "stamp")]
    tried = candidate_slots(messages.withWatermark("ts", retention)).select("ts", *seconds, "place", "pixel", "mm_h")
    found = tried.groupBy("slot").transformWithStateInPandas(SlotChoice(), _SECONDS, "Append", "EventTime")
    return found.select(*[F.timestamp_seconds(k).alias(k) for k in ("slot", "stamp")], "pixel", "mm_h")


def rejected_rows(query: Any) -> int:
    """Rows that a stream's stateful steps have dropped as too late, in the batches that its progress still has."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])


def running_depth(frames: DataFrame) -> DataFrame:
    """Largest depth of every cell so far (update or complete mode); the state is one row a cell."""
    return frames.groupBy("region", "r", "c").agg(F.max("h").alias("h_max"), F.count(F.lit(1)).alias("frames"))


def gauge_totals(messages: DataFrame, key: str = "station", delay: str = "1 hour") -> DataFrame:
    """Hourly totals of sub-hourly gauge messages (ts, key, mm)."""
    by_hour = messages.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), key)
    return by_hour.agg(F.sum("mm").alias("mm"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), key, "mm", "n")


def sliding_totals(messages: DataFrame, key: str = "station", delay: str = "1 hour") -> DataFrame:
    """Totals of an hour that starts every ten minutes."""
    by_hour = messages.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour", "10 minutes"), key)
    return by_hour.agg(F.sum("mm").alias("mm")).select(F.col("window.start").alias("start"), key, "mm")


def largest_hours(messages: DataFrame, key: str = "station") -> DataFrame:
    """key, day and most_mm: the largest total of an hour that starts on that day, every ten minutes. Batch form, of finished messages."""
    totals = sliding_totals(messages, key)
    return totals.groupBy(key, F.to_date("start").alias("day")).agg(F.max("mm").alias("most_mm"))


def largest_hours_stream(messages: DataFrame, key: str = "station", delay: str = "1 hour") -> DataFrame:
    """The same as a stream in append mode: windows of an hour, every ten minutes, within windows of a day, which hold them by their start.

    A day comes once the watermark has passed the last hour that starts on it.
    """
    by_hour = messages.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour", "10 minutes").alias("hour"), key).agg(F.sum("mm").alias("mm"))
    # hours that start on a day have their last moments from 00:59:59 on, and before 00:50 of the next day
    by_day = by_hour.groupBy(F.window("hour", "1 day", "1 day", "50 minutes").alias("day"), key).agg(F.max("mm").alias("most_mm"))
    return by_day.select(key, F.to_date("day.start").alias("day"), "most_mm")


class ZoneTank(StatefulProcessor):
    """Keeps the volume and the last time of each zone's tank; rows of a batch are taken in order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField("volume", T.DoubleType()), T.StructField("t_s", T.DoubleType())]
        self.state = handle.getValueState("tank", T.StructType(fields))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        volume, before = self.state.get() if self.state.exists() else (0.0, None)
        part = pd.concat(list(rows), ignore_index=True).sort_values("t_s", kind="stable")
        out = []
        for row in part.itertuples():
            volume = step(volume, row.mean_h, row.area, 0.0 if before is None else row.t_s - before, row.floor_depth_m, row.threshold_m, row.coupling_s)
            before = row.t_s
            out.append((key[0], key[1], row.t_s, volume, volume / row.area if row.area > 0 else 0.0))
        self.state.update((volume, before))
        yield pd.DataFrame(out, columns=["zone", "region", "t_s", "volume", "depth"])

    def close(self) -> None:
        pass


def zone_tanks(means: DataFrame) -> DataFrame:
    """STR4 as a stream: means carries the tank parameters. Needs the RocksDB state store provider."""
    return means.groupBy("zone", "region").transformWithStateInPandas(ZoneTank(), SERIES, "Append", "None")
