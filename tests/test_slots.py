"""Radar slots as a stream: accepted stamps against the batch form, rejected rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from riverine.functions.hydraulics import SLOT_OFFSETS
from riverine.streaming import feeds

MESSAGE = "ts timestamp, pixel bigint, mm_h double"


def expected(messages):
    """slot: rows of its accepted minute, one slot after the other."""
    by_minute = {}
    for ts, pixel, v in messages:
        by_minute.setdefault(ts.replace(second=0, microsecond=0), []).append((pixel, v))
    found = set()
    for day in {t.date() for t in by_minute}:
        for slot in range(0, 1440, 5):
            start = dt.datetime.combine(day, dt.time()) + dt.timedelta(minutes=slot)
            stamps = [start + dt.timedelta(minutes=o) for o in SLOT_OFFSETS if 0 <= slot + o < 1440]
            hit = next((s for s in stamps if s in by_minute), None)
            found |= {(start, hit, *row) for row in by_minute.get(hit, [])}
    return found


def run(spark, folder, messages, retention):
    """One file a list of messages, one batch a file; returns rows and rejected rows."""
    path = str(folder / "in")
    for part in messages:
        spark.createDataFrame(part, MESSAGE).coalesce(1).write.mode("append").parquet(path)
    with feeds.keyed_state(spark):
        stream = feeds.accepted_stamps(spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(path), retention)
        query = stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    rows = [tuple(r) for r in spark.read.schema(feeds.ACCEPTED).parquet(str(folder / "out")).collect()]
    return rows, feeds.rejected_rows(query)


def test_accepted_stamps(spark, tmp_path):
    rng = random.Random(1)
    begin = dt.datetime(2024, 5, 3, 23, 30)
    messages = [(begin + dt.timedelta(seconds=rng.randrange(5400)), i, float(rng.randint(0, 50))) for i in range(60)]
    cut = [messages[:25], messages[25:], [(begin + dt.timedelta(days=20), -1, 0.0)]]  # later messages may better a slot's stamp
    rows, rejected = run(spark, tmp_path, cut, "8 days")
    assert set(rows) == expected(messages) and len(rows) == len(set(rows)) and rejected == 0


def test_late_messages_are_rejected_and_counted(spark, tmp_path):
    at = lambda d, m: dt.datetime(2024, 5, d, 12, m)
    first, then, late = [(at(1, 1), 1, 1.0), (at(20, 0), 2, 2.0)], [(at(20, 30), 5, 5.0)], [(at(2, 0), 3, 3.0), (at(19, 5), 4, 4.0)]
    rows, rejected = run(spark, tmp_path, [first, then, late, [(at(31, 0), -1, 0.0)]], "8 days")
    assert set(rows) == expected([*first, *then, late[1]]) and rejected >= 1  # the 2nd is more than 8 days before the 20th; a row a slot that tries it


def test_settings_stay(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with feeds.keyed_state(spark):
        assert spark.conf.get(key).endswith("RocksDBStateStoreProvider")
    assert spark.conf.get(key, None) == before


def test_candidates_keep_within_the_day(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 5, 1, 23, 58), 1, 1.0), (dt.datetime(2024, 5, 1, 0, 2), 2, 1.0)], MESSAGE)
    got = {(r.pixel, r.slot.hour, r.slot.minute, r.place) for r in feeds.candidate_slots(df).select("pixel", "slot", F.col("place")).collect()}
    assert got == {(1, 23, 55, 5), (2, 0, 0, 2), (2, 0, 5, 6)}
