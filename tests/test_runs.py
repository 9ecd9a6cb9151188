"""What a run leaves behind, versions of an index, and the sliding maximum as a stream."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from riverine.operators import drainage
from riverine.sources import sinks
from riverine.streaming import feeds


def test_a_run_can_clear_its_folder(spark):
    rows = drainage.scratch(spark)(spark.range(5))
    folder = drainage.shared_folder(spark).removeprefix("file://")
    assert rows.count() == 5 and os.path.isdir(folder) and folder.endswith(spark.sparkContext.applicationId)
    assert drainage.clear_scratch(spark) and not os.path.exists(folder)
    assert not drainage.clear_scratch(spark)  # nothing left


def test_a_begun_version_is_not_written_again(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    one = lambda v: spark.createDataFrame([("a", v), (v, v)], "dir string, label string")
    sinks.replace_index(one("first"), path, "dir")
    (tmp_path / "index/version=2").mkdir()  # a writer that is still at work, or has died
    sinks.replace_index(one("second"), path, "dir")
    assert sorted(tuple(r) for r in sinks.read_index(spark, path).select("dir", "label").collect()) == [("a", "second"), ("first", "first"), ("second", "second")]
    assert (tmp_path / "index/version=3/_SUCCESS").exists() and not list((tmp_path / "index/version=2").iterdir())
    with pytest.raises(Exception, match="exist"):
        spark.range(1).write.mode("error").parquet(f"{path}/version=3")


def test_sliding_maximum_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    begin = dt.datetime(2024, 5, 3, 20, 0)
    made = [(begin + dt.timedelta(seconds=rng.randrange(100_000)), rng.randint(0, 2), float(rng.randint(0, 40))) for _ in range(150)]
    schema = "ts timestamp, station bigint, mm double"
    for part in (made, [(begin + dt.timedelta(days=9), -1, 0.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feeds.largest_hours_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).where("station >= 0").collect()}
    batch = feeds.largest_hours(spark.createDataFrame(made, schema)).select("station", "day", F.col("most_mm"))
    assert got == {tuple(r) for r in batch.collect()} and len(got) >= 6
