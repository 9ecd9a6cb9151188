"""Queries that run streams over the tables with an available-now trigger, and their batch oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverine.operators import zones
from riverine.operators.drainage import counted, scratch, shared_folder
from riverine.plans.extent import DX, _frames
from riverine.plans.testdata import collection, frame
from riverine.streaming import feeds

QUERIES, ORACLE_SQL, query = collection()


def run_stream(spark: SparkSession, made: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what there is and returns the rows of its sink, both in the shared folder."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        made.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(made.schema).parquet(f"{base}/rows")
    keep = lambda df, _: df.write.mode("overwrite").parquet(f"{base}/rows")  # noqa: E731  complete mode: each batch holds all rows
    made.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{base}/rows")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    # the file source wants folders or globs, and event times with a zone
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, CAST(user_id % 10 AS BIGINT) AS station, round(sum(value), 4) AS mm, count(*) AS n FROM events GROUP BY 1, 2")
def str5_gauge_totals(spark: SparkSession, sf: str) -> DataFrame:
    messages = _events(spark, sf).select("ts", (F.col("user_id") % 10).alias("station"), F.col("value").alias("mm"))
    return run_stream(spark, feeds.gauge_totals(messages), "complete").withColumn("mm", F.round("mm", 4)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("""SELECT start, station, round(sum(value), 4) AS mm FROM (SELECT CAST(user_id % 10 AS BIGINT) AS station, value, time_bucket(INTERVAL '10 minutes', ts) - INTERVAL '10 minutes' * k AS start FROM events, (SELECT unnest(range(0, 6)) AS k)) GROUP BY ALL""")
def str5_sliding_totals(spark: SparkSession, sf: str) -> DataFrame:
    messages = _events(spark, sf).select("ts", (F.col("user_id") % 10).alias("station"), F.col("value").alias("mm"))
    return run_stream(spark, feeds.sliding_totals(messages), "complete").withColumn("mm", F.round("mm", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT CAST(to_timestamp(300 * floor((epoch(date_trunc('minute', ts)) + 150) / 300)) AT TIME ZONE 'UTC' AS TIMESTAMP) AS slot, user_id AS pixel, round(avg(value), 6) AS mm_h, count(*) AS n
    FROM (SELECT DISTINCT ON (user_id, ts) * FROM events) GROUP BY 1, 2""")
def str1_radar_slots(spark: SparkSession, sf: str) -> DataFrame:
    """STR1 and STR2: the table is finite, so all of its slots come, those that the 8-day watermark hasn't passed included."""
    messages = feeds.slotted(_events(spark, sf).select("ts", F.col("user_id").alias("pixel"), F.col("value").alias("mm_h")))
    got = run_stream(spark, feeds.radar_slots(messages.drop("slot")), "complete")
    return got.select(F.col("slot").cast("timestamp_ntz").alias("slot"), "pixel", F.round("mm_h", 6).alias("mm_h"), "n")


@query("""SELECT station, CAST(start AS DATE) AS day, max(mm) AS most_mm FROM (SELECT start, station, sum(tenths) / 10.0 AS mm FROM
    (SELECT CAST(user_id % 10 AS BIGINT) AS station, CAST(floor(value * 10) AS BIGINT) AS tenths, time_bucket(INTERVAL '10 minutes', ts) - INTERVAL '10 minutes' * k AS start FROM events, (SELECT unnest(range(0, 6)) AS k)) GROUP BY ALL) GROUP BY ALL""".replace("/ 10.0", "/ CAST(10 AS DOUBLE)"))
def str5_sliding_maximum_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The sliding maximum as a stream in append mode. A last message, of a time at which every day is over, closes them."""
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).cast("bigint").alias("station"), (F.floor(F.col("value") * 10) / 10).alias("mm"))
    path = f"{shared_folder(spark)}/messages-{uuid.uuid4().hex}"
    events.write.parquet(path)
    events.agg((F.max("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts")).select("ts", F.lit(-1).cast("bigint").alias("station"), F.lit(0.0).alias("mm")).write.mode("append").parquet(path)
    got = run_stream(spark, feeds.largest_hours_stream(spark.readStream.schema(events.schema).parquet(path)), "append")
    return got.where("station >= 0").select("station", "day", F.round("most_mm", 1).alias("most_mm"))


_SLOTS = """m AS (SELECT CAST(ts AS DATE) AS day, date_trunc('minute', ts) AS stamp, user_id AS pixel, value, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS mi FROM events),
    t AS (SELECT day, stamp, mi - o AS slot, place FROM (SELECT DISTINCT day, stamp, mi FROM m), (VALUES (0, 0), (1, 1), (2, 2), (-1, 3), (-2, 4), (3, 5), (-3, 6)) v(o, place) WHERE (mi - o) % 5 = 0 AND mi - o BETWEEN 0 AND 1435),
    a AS (SELECT day, slot, arg_min(stamp, place) AS stamp FROM t GROUP BY day, slot)"""


@query(f"""+ {_SLOTS} SELECT CAST(a.day AS TIMESTAMP) + slot * INTERVAL '1 minute' AS slot, a.stamp, pixel, count(*) AS n, round(sum(value), 4) AS mm_h FROM a JOIN m ON m.stamp = a.stamp GROUP BY ALL""".replace("+ m AS", "WITH m AS"))
def str1_accepted_stamps(spark: SparkSession, sf: str) -> DataFrame:
    """STR1 with timers: of the minutes that a slot tries, the first that has messages. A last message, of a time at which every slot is over, closes them."""
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("bigint").alias("pixel"), F.col("value").cast("double").alias("mm_h"))
    path = f"{shared_folder(spark)}/messages-{uuid.uuid4().hex}"
    events.write.parquet(path)
    events.agg((F.max("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts")).select("ts", F.lit(-1).cast("bigint").alias("pixel"), F.lit(0.0).alias("mm_h")).write.mode("append").parquet(path)
    with feeds.keyed_state(spark):
        got = run_stream(spark, feeds.accepted_stamps(spark.readStream.schema(events.schema).parquet(path)), "append")
    return got.groupBy("slot", "stamp", "pixel").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mm_h"), 4).alias("mm_h")).withColumns({k: F.col(k).cast("timestamp_ntz") for k in ("slot", "stamp")})


@query("SELECT CAST(month(l_shipdate) AS BIGINT) AS region, CAST(floor((l_partkey % 600) / CAST(30 AS DOUBLE)) AS BIGINT) AS r, CAST(l_partkey % 30 AS BIGINT) AS c, max(l_quantity / 100) AS h_max, count(*) AS frames FROM lineitem GROUP BY 1, 2, 3")
def str3_running_depth(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/lineitem.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    cells = rows.select(F.month("l_shipdate").cast("bigint").alias("region"), F.floor((F.col("l_partkey") % 600) / 30).alias("r"), (F.col("l_partkey") % 30).alias("c"), (F.col("l_quantity") / 100).alias("h"))
    return run_stream(spark, feeds.running_depth(cells), "complete")


@query(None)
def str4_zone_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The zone means as a stream through transformWithState; equal to str4_zone_storage (tests/test_registry.py)."""
    z = frame(spark, sf, "zones")
    means = zones.zone_means(_frames(spark, sf), z, DX).join(counted(z.select("zone", "floor_depth_m", "threshold_m", "coupling_s")), "zone")
    kept = scratch(spark)(means)
    rows = spark.readStream.schema(kept.schema).parquet(kept.inputFiles()[0].rpartition("/")[0])
    with feeds.keyed_state(spark):
        got = run_stream(spark, feeds.zone_tanks(rows), "append")
    return got.select("zone", "region", "t_s", F.round("volume", 4).alias("volume"), F.round("depth", 6).alias("depth"))
