"""What several operators need: written intermediate tables and joins behind a checked size."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of keys up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Bytes of a broadcast row of keys, at most.
ROW_BYTES = 128


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a folder of this process serves on a single machine; a cluster has to name one. Settings of the
    session stay as they are.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/riverine-{os.getpid()}"


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keeps Arrow batches of whole texts at a few MB, on both sides of the pipe to a Python worker.

    Spark reads the setting when a plan runs, after the operator has returned, so it stays lowered for the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/riverine/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_not(keys: DataFrame) -> DataFrame:
    """Marks keys for broadcast if their count is within BROADCAST_BYTES, else leaves the join to shuffle.

    Give it a written table, as its rows are counted here.
    """
    return F.broadcast(keys) if keys.count() * ROW_BYTES <= BROADCAST_BYTES else keys


def without(docs: DataFrame, dropped: DataFrame, **keys: F.Column) -> DataFrame:
    """Rows of docs that no row of dropped matches; keys: what each column of dropped is compared with. Null matches null."""
    gone = written(dropped.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct(), "gone")
    match = [col.eqNullSafe(F.col(f"__{k}")) for k, col in keys.items()]
    return docs.join(small_or_not(gone), match, "left_anti")
