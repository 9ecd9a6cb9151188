"""Tables of tiles, frames and scenarios on the shared file system, and an index that is replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverine.operators.rain import upsert


def write_partitions(rows: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Parquet in folders of `by`. Small folders are merged into one task, a folder of many rows is split over several."""
    rows.hint("rebalance", *by).write.partitionBy(*by).mode(mode).parquet(path)


def write_tiles(cells: DataFrame, path: str, tile: int = 256) -> None:
    """Cells (r, c and values) in folders of their tile (tile_r, tile_c)."""
    named = cells.withColumn("tile_r", F.floor(F.col("r") / tile).cast("int")).withColumn("tile_c", F.floor(F.col("c") / tile).cast("int"))
    write_partitions(named, path, ["tile_r", "tile_c"])


def write_documents(documents: DataFrame, path: str, day: str = "day") -> None:
    """Documents (file, document and a day) in folders of their day."""
    write_partitions(documents.select(day, "file", "document"), path, [day])


def _versions(spark: SparkSession, path: str, begun: bool = False) -> dict[int, str]:
    """Complete versions of an index by number, or all that were begun; a version counts once its writer has marked it."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = files.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*" + ("" if begun else "/_SUCCESS"))) or []
    found = [(m.getPath() if begun else m.getPath().getParent()).toString() for m in marks]
    return {int(f.rpartition("=")[2]): f for f in found}


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The last complete version of an index, None if there is none."""
    found = _versions(spark, path)
    return spark.read.parquet(found[max(found)]) if found else None


def replace_index(new: DataFrame, path: str, key: str) -> None:
    """Writes the index with `new` in place of rows of the same keys as its next version, so that a failed run leaves the last one.

    A number that another writer has begun is never written again: the next is taken, or, if both take it at once, the
    later one fails.
    """
    spark = new.sparkSession
    before = read_index(spark, path)
    after = new if before is None else upsert(before, new, key)
    after.write.mode("error").parquet(f"{path}/version={max(_versions(spark, path, begun=True), default=0) + 1}")
