"""All registered queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riverine.plans import extent, files, images, places, rain, streams, terrain

QUERIES = {**rain.QUERIES, **terrain.QUERIES, **extent.QUERIES, **places.QUERIES, **streams.QUERIES, **files.QUERIES, **images.QUERIES}
ORACLE_SQL = {**rain.ORACLE_SQL, **terrain.ORACLE_SQL, **extent.ORACLE_SQL, **places.ORACLE_SQL, **streams.ORACLE_SQL, **files.ORACLE_SQL, **images.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)
