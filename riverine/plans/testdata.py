"""Adapters: the tables of terrain and rain jobs, derived from the given tables by SQL that Spark and DuckDB share.

Each adapter is one SELECT over base tables and earlier adapters. `frame` runs it on Spark; `ctes` gives the same text
to an oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
_HOURS = ", ".join(f"({h})" for h in range(1, 25))

ADAPTERS = {
    # hourly gauge rows with a full 24-hour spine; NULL where nothing but errors was reported
    "gauge": f"""
        SELECT s.station, s.day, s.hour, g.mm FROM
          (SELECT d.station, d.day, CAST(v.h AS INT) AS hour FROM
             (SELECT DISTINCT CAST(user_id % 10 AS BIGINT) AS station, CAST(ts AS DATE) AS day FROM events) d CROSS JOIN (VALUES {_HOURS}) AS v(h)) s
        LEFT JOIN
          (SELECT CAST(user_id % 10 AS BIGINT) AS station, CAST(ts AS DATE) AS day, CAST(hour(ts) + 1 AS INT) AS hour,
                  CASE WHEN count(CASE WHEN event_type <> 'error' THEN 1 END) = 0 THEN NULL
                       ELSE CAST(sum(CASE WHEN event_type <> 'error' THEN CAST(floor(value * 10) AS BIGINT) ELSE 0 END) AS DOUBLE) / CAST(10 AS DOUBLE) END AS mm
           FROM events GROUP BY 1, 2, 3) g
        ON s.station = g.station AND s.day = g.day AND s.hour = g.hour""",
    "series": """
        SELECT station, day, CAST((hour - 1) * 3600 AS DOUBLE) AS t_s, coalesce(mm, CAST(0 AS DOUBLE)) AS mm_h FROM gauge
        UNION ALL SELECT DISTINCT station, day, CAST(86400 AS DOUBLE) AS t_s, CAST(0 AS DOUBLE) AS mm_h FROM gauge""",
    # times at which series are looked up
    "moments": """
        SELECT event_id, CAST(user_id % 10 AS BIGINT) AS station, CAST(ts AS DATE) AS day,
               CAST(hour(ts) * 3600 + minute(ts) * 60 + event_id % 60 - (CASE WHEN event_id % 50 = 0 THEN 90000 ELSE 0 END) + (CASE WHEN event_id % 50 = 1 THEN 90000 ELSE 0 END) AS DOUBLE) AS t_s
        FROM events""",
    # a 12 x 12 model grid, hourly
    "model": """
        SELECT day, hour, iy, ix, CAST(35 AS DOUBLE) + iy / CAST(20 AS DOUBLE) AS lat, CAST(136 AS DOUBLE) + ix / CAST(20 AS DOUBLE) AS lon, mm_h FROM
          (SELECT d.day, CAST(h.h AS INT) AS hour, CAST(floor(g.g / CAST(12 AS DOUBLE)) AS INT) AS iy, CAST(g.g % 12 AS INT) AS ix, coalesce(x.mm_h, CAST(0 AS DOUBLE)) AS mm_h FROM
             (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d CROSS JOIN (VALUES """ + _HOURS + """) AS h(h)
             CROSS JOIN (SELECT o_orderkey AS g FROM orders WHERE o_orderkey < 144) g
             LEFT JOIN (SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) + 1 AS INT) AS hour, CAST(user_id % 144 AS BIGINT) AS g,
                               CAST(sum(CAST(floor(value * 10) AS BIGINT)) AS DOUBLE) / CAST(10 AS DOUBLE) AS mm_h FROM events GROUP BY 1, 2, 3) x
             ON x.day = d.day AND x.hour = h.h AND x.g = g.g) z""",
    # elevations, 50 columns; NULL is a void
    "cells": """
        SELECT CAST(floor(p_partkey / CAST(50 AS DOUBLE)) AS BIGINT) AS r, CAST(p_partkey % 50 AS BIGINT) AS c,
               CASE WHEN p_size % 7 = 3 THEN NULL ELSE CAST(CAST(floor(p_retailprice * 10) AS BIGINT) % 977 + p_size * 3 - 40 AS DOUBLE) / CAST(10 AS DOUBLE) END AS elev
        FROM part""",
    # heights of buildings in centimetres, 0 without one
    "heights": """
        SELECT CAST(floor(c_custkey / CAST(50 AS DOUBLE)) AS BIGINT) AS r, CAST(c_custkey % 50 AS BIGINT) AS c,
               CASE WHEN c_acctbal < 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(c_acctbal / 2500) * 700 AS BIGINT) END AS height_cm
        FROM customer""",
    # depth frames: region of 50-column cells, one frame a month
    "frames": """
        SELECT CAST(month(l_shipdate) AS BIGINT) AS region, CAST(year(l_shipdate) - 1995 AS INT) AS frame, CAST(year(l_shipdate) - 1995 AS DOUBLE) * 60 AS t_s,
               CAST(floor((l_partkey % 600) / CAST(30 AS DOUBLE)) AS BIGINT) AS r, CAST(l_partkey % 30 AS BIGINT) AS c, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS h_cm,
               CAST(sum(CAST(l_linenumber AS BIGINT) * 7 - 20) AS BIGINT) AS qe_cm, CAST(sum(CAST(l_suppkey % 41 AS BIGINT) - 20) AS BIGINT) AS qs_cm
        FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    # satellite pixels with places on the frames' grid; value is a fraction of water in thousandths, NULL where missing
    "pixels": """
        SELECT o_orderstatus AS product, CAST(o_orderkey AS BIGINT) AS pixel, CAST(o_custkey % 12 + 1 AS BIGINT) AS region,
               CAST(o_orderkey % 33 AS DOUBLE) - CAST(o_custkey % 10 AS DOUBLE) / 4 AS x, CAST(o_orderkey % 23 AS DOUBLE) + CAST(o_custkey % 7 AS DOUBLE) / 8 - 1 AS y,
               CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 1001 AS DOUBLE) / 1000 END AS value
        FROM orders""",
    # backscatter before and after an event
    "backscatter": """
        SELECT CAST(o_custkey % 12 + 1 AS BIGINT) AS region, CAST(o_orderkey AS BIGINT) AS cell,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS DOUBLE) / 1000 END AS pre,
               CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice / 7) AS BIGINT) % 1000 AS DOUBLE) / 1000 END AS post
        FROM orders""",
    # points on the map
    "points": """
        SELECT c_custkey AS point, CAST(136.74 AS DOUBLE) + CAST(c_custkey % 350 AS DOUBLE) / 1000 AS lon, CAST(34.97 AS DOUBLE) + CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 335 AS DOUBLE) / 1000 AS lat
        FROM customer""",
    # wards: a centre, and tileset addresses by level of detail where there are some
    "wards": """
        SELECT CAST(s_suppkey AS BIGINT) AS ward, CAST(136.74 AS DOUBLE) + CAST((s_suppkey * 37) % 350 AS DOUBLE) / 1000 AS lon,
               CAST(34.97 AS DOUBLE) + CAST((s_suppkey * 53) % 335 AS DOUBLE) / 1000 AS lat, CAST('builtin/' AS VARCHAR(40)) || CAST(s_suppkey AS VARCHAR(20)) AS url
        FROM supplier""",
    "tilesets": """
        SELECT CAST(c_custkey AS BIGINT) AS pos, CAST((c_custkey * 7) % 29 AS BIGINT) AS ward, CAST(c_custkey % 2 + 1 AS INT) AS lod, c_custkey % 3 = 0 AS texture,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'tiles/' || c_name END AS url,
               CASE WHEN c_custkey % 13 = 0 THEN '14100' ELSE '23100' END AS city_code, CASE WHEN c_custkey % 5 = 0 THEN 'tran' ELSE 'bldg' END AS type_en
        FROM customer""",
    # rectangular zones with tank parameters
    "zones": """
        SELECT CAST(n_nationkey AS BIGINT) AS zone, CAST(n_nationkey % 20 AS BIGINT) AS r0, CAST(n_nationkey % 20 + 6 AS BIGINT) AS r1,
               CAST((n_nationkey * 3) % 25 AS BIGINT) AS c0, CAST((n_nationkey * 3) % 25 + 5 AS BIGINT) AS c1,
               CAST(n_regionkey + 2 AS DOUBLE) AS floor_depth_m, CAST(0.1 AS DOUBLE) + CAST(n_regionkey AS DOUBLE) / 10 AS threshold_m, CAST(60 AS DOUBLE) AS coupling_s
        FROM nation""",
}


def _needs(name: str) -> list[str]:
    """The adapter and those that it reads, in order."""
    found: list[str] = []
    for other in ADAPTERS:
        if other == name:
            break
        if re.search(rf"\b(FROM|JOIN)\s+{other}\b", ADAPTERS[name]):
            found += [x for x in _needs(other) if x not in found]
    return [*found, name]


def ctes(*names: str) -> str:
    """`WITH` and the adapters as common table expressions."""
    order = [x for x in ADAPTERS if any(x in _needs(n) for n in names)]
    return "WITH " + ", ".join(f"{x} AS ({ADAPTERS[x]})" for x in order)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = ctes(name)
    for base in BASE:
        if re.search(rf"\b{base}\b", text):
            spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
    return spark.sql(f"{text} SELECT * FROM {name}")


def collection() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str], Callable]:
    """Queries and SQL by name, and a decorator that adds a function with its SQL.

    SQL that begins with + goes on after the adapters' common table expressions with a comma, else it follows them.
    """
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None, *adapters: str) -> Callable:
        def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            queries[f.__name__] = f
            if sql is not None:
                more = sql.lstrip().startswith("+") and " AS (" in sql.split("SELECT")[0]
                oracles[f.__name__] = (ctes(*adapters) + (", " if more else " ") if adapters else "") + sql.lstrip().removeprefix("+")
            return f

        return add

    return queries, oracles, query
