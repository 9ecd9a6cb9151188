"""Pixels of PNG tiles and frames, by Spark's image source."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """path, r, c, red, green, blue of every pixel of the images below path; grey images have three equal values."""

    def unpack(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                a = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                a = np.repeat(a, 3, axis=2) if row.channels == 1 else a[:, :, 2::-1]  # stored as blue, green, red
                r, c = np.indices(a.shape[:2])
                yield pd.DataFrame({"path": row.origin, "r": r.ravel(), "c": c.ravel(), "red": a[:, :, 0].ravel().astype(int), "green": a[:, :, 1].ravel().astype(int), "blue": a[:, :, 2].ravel().astype(int)})

    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    return images.mapInPandas(unpack, "path string, r bigint, c bigint, red int, green int, blue int")


def tile_of(path: Column) -> tuple[Column, Column]:
    """Tile column and row in a name x_y.png."""
    return F.regexp_extract(path, r"(\d+)_(\d+)\.png$", 1).cast("int"), F.regexp_extract(path, r"(\d+)_(\d+)\.png$", 2).cast("int")


def frame_of(path: Column) -> Column:
    """Index in a name frame_0012.png or max_0012.png."""
    return F.regexp_extract(path, r"_(\d+)\.png$", 1).cast("int")


def elevation_cm(red: Column, green: Column, blue: Column) -> Column:
    return red * 65536 + green * 256 + blue


def height_cm(red: Column, green: Column) -> Column:
    return red * 256 + green


def hexadecimal(red: Column, green: Column, blue: Column) -> Column:
    return F.lower(F.format_string("%02x%02x%02x", red, green, blue))
