"""Image tiles as a data source: files, filters, missing tiles, commits and aborts."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverine.sources import png, tiles


def chunked(header, rows, palette=None):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", *header)) + (chunk(b"PLTE", palette) if palette else b"")
    return png.SIGNATURE + body + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_round_trip(channels):
    a = np.random.default_rng(channels).integers(0, 256, (5, 9, channels)).astype(np.uint8)
    assert (png.decode(png.encode(a)) == a).all()


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    """Rows filtered pixel by pixel as the format has it."""
    a = np.random.default_rng(kind).integers(0, 256, (6, 5, 3)).astype(int)
    wide = np.zeros((7, 6, 3), int)
    wide[1:, 1:] = a
    rows = b""
    for y in range(1, 7):
        rows += bytes([kind])
        for x in range(1, 6):
            for k in range(3):
                left, up, corner = wide[y, x - 1, k], wide[y - 1, x, k], wide[y - 1, x - 1, k]
                p = left + up - corner
                nearest = min((left, up, corner), key=lambda v: (abs(p - v),)) if kind == 4 else 0
                guess = {1: left, 2: up, 3: (left + up) // 2, 4: nearest}[kind]
                rows += bytes([(wide[y, x, k] - guess) % 256])
    assert (png.decode(chunked((5, 6, 8, 2, 0, 0, 0), rows)) == a).all()


def test_png_palette_and_errors():
    got = png.decode(chunked((2, 1, 8, 3, 0, 0, 0), b"\0\1\0", bytes([1, 2, 3, 9, 8, 7])))
    assert got.tolist() == [[[9, 8, 7], [1, 2, 3]]]
    with pytest.raises(ValueError):
        png.decode(b"no picture")
    with pytest.raises(ValueError):
        png.decode(chunked((1, 1, 16, 0, 0, 0, 0), b"\0\0\0"))


@pytest.fixture
def written(spark, tmp_path):
    """Layer a: tiles of 4 x 4 over 12 x 8 pixels, one of them missing; red counts columns, green rows. Layer b: one tile."""
    cells = spark.range(96).select(F.floor(F.col("id") / 12).alias("r"), (F.col("id") % 12).alias("c"))
    pixels = cells.selectExpr("'a' AS layer", "floor(c / 4) AS x", "floor(r / 4) AS y", "cast(floor(c / 4) AS double) AS t_s", "r % 4 AS r", "c % 4 AS c", "c + 1 AS red", "r + 1 AS green", "7 AS blue")
    other = pixels.where("x = 0 AND y = 0").withColumn("layer", F.lit("b/c"))
    path = f"file://{tmp_path}/set"
    made = tiles.write_images(tiles.images_of(pixels.where("NOT (x = 1 AND y = 1)").unionByName(other), ["red", "green", "blue"], 4, 4), path)
    return path, made


def test_window_with_a_missing_tile(spark, written):
    path, _ = written
    got = {(r.r, r.c): (r.red, r.green, r.blue) for r in tiles.window(spark, path, "a", 1, 2, 11, 8, 4).collect()}
    assert got == {(r, c): (0, 0, 0) if r >= 4 and 4 <= c < 8 else (c + 1, r + 1, 7) for r in range(2, 8) for c in range(1, 11)}
    assert tiles.window(spark, path, "none", 0, 0, 4, 4, 4).where("red = 0").count() == 16


def test_manifest_and_list(spark, written, tmp_path):
    path, made = written
    listed = tiles.read_tiles(spark, path, listed=True).collect()
    assert made["files"] == len(listed) == 6 and made["bytes"] == sum(r.bytes for r in listed)
    assert made["bounds"] == [0, 2, 0, 1] and made["times"] == [0.0, 2.0]
    assert {r.file for r in listed} == {"a/0_0.png", "a/1_0.png", "a/2_0.png", "a/0_1.png", "a/2_1.png", "b/c/0_0.png"}
    assert all((tmp_path / "set" / made["folder"] / r.file).stat().st_size == r.bytes for r in listed)


def test_only_asked_files_are_opened(spark, written, tmp_path):
    """A damaged file does no harm as long as it isn't asked for, by options or by the query's own filters."""
    path, made = written
    (tmp_path / "set" / made["folder"] / "a/2_0.png").write_bytes(b"damaged")
    assert tiles.read_tiles(spark, path, ["a"], (0, 1)).count() == 48
    assert tiles.read_tiles(spark, path, ["b/c"]).count() == 16
    with pytest.raises(Exception, match="PNG"):
        tiles.read_tiles(spark, path, ["a"], (2, 2)).count()
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        pixels = tiles.read_tiles(spark, path)
        assert pixels.where("layer = 'a' AND x < 2 AND r >= 2").count() == 24
        assert pixels.where("layer IN ('b/c') AND y >= 0").count() == 16 and pixels.where("x > 1 AND y = 1").count() == 16
    finally:
        spark.conf.unset(key)


def test_a_set_replaces_the_last_and_an_abort_leaves_it(spark, written, tmp_path):
    path, made = written
    bad = spark.createDataFrame([("a", 0, 0, None, 1, 1, bytearray(3)), ("a", 1, 0, None, 2, 2, bytearray(5))], tiles.IMAGES)
    with pytest.raises(Exception):
        tiles.write_images(bad.repartition(2), path)
    assert tiles.manifest(path) == made and tiles.read_tiles(spark, path, ["a"], (0, 0), (0, 0)).where("red > 0").count() == 16
    new = tiles.write_images(spark.createDataFrame([("z", 5, 6, 1.5, 1, 1, bytearray([1, 2, 3]))], tiles.IMAGES), path)
    assert new["files"] == 1 and tiles.read_tiles(spark, path).select("layer", "x", "y", "red", "green", "blue").collect() == [("z", 5, 6, 1, 2, 3)]
    assert json.loads((tmp_path / "set/manifest.json").read_text()) == new and not (tmp_path / "set" / made["folder"]).exists()


def test_empty_set(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    made = tiles.write_images(spark.createDataFrame([], tiles.IMAGES), path)
    assert made["files"] == 0 and tiles.read_tiles(spark, path).collect() == [] and tiles.read_tiles(spark, path, listed=True).collect() == []
