"""Building footprints as rasters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverine.functions.geo import pixel

#: Pixels in one Arrow batch at most, but for a single run of pixels.
BATCH_PIXELS = 1 << 20
#: Rings (once a tile) in one partition, about.
RINGS = 50_000


def _runs(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every range [first, stop): its number, and each of its members."""
    n = np.maximum(stop - first, 0)
    of = np.repeat(np.arange(len(n)), n)
    return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def spans(y: np.ndarray, x: np.ndarray, sizes: np.ndarray, rows: np.ndarray, cols: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ring, row, first and stop column of the runs of pixels whose centres lie in rings by the even-odd rule.

    y, x: corners of all rings in turn, `sizes` of each; rows and cols: where each ring's tile begins. A pixel row is
    crossed by edges whose ends lie on both sides of its centre; crossings in order of x bound the runs in pairs.
    """
    ring = np.repeat(np.arange(len(sizes)), sizes)
    after = np.arange(1, len(y) + 1)
    full = sizes > 0
    after[np.cumsum(sizes)[full] - 1] = (np.cumsum(sizes) - sizes)[full]
    to_y, to_x = y[after], x[after]
    ceil = lambda v: np.ceil(v - 0.5)
    top = np.maximum(ceil(np.minimum(y, to_y)), rows[ring]).astype(np.int64)
    bottom = np.minimum(ceil(np.maximum(y, to_y)), rows[ring] + tile).astype(np.int64)
    edge, row = _runs(top, bottom)
    at = x[edge] + (to_x[edge] - x[edge]) * (row + 0.5 - y[edge]) / (to_y[edge] - y[edge])
    order = np.lexsort((at, row, ring[edge]))
    of, row, at = ring[edge][order], row[order], at[order]
    left, right = np.maximum(ceil(at[0::2]), cols[of[0::2]]), np.minimum(ceil(at[1::2]), cols[of[0::2]] + tile)
    return of[0::2], row[0::2], left.astype(np.int64), right.astype(np.int64)


def in_pixels(buildings: DataFrame, tile_x0: int, tile_y0: int) -> DataFrame:
    """buildings with rings of lon, lat turned into rings of y, x: pixels from the north-west corner of a tile."""

    def corner(p: Column) -> Column:
        x, y = pixel(p["lon"], p["lat"], F.lit(tile_x0), F.lit(tile_y0))
        return F.struct(y.alias("y"), x.alias("x"))

    return buildings.withColumn("ring", F.transform("ring", corner))


def rasterised(buildings: DataFrame, tile: int = 256) -> DataFrame:
    """r, c, height_cm of pixels whose centre is in a ring (even-odd); of overlapping buildings the last by (file, seq) counts.

    buildings: file, seq, height_cm, ring (array of struct y, x in pixels). A ring goes to every tile that its box
    touches, so that one ring gives a bounded number of pixels a row; all rings of an Arrow batch are painted at once.
    Rings are laid out by tile and order in partitions of RINGS, and of the pixels painted at once the last of each goes on.
    """
    ys, xs = F.transform("ring", lambda p: p["y"]), F.transform("ring", lambda p: p["x"])
    floor = lambda v: F.floor(v / tile)
    tiles = buildings.select("file", "seq", "height_cm", ys.alias("y"), xs.alias("x"))
    for axis, name in (("y", "tr"), ("x", "tc")):
        tiles = tiles.withColumn(name, F.explode(F.sequence(floor(F.array_min(axis)), floor(F.array_max(axis)))))

    def paint(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            flat = {k: part.column(k).flatten().to_numpy(zero_copy_only=False) for k in ("y", "x")}
            sizes = part.column("y").value_lengths().to_numpy(zero_copy_only=False)
            begins = {k: part.column(k).to_numpy(zero_copy_only=False) * tile for k in ("tr", "tc")}
            ring, row, left, right = spans(flat["y"], flat["x"], sizes, begins["tr"], begins["tc"], tile)
            ends = np.cumsum(np.maximum(right - left, 0))
            begin = 0
            while begin < len(ends):
                stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + BATCH_PIXELS, "right")))
                run, col = _runs(left[begin:stop], right[begin:stop])
                of, line = ring[begin:stop][run], row[begin:stop][run]
                order = np.lexsort((of, col, line))  # rings come in order, so that the last of a pixel's counts
                of, line, col = of[order], line[order], col[order]
                last = np.ones(len(of), bool)
                last[:-1] = (line[1:] != line[:-1]) | (col[1:] != col[:-1])
                kept = [part.column(k).take(pa.array(of[last])) for k in ("file", "seq", "height_cm")]
                yield pa.RecordBatch.from_arrays([pa.array(line[last]), pa.array(col[last]), *kept], ["r", "c", "file", "seq", "height_cm"])
                begin = stop

    rings = tiles.selectExpr("tr", "tc", "file", "CAST(seq AS BIGINT) AS seq", "CAST(height_cm AS BIGINT) AS height_cm", "y", "x")
    order = ["tr", "tc", "file", "seq"]
    n = max(buildings.sparkSession.sparkContext.defaultParallelism, tiles.count() // RINGS + 1)
    pixels = rings.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(paint, "r bigint, c bigint, file string, seq bigint, height_cm bigint")
    return pixels.groupBy("r", "c").agg(F.max_by("height_cm", F.struct("file", "seq")).alias("height_cm"))
