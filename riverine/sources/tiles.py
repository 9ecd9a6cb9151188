"""Image tiles as a data source: only the asked files are opened, and a set of files is visible once it is whole.

A tile has a layer (a name such as `elevation` or `r7/frame`), and x and y. A set is a folder of PNG files, JSON lines
that list them, and a manifest, which is replaced last. Paths may be of any file system that pyarrow knows.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from riverine.sources import png

FORMAT = "riverine_tiles"
IMAGES = "layer string, x int, y int, t_s double, height int, width int, pixels binary"
PIXELS = "layer string, x int, y int, r bigint, c bigint, red int, green int, blue int"
LISTED = "layer string, x int, y int, t_s double, height int, width int, bytes bigint, file string"
MANIFEST = "manifest.json"


def _system(path: str) -> tuple[Any, str]:
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def _read(system: Any, path: str) -> bytes:
    with system.open_input_stream(path) as f:
        return f.read()


def _write(system: Any, path: str, data: bytes) -> None:
    system.create_dir(posixpath.dirname(path), recursive=True)
    with system.open_output_stream(path) as f:
        f.write(data)


def manifest(path: str) -> dict:
    """The manifest of the last whole set: folder, files, bytes, bounds (x0, x1, y0, y1), times and parts."""
    system, root = _system(path)
    return json.loads(_read(system, f"{root}/{MANIFEST}"))


@dataclass
class _Part(WriterCommitMessage):
    """What a task wrote: its list, and what is in it."""

    name: str
    files: int = 0
    bytes: int = 0
    layers: list[str] = field(default_factory=list)  # the smallest and the largest
    bounds: list[int] = field(default_factory=list)
    times: list[float] = field(default_factory=list)


class TileWriter(DataSourceArrowWriter):
    """Every task writes its files and a list of them; the manifest is built from the tasks' messages."""

    def __init__(self, path: str):
        self.path, self.folder = path, f"set-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        system, root = _system(self.path)
        part, lines = _Part(f"{uuid.uuid4().hex}.jsonl"), []
        for batch in iterator:
            for row in batch.to_pylist():
                pixels = np.frombuffer(row.pop("pixels"), np.uint8).reshape(row["height"], row["width"], -1)
                data, name = png.encode(pixels), f"{row['layer']}/{row['x']}_{row['y']}.png"
                _write(system, f"{root}/{self.folder}/{name}", data)
                lines.append(row | {"bytes": len(data), "file": name})
        if lines:
            span = lambda k: [min(v[k] for v in lines), max(v[k] for v in lines)]
            times = [v["t_s"] for v in lines if v["t_s"] is not None]
            part.files, part.bytes, part.layers = len(lines), sum(v["bytes"] for v in lines), span("layer")
            part.bounds, part.times = span("x") + span("y"), [min(times), max(times)] if times else []
            _write(system, f"{root}/{self.folder}/lists/{part.name}", "\n".join(map(json.dumps, lines)).encode())
        return part

    def commit(self, messages: list[_Part | None]) -> None:
        parts = [m for m in messages if m and m.files]
        system, root = _system(self.path)
        before = self._committed(system, root)
        bounds = [f(p.bounds[i] for p in parts) for i, f in enumerate((min, max, min, max))] if parts else []
        times = [f(p.times[i] for p in parts if p.times) for i, f in enumerate((min, max))] if any(p.times for p in parts) else []
        whole = {
            "folder": self.folder, "files": sum(p.files for p in parts), "bytes": sum(p.bytes for p in parts), "bounds": bounds, "times": times,
            "parts": [{"name": p.name, "layers": p.layers, "bounds": p.bounds} for p in parts],
        }
        ready = f"{root}/{self.folder}/{MANIFEST}"
        _write(system, ready, json.dumps(whole).encode())
        system.move(ready, f"{root}/{MANIFEST}")
        if before:
            system.delete_dir(f"{root}/{before}")

    def _committed(self, system: Any, root: str) -> str | None:
        try:
            return json.loads(_read(system, f"{root}/{MANIFEST}"))["folder"]
        except FileNotFoundError:
            return None

    def abort(self, messages: list[_Part | None]) -> None:
        system, root = _system(self.path)
        system.delete_dir_contents(f"{root}/{self.folder}", missing_dir_ok=True)


@dataclass
class _Asked:
    """Ranges of x and y and sets of layers that are asked for; what isn't named is all."""

    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int] = field(default_factory=dict)
    layers: set[str] | None = None

    def take(self, f: Filter) -> bool:
        """Narrows by a filter; False if it can't."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name == "layer" and isinstance(f, EqualTo | In):
            mine = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.layers = mine if self.layers is None else self.layers & mine
        elif name in ("x", "y") and isinstance(f, EqualTo):
            self.within(name, f.value, f.value)
        elif name in ("x", "y") and isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.within(name, f.value + isinstance(f, GreaterThan), None)
        elif name in ("x", "y") and isinstance(f, LessThan | LessThanOrEqual):
            self.within(name, None, f.value - isinstance(f, LessThan))
        else:
            return False
        return True

    def within(self, name: str, low: int | None, high: int | None) -> None:
        if low is not None:
            self.low[name] = max(self.low.get(name, low), low)
        if high is not None:
            self.high[name] = min(self.high.get(name, high), high)

    def tile(self, row: dict) -> bool:
        inside = all(row[k] >= v for k, v in self.low.items()) and all(row[k] <= v for k, v in self.high.items())
        return inside and (self.layers is None or row["layer"] in self.layers)

    def part(self, part: dict) -> bool:
        """Whether a list can have any of what is asked for."""
        ends = dict(zip(("x", "y"), (part["bounds"][:2], part["bounds"][2:]), strict=True))
        if any(ends[k][1] < v for k, v in self.low.items()) or any(ends[k][0] > v for k, v in self.high.items()):
            return False
        return self.layers is None or any(part["layers"][0] <= v <= part["layers"][1] for v in self.layers)


class _Slice(InputPartition):
    def __init__(self, lines: str):
        self.lines = lines


class TileReader(DataSourceReader):
    """A partition a list of files that can have what is asked for; tasks open only the files that do."""

    def __init__(self, path: str, asked: _Asked, listed: bool):
        self.path, self.asked, self.listed = path, asked, listed

    def partitions(self) -> list[_Slice]:
        whole = manifest(self.path)
        return [_Slice(f"{whole['folder']}/lists/{p['name']}") for p in whole["parts"] if self.asked.part(p)] or [_Slice("")]

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        if not partition.lines:
            return
        system, root = _system(self.path)
        rows = [json.loads(line) for line in _read(system, f"{root}/{partition.lines}").decode().splitlines()]
        rows = [r for r in rows if self.asked.tile(r)]
        if self.listed:
            types = {"x": pa.int32(), "y": pa.int32(), "t_s": pa.float64(), "height": pa.int32(), "width": pa.int32(), "bytes": pa.int64()}
            names = [c.split()[0] for c in LISTED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names)
            return
        folder = posixpath.dirname(posixpath.dirname(partition.lines))
        for row in rows:
            pixels = png.decode(_read(system, f"{root}/{folder}/{row['file']}"))
            pixels = np.repeat(pixels[:, :, :1], 3, axis=2) if pixels.shape[2] < 3 else pixels[:, :, :3]
            n = pixels.shape[0] * pixels.shape[1]
            r, c = np.indices(pixels.shape[:2])
            same = [pa.array([row[k]] * n, t) for k, t in (("layer", pa.string()), ("x", pa.int32()), ("y", pa.int32()))]
            values = [pa.array(pixels[:, :, k].ravel().astype(np.int32)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(r.ravel()), pa.array(c.ravel()), *values], ["layer", "x", "y", "r", "c", "red", "green", "blue"])


class FilteringReader(TileReader):
    """The same for sessions that let Python sources take filters (spark.sql.python.filterPushdown.enabled)."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if not self.asked.take(f):
                yield f


class TileSource(DataSource):
    """Options: path; listed (true for the list of tiles alone); filters (true to take the query's filters);
    x0, x1, y0, y1 (ends included) and layers (a JSON list)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTED if self.options.get("listed") == "true" else PIXELS

    def reader(self, schema: Any) -> TileReader:
        asked = _Asked()
        for k in ("x", "y"):
            low, high = (self.options.get(f"{k}{i}") for i in (0, 1))
            asked.within(k, None if low is None else int(low), None if high is None else int(high))
        if self.options.get("layers"):
            asked.layers = set(json.loads(self.options["layers"]))
        kind = FilteringReader if self.options.get("filters") == "true" else TileReader
        return kind(self.options["path"], asked, self.options.get("listed") == "true")

    def writer(self, schema: Any, overwrite: bool) -> TileWriter:
        return TileWriter(self.options["path"])


def write_images(images: DataFrame, path: str) -> dict:
    """Writes rows of IMAGES (one a file) as a new set in place of the last, and returns its manifest."""
    images.sparkSession.dataSource.register(TileSource)
    columns = [c.split()[0] for c in IMAGES.split(", ")]
    images.select(*columns).write.format(FORMAT).mode("overwrite").option("path", path).save()
    return manifest(path)


def read_tiles(spark: SparkSession, path: str, layers: list[str] | None = None, x: tuple[int, int] | None = None, y: tuple[int, int] | None = None, listed: bool = False) -> DataFrame:
    """Pixels (PIXELS), or the list (LISTED), of the tiles of some layers in ranges of x and y, ends included."""
    spark.dataSource.register(TileSource)
    options = {"path": path, "listed": str(listed).lower(), "filters": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")}
    options |= {f"{k}{i}": str(v[i]) for k, v in (("x", x), ("y", y)) if v for i in (0, 1)}
    if layers is not None:
        options["layers"] = json.dumps(layers)
    return spark.read.format(FORMAT).options(**options).load()


def window(spark: SparkSession, path: str, layer: str, left: int, top: int, right: int, bottom: int, size: int = 256) -> DataFrame:
    """r, c, red, green, blue of every pixel of a layer with left <= c < right and top <= r < bottom; pixels of missing tiles are 0."""
    x, y = (left // size, (right - 1) // size), (top // size, (bottom - 1) // size)
    found = read_tiles(spark, path, [layer], x, y).select((F.col("y") * size + F.col("r")).alias("r"), (F.col("x") * size + F.col("c")).alias("c"), "red", "green", "blue")
    grid = spark.range(x[0], x[1] + 1).select(F.col("id").cast("int").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(y[0]), F.lit(y[1]))))
    gone = grid.join(read_tiles(spark, path, [layer], x, y, listed=True).select("x", "y"), ["x", "y"], "left_anti")
    places = lambda k: F.explode(F.sequence(F.col(k).cast("bigint") * size, F.col(k).cast("bigint") * size + size - 1))
    zero = gone.withColumn("r", places("y")).select("x", "r", places("x").alias("c")).select("r", "c", *[F.lit(0).alias(k) for k in ("red", "green", "blue")])
    return found.unionByName(zero).where((F.col("c") >= left) & (F.col("c") < right) & (F.col("r") >= top) & (F.col("r") < bottom))


def images_of(pixels: DataFrame, channels: list[str], height: int, width: int) -> DataFrame:
    """Rows of IMAGES from pixels (layer, x, y, t_s, r, c and a column a channel); what a tile lacks is 0."""

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((height, width, len(channels)), np.uint8)
        out[part["r"].to_numpy(), part["c"].to_numpy()] = part[channels].fillna(0).to_numpy()
        return pd.DataFrame([(*key[:3], part["t_s"].iloc[0], height, width, out.tobytes())], columns=[c.split()[0] for c in IMAGES.split(", ")])

    return pixels.select("layer", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("t_s").cast("double").alias("t_s"), "r", "c", *channels).groupBy("layer", "x", "y").applyInPandas(pack, IMAGES)
