"""Flow directions, accumulation, longest paths and channels of a raster (r, c, z)."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverine.functions.hydraulics import LEAST_SLOPE, channel_depth, channel_width, overflow_depth, path_velocity
from riverine.operators.lookups import sorted_points

#: Neighbours (columns east, rows south) in the order of the direction flags 1, 2, 4, ... 128.
NEIGHBOURS = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]
DIAGONAL = 1.4142135623730951


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="riverine-")


def shared_folder(spark: SparkSession) -> str:
    """A run's own folder within spark.checkpoint.dir, which driver and executors share; unset on a single machine, in one of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(folder or _own_folder()).rstrip('/')}/riverine/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> bool:
    """Deletes what this run has written to its folder; whatever still reads from there is lost. To call when results are stored, or after a failure."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes a round's rows to the run's folder and reads them again, so that lineage ends there."""
    folder = shared_folder(spark)

    def write(df: DataFrame) -> DataFrame:
        path = f"{folder}/round-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


def counted(df: DataFrame, row_bytes: int = 100, most: int = 64 << 20) -> DataFrame:
    """Writes df and marks it for broadcast if its counted rows, at row_bytes each, stay within `most` bytes."""
    kept = scratch(df.sparkSession)(df)
    return F.broadcast(kept) if kept.count() * row_bytes <= most else kept


def directions(cells: DataFrame, dx: float, tile: int = 256) -> DataFrame:
    """r, c, z, flag, to_r, to_c, slope: the steepest descent, the first of equals; flag 0 and NULLs at sinks and missing cells.

    A tile and the cells around it are one block of an array; only cells at a tile's edge go to more than one tile.
    """
    reach = lambda k: F.explode(F.sequence(F.floor((F.col(k) - 1) / tile), F.floor((F.col(k) + 1) / tile)))
    placed = cells.select(F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), F.col("z").cast("double").alias("z")).withColumn("tr", reach("r")).withColumn("tc", reach("c"))

    lengths = np.array([dx * (DIAGONAL if a and b else 1.0) for a, b in NEIGHBOURS])[:, None, None]

    def steepest(key: tuple[int, int], part: pd.DataFrame) -> pd.DataFrame:
        y, x = (part["r"] - key[0] * tile).to_numpy(), (part["c"] - key[1] * tile).to_numpy()
        z = np.full((tile + 2, tile + 2), np.nan)
        z[y + 1, x + 1] = part["z"]
        around = np.stack([z[1 + dy : 1 + dy + tile, 1 + dx_ : 1 + dx_ + tile] for dx_, dy in NEIGHBOURS])
        slopes = np.nan_to_num((z[1:-1, 1:-1] - around) / lengths, nan=-np.inf)
        toward = slopes.argmax(axis=0)  # the first of equals
        slope = np.take_along_axis(slopes, toward[None], axis=0)[0]
        toward[slope <= 0] = -1
        own = (y >= 0) & (y < tile) & (x >= 0) & (x < tile)
        out = part.loc[own, ["r", "c", "z"]]
        k, s = toward[y[own], x[own]], slope[y[own], x[own]]
        step = np.array(NEIGHBOURS)[k]
        flows = lambda v: pd.array(v, "Int64").copy()
        to_r, to_c = flows(out["r"].to_numpy() + step[:, 1]), flows(out["c"].to_numpy() + step[:, 0])
        to_r[k < 0], to_c[k < 0] = pd.NA, pd.NA
        return out.assign(flag=np.where(k < 0, 0, 1 << np.maximum(k, 0)).astype(np.int16), to_r=to_r, to_c=to_c, slope=np.where(k < 0, np.nan, s))

    return placed.groupBy("tr", "tc").applyInPandas(steepest, "r bigint, c bigint, z double, flag smallint, to_r bigint, to_c bigint, slope double")


#: Paths are added up in whole billionths of a cell, so that equal paths are equal whatever the order.
UNIT = 1_000_000_000
_STRAIGHT, _SLANTED = UNIT, round(DIAGONAL * UNIT)


class _Tile:
    """Flow within one tile: cells by place (row * tile + column), the place each points at (-1 out of the tile, -2 nowhere)."""

    def __init__(self, to: np.ndarray, steps: np.ndarray, here: np.ndarray):
        self.to, self.steps = to, steps
        waiting = np.bincount(to[to >= 0], minlength=len(to))
        front = np.flatnonzero(here & (waiting == 0))
        self.fronts = []  # every cell comes after all that point at it
        while len(front):
            self.fronts.append(front)
            ahead = to[front]
            ahead = ahead[ahead >= 0]
            np.subtract.at(waiting, ahead, 1)
            ahead = np.unique(ahead)
            front = ahead[waiting[ahead] == 0]

    def gather(self, acc: np.ndarray, path: np.ndarray, head: np.ndarray) -> None:
        """Hands on what cells have gathered: sums, and the longest path with its head, the higher of equals."""
        for front in self.fronts:
            front = front[self.to[front] >= 0]
            ahead = self.to[front]
            np.add.at(acc, ahead, acc[front])
            raise_best(path, head, ahead, path[front] + self.steps[front], head[front])

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The last cell of this tile on every cell's way, and how far it is."""
        last, far = np.arange(len(self.to)), np.zeros(len(self.to), np.int64)
        for front in reversed(self.fronts):
            front = front[self.to[front] >= 0]
            last[front], far[front] = last[self.to[front]], far[self.to[front]] + self.steps[front]
        return last, far


def raise_best(path: np.ndarray, head: np.ndarray, at: np.ndarray, new_path: np.ndarray, new_head: np.ndarray) -> None:
    """Puts the largest (path, head) of what is there and what is new."""
    order = np.lexsort((new_head, new_path, at))
    at, new_path, new_head = at[order], new_path[order], new_head[order]
    top = np.append(at[1:] != at[:-1], True)[: len(at)]
    at, new_path, new_head = at[top], new_path[top], new_head[top]
    better = (new_path > path[at]) | ((new_path == path[at]) & (new_head > head[at]))
    path[at[better]], head[at[better]] = new_path[better], new_head[better]


def routed(flow: DataFrame, dx: float, tile: int = 256) -> DataFrame:
    """r, c, acc (cells that drain through, itself included), path_m (longest upstream path) and head_z (where that begins, the higher of equals).

    A tile is one row, routed by itself. What crosses tiles is a graph of the cells at which flow leaves them: each one
    points at the cell at which its water leaves the next tile. There pointers double: in every round each such cell
    hands what it has gathered to the one that it points at, then points where that one points, so that the rounds are
    the logarithm of the tiles that the longest path crosses. At last the totals enter the tiles, which are routed again.
    """
    write = scratch(flow.sparkSession)
    number = lambda k: F.floor(F.col(k) / tile)
    named = flow.select(number("r").alias("tr"), number("c").alias("tc"), *[F.col(k).cast("bigint").alias(k) for k in ("r", "c", "to_r", "to_c")], F.col("z").cast("double").alias("z"))

    def pack(key: tuple[int, int], part: pd.DataFrame) -> pd.DataFrame:
        y, x = (part["r"] - key[0] * tile).to_numpy(), (part["c"] - key[1] * tile).to_numpy()
        at = y * tile + x
        flows = part["to_r"].notna().to_numpy()
        v, u = part["to_r"].fillna(0).to_numpy(np.int64) - key[0] * tile, part["to_c"].fillna(0).to_numpy(np.int64) - key[1] * tile
        inside = flows & (v >= 0) & (v < tile) & (u >= 0) & (u < tile)
        to, way, z = np.full(tile * tile, -3, np.int64), np.zeros((tile * tile, 2), np.int8), np.full(tile * tile, np.nan)
        to[at] = np.where(inside, v * tile + u, np.where(flows, -1, -2))
        way[at[flows]] = np.stack([v - y, u - x], axis=1)[flows]
        z[at] = part["z"]
        return pd.DataFrame({"tr": [key[0]], "tc": [key[1]], "to": [to.tobytes()], "way": [way.tobytes()], "z": [z.tobytes()]})

    def opened(row: pd.Series) -> tuple[_Tile, np.ndarray, np.ndarray, np.ndarray]:
        to, way, z = np.frombuffer(row.to, np.int64), np.frombuffer(row.way, np.int8).reshape(-1, 2), np.frombuffer(row.z).copy()
        steps = np.where(way.all(axis=1), _SLANTED, _STRAIGHT)
        return _Tile(to, steps, to > -3), way, steps, z

    def edges(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        line = np.arange(tile * tile)
        rim = (line // tile % (tile - 1) == 0) | (line % tile % (tile - 1) == 0) if tile > 1 else line >= 0
        for part in parts:
            for row in part.itertuples():
                one, way, steps, z = opened(row)
                acc, path, head = (one.to > -3).astype(np.int64), np.zeros(tile * tile, np.int64), z
                one.gather(acc, path, head)
                last, far = one.ends()
                k = np.flatnonzero(rim & (one.to > -3))
                r, c = row.tr * tile + k // tile, row.tc * tile + k % tile
                leaves, through = one.to[k] == -1, one.to[last[k]] == -1
                yield pd.DataFrame({
                    "r": r, "c": c, "leaves": leaves, "to_r": r + way[k, 0], "to_c": c + way[k, 1], "step": steps[k], "through": through,
                    "end_r": row.tr * tile + last[k] // tile, "end_c": row.tc * tile + last[k] % tile, "far": far[k], "acc": acc[k], "path": path[k], "head": head[k],
                })

    def finish(key: tuple[int, int], tiles: pd.DataFrame, mail: pd.DataFrame) -> pd.DataFrame:
        if tiles.empty:
            return pd.DataFrame({k: [] for k in ("r", "c", "acc", "path_m", "head_z")})
        one, _, _, z = opened(next(tiles.itertuples()))
        acc, path, head = (one.to > -3).astype(np.int64), np.zeros(tile * tile, np.int64), z
        at = ((mail["r"] - key[0] * tile) * tile + mail["c"] - key[1] * tile).to_numpy(np.int64)
        acc[at] += mail["acc"].to_numpy(np.int64)
        raise_best(path, head, at, mail["path"].to_numpy(np.int64), mail["head"].to_numpy())
        one.gather(acc, path, head)
        k = np.flatnonzero(one.to > -3)
        return pd.DataFrame({"r": key[0] * tile + k // tile, "c": key[1] * tile + k % tile, "acc": acc[k], "path_m": path[k] / UNIT * dx, "head_z": head[k]})

    packed = write(named.groupBy("tr", "tc").applyInPandas(pack, "tr bigint, tc bigint, to binary, way binary, z binary"))
    rim = write(packed.mapInPandas(edges, "r bigint, c bigint, leaves boolean, to_r bigint, to_c bigint, step bigint, through boolean, end_r bigint, end_c bigint, far bigint, acc bigint, path bigint, head double"))
    there = rim.select(F.col("r").alias("to_r"), F.col("c").alias("to_c"), F.col("through").alias("on"), F.col("end_r").alias("jr"), F.col("end_c").alias("jc"), F.col("far").alias("beyond"))
    out = rim.where("leaves").join(there, ["to_r", "to_c"], "left")
    ends = lambda k: F.when(F.col("on"), F.col(k)).alias(k)
    state = write(out.select("r", "c", ends("jr"), ends("jc"), "acc", F.when(F.col("on"), F.col("step") + F.col("beyond")).alias("dist"), F.struct("path", "head").alias("best")))
    totals = _doubled(state, write)
    mail = rim.where("leaves").select("r", "c", "to_r", "to_c", "step").join(totals.select("r", "c", "acc", "best"), ["r", "c"])
    entering = mail.groupBy(F.col("to_r").alias("r"), F.col("to_c").alias("c")).agg(F.sum("acc").alias("acc"), F.max(F.struct((F.col("best.path") + F.col("step")).alias("path"), F.col("best.head").alias("head"))).alias("b"))
    placed = entering.select(number("r").alias("tr"), number("c").alias("tc"), "r", "c", "acc", "b.path", "b.head")
    return packed.groupBy("tr", "tc").cogroup(placed.groupBy("tr", "tc")).applyInPandas(finish, "r bigint, c bigint, acc bigint, path_m double, head_z double")


def _doubled(state: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Totals of nodes (r, c, acc, best) that point at jr, jc, dist away. Gatherings are summed before the exchange, nodes that point nowhere leave the join, and each round is written."""
    while True:  # paths descend, so they end
        moving = state.where("jr IS NOT NULL")
        if moving.isEmpty():
            return state
        given = moving.groupBy(F.col("jr").alias("r"), F.col("jc").alias("c")).agg(F.sum("acc").alias("more"), F.max(F.struct((F.col("best.path") + F.col("dist")).alias("path"), F.col("best.head").alias("head"))).alias("longer"))
        ahead = state.select(F.col("r").alias("jr"), F.col("c").alias("jc"), F.col("jr").alias("kr"), F.col("jc").alias("kc"), F.col("dist").alias("far"))
        jumped = moving.select("r", "c", "jr", "jc", "dist").join(ahead, ["jr", "jc"]).select("r", "c", F.col("kr"), F.col("kc"), (F.col("dist") + F.col("far")).alias("far"))
        state = write(
            state.join(given, ["r", "c"], "left").join(jumped, ["r", "c"], "left")
            .select("r", "c", F.col("kr").alias("jr"), F.col("kc").alias("jc"), (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc"), F.col("far").alias("dist"), F.greatest("best", F.coalesce("longer", "best")).alias("best"))
        )


def streams(acc: DataFrame, sea: DataFrame, threshold: float) -> DataFrame:
    """r, c of cells with at least `threshold` cells, but for those at sea (r, c)."""
    return acc.where(F.col("acc") >= threshold).select("r", "c").join(sea.select("r", "c"), ["r", "c"], "left_anti")


def stream_intensity(acc: DataFrame, least: float = 80.0) -> DataFrame:
    """r, c and log1p(acc) over log1p of the largest; below `least` 0."""
    shown = acc.select("r", "c", F.when(F.col("acc") >= least, F.col("acc").cast("double")).otherwise(F.lit(0.0)).alias("a"))
    peak = F.broadcast(shown.agg(F.greatest(F.max("a"), F.lit(1.0)).alias("peak")))
    return shown.crossJoin(peak).select("r", "c", (F.log1p("a") / F.log1p("peak")).alias("intensity"))


def channels(cells: DataFrame, dx: float, threshold: float = 200.0) -> DataFrame:
    """r, c, area_m2, slope, width_m, depth_m, lag_s of cells with at least `threshold` upstream cells. Give it a filled raster."""
    flow = directions(cells, dx)
    got = routed(flow, dx).where(F.col("acc") >= threshold).join(flow.select("r", "c", "z", "slope"), ["r", "c"])
    area = F.col("acc") * dx * dx
    path_slope = (F.col("head_z") - F.col("z")) / F.greatest("path_m", F.lit(1e-6))
    return got.select(
        "r", "c", area.alias("area_m2"), F.greatest(F.coalesce("slope", F.lit(LEAST_SLOPE)), F.lit(LEAST_SLOPE)).alias("slope"), channel_width(area).alias("width_m"), channel_depth(area).alias("depth_m"),
        (F.col("path_m") / path_velocity(path_slope)).alias("lag_s"),
    )


#: Weights, and lags before a time, of the rates that a channel sees.
TAPS = [(0.25, 0.5), (0.5, 1.0), (0.25, 1.5)]
#: Bytes of times and series up to which they are broadcast.
BROADCAST_BYTES = 64 << 20


#: Look-ups in one array operation, but for those of a single row.
LOOKUPS = 1 << 20


def _between(at: np.ndarray, first: np.ndarray, size: np.ndarray, t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """between_points of times `at`, each in a series of `size` points from `first` of t and v, found by halving all at once."""
    low, high = np.zeros(len(at), np.int64), size.copy()  # points before `at`
    while True:
        open_ = low < high
        if not open_.any():
            break
        mid = (low + high) // 2
        before = open_ & (t[np.where(open_, first + mid, 0)] < at)
        low, high = np.where(before, mid + 1, low), np.where(open_ & ~before, mid, high)
    got = np.zeros(len(at))
    start, inside = (low == 0) & (size > 0), (low > 0) & (low < size)
    got[start] = v[first[start]]
    k, q = (first + low)[inside], at[inside]
    got[inside] = v[k - 1] + (v[k] - v[k - 1]) * ((q - t[k - 1]) / np.maximum(t[k] - t[k - 1], 1e-6))
    return got


def _seen_rates(lag: pa.Array, times: pa.Array, t: pa.Array, v: pa.Array) -> pa.Array:
    """Of each row the rates at its times, as a list."""
    lags = lag.to_numpy(zero_copy_only=False)
    sizes, points = (a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (times, t))
    first, ends = np.cumsum(points) - points, np.cumsum(sizes)
    asked, at, value = (a.flatten().to_numpy(zero_copy_only=False) for a in (times, t, v))
    found, begin = [], 0
    while begin < len(sizes):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + LOOKUPS, "right")))
        n, q = sizes[begin:stop], asked[done : ends[stop - 1]]
        spread = lambda a: np.repeat(a[begin:stop], n)  # noqa: B023, E731
        back, own, held = spread(lags), spread(first), spread(points)
        found.append(sum(w * _between(q - k * back, own, held, at, value) for w, k in TAPS))
        begin = stop
    values = np.concatenate(found) if found else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.float64()))


def lagged_rates(channel: DataFrame, times: DataFrame, series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, r, c, t_s, rate: a quarter, a half and a quarter of the rates at 0.5, 1 and 1.5 lags before t. times: keys, t_s; series: keys, t_s, mm_h.

    Times and series travel to the channel as one row of arrays a key, broadcast if their counted points are few; rates
    are looked up by halving, an Arrow batch at once, so channel cells are neither exchanged nor multiplied before their
    result. Other columns of the channel go along, so that nothing needs to be joined to the result.
    """
    keys, write = keys or [], scratch(channel.sparkSession)
    asked = times.groupBy(*keys).agg(F.collect_list(F.col("t_s").cast("double")).alias("__times"))
    points = sorted_points(series, keys, "mm_h")
    both = asked.join(points, keys, "left") if keys else asked.crossJoin(points)  # one row each without keys
    both = write(both.select(*keys, "__times", *[F.col(f"__points.{k}").alias(f"__{k}") for k in ("t", "v")]))
    n = both.agg(F.sum(F.size("__times") + F.coalesce(F.size("__t"), F.lit(0)))).first()[0] or 0
    spread = channel.repartition(8 * channel.sparkSession.sparkContext.defaultParallelism, "r", "c")
    pairs = spread.crossJoin(F.broadcast(both) if n * 16 <= BROADCAST_BYTES else both)
    others = [c for c in channel.columns if c not in ("r", "c", "lag_s")]

    @F.arrow_udf("array<double>")
    def rates(lag: pa.Array, times: pa.Array, t: pa.Array, v: pa.Array) -> pa.Array:
        return _seen_rates(lag, times, t, v)

    found = pairs.select(*keys, "r", "c", *others, "__times", rates("lag_s", "__times", "__t", "__v").alias("__rates"))
    return found.select(*keys, "r", "c", *others, "__times", F.posexplode("__rates").alias("__n", "rate")).select(*keys, "r", "c", F.get("__times", F.col("__n")).alias("t_s"), "rate", *others)


def overflow(rates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, r, c, t_s, rate and the depth that leaves the channel, of rates with the channel's columns."""
    return rates.select(*(keys or []), "r", "c", "t_s", "rate", overflow_depth(F.col("rate"), F.col("area_m2"), F.col("width_m"), F.col("slope"), F.col("depth_m")).alias("excess_m"))
