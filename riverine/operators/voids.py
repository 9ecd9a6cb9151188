"""Voids and depressions of an elevation raster: sea, holes, filling. Work is in tiles; only their edges are exchanged."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverine.operators.drainage import NEIGHBOURS, scratch


def _labels(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """At every set cell of a mask the place (row * width + column) of its connected group's first cell, -1 elsewhere.

    Runs of a row are joined with the runs that they touch in the next row; groups are then found by arrays: every run
    takes the smallest number around it, and the number of that one, until nothing changes.
    """
    height, width = mask.shape
    wide = width + 2  # runs of different rows never touch in one line of places
    flat = np.zeros(height * wide + 1, np.int8)
    flat[:-1].reshape(height, wide)[:, 1:-1] = mask
    turns = np.flatnonzero(np.diff(flat, prepend=0))
    start, stop = turns[0::2], turns[1::2]
    if not len(start):
        return np.full(mask.shape, -1, np.int64)
    slack = 1 if diagonal else 0
    low = np.searchsorted(stop, start + wide - slack, "right")
    high = np.searchsorted(start, stop + wide + slack, "left")
    n = np.maximum(high - low, 0)
    above = np.repeat(np.arange(len(start)), n)
    below = low[above] + np.arange(len(above)) - np.repeat(np.cumsum(n) - n, n)
    label = np.arange(len(start))
    while True:
        before = label.copy()
        least = np.minimum(label[above], label[below])
        np.minimum.at(label, label[above], least)
        np.minimum.at(label, label[below], least)
        np.minimum.at(label, above, least)
        np.minimum.at(label, below, least)
        label = label[label]
        if (label == before).all():
            break
    found = np.full(height * wide, -1, np.int64)
    sizes = stop - start
    cells = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    first = start[label]
    found[cells] = np.repeat(first // wide * width + first % wide - 1, sizes)
    return found.reshape(height, wide)[:, 1:-1]


def void_groups(cells: DataFrame, diagonal: bool = False, tile: int = 256, among: str = "elev IS NULL") -> DataFrame:
    """r, c, group of the cells `among`: groups of neighbours share the smallest label.

    Cells are labelled inside their tile, then labels that meet at tile edges are joined until nothing changes.
    """
    write = scratch(cells.sparkSession)
    named = cells.where(among).select("r", "c", F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"))

    def label(key: tuple[int, int], part: pd.DataFrame) -> pd.DataFrame:
        r, c = part["r"].to_numpy(), part["c"].to_numpy()
        y, x = r - key[0] * tile, c - key[1] * tile
        mask = np.zeros((tile, tile), bool)
        mask[y, x] = True
        first = _labels(mask, diagonal)[y, x]
        group = (first // tile + key[0] * tile) << 31 | (first % tile + key[1] * tile)
        return pd.DataFrame({"r": r, "c": c, "tr": part["tr"], "tc": part["tc"], "group": group})

    schema = "r bigint, c bigint, tr bigint, tc bigint, group bigint"
    labelled = write(named.groupBy("tr", "tc").applyInPandas(label, schema))
    edge = labelled.where(f"r % {tile} IN (0, {tile - 1}) OR c % {tile} IN (0, {tile - 1})")
    steps = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for x, y in NEIGHBOURS if diagonal or not (x and y)])
    asked = edge.select("group", "tr", "tc", F.explode(steps).alias("s"), "r", "c").select(F.col("group").alias("u"), F.col("tr").alias("ur"), F.col("tc").alias("uc"), (F.col("r") + F.col("s.y")).alias("r"), (F.col("c") + F.col("s.x")).alias("c"))
    links = write(asked.join(edge, ["r", "c"]).where("ur <> tr OR uc <> tc").select("u", F.col("group").alias("v")).distinct())
    smallest = write(links.select(F.col("u").alias("group"), F.col("u").alias("least")).distinct())
    while True:  # labels shrink along links and through each other
        near = links.join(smallest, links["v"] == smallest["group"]).groupBy("u").agg(F.min("least").alias("m"))
        step = smallest.join(near, F.col("group") == F.col("u")).select("group", "least", F.least("least", "m").alias("now"))
        through = step.alias("a").join(step.select(F.col("group").alias("k"), F.col("now").alias("then")), F.col("a.now") == F.col("k"), "left")
        after = write(through.select("group", "least", F.least("now", F.coalesce("then", "now")).alias("now")))
        if after.where("now < least").isEmpty():
            break
        smallest = after.select("group", F.col("now").alias("least"))
    return labelled.join(smallest, "group", "left").select("r", "c", F.coalesce("least", "group").alias("group"))


def classified(cells: DataFrame, tile: int = 256) -> DataFrame:
    """cells with sea: voids connected (by sides) with the grid's border. Other voids are holes."""
    size = F.broadcast(cells.agg(F.max("r").alias("__r"), F.max("c").alias("__c")))
    groups = void_groups(cells, False, tile)
    wet = groups.crossJoin(size).where("r = 0 OR c = 0 OR r = __r OR c = __c").select("group").distinct()
    sea = groups.join(wet, "group").select("r", "c", F.lit(True).alias("sea"))
    return cells.join(sea, ["r", "c"], "left").withColumn("sea", F.coalesce("sea", F.lit(False)))


#: Kinds of cells in a tile whose holes are filled: none, known, hole, sea.
NOTHING, KNOWN, HOLE, SEA = range(4)


def _diffuse(z: np.ndarray, rounds: int) -> int:
    """Fills cells of NaN, but for the outermost, by rounds of means over what is known in 3 x 3; returns the rounds that changed anything.

    Cells beyond the raster are infinite: never known, never filled.
    """
    flat, wide = z.ravel(), z.shape[1]
    inner = np.zeros(z.shape, bool)
    inner[1:-1, 1:-1] = True
    open_ = np.flatnonzero(np.isnan(flat) & inner.ravel())
    steps = np.array([y * wide + x for x, y in NEIGHBOURS])
    for k in range(rounds):
        if not len(open_):
            return k
        around = flat[open_[:, None] + steps]
        have = np.isfinite(around)
        n = have.sum(axis=1)
        ready = n > 0
        if not ready.any():
            return k
        flat[open_[ready]] = np.where(have, around, 0.0).sum(axis=1)[ready] / n[ready]
        open_ = open_[~ready]
    return rounds


def filled_holes(cells: DataFrame, tile: int = 256, rounds: int = 500, halo: int = 32) -> DataFrame:
    """r, c, elev, sea of classified cells: sea is 0 m, holes are filled by rounds of means over known cells of 3 x 3.

    A tile is one row with its cells in an array. With bands of `halo` cells around it from its neighbours it runs as
    many rounds by itself, since what is wrong beyond the bands moves one cell a round; then bands are exchanged anew.
    Only tiles with open cells run, and only their neighbours send bands. A hole may span any number of tiles. What is
    left after `rounds`, or can't be reached, is 0.
    """
    write = scratch(cells.sparkSession)
    halo = min(halo, tile)
    kind = F.when(F.col("sea"), SEA).when(F.col("elev").isNull(), HOLE).otherwise(KNOWN)
    placed = cells.select(F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"), F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), F.when(F.col("sea"), F.lit(0.0)).otherwise(F.col("elev")).cast("double").alias("z"), kind.alias("kind"))

    def pack(key: tuple[int, int], part: pd.DataFrame) -> pd.DataFrame:
        z, kinds = np.full((tile, tile), np.inf), np.zeros((tile, tile), np.uint8)
        y, x = (part["r"] - key[0] * tile).to_numpy(), (part["c"] - key[1] * tile).to_numpy()
        z[y, x], kinds[y, x] = part["z"], part["kind"]
        return pd.DataFrame({"tr": [key[0]], "tc": [key[1]], "z": [z.tobytes()], "kind": [kinds.tobytes()], "open": [int(np.isnan(z).sum())]})

    ends = {-1: slice(0, halo), 0: slice(None), 1: slice(tile - halo, tile)}
    places = {-1: slice(1, 1 + halo), 0: slice(1 + halo, 1 + halo + tile), 1: slice(1 + halo + tile, 1 + 2 * halo + tile)}

    def bands(tr: int, tc: int, z: np.ndarray) -> list[tuple]:
        return [(tr + y, tc + x, len(NEIGHBOURS) - 1 - i, np.ascontiguousarray(z[ends[y], ends[x]]).tobytes()) for i, (x, y) in enumerate(NEIGHBOURS)]

    def send(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                yield pd.DataFrame(bands(row.tr, row.tc, np.frombuffer(row.z).reshape(tile, tile)), columns=["tr", "tc", "side", "band"])

    def run(many: int) -> Callable:
        def fill(key: tuple[int, int], tiles: pd.DataFrame, mail: pd.DataFrame) -> pd.DataFrame:
            names = ["tr", "tc", "side", "band", "z", "kind", "open", "moved"]
            if tiles.empty:
                return pd.DataFrame([], columns=names)
            wide = np.full((tile + 2 * halo + 2,) * 2, np.inf)
            wide[places[0], places[0]] = np.frombuffer(tiles["z"].iloc[0]).reshape(tile, tile)
            for side, band in zip(mail["side"].tolist(), mail["band"], strict=True):
                x, y = NEIGHBOURS[side]
                block = wide[places[y], places[x]]
                block[:] = np.frombuffer(band).reshape(block.shape)
            before = int(tiles["open"].iloc[0])
            _diffuse(wide, many)
            z = wide[places[0], places[0]]
            left = int(np.isnan(z).sum())
            rows = [(*key, None, None, z.tobytes(), tiles["kind"].iloc[0], left, left < before)]
            return pd.DataFrame(rows + [(*b, None, None, None, None) for b in bands(*key, z)], columns=names)

        return fill

    def unpack(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                kinds = np.frombuffer(row.kind, np.uint8).reshape(tile, tile)
                y, x = np.nonzero(kinds)
                z = np.frombuffer(row.z).reshape(tile, tile)[y, x]
                yield pd.DataFrame({"r": y + row.tr * tile, "c": x + row.tc * tile, "elev": np.where(np.isnan(z), 0.0, z), "sea": kinds[y, x] == SEA})

    letter = "tr bigint, tc bigint, side int, band binary"
    packed = write(placed.groupBy("tr", "tc").applyInPandas(pack, "tr bigint, tc bigint, z binary, kind binary, open bigint"))
    finished, active = [packed.where("open = 0")], packed.where("open > 0")
    sides = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in NEIGHBOURS])).alias("s")
    near = active.select("tr", "tc", sides).select((F.col("tr") + F.col("s.y")).alias("tr"), (F.col("tc") + F.col("s.x")).alias("tc")).distinct()
    sent = [packed.join(near, ["tr", "tc"], "left_semi").select("tr", "tc", "z").mapInPandas(send, letter).withColumn("round", F.lit(0))]
    done = 0
    while done < rounds and not active.isEmpty():
        many = min(halo, rounds - done)
        letters = sent[0]
        for more in sent[1:]:
            letters = letters.unionByName(more)
        last = letters.join(active.select("tr", "tc"), ["tr", "tc"], "left_semi").groupBy("tr", "tc", "side").agg(F.max_by("band", "round").alias("band"))
        out = f"{letter}, z binary, kind binary, open bigint, moved boolean"
        after = write(active.groupBy("tr", "tc").cogroup(last.groupBy("tr", "tc")).applyInPandas(run(many), out))
        done += many
        sent.append(after.where("side IS NOT NULL").select("tr", "tc", "side", "band").withColumn("round", F.lit(done)))
        tiles = after.where("side IS NULL")
        if tiles.where("moved").isEmpty():  # what is open has nothing known around it
            done = rounds
        finished.append(tiles.where("open = 0").select(*packed.columns))
        active = tiles.where("open > 0").select(*packed.columns)
    out = active
    for more in finished:
        out = out.unionByName(more)
    return out.mapInPandas(unpack, "r bigint, c bigint, elev double, sea boolean")


#: Kinds of cells in a packed tile: none, to be filled, at the border, missing at the border.
NONE, INNER, BORDER, OPEN = range(4)


def _sink(bed: np.ndarray, kind: np.ndarray, around: dict[int, np.ndarray], epsilon: float) -> np.ndarray:
    """The surface of a tile, given the strips that lie around it (by number in NEIGHBOURS): whatever a sunken cell lowers is looked at next."""
    n = len(bed)
    wide = n + 4  # the strips around, and one row beyond them that no step leaves
    level, ground, open_ = np.full((wide, wide), np.inf), np.full((wide, wide), np.inf), np.zeros((wide, wide), bool)
    level[2:-2, 2:-2] = np.where(kind == BORDER, bed, np.where(kind == OPEN, 0.0, np.inf))
    ground[2:-2, 2:-2], open_[2:-2, 2:-2] = bed, kind == INNER
    place = {-1: slice(1, 2), 0: slice(2, n + 2), 1: slice(n + 2, n + 3)}
    for i, strip in around.items():
        x, y = NEIGHBOURS[i]
        block = level[place[y], place[x]]
        block[:] = strip.reshape(block.shape)
    level, ground, open_ = level.ravel(), ground.ravel(), open_.ravel()
    steps = np.array([y * wide + x for x, y in NEIGHBOURS])
    front = np.flatnonzero(np.isfinite(level))
    while len(front):
        to, low = (front[:, None] + steps).ravel(), np.repeat(level[front], len(steps))
        ok = open_[to]
        to, low = to[ok], low[ok]
        sunk = np.where(ground[to] > low, ground[to], low + epsilon)
        lower = sunk < level[to]
        np.minimum.at(level, to[lower], sunk[lower])
        front = np.unique(to[lower])
    return level.reshape(wide, wide)[2:-2, 2:-2]


def filled_depressions(cells: DataFrame, epsilon: float = 0.001, tile: int = 256) -> DataFrame:
    """r, c, z of a raster (r, c, z) without sinks: the only surface with border cells as they are and, inside,
    f = z if z > m, else m + epsilon, with m the lowest f around. Missing cells at the border stay missing and act as 0
    for their neighbours; missing ones inside are raised.

    A tile is one row with its cells in an array. It sinks from its border and from the strips that its neighbours
    sent, and sends its own strips on; tiles that got a changed strip run again until there is none. Rounds hand on
    strips only, as a tile's surface follows from its cells and the strips around it; surfaces come at the end.
    """
    write = scratch(cells.sparkSession)
    size = F.broadcast(cells.agg(F.max("r").alias("__r"), F.max("c").alias("__c")))
    edge = F.expr("r = 0 OR c = 0 OR r = __r OR c = __c")
    kind = F.when(~edge, INNER).when(F.col("z").isNull(), OPEN).otherwise(BORDER)
    placed = cells.crossJoin(size).select(F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"), F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), F.col("z").cast("double").alias("z"), kind.alias("kind"))

    def pack(key: tuple[int, int], part: pd.DataFrame) -> pd.DataFrame:
        bed, kinds = np.full((tile, tile), np.inf), np.zeros((tile, tile), np.uint8)
        y, x = (part["r"] - key[0] * tile).to_numpy(), (part["c"] - key[1] * tile).to_numpy()
        bed[y, x], kinds[y, x] = part["z"].fillna(-np.inf), part["kind"]
        return pd.DataFrame({"tr": [key[0]], "tc": [key[1]], "bed": [bed.tobytes()], "kind": [kinds.tobytes()]})

    def surface(tiles: pd.DataFrame, mail: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, bytes]]:
        bed = np.frombuffer(tiles["bed"].iloc[0]).reshape(tile, tile)
        kinds = np.frombuffer(tiles["kind"].iloc[0], np.uint8).reshape(tile, tile)
        got = dict(zip(mail["side"].tolist(), mail["strip"], strict=True))
        level = _sink(bed, kinds, {i: np.frombuffer(b) for i, b in got.items() if i < len(NEIGHBOURS)}, epsilon)
        return level, kinds, {i - len(NEIGHBOURS): b for i, b in got.items() if i >= len(NEIGHBOURS)}

    def send(key: tuple[int, int], tiles: pd.DataFrame, mail: pd.DataFrame) -> pd.DataFrame:
        level, _, before = surface(tiles, mail)
        ends = {-1: slice(0, 1), 0: slice(None), 1: slice(tile - 1, tile)}
        out = []
        for i in tiles["near"].iloc[0].tolist():
            x, y = NEIGHBOURS[i]
            strip = level[ends[y], ends[x]]
            # a receiver knows the strip by the side that it comes from, which is opposite in order
            news = strip.tobytes() != before[i] if i in before else bool(np.isfinite(strip).any())
            out.append((*key, key[0] + y, key[1] + x, len(NEIGHBOURS) - 1 - i, strip.tobytes(), news))
        return pd.DataFrame(out, columns=["sr", "sc", "tr", "tc", "side", "strip", "changed"])

    def unpack(key: tuple[int, int], tiles: pd.DataFrame, mail: pd.DataFrame) -> pd.DataFrame:
        level, kinds, _ = surface(tiles, mail)
        y, x = np.nonzero(kinds)
        return pd.DataFrame({"r": y + key[0] * tile, "c": x + key[1] * tile, "z": np.where(kinds[y, x] == OPEN, np.nan, level[y, x])})

    letters = "sr bigint, sc bigint, tr bigint, tc bigint, side int, strip binary, changed boolean"
    packed = write(placed.groupBy("tr", "tc").applyInPandas(pack, "tr bigint, tc bigint, bed binary, kind binary"))
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, (x, y) in enumerate(NEIGHBOURS)])).alias("s")
    asked = packed.select("tr", "tc", sides).select("tr", "tc", "s.i", (F.col("tr") + F.col("s.y")).alias("nr"), (F.col("tc") + F.col("s.x")).alias("nc"))
    there = packed.select(F.col("tr").alias("nr"), F.col("tc").alias("nc"))
    near = asked.join(there, ["nr", "nc"]).groupBy("tr", "tc").agg(F.collect_set("i").alias("near"))  # eight at most
    tiles = write(packed.join(near, ["tr", "tc"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<int>"))))
    to, back = F.struct("tr", "tc", "side"), F.struct(F.col("sr").alias("tr"), F.col("sc").alias("tc"), (2 * len(NEIGHBOURS) - 1 - F.col("side")).alias("side"))
    mail, due, first = write(cells.sparkSession.createDataFrame([], letters)), tiles.select("tr", "tc"), True
    while first or not mail.where("changed").isEmpty():
        due, first = due if first else mail.where("changed").select("tr", "tc"), False
        both = mail.select(F.explode(F.array(to, back)).alias("k"), "strip").select("k.*", "strip").join(due, ["tr", "tc"], "left_semi")  # got and sent before
        sent = tiles.join(due, ["tr", "tc"], "left_semi").groupBy("tr", "tc").cogroup(both.groupBy("tr", "tc")).applyInPandas(send, letters)
        still = mail.join(due.withColumnsRenamed({"tr": "sr", "tc": "sc"}), ["sr", "sc"], "left_anti").withColumn("changed", F.lit(False))
        mail = write(sent.unionByName(still))
    return tiles.groupBy("tr", "tc").cogroup(mail.select("tr", "tc", "side", "strip").groupBy("tr", "tc")).applyInPandas(unpack, "r bigint, c bigint, z double")
