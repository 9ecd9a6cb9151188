"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverine.llm.bpe import SLICE, WordIds
from riverine.llm.shared import small_batches, written
from riverine.llm.textblocks import slices

#: Pieces a packing task takes. Each task leaves about one sequence part-filled, of some thousands.
PIECES_PER_TASK = 20_000


class Capacities:
    """A segment tree over remaining capacities 0 to `most`: the tightest open bin that still fits, in logarithmic time."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.open = [0] * (2 * self.size)  # open bins below each node
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, one: int) -> None:
        self.bins[capacity].append(one)
        self._count(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """A bin of the smallest capacity of at least `least`, and that capacity; the bin is no longer open."""
        node = least + self.size
        while not self.open[node]:  # up until a right neighbour has open bins
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._count(capacity, -1)
        return self.bins[capacity].pop(), capacity

    def _count(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.open[node] += by
            node >>= 1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece: longest first, each into the open bin that it leaves least room in."""
    tree, n_bins = Capacities(capacity), 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = tree.take(length)
        one, room = found or (n_bins, capacity)
        n_bins += found is None
        bins[i], offsets[i] = one, capacity - room
        if room > length:
            tree.add(room - length, one)
    return bins, offsets


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every text's ids and end_id, cut into pieces of `capacity` ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(path)
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE)):
            ids, ends = encode(batch.column("text"))
            rows: list[tuple[int, int, int, int, int]] = []
            for i, (s, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                own = np.append(ids[s:e], end_id).astype("<u4")
                for p, at in enumerate(range(0, len(own), capacity)):
                    cut = own[at : at + capacity]
                    rows.append((i, p, at, len(cut), zlib.crc32(cut.tobytes())))
            of, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"{id_col} AS doc_id", f"{text_col} AS text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of more than `capacity` ids are cut. Pieces are dealt out evenly to tasks of about
    PIECES_PER_TASK, each packed by best fit decreasing; more tasks cost about one sequence each. A null text counts
    as empty: its piece is the end id alone. Ties in length go by row order; repeated rows are packed each; an empty
    table gives no rows; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    pieces = written(token_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    tasks = max(1, round(pieces.count() / PIECES_PER_TASK))

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = list(parts)
        if whole:
            got = pd.concat(whole, ignore_index=True)
            bins, offsets = best_fit_decreasing(got["length"].to_numpy(), capacity)
            yield got.assign(sequence_id=(TaskContext.get().partitionId() << 32) + bins, offset=offsets)

    kind = docs.schema[id_col].dataType.simpleString()
    return pieces.repartition(tasks).mapInPandas(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint").select(
        "doc_id", "piece", "start", "length", F.col("ids_crc32"), "sequence_id", "offset"
    )
