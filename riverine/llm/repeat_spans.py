"""Removes word spans that repeat text of documents with a smaller id.

Windows of `k` words are the edges of a de Bruijn graph; its nodes are the k - 1 words that two windows in a row share.
Only edges that several documents have matter:

1. Consecutive windows of a text with the same smallest gram (their minimizer) are one piece. A minimizer of one
   document only has no repeated window. If all pieces of a minimizer are equal, the piece is one edge of the graph;
   if not, its windows are edges each.
2. Edges that two documents have are kept with source coordinates: the smallest document, and the word there.
3. Edges are compacted: at a node that one edge enters and one leaves, they belong to one path. Runs along a source
   come first; joins on the nodes where runs end, with pointers doubled, lay runs end to end.
4. A document's edges are joined with the paths; what lies in a row on a path is one span. Each span is then compared
   with the words at its source coordinates, and removed if they are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverine.llm.shared import small_batches, small_or_not, written
from riverine.llm.textblocks import Block, Words, block, hashes, mix, ragged, slices, windows, words

#: Words of a minimizer; a piece has at most k - GRAM + 1 windows unless a gram repeats.
GRAM = 5
#: Rows that a task gathers before it combines those of one minimizer.
COMBINE = 1 << 19
#: Rows of an Arrow batch of numbers.
ROWS = 100_000


@dataclass
class Pieces:
    """Runs of windows: minimizer, digest of all windows, text, first window's word in its text, number of windows."""

    minimizer: np.ndarray
    digest: np.ndarray
    text: np.ndarray
    start: np.ndarray
    count: np.ndarray


def window_hashes(b: Block, w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the k-word window at each word, whether it lies in one text, and the smallest hash of its grams."""
    x = hashes(b, w)
    h, whole = windows(x, w.first, k)
    least, _ = windows(x, w.first, min(GRAM, k))
    wide, span = k - min(GRAM, k) + 1, 1
    while 2 * span <= wide:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < wide:
        least = np.minimum(least[: len(least) - wide + span], least[wide - span :])
    return h, whole, least[: len(h)]


def pieces(b: Block, w: Words, k: int) -> tuple[Pieces, np.ndarray]:
    """The pieces of all texts, and the hash of the window at each word."""
    h, whole, least = window_hashes(b, w, k)
    n = len(h)
    if not n:
        none = np.zeros(0, np.int64)
        return Pieces(none, none, none, none, none), h.view(np.int64)
    text = np.repeat(np.arange(len(b)), w.counts)[:n]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, n))
    place = (np.arange(n) - np.repeat(at, count)).astype(np.uint64)
    digest = mix(np.add.reduceat(mix(h + place * np.uint64(0x9E3779B97F4A7C15)), at) + count.astype(np.uint64))
    inside = whole[at]
    at, count, digest = at[inside], count[inside], digest[inside]
    return Pieces(least[at].view(np.int64), digest.view(np.int64), text[at], at - w.first[text[at]], count), h.view(np.int64)


def _batches(names: list[str], columns: list[np.ndarray | pa.Array]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + ROWS]) if isinstance(c, np.ndarray) else c.slice(i, ROWS) for c in columns], names)


def _shared_minimizers(docs: DataFrame, k: int) -> DataFrame:
    """m and branching: minimizers of several documents, and whether their pieces differ. A task hands on one row a minimizer."""
    names = ["m", "a", "b", "low", "high"]

    def combined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        m, a, b, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(m)
        m = m[order]
        at = np.flatnonzero(np.append(True, m[1:] != m[:-1])) if len(m) else np.zeros(0, np.int64)
        least, most = (lambda x: np.minimum.reduceat(x[order], at) if len(at) else x), (lambda x: np.maximum.reduceat(x[order], at) if len(at) else x)
        return [m[at], least(a), most(b), least(low), most(high)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        rows = 0
        for batch in (part for whole in batches for part in slices(whole, "text")):
            b = block(batch.column("text"))
            p, _ = pieces(b, words(b), k)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[p.text]
            parts.append([p.minimizer, p.digest, p.digest, ids, ids])
            rows += len(ids)
            if rows > COMBINE:
                yield from _batches(names, combined(parts))
                parts, rows = [], 0
        if parts:
            yield from _batches(names, combined(parts))

    found = docs.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    by_minimizer = found.groupBy("m").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("low").alias("low"), F.max("high").alias("high"))
    return written(by_minimizer.where("low < high").selectExpr("m", "a < b AS branching"), "shared-minimizers")


def _minimizers(docs: DataFrame, k: int) -> DataFrame:
    """m and doc_id of every document's pieces."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            b = block(batch.column("text"))
            p, _ = pieces(b, words(b), k)
            yield from _batches(["m", "doc_id"], [p.minimizer, batch.column("doc_id").take(pa.array(p.text))])

    return docs.mapInArrow(run, "m bigint, doc_id bigint")


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row that each belongs to; null counts as empty."""
    n = np.array(column.value_lengths().fill_null(0), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), n)


def _among(values: np.ndarray, rows: np.ndarray, column: pa.Array) -> np.ndarray:
    """Whether each value is in its row's list."""
    known, of = _listed(column)
    salt = np.uint64(0xA24BAED4963EE407)
    return np.isin(mix(values.view(np.uint64) + rows.astype(np.uint64) * salt), mix(known.view(np.uint64) + of.astype(np.uint64) * salt))


def _places(hit: DataFrame, k: int) -> DataFrame:
    """key, doc_id, version, start and count of the pieces in `plain`, and of the windows of those in `branching`; version tells texts of one id apart."""
    names = ["key", "doc_id", "version", "start", "count"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            b = block(batch.column("text"))
            w = words(b)
            p, h = pieces(b, w, k)
            one, many = (np.flatnonzero(_among(p.minimizer, p.text, batch.column(c))) for c in ("plain", "branching"))
            text, start = np.repeat(p.text[many], p.count[many]), ragged(p.start[many], p.count[many])
            of = np.concatenate([p.text[one], text])
            version = np.add.reduceat(np.append(h, 0), np.minimum(w.first[:-1], len(h))).view(np.uint64) >> np.uint64(33)
            yield from _batches(names, [
                np.concatenate([p.digest[one], h[w.first[text] + start]]), batch.column("doc_id").take(pa.array(of)), version[of].astype(np.int32),
                np.concatenate([p.start[one], start]).astype(np.int32), np.concatenate([p.count[one], np.ones(len(start), np.int64)]).astype(np.int32),
            ])

    return hit.mapInArrow(run, "key bigint, doc_id bigint, version int, start int, count int")


def _by_document(docs: DataFrame, lists: DataFrame, id_col: str) -> DataFrame:
    """doc_id and text of the documents that lists names, and its other columns; lists is a written table."""
    named = lists.withColumnRenamed(id_col, "__id")
    hit = docs.join(small_or_not(named.select("__id")), docs["doc_id"] == F.col("__id"), "left_semi")
    return hit.join(named, hit["doc_id"] == F.col("__id")).drop("__id")


def _fields(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """Fields of a list of structs, and the row that each struct belongs to."""
    flat = column.flatten()
    rows = np.repeat(np.arange(len(column)), np.array(column.value_lengths().fill_null(0), np.int64))
    return (*(flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names), rows)


def _with_nodes(docs: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """key, source, start, count, enters and leaves: edges where they first stand in their source, and the nodes that they lead from and to."""
    names = ["key", "source", "start", "count", "enters", "leaves"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            b = block(batch.column("text"))
            w = words(b)
            p, h = pieces(b, w, k)
            nodes, _ = windows(hashes(b, w), w.first, k - 1)
            text = np.repeat(np.arange(len(b)), w.counts)[: len(h)]
            key, at = np.concatenate([p.digest, h]), np.concatenate([w.first[p.text] + p.start, np.arange(len(h))])
            count, text = np.concatenate([p.count, np.ones(len(h), np.int64)]), np.concatenate([p.text, text])
            chosen = np.flatnonzero(_among(key, text, batch.column("keys")))
            chosen = chosen[at[chosen] + k <= w.first[text[chosen] + 1]]
            chosen = chosen[np.lexsort((at[chosen], key[chosen], text[chosen]))]
            first = np.ones(len(chosen), bool)
            first[1:] = (key[chosen][1:] != key[chosen][:-1]) | (text[chosen][1:] != text[chosen][:-1])
            key, at, count, text = (x[chosen[first]] for x in (key, at, count, text))
            start = (at - w.first[text]).astype(np.int32)
            yield from _batches(names, [key, batch.column("doc_id").take(pa.array(text)), start, count.astype(np.int32), nodes[at].view(np.int64), nodes[at + count].view(np.int64)])

    lists = written(edges.groupBy("source").agg(F.collect_list("key").alias("keys")), "edge-lists")
    found = _by_document(docs, lists, "source").mapInArrow(run, "key bigint, source bigint, start int, count int, enters bigint, leaves bigint")
    once = found.repartition("source").groupBy("source", "key").agg(*[F.min(c).alias(c) for c in ("start", "count", "enters", "leaves")])  # rows may share an id
    return written(once, "graph-edges")


def _paths(edges: DataFrame) -> DataFrame:
    """edges with path_source, path_start and at: the compacted path that each lies on, and its place there in windows.

    A path is named by the source coordinates of its first edge.
    """
    ends = edges.selectExpr("enters AS node", "1 AS leaving", "0 AS entering").unionByName(edges.selectExpr("leaves AS node", "0 AS leaving", "1 AS entering"))
    degrees = ends.groupBy("node").agg(F.sum("leaving").alias("leaving"), F.sum("entering").alias("entering"))
    inner = written(degrees.where("leaving = 1 AND entering = 1").select("node"), "inner-nodes")
    along = Window.partitionBy("source").orderBy("start", "count", "key")
    before = lambda c: F.lag(c).over(along)
    follows = F.col("node").isNotNull() & (before(F.col("start") + F.col("count")) == F.col("start")) & (before("leaves") == F.col("enters"))
    marked = edges.join(inner, F.col("enters") == F.col("node"), "left").withColumn("first", ~F.coalesce(follows, F.lit(False)))
    ending = F.coalesce(F.lead("first").over(along), F.lit(True))
    run = F.last(F.when(F.col("first"), F.col("start")), ignorenulls=True).over(along)
    ended = marked.select("key", "source", "start", "count", F.when(F.col("first"), F.col("enters")).alias("enters"), F.when(ending, F.col("leaves")).alias("leaves"), run.alias("run"))
    runs = written(ended, "runs")
    whole = runs.groupBy("source", "run").agg(F.sum("count").alias("n"), F.min("enters").alias("enters"), F.min("leaves").alias("leaves"))
    islands = written(whole, "run-ends")
    over = islands.join(inner, F.col("leaves") == F.col("node")).select(F.col("source").alias("up_source"), F.col("run").alias("up_run"), F.col("n").alias("up_n"), F.col("node").alias("meets"))
    linked = islands.join(over, (F.col("enters") == F.col("meets")) & ((F.col("up_source") != F.col("source")) | (F.col("up_run") != F.col("run"))), "left")
    state = written(linked.selectExpr("source", "run", "up_source", "up_run", "coalesce(up_n, 0L) AS at"), "run-links")
    rounds = max(1, islands.count()).bit_length() + 1  # more only where runs form a ring, which has no first one
    for _ in range(rounds):
        upper = state.where("up_source IS NOT NULL").select(F.col("source").alias("s"), F.col("run").alias("r"), F.col("up_source").alias("us"), F.col("up_run").alias("ur"), F.col("at").alias("ua"))
        if not upper.join(state.select(F.col("up_source").alias("s"), F.col("up_run").alias("r")), ["s", "r"], "left_semi").limit(1).count():
            break
        moved = state.join(upper, (F.col("up_source") == F.col("s")) & (F.col("up_run") == F.col("r")), "left")
        state = written(moved.selectExpr("source", "run", "coalesce(us, up_source) AS up_source", "coalesce(ur, up_run) AS up_run", "at + coalesce(ua, 0L) AS at"), "run-links")
    paths = state.selectExpr("source AS __source", "run AS __run", "coalesce(up_source, source) AS path_source", "coalesce(up_run, run) AS path_start", "at AS begins")
    on = (F.col("source") == F.col("__source")) & (F.col("run") == F.col("__run"))
    return written(runs.join(small_or_not(paths), on).selectExpr("key", "source", "start AS source_start", "path_source", "path_start", "begins + source_start - run AS at"), "paths")


def _digests(b: Block, w: Words, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[bytes]:
    """SHA-256 of each stretch of words of a text, joined by one space."""
    raw, found = b.data.tobytes(), []
    for i, n in zip((w.first[text] + start).tolist(), length.tolist(), strict=True):
        found.append(hashlib.sha256(b" ".join(raw[w.starts[i] : w.starts[i + n - 1] + w.lengths[i + n - 1]].split())).digest())
    return found


def _source_words(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """source, source_start, n_words and digest of what stands at the source coordinates of spans."""
    names = ["source", "source_start", "n_words", "digest"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            b = block(batch.column("text"))
            w = words(b)
            start, n, text = _fields(batch.column("asked"), "source_start", "n_words")
            fits = start + n <= w.counts[text]
            start, n, text = start[fits], n[fits], text[fits]
            yield from _batches(names, [batch.column("doc_id").take(pa.array(text)), start.astype(np.int32), n, pa.array(_digests(b, w, text, start, n), pa.binary())])

    asked = written(spans.groupBy("source").agg(F.collect_set(F.struct("source_start", "n_words")).alias("asked")), "asked")
    return _by_document(docs, asked, "source").mapInArrow(run, "source bigint, source_start int, n_words bigint, digest binary")


def repeated_spans(docs: DataFrame, k: int = 13) -> DataFrame:
    """Spans of docs (doc_id, text) that repeat a document of a smaller id: doc_id, starts, n_words, source, source_start, path_source, path_start, digest.

    A span is `n_words` words from each word of `starts` on, all windows of which lie in a row on one compacted path, and which
    stand in document `source`, the smallest that has them, from word `source_start` on; digest is the SHA-256 of the
    words there. Rows without an id take no part.
    """
    plain = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    shared = _shared_minimizers(plain, k)
    lists = _minimizers(plain, k).join(shared, "m").groupBy("doc_id").agg(F.collect_set(F.expr("IF(branching, NULL, m)")).alias("plain"), F.collect_set(F.expr("IF(branching, m, NULL)")).alias("branching"))
    places = written(_places(_by_document(plain, written(lists, "minimizer-lists"), "doc_id"), k), "places")
    edges = places.groupBy("key").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last")
    paths = _paths(_with_nodes(plain, edges, k))
    met = places.join(paths, "key").where("doc_id > source").selectExpr("*", "start - at AS diagonal", "start - source_start AS shift")
    line = ["doc_id", "version", "path_source", "path_start", "diagonal", "source", "shift"]  # by source too: a short document may be the source of an edge amid another's
    along = Window.partitionBy(*line).orderBy("start")
    reached = F.max(F.col("start") + F.col("count")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    parted = met.withColumn("begins", F.when(F.coalesce(reached < F.col("start"), F.lit(True)), F.col("start")))
    stretch = parted.withColumn("stretch", F.last("begins", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*line, "stretch")
    spans = stretch.agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("count")) - F.min("start") + k - 1).cast("bigint").alias("n_words"), F.min("source_start").alias("source_start"))
    # a stuttering text has the same source words at many places: one row, however many
    once = spans.groupBy("doc_id", "n_words", "source", "source_start", "path_source", "path_start").agg(F.collect_set("start").alias("starts"))
    kept = written(once, "spans")
    return kept.join(written(_source_words(plain, kept), "source-words"), ["source", "source_start", "n_words"])


def _cut(docs: DataFrame, text_name: str | None) -> DataFrame:
    """doc_id, carried, n_words, n_removed and kept_sha256 of every row, or the kept words under text_name; spans whose words differ from their digest stay."""
    listed = "spans" in docs.columns
    last_name = text_name or "kept_sha256"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            b = block(batch.column("text"))
            w = words(b)
            edges = np.zeros(len(w.starts) + 1, np.int64)
            if listed:
                spans = batch.column("spans")
                n, text = _fields(spans, "n_words")
                start, of = _listed(spans.flatten().field("starts"))
                n, text = n[of], text[of]
                fits = start + n <= w.counts[text]
                start, n, text, of = start[fits], n[fits], text[fits], of[fits]
                stated = spans.flatten().field("digest").take(pa.array(of)).to_pylist()
                same = np.array([x == y for x, y in zip(_digests(b, w, text, start, n), stated, strict=True)], bool)
                np.add.at(edges, (w.first[text] + start)[same], 1)
                np.add.at(edges, (w.first[text] + start + n)[same], -1)
            kept = np.cumsum(edges[:-1]) == 0
            out, ends = joined(b, w, kept)
            total = np.concatenate([[0], np.cumsum(kept)])[w.first]
            texts = [out[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
            whole = (np.diff(total) == w.counts).tolist()
            if text_name:
                last = pa.array([t if s else x.decode() for t, s, x in zip(batch.column("text").to_pylist(), whole, texts, strict=True)], pa.string())
            else:
                last = pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("carried"), pa.array(w.counts), pa.array(w.counts - np.diff(total)), last], ["doc_id", "carried", "n_words", "n_removed", last_name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in ("doc_id", "carried"))
    return docs.mapInArrow(run, f"{kinds}, n_words bigint, n_removed bigint, `{last_name}` string")


def joined(b: Block, w: Words, kept: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of every text joined by one space, laid end to end, and where each text begins and ends."""
    text = np.repeat(np.arange(len(b)), w.counts)[kept]
    starts, ends = w.starts[kept], w.starts[kept] + w.lengths[kept]
    after = np.append(text[1:] == text[:-1], False) if len(text) else np.zeros(0, bool)  # another kept word follows
    n = int(b.offsets[-1])
    data = b.data[:n].copy()
    data[ends[after]] = 32
    take = np.zeros(n + 1, np.int32)
    take[starts] += 1
    np.add.at(take, ends + after, -1)
    take = np.cumsum(take[:-1]).astype(bool)
    lengths = np.bincount(text, ends + after - starts, len(b)).astype(np.int64)
    return data[take].tobytes(), np.concatenate([[0], np.cumsum(lengths)])


def remove_repeats(docs: DataFrame, k: int = 13, keep: list[str] | None = None, text_name: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256.

    Words are runs of bytes other than ASCII white space, unchanged. Every word goes that is covered by a window of k
    words whose sequence also starts in a document of a smaller doc_id; windows are judged on the input. Texts of
    fewer than k words keep everything; null counts as empty. Rows that share a doc_id are one document to each other:
    they don't remove each other's words. Rows without an id are no source and lose nothing. With a text_name, a column
    of that name takes the digest's place: the kept words joined by one space, or the text as it is if it loses
    nothing. `keep` names columns to carry along besides doc_id, of any names. An empty table gives no rows.

    Candidates are found by 64-bit hashes and removed only if their words equal those at the source coordinates (by
    SHA-256). Should two windows' hashes collide, a repeated span could stay.
    """
    small_batches(docs.sparkSession)
    spans = repeated_spans(docs, k)
    lists = written(spans.groupBy("doc_id").agg(F.collect_list(F.struct("starts", "n_words", "digest")).alias("spans")), "span-lists").withColumnRenamed("doc_id", "__id")
    ids = small_or_not(lists.select("__id"))
    wanted = docs.select("doc_id", "text", F.struct(*(keep or ["doc_id"])).alias("carried"))
    on = wanted["doc_id"] == F.col("__id")
    hit = wanted.join(ids, on, "left_semi").join(lists, on).drop("__id")
    cut = _cut(hit, text_name).unionByName(_cut(wanted.join(ids, on, "left_anti"), text_name))
    return cut.select("doc_id", *[F.col(f"carried.`{c}`") for c in keep or []], "n_words", "n_removed", text_name or "kept_sha256")
