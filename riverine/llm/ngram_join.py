"""Documents whose sets of word n-grams have a Jaccard similarity of at least a bound, and their components.

The product of the sparse document-by-gram incidence matrix with its transpose is worked in blocks.

1. Which entries to work: of each row, only the part that size bounds ask for. Two sets of similarity s share one of
   the first |A| - ceil(s |A|) + 1 grams of A and of B in any order of all grams (here by hash, grams of crowded hash
   bins last). Sizes, counts of shared prefix grams and signatures, which bound the overlap from above, discard pairs.
2. The entries: the matrix is cut into blocks of columns. Block by block, the product adds to a pair's overlap count;
   a pair goes as soon as the count and what is left of either row cannot reach the least overlap for their sizes.
   What is left after the last block has its exact count, which decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverine.llm.components import components
from riverine.llm.shared import small_batches, small_or_not, written
from riverine.llm.textblocks import Block, block, hashes, mix, slices, windows, words

#: Hash bins of the order of grams: one count each, whatever the corpus.
BINS = 1 << 18
#: Blocks of columns (a power of two): a gram's block is in the highest bits of its hash.
BLOCKS = 4


def gram_sets(b: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of every text as (text, hash), sorted; a shorter text with words has one, all its words."""
    w = words(b)
    x = hashes(b, w)
    h, whole = windows(x, w.first, k)
    text = np.repeat(np.arange(len(b)), w.counts)[: len(h)][whole]
    h = h[whole]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        one = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = w.counts[short] > j
            one[has] = mix(one[has] * np.uint64(0x9E3779B97F4A7C15) + x[w.first[short[has]] + j] + np.uint64(1))
        h, text = np.concatenate([h, one]), np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])) if len(h) else np.zeros(0, bool)
    return text[new], h[new]


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), two fingerprints of the set, and a signature of 2 to 4 bits a gram."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            b = block(batch.column("text"), lower=True)
            text, h = gram_sets(b, k)
            n = np.bincount(text, minlength=len(b))
            first = np.cumsum(n) - n

            def total(x: np.ndarray, n: np.ndarray = n, first: np.ndarray = first) -> np.ndarray:
                out = np.zeros(len(n), np.uint64)
                if len(x):
                    out[n > 0] = np.add.reduceat(x, first[n > 0])  # empty texts have no grams between these
                return out

            bits = np.where(n > 0, 1 << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64), 0)
            at = np.cumsum(bits) - bits
            marks = np.zeros(int(bits.sum()), bool)
            marks[at[text] + (h & (bits[text] - 1).astype(np.uint64)).astype(np.int64)] = True
            packed = np.packbits(marks, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(mix(total(mix(h))).view(np.int64)), pa.array(mix(total(mix(h ^ np.uint64(0xA24BAED4963EE407)))).view(np.int64)),
                    pa.array([packed[i : i + m] for i, m in zip((at // 8).tolist(), (bits // 8).tolist(), strict=True)], pa.binary()),
                ],
                ["doc_id", "n", "fp", "fp2", "sig"],
            )

    return docs.mapInArrow(run, "doc_id bigint, n bigint, fp bigint, fp2 bigint, sig binary")


def crowded_bins(docs: DataFrame, k: int) -> np.ndarray:
    """By hash bin, whether it holds far more gram occurrences than chance gives it: then it has a frequent gram.

    Counts are over all texts. A task hands on one count a bin, and the driver gets one.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            b = block(batch.column("text"), lower=True)
            w = words(b)
            h, whole = windows(hashes(b, w), w.first, k)
            total += np.bincount((h[whole] % np.uint64(BINS)).astype(np.int64), minlength=BINS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bin", "n"])

    rows = docs.select("text").mapInArrow(count, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # at most BINS rows
    counts = np.zeros(BINS)
    counts[rows["bin"].to_numpy(np.int64)] = rows["n"]
    usual = np.median(counts)
    return counts > usual + 8 * np.sqrt(usual) + 8


def _prefixes(docs: DataFrame, k: int, percent: int, crowded: np.ndarray) -> DataFrame:
    """gram and doc_id of the first n - ceil(s n) + 1 grams of every set, those of crowded bins ordered last."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(crowded))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.unpackbits(shared.value).astype(bool)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            text, h = gram_sets(block(batch.column("text"), lower=True), k)
            order = np.lexsort((last[(h % np.uint64(BINS)).astype(np.int64)], text))  # stable: by hash within
            text, h = text[order], h[order]
            n = np.bincount(text, minlength=batch.num_rows)
            first, length = np.cumsum(n) - n, n - -(-percent * n // 100) + 1
            takes = np.arange(len(h)) - first[text] < length[text]
            yield pa.RecordBatch.from_arrays([pa.array(h[takes].view(np.int64)), batch.column("doc_id").take(pa.array(text[takes]))], ["gram", "doc_id"])

    return docs.mapInArrow(run, "gram bigint, doc_id bigint")


def least_overlap(na: int, nb: int, percent: int) -> int:
    """The least intersection at which 100 |A and B| >= percent |A or B|."""
    return -(-percent * (na + nb) // (100 + percent))


def _by_signature(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and signatures leave a sufficient overlap possible."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, sa, sb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True):
                short = 8 * min(len(sa), len(sb))
                x, y = (_folded(int.from_bytes(s, "little"), 8 * len(s), short) for s in (sa, sb))
                most = min(na - (x & ~y).bit_count(), nb - (y & ~x).bit_count())
                keep.append(most >= least_overlap(na, nb, percent))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(chosen), batch.column("b").filter(chosen)], ["a", "b"])

    side = lambda x: profiles.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _folded(bits: int, wide: int, narrow: int) -> int:
    while wide > narrow:
        wide //= 2
        bits = (bits >> wide) | (bits & ((1 << wide) - 1))
    return bits


def _incidence(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, a fingerprint and the size of its set, and the sorted gram hashes of every block: a row of the incidence matrix."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - (BLOCKS - 1).bit_length())
        for batch in (part for whole in batches for part in slices(whole, "text")):
            text, h = gram_sets(block(batch.column("text"), lower=True), k)
            n = np.bincount(text, minlength=batch.num_rows)
            prints = np.add.reduceat(np.append(mix(h), np.uint64(0)), np.cumsum(n) - n)
            columns = []
            for j in range(BLOCKS):
                inside = (h >> shift) == np.uint64(j)
                ends = np.concatenate([[0], np.cumsum(8 * np.bincount(text[inside], minlength=batch.num_rows))]).astype("<i4")
                columns.append(pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(h[inside].tobytes())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64)), pa.array(n), *columns], ["doc_id", "fp", "n", *(f"g{j}" for j in range(BLOCKS))])

    return docs.mapInArrow(run, "doc_id bigint, fp bigint, n bigint, " + ", ".join(f"g{j} binary" for j in range(BLOCKS)))


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes in a binary column, and the row that each belongs to."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64), np.repeat(np.arange(len(column)), _sizes(column))


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 8


def overlaps(a: pa.Array, b: pa.Array) -> np.ndarray:
    """By row, how many hashes stand in both columns; a row's hashes are distinct."""
    (ha, ra), (hb, rb) = _grams(a), _grams(b)
    h, row = np.concatenate([ha, hb]), np.concatenate([ra, rb])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    twice = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][twice], minlength=len(a))


def _product(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of pairs, a written table, whose accumulated overlap suffices.

    Documents that share an id have a row of the matrix each, and a pair of ids links by any of its rows.
    """
    ids = written(pairs.select(F.col("a").alias("__id")).union(pairs.select("b")).distinct(), "pair-ids")
    rows = written(_incidence(docs.join(small_or_not(ids), docs["doc_id"] == F.col("__id"), "left_semi"), k), "incidence")
    carried = ["a", "b", "fa", "fb", "na", "nb", "met", "seen_a", "seen_b"]

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "ga")):
            na, nb, met, seen_a, seen_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb", "met", "seen_a", "seen_b"))
            ga, gb = batch.column("ga"), batch.column("gb")
            met = met + overlaps(ga, gb)
            seen_a, seen_b = seen_a + _sizes(ga), seen_b + _sizes(gb)
            open_ = pa.array(met + np.minimum(na - seen_a, nb - seen_b) >= least_overlap(na, nb, percent))
            columns = [*(batch.column(c) for c in carried[:6]), pa.array(met), pa.array(seen_a), pa.array(seen_b)]
            yield pa.RecordBatch.from_arrays([c.filter(open_) for c in columns], carried)

    state = pairs
    for j in range(BLOCKS):
        side = lambda x, j=j: rows.select(F.col("doc_id").alias(x), F.col("fp").alias(f"f{x}"), F.col("n").alias(f"n{x}"), F.col(f"g{j}").alias(f"g{x}"))
        if j:
            met = state.join(side("a").drop("na"), ["a", "fa"]).join(side("b").drop("nb"), ["b", "fb"])
        else:
            met = state.join(side("a"), "a").join(side("b"), "b").selectExpr("*", "0L AS met", "0L AS seen_a", "0L AS seen_b")
        state = written(met.select(*carried, "ga", "gb").mapInArrow(add, ", ".join(f"{c} bigint" for c in carried)), "overlaps")
    return state.select("a", "b").distinct()


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text's set are its distinct k-word
    shingles; with fewer words, all of them are one; without words, or null, the set is empty and linked with nothing.
    Documents link when 100 times the intersection is at least `percent` times the union; component_id is the
    smallest doc_id that links reach. Rows that share a doc_id are one document, linked by any of its texts. Rows
    without an id have no component (null). An empty table gives no rows; other columns aren't read. Shingles are
    compared by 64-bit hashes.

    Equal sets stand for one another. In each gram's block all documents are first compared with one, the document
    with the largest share of grams that others have as well, then only pairs that are still in different components.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    known = plain.where("doc_id IS NOT NULL")
    profiles = written(_profiles(plain, k), "profiles")
    sets = profiles.where("n > 0 AND doc_id IS NOT NULL")
    groups = written(sets.groupBy("fp", "fp2", "n").agg(F.min("doc_id").alias("rep")), "set-groups")
    equal = written(sets.join(groups, ["fp", "fp2", "n"]).select("doc_id", "rep"), "equal-sets")
    reps = equal.select("rep").distinct()
    others = written(sets.select("doc_id").join(reps, F.col("doc_id") == F.col("rep"), "left_anti").select(F.col("doc_id").alias("__gone")).distinct(), "others")
    chosen = known.join(small_or_not(others), known["doc_id"] == F.col("__gone"), "left_anti")

    postings = _prefixes(chosen, k, percent, crowded_bins(plain, k))
    # aggregates that large tables are joined with are written first: then each join deals out both of its sides
    # itself, and Spark can split the rows of a frequent gram
    shared = written(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("gram"), "shared-grams")
    blocks = written(postings.join(shared, "gram"), "blocks")
    common = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    sized = written(sets.select("doc_id", "n").distinct().join(common, "doc_id").select("doc_id", "n", "c", (F.col("c") / F.col("n")).alias("share")), "sized")
    entries = written(blocks.join(sized, "doc_id"), "entries")
    leaders = written(entries.groupBy("gram").agg(F.max(F.struct("share", (-F.col("doc_id")).alias("lead"))).alias("m")).select("gram", (-F.col("m.lead")).alias("lead")), "leaders")
    stars = entries.select("gram", "doc_id").join(leaders, "gram").where("lead <> doc_id").select(F.least("lead", "doc_id").alias("a"), F.greatest("lead", "doc_id").alias("b")).distinct()
    first = written(_product(written(_by_signature(stars, sets, percent), "star-pairs"), known, k, percent), "star-links")

    # a set's copies hang on its representative, and take no part but for documents of several texts
    several = equal.groupBy(F.col("doc_id").alias("u")).agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("u")
    hinges = written(equal.join(several, F.col("doc_id") == F.col("u"), "left_semi").selectExpr("doc_id AS u", "rep AS v"), "hinges")
    links = lambda *found: hinges.unionByName(_union(found).select(F.col("a").alias("u"), F.col("b").alias("v")))
    near = components(links(first))
    placed = entries.join(near, F.col("doc_id") == F.col("node"), "left").select("gram", "doc_id", "n", "c", F.coalesce("component", "doc_id").alias("comp"))
    open_grams = written(placed.groupBy("gram").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("gram"), "open-grams")
    unsettled = written(placed.join(open_grams, "gram", "left_semi"), "unsettled")
    left, right = unsettled.alias("l"), unsettled.alias("r")
    # The prefix that ends first has all its shared grams within the other's, and linked sets miss at most n - t of
    # each other's grams: so the counts of shared prefix grams, of either document and of the pair, have a bound.
    total = f"ceil({percent} * (l.n + r.n) / {100.0 + percent})"
    spare = lambda x: f"({total} - ceil({percent} * {x}.n / 100.0) + 1)"
    least = f"least({spare('l')}, {spare('r')})"
    fits = F.expr(f"l.doc_id < r.doc_id AND l.comp <> r.comp AND 100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n) AND least(l.c, r.c) >= {least}")
    met = left.join(right, (F.col("l.gram") == F.col("r.gram")) & fits).select(F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b"), F.expr(least).alias("least"))
    rest = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min("least").alias("least")).where("c >= least").select("a", "b")
    second = written(_product(written(_by_signature(rest, sets, percent), "rest-pairs"), known, k, percent), "rest-links")
    final = components(links(first, second))
    of_copies = equal.join(final, F.col("rep") == F.col("node"), "left").select(F.col("doc_id").alias("__id"), F.coalesce("component", "rep").alias("component"))
    placed = written(of_copies.groupBy("__id").agg(F.min("component").alias("component")), "components")
    return profiles.join(placed, F.col("doc_id") == F.col("__id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _union(tables: tuple[DataFrame, ...]) -> DataFrame:
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole
