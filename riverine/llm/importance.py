"""Quality classifier by importance resampling: two hashed n-gram models and Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverine.llm.shared import small_batches, written
from riverine.llm.textblocks import Block, Words, block, hashes, segments, slices

#: 0: white space, 1: letters, digits and all bytes beyond ASCII, 2: other marks.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1


def tokens(b: Block) -> Words:
    """Runs of letters and digits, and runs of other marks."""
    kind = _CLASS[b.data[: int(b.offsets[-1])]]
    begins = np.zeros(len(kind), bool)
    begins[1:] = kind[1:] != kind[:-1]
    return segments(b, begins, kind > 0)


def features(b: Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of the block, and the text that each belongs to."""
    w = tokens(b)
    h = hashes(b, w)
    text = np.repeat(np.arange(len(b)), w.counts)
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    same = text[:-1] == text[1:]
    return np.concatenate([h % np.uint64(buckets), pair[same] % np.uint64(buckets)]).astype(np.int64), np.concatenate([text, text[:-1][same]])


def bucket_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in the texts of docs; a task hands on one count a bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            total += np.bincount(features(block(batch.column("text"), lower=True), buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most `buckets` rows
    counts = np.zeros(buckets)
    counts[rows["bucket"].to_numpy(np.int64)] = rows["n"]
    return counts


def labelled_sample(labels: DataFrame, max_labels: int) -> DataFrame:
    """At most max_labels (id, quality) rows of the labels, those of the smallest hashes."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("quality").alias("__quality")).distinct()
    return written(chosen.orderBy(F.xxhash64("__id"), "__id").limit(max_labels), "labels")


def fit(docs: DataFrame, labelled: DataFrame, buckets: int = 10_000, smoothing: float = 1.0) -> np.ndarray:
    """By bucket, the log of its probability in documents labelled 1 (a bounded sample) over that in all documents."""
    good = F.broadcast(labelled.where("__quality = 1").select("__id"))  # bounded by max_labels
    target = bucket_counts(docs.join(good, docs["doc_id"] == F.col("__id"), "left_semi"), buckets) + smoothing
    raw = bucket_counts(docs, buckets) + smoothing
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """docs (doc_id, text and, if there is one, carried) with log_weight in place of the text: the sum of log ratios over all features of the whole text; 0 without features."""
    names = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            b = block(batch.column("text"), lower=True)
            bucket, text = features(b, len(shared.value))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.bincount(text, shared.value[bucket], len(b)).astype(np.float64))], [*names, "log_weight"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.mapInArrow(run, f"{kinds}, log_weight double")


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096, at_most: int = 20_000) -> float:
    """The k-th largest value, by counting in ever narrower bins; the driver sees counts and at most at_most values."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return low
    while n > at_most and high > low:
        width = (high - low) / bins
        within = keys.where(F.col(column).between(low, high))
        rows = within.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).orderBy(F.desc("bin")).collect()
        for r in rows:
            if k <= r["n"]:
                low, high, n = r["a"], r["b"], r["n"]
                break
            k -= r["n"]
    if low == high:
        return low
    return sorted((r[0] for r in keys.where(F.col(column).between(low, high)).select(column).collect()), reverse=True)[k - 1]


def threshold(scored: DataFrame, labelled: DataFrame, lose: float) -> float:
    """The log weight at which all but a share `lose` of the documents labelled 1 pass, or fewer if more of those labelled 0 fail.

    Between the `lose` quantile of label 1 and the largest margin below it, the cut with the fewest errors is taken.
    """
    rows = scored.join(F.broadcast(labelled), F.col("doc_id") == F.col("__id")).select("log_weight", "__quality").toPandas()  # bounded by max_labels
    good, bad = np.sort(rows["log_weight"][rows["__quality"] == 1]), np.sort(rows["log_weight"][rows["__quality"] != 1])
    if not len(good) or not len(bad):
        return -np.inf
    most = good[int(lose * len(good))]
    cuts = np.unique(np.concatenate([good[good <= most], bad[bad <= most]]))
    errors = np.searchsorted(good, cuts) + (len(bad) - np.searchsorted(bad, cuts))
    return float(cuts[errors.argmin()])


def importance_resample(
    docs: DataFrame, labels: DataFrame, buckets: int = 10_000, max_labels: int = 20_000, lose: float = 0.002, k: int | None = None, temperature: float = 1.0, seed: int = 17,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, log_weight, gumbel_key, kept.

    Every document's log weight is its log-likelihood under a hashed n-gram model of the target (documents labelled
    quality 1, at most max_labels labels) less that under one of the raw corpus (all documents). The k rows of the
    largest log weight / temperature plus Gumbel noise are kept. Without a k, it is the number of documents above the
    weight that best parts labels 1 and 0, of which at most a share `lose` of label 1 may fall short; without both
    labels, everything is kept. Null or empty texts have weight 0; the noise is a function of doc_id, so repeated
    rows share their fate, and rows that tie with the k-th are kept as well. An empty table gives no rows. `keep` names
    further columns to return, not those of the result; others aren't read. Labels of unknown ids do nothing. Texts of any
    length are read whole in their row.
    """
    small_batches(docs.sparkSession)
    labelled = labelled_sample(labels, max_labels)
    plain = docs.select("doc_id", "text")
    noise = F.expr(f"-ln(-ln((shiftrightunsigned(xxhash64(doc_id, {seed}), 11) + 0.5D) / 9007199254740992D))")
    carried = docs.select("doc_id", "text", F.struct(*keep).alias("carried")) if keep else plain
    scored = written(weights(carried, fit(plain, labelled, buckets)).withColumn("gumbel_key", F.col("log_weight") / temperature + noise), "weights")
    if k is None:
        k = scored.where(F.col("log_weight") >= threshold(scored, labelled, lose)).count()
    least = kth_largest(scored, "gumbel_key", k) if k else float("inf")
    kept = F.col("gumbel_key") >= F.lit(least) if least is not None else F.lit(True)
    return scored.select("doc_id", "log_weight", "gumbel_key", kept.alias("kept"), *[F.col(f"carried.`{c}`") for c in keep or []])
