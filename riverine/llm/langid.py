"""Language identification with bit-sliced Bloom filters of byte n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverine.llm.shared import small_batches, written
from riverine.llm.textblocks import Block, block, mix, slices

#: Bytes of an n-gram.
GRAM = 4


@dataclass
class LanguageFilter:
    """planes[j][position]: bit i is set if a gram of language 64 * j + i hashes there. fallback: the commonest language."""

    languages: list[str]
    planes: list[np.ndarray]
    probes: int
    fallback: str

    @property
    def false_positive(self) -> np.ndarray:
        """By language, the chance that a gram not put in answers yes: its share of set bits to the power of probes."""
        share = [np.mean((self.planes[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(self.languages))]
        return np.minimum(np.array(share) ** self.probes, 0.999)

    def positions(self, grams: np.ndarray, size: int) -> list[np.ndarray]:
        h = mix(grams.astype(np.uint64) + np.uint64(1))
        return [((h >> np.uint64(16 * k)) % np.uint64(size)).astype(np.int64) for k in range(self.probes)]

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """Of every gram, the languages that contain it: one AND over the probes answers for 64 languages at once."""
        at = self.positions(grams, len(self.planes[0]))
        found = []
        for plane in self.planes:
            mask = plane[at[0]]
            for p in at[1:]:
                mask &= plane[p]
            found.append(mask)
        return found


def grams(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Byte n-grams of every text and where each text's begin; texts come with a space on either side."""
    view = np.ndarray((len(b.data) - 7,), "<u4", buffer=b.data, strides=(1,))
    counts = np.maximum(np.diff(b.offsets) - GRAM + 1, 0)
    begin = np.repeat(b.offsets[:-1] - (np.cumsum(counts) - counts), counts)
    return view[np.arange(int(counts.sum())) + begin], np.concatenate([[0], np.cumsum(counts)])


def padded(column: pa.Array) -> pa.Array:
    """Lower-cased, with a space before and behind."""
    return pc.binary_join_element_wise(" ", pc.utf8_lower(column.fill_null("")), " ", "")


def training_sample(docs: DataFrame, max_docs: int) -> DataFrame:
    """At most max_docs (lang, text) of each language, those of the smallest hashes of doc_id.

    Counts by language and range of hashes leave little more than max_docs candidates to put in order.
    """
    bucket = F.shiftrightunsigned(F.xxhash64("doc_id"), 48)  # 2 ** 16 ranges
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", bucket.alias("bucket"))
    counts = written(labelled.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("n")), "hash-ranges")
    lower = F.sum("n").over(Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    reach = counts.withColumn("lower", F.coalesce(lower, F.lit(0))).where(F.col("lower") < max_docs).groupBy(F.col("lang").alias("__lang")).agg(F.max("bucket").alias("most"))
    near = labelled.join(reach, (F.col("lang") == F.col("__lang")) & (F.col("bucket") <= F.col("most")))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = near.withColumn("__n", F.row_number().over(by_hash)).where(F.col("__n") <= max_docs)
    # the number of ids is bounded by max_docs and the number of languages
    chosen = written(ids.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang")).distinct(), "language-sample")
    return docs.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("lang") == F.col("__lang"))).select("lang", "text")


def fit(train: DataFrame, max_docs: int = 500, size: int = 1 << 20, probes: int = 2) -> LanguageFilter:
    """Learns a filter from train (doc_id, text, lang); rows without a language don't count.

    The sample of labelled rows is bounded by max_docs of each language; all of its grams go in. The filter has `size`
    positions of 8 bytes for every 64 languages, so at most that many bits a language reach the driver.
    """
    languages_of = train.where("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {r["lang"]: r["n"] for r in languages_of}
    languages = sorted(sizes)
    model = LanguageFilter(languages, [np.zeros(size, np.uint64) for _ in range(max(1, -(-len(languages) // 64)))], probes, max(languages, key=lambda x: (sizes[x], x), default="und"))
    shape = LanguageFilter([], [np.zeros(1, np.uint64)], probes, "")

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            g, ends = grams(block(padded(batch.column("text"))))
            langs = batch.column("lang").dictionary_encode()
            code = np.repeat(langs.indices.to_numpy().astype(np.int64), np.diff(ends))
            key = np.unique(np.concatenate([code * size + at for at in shape.positions(g, size)]))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // size)), pa.array(key % size)], ["lang", "position"])

    rows = training_sample(train, max_docs).mapInArrow(bits, "lang string, position bigint").distinct().toPandas()
    for i, lang in enumerate(languages):
        model.planes[i // 64][rows["position"][rows["lang"] == lang].to_numpy(np.int64)] |= np.uint64(1 << (i % 64))
    return model


def predict(docs: DataFrame, model: LanguageFilter, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep, lang_pred and score of every row; only the text is looked at.

    A language's popcount over all grams of the text, less what false positives add, is its vote; score is the best
    vote's share of all votes. A null text or one without a letter is `und` at 0; a text with a letter but no known
    gram gets the commonest language at 0. Ties go to the alphabetically first language.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*keep, F.col(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        wrong = m.false_positive
        for batch in (part for whole in batches for part in slices(whole, "text")):
            text = batch.column("text")
            g, ends = grams(block(padded(text)))
            masks, n = m.masks(g), np.diff(ends)
            votes = np.zeros((len(m.languages), len(n)))
            for i in range(len(m.languages)):
                hits = np.concatenate([[0], np.cumsum((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)])
                votes[i] = np.maximum(hits[ends[1:]] - hits[ends[:-1]] - n * wrong[i], 0) / (1 - wrong[i])
            total = votes.sum(axis=0)
            best = votes.argmax(axis=0) if len(m.languages) else np.zeros(len(n), int)
            letters = np.array(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_pylist(), bool)
            score = np.where(letters & (total > 0), votes.max(axis=0, initial=0) / np.where(total > 0, total, 1), 0.0)
            names = [("und" if not a else m.languages[x] if t > 0 else m.fallback) for a, x, t in zip(letters, best, total, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double")


def language_id(docs: DataFrame, folds: int = 5, **parameters: int) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Documents whose crc32 of the id's text is divisible by `folds` are held out: nothing is learnt from them, nor
    from rows without a language or a text. Of an empty table, or without training rows, predictions are `und` and
    no row is lost. A null id is not held out. Repeated rows get a row each; other columns aren't read. Texts of any length
    are read whole in their row; of languages that tie, the first in order of their names is predicted.
    """
    small_batches(docs.sparkSession)
    marked = docs.select("doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False)).alias("held_out"))
    return predict(marked, fit(marked.where("NOT held_out"), **parameters), ["doc_id", "held_out"])
