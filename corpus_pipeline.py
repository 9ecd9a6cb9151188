"""A training corpus from documents: quality, exact and near duplicates, repeated passages, packing.

In every stage a null text counts as an empty one, texts of any length are worked whole in their row, an empty table
gives no rows, and columns besides those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverine.llm.exact_dedup import DigestIndex, exact_dedup, normalised_digest
from riverine.llm.importance import importance_resample
from riverine.llm.ngram_join import ngram_join
from riverine.llm.packing import pack
from riverine.llm.queries import tokenizer_path
from riverine.llm.repeat_spans import remove_repeats
from riverine.llm.shared import without, written

#: SQL cannot express the stages' models, pieces and packing; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Session setting that names a digest index to keep between runs; unset, a run judges its documents alone.
INDEX = "spark.riverine.digestIndex"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling against labelled good documents keeps.

    Rows are judged one by one, so rows without an id are judged by their text; rows that repeat an id and a text share
    their verdict; a null or empty text has weight 0; ties with the last document kept are kept.
    """
    judged = importance_resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=COLUMNS[1:])
    return judged.where("kept").select(COLUMNS)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of those with equal texts: of the largest id, and any one of rows that repeat that id.

    All null and empty texts are equal to each other. A row without an id stays only if no equal text has one.
    """
    name = spark.conf.get(INDEX, None)
    index = DigestIndex(spark, name) if name else DigestIndex.temporary(spark)
    found = exact_dedup(docs, index)
    if not name:
        index.drop()
    digest = normalised_digest(docs["text"])
    kept = without(docs, found.where("NOT kept"), doc_id=docs["doc_id"], text_sha256=digest).select(COLUMNS)
    repeats = written(found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")), "repeated-rows")
    if not repeats.count():
        return kept
    keyed = kept.withColumn("__key", normalised_digest(kept["text"]))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__sha"))
    once = keyed.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "__key"])
    return keyed.join(repeats, same, "left_anti").unionByName(once).select(COLUMNS)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that n-gram links connect, the one of the smallest id.

    Texts without words, and rows without an id, are linked with nothing and stay; rows that share an id are one
    document and share their verdict.
    """
    found = ngram_join(docs)
    return without(docs, found.where("component_id <> doc_id"), doc_id=docs["doc_id"]).select(COLUMNS)


def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the word spans that a document of a smaller id has; n_chars is that of the new text.

    A text that loses nothing stays as it is, a null one null (with n_chars null); rows without an id, and texts of
    fewer than 13 words, lose nothing; rows that share an id don't remove each other's words.
    """
    cut = remove_repeats(docs, keep=["lang", "source"], text_name="text")
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences.

    A null or empty text is a piece of the end id alone; repeated rows and rows without an id are packed each; ties in
    length go by row order.
    """
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_deduplication),
    ("ngram_jaccard_join", near_deduplication),
    ("substring_dedup", substring_deduplication),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
