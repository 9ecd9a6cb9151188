"""The pipeline's stages against plain versions, each on what its predecessor kept."""

import corpus_pipeline
import pytest
from brute import check_packing, exact, near, repeats

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from riverine.llm.importance import importance_resample
    from riverine.llm.queries import tokenizer_path

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == corpus_pipeline.COLUMNS and dict(docs.dtypes) == dict(before.dtypes)
        kept[name] = (rows(before), rows(docs))
    before, after = kept["quality_classifier"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = {r.doc_id: r.kept for r in importance_resample(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()}
    assert sorted(after) == sorted(r for r in before if judged[r[0]])
    bad = {r.doc_id for r in labels.where("quality = 1").collect()} - {i for i, _ in after}
    assert len(bad) <= 2
    before, after = kept["exact_dedup"]
    assert sorted(after) == sorted(r for r, e in zip(before, exact(before), strict=True) if e[3])
    before, after = kept["ngram_jaccard_join"]
    assert sorted(after) == sorted(r for r, e in zip(before, near(before), strict=True) if e[0] == e[2])
    before, after = kept["substring_dedup"]
    assert sorted(after) == sorted((i, t if not e[2] else e[3].decode()) for (i, t), e in zip(before, repeats(before), strict=True))
    t = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = corpus_pipeline.packing(spark, docs, SF).collect()
    check_packing(pieces, after, 4096, lambda x: t.encode(x, add_special_tokens=False).ids)


ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t", "en", "s", 2), (None, "a text without an id " * 9, "en", None, 1), (None, "a text without an id " * 9, None, "s", 1),
    (4, "x " * 60_000, "en", "s", 120_000), (5, "X " * 60_000, "en", "s", 120_000), (6, "same row twice", "en", "s", 14), (6, "same row twice", "en", "s", 14), (7, "Same Row twice", "en", "s", 14), (7, "Same Row twice", "en", "s", 14),
    (8, " ".join(f"w{i}" for i in range(90)), "de", "t", 1), (9, " ".join(f"w{i}" for i in range(92)), "de", "t", 1), (10, "y " + " ".join(f"w{i}" for i in range(20)), "de", "t", 1),
]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, tmp_path, empty):
    """Nulls, repeated rows, ties, empty and long texts, an empty table, columns of clashing names; no labels, so all quality is kept."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([] if empty else ODD, schema)
    for name in ("kept", "digest", "__id", "carried", "spans", "gram"):
        docs = docs.withColumn(name, docs["source"])
    seen = rows(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}").cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        before, seen = seen, rows(docs)
        if name == "quality_classifier":
            want = before
        elif name == "exact_dedup":
            want = list(dict.fromkeys(r for r, e in zip(before, exact(before), strict=True) if e[3]))
        elif name == "ngram_jaccard_join":
            want = [r for r, e in zip(before, near(before), strict=True) if e[0] == e[2]]
        else:
            want = [(i, t if not e[2] else e[3].decode()) for (i, t), e in zip(before, repeats(before), strict=True)]
        assert sorted(seen, key=repr) == sorted(want, key=repr), name
    pieces = corpus_pipeline.packing(spark, docs, f"file://{tmp_path}").collect()
    assert len({(r.doc_id, r.piece) for r in pieces}) == len(pieces) and (len(pieces) == 0) == empty


def test_named_index_remembers(spark):
    docs = spark.createDataFrame([(1, "one", "en", "s", 3), (2, "two", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set(corpus_pipeline.INDEX, "index_of_test")
    try:
        first = rows(corpus_pipeline.exact_deduplication(spark, docs, ""))
        assert sorted(first) == [(1, "one"), (2, "two")] and sorted(rows(corpus_pipeline.exact_deduplication(spark, docs, ""))) == sorted(first)
        later = docs.union(spark.createDataFrame([(9, "ONE", "en", "s", 3), (10, "new", "en", "s", 3)], docs.schema))
        assert sorted(rows(corpus_pipeline.exact_deduplication(spark, later, ""))) == [(1, "one"), (2, "two"), (10, "new")]
    finally:
        spark.conf.unset(corpus_pipeline.INDEX)
        spark.sql("DROP TABLE index_of_test")


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
