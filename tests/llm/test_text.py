"""Words, hashes, quality rules, classifiers and language identification."""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from riverine.llm import textblocks as tb
from riverine.llm.importance import features, importance_resample, kth_largest, labelled_sample, weights
from riverine.llm.importance import fit as fit_importance
from riverine.llm.langid import fit, language_id
from riverine.llm.quality_rules import quality_rules

DATA = "/root/testdata/sf0.01"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abÉ \n\t 　xyzxyzxyzxyz", max_size=60)), max_size=12))
def test_words(texts):
    b = tb.block(pa.array(texts, pa.string()), lower=True)
    w = tb.words(b)
    raw = b.data.tobytes()
    for i, t in enumerate(texts):
        own = [raw[s : s + n] for s, n in zip(w.starts[w.first[i] : w.first[i + 1]].tolist(), w.lengths[w.first[i] : w.first[i + 1]].tolist(), strict=True)]
        assert own == re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
    by = {}
    for s, n, h in zip(w.starts.tolist(), w.lengths.tolist(), tb.hashes(b, w).tolist(), strict=True):
        assert by.setdefault(raw[s : s + n], h) == h
    assert len(set(by.values())) == len(by)


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 0, 40, 3, 100, 1)] + [None])], ["text"])
    assert [t for s in tb.slices(batch.slice(1), "text", 30) for t in s.column("text").to_pylist()] == batch.column("text").to_pylist()[1:]


def test_quality_rules(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, "h", long), (2, "h", "a b c a b c " * 20), (3, "h", None), (4, None, long + " #$x"), (5, "", "one\n\none\n  one\nx"), (1, "h", long)] + [(100 + i, "bad", "short") for i in range(30)] + [(200, "bad", long)] + [(300 + i, "h", long) for i in range(30)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, host int, n_words int")
    out = {r.doc_id: r for r in quality_rules(df).collect()}
    assert (out[1].n_words, out[1].n_repeat_words, out[1].base_failed, out[1].kept) == (80, 0, False, True)
    assert (out[2].n_words, out[2].n_repeat_words, out[2].base_failed) == (120, 120, True)
    assert (out[3].n_words, out[3].word_chars, out[3].base_failed) == (0, 0, True)
    assert (out[4].n_symbols, out[5].n_dup_lines) == (2, 1)
    assert not out[200].base_failed and not out[200].kept and out[200].host_rate > 0.5
    assert quality_rules(df).count() == len(rows) and quality_rules(df.limit(0)).count() == 0


def plain_features(text):
    """Tokens, pairs of neighbours, as the model sees them."""
    return re.findall(rb"[A-Za-z0-9_\x80-\xff]+|[^\sA-Za-z0-9_\x80-\xff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())


def test_weights(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(150)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, None), (-2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(n % 4 > 0)) for n, (i, _) in enumerate(rows[:80])], "doc_id long, quality int")
    buckets = 500
    code = {}

    def bucket(token):
        if token not in code:
            b = tb.block(pa.array([token.decode()]))
            code[token] = int(tb.hashes(b, tb.Words(np.array([0]), np.array([len(token)]), np.array([0, 1])))[0])
        return code[token]

    def counts(text):
        t = [bucket(x) for x in plain_features(text)]
        pairs = [(a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(t, t[1:], strict=False)]
        return Counter(x % buckets for x in t + pairs)

    each = {i: counts(t) for i, t in rows}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    raw, target = np.ones(buckets), np.ones(buckets)
    for i, c in each.items():
        for k, n in c.items():
            raw[k] += n
            target[k] += n * (i in good)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    model = fit_importance(df, labelled_sample(labels, 1000), buckets)
    assert np.allclose(model, ratio)
    for r in weights(df, model).collect():
        assert abs(r.log_weight - sum(n * ratio[k] for k, n in each[r.doc_id].items())) < 1e-6
    assert features(tb.block(pa.array(["a", None])), 10)[1].tolist() == [0]


def test_importance_keeps_good_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = importance_resample(docs.withColumn("kept", docs["n_chars"]), labels).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in out}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_importance_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.kept for r in importance_resample(docs, none).collect()} == {True}
    assert importance_resample(docs.limit(0), none).count() == 0
    top = importance_resample(docs, none, k=2).where("kept").count()
    assert top >= 2
    long = spark.createDataFrame([(1, "word " * 200_000, "x"), (2, "a b", "y")], "doc_id long, text string, source string")
    assert [r.source for r in importance_resample(long, none, keep=["source"]).orderBy("doc_id").collect()] == ["x", "y"]


@pytest.mark.parametrize("temperature", [1.0, 50.0])
def test_gumbel_top_k(spark, temperature):
    """The k largest of log weight / temperature plus noise, the noise worked out from the id here."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = importance_resample(docs, labels, k=120, temperature=temperature, seed=5).collect()
    keys = {}
    for r in out:
        h = xxhash.xxh64(struct.pack("<i", 5), xxhash.xxh64(struct.pack("<q", r.doc_id), 42).intdigest()).intdigest()
        keys[r.doc_id] = r.log_weight / temperature - math.log(-math.log(((h >> 11) + 0.5) / 2**53))
        assert abs(keys[r.doc_id] - r.gumbel_key) < 1e-6
    assert {r.doc_id for r in out if r.kept} == set(sorted(keys, key=keys.get, reverse=True)[:120])
    plain = set(sorted(keys, key=lambda i: next(r.log_weight for r in out if r.doc_id == i), reverse=True)[:120])
    assert temperature < 2 or plain != {r.doc_id for r in out if r.kept}  # a sample, not a cut


@pytest.mark.parametrize("k", [1, 7, 500, 1999, 2000])
def test_kth_largest(spark, k):
    values = [float(i % 700) for i in range(2000)]
    assert kth_largest(spark.createDataFrame([(v,) for v in values], "v double"), "v", k, 16, 50) == sorted(values, reverse=True)[k - 1]


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "123 !!", None), (-3, "", "en"), (-4, "the", None), (None, "der die das und", None)], docs.schema)
    both = docs.union(odd).withColumn("lang_pred", docs["lang"])
    out = language_id(both).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len(out) == docs.count() + 5
    held = [r for r in out if r.held_out and r.lang]
    assert len(held) > 150 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and by[-4].lang_pred in {"en", "de", "fr", "es"} and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in out)
    alone = language_id(docs.limit(0))
    assert alone.collect() == []


def test_language_against_plain_sets(spark):
    """With so many positions that no false positive is left, the votes are those of plain sets of grams."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    tied = spark.createDataFrame([(-5, "qqqqzzzz", None), (-6, "ab", None), (-7, "x" * 300_000, None)], docs.schema)
    rows = docs.union(tied).collect()
    grams_of = lambda t: [x[i : i + 4] for x in [f" {t.lower()} ".encode()] for i in range(len(x) - 3)]
    known, sizes = defaultdict(set), Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None:
            sizes[r.lang] += 1
            known[r.lang].update(grams_of(r.text or ""))
    langs = sorted(sizes)
    for r in language_id(docs.union(tied), size=1 << 24).collect():
        text = next(x.text for x in rows if x.doc_id == r.doc_id)
        if not text or not re.search(r"[^\W\d_]", text):
            assert r.lang_pred == "und" and r.score == 0
            continue
        votes = [sum(g in known[x] for g in grams_of(text)) for x in langs]
        want = langs[votes.index(max(votes))] if max(votes) else max(langs, key=lambda x: (sizes[x], x))
        assert r.lang_pred == want or sorted(votes)[-1] - sorted(votes)[-2] <= 1, (r, votes)
        assert abs(r.score - (max(votes) / sum(votes) if sum(votes) else 0)) < 0.01


def test_bloom_false_positives(spark):
    docs = spark.createDataFrame([(i, "abcdefgh ijklmnop " * 5, f"l{i % 70:02d}") for i in range(280)], "doc_id long, text string, lang string")
    model = fit(docs, size=1 << 12)
    assert len(model.languages) == 70 and len(model.planes) == 2 and (model.false_positive < 0.01).all()
    masks = model.masks(np.frombuffer(b"abcd", "<u4"))
    assert int(masks[0][0]) == 2**64 - 1 and int(masks[1][0]) == 2**6 - 1
