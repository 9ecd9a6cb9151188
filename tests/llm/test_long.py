"""Texts of about a megabyte, whole, in the operators that work text by text."""

import base64
import hashlib

import numpy as np
import pytest

from riverine.llm import bpe, packing
from riverine.llm.quality_rules import quality_rules
from riverine.llm.warc import warc_round_trip

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")
LONG = "".join(f"word{k % 997} and é{k % 13}, then #{k % 7}.\n" for k in range(40_000))


def test_rules(spark):
    df = spark.createDataFrame([(1, LONG, "a"), (2, None, "a")], "doc_id long, text string, source string")
    row = {r.doc_id: r for r in quality_rules(df).collect()}[1]
    words = LONG.split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in zip(*np.unique(np.array([hash(w) for w in windows]), return_counts=True), strict=True) if n > 1}
    repeated = {i + j for i, w in enumerate(windows) if hash(w) in often for j in range(3)}
    assert (row.n_words, row.n_repeat_words, row.n_symbols) == (len(words), len(repeated), LONG.count("#"))
    assert row.n_dup_lines == 40_000 - len(set(LONG.splitlines()))


def test_archive(spark):
    page = spark.createDataFrame([(7, "http://a/b", LONG)], "page_id long, url string, html string")
    row, raw = warc_round_trip(page).first(), LONG.encode()
    assert row.payload_bytes == len(raw) and row.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_tokens_and_pieces(spark):
    df = spark.createDataFrame([(1, LONG), (2, "short"), (3, "short"), (4, LONG)], "doc_id long, text string")
    byte, word = (vocabularies.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    ids = tokenizers.Tokenizer.from_file(byte).encode(LONG, add_special_tokens=False).ids
    got = {r.doc_id: r for r in bpe.bpe_round_trip(df, byte).collect()}
    assert got[1].n_tokens == len(ids) and got[1].ids_sha256 == got[4].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    pieces = packing.pack(df, word, 4096).collect()
    total = len(tokenizers.Tokenizer.from_file(word).encode(LONG, add_special_tokens=False).ids) + 1
    own = sorted((r.piece, r.start, r.length) for r in pieces if r.doc_id == 1)
    assert [s for _, s, _ in own] == list(range(0, total, 4096)) and sum(n for *_, n in own) == total
    used = {}
    for r in pieces:  # pieces of equal lengths, of both long texts and both short ones, each have a place of their own
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096
