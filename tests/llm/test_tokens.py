"""Encoding and packing against the tokenizers library and plain best fit."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
from brute import check_packing

from riverine.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")
BYTE, WORD = (vocabularies.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    None, "", "a", " a  b ", "Foo\tbar\x0b\x0b baz é x  ", "x" * 5000, "<|endoftext|> a <|endoftext|>b  <|endoftext|> ", "<|EndOfText|> X<|startoftext|>Y", "don't   stop\n\n\nnow  \n A",
    "　 ab ä\n\té̂ ́x İSTANBUL ΣΑΣ", "don't're,'s''s a,'ll b.'d A1,2'x 3rd", "🙂 ퟿ a​ b", "1234567 8,9.0", "a" * 3 + " \t\n" * 50,
]


def rows(seed):
    rng = random.Random(seed)
    alphabet = list("abS1',lsé \n\t 　 .|<>́🙂")
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    return list(enumerate(ODD + made)) + [(3, " a  b "), (None, "no id")]


def test_round_trip(spark):
    t = tokenizers.Tokenizer.from_file(BYTE)
    data = rows(1)
    df = spark.createDataFrame([(i, x, 1) for i, x in data], "doc_id long, text string, n_tokens int")
    want = []
    for i, x in data:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.bpe_round_trip(df, BYTE).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.bpe_round_trip(df.limit(0), BYTE).collect() == []


def test_forced_cuts_are_certain():
    spec = bpe.load(BYTE)
    cuts = bpe.forced_cuts(spec)
    of = bpe.byte_of_char()
    assert cuts.any() and not any(cuts[of[a], of[b]] for token in spec["model"]["vocab"] for a, b in zip(token, token[1:], strict=False))


def test_forgetting_changes_nothing(monkeypatch):
    import pyarrow as pa

    from riverine.llm import textblocks as tb

    monkeypatch.setattr(bpe, "CACHE", 40)
    t, store, cuts = tokenizers.Tokenizer.from_file(BYTE), bpe.Fragments(BYTE), bpe.forced_cuts(bpe.load(BYTE))
    for part in range(6):
        texts = [x or "" for _, x in rows(part)]
        b = tb.block(pa.array(texts))
        w = bpe.fragments(b, cuts)
        at = store.look_up(b, w)
        ends = np.concatenate([[0], np.cumsum(store.lengths[at])])[w.first]
        ids = store.ids(at)
        assert [ids[i:j].tolist() for i, j in zip(ends[:-1], ends[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("capacity", [16, 4096])
def test_pack(spark, capacity):
    t = tokenizers.Tokenizer.from_file(WORD)
    data = rows(2)
    df = spark.createDataFrame([(i, x, 1) for i, x in data], "doc_id long, text string, piece int")
    pieces = packing.pack(df, WORD, capacity).collect()
    n = check_packing(pieces, data, capacity, lambda x: t.encode(x, add_special_tokens=False).ids)
    total = sum(r.length for r in pieces)
    assert n <= 1.02 * -(-total // capacity) + 2
    assert packing.pack(df.limit(0), WORD).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing(seed):
    lengths = np.random.default_rng(seed).integers(1, 101, 300)
    bins, offsets = packing.best_fit_decreasing(lengths, 100)
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [(r, i) for i, r in enumerate(rooms) if r >= length]
        if fitting:
            rooms[min(fitting)[1]] -= length
        else:
            rooms.append(100 - length)
    assert len(rooms) == bins.max() + 1
    for one in range(bins.max() + 1):
        mine = bins == one
        order = np.argsort(offsets[mine])
        own = lengths[mine][order]
        assert (offsets[mine][order] == np.cumsum(own) - own).all() and own.sum() <= 100


def test_no_vocabulary_in_the_repository():
    names = {Path(BYTE).name, Path(WORD).name}
    assert not [p for p in Path(__file__).parents[2].rglob("*.json") if p.name in names]
