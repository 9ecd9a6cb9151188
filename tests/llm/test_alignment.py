"""Alignment of tokens against both libraries on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from riverine.llm import alignment
from riverine.llm.bpe import byte_of_char, load

pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")
A, B = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model")
ODD = [
    None, "", "a", " ", "   ", " a  b ", "Foo\tbar\x0b\x0b baz é x  ", "x" * 5000, "<|endoftext|> a <s></s><unk><0x41> b", "don't   stop\n\n\nnow  \n A", "　 ab ä\n\té̂ ́x İSTANBUL",
    "🙂 ퟿ a​ b", "▁ a", "a▁b", "ﬁＡ①", "\u0000 x", "a\u0085 b  c  d", "日本 語 の\r\nх ю", "a" * 3 + " \t\n" * 50, "x,y;z'll 'sA1,2'", "word " * 30000,
]


def made(seed, n=300):
    rng = random.Random(seed)
    alphabet = list("abS1',lsé \n\t 　 .|<>́🙂дж日▁ \u0085x  ")
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


class Plain:
    def __init__(self):
        import sentencepiece

        self.a = tokenizers.Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        of = byte_of_char()
        self.a_bytes = {i: bytes(of[c] for c in t) for t, i in load(A)["model"]["vocab"].items()}
        self.size = self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]

    def groups(self, text):
        """Groups of (ids of A, ids of B), and the number of tokens of both."""
        raw = f" {text}".encode()
        a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
        if b"".join(self.a_bytes[i] for i in a) != raw or b"".join(self.b_bytes[i] for i in b) != raw:
            return None
        ends = [dict(zip(np.cumsum([len(of[i]) for i in ids]).tolist(), range(1, len(ids) + 1), strict=True)) for ids, of in ((a, self.a_bytes), (b, self.b_bytes))]
        found, x, y = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            found.append((a[x : ends[0][end]], b[y : ends[1][end]]))
            x, y = ends[0][end], ends[1][end]
        return found, len(a), len(b)


def expected(rows):
    plain = Plain()
    each = [plain.groups(t) if t else None for _, t in rows]
    count = Counter((g[0][-1], g[1][-1]) for e in each if e for g in e[0])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for (i, _), e in zip(rows, each, strict=True):
        if not e:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(g[0][-1], g[1][-1]) for g in e[0]]
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in e[0])
        out.append((i, e[1], e[2], len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(shown.encode()).hexdigest()))
    return out


def test_alignment(spark):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(ODD + made(1))] + [(3, " a  b "), (3, " a  b ")]
    df = spark.createDataFrame([(i, t, 1, [2]) for i, t in rows], "doc_id long, text string, n_a int, links array<int>")
    got = sorted(map(repr, map(tuple, alignment.cross_tokenizer(df, A, B).collect())))
    assert got == sorted(map(repr, expected(rows)))
    assert alignment.cross_tokenizer(df.limit(0), A, B).collect() == []


def test_groups_and_pairs(spark):
    df = spark.createDataFrame([(1, "the cat, the hat"), (2, "ﬁ the"), (3, None)], "doc_id long, text string")
    aligned = alignment.align_tokens(df, A, B)
    plain = Plain()
    shown = {r.doc_id: r for r in aligned.collect()}
    for i, t in ((1, "the cat, the hat"), (2, "ﬁ the")):
        assert shown[i].groups == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in plain.groups(t)[0])
    assert shown[3].groups == "" and shown[3].links == []
    pairs = {(r.a_id, r.b_id): (r["count"], r.best) for r in alignment.pair_counts(aligned, plain.size).collect()}
    the = plain.groups("the")[0][0]
    assert pairs[the[0][0], the[1][0]] == (3, True)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, alignment.cross_tokenizer(df, A, B).collect())) == sorted(expected(rows))


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE", 60)
    store, plain = alignment.Aligned(A, B), Plain()
    for seed in range(8):
        texts = [t for t in made(seed, 60) if t]
        data, ends = alignment._with_space(pa.array(texts))
        starts = store.starts_of(data, ends)
        for i, t in enumerate(texts):
            own = [*starts[(starts >= ends[i]) & (starts < ends[i + 1])].tolist(), int(ends[i + 1])]
            raws = [data[s:e].tobytes() for s, e in zip(own[:-1], own[1:], strict=True)]
            at = store.look_up(pa.array(list(dict.fromkeys(raws)), pa.large_binary()))
            of = dict(zip(dict.fromkeys(raws), at.tolist(), strict=True))
            want = plain.groups(t)
            assert all(store.sizes[of[r], 3] for r in raws) == (want is not None)
            if want:
                assert ";".join(x for r in raws if (x := store.texts[of[r]])) == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in want[0])


def test_pairs_are_bounded_by_the_vocabularies():
    """Of two linked tokens one's bytes end the other's; so many such pairs exist, which is what may be broadcast."""
    store = alignment.Aligned(A, B)
    sides = []
    for t in (store.a.table, store.b.table):
        sides.append(Counter(t.flat[s : s + n].tobytes() for s, n in zip(t.starts, t.lengths, strict=True)))
    bound = sum(n * sides[1][x[k:]] for x, n in sides[0].items() for k in range(len(x))) + sum(n * sides[0][x[k:]] for x, n in sides[1].items() for k in range(1, len(x)))
    assert bound < 400_000
