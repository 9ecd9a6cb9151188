"""Exact, near and passage duplicates and boilerplate lines against plain versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import exact, near, repeats

from riverine.llm.components import components
from riverine.llm.exact_dedup import DigestIndex, exact_dedup
from riverine.llm import line_dedup as line_module
from riverine.llm.line_dedup import line_dedup
from riverine.llm.ngram_join import _profiles, ngram_join, overlaps
from riverine.llm.repeat_spans import remove_repeats, repeated_spans

ODD = [(None, "a b c d e f"), (None, None), (5, None), (6, ""), (7, " x\t y "), (8, "X y"), (9, "x y z"), (3, "a B c d e f"), (4, "a b c d E f g"), (11, "\n"), (12, "É x"), (13, "é x")]


def copies(seed):
    """Texts with near copies, shared passages, repeated rows and an id that two texts share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    rows, passage = list(ODD), [rng.choice(vocabulary) for _ in range(30)]
    for _ in range(10):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, 150))]
        for _ in range(rng.randint(1, 30)):
            t = base[:]
            for _ in range(rng.randint(0, max(1, len(t) // 15))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                at = rng.randrange(len(t) + 1)
                t[at:at] = passage[rng.randint(0, 9) :]
            rows.append((rng.randint(100, 100000), " ".join(t)))
    return rows + rows[20:25] + [(rows[40][0], "another text with some more words in it")] + [(50, "z " * 400), (51, "z " * 37)]


def frame(spark, rows):
    extra = [(i, t, 1, "x", True, "y", 2, 3) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, n long, digest string, kept boolean, low string, whole int, apart int")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_near(spark, seed):
    rows = copies(seed)
    assert got(ngram_join(frame(spark, rows))) == sorted(near(rows), key=repr)


@pytest.mark.parametrize("seed", [3, 4])
def test_repeats(spark, seed):
    rows = copies(seed)
    want = [(i, n, m, hashlib.sha256(t).hexdigest()) for i, n, m, t in repeats(rows)]
    assert got(remove_repeats(frame(spark, rows))) == sorted(want, key=repr)


def test_repeats_with_text(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"a {passage}\n b"), (2, f"c {passage} d"), (3, "one  two"), (4, None)]
    out = {r.doc_id: (r.kept, r.low, r.apart) for r in remove_repeats(frame(spark, rows), keep=["low", "apart"], text_name="kept").collect()}
    assert out == {1: (f"a {passage}\n b", "y", 3), 2: ("c d", "y", 3), 3: ("one  two", "y", 3), 4: (None, "y", 3)}


def test_exact_and_index(spark):
    rows = copies(5)
    index = DigestIndex(spark, "digests_of_test", 4)
    first = got(exact_dedup(frame(spark, rows), index))
    assert first == sorted(exact(rows), key=repr)
    later = exact_dedup(frame(spark, [(200000, "X Y"), (200001, " X\t y "), (200002, "new"), (200003, "NEW")]), index).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in later) == [(200000, 8, False), (200001, 7, False), (200002, 200003, False), (200003, 200003, True)]
    assert got(exact_dedup(frame(spark, rows), index)) == first  # a batch that runs again gets the verdicts it had
    table = index.read()
    assert table.count() == table.select("digest").distinct().count() == len({r[4] for r in first}) + 1
    assert got(exact_dedup(frame(spark, []), index)) == []
    index.drop()
    assert not index.exists()
    long = spark.createDataFrame([(1, "Ab " * 300_000), (2, "aB " * 300_000)], "doc_id long, text string")
    assert sorted((r.keep_id, r.kept) for r in exact_dedup(long, index).collect()) == [(2, False), (2, True)]
    index.drop()


@pytest.mark.parametrize("operator", [ngram_join, remove_repeats, line_dedup])
def test_empty(spark, operator):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert operator(empty).collect() == []


def test_lines(spark):
    rows = [(i, "A", f"menu\nbody {i}\n\n") for i in range(30)] + [(100 + i, "B", f"menu\nbody {i}") for i in range(5)] + [(200, None, None), (201, "A", ""), (202, "A", "menu\nmenu\nlast"), (202, "A", "menu\nmenu\nlast")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, source string, text string, pages int, boiler string")
    out = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup(df).collect()}
    assert out[3] == (4, 1, "body 3\n\n") and out[100] == (2, 1, "body 0") and out[200] == (0, 0, None) and out[201] == (1, 0, "") and out[202] == (3, 2, "last")
    assert line_dedup(df).count() == len(rows)


def test_lines_of_white_space_stay(spark, monkeypatch):
    rows = [(i, "A", f"\r\n \x0b\r\nmenu\r\n{i}\r\n") for i in range(5)] + [(9, "A", "one " * 200_000 + "\nmenu\r")]
    want = {i: f"\r\n \x0b\r\n{i}\r\n" for i in range(5)} | {9: ("one " * 200_000)}
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for limit in (line_module.BROADCAST_BYTES, -1):  # broadcast, and dealt out in parts
        monkeypatch.setattr(line_module, "BROADCAST_BYTES", limit)
        assert {r.doc_id: r.text for r in line_dedup(df).collect()} == want
        assert line_dedup(df.limit(0)).collect() == []


def test_overlaps():
    rng = random.Random(1)
    left, right = ([sorted(rng.sample(range(40), rng.randint(0, 30))) for _ in range(50)] for _ in range(2))
    packed = lambda rows: pa.array([np.array(r, np.uint64).tobytes() for r in rows], pa.binary())
    assert overlaps(packed(left), packed(right)).tolist() == [len(set(a) & set(b)) for a, b in zip(left, right, strict=True)]
    assert overlaps(packed(left).slice(7, 5), packed(right).slice(7, 5)).tolist() == [len(set(a) & set(b)) for a, b in zip(left[7:12], right[7:12], strict=True)]


def test_spans_have_source_coordinates(spark):
    shared = [f"p{i}" for i in range(60)]
    rows = [(1, "a b " + " ".join(shared) + " c"), (2, "d " + " ".join(shared[:40]) + " e f"), (3, " ".join(shared[20:]) + " g"), (4, " ".join(shared[5:18]))]
    out = {r.doc_id: (r.starts, r.n_words, r.source, r.source_start) for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {2: ([1], 40, 1, 2), 3: ([0], 40, 1, 22), 4: ([0], 13, 1, 7)}


def test_fingerprints_before_empty_texts(spark):
    texts = ["a b c d e f g h i j", "k l m n o p q r s t"]
    prints = lambda rows: {r.doc_id: (r.n, r.fp, r.fp2) for r in _profiles(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1), 5).collect()}
    plain, followed = prints(texts), prints([*texts, None, ""])
    assert {i: followed[i] for i in plain} == plain and followed[2] == followed[3]


def test_lines_of_small_hosts(spark):
    rows = [(i, "B", f"menu\nbody {i}") for i in range(5)] + [(10, "C", "menu\none"), (11, "C", "menu\ntwo"), (20, "D", "menu\nmenu\nalone")]
    out = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert out == {i: (1, f"body {i}") for i in range(5)} | {10: (1, "one"), 11: (1, "two"), 20: (0, "menu\nmenu\nalone")}


def test_components_of_a_chain(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False)] + [(100, 101), (7, 7)], "u long, v long")
    out = dict(got(components(links)))
    assert out == {i: 0 for i in range(1, 60)} | {101: 100}
