"""Alignment of two tokenizers' tokens by the byte offsets at which tokens of both end."""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverine.llm.bpe import _ALNUM, _MARK, byte_of_char, load
from riverine.llm.shared import small_batches, written
from riverine.llm.textblocks import ragged, slices

#: Fragments whose alignment a Python worker remembers; beyond it, those met once are forgotten.
CACHE = 150_000
#: Bytes of text aligned at a time, and fragments given to a library at a time.
SLICE, BATCH = 1 << 20, 2500
#: The mark of a space in pieces, and what is put before a fragment: no piece goes on from it, and the space that the model adds stands before it.
MARK, BEFORE = "▁", "\n"


@dataclass
class Tokens:
    """Tokens of a batch of fragments laid end to end: ids, spans (bytes of the batch), and tokens of each fragment."""

    ids: np.ndarray
    begin: np.ndarray
    stop: np.ndarray
    counts: np.ndarray


def refined(t: Tokens, lengths: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Byte offsets at which tokens end, from a library's spans and the bytes that tokens stand for.

    The end of a span is a cut if the fragment's next token begins there, after whole characters. Between cuts, tokens
    that share a character, or fall back to bytes (spans of nothing but the last), end where their bytes do. base: where
    each token's fragment begins. Raises if bytes and cuts contradict each other.
    """
    total = np.concatenate([[0], np.cumsum(lengths)])
    first = np.repeat(np.cumsum(t.counts) - t.counts, t.counts)
    ends = base + total[1:] - total[first]
    last = np.zeros(len(t.ids), bool)
    last[np.cumsum(t.counts)[t.counts > 0] - 1] = True
    cuts = (t.stop > t.begin) & (last | (np.append(t.begin[1:], 0) >= t.stop))
    if (ends != t.stop)[cuts].any():
        raise ValueError("spans and bytes of tokens contradict each other")
    return ends


class TokenTable:
    """The bytes of every id, end to end."""

    def __init__(self, each: list[bytes]):
        self.flat = np.frombuffer(b"".join(each) + b"\0", np.uint8)
        self.lengths = np.array([len(x) for x in each], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def agree(self, t: Tokens, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the tokens of each fragment give back its bytes."""
        n = self.lengths[t.ids]
        sums = np.concatenate([[0], np.cumsum(n)])
        last = np.cumsum(t.counts)
        good = sums[last] - sums[last - t.counts] == sizes
        keep = np.repeat(good, t.counts)
        own = self.flat[ragged(self.starts[t.ids[keep]], n[keep])]
        differ = np.concatenate([[0], np.cumsum(own != data[ragged(starts[good], sizes[good])])])
        ends = np.cumsum(sizes[good])
        good[good] = differ[ends] == differ[ends - sizes[good]]
        return good


class ByteTokens:
    """Tokens of a byte-level vocabulary of the tokenizers library, with the bytes and byte offsets of each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True
        of, spec = byte_of_char(), load(path)
        vocab = {i: bytes(of[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.table = TokenTable([vocab.get(i, b"") for i in range(max(vocab) + 1)])

    def __call__(self, fragments: list[str], data: np.ndarray, starts: np.ndarray) -> Tokens:
        found = self.tokenizer.encode_batch(fragments, add_special_tokens=False)
        counts = np.fromiter((len(e.ids) for e in found), np.int64, len(found))
        n = int(counts.sum())
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.int64, n)
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found)), np.int64, 2 * n).reshape(-1, 2)
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # offsets count characters
        of = np.repeat(np.searchsorted(chars, starts), counts)
        return Tokens(ids, chars[of + spans[:, 0]], chars[of + spans[:, 1]], counts)


class PieceTokens:
    """Pieces of a sentencepiece model, with the bytes and byte offsets of each."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.table = TokenTable([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)])
        plain = [p for i, p in enumerate(pieces) if not self.model.is_byte(i)]
        inside = {p.lstrip(MARK)[i : i + 2] for p in plain for i in range(len(p) - 1)}
        if any(BEFORE in p for p in plain):
            raise ValueError("pieces with line ends aren't provided for")
        #: White space that no piece has behind another character, and pairs of a letter or digit and a mark that no piece has.
        self.begins = [c for c in " \t\n\r\v\f" if not any((MARK if c == " " else c) in p.lstrip(MARK)[1:] for p in plain)]
        self.apart = np.zeros((256, 256), bool)
        for a, b in product(np.flatnonzero(_ALNUM).tolist(), np.flatnonzero(_MARK).tolist()):
            self.apart[a, b] = chr(a) + chr(b) not in inside
        self.first = self.model.encode(BEFORE)

    def __call__(self, fragments: list[str], data: np.ndarray, starts: np.ndarray) -> Tokens:
        found = [[x for p in t.pieces for x in (p.id, p.begin, p.end)] for t in self.model.encode([BEFORE + f for f in fragments], return_type="proto", num_threads=1)]
        skip = len(self.first)
        if any(x[: 3 * skip : 3] != self.first for x in found):
            raise ValueError("a piece crosses the line end before a fragment")
        counts = np.array([len(x) // 3 - skip for x in found], np.int64)
        flat = np.fromiter(chain.from_iterable(x[3 * skip :] for x in found), np.int64, 3 * int(counts.sum())).reshape(-1, 3)
        shift = np.repeat(starts, counts) - len(BEFORE.encode())
        return Tokens(flat[:, 0], flat[:, 1] + shift, flat[:, 2] + shift, counts)


class Aligned:
    """Alignments of fragments, each worked out once while remembered."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.n_b = len(self.b.table.lengths)
        self.space = np.isin(np.arange(256), [ord(c) for c in self.b.begins])
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.met = np.zeros(0, np.int64)
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A, tokens of B, groups, and whether the bytes agree
        self.texts: list[str] = []
        self.links, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def starts_of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Offsets of fragments: where the splitting pattern ends a piece and no token of B crosses.

        That is at a mark behind a letter or digit (ASCII), and at white space behind a character that is none. What is behind has to be printable ASCII, or a character of two or four bytes from U+00C0 on, or of three from
        U+4000 on: none of these is white space to the splitting pattern, so it ends a piece there.
        """
        n = int(offsets[-1])
        i = np.flatnonzero(self.space[data[:n]])
        i = i[i >= 4]  # the first fragment of a text begins at its offset anyway
        b1, b2, b3, b4 = (data[i - k] for k in (1, 2, 3, 4))
        tail1, tail2, tail3 = (x & 0xC0 == 0x80 for x in (b1, b2, b3))
        printable = (b1 > 32) & (b1 < 127)
        two = tail1 & (b2 >= 0xC3) & (b2 < 0xE0)
        three = tail1 & tail2 & (b3 >= 0xE4) & (b3 < 0xF0)
        four = tail1 & tail2 & tail3 & (b4 >= 0xF0)
        begins = np.zeros(n, bool)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        begins[i[printable | two | three | four]] = True
        marks = np.flatnonzero(_MARK[data[:n]])
        begins[marks[self.b.apart[data[marks - 1], data[marks]]]] = True  # a text begins with a space, no mark
        return np.flatnonzero(begins)

    def _add(self, raws: list[bytes]) -> None:
        data = np.frombuffer(b"".join(raws), np.uint8)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        starts = np.cumsum(sizes) - sizes
        texts = [r.decode() for r in raws]
        both = [tokens(texts, data, starts) for tokens in (self.a, self.b)]
        good = self.a.table.agree(both[0], data, starts, sizes) & self.b.table.agree(both[1], data, starts, sizes)
        ids, ends = [], []
        for t, table in zip(both, (self.a.table, self.b.table), strict=True):
            keep = np.repeat(good, t.counts)
            t = Tokens(t.ids[keep], t.begin[keep], t.stop[keep], t.counts[good])
            ids.append(t.ids)
            ends.append(refined(t, table.lengths[t.ids], np.repeat(starts[good], t.counts)))
        cuts, i, j = np.intersect1d(*ends, assume_unique=True, return_indices=True)
        groups = np.zeros(len(raws), np.int64)
        groups[good] = np.diff(np.concatenate([[0], np.searchsorted(cuts, (starts + sizes)[good], "right")]))
        a, b = (list(map(str, x.tolist())) for x in ids)
        i1, j1 = (i + 1).tolist(), (j + 1).tolist()
        shown = [f"{','.join(a[p:q])}|{','.join(b[r:s])}" for p, q, r, s in zip([0, *i1], i1, [0, *j1], j1, strict=False)]
        stops = np.cumsum(groups).tolist()
        self.at.update(zip(raws, range(len(self.texts), len(self.texts) + len(raws)), strict=True))
        self.texts += [";".join(shown[p:q]) for p, q in zip([0, *stops], stops, strict=False)]
        self.starts = np.concatenate([self.starts, len(self.links) + np.cumsum(groups) - groups])
        self.sizes = np.concatenate([self.sizes, np.stack([both[0].counts, both[1].counts, groups, good], axis=1)])
        self.met = np.concatenate([self.met, np.zeros(len(raws), np.int64)])
        self.links = np.concatenate([self.links, ids[0][i] * self.n_b + ids[1][j]])

    def _forget(self) -> None:
        least = np.partition(self.met, -CACHE // 2)[-CACHE // 2]  # half of what there is room for stays at most
        keep = np.flatnonzero(self.met > max(1, least))
        raws = list(self.at)
        self.at = {raws[k]: i for i, k in enumerate(keep.tolist())}
        self.texts = [self.texts[k] for k in keep.tolist()]
        self.met, self.sizes = self.met[keep], self.sizes[keep]
        self.links = self.links[ragged(self.starts[keep], self.sizes[:, 2])]
        self.starts = np.cumsum(self.sizes[:, 2]) - self.sizes[:, 2]

    def look_up(self, fragments: pa.Array) -> np.ndarray:
        """Indexes into what is remembered, of distinct fragments; compared by their bytes."""
        if len(self.at) > CACHE:
            self._forget()
        raws = fragments.to_pylist()
        new = [r for r in raws if r not in self.at]
        for k in range(0, len(new), BATCH):
            self._add(new[k : k + BATCH])
        at = np.fromiter((self.at[r] for r in raws), np.int64, len(raws))
        self.met[at] += 1
        return at


@functools.lru_cache(maxsize=1)
def remembered(a_path: str, b_path: str) -> Aligned:
    """The alignments of a pair of vocabularies, kept by a Python worker from one task to the next."""
    return Aligned(a_path, b_path)


def _with_space(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of space + text of each row, end to end with 8 spare ones, and their offsets; nothing for empty texts."""
    texts = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    lengths = np.diff(offsets)
    source = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    room = lengths + (lengths > 0)
    ends = np.concatenate([[0], np.cumsum(room)])
    data = np.full(int(ends[-1]) + 8, 32, np.uint8)
    data[ragged(ends[:-1] + (lengths > 0), lengths)] = source
    return data, ends


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, groups, links.

    `a_path` is a byte-level BPE vocabulary of the tokenizers library, `b_path` a sentencepiece model, on every worker;
    special tokens' strings are plain text. A encodes a space and the text, B the text, before which it puts the space.
    `groups` has the ids of both between offsets where both end, as `a1,a2|b1;a3|b2,b3` (or, with digest, its SHA-256);
    `links` has a_id * (size of B) + b_id of every pair of tokens that end together. Texts are cut at white space that
    no token crosses; each distinct fragment is aligned once in a worker. Texts null, empty, or whose tokens don't give
    back their bytes have no tokens, '' and no links.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = remembered(a_path, b_path)
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE)):
            data, ends = _with_space(batch.column("text"))
            n = int(ends[-1])
            starts = store.starts_of(data, ends)
            fragments = pa.Array.from_buffers(
                pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, n).astype("<i8")), pa.py_buffer(data)]
            ).dictionary_encode()
            at = store.look_up(fragments.dictionary)[fragments.indices.to_numpy()] if n else np.zeros(0, np.int64)
            first = np.searchsorted(starts, ends)
            sizes = store.sizes[at]
            sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(sizes, axis=0)])
            a, b, g, agree = (sums[first[1:]] - sums[first[:-1]]).T
            good = (agree == np.diff(first)) & (np.diff(ends) > 0)
            of = np.repeat(good, np.diff(first))
            links = store.links[ragged(store.starts[at[of]], sizes[of, 2])]
            lengths = np.where(good, g, 0)
            shown, order = [], at.tolist()
            for i in range(len(good)):
                text = ";".join([t for k in order[first[i] : first[i + 1]] if (t := store.texts[k])]) if good[i] else ""
                shown.append(hashlib.sha256(text.encode()).hexdigest() if digest and text else text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.where(good, a, 0)), pa.array(np.where(good, b, 0)), pa.array(shown, pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(links)),
                ],
                ["doc_id", "n_a", "n_b", "groups", "links"],
            )

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"{id_col} AS doc_id", f"{text_col} AS text").mapInArrow(run, f"doc_id {kind}, n_a bigint, n_b bigint, groups string, links array<bigint>")


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """pair, a_id, b_id, count and best (the count is its b_id's highest) of the links of all rows.

    Of two tokens that end together, one's bytes are the end of the other's. So the pairs are bounded by the two
    vocabularies whatever the corpus (each token has at most as many as it has bytes that are tokens of the other, some
    hundreds of thousands in all), and so is what is counted, grouped or broadcast here.
    """
    counts = aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    named = counts.selectExpr("pair", f"cast(pair DIV {b_size} AS int) AS a_id", f"cast(pair % {b_size} AS int) AS b_id", "count")
    most = named.groupBy("b_id").agg(F.max("count").alias("most"))
    return named.join(most, "b_id").selectExpr("pair", "a_id", "b_id", "count", "count = most AS best")


def cross_tokenizer(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens are aligned once and written with their links; the links' counts over the corpus, bounded by the
    vocabularies, go to every task. n_best counts links of the highest count of their B id, ties included; count_sum
    adds up the links' counts. A null or empty text, and one whose bytes the tokens don't give back, has zeros and ''.
    Texts of any length are aligned whole in their row; rows that repeat a text count each; an empty table gives no
    rows; other columns, whatever their names, aren't read.
    """
    from sentencepiece import SentencePieceProcessor

    spark = docs.sparkSession
    size = SentencePieceProcessor(model_file=b_path).vocab_size()
    aligned = written(align_tokens(docs, a_path, b_path, id_col, text_col, digest=True), "aligned")
    table = pair_counts(aligned, size).select("pair", "count", "best").toPandas().sort_values("pair")
    shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "count", "best")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = shared.value
        for batch in batches:
            links = batch.column("links")
            at = np.searchsorted(pairs, links.flatten().to_numpy())
            ends = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(x[at].astype(np.int64))]) for x in (best, counts)]
            n_best, total = (pa.array(x[ends[1:]] - x[ends[:-1]]) for x in sums)
            n = pa.array(np.diff(ends))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_a"), batch.column("n_b"), n, n, n_best, total, batch.column("groups")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return aligned.mapInArrow(run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
