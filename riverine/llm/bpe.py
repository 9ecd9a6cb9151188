"""BPE encoding by fragments that certain cuts separate, and decoding."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from riverine.llm.shared import small_batches
from riverine.llm.textblocks import SPACE, WORD, Block, Words, block, hashes, ragged, segments, slices

#: Fragments whose ids a Python worker remembers; beyond it, those met once are forgotten.
CACHE = 200_000
#: Fragments given to the library at a time.
BATCH = 10_000
#: Bytes of text encoded at a time.
SLICE = 2 << 20

_CODES = np.arange(256)
_ALNUM = ((_CODES >= 48) & (_CODES < 58)) | ((_CODES >= 65) & (_CODES < 91)) | ((_CODES >= 97) & (_CODES < 123))
_MARK = (_CODES > 32) & (_CODES < 127) & ~_ALNUM


def byte_of_char() -> dict[str, int]:
    """The alphabet of byte-level vocabularies: printable Latin-1 stands for itself, other bytes for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def pattern_ends() -> np.ndarray:
    """Pairs of bytes between which the splitting pattern always ends a piece, whatever stands around them.

    No alternative of the pattern goes on from a printable ASCII character to ASCII white space, or from an ASCII
    letter or digit to an ASCII mark, and none looks back; so what follows is split as if the text began there.
    """
    can = np.zeros((256, 256), bool)
    can[33:127, SPACE] = True
    can[np.ix_(_ALNUM, _MARK)] = True
    return can


def forced_cuts(spec: dict) -> np.ndarray:
    """A table [a, b]: True if a cut between bytes a and b of any text is certain.

    No token of the vocabulary has the pair inside it, so no merge crosses it, and the pattern ends a piece there.
    """
    of = byte_of_char()
    inside = np.zeros((256, 256), bool)
    for token in spec["model"]["vocab"]:
        t = [of[c] for c in token]
        inside[t[:-1], t[1:]] = True
    return pattern_ends() & ~inside & ~special_pairs(spec)


def special_pairs(spec: dict) -> np.ndarray:
    """Pairs of bytes inside special tokens."""
    inside = np.zeros((256, 256), bool)
    for token in spec["added_tokens"]:
        t = list(token["content"].encode())
        inside[t[:-1], t[1:]] = True
    return inside


class Fragments:
    """Ids of fragments by their hashes, each encoded once while remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.hash, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known: dict[int, int] = {}

    def _forget(self) -> None:
        least = np.partition(self.met, -CACHE // 2)[-CACHE // 2]  # half of what there is room for stays at most
        keep = self.met > max(1, least)
        self.flat = self.flat[ragged(self.starts[keep], self.lengths[keep])]
        self.hash, self.met, self.lengths = self.hash[keep], self.met[keep], self.lengths[keep]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.known = dict(zip(self.hash.tolist(), range(len(self.hash)), strict=True))

    def look_up(self, b: Block, w: Words) -> np.ndarray:
        """An index into starts and lengths for every fragment, valid until the next call."""
        if len(self.known) > CACHE:
            self._forget()
        codes, unique = pd.factorize(hashes(b, w))
        first = np.zeros(len(unique), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        at = np.fromiter((self.known.get(h, -1) for h in unique.tolist()), np.int64, len(unique))
        new = np.flatnonzero(at < 0)
        raw = b.data.tobytes() if len(new) else b""
        for i in range(0, len(new), BATCH):
            part = new[i : i + BATCH]
            s = w.starts[first[part]]
            texts = [raw[j:k].decode() for j, k in zip(s.tolist(), (s + w.lengths[first[part]]).tolist(), strict=True)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            base = len(self.hash)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))])
            self.hash = np.concatenate([self.hash, unique[part]])
            at[part] = base + np.arange(len(part))
        if len(new):
            self.known.update(zip(unique[new].tolist(), at[new].tolist(), strict=True))
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        if len(unique):
            self.met[at] += np.bincount(codes)
        return at[codes]

    def ids(self, at: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.starts[at], self.lengths[at])]


@functools.lru_cache(maxsize=2)
def remembered(path: str) -> Fragments:
    """The fragments of a vocabulary, kept by a Python worker from one task to the next."""
    return Fragments(path)


class TokenBytes:
    """The bytes that every id of a byte-level vocabulary stands for."""

    def __init__(self, spec: dict):
        of = byte_of_char()
        vocab = {i: bytes(of[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        vocab |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        each = [vocab.get(i, b"") for i in range(max(vocab) + 1)]
        self.flat = np.frombuffer(b"".join(each), np.uint8)
        self.lengths = np.array([len(x) for x in each])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All bytes, and where those of each id begin and end."""
        n = self.lengths[ids]
        return self.flat[ragged(self.starts[ids], n)].tobytes(), np.concatenate([[0], np.cumsum(n)])


def fragments(b: Block, cuts: np.ndarray) -> Words:
    """Every byte of the block, cut where cuts has the pair of neighbours."""
    n = int(b.offsets[-1])
    begins = np.zeros(n, bool)
    if n:
        begins[1:] = cuts[b.data[: n - 1], b.data[1:n]]
    return segments(b, begins, np.ones(n, bool))


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    `path` is a byte-level BPE vocabulary of the tokenizers library, on every worker. Texts are cut at forced
    boundaries, each distinct fragment is encoded and decoded once, and the ids are laid end to end; they equal the
    library's own over the whole text. Fragments are told apart by 64-bit hashes: among the CACHE that a worker remembers, the chance
    that a new one is taken for another is 1e-14. A null text counts as empty (0 tokens); a text without a certain cut is one
    fragment; repeated rows are encoded each; an empty table gives no rows; other columns aren't read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = load(path)
        cuts, store, table = forced_cuts(spec), remembered(path), TokenBytes(spec)
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE)):
            b = block(batch.column("text"))
            w = fragments(b, cuts)
            at = store.look_up(b, w)
            ends = np.concatenate([[0], np.cumsum(store.lengths[at])])[w.first]
            ids = store.ids(at).astype("<u4")
            text, places = table.decode(ids)
            spans = places[ends]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()),
                    pa.array([hashlib.sha256(ids[i:j].tobytes()).hexdigest() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.string()),
                    pa.array([hashlib.sha256(text[i:j].decode("utf-8", "replace").encode()).hexdigest() for i, j in zip(spans[:-1], spans[1:], strict=True)], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"{id_col} AS doc_id", f"{text_col} AS text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


class WordIds:
    """Ids of whole texts under a lower-casing vocabulary that drops white space, fragment by fragment.

    The splitting pattern and the mark of a word's end make pieces independent of each other, so its ends are cuts.
    """

    def __init__(self, path: str):
        spec = load(path)
        self.cuts = pattern_ends() & ~special_pairs(spec)
        self.special = spec["added_tokens"][0]["content"][:2].encode() if spec["added_tokens"] else b""
        self.store = remembered(path)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin and end."""
        b = block(column)
        if not self.special or self.special not in b.data.tobytes():  # special tokens are told by their case
            b = block(column, lower=True)
        n = int(b.offsets[-1])
        begins = np.zeros(n, bool)
        if n:
            begins[1:] = self.cuts[b.data[: n - 1], b.data[1:n]]
        w = segments(b, begins, WORD[b.data[:n]])
        at = self.store.look_up(b, w)
        return self.store.ids(at), np.concatenate([[0], np.cumsum(self.store.lengths[at])])[w.first]
