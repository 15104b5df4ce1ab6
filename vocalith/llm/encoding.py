"""Texts into the token ids of a public byte-level BPE."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Where the vocabulary files lie; never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the published pattern that splits text before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries after which a worker's cache starts anew, and the longest word it keeps.
CACHED, CACHED_LENGTH = 400_000, 200
_NONE = 1 << 62


def _letters() -> dict[int, str]:
    """The published rule by which each byte is written as a letter: printable bytes as themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """Merges of one vocabulary file, applied through a segment tree over the ranks of adjacent pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        letter = _letters()
        self.base = [vocab[letter[b]] for b in range(256)]
        self.width = len(vocab)
        self.merges: dict[int, tuple[int, int]] = {}
        byte = {v: k for k, v in letter.items()}
        #: Byte pairs that stand inside some token; no token reaches over any other pair, so words are cut there first.
        self.inner: set[tuple[int, int]] = set()
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[left] * self.width + vocab[right], (rank, vocab[left + right]))
            whole = [byte[c] for c in left + right]
            self.inner.update(zip(whole, whole[1:]))
        self.pieces: dict[bytes, array] = {}
        self.words: dict[str, array] = {}
        self.split: Callable[[str], list[str]] = regex.compile(PATTERN).findall

    def merge(self, raw: bytes) -> array:
        """Ids of one piece. The root of the tree is the leftmost pair of the lowest rank; a merge updates three leaves."""
        ids = [self.base[b] for b in raw]
        n = len(ids)
        if n < 2:
            return array("i", ids)
        merges, width = self.merges, self.width
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            got = merges.get(ids[i] * width + ids[i + 1])
            if got:
                tree[size + i] = got[0] * n + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low
                i >>= 1

        while tree[1] != _NONE:
            i = tree[1] % n
            j = after[i]
            ids[i] = merges[ids[i] * width + ids[j]][1]
            k = after[i] = after[j]
            ids[j] = -1
            if j < n - 1:
                put(j, _NONE)
            if k < n:
                before[k] = i
            got = merges.get(ids[i] * width + ids[k]) if k < n else None
            put(i, got[0] * n + i if got else _NONE)
            h = before[i]
            if h >= 0:
                got = merges.get(ids[h] * width + ids[i])
                put(h, got[0] * n + h if got else _NONE)
        return array("i", [x for x in ids if x >= 0])

    def word(self, word: str) -> array:
        raw, inner, out, start = word.encode(), self.inner, array("i"), 0
        for i in range(1, len(raw) + 1):
            if i == len(raw) or (raw[i - 1], raw[i]) not in inner:
                piece = raw[start:i]
                ids = self.pieces.get(piece)
                if ids is None:
                    ids = self.merge(piece)
                    if len(piece) <= CACHED_LENGTH:
                        if len(self.pieces) >= CACHED:
                            self.pieces.clear()
                        self.pieces[piece] = ids
                out += ids
                start = i
        if len(word) <= CACHED_LENGTH:
            if len(self.words) >= CACHED:
                self.words.clear()
            self.words[word] = out
        return out

    def encode(self, text: str, into: array) -> None:
        """Appends the ids of ``text``; the strings of special tokens are ordinary text."""
        words = self.words
        for w in self.split(text):
            ids = words.get(w)
            into += self.word(w) if ids is None else ids


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids ARRAY<INT>) of each row, without special tokens; an empty array for an empty and for a null text.

    Row by row over Arrow batches, without a shuffle: equal rows give equal rows. The vocabulary file must lie at the
    same path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            # Parts of a batch keep the ids held at once small, however long the texts.
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                ids, ends = array("i"), [0]
                for text in part.column(1).to_pylist():
                    if text:
                        bpe.encode(text, ids)
                    ends.append(len(ids))
                flat = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], [id_col, "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
