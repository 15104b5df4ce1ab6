"""Held-out items that stand, whole or in part, in a corpus.

Every document's tokens (words, or characters of Han and kana), without marks and fillers, are scanned for windows of four tokens that stand in an
item too (a broadcast hash set, numpy over whole batches); documents with hits are then read word by word and each item's passage is verified
by alignment. A passage of at least eight words with one in ten changed, and any unchanged one of four, leaves a window of four, so none is lost to the scan.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import re
from functools import lru_cache
from pyspark.sql import DataFrame, functions as F

from . import marks

#: Tokens in a window.
WORDS = 4
#: Items a block of the broadcast set holds at most, and their characters.
BLOCK_ITEMS, BLOCK_CHARS = 2_000, 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
# Han and kana, character by character.
_SINGLE = r"[\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\U00020000-\U000323AF\u3005]"
_TOKEN = re.compile(rf"{_SINGLE}|(?:(?!{_SINGLE})[^\W_])+")


def _is_cjk(c: int) -> bool:
    return 0x3040 <= c < 0x3100 or 0x3400 <= c < 0xA000 or 0xF900 <= c < 0xFB00 or 0x20000 <= c < 0x323B0 or c == 0x3005


# Classes of characters: outside tokens, in a word, a token of its own, the end of a text.
_OUT, _IN, _ALONE, _END = range(4)


@lru_cache(maxsize=1)
def _chars() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point its class, its letter in lower case and plain width, whether it is a digit, and whether that letter depends on more than itself."""
    kind, fold = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint64)
    digit, odd = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for c in range(0x110000):
        ch = chr(c)
        if _is_cjk(c):
            kind[c] = _ALONE
        elif ch.isalnum():
            kind[c] = _IN
        else:
            continue
        digit[c] = ch.isdecimal()
        plain = unicodedata.normalize("NFKC", ch).casefold()
        if len(plain) == 1:
            fold[c] = ord(plain)
        else:
            odd[c] = True
    # Jamo and kana of half width join with their neighbours.
    for a, b in ((0x1100, 0x1200), (0x3130, 0x3190), (0xA960, 0xA980), (0xD7B0, 0xD800), (0xFF65, 0xFFDD)):
        odd[a:b] |= kind[a:b] > _OUT
    kind[1] = _END
    return kind, fold, digit, odd


_POWERS = np.cumprod(np.full(4096, _P | np.uint64(1)))


def _windows(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place in ``text``) of each window of ``WORDS`` tokens, by the rules of ``tokens``, and where the tokens start and end before numbers are parted; texts are parted by U+0001."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, folds, digits, _ = _chars()
    kind = kinds[codes]
    at = np.flatnonzero(kind)
    if not len(at):
        return np.empty(0, np.uint64), at, at, at
    kind, code, digit = kind[at], folds[codes[at]], digits[codes[at]]
    fresh = np.r_[True, (np.diff(at) > 1) | (kind[1:] != _IN) | (kind[:-1] != _IN)]
    start = np.flatnonzero(fresh)
    size = np.diff(np.r_[start, len(at)])
    begins, stops = at[start], at[start + size - 1] + 1
    # In Han and kana the digits of a number are characters like the others.
    alone = np.r_[False, kind[start] == _ALONE, False]
    number = (np.add.reduceat(digit.astype(np.int64), start) == size) & (size > 1) & (alone[:-2] | alone[2:])
    if number.any():
        fresh |= np.repeat(number, size)
        start = np.flatnonzero(fresh)
        size = np.diff(np.r_[start, len(at)])
    within = np.arange(len(at)) - np.repeat(start, size)
    mixed = (code + np.uint64(1)) * _P
    mixed ^= mixed >> np.uint64(29)
    word = np.add.reduceat(mixed * _POWERS[within & 4095], start)
    word ^= word >> np.uint64(32)
    n = len(word) - WORDS + 1
    if n < 1:
        return np.empty(0, np.uint64), at[:0], begins, stops
    window = word[:n].copy()
    for k in range(1, WORDS):
        window = window * (_P + np.uint64(2 * k)) + word[k : k + n]
        window ^= window >> np.uint64(31)
    return window, at[start[:n]], begins, stops


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(31))) * _P) >> np.uint64(42)


def _bare(text: str) -> str:
    return marks.without_fillers(marks.blanked(text))


def tokens(text: str) -> tuple[list[str], list[int]]:
    """Words (characters of Han and kana) in lower case and plain width without marks and fillers, and where each starts."""
    return _tokens(_bare(text))


def _tokens(bare: str, low: int = 0, high: int | None = None) -> tuple[list[str], list[int]]:
    words, places = [], []
    for m in _TOKEN.finditer(bare, low, len(bare) if high is None else high):
        word = m[0]
        words.append(word if word.isascii() and word.islower() else unicodedata.normalize("NFKC", word).casefold())
        places.append(m.start())
    # In Han and kana the digits of a number are characters like the others.
    if any(w.isdecimal() and len(w) > 1 for w in words):
        single = [_is_cjk(ord(w[0])) for w in words]
        cut = [w.isdecimal() and len(w) > 1 and (i and single[i - 1] or i + 1 < len(words) and single[i + 1]) for i, w in enumerate(words)]
        places = [p + k for w, p, c in zip(words, places, cut) for k in (range(len(w)) if c else (0,))]
        words = [x for w, c in zip(words, cut) for x in (w if c else (w,))]
    return words, places


class _HashSet:
    """A set of hashes: a table of bits for the first look, the sorted hashes for the second."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        self.sorted, index = np.unique(hashes, return_inverse=True)
        #: The greatest weight of equal hashes.
        self.weights = np.zeros(len(self.sorted))
        np.maximum.at(self.weights, index, weights)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[_slot(self.sorted)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are in the set, and their weights."""
        at = np.flatnonzero(self.bits[_slot(hashes)])
        if not len(self.sorted):
            return at[:0], self.weights
        near = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        same = self.sorted[near] == hashes[at]
        return at[same], self.weights[near[same]]


def _need(n: int, part: float, changed: float) -> int:
    """Even with the most changes spread most evenly, so many windows of an item of ``n`` words stay in its least passage."""
    return max(1, int(part * n * (1 - changed * (WORDS + 1))) - WORDS)


class Items:
    """The held-out items, their windows of tokens and the set of the windows' hashes."""

    def __init__(self, items: list[tuple[int, str]], part: float = 0.5, changed: float = 0.1):
        self.words = {i: tokens(t)[0] for i, t in items}
        self.at: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for i, words in self.words.items():
            for k in range(len(words) - WORDS + 1):
                self.at[tuple(words[k : k + WORDS])].append((i, k))
        # An item's words parted by spaces are hashed as they would be in a text; digits among Han and kana are parted already.
        lines = "\x01".join(" ".join(w) for w in self.at)
        begin = np.r_[0, np.flatnonzero(np.frombuffer(lines.encode("utf-32-le", "surrogatepass"), np.uint32) == 1) + 1]
        hashes, at, _, _ = _windows(lines)
        own = np.isin(at, begin)
        # Hits weigh so much that any passage's weigh 1 together at least.
        weights = np.array([max(1 / _need(len(self.words[i]), part, changed) for i, _ in where) for where in self.at.values()])
        self.known = _HashSet(hashes[own], weights[np.searchsorted(begin, at[own])] if own.any() else np.empty(0))

    def candidates(self, bare: list[str]) -> list[tuple[int, int, int]]:
        """(text, first, end) of the texts that hold as many windows of an item as any passage of it leaves; whole texts are scanned. All windows that are an item's lie from first to end.

        Texts with letters that fold to several, or together with their neighbours, are always among them, from end to end.
        """
        plain = [t.replace("\x01", " ").replace("ß", "ss") for t in bare]
        whole = "\x01".join(plain)
        hashes, at, begins, stops = _windows(whole)
        odd = np.flatnonzero(_chars()[3][np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)])
        ends = np.cumsum([len(t) + 1 for t in plain])
        hit, weight = self.known.places(hashes)
        own = np.searchsorted(ends, at[hit], "right")
        total = np.bincount(own, weight, len(bare))
        entire = np.zeros(len(bare), bool)
        entire[np.searchsorted(ends, odd, "right")] = True
        # Two tokens more at each side, on which it depends whether a number is parted.
        low = np.maximum(np.searchsorted(begins, at[hit], "right") - 3, 0)
        high = np.minimum(np.searchsorted(begins, at[np.minimum(hit + WORDS - 1, len(at) - 1)], "right") + WORDS + 1, len(begins) - 1)
        out = []
        for d in np.flatnonzero(entire | (total > 1 - 1e-6)).tolist():
            # Where a letter was written as two the places are not those of the text.
            if entire[d] or len(plain[d]) != len(bare[d]):
                out.append((d, 0, len(bare[d])))
            else:
                a, b = np.searchsorted(own, [d, d + 1])
                shift = int(ends[d]) - len(plain[d]) - 1
                out.append((d, max(0, int(begins[low[a]]) - shift), min(len(bare[d]), int(stops[high[b - 1]]) - shift)))
        return out


#: What a changed word costs against a matching one: passages are chained with up to one word in about four changed, then measured.
COST = 3
#: Words between two equal runs of one passage, at most.
GAP = 24


def _distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two short lists."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        left, diagonal = i + 1, row[0]
        row[0] = left
        for j, y in enumerate(b):
            left = min(diagonal + (x != y), row[j + 1] + 1, left + 1)
            diagonal, row[j + 1] = row[j + 1], left
    return row[-1]


def passage(item: list[str], text: list[str], hits: list[tuple[int, int]]) -> tuple[int, int, int, int, int]:
    """The best alignment of an item with a text (item from, item to, text from, text to, changes).

    ``hits`` are the places (text, item) of common n-grams. Hits in a row form equal runs; runs are chained in the order of both, the words
    between two costing their edit distance. What lies beyond a changed word and is shorter than an n-gram would not raise the score.
    """
    runs: list[list[int]] = []  # text from, item from, length
    open_runs: dict[int, list[int]] = {}
    for k, j in hits:
        run = open_runs.get(k - j)
        if run and k < run[0] + run[2]:
            run[2] = k + WORDS - run[0]
        else:
            run = open_runs[k - j] = [k, j, WORDS]
            runs.append(run)
    best: list[tuple[int, int, int, int]] = []  # score, changes, text from, item from
    for i, (k, j, size) in enumerate(runs):
        top = (size, 0, k, j)
        for h in range(i - 1, -1, -1):
            k0, j0, n0 = runs[h]
            # Where two runs overlap in the text or the item, the second starts later.
            late = max(0, k0 + n0 - k, j0 + n0 - j)
            a, b = k + late - k0 - n0, j + late - j0 - n0
            if late >= size or max(a, b) > GAP or best[h][0] + size - late - COST * abs(a - b) <= top[0]:
                continue
            changes = _distance(item[j0 + n0 : j + late], text[k0 + n0 : k + late])
            same = max(a, b) - changes
            score = best[h][0] + size - late + max(0, same) - COST * changes
            if score > top[0]:
                top = (score, best[h][1] + changes, best[h][2], best[h][3])
        best.append(top)
    i = max(range(len(best)), key=lambda x: best[x][0])
    _, changes, k, j = best[i]
    return j, runs[i][1] + runs[i][2], k, runs[i][0] + runs[i][2], changes


def _stretches(found: list[tuple[int, int]], apart: int) -> Iterator[list[tuple[int, int]]]:
    """Hits cut where the text between two of them is longer than ``apart`` tokens."""
    some = [found[0]]
    for hit in found[1:]:
        if hit[0] - some[-1][0] > apart:
            yield some
            some = []
        some.append(hit)
    yield some


def find(text: str, items: Items, part: float = 0.5, changed: float = 0.1) -> list[tuple[int, int, int, float, float]]:
    """(item, first character, end character, share of the item's words, share of changed words) of each passage in a text; an item may have several."""
    return _found(*tokens(text), items, part, changed)


def _found(words: list[str], places: list[int], items: Items, part: float, changed: float) -> list[tuple[int, int, int, float, float]]:
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k in range(len(words) - WORDS + 1):
        for i, j in items.at.get(tuple(words[k : k + WORDS]), ()):
            hits[i].append((k, j))
    out = []
    for i, found in hits.items():
        item = items.words[i]
        n = len(item)
        need = _need(n, part, changed)
        if len(found) < need:
            continue
        rest = [found]
        while rest:
            for stretch in _stretches(rest.pop(), n // 2 + 8):
                if len({j for _, j in stretch}) < need:
                    continue
                a, b, c, d, edits = passage(item, words, stretch)
                share, rate = (b - a) / n, edits / max(1, b - a)
                if share >= part and rate <= changed:
                    out.append((i, places[c], places[d - 1] + len(words[d - 1]), share, rate))
                # Before and after it the item may stand again.
                rest += [side for side in ([h for h in stretch if h[0] + WORDS <= c], [h for h in stretch if h[0] >= d]) if side]
    return sorted(out)


_SCHEMA = "doc_id long, item_id long, start_char long, end_char long, share double, changed double"


def leaked(documents: DataFrame, items: DataFrame, part: float = 0.5, changed: float = 0.1) -> DataFrame:
    """(doc_id, item_id, start_char, end_char, share, changed): passages of a document in which at least ``part`` of an item stands; a pair has a row a passage.

    Case, width, spacing, punctuation, marks and fillers do not count; at most ``changed`` of the passage's words differ. Null and
    empty texts are in no pair, nor are items of fewer than 4 words (characters), which are single phrases; repeated items count once, and an item's pairs do not depend on the others. Items are broadcast in blocks of at most
    ``BLOCK_ITEMS`` items, each block against all documents, so what is broadcast does not grow with the items' number.
    """
    spark = documents.sparkSession
    stated = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    n, chars = stated.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    out = None
    for k in range(blocks):
        rows = stated.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in rows], part, changed))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                for part_ in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                    ids, texts = part_.column(0).to_pylist(), [t or "" for t in part_.column(1).to_pylist()]
                    bare = [_bare(t) for t in texts]
                    found = [(ids[d], *row) for d, low, high in known.candidates(bare) for row in _found(*_tokens(bare[d], low, high), known, part, changed)]
                    cols = list(zip(*found)) or [[]] * 6
                    kinds = [pa.int64()] * 4 + [pa.float64()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "start_char", "end_char", "share", "changed"])

        some = documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, _SCHEMA)
        out = some if out is None else out.unionByName(some)
    return out


def without_leaks(documents: DataFrame, found: DataFrame, whole: bool = False) -> DataFrame:
    """The documents without the leaked spans, or (``whole``) without the documents that hold any. All other columns stay.

    A document's spans are few (one a passage); they are cut from the last to the first, overlapping ones together.
    """
    if whole:
        return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(F.col("start_char").alias("s"), F.col("end_char").alias("e")))).alias("__spans"))
    joined = documents.join(spans, "doc_id", "left")
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("kept"))
    kept = F.aggregate(
        "__spans", begin,
        lambda a, x: F.struct(
            F.greatest(a["at"], x["e"]).alias("at"),
            F.concat(a["kept"], F.when(x["s"] > a["at"], F.substring("text", a["at"].cast("int") + 1, (x["s"] - a["at"]).cast("int"))).otherwise(F.lit(""))).alias("kept"),
        ),
        lambda a: F.concat(a["kept"], F.substring(F.col("text"), a["at"].cast("int") + 1, F.length("text"))),
    )
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(kept)).drop("__spans")
