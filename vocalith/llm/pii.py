"""Personal data in free text: a linear-chain conditional random field over word shapes, decoded by Viterbi in numpy batches.

Texts of a batch are joined and cut into tokens (words, digit runs, single characters of CJK scripts and punctuation) by
array operations alone; each token has hashed features of itself and its neighbours; sentences of like length are decoded
together. The field is trained on the labelled table of ``pii_labelled`` when first needed, and its weights are kept in the shared folder.
"""

from __future__ import annotations

import hashlib
import inspect
import io
import re
import sys
import uuid
import warnings
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import pii_labelled as table

KINDS = ["name", "email", "phone", "id_number", "address"]
#: 0 is outside; 2k+1 begins and 2k+2 continues a piece of kind k.
LABELS = 2 * len(KINDS) + 1
BUCKETS = 1 << 17
#: How often the labelled table is multiplied, and passes over it.
TIMES, PASSES = 24, 8
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
# Classes of characters.
SPACE, LOWER, UPPER, OTHER, DIGIT, HAN, HIRAGANA, KATAKANA, HANGUL, BREAK, MARK = range(11)


@lru_cache(maxsize=1)
def _chars() -> tuple[np.ndarray, np.ndarray]:
    """Class and folded code of each code point."""
    kind, fold = np.full(0x110000, MARK, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x30000):
        ch = chr(c)
        if ch in "\n\r\x0b\x0c\x85  ":
            kind[c] = BREAK
        elif ch.isspace() or c < 32:
            kind[c] = SPACE
        elif ch.isdecimal():
            kind[c], fold[c] = DIGIT, 48
        elif 0x3041 <= c < 0x30A0:
            kind[c] = HIRAGANA
        elif 0x30A0 <= c < 0x3100:
            kind[c] = KATAKANA
        elif 0xAC00 <= c < 0xD7B0:
            kind[c] = HANGUL
        elif 0x3400 <= c < 0xA000 or 0xF900 <= c < 0xFB00 or c >= 0x20000 or c == 0x3005:
            kind[c] = HAN
        elif ch.isupper():
            kind[c], fold[c] = UPPER, ord(ch.lower()[0])
        elif ch.islower():
            kind[c] = LOWER
        elif ch.isalpha() or 0x300 <= c < 0x370:
            kind[c] = OTHER
    kind[0x30000:0x32400] = HAN
    return kind, fold


def _hash_word(word: str) -> int:
    """The hash ``_Tokens`` gives to a word."""
    fold = _chars()[1]
    return sum(int(fold[ord(c)]) * pow(_P, i, 1 << 64) for i, c in enumerate(word)) % (1 << 64)


_NUMBER_WORDS = np.array(sorted({_hash_word(w) for ws in table.DIGIT_WORDS.values() for w in ws.split()} | {_hash_word(c) for c in "〇零一二三四五六七八九공일이삼사오육칠팔구"}), np.uint64)
_JOINERS = np.array(sorted(_hash_word(c) for c in "+()-.－/（）＋"), np.uint64)
_DOTS = np.array(sorted(_hash_word(c) for c in ".。！？!?"), np.uint64)
_STOPS = np.array(sorted(_hash_word(c) for c in "。！？!?"), np.uint64)
_CLOSERS = np.array(sorted(_hash_word(c) for c in ")]}>\"'*"), np.uint64)
_HOST = r"[A-Za-z0-9-]+"
_EMAIL = re.compile(
    rf"[A-Za-z0-9][A-Za-z0-9._+'-]*(?: (?:dot|underscore|plus|dash) [A-Za-z0-9._+-]+)*(?:\s?[@＠]\s?{_HOST}(?:\.{_HOST})+|\s?\[at\]\s?{_HOST}(?:\s?\[dot\]\s?{_HOST})+| at {_HOST}(?: dot {_HOST})+)"
)


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


_KEPT: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier of hashes and of its inverse; kept from batch to batch."""
    if not _KEPT or len(_KEPT[0][0]) < n:
        made = []
        for x in (_P, _INV):
            powers = np.full(max(n, 1 << 19), x, np.uint64)
            powers[0] = 1
            made.append(np.cumprod(powers))
        _KEPT[:] = [tuple(made)]
    return _KEPT[0][0][:n], _KEPT[0][1][:n]


class Tokens:
    """Tokens of joined texts: where each starts and ends, its hash, shape and sentence."""

    def __init__(self, texts: list[str]):
        # A line feed ends each text, so that no sentence goes over into the next.
        whole = "\n".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes, folds = _chars()
        kind, code = classes[codes], folds[codes].astype(np.uint64)
        self.text = whole
        group = np.array([0, 1, 1, 1, 2, 3, 4, 5, 6, 0, 7], np.uint8)[kind]
        inside = group > 0
        fresh = inside.copy()
        fresh[1:] &= (group[1:] != group[:-1]) | (group[1:] > 2)
        start = np.flatnonzero(fresh)
        last = inside.copy()
        last[:-1] &= (group[1:] != group[:-1]) | (group[:-1] > 2)
        end = np.flatnonzero(last) + 1
        self.start, self.end, n = start, end, len(start)
        size = end - start
        with np.errstate(over="ignore"):
            power, inverse = _powers(len(codes))
            total = np.r_[np.uint64(0), np.cumsum(code * power, dtype=np.uint64)]
            self.word = (total[end] - total[start]) * inverse[start] if n else np.empty(0, np.uint64)
        first = kind[start] if n else kind[:0]
        uppers = np.r_[0, np.cumsum(kind == UPPER)]
        upper = uppers[end] - uppers[start]
        shape = np.where(first == LOWER, np.where(upper > 0, 5, 1), np.where(first == UPPER, np.where(upper == size, np.where(size == 1, 4, 3), np.where(upper > 1, 5, 2)), 6))
        zero = (codes[start] == 48).astype(np.int64) + ((size > 1) & (codes[np.minimum(start + 1, max(0, len(codes) - 1))] == 48) & (codes[start] == 48)) if n else np.empty(0, np.int64)
        shape = np.where(first == DIGIT, 10 + np.minimum(size, 19) + 20 * zero, shape)
        shape = np.where((first >= HAN) & (first <= HANGUL), 80 + first, shape)
        shape = np.where(first == MARK, 100 + (self.word % np.uint64(499)).astype(np.int64), shape) if n else shape
        self.number = _within(self.word, _NUMBER_WORDS) if n else np.empty(0, bool)
        shape = np.where(self.number & (first != DIGIT), 7 + 90 * (first >= HAN), shape)
        self.shape = shape.astype(np.uint64)
        self.space = np.r_[True, start[1:] > end[:-1]] if n else np.empty(0, bool)
        # Sentences end at a line feed, at a stop, and at a point before a space after a number or a word that is no initial or short form.
        feeds = np.r_[0, np.cumsum(kind == BREAK)]
        cut = np.zeros(n, bool)
        if n:
            cut[0] = True
            cut[1:] = feeds[start[1:]] > feeds[start[:-1]]
            cut[1:] |= _within(self.word[:-1], _STOPS)
            point = _within(self.word[:-1], _DOTS) & self.space[1:]
            point[1:] &= (first[:-2] == DIGIT) | _within(self.word[:-2], _CLOSERS) | ((first[:-2] == LOWER) & (size[:-2] >= 2)) | ((first[:-2] == UPPER) & (size[:-2] >= 4))
            cut[1:] |= point
        self.sentence = np.cumsum(cut) - 1
        self.first = np.flatnonzero(cut)
        self.digit = first == DIGIT
        self.size = size

    def features(self) -> list[np.ndarray]:
        """Bucket of each token, for each template."""
        n, w, s = len(self.start), self.word, self.shape
        if not n:
            return []
        with np.errstate(over="ignore"):
            s = s * np.uint64(2) + self.space
            same = {k: (self.sentence[k:] == self.sentence[:-k]) if n > k else np.empty(0, bool) for k in (1, 2, 3)}

            def at(values: np.ndarray, by: int) -> np.ndarray:
                """Values of the token ``by`` further, 0 outside the sentence."""
                out = np.zeros(n, np.uint64)
                k = abs(by)
                if n > k:
                    if by > 0:
                        np.multiply(values[k:], same[k], out=out[:-k])
                    else:
                        np.multiply(values[:-k], same[k], out=out[k:])
                return out

            p1w, n1w, p2w, n2w = at(w, -1), at(w, 1), at(w, -2), at(w, 2)
            p1s, n1s, p2s, n2s = at(s, -1), at(s, 1), at(s, -2), at(s, 2)
            chunk, email = self._numbers(), self._emails()
            begins = np.ones(n, np.uint64)
            begins[1:] -= same[1]
            mixed = [
                s * np.uint64(2) + begins, w, p1w, n1w, p2w, n2w, at(w, -3), _mix(_mix(p1s, s), n1s), _mix(_mix(s, n1s), n2s), _mix(_mix(p2s, p1s), s), _mix(p1w, s), _mix(n1w, s),
                _mix(p2w, p1w), _mix(n1w, n2w), _mix(chunk, s), email, _mix(p1w, n1w),
            ]
            return [((x * np.uint64(_P + 2 * i) + np.uint64(_INV >> i)) >> np.uint64(64 - 17)).view(np.int64) for i, x in enumerate(mixed)]

    def _numbers(self) -> np.ndarray:
        """Of a token in a run of digits, digit words and their joiners: the run's digits (up to 19) and whether it begins the run; else 0."""
        n = len(self.start)
        part = self.digit | self.number | _within(self.word, _JOINERS) if n else np.empty(0, bool)
        if not part.any():
            return np.zeros(n, np.uint64)
        begin = part.copy()
        begin[1:] &= ~part[:-1] | (self.sentence[1:] != self.sentence[:-1])
        run = np.cumsum(begin)
        count = np.bincount(run[part], np.where(self.digit, self.size, self.number)[part], minlength=run[-1] + 1)
        return np.where(part, (1 + np.minimum(count[run], 19)) * 2 + begin, 0).astype(np.uint64)

    def _emails(self) -> np.ndarray:
        """1 for the first token of what has the form of an address, 2 inside it, else 0."""
        out, text, done = np.zeros(len(self.start), np.uint64), self.text, 0
        # Looked for only around what every address holds.
        for p in sorted(p for sign in ("@", "＠", "[at]", " dot ") for p in _all(text, sign)):
            if p < done:
                continue
            low = max(done, p - 160)
            for m in _EMAIL.finditer(text, low, p + 160):
                if m.end() > p:
                    a, b = np.searchsorted(self.start, [m.start(), m.end()])
                    out[a:b] = 2
                    if a < b:
                        out[a] = 1
                    done = m.end()
                    break
        return out


def _all(text: str, sign: str) -> Iterator[int]:
    p = text.find(sign)
    while p >= 0:
        yield p
        p = text.find(sign, p + 1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number of two, of which the order counts."""
    return (a * np.uint64(_P)) ^ ((b + np.uint64(1)) * np.uint64(_INV))


class Field:
    """Weights of the features (buckets x labels) and of the transitions (labels x labels)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        #: What a move into a label can add at most against staying outside; the move out of a piece is added where it begins.
        self.moved = moves.max(0) - moves[0, 0]
        #: A sentence's first token is moved into from nowhere.
        self.left = max(0.0, float(moves[1:, 0].max() - moves[0, 0]))
        self.moved[1::2] += self.left

    def decode(self, tokens: Tokens) -> np.ndarray:
        """The likeliest label of each token; sentences are decoded together with those of like length.

        A piece of a kind gains at most what its best beginning and all that could go on in the sentence gain against outside, with the
        best moves; a sentence in which this is for no kind above 0 is outside without decoding.
        """
        n = len(tokens.start)
        labels = np.zeros(n, np.int8)
        if not n:
            return labels
        first, *others = tokens.features()
        emit = self.weights.take(first, axis=0, mode="clip")
        # One buffer for all gathers: their memory is touched once.
        part = np.empty_like(emit)
        for f in others:
            self.weights.take(f, axis=0, out=part, mode="clip")
            emit += part
        more = emit[:, 1:] - emit[:, :1] + self.moved[1:]
        more[tokens.first, 0::2] += np.maximum(self.left - self.moved[1::2], 0)
        begun = np.maximum.reduceat(more[:, 0::2], tokens.first, axis=0)
        going = np.add.reduceat(np.maximum(more[:, 1::2], 0), tokens.first, axis=0)
        open_ = (begun + going > 0).any(1)
        every = np.diff(np.r_[tokens.first, n])
        kept = np.flatnonzero(np.repeat(open_, every))
        emit = emit[kept]
        length = every[open_]
        first = np.cumsum(length) - length
        order = np.argsort(length, kind="stable")
        i = 0
        while i < len(order):
            # Lengths of one block differ by a quarter at most; blocks hold so many tokens at most.
            low = int(length[order[i]])
            high = min(int(np.searchsorted(length[order], low * 1.25 + 2, "right")), i + max(1, 400_000 // int(low * 1.25 + 2)))
            for where, got in self._viterbi(emit, first[order[i:high]], length[order[i:high]]):
                labels[kept[where]] = got
            i = high
        return labels

    def _viterbi(self, emit: np.ndarray, first: np.ndarray, length: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        steps, m = int(length.max()), len(first)
        score = np.where(_BEGIN, emit[first], np.float32(-1e9))
        back = np.zeros((steps, m, LABELS), np.int8)
        moves = self.moves.astype(np.float32)
        for t in range(1, steps):
            way = score[:, :, None] + moves
            back[t] = way.argmax(1)
            new = way.max(1) + emit[np.minimum(first + t, len(emit) - 1)]
            score = np.where((t < length)[:, None], new, score)
        state, out = score.argmax(1), []
        for t in range(steps - 1, -1, -1):
            on = t < length
            out.append(((first + t)[on], state[on].astype(np.int8)))
            if t:
                state = np.where(on, back[t][np.arange(m), state], state)
        return out


#: A piece begins with its beginning label and goes on only within its kind.
_BEGIN = np.array([label == 0 or label % 2 == 1 for label in range(LABELS)])
_ALLOWED = np.array([[b == 0 or b % 2 == 1 or a in (b, b - 1) for b in range(LABELS)] for a in range(LABELS)])


def _labels(tokens: Tokens, spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(len(tokens.start), np.int64)
    for s, e, kind in spans:
        a, b = np.searchsorted(tokens.start, [s, e])
        out[a:b] = 2 * KINDS.index(kind) + 2
        if a < b:
            out[a] -= 1
    return out


def train(examples: list[tuple[str, list[tuple[int, int, str]]]], passes: int = PASSES, seed: int = 3) -> Field:
    """Maximum likelihood with a weight penalty, by Adam over batches of sentences; forward and backward sums in numpy."""
    at, shifted = 0, []
    for text, spans in examples:
        shifted += [(s + at, e + at, k) for s, e, k in spans]
        at += len(text) + 1
    tokens = Tokens([t.replace("\n", " ") for t, _ in examples])
    gold, feats = _labels(tokens, shifted), np.stack(tokens.features(), 1)
    used, index = np.unique(feats, return_inverse=True)
    feats = index.reshape(feats.shape)
    weights, moves = np.zeros((len(used), LABELS), np.float32), np.zeros((LABELS, LABELS), np.float32)
    length = np.diff(np.r_[tokens.first, len(gold)])
    rng = np.random.default_rng(seed)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, moves)]
    step, block = 0, 256
    for done in range(passes):
        rate = 0.08 * (1 - done / passes) + 0.005
        order = np.argsort(length + rng.random(len(length)) * 3)
        for k in rng.permutation(range(0, len(order), block)):
            some = order[k : k + block]
            first, size = tokens.first[some], length[some]
            steps, m = int(size.max()), len(some)
            place = first[:, None] + np.minimum(np.arange(steps), size[:, None] - 1)
            on = np.arange(steps) < size[:, None]
            emit = weights[feats[place]].sum(2)
            gate = np.where(_ALLOWED, moves, np.float32(-1e9))
            alpha, beta = np.zeros((steps, m, LABELS), np.float32), np.zeros((steps, m, LABELS), np.float32)
            alpha[0] = np.where(_BEGIN, emit[:, 0], np.float32(-1e9))
            for t in range(1, steps):
                x = alpha[t - 1][:, :, None] + gate
                top = x.max(1)
                alpha[t] = np.where(on[:, t, None], top + np.log(np.exp(x - top[:, None]).sum(1)) + emit[:, t], alpha[t - 1])
            top = alpha[-1].max(1, keepdims=True)
            whole = top + np.log(np.exp(alpha[-1] - top).sum(1, keepdims=True))
            moved = np.zeros((LABELS, LABELS), np.float32)
            for t in range(steps - 2, -1, -1):
                x = gate + (emit[:, t + 1] + beta[t + 1])[:, None]
                top = x.max(2)
                beta[t] = np.where(on[:, t + 1, None], top + np.log(np.exp(x - top[:, :, None]).sum(2)), 0)
                pair = np.exp(np.minimum(alpha[t][:, :, None] + x - whole[:, :, None], 0)) * on[:, t + 1, None, None]
                moved += pair.sum(0)
            share = np.exp(np.minimum(alpha + beta - whole, 0)).transpose(1, 0, 2) * on[:, :, None]
            truth = gold[place]
            share[np.arange(m)[:, None], np.arange(steps), truth] -= on
            pairs = on[:, 1:]
            np.subtract.at(moved, (truth[:, :-1][pairs], truth[:, 1:][pairs]), 1)
            rows, inverse = np.unique(feats[place[on]], return_inverse=True)
            inverse, delta = inverse.reshape(-1, feats.shape[1]), share[on]
            grad = np.zeros((len(rows), LABELS), np.float32)
            for label in range(LABELS):
                grad[:, label] = np.bincount(inverse.ravel(), np.repeat(delta[:, label], feats.shape[1]), minlength=len(rows))
            step += 1
            for x, g, (mean, square), pick in ((weights, grad / m, state[0], rows), (moves, moved / m, state[1], slice(None))):
                g = g + 1e-4 * x[pick]
                mean[pick] = 0.9 * mean[pick] + 0.1 * g
                square[pick] = 0.99 * square[pick] + 0.01 * g * g
                x[pick] -= rate * mean[pick] / (np.sqrt(square[pick]) + 1e-3)
    full = np.zeros((BUCKETS, LABELS), np.float32)
    full[used] = weights
    return Field(full, np.where(_ALLOWED, moves, -1e9).astype(np.float32))


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(table.expanded(TIMES))


def stored_field(spark: SparkSession, folder: str | None = None) -> Field:
    """The default field from a shared folder (that of spark.checkpoint.dir), where the first session that needs it leaves it; trained anew where none is set.

    The file's name holds a digest of the labelled table, the settings and this module, so that no stale weights are read.
    """
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return default_field()
    try:
        return _kept_field(spark, folder)
    except Py4JJavaError as error:
        # A folder that cannot be read or written costs the training, not the query.
        warnings.warn(f"weights are not kept: {error.java_exception}", stacklevel=2)
        return default_field()


def _kept_field(spark: SparkSession, folder: str) -> Field:
    digest = hashlib.sha256()
    for module in (table.__name__, __name__):
        digest.update(inspect.getsource(sys.modules[module]).encode())
    name = f"{folder.rstrip('/')}/models/pii-{digest.hexdigest()[:24]}.npz"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        stream = fs.open(path)
        try:
            kept = np.load(io.BytesIO(bytes(stream.readAllBytes())))
        finally:
            stream.close()
        weights = np.zeros((BUCKETS, LABELS), np.float32)
        weights[kept["used"]] = kept["weights"]
        return Field(weights, kept["moves"])
    field, data = default_field(), io.BytesIO()
    used = np.flatnonzero(field.weights.any(1))
    np.savez_compressed(data, used=used, weights=field.weights[used], moves=field.moves)
    part = jvm.org.apache.hadoop.fs.Path(f"{name}.{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    stream.write(bytearray(data.getvalue()))
    stream.close()
    # Another session may have been faster; its weights are the same.
    if not fs.rename(part, path):
        fs.delete(part, False)
    return field


def pieces(texts: list[str], field: Field) -> list[tuple[int, str, int, int]]:
    """(text, kind, first character, end character) of each piece found."""
    if not texts:
        return []
    tokens = Tokens(texts)
    labels = field.decode(tokens)
    ends = np.cumsum([len(t) + 1 for t in texts])
    begin = np.flatnonzero(labels % 2 == 1)
    out = []
    n = len(labels)
    for a in begin.tolist():
        kind, b = labels[a] // 2, a + 1
        while b < n and labels[b] == labels[a] + 1:
            b += 1
        s, e = int(tokens.start[a]), int(tokens.end[b - 1])
        d = int(np.searchsorted(ends, s, "right"))
        base = int(ends[d]) - len(texts[d]) - 1
        if _plausible(KINDS[kind], tokens.text[s:e]):
            out.append((d, KINDS[kind], s - base, e - base))
    return out


_SPACED = sorted({w for k, ws in table.DIGIT_WORDS.items() if k not in ("han", "ko", "ja") for w in ws.split()})
#: A digit as a word; those of Han, Hangul and kana may stand together.
_SPELLED = re.compile(rf"[〇零一二三四五六七八九공일이삼사오육칠팔구]|{'|'.join(table.DIGIT_WORDS['ja'].split())}|\b(?:{'|'.join(_SPACED)})\b", re.I)


def _plausible(kind: str, text: str) -> bool:
    """The exact check after decoding: what a piece of a kind must hold at least."""
    if kind == "email":
        return bool(_EMAIL.fullmatch(text))
    digits = sum(c.isdecimal() for c in text)
    if kind == "phone":
        return digits >= 7 or digits == 0
    if kind == "id_number":
        return digits + len(_SPELLED.findall(text)) >= 6
    if kind == "address":
        return digits > 0
    return digits == 0 and any(c.isalpha() for c in text)


_SCHEMA = "doc_id long, kind string, start_char long, end_char long"


def mentions(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, kind, start_char, end_char) of each piece of personal data in ``documents.text``; code points from 0.

    Whole texts are read, row by row over Arrow batches without a shuffle; null and empty texts and null ids have none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(field or stored_field(documents.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _slices(texts, 300_000):
                found = [(ids[a + d], kind, s, e) for d, kind, s, e in pieces(texts[a:b], shared.value)]
                cols = list(zip(*found)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "kind", "start_char", "end_char"])

    return documents.where("doc_id is not null and text <> ''").select("doc_id", "text").mapInArrow(run, _SCHEMA)


def _slices(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def redacted(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, text): each piece replaced by its kind in square brackets, such as [EMAIL]; all else stays. Null texts stay null."""
    shared = documents.sparkSession.sparkContext.broadcast(field or stored_field(documents.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = list(texts)
            known = [i for i, t in enumerate(texts) if t]
            for a, b in _slices([texts[i] for i in known], 300_000):
                part = known[a:b]
                for d, kind, s, e in reversed(pieces([texts[i] for i in part], shared.value)):
                    i = part[d]
                    out[i] = f"{out[i][:s]}[{kind.upper()}]{out[i][e:]}"
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")
