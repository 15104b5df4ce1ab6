"""Languages of documents, their lines and of segments, by naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import marks

CODES = ["de", "en", "es", "fr", "ja", "ko", "yue", "zh"]
# Other notations of the codes, in lower case and without region or script.
NOTATIONS = {
    "de": ["de", "deu", "ger", "german", "deutsch"], "en": ["en", "eng", "english"], "es": ["es", "spa", "spanish", "español", "castellano"],
    "fr": ["fr", "fra", "fre", "french", "français"], "ja": ["ja", "jpn", "jp", "japanese", "日本語"], "ko": ["ko", "kor", "kr", "korean", "한국어"],
    "yue": ["yue", "zh-yue", "cantonese", "zh-hk", "粤语", "粵語"], "zh": ["zh", "zho", "chi", "cmn", "chinese", "mandarin", "中文"],
}
BUCKETS = 1 << 17
#: A line is of another language than its document's only if that is likelier by so many nats.
MARGIN = 8.0
MIN_LETTERS = 8
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def label_code(label: Column) -> Column:
    """The code a label names in any notation (``en-GB``, ``eng``, ``zh_Hans``), or NULL."""
    plain = F.regexp_replace(F.trim(F.lower(F.regexp_replace(label, marks.SPACE, " "))), "_", "-")
    names = [(n, c) for c, ns in NOTATIONS.items() for n in ns]
    known = F.create_map(*[F.lit(x) for pair in names for x in pair])
    return F.coalesce(F.try_element_at(known, plain), F.try_element_at(known, F.split_part(plain, F.lit("-"), F.lit(1))))


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Of each code point: 0 for a line feed, 1 for what is no letter, else the letter in lower case, width-folded."""
    table = np.ones(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = (unicodedata.normalize("NFKC", ch).lower() if c > 127 else ch.lower())[:1]
            table[c] = ord(low) if low else c
    table[10] = 0
    return table


def _cjk(codes: np.ndarray) -> np.ndarray:
    return ((codes >= 0x3040) & (codes < 0xA000)) | ((codes >= 0xAC00) & (codes < 0xD7B0)) | ((codes >= 0x20000) & (codes < 0x32000))


def _grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each n-gram (n = 1, 2, 3) within a line, the line it is in, and the number of letters of each line."""
    codes = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    # Of a line in both kinds of script the lesser one is names, loan words and codes; a CJK character weighs three letters.
    line = np.cumsum(codes == 0)
    cjk = _cjk(codes)
    both = np.bincount(line, cjk * 3.0) - np.bincount(line, ((codes > 1) & ~cjk) * 1.0) if len(codes) else np.zeros(0)
    if len(codes):
        every = np.bincount(line[codes > 1], minlength=int(line[-1]) + 1)
        codes = np.where((codes > 1) & (cjk != (both[line] > 0)), 1, codes)
    # Runs of what is no letter count as one space.
    codes = codes[np.r_[True, (codes[1:] != 1) | (codes[:-1] != 1)]] if len(codes) else codes
    line = np.cumsum(codes == 0)
    letters = every if len(codes) else np.zeros(1, np.int64)
    c = codes.astype(np.uint64)
    found, where = [], []
    one = codes > 1
    found.append(((c[one] * _P) >> np.uint64(47)).astype(np.int64))
    where.append(line[one])
    if len(c) > 1:
        two = c[:-1] * _Q + c[1:]
        inside = (codes[:-1] > 0) & (codes[1:] > 0) & ((codes[:-1] > 1) | (codes[1:] > 1))
        found.append(((two[inside] * _P) >> np.uint64(47)).astype(np.int64))
        where.append(line[:-1][inside])
    if len(c) > 2:
        three = two[:-1] * _Q + c[2:]
        inside = (codes[:-2] > 0) & (codes[1:-1] > 0) & (codes[2:] > 0)
        found.append(((three[inside] * _P) >> np.uint64(47)).astype(np.int64))
        where.append(line[:-2][inside])
    return np.concatenate(found), np.concatenate(where), letters


def line_scores(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods (lines x codes) and letters of the lines of all texts, in order."""
    scores, letters = [], []
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > 200_000 or i == len(texts) - 1:  # parts that stay in the processor's cache
            bucket, line, n = _grams("\n".join(texts[start : i + 1]))
            out = np.zeros((len(n), weights.shape[1]), np.float64)
            for k in range(weights.shape[1]):
                out[:, k] = np.bincount(line, weights[bucket, k], minlength=len(n))
            scores.append(out)
            letters.append(n)
            start, size = i + 1, 0
    return (np.concatenate(scores), np.concatenate(letters)) if scores else (np.zeros((0, weights.shape[1])), np.zeros(0, np.int64))


def _recounted(texts: list[str], letters: np.ndarray) -> np.ndarray:
    """Letters of each line, those of fillers taken off where the line is so short that they matter."""
    letters = letters.copy()
    near = np.flatnonzero((letters >= MIN_LETTERS) & (letters < 4 * MIN_LETTERS))
    if len(near):
        lines = "\n".join(texts).split("\n")
        for i in near:
            letters[i] = sum(map(str.isalpha, marks.without_fillers(lines[i])))
    return letters


def fit(texts: list[str], labels: list[str], rounds: int = 2, smooth: float = 0.05) -> np.ndarray:
    """Log-probabilities (buckets x codes) from texts with labels some of which are wrong.

    After the first fit each line is given the code it is likeliest in, so that wrong labels and mixed texts are undone.
    A code without any text keeps the smoothed probability of nothing seen, below that of all others.
    """
    bucket, line, owner, base = [], [], [], 0
    for t, c in zip(texts, labels):
        b, l, n = _grams(speech(t))
        bucket.append(b.astype(np.int32))
        line.append((l + base).astype(np.int32))
        owner.append(np.full(len(n), CODES.index(c), np.int8))
        base += len(n)
    if not bucket:
        return np.zeros((BUCKETS, len(CODES)), np.float32)
    b, l, y = np.concatenate(bucket), np.concatenate(line), np.concatenate(owner)
    del bucket, line, owner
    # Lines in parts, so that what is held at once stays small.
    parts = [slice(i, i + 1_000_000) for i in range(0, len(b), 1_000_000)]
    for r in range(rounds + 1):
        counts = np.zeros(BUCKETS * len(CODES))
        for p in parts:
            counts += np.bincount(b[p].astype(np.int64) * len(CODES) + y[l[p]], minlength=len(counts))
        counts = counts.reshape(BUCKETS, len(CODES))
        total = counts.sum(0)
        weights = (np.log(counts + smooth) - np.log(np.maximum(total, total.max() * 0.01) + smooth * BUCKETS)).astype(np.float32)
        if r < rounds:
            scores = np.zeros((base, len(CODES)))
            for p in parts:
                low = int(l[p].min())
                for k in range(len(CODES)):
                    part = np.bincount(l[p] - low, weights[b[p], k])
                    scores[low : low + len(part), k] += part
            y = scores.argmax(1).astype(np.int8)
    return weights


_ADDRESS = re.compile(r"(?<![A-Za-z0-9_.+'-])[A-Za-z0-9_.+'-]+ ?[@＠] ?[A-Za-z0-9_.-]+|(?<![A-Za-z0-9_.+-])[A-Za-z0-9_.+-]+(?: \[?(?:at|dot|underscore)\]? [A-Za-z0-9_+-]+)+")


def speech(text: str) -> str:
    """What of a text tells its language: no marks and no addresses; line feeds stay."""
    bare = marks.blanked(text)
    return _ADDRESS.sub(" ", bare) if "@" in bare or "＠" in bare or " dot" in bare or "[dot]" in bare else bare


def _choose(scores: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the likeliest code and the confidence: its share after scaling the evidence by the square root of its amount."""
    best = scores.argmax(1)
    scaled = (scores - scores.max(1, keepdims=True)) / np.sqrt(np.maximum(letters, 1))[:, None]
    return best, 1 / np.exp(scaled).sum(1)


def sample(documents: DataFrame, segments: DataFrame, rows: int) -> tuple[list[str], list[str]]:
    """About ``rows`` labelled texts of each table, chosen by a hash of their keys, never more than twice as many."""
    texts, labels = [], []
    for df, key, lang in ((documents, ["doc_id"], "lang"), (segments, ["job_id", "segment_index"], "language")):
        every = max(1, df.count() // rows)
        chosen = df.where(F.pmod(F.xxhash64(*key), F.lit(every)) == 0).select(label_code(F.col(lang)).alias("c"), "text").where("c is not null and text is not null")
        for r in chosen.limit(2 * rows).collect():
            texts.append(r["text"])
            labels.append(r["c"])
    return texts, labels


def documents_languages(documents: DataFrame, weights) -> DataFrame:
    """Rows (kind, ref, part_no, language, confidence, label, mixed, letters) of documents and lines.

    kind ``document`` (part_no -1): the language most lines of at least 8 letters are in, ties to the one with more letters;
    ``line``: each line of at least 8 letters, and of a mixed document each with letters (short ones in its main language, with a low confidence). mixed says whether lines of several languages occur. Documents without 8 letters have a
    language NULL and no lines; so have null and empty texts. ``weights`` is the broadcast matrix of ``fit``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        names = np.array(CODES, dtype=object)
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = [speech(t) if t else "" for t in batch.column(1).to_pylist()]
            scores, letters = line_scores(texts, w)
            if not len(texts):
                continue
            lines = np.array([t.count("\n") + 1 for t in texts])
            doc = np.repeat(np.arange(len(texts)), lines)
            no = np.arange(len(doc)) - np.repeat(np.cumsum(lines) - lines, lines)
            letters = _recounted(texts, letters)
            best, sure = _choose(scores, letters)
            counted = letters >= MIN_LETTERS
            k = len(CODES)
            # Votes of lines; letters break ties. Where no line is long enough, all letters together decide.
            votes = np.bincount(doc[counted] * k + best[counted], minlength=len(texts) * k).reshape(-1, k).astype(np.float64)
            weight = np.bincount(doc * k + best, letters, minlength=len(texts) * k).reshape(-1, k)
            main = (votes + weight / (weight.sum() + 1)).argmax(1)
            # A line leaves the main language only on clear evidence.
            stays = scores[np.arange(len(doc)), best] - scores[np.arange(len(doc)), main[doc]] < MARGIN
            best = np.where(stays, main[doc], best)
            votes = np.bincount(doc[counted] * k + best[counted], minlength=len(texts) * k).reshape(-1, k).astype(np.float64)
            weight = np.bincount(doc * k + best, letters, minlength=len(texts) * k).reshape(-1, k)
            main = (votes + weight / (weight.sum() + 1)).argmax(1)
            total = weight.sum(1)
            mixed = (votes > 0).sum(1) > 1
            share = np.divide((votes * (np.arange(k) == main[:, None])).sum(1), votes.sum(1), out=np.ones(len(texts)), where=votes.sum(1) > 0)
            mean = np.bincount(doc, sure * letters, minlength=len(texts)) / np.maximum(total, 1)
            known = total >= MIN_LETTERS
            yield _rows("document", ids, np.full(len(texts), -1), np.where(known, names[main], None), share * mean, labels, mixed, total)
            # A short line of a mixed document is taken to be in the main language, at half the chance of a blind guess at most.
            short = ~counted & mixed[doc] & (letters > 0)
            best, sure = np.where(short, main[doc], best), np.where(short, np.minimum(sure, 0.5 / k), sure)
            at = np.flatnonzero(counted | short)
            yield _rows("line", [ids[i] for i in doc[at]], no[at], names[best[at]], sure[at], [labels[i] for i in doc[at]], mixed[doc[at]], letters[at])

    rows = documents.select(F.col("doc_id").cast("string"), "text", label_code(F.col("lang")).alias("label"))
    return rows.mapInArrow(run, _SCHEMA)


def segment_languages(segments: DataFrame, weights) -> DataFrame:
    """Rows like those of ``documents_languages`` of kind ``segment``: ref = job_id, part_no = segment_index, the text as a whole.

    Segments of fewer than 8 letters have a language NULL. Copies of a segment come out as often as they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        names = np.array(CODES, dtype=object)
        for batch in batches:
            texts = [speech(t).replace("\n", " ") if t else "" for t in batch.column(2).to_pylist()]
            if not len(texts):
                continue
            scores, letters = line_scores(texts, w)
            letters = _recounted(texts, letters)
            best, sure = _choose(scores, letters)
            language = np.where(letters >= MIN_LETTERS, names[best], None)
            yield _rows("segment", batch.column(0).to_pylist(), batch.column(1).to_pylist(), language, sure, batch.column(3).to_pylist(), np.zeros(len(texts), bool), letters)

    rows = segments.where("job_id is not null and segment_index is not null").select("job_id", "segment_index", "text", label_code(F.col("language")).alias("label"))
    return rows.mapInArrow(run, _SCHEMA)


_SCHEMA = "kind string, ref string, part_no long, language string, confidence double, label string, mixed boolean, letters long"


def _rows(kind, ref, part, language, confidence, label, mixed, letters) -> pa.RecordBatch:
    s = pa.string()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * len(ref), s), pa.array(ref, s), pa.array(part, pa.int64()), pa.array(list(language), s), pa.array(confidence, pa.float64()),
            pa.array(label, s), pa.array(mixed, pa.bool_()), pa.array(np.asarray(letters).astype(np.int64)),
        ],
        ["kind", "ref", "part_no", "language", "confidence", "label", "mixed", "letters"],
    )


def languages(documents: DataFrame, segments: DataFrame, sample_rows: int = 2500) -> DataFrame:
    """All rows of documents, lines and segments; the model is fitted on a sample bounded by ``sample_rows`` texts of each table (at most twice)."""
    weights = documents.sparkSession.sparkContext.broadcast(fit(*sample(documents, segments, sample_rows)))
    return documents_languages(documents, weights).unionByName(segment_languages(segments, weights))


def wrong_labels(found: DataFrame) -> DataFrame:
    """The cases (kind, ref, part_no, language): documents and segments whose label names no or another language, all lines of at least 8 letters of mixed documents."""
    other = F.col("language").isNotNull() & ~F.col("label").eqNullSafe(F.col("language"))
    cases = found.where(F.when(F.col("kind") == "line", F.col("mixed") & (F.col("letters") >= MIN_LETTERS)).otherwise(other))
    return cases.groupBy("kind", "ref", "part_no").agg(F.min("language").alias("language"))
