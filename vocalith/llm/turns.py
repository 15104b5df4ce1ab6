"""Transcripts with marks and loose speaker labels into clean speaker turns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.ordered import along
from ..operators.store import settle
from . import marks, runs

#: A label of so few letters stands for itself: `A` and `AB` are two speakers, however alike.
LETTERS = 3
SIMILAR = 0.8
_WORD = re.compile(rf"^(?:{'|'.join(marks.SPEAKER_WORDS)})\b[\s_-]*", re.I)


@lru_cache(maxsize=10_000)
def plain_name(label: str) -> str:
    """The label in capitals, width-folded, without a leading speaker word, punctuation or doubled spaces; '' names nobody."""
    text = unicodedata.normalize("NFKC", label).strip()
    found = re.match(marks.LABEL, re.sub(r"\s+", " ", text.upper()))
    if found:
        return found[1]
    text = _WORD.sub("", text)
    return re.sub(r"[\W_]+", " ", text.upper()).strip()


def _initials(name: str) -> str:
    return "".join(w[0] for w in name.split())


def cluster_labels(labels: list[str]) -> dict[str, str]:
    """Each spelling to its canonical speaker within one transcript; spellings of equal plain names are one speaker, and so are those ``cluster_names`` joins."""
    plain = {x: plain_name(x) for x in labels}
    best = cluster_names(list({n for n in plain.values() if n}))
    return {x: best[n] for x, n in plain.items() if n}


def cluster_names(plain: list[str]) -> dict[str, str]:
    """Each plain name to its canonical one within one transcript, by union-find.

    Two names are one speaker if they are equal, or, for names of more than ``LETTERS`` letters, if their
    initials are equal and the names are alike by 0.8. The canonical name is the longest of the class, then the smallest.
    Only names of equal initials and of lengths that allow such likeness are compared, and those that bounds by their letters leave.
    """
    names = sorted(set(plain))
    parent = {n: n for n in names}

    def find(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_initials: dict[str, list[str]] = {}
    for n in names:
        if len(n) > LETTERS:
            by_initials.setdefault(_initials(n), []).append(n)
    for same in by_initials.values():
        same.sort(key=len)
        for i, a in enumerate(same):
            match = SequenceMatcher(None, b=a, autojunk=False)
            for b in reversed(same[:i]):
                # The likeness is twice the common letters over all; shorter names than this cannot reach it.
                if len(b) * (2 - SIMILAR) < len(a) * SIMILAR:
                    break
                if find(a) == find(b):
                    continue
                match.set_seq1(b)
                if match.quick_ratio() >= SIMILAR and match.ratio() >= SIMILAR:
                    parent[find(a)] = find(b)
    best: dict[str, str] = {}
    for n in names:
        r = find(n)
        best[r] = min(best.get(r, n), n, key=lambda x: (-len(x), x))
    return {n: best[find(n)] for n in names}


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _clustered(names: pd.Series) -> pd.Series:
    return names.map(lambda xs: cluster_names(list(xs)))


def own_label(label: str | None) -> str | None:
    """The letters a label names, else the label as it stands if it is a name, else None: blank, punctuation or a mere speaker word names nobody."""
    plain = plain_name(label) if label else ""
    if not plain:
        return None
    return plain if len(plain) <= LETTERS else label.strip()


def spoken_records(records: DataFrame, with_text: bool = True) -> DataFrame:
    """(job_id, segment_index, start_sample, end_sample, speaker, text): the records that hold speech and name a speaker.

    Rows of equal (job_id, segment_index) are one record, the earliest received. The label is that of anonymous_speaker
    or, if it names nobody, that at the head of the text. Void spans (end <= start) and null keys are dropped. Without ``with_text`` the text is NULL.
    """
    cols = ["start_sample", "end_sample", "text", "anonymous_speaker"]
    once = records.where("job_id is not null and segment_index is not null").groupBy("job_id", "segment_index").agg(
        F.min_by(F.struct(*cols), F.struct(F.coalesce("received_at", F.lit("9999-12-31").cast("timestamp")), *[F.col(c) for c in cols])).alias("r")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            job, index, start, end, text, who = (batch.column(i) for i in range(6))
            keep, speakers, plains, marks_of, texts = [], [], [], [], []
            for i, (t, w) in enumerate(zip(text.to_pylist(), who.to_pylist())):
                named, clean, spoken = marks.split_text(t)
                label = own_label(w) or named
                if spoken and label:
                    plain = plain_name(label)
                    lettered = len(plain) <= LETTERS
                    keep.append(i)
                    speakers.append(plain if lettered else None)
                    plains.append(None if lettered else plain)
                    marks_of.append(None if lettered else _initials(plain))
                    texts.append(clean if with_text else None)
            at = pa.array(keep, pa.int64())
            made = [pa.array(x, pa.string()) for x in (speakers, plains, marks_of, texts)]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in (job, index, start, end)), *made], ["job_id", "segment_index", "start_sample", "end_sample", "speaker", "label", "initials", "text"])

    flat = once.select("job_id", "segment_index", "r.*").where("end_sample > start_sample")
    # Labels of letters are their own speakers; names are clustered below. The texts are split once for both.
    rows = settle(flat.mapInArrow(run, "job_id string, segment_index long, start_sample long, end_sample long, speaker string, label string, initials string, text string"))
    cols = ["job_id", "segment_index", "start_sample", "end_sample", "speaker", "text"]
    named = rows.where("speaker is null").drop("speaker")
    # Only names of equal initials can be one speaker, so a transcript's names are taken by initials; of each name its plain form once, combined before it moves.
    labels = named.groupBy("job_id", "initials").agg(F.collect_set("label").alias("labels")).select("job_id", F.explode(_clustered("labels")).alias("label", "speaker"))
    return rows.where("speaker is not null").select(cols).unionByName(named.join(labels, ["job_id", "label"]).select(cols))


def _turns(spoken: DataFrame, gap: int, chunk: int) -> DataFrame:
    return runs.collapse_runs(spoken, F.col("job_id"), F.col("speaker"), F.col("start_sample"), F.col("end_sample"), gap, F.col("segment_index"), chunk)


def speaker_turns(records: DataFrame, gap: int = 480_000, chunk: int = runs.CHUNK_SAMPLES) -> DataFrame:
    """Turns (job_id, speaker, start_sample, end_sample, n_records) of ``segment_records``.

    Spoken records by start: one joins the turn if it has the same speaker and starts at most ``gap`` after the turn's
    latest end. A job that names no speaker has no turns.
    """
    out = _turns(spoken_records(records, with_text=False), gap, chunk)
    return out.select(
        F.col("key").alias("job_id"), F.col("label").alias("speaker"), F.col("start").alias("start_sample"), F.col("end").alias("end_sample"), F.col("n_events").alias("n_records")
    )


def turn_texts(records: DataFrame, gap: int = 480_000, chunk: int = runs.CHUNK_SAMPLES) -> DataFrame:
    """(job_id, turn, speaker, segment_index, start_sample, end_sample, text): the clean text of each spoken record with the turn it is in.

    A turn is named by the segment_index of its first record. Texts stay a row a record, as a turn may be as long as its job.
    """
    spoken = spoken_records(records)
    begun = _turns(spoken, gap, chunk).select(F.col("key").alias("job_id"), F.col("first").alias("segment_index"), F.lit(True).alias("begins"))
    rows = spoken.join(begun, ["job_id", "segment_index"], "left").withColumn("opens", F.when(F.col("begins"), F.col("segment_index")))
    rows = along(rows, "job_id", ["start_sample", "end_sample", "segment_index"], chunk, last={"open": F.col("opens")})
    return rows.select("job_id", F.coalesce("opens", "open").alias("turn"), "speaker", "segment_index", "start_sample", "end_sample", "text")
