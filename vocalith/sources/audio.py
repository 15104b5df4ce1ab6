"""Audio files of PCM (8 to 32 bits) into probes and fixed blocks, without any decoder outside Python's library."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.intervals import BLOCK

RATE = 16_000
#: Samples after which a batch of blocks goes out.
MOST = 1_000_000


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")


def probes(audio: DataFrame) -> DataFrame:
    """(path, seconds, rate, channels, width, error) of each file; a file that is no PCM WAV has the error ``unreadable``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rows.append((path, w.getnframes() / w.getframerate(), w.getframerate(), w.getnchannels(), w.getsampwidth(), None))
                except (wave.Error, EOFError, ZeroDivisionError):
                    rows.append((path, None, None, None, None, "unreadable"))
            yield pd.DataFrame(rows, columns=["path", "seconds", "rate", "channels", "width", "error"]).astype({c: "Int64" for c in ("rate", "channels", "width")})

    return audio.mapInPandas(run, "path string, seconds double, rate long, channels long, width long, error string")


def _samples(data: bytes, width: int, channels: int) -> np.ndarray:
    """Frames x channels of 16 bits; of wider samples the upper bits, of 8 bits (which have no sign) the distance from their middle. A last frame that is cut off is dropped."""
    data = data[: len(data) // (width * channels) * width * channels]
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.int16) - 128) << 8
    elif width == 2:
        x = np.frombuffer(data, "<i2")
    else:
        x = np.frombuffer(data, np.uint8).reshape(-1, width)[:, width - 2 :].copy().view("<i2")[:, 0]
    return x.reshape(-1, channels)


def blocks(content: bytes, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    """(start, samples) of each block of one file, as ``decoded`` has them."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            rate, x = w.getframerate(), _samples(w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels())
    except (wave.Error, EOFError):
        return
    mono = x[:, 0] if x.shape[1] == 1 else np.rint(x.mean(1)).astype(np.int16)
    if rate != RATE and len(mono):
        at = np.arange(len(mono) * RATE // rate) * (rate / RATE)
        mono = np.rint(np.interp(at, np.arange(len(mono)), mono)).astype(np.int16)
    for s in range(0, len(mono), size):
        yield s, mono[s : s + size]


def _batched(files: Iterable[tuple[str, bytes]], size: int, most: int = MOST) -> Iterator[pa.RecordBatch]:
    """The blocks of the files as batches that end with the block that brings them to ``most`` samples."""
    held: list[tuple[str, int, np.ndarray]] = []

    def batch() -> pa.RecordBatch:
        paths, starts, pcm = zip(*held)
        ends = np.cumsum([0, *map(len, pcm)], dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(starts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pcm)))], ["path", "start_sample", "pcm"])

    n = 0
    for path, content in files:
        for s, x in blocks(content, size):
            held.append((path, s, x))
            n += len(x)
            if n >= most:
                yield batch()
                n = 0
                held.clear()
    if held:
        yield batch()


def decoded(audio: DataFrame, size: int = BLOCK) -> DataFrame:
    """(path, start_sample, pcm ARRAY<SMALLINT>): mono blocks of ``size`` samples at 16 kHz, the last maybe shorter.

    Samples of 8, 24 and 32 bits are brought to 16; channels are averaged; another rate is brought to 16 kHz by linear interpolation. Files that are unreadable have no blocks;
    ``probes`` tells them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One file at a time becomes bytes of Python.
        return _batched(((p.as_py(), c.as_py()) for batch in batches for p, c in zip(batch["path"], batch["content"])), size)

    return audio.select("path", "content").mapInArrow(run, "path string, start_sample long, pcm array<smallint>")


def decode_budget(seconds: Column) -> Column:
    """Seconds a decoder may take: twice the audio and ten more, from half a minute to twelve hours."""
    return F.least(F.lit(43_200.0), F.greatest(F.lit(30.0), seconds * 2 + 10))


def window_pcm(pcm: Column, size: int = 24_000) -> Column:
    """Samples as floats in [-1, 1), filled up with zeros at the right to ``size``."""
    return F.transform(F.concat(pcm, F.array_repeat(F.lit(0).cast("smallint"), size - F.size(pcm))), lambda x: x / F.lit(32768.0))
