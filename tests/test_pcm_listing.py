import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from vocalith.functions import clock, vectors
from vocalith.operators import pcm, segments
from vocalith.sources import listing

BLOCKS = "job_id string, start long, pcm array<smallint>"


def test_cut_out_fills_gaps_with_zeros(spark):
    r = random.Random(1)
    whole, blocks, at = np.zeros(3000, np.int16), [], 0
    while at < 2900:
        n = r.randint(1, 200)
        if r.random() < 0.7:
            x = [r.randint(1, 99) for _ in range(min(n, 3000 - at))]
            whole[at : at + len(x)] = x
            blocks.append(("a", at, x))
        at += n
    spans = [("a", s := r.randint(0, 2800), s + r.randint(1, 200)) for _ in range(60)] + [("b", 0, 5), ("a", 10, 10)]
    df = spark.createDataFrame(spans, "job_id string, start long, end long")
    got = pcm.cut_out(df, spark.createDataFrame(blocks + blocks[:3], BLOCKS)).collect()
    assert len(got) == len({s for s in spans if s[2] > s[1]})
    for g in got:
        want = whole[g["start"] : g["end"]] if g["job_id"] == "a" else np.zeros(5)
        assert g["pcm"] == want.tolist() and g["covered"] == int((want > 0).sum())


@pytest.mark.parametrize(
    "sizes,starts,want",
    [([4, 4, 2], [0, 4, 8], []), ([4, 2, 4], [0, 4, 6], [(4, "short")]), ([4, 4], [0, 5], [(5, "gap")]), ([4], [1], [(1, "gap")]), ([5], [0], [(0, "too_long")]), ([4, 0], [0, 4], [(4, "empty")]), ([4, 4, 4], [0, 4, 8], [(8, "beyond")])],
)
@pytest.mark.parametrize("span", [3, 1000])
def test_faults(spark, sizes, starts, want, span):
    df = spark.createDataFrame([("a", s, [1] * n) for s, n in zip(starts, sizes)], BLOCKS)
    longest = 10 if want == [(8, "beyond")] else 100
    assert rows(pcm.faults(df, size=4, longest=longest, span=span), "start", "fault") == want


def test_progress(spark):
    ticks = [("a", 0, 5, None), ("a", 1, 9, None), ("a", 2, 7, None), ("a", 3, 12, 12), ("b", 0, 3, None)]
    df = spark.createDataFrame(ticks, "job_id string, seq long, processed long, total long")
    assert rows(pcm.progress(df, span=2)) == [("a", 12, 12, True, 1), ("b", 3, None, False, 0)]


def test_unknown_files(spark, tmp_path):
    for n in ("AB.ready", "CD.ready", "notes.txt"):
        (tmp_path / n).write_bytes(b"x")
    leases = spark.createDataFrame([("/data/AB.ready",), (None,)], "controlled_path string")
    got = listing.unknown(listing.files(spark, str(tmp_path), r"[A-Z]{2}\.ready"), leases)
    assert rows(got, "name", "bytes") == [("CD.ready", 1)]


def test_mapping_errors(spark):
    data = [("ok", "A", "1", "Ann"), ("ok", "B", None, None), ("ok", "C", "1", "Ann"), ("gap", "A", None, None), ("gap", "C", None, None), ("twice", "A", "1", "x"), ("twice", "A", "1", "x"), ("names", "A", "1", "x"), ("names", "B", "1", "y")]
    df = spark.createDataFrame(data, "job_id string, label string, id string, name string")
    assert rows(segments.mapping_errors(df)) == [("gap", "not_dense"), ("names", "two_names"), ("twice", "repeated")]


def test_due_is_inclusive(spark):
    df = spark.sql("select timestamp '2026-01-02 00:00:00' n, timestamp '2026-01-01 00:00:00' a, timestamp '2026-01-01 00:00:00.000001' b, cast(null as timestamp) c")
    assert tuple(df.select(*[clock.due(F.col(x), F.col("n"), 24) for x in "abc"]).first()) == (True, False, False)


def test_positive_zero(spark):
    df = spark.createDataFrame([(-0.0,), (float("nan"),), (float("-inf"),), (1.5,)], "x double")
    got = [r[0] for r in df.select(vectors.positive_zero(F.col("x"))).collect()]
    assert str(got[0]) == "0.0" and got[1:] == [None, None, 1.5]
