import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import rows
from vocalith.operators import intervals as I


def frame(spark, data):
    return spark.createDataFrame(data, "job_id string, start long, end long")


def some(seed, n=120, long=200_000):
    r = random.Random(seed)
    return [(r.choice("abc"), s := r.randint(0, 2_000_000), s + r.randint(-5, long)) for _ in range(n)] + [(None, 1, 2), ("a", None, 5), ("a", 5, None)]


def good(data):
    return [(k, s, e) for k, s, e in data if k is not None and s is not None and e is not None and e > s]


def union(data):
    by = defaultdict(list)
    for k, s, e in sorted(good(data)):
        if by[k] and s <= by[k][-1][1]:
            by[k][-1][1] = max(by[k][-1][1], e)
        else:
            by[k].append([s, e])
    return sorted((k, s, e) for k, x in by.items() for s, e in x)


@pytest.mark.parametrize("span", [10_000, 160_000_000])
def test_islands(spark, span):
    data = some(1) + some(1)[:20]
    assert rows(I.islands(frame(spark, data), span=span)) == union(data)


@pytest.mark.parametrize("bucket", [50_000, 960_000])
def test_overlaps(spark, bucket):
    a, b = some(2), some(3)
    got = rows(I.overlaps(frame(spark, a), frame(spark, b), bucket=bucket), "job_id", "l.start", "l.end", "r.start", "r.end", "start", "end")
    want = sorted((k, s, e, t, f, max(s, t), min(e, f)) for k, s, e in good(a) for q, t, f in good(b) if k == q and max(s, t) < min(e, f))
    assert got == want


def test_coverage(spark):
    a, b = some(4), some(5, 30)
    cover = union(b)
    want = sorted({(k, s, e, sum(max(0, min(e, f) - max(s, t)) for q, t, f in cover if q == k)) for k, s, e in good(a)})
    assert rows(I.coverage(frame(spark, a), frame(spark, b))) == want


def test_hop_windows_golden(spark):
    got = lambda s, e: [r[1] for r in rows(I.hop_windows(frame(spark, [("a", s, e)])))]
    assert got(1000, 2000) == [0]
    assert got(70_000, 71_000) == [48_000, 60_000]
    assert got(71_500, 72_001) == [48_000, 60_000, 72_000]


def test_hop_windows_brute_force(spark):
    data = some(6)
    want = sorted({(k, a, a + 24_000) for k, s, e in good(data) for a in range(0, e, 12_000) if a + 24_000 > s})
    assert rows(I.hop_windows(frame(spark, data))) == want


@pytest.mark.parametrize("n,want", [(0, []), (1, [(0, 1)]), (24_000, [(0, 24_000)]), (24_001, [(0, 24_000), (1, 24_001)]), (36_000, [(0, 24_000), (12_000, 36_000)]), (40_000, [(0, 24_000), (12_000, 36_000), (16_000, 40_000)]), (None, [])])
def test_tail_windows(spark, n, want):
    df = spark.createDataFrame([(n,)], "n long")
    assert rows(I.tail_windows(df, F.col("n")), "start", "end") == want


@pytest.mark.parametrize("span", [30_000, 160_000_000])
def test_cells(spark, span):
    starts, total = [0, 48_000, 60_000, 72_000], 72_001
    df = spark.createDataFrame([("a", s, total) for s in starts], "job_id string, start long, total long")
    got = rows(I.cells(df, "total", span=span), "start", "cell_start", "cell_end")
    mids = [min(total, (a + b) // 2 + 12_000) for a, b in zip(starts, starts[1:])]
    assert got == list(zip(starts, [0, *mids], [*mids, total]))


@pytest.mark.parametrize("span", [25_000, 160_000_000])
def test_merged_only_touching_and_equal(spark, span):
    data = [("a", 0, 10, "A"), ("a", 10, 20, "A"), ("a", 20, 30, "B"), ("a", 31, 40, "B"), ("a", 40, 50, None), ("a", 50, 60, None), ("a", 60, 60, "A"), ("b", 60, 70, None)]
    df = spark.createDataFrame([(k, s * 1000, e * 1000, x) for k, s, e, x in data], "job_id string, start long, end long, label string")
    got = rows(I.merged(df, "label", span=span), "job_id", "start", "end", "label", "n")
    assert got == sorted([("a", 0, 20_000, "A", 2), ("a", 20_000, 30_000, "B", 1), ("a", 31_000, 40_000, "B", 1), ("a", 40_000, 60_000, None, 2), ("b", 60_000, 70_000, None, 1)])


def test_merged_not_over_islands(spark):
    df = spark.createDataFrame([("a", 0, 10, "A", 0), ("a", 10, 20, "A", 10)], "job_id string, start long, end long, label string, island long")
    assert I.merged(df, "label", within="island").count() == 2


@pytest.mark.parametrize("n,pieces", [(1, 1), (479_999, 1), (480_000, 1), (480_001, 2), (960_000, 2), (960_001, 3)])
def test_split(spark, n, pieces):
    got = rows(I.split(frame(spark, [("a", 7, 7 + n)])), "start", "end", "piece")
    assert len(got) == pieces and got[0][0] == 7 and got[-1][1] == 7 + n
    assert all(a[1] == b[0] for a, b in zip(got, got[1:])) and all(e - s <= 480_000 for s, e, _ in got)


def test_blocks_tile(spark):
    got = rows(I.blocks(frame(spark, [("a", 100, 30_000)])), "start", "end", "block")
    assert got == [(100, 9600, 0), (9600, 19_200, 1), (19_200, 28_800, 2), (28_800, 30_000, 3)]
