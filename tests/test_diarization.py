"""The two queries that SQL cannot express, against plain Python over the whole tables."""

from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq

from conftest import rows
from vocalith import catalogue
from vocalith.operators import spectral


def windows_of(data):
    """Of each job its usable windows by start (the least by content of one start), at length one."""
    kept = defaultdict(dict)
    for r in pq.read_table(f"{data}/speaker_embedding_windows.parquet").to_pylist():
        v = r["embedding"]
        if r["job_id"] is None or v is None or len(v) != 192 or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        own = kept[r["job_id"]]
        own[r["start_sample"]] = min(own.get(r["start_sample"], v), v)
    return kept


def test_recording_clusters_equal_those_of_each_recording_alone(spark, data):
    got = defaultdict(dict)
    for job, start, ordinal, error in rows(catalogue.queries()["recording_clusters"](spark, data), "job_id", "start", "ordinal", "error"):
        assert error is None
        got[job][start] = ordinal
    want = {}
    for job, own in windows_of(data).items():
        starts = sorted(own)
        x = np.array([own[s] for s in starts], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want[job] = dict(zip(starts, spectral.clustered(x, dense=10**9).tolist()))
    assert want and got == want


def merged(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def letters(n):
    return chr(65 + n) if n < 26 else chr(64 + n // 26) + chr(65 + n % 26)


def test_diarized_regions_equal_a_sweep(spark, data):
    ordinals = defaultdict(dict)
    for job, start, ordinal in rows(catalogue.queries()["recording_clusters"](spark, data), "job_id", "start", "ordinal"):
        ordinals[job][start] = ordinal
    speech = defaultdict(list)
    for r in pq.read_table(f"{data}/speaker_regions.parquet", columns=["job_id", "start_sample", "end_sample"]).to_pylist():
        if r["job_id"] is not None and None not in r.values() and r["end_sample"] > r["start_sample"]:
            speech[r["job_id"]].append((r["start_sample"], r["end_sample"]))
    want = []
    for job, own in ordinals.items():
        if job not in speech:
            continue
        islands, starts = merged(speech[job]), sorted(own)
        total = max(e for _, e in islands)
        cells = []
        for i, s in enumerate(starts):
            left = 0 if i == 0 else max(0, min(total, (starts[i - 1] + s + 1) // 2 + 12_000))
            right = total if i == len(starts) - 1 else max(0, min(total, (s + starts[i + 1] + 1) // 2 + 12_000))
            cells.append((left, right, own[s]))
        for a, b in islands:
            runs = []
            for left, right, who in cells:
                s, e = max(a, left), min(b, right)
                if s >= e:
                    continue
                if runs and runs[-1][1] == s and runs[-1][2] == who:
                    runs[-1][1] = e
                else:
                    runs.append([s, e, who])
            for s, e, who in runs:
                while s < e:
                    want.append((job, letters(who), s, min(e, s + 480_000)))
                    s += 480_000
    got = rows(catalogue.queries()["diarized_regions"](spark, data), "job_id", "label", "start", "end")
    assert want and got == sorted(want)
