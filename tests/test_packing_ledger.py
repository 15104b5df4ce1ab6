import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from vocalith.functions import clock
from vocalith.operators import ledger, packing


def greedy(items, most, samples, span):
    no, n, total, first, out = 0, 0, 0, 0, []
    for s, e in items:
        if n and (n + 1 > most or total + e - s > samples or e - first > span):
            no, n, total = no + 1, 0, 0
        if not n:
            first = s
        n, total = n + 1, total + e - s
        out.append(no)
    return out


@pytest.mark.parametrize("bounds", [(32, 960_000, 4_800_000), (3, 100, 1000), (100, 50, 10_000), (100, 10_000, 60)])
def test_packed(spark, bounds):
    r = random.Random(5)
    data = []
    for k in "abc":
        at = 0
        for i in range(80):
            start = at + r.randint(0, 30)
            at = start + r.randint(1, 60)
            data.append((k, i, start, at))
    df = spark.createDataFrame(data, "job_id string, segment_index long, start long, end long").repartition(3)
    got = {(r["job_id"], r["segment_index"]): r["batch_no"] for r in packing.packed(df, most=bounds[0], samples=bounds[1], span=bounds[2]).collect()}
    for k in "abc":
        mine = [d for d in data if d[0] == k]
        assert [got[k, d[1]] for d in mine] == greedy([(d[2], d[3]) for d in mine], *bounds)


def test_packed_bounds_are_inclusive_and_one_large_row_stands_alone(spark):
    df = spark.createDataFrame([("a", 0, 0, 60), ("a", 1, 60, 100), ("a", 2, 100, 101), ("a", 3, 101, 500)], "job_id string, segment_index long, start long, end long")
    assert [r[2] for r in rows(packing.packed(df, samples=100))] == [0, 0, 1, 2]


JOBS = "id string, status string, input_lease_id string"
LEASES = "id string, owner_kind string, owner_id string, phase string, actual_bytes long, reserved_bytes long, lease_type string"


def test_lease_joins(spark):
    jobs = spark.createDataFrame([("j1", "queued", "l1"), ("j2", "queued", "gone"), ("j3", None, None)], JOBS)
    leases = spark.createDataFrame([("l1", "job", "j1", "sealed", 5, 5, "upload"), ("l2", "job", "j1", "writing", 7, 9, "artifact"), ("l3", "job", "x", "sealed", 1, 1, "artifact"), ("l4", "sync", "j2", "sealed", 1, 1, "upload")], LEASES)
    assert rows(ledger.with_leases(jobs, leases), "id", "input_phase", "leases", "bytes") == [("j1", "sealed", 2, 12), ("j2", None, 0, 0), ("j3", None, 0, 0)]
    assert rows(ledger.orphans(leases, jobs), "id") == [("l3",)]
    assert rows(ledger.guarded(jobs, leases), "id") == [("j1",)]
    usage = rows(ledger.usage(leases), "lease_type", "phase", "n", "outstanding", "quanta")
    assert ("artifact", "writing", 1, 2, clock.QUANTUM) in usage


def test_once_takes_the_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), (None, 9, "n")], "id string, at int, v string")
    assert rows(ledger.once(df, "id", "at")) == [("a", 3, "y")]


def test_differing_is_null_safe(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, 5, "y"), (3, 1, "z")], "k int, v int, w string")
    b = spark.createDataFrame([(1, None, "x"), (2, None, "y"), (4, 1, "z")], "k int, v int, w string")
    assert rows(ledger.differing(a, b, "k")) == [(2, "changed"), (3, "removed"), (4, "added")]


def test_violations(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "v int")
    assert rows(ledger.violations(df, {"positive": F.col("v") > 0, "known": F.col("v").isNotNull()})) == [("known", 1), ("positive", 2)]


@pytest.mark.parametrize("size,quanta", [(0, 1), (1, 1), (clock.QUANTUM, 1), (clock.QUANTUM + 1, 2)])
def test_reserved(spark, size, quanta):
    assert spark.range(1).select(clock.reserved(F.lit(size))).first()[0] == quanta * clock.QUANTUM


def test_instants(spark):
    df = spark.sql("select timestamp '2026-07-27 12:00:00' a, timestamp '2026-07-27 12:00:00.5' b")
    got = df.select(clock.instant(F.col("a")), clock.instant(F.col("b")), clock.fixed_instant(F.col("a")), clock.elapsed_ms(F.col("a"), F.col("b")), clock.elapsed_ms(F.col("b"), F.col("a"))).first()
    assert tuple(got) == ("2026-07-27T12:00:00Z", "2026-07-27T12:00:00.500000Z", "2026-07-27T12:00:00.000000Z", 500.0, 0.0)


JOB = (
    "id string, phase string, status string, input_lease_id string, canonical_options_json string, selected_speaker_snapshot binary, snapshot_sha256 string, input_size_bytes long, effective_max_audio_samples long, effective_direct_max_audio_samples long, total_samples long, "
    "processed_samples long, request_fingerprint string, processor_fingerprint string, attempt_no int, attempt_token string, owner_generation string, crash_recoveries int, cancel_requested boolean, result_lease_id string, error_code string, input_cleanup_pending boolean, created_at long, started_at long, finished_at long"
)
NAMES = [x.split()[0] for x in JOB.split(", ")]
NEW = dict.fromkeys(NAMES) | {"id": "a", "phase": "receiving", "input_lease_id": "l", "processed_samples": 0, "attempt_no": 0, "crash_recoveries": 0, "cancel_requested": False, "input_cleanup_pending": False, "created_at": 10}
QUEUED = NEW | {"phase": "visible", "status": "queued", "canonical_options_json": "{}", "input_size_bytes": 5, "effective_max_audio_samples": 1000, "effective_direct_max_audio_samples": 100, "request_fingerprint": "a" * 64, "processor_fingerprint": "b" * 64}
RUNNING = QUEUED | {"status": "running", "attempt_no": 1, "attempt_token": "t", "owner_generation": "g", "started_at": 11}
DONE = RUNNING | {"status": "succeeded", "attempt_token": None, "owner_generation": None, "finished_at": 12, "total_samples": 50, "processed_samples": 50, "result_lease_id": "r", "input_cleanup_pending": True}
FAILED = DONE | {"status": "failed", "result_lease_id": None, "error_code": "e"}
CANCELLED = FAILED | {"status": "cancelled", "error_code": None, "cancel_requested": True}
BROKEN = [
    (NEW, set()), (QUEUED, set()), (RUNNING, set()), (DONE, set()), (FAILED, set()), (CANCELLED, set()), (QUEUED | {"status": "cancelled", "finished_at": 11, "input_lease_id": None}, set()), (DONE | {"phase": "deleting", "input_lease_id": None, "input_cleanup_pending": False}, set()),
    (NEW | {"total_samples": 1}, {"receiving"}), (NEW | {"phase": "deleting", "input_lease_id": None}, {"receiving"}), (NEW | {"phase": "gone"}, {"known_state"}), (NEW | {"phase": "visible"}, {"known_state"}), (QUEUED | {"status": "odd"}, {"known_state"}), (QUEUED | {"started_at": 11}, {"queued"}),
    (QUEUED | {"total_samples": 5}, {"queued"}), (QUEUED | {"phase": "deleting"}, {"deleted_when_done"}), (QUEUED | {"request_fingerprint": "A" * 64}, {"digests"}), (QUEUED | {"input_size_bytes": None}, {"described"}), (QUEUED | {"effective_direct_max_audio_samples": 1001}, {"caps"}), (QUEUED | {"effective_max_audio_samples": None}, {"caps", "described"}),
    (RUNNING | {"attempt_token": None}, {"running"}), (RUNNING | {"attempt_token": ""}, {"no_empty_texts"}), (RUNNING | {"started_at": 9}, {"times_in_order"}), (RUNNING | {"crash_recoveries": 2}, {"counts"}), (RUNNING | {"processed_samples": None}, {"counts", "within_caps"}), (DONE | {"processed_samples": 49}, {"succeeded"}),
    (DONE | {"total_samples": 2000, "processed_samples": 2000}, {"within_caps"}), (DONE | {"input_cleanup_pending": False}, {"cleanup_told"}), (FAILED | {"error_code": None}, {"failed"}), (CANCELLED | {"cancel_requested": False}, {"cancelled"}), (CANCELLED | {"finished_at": 10}, {"times_in_order"}),
]


def test_shapes_of_states(spark):
    df = spark.createDataFrame([tuple(x[n] for n in NAMES) for x, _ in BROKEN], JOB)
    rules = ledger.state_rules()
    got = df.select(*[F.coalesce(rule, F.lit(False)).alias(name) for name, rule in rules.items()]).collect()
    for row, (_, want) in zip(got, BROKEN):
        assert {name for name in rules if not row[name]} == want
    assert all(r["rows"] == 0 for r in ledger.violations(df.where("false"), rules).collect())
