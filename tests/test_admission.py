import pytest
from pyspark.sql import functions as F

from conftest import rows
from vocalith.operators import admission, identity

OPTIONS = [
    (("x", "auto", None, None, None, None), "invalid_model"), ((None, "auto", None, None, None, None), "invalid_model"), (("sensevoice", "de", None, None, None, None), "invalid_language"), (("sensevoice", None, None, None, None, None), "invalid_language"),
    (("sensevoice", "auto", None, "vad", None, None), "invalid_chunking_strategy"), (("sensevoice-diarize", "auto", "diarized_json", None, None, None), "diarization_requires_vad"),
    (("sensevoice-diarize", "auto", None, "auto", None, None), "diarization_requires_format"), (("sensevoice-diarize", "auto", "json", "auto", None, None), "diarization_requires_format"), (("sensevoice", "auto", "diarized_json", None, None, None), "diarized_format_requires_model"),
    (("sensevoice", "auto", "srt", None, None, None), "invalid_response_format"), (("sensevoice", "auto", "", None, [], []), None), (("sensevoice", "auto", None, None, ["words"], None), "invalid_include"), (("sensevoice", "auto", "text", None, ["funasr.emotion"], None), "incompatible_response_format"),
    (("sensevoice-diarize", "zh", "diarized_json", "auto", ["funasr.emotion"], ["00000001", "00000002"]), None), (("sensevoice-diarize", "zh", "diarized_json", "auto", None, ["00000001", "00000001"]), "invalid_known_speaker_ids"), (("sensevoice-diarize", "zh", "diarized_json", "auto", None, ["0000000I"]), "invalid_known_speaker_ids"),
    (("sensevoice-diarize", "zh", "diarized_json", "auto", None, [f"000000{i:02}" for i in range(33)]), "invalid_known_speaker_ids"), (("sensevoice", "zh", None, None, None, ["00000001"]), "known_speakers_require_diarization"), (("sensevoice-diarize", "zh", "diarized_json", "auto", None, [None]), "invalid_known_speaker_ids"),
]


def test_the_first_rule_that_options_break(spark):
    df = spark.createDataFrame([(i, *o) for i, (o, _) in enumerate(OPTIONS)], "n int, m string, l string, f string, c string, i array<string>, k array<string>")
    got = rows(df.select("n", admission.option_error(*map(F.col, "mlfcik")).alias("e")), "n", "e")
    assert got == [(i, e) for i, (_, e) in enumerate(OPTIONS)]


def test_lengths_and_caps(spark):
    cases = [(1801.0, True, True, True, "diarization_too_long"), (1800.0, True, True, True, None), (43_201.0, False, True, False, "audio_too_long"), (31.0, False, False, True, "long_audio_requires_vad"), (30.0, False, False, True, None), (3601.0, False, True, True, "async_required"), (3601.0, False, True, False, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "n int, s double, d boolean, c boolean, w boolean, want string")
    error = admission.length_error(F.col("s"), F.col("d"), F.col("c"), F.col("w"), F.lit(43_200), F.lit(30), F.lit(3_600))
    assert df.where(~error.eqNullSafe(F.col("want"))).count() == 0
    caps = spark.createDataFrame([(0, 691_200_000, 480_000, None), (1, 691_200_001, 1, "bad_most"), (2, None, 1, "bad_most"), (3, 100, 101, "bad_direct"), (4, 100, 100, None), (5, 10**8, 480_001, "bad_direct"), (6, 5, None, "bad_direct")], "n int, a long, b long, want string")
    assert caps.where(~admission.cap_error(F.col("a"), F.col("b")).eqNullSafe(F.col("want"))).count() == 0
    assert spark.range(1).select(admission.direct_cap(F.lit(20), F.lit(43_200)), admission.direct_cap(F.lit(90), F.lit(43_200)), admission.direct_cap(F.lit(90), F.lit(3))).first()[:] == (320_000, 480_000, 48_000)


def test_one_bad_row_rejects_its_batch(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 1, True), ("b", 1, True), ("b", 1, False), ("c", 1, None), (None, 2, True)], "k string, n int, ok boolean")
    assert rows(admission.whole_batches(df, ["k"], F.col("ok")), "k", "n") == [("a", 1), ("a", 1)]


def test_zipped_arrays_have_one_length(spark):
    df = spark.createDataFrame([([1, 2], ["a", "b"]), ([1], ["a", "b"]), ([], []), (None, ["a"])], "x array<int>, y array<string>")
    got = [r[0] and [tuple(p) for p in r[0]] for r in df.select(admission.zipped(F.col("x"), F.col("y"))).collect()]
    assert got == [[(1, "a"), (2, "b")], None, [], None]


def test_lookup_and_repeats(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, n int")
    found, missing = admission.lookup(table, spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "id string"))
    assert rows(found) == [("a", 1)] and rows(missing) == [("z",)]
    assert rows(admission.repeated(table.unionByName(table.limit(1)), ["id"])) == [("a", 2)]


TILES = [
    ([(0, 100)], [(0, 50), (50, 100)], []), ([(0, 100)], [(0, 50), (60, 100)], [("uncovered", 0, 100, 10)]), ([(0, 100)], [(0, 60), (50, 100)], [("twice", 0, 100, 10)]), ([(0, 100)], [(0, 100), (200, 300)], [("outside", 200, 300, 100)]),
    ([(0, 50), (50, 100)], [(0, 100)], []), ([(0, 10), (20, 30)], [(0, 30)], []), ([(0, 10)], [], [("uncovered", 0, 10, 10)]), ([], [(0, 5)], [("outside", 0, 5, 5)]), ([(0, 10)], [(0, 10), (7, 7), (9, 3)], []),
]


@pytest.mark.parametrize("speech,segs,want", TILES)
def test_tiling(spark, speech, segs, want):
    frame = lambda xs: spark.createDataFrame([("j", *x) for x in xs] + [(None, 0, 9)], "job_id string, start long, end long")
    assert rows(admission.tiling_errors(frame(speech), frame(segs)), "kind", "start", "end", "samples") == want


def test_lists_in_texts(spark):
    df = spark.createDataFrame([("a, RESPOND-ASYNC ",), ("respond-async;q=1",), (None,)], "v string")
    assert [r[0] for r in df.select(admission.prefers_async(F.col("v"))).collect()] == [True, False, False]
    df = spark.createDataFrame([("mov,mp4",), ("mov,exe",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(admission.container_error(F.col("v"))).collect()] == [None, "invalid_audio", "invalid_audio", "invalid_audio"]


def test_sweep_takes_what_is_deleted_first(spark):
    data = [("a", "visible", "failed", 5), ("b", "visible", "succeeded", 3), ("c", "deleting", "succeeded", 9), ("d", "visible", "running", 1), ("e", "visible", "cancelled", 50), ("f", "visible", "failed", 3), ("f", "visible", "failed", 3)]
    df = spark.createDataFrame(data, "id string, phase string, status string, t long").withColumn("finished_at", F.timestamp_seconds("t"))
    assert [r["id"] for r in admission.sweep(df, F.timestamp_seconds(F.lit(10)), 3).collect()] == ["c", "b", "f"]
    assert admission.sweep(df.where("false"), F.timestamp_seconds(F.lit(10))).count() == 0


def test_generation_and_ids(spark):
    df = spark.createDataFrame([("a", "7"), ("b", "8"), ("c", None)], "id string, g string")
    marker = spark.createDataFrame([("8",)], "generation string")
    assert rows(admission.generation_of(df, "g", marker)) == [("a", "7", False), ("b", "8", True), ("c", None, False)]
    assert rows(admission.generation_of(df, "g", marker.where("false")), "current") == [(False,)] * 3
    ids = [r[0] for r in spark.range(200).select(identity.random_id(5)).collect()]
    assert len(set(ids)) == 200 and all(len(i) == 8 and set(i) <= set(identity.ALPHABET) for i in ids)


def test_manifests_do_not_depend_on_the_order_of_files(spark):
    data = [("k", "b", 2, "y"), ("k", "a", 1, "x"), ("k", "a", 1, "x"), (None, "a", 1, "x"), ("m", None, 1, "x"), ("m", "a", None, None)]
    df = spark.createDataFrame(data, "key string, p string, n long, d string")
    got = rows(identity.manifest_digests(df.repartition(3), "key", "p", "n", "d"), "key", "files", "fingerprint")
    assert got == rows(identity.manifest_digests(df.coalesce(1), "key", "p", "n", "d"), "key", "files", "fingerprint") and [g[:2] for g in got] == [("k", 2), ("m", 1)]
