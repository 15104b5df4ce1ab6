import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from vocalith.functions.text import escaped, quoted, seconds_text
from vocalith.operators import documents, resources

SEGMENT = "job_id string, segment_index long, start_sample long, end_sample long, text string, language string, annotations struct<emotion:string,audio_event:string>, anonymous_speaker string"
OPTIONS = "job_id string, format string, language string, rich array<string>, known boolean, total long"
TEXTS = ["", "plain", 'a "b" \\ /', "\n\r\t\b\f", "\x00\x01\x0b\x1b\x1f\x7f", "你好   é 𠮷", "\\u001B", None]


@pytest.mark.parametrize("text", TEXTS)
def test_strings_are_written_as_json_has_them(spark, text):
    df = spark.createDataFrame([(text,)], "v string")
    got = df.select(quoted(F.col("v")), escaped(F.col("v"))).first()
    assert got[0] == json.dumps(text, ensure_ascii=False) and (text is None or f'"{got[1]}"' == got[0])


@pytest.mark.parametrize("samples", [0, 1, 2, 15, 16, 8_000, 16_000, 16_001, 123_456_789, 691_200_000, 10**12 + 7])
def test_seconds_are_the_shortest_numbers(spark, samples):
    assert spark.range(1).select(seconds_text(F.lit(samples).cast("long"))).first()[0] == json.dumps(samples / 16_000)


def segment(index, start, end, text, speaker=None, emotion=None, event=None, language="en", job="j"):
    return (job, index, start, end, text, language, (emotion, event), speaker)


def made(spark, data, options, names=None):
    parts = documents.parts(spark.createDataFrame(data, SEGMENT).repartition(3), spark.createDataFrame(options, OPTIONS), names)
    return {r["job_id"]: (r["body"], r["error"]) for r in documents.bodies(parts).collect()}


DATA = [segment(0, 0, 8_000, " Hi ", "A", "happy", None, None), segment(1, 8_000, 8_001, " ", "A"), segment(2, 9_000, 17_000, 'say "x"', "B", None, "bgm", "ko")]


def plain(fmt, **more):
    return ("j", fmt, *({"language": "auto", "rich": [], "known": False, "total": 32_000} | more).values())


def test_documents_of_each_format(spark):
    segs = [{"id": "0", "start": 0.0, "end": 0.5, "text": "Hi"}, {"id": "2", "start": 0.5625, "end": 1.0625, "text": 'say "x"'}]
    rich = {"emotion": [{"label": "happy", "start": 0.0, "end": 0.5}], "audio_events": [{"label": "bgm", "start": 0.5625, "end": 1.0625}]}
    compact = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    joined = 'Hi say "x"'
    assert made(spark, DATA, [plain("text", rich=["emotion"])]) == {"j": (joined, None)}
    assert made(spark, DATA, [plain("json")]) == {"j": (compact({"text": joined}), None)}
    assert made(spark, DATA, [plain("json", rich=["emotion", "audio_events"])]) == {"j": (compact({"text": joined, "funasr": rich}), None)}
    assert made(spark, DATA, [plain("json", rich=["audio_events"])]) == {"j": (compact({"text": joined, "funasr": {"audio_events": rich["audio_events"]}}), None)}
    want = {"task": "transcribe", "language": "unknown", "duration": 2.0, "text": joined, "segments": segs}
    assert made(spark, DATA, [plain("verbose_json")]) == {"j": (compact(want), None)}
    assert made(spark, DATA, [plain("verbose_json", language="ja", total=None)]) == {"j": (compact(want | {"language": "ja", "duration": 1.0625}), None)}
    named = [{"id": s["id"], "type": "transcript.text.segment", "start": s["start"], "end": s["end"], "speaker": w, "text": s["text"]} for s, w in zip(segs, "AB")]
    whole = {"task": "transcribe", "duration": 2.0, "text": joined, "segments": named, "funasr": rich}
    assert made(spark, DATA, [plain("diarized_json", rich=["emotion", "audio_events"])]) == {"j": (compact(whole), None)}
    names = spark.createDataFrame([("j", "B", "00000001", "Ann", 0.5)], "job_id string, label string, id string, name string, similarity double")
    named[0]["speaker"], named[1] = "Unknown A", named[1] | {"speaker": "Ann", "funasr": {"speaker_id": "00000001", "anonymous_speaker": "B", "similarity": 0.5}}
    assert made(spark, DATA, [plain("diarized_json")], names) == {"j": (compact({k: v for k, v in whole.items() if k != "funasr"}), None)}


def test_documents_of_nothing_and_of_unlabelled_segments(spark):
    blank = [segment(0, 0, 0, "  ", "A")]
    assert made(spark, blank, [plain("verbose_json", total=0, rich=["emotion"])]) == {"j": ('{"task":"transcribe","language":"unknown","duration":0,"text":"","segments":[],"funasr":{"emotion":[]}}', None)}
    assert made(spark, [*DATA, segment(3, 20_000, 21_000, "who", None)], [plain("diarized_json")]) == {"j": (None, "unlabelled")}
    assert made(spark, [], [plain("json")]) == {} and made(spark, DATA, []) == {}


def test_options_of_jobs(spark):
    data = [("a", '{"include":["funasr.audio_events","emotion"],"known_speaker_ids":["00000001"],"language":"ko","response_format":"json"}', 5), ("a", None, 9), ("b", '{"response_format":"srt"}', 1), ("c", "no json", 1), (None, '{"response_format":"text"}', 1), ("d", '{"response_format":"text","include":null}', None)]
    got = rows(documents.with_options(spark.createDataFrame(data, "id string, canonical_options_json string, total_samples long")))
    assert got == [("a", "json", "ko", ["emotion", "audio_events"], True, 9), ("d", "text", None, [], False, None)]


GOOD = '{"task":"transcribe","language":"en","duration":2.0,"text":"Hi","segments":[{"id":"0","start":0.0,"end":0.5,"text":"Hi"},{"id":"2","start":0.5,"end":2.0,"text":"x"}]}'
BODIES = [
    (GOOD, None), ("", "no_json"), (None, "no_json"), ("[1]", "no_json"), ('{"text":', "no_json"), (GOOD + " ", "not_canonical"), (GOOD.replace('"text":"Hi",', '"text":"Hi","more":1,', 1), "not_canonical"),
    (GOOD.replace('"task":"transcribe"', '"task":"transcribe","task":"transcribe"'), "not_canonical"), (GOOD.replace("2.0", "2.00", 1), "not_canonical"), (GOOD.replace("2.0", "2", 1), "not_canonical"), (GOOD.replace("0.0", "NaN"), "no_json"),
    (GOOD.replace('"language":"en",', ""), "not_canonical"), (GOOD.replace("Hi", "\\u0048i"), "not_canonical"), (GOOD.replace('"id":"2"', '"id":"0"'), "bad_id"), (GOOD.replace('"id":"2"', '"id":"x"'), "bad_id"),
    (GOOD.replace('"start":0.5', '"start":0.25'), "bad_bounds"), (GOOD.replace('"end":0.5', '"end":0.0'), "bad_bounds"), (GOOD.replace("2.0,\"text\":\"x\"", '2.5,"text":"x"'), "bad_bounds"), (GOOD.replace('"duration":2.0', '"duration":3.0'), "bad_duration"),
]


def test_bodies_are_read_strictly(spark):
    df = spark.createDataFrame([(i, b, "verbose_json", 32_000) for i, (b, _) in enumerate(BODIES)], "n int, body string, format string, total long")
    got = rows(documents.body_errors(df), "n", "error")
    assert got == [(i, e) for i, (_, e) in enumerate(BODIES)]
    assert documents.body_errors(df.where("false")).count() == 0
    simple = spark.createDataFrame([('{"text":"x"}', "json", 0), ("anything", "text", 0), ('{"text":"x","funasr":{"emotion":[{"label":"a","start":0.0,"end":0.5}]}}', "json", 0)], "body string, format string, total long")
    assert [r["error"] for r in documents.body_errors(simple).collect()] == [None, None, None]


def test_resources(spark):
    data = [("a", "queued", 8_000, None, None, None), ("b", "failed", 0, 5, "worker_crashed", "2026-01-02 03:04:05"), ("c", "failed", 0, 5, None, "2026-01-02 03:04:05.5"), ("d", "cancelled", 0, None, None, "2026-01-02 03:04:05"), ("e", "succeeded", 1, 1, None, None)]
    df = spark.createDataFrame(data, "id string, status string, processed_samples long, total_samples long, error_code string, f string").withColumn("finished_at", F.to_timestamp("f"))
    got = {r["id"]: r["resource"] and json.loads(r["resource"]) for r in resources.jobs(df).collect()}
    assert got["a"] == {"id": "a", "status": "queued", "progress": {"processed_audio_secs": 0.5, "total_audio_secs": None}} and got["e"] is None
    assert got["b"]["error"]["code"] == "worker_crashed" and got["c"]["error"]["code"] == "internal_error" and got["c"]["finished_at"] == "2026-01-02T03:04:05.500000Z"
    assert got["d"] == {"id": "d", "status": "cancelled", "finished_at": "2026-01-02T03:04:05Z"}
