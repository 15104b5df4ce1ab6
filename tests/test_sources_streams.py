import io
import re
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from twins import same
from vocalith import catalogue
from vocalith.operators import pcm, segments
from vocalith.sources import audio, envelope, jsonl, snapshots
from vocalith.streaming import markers as streams

SEGMENT = "job_id string, segment_index long, start_sample long, end_sample long, text string, language string, annotations struct<emotion:string,audio_event:string>, anonymous_speaker string"


def test_jsonl_round_trip(spark, tmp_path):
    data = [("a", 0, 0, 8000, '  你"\n\\  ', "zh", ("happy", None), None), ("a", 1, 8000, 16_000, "", None, (None, None), "A"), ("b", 0, 0, 1, "x", "en", (None, "speech"), "B")]
    df = spark.createDataFrame(data, SEGMENT)
    jsonl.write(df, str(tmp_path / "out"))
    back = jsonl.read(spark, str(tmp_path / "out"))
    assert back.where("error is not null").count() == 0
    assert rows(back, "job_id", "segment_index", "start_sample", "text", "annotations.emotion", "anonymous_speaker") == rows(df, "job_id", "segment_index", "start_sample", "text", "annotations.emotion", "anonymous_speaker")


def test_jsonl_refuses(spark, tmp_path):
    good = '{"annotations":{"audio_event":null,"emotion":null},"anonymous_speaker":null,"end_sample":1,"index":0,"language":null,"start_sample":0,"text":"x"}'
    (tmp_path / "x.txt").write_text("\n".join([good, "nonsense", good.replace('"text"', '"txt"'), good[:-1] + ',"more":1}', good.replace('"index":0', '"index":"q"')]))
    got = [r["error"] for r in jsonl.read(spark, str(tmp_path / "x.txt")).collect()]
    assert got[0] is None and got[1] == "no_json" and got[2] == got[3] == "unknown_key" and got[4] is not None


def test_envelope(spark, tmp_path):
    df = spark.createDataFrame([("é\nbody",), ("",)], "body string")
    files = [r["envelope"] for r in envelope.sealed(df, "text/plain").collect()]
    broken = [files[0] + "x", files[0].replace("body", "bodY"), "no manifest", "\n"]
    for i, text in enumerate(files + broken):
        (tmp_path / f"{i}.bin").write_bytes(text.encode())
    got = {r["path"].rsplit("/", 1)[1]: (r["body"], r["error"]) for r in envelope.read(spark, str(tmp_path)).collect()}
    assert got["0.bin"] == ("é\nbody", None) and got["1.bin"] == ("", None)
    assert [got[f"{i}.bin"][1] for i in (2, 3, 4, 5)] == ["wrong_size", "wrong_digest", "no_manifest", "no_manifest"]


def test_audio(spark, tmp_path):
    x = (np.arange(20_000) % 3000 - 1500).astype("<i2")
    for name, rate, channels in (("mono", 16_000, 1), ("stereo", 8_000, 2)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(np.repeat(x, channels).tobytes())
    (tmp_path / "bad.wav").write_bytes(b"RIFFnope")
    files = audio.files(spark, str(tmp_path))
    probes = {r["path"].rsplit("/", 1)[1]: r for r in audio.probes(files).collect()}
    assert probes["mono.wav"]["seconds"] == 1.25 and probes["stereo.wav"]["channels"] == 2 and probes["bad.wav"]["error"] == "unreadable"
    blocks = audio.decoded(files).where(F.col("path").endswith("mono.wav")).orderBy("start_sample").collect()
    assert [len(b["pcm"]) for b in blocks] == [9600, 9600, 800]
    assert np.array_equal(np.concatenate([b["pcm"] for b in blocks]), x)
    doubled = audio.decoded(files).where(F.col("path").endswith("stereo.wav")).agg(F.sum(F.size("pcm"))).first()[0]
    assert doubled == 40_000
    filled = spark.createDataFrame([([16384, -32768],)], "p array<smallint>").select(audio.window_pcm(F.col("p"), 4)).first()[0]
    assert filled == [0.5, -1.0, 0.0, 0.0]


@pytest.mark.parametrize("seconds,budget", [(0, 30), (10, 30), (100, 210), (1e6, 43_200)])
def test_decode_budget(spark, seconds, budget):
    assert spark.range(1).select(audio.decode_budget(F.lit(float(seconds)))).first()[0] == budget


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_samples_of_other_widths(width):
    want = [0, 256, -256, 12_800, -32_768, 32_512]
    if width == 1:
        data = bytes((x >> 8) + 128 for x in want)
    else:
        data = b"".join((x << 8 * (width - 2)).to_bytes(width, "little", signed=True) for x in want)
    assert audio._samples(data, width, 2).tolist() == [want[0:2], want[2:4], want[4:6]]
    assert len(audio._samples(data[:-1], width, 2)) == 2 and len(audio._samples(b"", width, 1)) == 0


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    assert snapshots.version(spark, root) is None
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, root)
    assert snapshots.publish(spark.range(3), root, None) == 1
    assert snapshots.publish(snapshots.read(spark, root).where("id > 0"), root, 1) == 2
    with pytest.raises(RuntimeError):
        snapshots.publish(spark.range(9), root, 1)
    assert not [f for f in (tmp_path / "t").iterdir() if f.name.startswith("CURRENT.")]
    assert snapshots.read(spark, root).count() == 2 and snapshots.read(spark, root, 1).count() == 3


def drain(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def stream_of(spark, tmp_path, frames, schema):
    for i, data in enumerate(frames):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_marker_stream_keeps_state_over_batches(spark, tmp_path):
    schema = "k string, o long, b long, e long"
    frames = [[("x", 0, 10, None), ("y", 0, None, 5)], [("x", 1, None, 20), ("y", 1, 7, 9)], [("x", 2, 15, 30), ("y", 2, 9, None)]]
    out = drain(spark, streams.spans(stream_of(spark, tmp_path, frames, schema), "k", "o", "b", "e"), "spans_out")
    assert rows(out) == sorted([("x", 160, 320, "closed"), ("x", None, None, "rollback"), ("y", None, None, "unopened"), ("y", 112, 144, "complete")], key=lambda r: (r[0], r[1] is not None, r[1] or 0))


def test_cut_stream(spark, tmp_path):
    schema = "k string, o long, n long, b long, e long"
    frames = [[("x", 0, 20_000, 10_000, None)], [("x", 1, 480_000, None, None)], [("x", 2, 1000, None, 495_000), ("x", 3, None, 1, None), ("x", 4, 5, None, None)]]
    out = rows(drain(spark, streams.cuts(stream_of(spark, tmp_path, frames, schema), "k", "o", "n", "b", "e"), "cuts_out"), "start", "stop", "pcm_start", "error")
    assert (10_000, 486_800, 6_800, None) in out and (486_800, 495_000, 486_800, None) in out
    assert [r for r in out if r[3]] and len(out) == 3


def test_counts_and_sessions(spark, tmp_path):
    base = pd.Timestamp("2024-01-01")
    at = lambda m: (base + pd.Timedelta(minutes=m)).to_pydatetime()
    schema = "u string, t timestamp"
    frames = [[("a", at(1)), ("a", at(5)), ("b", at(11))], [("a", at(500)), ("a", at(900))]]
    source = stream_of(spark, tmp_path, frames, schema)
    got = rows(drain(spark, streams.counts(source, "t", ["u"]), "counts_out"), "u", "n")
    assert ("a", 2) in got and ("b", 1) in got
    batch = spark.createDataFrame([r for f in frames for r in f], schema)
    assert rows(streams.sessions(batch, "t", "u"), "u", "n") == [("a", 1), ("a", 1), ("a", 2), ("b", 1)]
    early, late = streams.with_late(batch.withColumn("seen", F.expr("t + interval 1 minute")), "t", "seen", 30)
    assert early.count() == 0 and late.count() == 5


def test_late_rows_are_counted_apart(spark, tmp_path):
    at = lambda m: (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)).to_pydatetime()
    schema = "u string, t timestamp, seen timestamp"
    frames = [[("a", at(1), at(2)), ("a", at(5), at(6))], [("a", at(900), at(900))], [("a", at(3), at(901)), ("b", at(890), at(901)), ("a", None, at(902))], [("a", at(2000), at(2000))], [("a", at(2000), at(2000))]]
    source = stream_of(spark, tmp_path, frames, schema)
    got = rows(drain(spark, streams.counts(source, "t", ["u"], seen="seen"), "late_out"), "u", "late", "n")
    assert got == sorted([("a", False, 2), ("a", False, 1), ("a", True, 2), ("b", False, 1)])
    batch = spark.createDataFrame([r for f in frames for r in f], schema)
    assert sum(r["n"] for r in streams.sessions(batch, "t", "u", seen="seen").collect()) == batch.count()


def test_segments_once_and_projections(spark):
    schema = SEGMENT + ", received_at timestamp"
    base = pd.Timestamp("2026-01-01").to_pydatetime()
    data = [("a", 0, 0, 8000, " hello ", "en", ("happy", None), "A", base), ("a", 1, 8000, 16_000, " \t ", "ja", ("x", "y"), None, base), ("a", 2, 24_000, 32_000, "你", None, (None, "speech"), "B", base)]
    late = ("a", 0, 0, 8000, "later", "en", None, "Z", pd.Timestamp("2026-01-02").to_pydatetime())
    df = segments.once(spark.createDataFrame([*data, late, (None, 0, 0, 1, "x", None, None, None, None), data[2]], schema))
    assert rows(df, "segment_index", "text") == [(0, " hello "), (1, " \t "), (2, "你")]
    s = segments.summary(df).first()
    assert (s["records"], s["with_text"], s["labelled"], s["last_end"], s["language"], s["labels"]) == (3, 2, 2, 32_000, "en", ["A", "B"])
    assert rows(segments.verbose(df), "id", "start", "end", "text") == [("0", 0.0, 0.5, "hello"), ("2", 1.5, 2.0, "你")]
    assert rows(segments.rich(df), "kind", "label") == [("audio_event", "speech"), ("emotion", "happy")]
    names = spark.createDataFrame([("a", "A", "Alice")], "job_id string, label string, name string")
    assert rows(segments.diarized(df, names), "speaker") == [("Alice",), ("Unknown B",)]
    assert rows(segments.diarized(df), "speaker") == [("A",), ("B",)]
    assert rows(segments.dense(df), "dense_index") == [(0,), (1,), (2,)]
    assert segments.label_use(df).first()["use"] == "all"


@pytest.fixture(scope="module")
def odd_regions(spark, tmp_path_factory):
    """A folder with speaker_regions of odd lengths, repeated, void and without a job."""
    folder = tmp_path_factory.mktemp("regions")
    data = [("a", s, s + n, label) for s, n in ((0, 1), (0, 9600), (7, 9601), (7, 12_000), (7, 12_001), (5, 15_000), (5, 90_000), (9, 0), (9, -4)) for label in ("A", None)] + [(None, 0, 5, "A"), ("b:1", 2, 30, "B"), ("b", 12, 30, "B")]
    df = spark.createDataFrame(data, "job_id string, start_sample long, end_sample long, anonymous_speaker string")
    df.toPandas().to_parquet(folder / "speaker_regions.parquet")
    return str(folder)


def moved(spark, folder, name):
    """Columns of sounds or samples that the plan of a query has between its steps."""
    plan = catalogue.queries()[name](spark, folder)._jdf.queryExecution().toString()
    return sorted({w for w in ("content", "pcm") if re.search(rf"\b{w}#", plan)})


def test_window_samples_moves_no_samples(spark, odd_regions):
    same(spark, odd_regions, catalogue.queries()["window_samples"], catalogue.oracle_sql()["window_samples"])
    assert moved(spark, odd_regions, "window_samples") == []


def test_cut_equals_cut_out(spark):
    blocks = [("a", 3, [1, 2, 3]), ("a", 6, [4, 5]), ("a", 11, [6])]
    spans = [(0, 2), (0, 20), (4, 7), (8, 11), (5, 12)]
    want = pcm.cut_out(spark.createDataFrame([("a", *s) for s in spans], "job_id string, start long, end long"), spark.createDataFrame(blocks, "job_id string, start long, pcm array<smallint>"))
    for r in want.collect():
        x, covered = pcm.cut([(s, np.array(x, np.int16)) for _, s, x in blocks], r["start"], r["end"])
        assert (x.tolist(), covered) == (r["pcm"], r["covered"])


def test_wav_blocks_moves_no_samples(spark, odd_regions):
    same(spark, odd_regions, catalogue.queries()["wav_blocks"], catalogue.oracle_sql()["wav_blocks"])
    assert moved(spark, odd_regions, "wav_blocks") == []


def test_blocks_of_many_files_share_a_batch():
    data = io.BytesIO()
    with wave.open(data, "wb") as w:
        w.setparams((1, 2, 16_000, 0, "NONE", "not compressed"))
        w.writeframes(np.arange(25, dtype="<i2").tobytes())
    got = list(audio._batched([("x", data.getvalue()), ("bad", b"RIFFnope"), ("y", data.getvalue()), ("z", data.getvalue())], 10, 40))
    assert [b.num_rows for b in got] == [5, 4] and list(audio._batched([("bad", b"")], 10)) == []
    rows = [(r["path"], r["start_sample"], r["pcm"]) for b in got for r in b.to_pylist()]
    assert rows == [(p, s, list(range(s, min(25, s + 10)))) for p in "xyz" for s in (0, 10, 20)]
