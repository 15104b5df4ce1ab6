import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from twins import same
from vocalith.llm import marks, queries, runs, splitting, turns

SPELLINGS = ["{}", "{} ", " {}", "Speaker {}", "SPK-{}", "spk {}:", "speaker_{}", "Unknown {}", "UNKNOWN  {}", "说话人{}"]
BASE = datetime(2026, 1, 1)


def brute_runs(events, gap):
    """events: (key, label, start, end) each once; runs (key, label, start, end, n)."""
    by = defaultdict(list)
    for k, x, s, e in events:
        if k is not None and s is not None and e is not None and e > s:
            by[k].append((s, e, x or ""))
    out = []
    for k, items in by.items():
        run = None
        for s, e, x in sorted(items):
            if run and run[1] == x and s <= run[3] + gap:
                run[3], run[4] = max(run[3], e), run[4] + 1
            else:
                run = [k, x, s, e, 1]
                out.append(run)
    return [(r[0], r[1] or None, *r[2:]) for r in out]


@pytest.mark.parametrize("chunk", [500, 20_000, 160_000_000])
@pytest.mark.parametrize("seed", range(3))
def test_collapse_runs_brute_force(spark, chunk, seed):
    r = random.Random(seed)
    events = {(r.choice("abc"), r.choice(["A", "B", None]), s := r.randint(0, 30_000), s + r.choice([-3, 0, 10, 300, 5000])) for _ in range(400)}
    once = {(k, s, e): x for k, x, s, e in events}
    events = [(k, x, s, e) for (k, s, e), x in once.items()] + [(None, "A", 1, 2), ("a", "A", None, 2)]
    df = spark.createDataFrame(events, "k string, l string, s long, e long").repartition(3)
    got = runs.collapse_runs(df, F.col("k"), F.col("l"), F.col("s"), F.col("e"), 200, chunk=chunk)
    key = lambda t: tuple((x is not None, x) for x in t)
    assert sorted((tuple(x) for x in got.select("key", "label", "start", "end", "n_events").collect()), key=key) == sorted(brute_runs(events, 200), key=key)
    assert got.where("duration <> end - start").count() == 0


def test_one_key_in_one_run_over_all_chunks(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), F.lit("X").alias("l"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 10).alias("e"))
    got = rows(runs.collapse_runs(df, F.col("k"), F.col("l"), F.col("s"), F.col("e"), 0, chunk=70), "start", "end", "n_events")
    assert got == [(0, 10_000, 1000)]


@pytest.mark.parametrize("label,letters", [("A", "A"), ("ａ", "A"), (" ab", "AB"), ("Speaker C", "C"), ("SPK-D", "D"), ("spk E:", "E"), ("speaker_f", "F"), ("UNKNOWN  g", "G"), ("说话人H", "H"), ("Unknown", None), ("", None), (None, None), ("　", None), ("speaker", None), ("???", None)])
def test_label_letters(spark, label, letters):
    df = spark.createDataFrame([(label,)], "v string")
    assert df.select(marks.label_letters(F.col("v"))).first()[0] == letters


REGION = "job_id string, start_sample long, end_sample long, anonymous_speaker string, received_at timestamp, label string, key string"


def test_regions_repeated_late_void_and_nameless(spark):
    at = lambda h: BASE + timedelta(hours=h)
    data = [
        ("j", 0, 100, "A", at(0), "clash", "x"), ("j", 0, 100, "spk A:", at(5), None, None), ("j", 50, 40, "B", at(0), None, None), ("j", 1700, 1800, "a", at(0), None, None), ("j", 3401, 3500, "A", at(0), None, None),
        ("j", 3600, 3700, None, at(0), None, None), ("j", 3650, 3800, "Unknown", at(0), None, None), ("j", 3900, 4000, "A", at(0), None, None), ("j", 4100, 4200, None, at(0), None, None), ("j", 4100, 4200, "Ａ", at(9), None, None),
        (None, 0, 5, "A", at(0), None, None), ("j", None, 5, "A", at(0), None, None), ("j", 0, None, "A", None, None, None), ("k", 0, 10, "", None, None, None),
    ]
    df = spark.createDataFrame(data, REGION)
    got = rows(runs.region_runs(df), "job_id", "speaker", "start_sample", "end_sample", "n_regions", "duration")
    assert got == [("j", "A", 0, 1800, 2, 1800), ("j", "A", 3401, 3500, 1, 99), ("j", "A", 3900, 4200, 2, 300)]


def test_nothing_gives_nothing(spark):
    assert runs.region_runs(spark.createDataFrame([], REGION)).count() == 0
    assert turns.speaker_turns(spark.createDataFrame([], RECORD)).count() == 0
    assert splitting.split_long_jobs(spark.createDataFrame([], "id string, total_samples long"), spark.createDataFrame([], RECORD)).count() == 0


RECORD = "job_id string, segment_index long, start_sample long, end_sample long, text string, language string, annotations struct<emotion:string,audio_event:string>, anonymous_speaker string, received_at timestamp, speaker string, label string"


def record(job, i, s, e, text, who=None, hours=0):
    return (job, i, s, e, text, None, None, who, BASE + timedelta(hours=hours), "clash", "clash")


SPEECH = [
    ("Yes.", True), ("好的。", True), ("um", False), ("Um... er,", False), ("嗯，好的。", True), ("唔係。", True), ("唔…", False), ("[laughter]", False), ("(door slams) Okay.", True), ("♪ ♪", False), ("<noise>", False), ("...", False), ("—", False),
    ("", False), (None, False), (" \t　", False), ("[00:01:45] uhm", False), ("00:02:33.266 ", False), ("02:33:17,266 --> 02:33:19,266 >> B: uh", False), ("A:", False), ("SPEAKER B -", False), ("<|en|><|SAD|><|Speech|><|woitn|>um, <noise>", False),
    ("【掌声】（叹气）", False), ("［笑い］", False), ("えっと…", False), ("어 맞아요.", True), ("[A] 12", True), ("*sighs* [background music]", False), ("((crosstalk))", False), ("{breath}", False), ("12:03 - Speaker A: Right.", True),
]


@pytest.mark.parametrize("text,spoken", SPEECH)
def test_spoken(spark, text, spoken):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(marks.split_marks(F.col("v"))[2]).first()[0] == spoken


HEADS = [("A: hi", "A"), ("spk_b: hi", "B"), ("Speaker AB: hi", "AB"), ("SPEAKER C - hi", "C"), ("说话人D：你好", "D"), ("E> hi", "E"), (">> F: hi", "F"), ("[G] hi", "G"), ("(Speaker h) hi", "H"), ("　[00:01:02] >> I: hi", "I"), ("<|en|><|SAD|><|Speech|><|withitn|>J: hi", "J"),
         ("[BGM] hi", None), ("hi", None), ("Er: hi", None), ("Well, A: hi", None), (None, None), ("04:05 - K: hi", "K"), ("(noise) L: hi", None)]


@pytest.mark.parametrize("text,who", HEADS)
def test_speaker_at_the_head(spark, text, who):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(marks.split_marks(F.col("v"))[0]).first()[0] == who


def test_turns(spark):
    data = [
        record("j", 0, 0, 1000, "hello", "A"), record("j", 1, 1000, 2000, "um", "B"), record("j", 2, 481_000, 482_000, "B: no, mine", "speaker_a"), record("j", 3, 962_001, 963_000, "later", "A"),
        record("j", 4, 962_500, 970_000, "B: overlap", None), record("j", 5, 980_000, 981_000, "yes", "Unknown B"), record("j", 5, 980_000, 981_000, "yes", "A", 9), record("j", 6, 990_000, 991_000, "[D] both", "Unknown"),
        record("none", 0, 0, 5, "words", None), record("none", 1, 5, 9, "words", "Unknown"), record(None, 0, 0, 5, "x", "A"), record("j", None, 0, 5, "x", "C"), record("j", 7, 5, 5, "x", "C"), record("j", 8, None, 5, "x", "C"),
    ]
    df = spark.createDataFrame(data, RECORD)
    want = [("j", "A", 0, 482_000, 2), ("j", "A", 962_001, 963_000, 1), ("j", "B", 962_500, 981_000, 2), ("j", "D", 990_000, 991_000, 1)]
    for chunk in (1000, 160_000_000):
        assert rows(turns.speaker_turns(df, chunk=chunk), "job_id", "speaker", "start_sample", "end_sample", "n_records") == want
        texts = rows(turns.turn_texts(df, chunk=chunk), "job_id", "segment_index", "turn", "speaker", "text")
        assert texts == [("j", 0, 0, "A", "hello"), ("j", 2, 0, "A", "no, mine"), ("j", 3, 3, "A", "later"), ("j", 4, 4, "B", "overlap"), ("j", 5, 4, "B", "yes"), ("j", 6, 6, "D", "both")]


def test_both_ways_of_splitting_marks_agree(spark, data):
    texts = [t for t, _ in SPEECH + HEADS] + ["　 x", "u" * 5000, "(" * 500, "[A]" * 50, "um" * 50, "A: B: C", "<|a|>" * 40, "x\u200b\ufeffy"]
    more = [r[0] for r in spark.read.parquet(f"{data}/segment_records.parquet").select("text").collect()]
    df = spark.createDataFrame([(t,) for t in texts + more], "v string")
    for r in df.select("v", *[c.alias(n) for c, n in zip(marks.split_marks(F.col("v")), "abc")]).collect():
        assert (r["a"], r["b"], r["c"]) == marks.split_text(r["v"]), r["v"]


def test_named_speakers(spark):
    data = [record("j", 0, 0, 1000, "hello", "Jorun Tarnfeld"), record("j", 1, 1000, 2000, "again", "jorun tarnfeld"), record("j", 2, 2000, 3000, "well", "Jorun  Tarnfelt"), record("j", 3, 3000, 4000, "yes", "Ketra Ashquill"), record("j", 4, 4000, 5000, "no", "B"), record("k", 0, 0, 9, "hi", "JORUN TARNFELD")]
    got = rows(turns.speaker_turns(spark.createDataFrame(data, RECORD)), "job_id", "speaker", "n_records")
    assert [g[0] for g in got] == ["j", "j", "j", "k"] and [g[2] for g in got if g[1].startswith("JORUN")] == [3, 1] and ("j", "B", 1) in got and ("j", "KETRA ASHQUILL", 1) in got


def test_labels_cluster_by_letters_initials_and_likeness():
    got = turns.cluster_labels(["A", "speaker a", "AB", "Spk_AB", "Jorun Tarnfeld", "jorun  tarnfeld", "Jorun Tarnfelt", "Jane Tucker", "unknown", ""])
    assert got["A"] == got["speaker a"] == "A" and got["AB"] == got["Spk_AB"] == "AB"
    assert got["Jorun Tarnfeld"] == got["jorun  tarnfeld"] == got["Jorun Tarnfelt"]
    assert got["Jane Tucker"] == "JANE TUCKER" and "unknown" not in got and "" not in got


def brute_pieces(size, spans, limit, overlap):
    ends = sorted({e for _, e in spans if 0 < e < size and not any(s < e < f for s, f in spans)})
    out, s = [], 0
    while size - s > limit:
        fit = [b for b in ends if s + overlap < b <= s + limit]
        e = fit[-1] if fit else s + limit
        out.append((s, e))
        s = e - overlap
    return [*out, (s, size)]


@pytest.mark.parametrize("chunk", [200, 160_000_000])
def test_split_brute_force(spark, chunk):
    r = random.Random(3)
    jobs, records, want = [], [], []
    for j in range(40):
        size, limit, overlap = r.choice([None, 900, 1000, 1001, r.randint(1001, 20_000)]), 1000, 80
        spans = [(s := r.randint(0, 20_000), s + r.randint(-2, r.choice([30, 400, 3000]))) for _ in range(r.choice([0, 3, 60, 200]))]
        jobs += [(f"j{j}", size), (f"j{j}", None if size is None else size - 5), (f"j{j}", None)]
        records += [record(f"j{j}", i, s, e, "x") for i, (s, e) in enumerate(spans)] * r.choice([1, 2])
        if size and size > limit:
            want += [(f"j{j}", s, e) for s, e in brute_pieces(size, spans, limit, overlap)]
    jobs += [(None, 99_999)]
    records += [record(None, 0, 0, 5, "x"), record("j1", None, None, 5, "x")]
    got = splitting.split_long_jobs(spark.createDataFrame(jobs, "id string, total_samples long").repartition(3), spark.createDataFrame(records, RECORD).repartition(3), 1000, 80, chunk)
    assert rows(got, "job_id", "start_sample", "end_sample") == sorted(want)
    assert got.where("natural and end_sample - start_sample > 1000").count() == 0


def test_split_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_split_brute_force(spark, 200)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_split_with_merge_joins_and_coalesced_partitions(spark):
    """Many jobs, no broadcast, far more shuffle partitions than data: a job's boundaries must still meet in one task."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in settings}
    jobs = spark.range(4000).selectExpr("concat('j', id) as id", "5000 + id % 900 as total_samples")
    records = spark.range(80_000).selectExpr("concat('j', id % 4000) as job_id", "floor(id / 4000) * 310 as start_sample", "floor(id / 4000) * 310 + 290 + id % 20 as end_sample")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = splitting.split_long_jobs(jobs, records, 1000, 80)
        found = rows(got, "job_id", "start_sample", "end_sample")
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = []
    for j in range(4000):
        spans = [(n * 310, n * 310 + 290 + (n * 4000 + j) % 20) for n in range(20)]
        want += [(f"j{j}", s, e) for s, e in brute_pieces(5000 + j % 900, spans, 1000, 80)]
    assert found == sorted(want)
    assert "Union" not in plan.split("MapInPandas")[-1]


def test_split_refuses_a_wide_overlap(spark):
    with pytest.raises(ValueError):
        splitting.split_long_jobs(spark.createDataFrame([], "id string, total_samples long"), spark.createDataFrame([], RECORD), 10, 10)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql_twin(spark, data, name):
    same(spark, data, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, data, name):
    assert queries.queries()[name](spark, data).count() > 0


def test_names_are_clustered_as_by_all_pairs():
    r = random.Random(8)
    stock = ["JORUN TARNFELD", "JANE TUCKER", "JORUNN TARNFELT", "KETRA ASHQUILL", "KETTRA ASHQUIL", "KIM AY", "ANNABEL LEE", "ANABEL LEE", "JO TO"]
    names = {"".join(c for c in n if r.random() > 0.04) for n in stock for _ in range(6)}
    got = turns.cluster_names(list(names))
    group = {n: {n} for n in names}
    for a in names:
        for b in names:
            like = min(turns.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in ((a, b), (b, a)))
            if len(a) > 3 and len(b) > 3 and turns._initials(a) == turns._initials(b) and like >= turns.SIMILAR and group[a] is not group[b]:
                both = group[a] | group[b]
                for n in both:
                    group[n] = both
    # What is alike both ways is joined; the canonical name is one of the class.
    assert all(got[a] == got[b] for a in names for b in group[a]) and set(got.values()) <= names
