import unicodedata

import pytest
from pyspark.sql import functions as F

from vocalith.functions import text
from vocalith.operators import segments


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_strip_is_unicode_strip(spark):
    values = [f"{chr(c)}a{chr(c)}b{chr(c)}" for c in range(1, 0x3100) if chr(c).isspace() or c % 97 == 0] + ["", " ", "　\t\n", None]
    assert column(spark, values, text.strip) == [v.strip() if v is not None else None for v in values]


def test_blank(spark):
    assert column(spark, ["", None, " 　", "x", ". "], text.is_blank) == [True, True, True, False, False]


def han_or_kana(ch):
    return any(w in unicodedata.name(ch, "") for w in ("CJK UNIFIED", "HIRAGANA LETTER", "KATAKANA LETTER"))


def plain_join(parts):
    out = ""
    for p in (p.strip() for p in parts):
        if not p:
            continue
        if out:
            left, right = out[-1], p[0]
            bare = unicodedata.category(left) in ("Ps", "Pi") or unicodedata.category(right) in ("Pe", "Pf", "Po") or han_or_kana(left) or han_or_kana(right)
            out += "" if bare else " "
        out += p
    return out


CASES = [
    ["hello", "world"], ["你好", "世界"], ["你好", "world"], ["hello", "世界"], ["안녕", "세계"], ["(", "a"], ["a", ")"], ["a", ", b"], ["“", "q"], ["q", "”"], ["カタ", "ひら"],
    ["a", "", " ", "b"], ["  a ", " b  "], ["。", "a"], ["a", "。"], ["1", "2"], ["a", "— b"], ["a", "-b"], ["\U00020000", "a"], [None, "a"], [""],
]


def test_joined_text(spark):
    rows = [(str(k), i, i * 10, i * 10 + 5, t, None, None, None) for k, parts in enumerate(CASES) for i, t in enumerate(parts)]
    df = spark.createDataFrame(rows, "job_id string, segment_index long, start_sample long, end_sample long, text string, language string, annotations struct<emotion:string,audio_event:string>, anonymous_speaker string")
    got = {r["job_id"]: r["text"] for r in segments.joined(df).collect()}
    want = {str(k): plain_join([p or "" for p in parts]) for k, parts in enumerate(CASES)}
    assert got == {k: v for k, v in want.items() if v}


def test_long_recordings_have_their_text(spark):
    data = [("long", 0, 0, 5, "a"), ("long", 1, segments.LONGEST, segments.LONGEST + 1, "b"), ("longer", 0, 0, 10 * segments.LONGEST, "c"), ("short", 0, 0, 5, "d")]
    df = spark.createDataFrame(data, "job_id string, segment_index long, start_sample long, end_sample long, text string")
    assert {r["job_id"]: r["text"] for r in segments.joined(df).collect()} == {"long": "a b", "longer": "c", "short": "d"}


def test_joining_in_any_chunks_gives_the_same(spark):
    parts = [p or "" for case in CASES for p in case]
    rows = [("j", i, i, i + 1, t, None, None, None) for i, t in enumerate(parts)]
    df = spark.createDataFrame(rows, "job_id string, segment_index long, start_sample long, end_sample long, text string, language string, annotations struct<emotion:string,audio_event:string>, anonymous_speaker string")
    for span in (1, 3, 1000):
        got = "".join(r["piece"] for r in segments.pieces(df, span).orderBy("segment_index").collect())
        assert got == plain_join(parts)


@pytest.mark.parametrize("n,label", [(0, "A"), (25, "Z"), (26, "AA"), (31, "AF"), (32, "AG"), (39, "AN"), (701, "ZZ"), (702, "AAA"), (18277, "ZZZ"), (18278, None), (-1, None)])
def test_letters(spark, n, label):
    assert spark.range(1).select(text.letters(F.lit(n))).first()[0] == label


@pytest.mark.parametrize(
    "raw,want",
    [
        ("<|en|><|HAPPY|><|Speech|><|withitn|>hi", (True, "hi", "en", "happy", "speech")),
        ("<|en|><|EMO_UNKNOWN|><|Event_UNK|><|withitn|>hi", (True, "hi", "en", "unknown:sensevoice:emotion:EMO_UNKNOWN", "unknown:sensevoice:audio_event:Event_UNK")),
        ("<|zh|><|HAPPY|><|Hum|><|withitn|>x", (True, "x", "zh", "happy", "unknown:sensevoice:audio_event:Hum")),
        ("<|zh|><|HAPPY|><|Speech|><|woitn|>x", (False, None, None, None, None)),
        ("<|zh|><|Speech|><|Speech|><|withitn|>x", (False, None, None, None, None)),
        ("<|zh|><|HAPPY|><|SAD|><|withitn|>x", (False, None, None, None, None)),
        ("<|fr|><|HAPPY|><|Speech|><|withitn|>x", (False, None, None, None, None)),
        ("<|nospeech|><|EMO_UNKNOWN|><|Event_UNK|><|withitn|> . ", (True, "", None, "unknown:sensevoice:emotion:EMO_UNKNOWN", "unknown:sensevoice:audio_event:Event_UNK")),
        ("<|nospeech|><|HAPPY|><|Event_UNK|><|withitn|>", (False, None, None, None, None)),
        ("<|en|><|HAPPY|><|Speech|><|withitn|>a<|b|>", (False, None, None, None, None)),
        ("plain", (False, None, None, None, None)), ("", (False, None, None, None, None)), (None, (False, None, None, None, None)),
    ],
)
def test_control_prefix(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "v string")
    assert tuple(df.select(text.control_prefix(F.col("v")).alias("p")).select("p.*").first()) == want


def test_casefold_joins_what_lower_keeps(spark):
    assert column(spark, ["Straße", "STRASSE", None], text.casefold) == ["strasse", "strasse", None]


def test_canonical_json_sorts_keys_and_keeps_nulls(spark):
    df = spark.range(1).select(text.canonical_json(b=F.lit(1), a=F.lit(None).cast("string"), c=F.lit("\"\\\n你")))
    assert df.first()[0] == '{"a":null,"b":1,"c":"\\"\\\\\\n你"}'


def test_matches_is_whole(spark):
    assert column(spark, ["AB", "AB\n", "xAB", None], lambda c: text.matches(c, "[A-Z]+")) == [True, False, False, None]
