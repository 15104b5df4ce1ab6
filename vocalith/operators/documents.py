"""Result documents of transcripts as JSON text: plain, verbose and with speakers, their parts, and strict checks of what a body holds.

A document is a sequence of fragments in the order of (section, segment_index), so that the longest recording's document never has to stand
in one row; ``bodies`` joins those of each job. Numbers and escapes are written as the wire format has them: seconds with as many digits as they
need, a duration of 0 without a fraction, control characters in lower-case hexadecimal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import escaped, quoted, seconds_text, strip
from .segments import pieces, spoken, summary

# Formats of results, and the parts on request with the annotation each is made of.
FORMATS = ["json", "text", "verbose_json", "diarized_json"]
RICH = {"emotion": "emotion", "audio_events": "audio_event"}
#: Sections of a document in order.
HEAD, TEXT, MIDDLE, SEGMENTS, TAIL, FIRST, BETWEEN, SECOND, END = range(9)


def with_options(jobs: DataFrame) -> DataFrame:
    """(job_id, format, language, rich, known, total): of each job its format, language, the parts on request, whether speakers are known, and its size.

    A job that is there several times has the options of the least text of them and the largest size; options that are no JSON of a known format give no row.
    """
    o = F.col("o")
    rows = jobs.where("id is not null").groupBy(F.col("id").alias("job_id")).agg(F.min("canonical_options_json").alias("o"), F.max("total_samples").cast("long").alias("total"))
    rich = F.transform(F.from_json(F.get_json_object(o, "$.include"), "array<string>"), lambda x: F.regexp_replace(x, r"\Afunasr\.", ""))
    known = F.size(F.from_json(F.get_json_object(o, "$.known_speaker_ids"), "array<string>")) > 0
    rows = rows.select("job_id", F.get_json_object(o, "$.response_format").alias("format"), F.get_json_object(o, "$.language").alias("language"), F.array_intersect(F.array(*map(F.lit, RICH)), F.coalesce(rich, F.array().cast("array<string>"))).alias("rich"), F.coalesce(known, F.lit(False)).alias("known"), "total")
    return rows.where(F.col("format").isin(FORMATS))


def parts(segments: DataFrame, options: DataFrame, names: DataFrame | None = None, span: int | None = None) -> DataFrame:
    """(job_id, section, segment_index, fragment, error) of the document of each job that has options and segments.

    The language of a verbose document is that asked for, with ``auto`` that of the first segment with text, else ``unknown``. Where ``total`` is NULL the last end counts. In a document with
    speakers the speaker is the label; with ``names`` (job_id, label, id, name, similarity) it is the name, with the match beside it, or ``Unknown`` and the label. A segment with text but
    without a label makes the document an error (unlabelled), whose only part is empty.
    """
    told = summary(segments).select("job_id", "last_end", F.col("language").alias("first_language"), (F.col("labelled") < F.col("with_text")).alias("unlabelled"))
    emotion, event = (F.when(spoken() & F.col(f"annotations.{a}").isNotNull(), F.col("segment_index")) for a in RICH.values())
    first = segments.groupBy("job_id").agg(F.min(F.when(spoken(), F.col("segment_index"))).alias("f_seg"), F.min(emotion).alias("f_emotion"), F.min(event).alias("f_audio_events"))
    jobs = options.join(told, "job_id").join(first, "job_id")
    error = F.when((F.col("format") == "diarized_json") & F.col("unlabelled"), "unlabelled")
    jobs = jobs.select("*", error.alias("error"))
    fmt, rich = F.col("format"), F.col("rich")
    listed, asked = fmt.isin("verbose_json", "diarized_json"), (F.size("rich") > 0) & (fmt != "text")
    total = F.coalesce("total", "last_end")
    duration = F.when(total == 0, "0").otherwise(seconds_text(total))
    language = F.when(F.col("language") != "auto", F.col("language")).otherwise(F.coalesce("first_language", F.lit("unknown")))
    head = (
        F.when(fmt == "text", "").when(fmt == "json", '{"text":"')
        .when(fmt == "verbose_json", F.concat(F.lit('{"task":"transcribe","language":'), quoted(language), F.lit(',"duration":'), duration, F.lit(',"text":"')))
        .otherwise(F.concat(F.lit('{"task":"transcribe","duration":'), duration, F.lit(',"text":"')))
    )
    opening = lambda i: F.concat(F.lit('"'), F.get(rich, F.lit(i)), F.lit('":['))
    fixed = [
        (HEAD, head), (MIDDLE, F.when(fmt == "text", "").when(listed, '","segments":[').otherwise('"')),
        (TAIL, F.concat(F.when(listed, "]").otherwise(""), F.when(asked, F.concat(F.lit(',"funasr":{'), opening(0))).otherwise(""))),
        (BETWEEN, F.when(asked & (F.size("rich") > 1), F.concat(F.lit("],"), opening(1))).otherwise("")),
        (END, F.concat(F.when(asked, "]}").otherwise(""), F.when(fmt == "text", "").otherwise("}"))),
    ]
    frame = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(-1).cast("long").alias("segment_index"), F.when(F.col("error").isNull(), x).otherwise("").alias("fragment")) for s, x in fixed])
    framed = jobs.select("job_id", "error", F.inline(frame)).where((F.col("section") == HEAD) | (F.col("fragment") != ""))

    sound = jobs.where("error is null").select("job_id", "format", "rich", "known", "f_seg", *[f"f_{k}" for k in RICH])
    text = pieces(segments, *([span] if span else [])).join(sound.select("job_id", "format"), "job_id")
    text = text.select("job_id", F.lit(None).cast("string").alias("error"), F.lit(TEXT).alias("section"), "segment_index", F.when(fmt == "text", F.col("piece")).otherwise(escaped(F.col("piece"))).alias("fragment"))

    rows = segments.where(spoken()).join(sound, "job_id").withColumn("label", F.col("anonymous_speaker"))
    if names is None:
        speaker, match = F.col("label"), F.lit("")
    else:
        rows = rows.join(names.select("job_id", "label", F.col("id").alias("m_id"), F.col("name").alias("m_name"), F.col("similarity").alias("m_like")), ["job_id", "label"], "left")
        speaker = F.coalesce("m_name", F.concat(F.lit("Unknown "), F.col("label")))
        match = F.when(F.col("m_name").isNotNull(), F.concat(F.lit(',"funasr":{"speaker_id":'), quoted(F.col("m_id")), F.lit(',"anonymous_speaker":'), quoted(F.col("label")), F.lit(',"similarity":'), F.col("m_like").cast("string"), F.lit("}"))).otherwise("")
    comma = lambda c: F.when(F.col("segment_index") == F.col(c), "").otherwise(",")
    bounds = F.concat(F.lit('"start":'), seconds_text(F.col("start_sample")), F.lit(',"end":'), seconds_text(F.col("end_sample")))
    spoken_text = F.concat(F.lit(',"text":'), quoted(strip(F.col("text"))))
    entry = F.when(fmt == "verbose_json", F.concat(bounds, spoken_text)).otherwise(F.concat(F.lit('"type":"transcript.text.segment",'), bounds, F.lit(',"speaker":'), quoted(speaker), spoken_text, match))
    entries = [(SEGMENTS, F.when(listed, F.concat(comma("f_seg"), F.lit('{"id":"'), F.col("segment_index").cast("string"), F.lit('",'), entry, F.lit("}"))))]
    for name, note in RICH.items():
        label = F.col(f"annotations.{note}")
        made = F.concat(comma(f"f_{name}"), F.lit('{"label":'), quoted(label), F.lit(","), bounds, F.lit("}"))
        entries.append((F.when(F.get(rich, F.lit(0)) == name, FIRST).otherwise(SECOND), F.when((fmt != "text") & F.array_contains(rich, name) & label.isNotNull(), made)))
    each = F.array(*[F.struct(F.lit(s).alias("section") if isinstance(s, int) else s.alias("section"), "segment_index", x.alias("fragment")) for s, x in entries])
    listed_rows = rows.select("job_id", F.lit(None).cast("string").alias("error"), F.inline(each)).where("fragment is not null")
    columns = ["job_id", "section", "segment_index", "fragment", "error"]
    return framed.select(columns).unionByName(text.select(columns)).unionByName(listed_rows.select(columns))


def bodies(fragments: DataFrame) -> DataFrame:
    """(job_id, body, error): the whole document of each job, one value a job; NULL where it is an error. For recordings whose document is too long for a row the parts are the result."""
    one = fragments.groupBy("job_id").agg(F.max("error").alias("error"), F.array_sort(F.collect_list(F.struct("section", "segment_index", "fragment"))).alias("l"))
    return one.select("job_id", F.when(F.col("error").isNull(), F.array_join(F.transform("l", lambda x: x["fragment"]), "")).alias("body"), "error")


# The members of a document and of its lists, in order.
_BODY = "task string, language string, duration double, text string, segments array<struct<id:string,type:string,start:double,end:double,speaker:string,text:string,funasr:struct<speaker_id:string,anonymous_speaker:string,similarity:double>>>, funasr struct<emotion:array<struct<label:string,start:double,end:double>>,audio_events:array<struct<label:string,start:double,end:double>>>"


def _again(b: Column, fmt: Column) -> Column:
    """The one text a parsed document can have been written as."""
    sec = lambda x: seconds_text(F.round(x * 16_000).cast("long"))
    bounds = lambda x: F.concat(F.lit('"start":'), sec(x["start"]), F.lit(',"end":'), sec(x["end"]))
    listing = lambda xs, one: F.concat(F.lit("["), F.array_join(F.transform(xs, one), ","), F.lit("]"))

    def match(x: Column) -> Column:
        m = x["funasr"]
        return F.when(m.isNull(), "").otherwise(F.concat(F.lit(',"funasr":{"speaker_id":'), quoted(m["speaker_id"]), F.lit(',"anonymous_speaker":'), quoted(m["anonymous_speaker"]), F.lit(',"similarity":'), m["similarity"].cast("string"), F.lit("}")))

    head = lambda x: F.concat(F.lit('{"id":'), quoted(x["id"]), F.lit(","))
    text = lambda x: F.concat(F.lit(',"text":'), quoted(x["text"]))
    plain = listing(b["segments"], lambda x: F.concat(head(x), bounds(x), text(x), F.lit("}")))
    named = listing(b["segments"], lambda x: F.concat(head(x), F.lit('"type":'), quoted(x["type"]), F.lit(","), bounds(x), F.lit(',"speaker":'), quoted(x["speaker"]), text(x), match(x), F.lit("}")))
    rich = [F.when(b["funasr"][k].isNotNull(), F.concat(F.lit(f'"{k}":'), listing(b["funasr"][k], lambda x: F.concat(F.lit('{"label":'), quoted(x["label"]), F.lit(","), bounds(x), F.lit("}"))))) for k in RICH]
    tail = F.concat(F.when(b["funasr"].isNull(), "").otherwise(F.concat(F.lit(',"funasr":{'), F.concat_ws(",", *rich), F.lit("}"))), F.lit("}"))
    whole = F.round(b["duration"] * 16_000).cast("long")
    length = F.concat(F.lit(',"duration":'), F.when(whole == 0, "0").otherwise(seconds_text(whole)))
    start, said = F.concat(F.lit('{"task":'), quoted(b["task"])), F.concat(F.lit(',"text":'), quoted(b["text"]))
    return (
        F.when(fmt == "json", F.concat(F.lit('{"text":'), quoted(b["text"]), tail))
        .when(fmt == "verbose_json", F.concat(start, F.lit(',"language":'), quoted(b["language"]), length, said, F.lit(',"segments":'), plain, tail))
        .when(fmt == "diarized_json", F.concat(start, length, said, F.lit(',"segments":'), named, tail))
    )


def body_errors(documents: DataFrame, body: str = "body", fmt: str = "format", total: str = "total") -> DataFrame:
    """``documents`` with ``error``: NULL, or the first of these a JSON body breaks.

    no_json; not_canonical: not the text its own content is written as, which no body with other, missing, repeated or reordered members, spaces or other forms of numbers is; bad_id: ids
    that are no rising numbers; bad_bounds: a segment that starts before 0 or the last end, does not end after its start or ends after the duration, or such a part on request;
    bad_duration: not that of ``total`` samples. Texts (format ``text``) have none.
    """
    b, f = F.col("__b"), F.col(fmt)
    rows = documents.withColumn("__b", F.from_json(F.col(body), _BODY, {"mode": "PERMISSIVE", "allowUnquotedControlChars": "false"}))
    segs, length = b["segments"], b["duration"]
    ids = F.transform(segs, lambda x: F.when(x["id"].rlike(r"\A[0-9]+\z"), x["id"].cast("long")))
    rising = F.aggregate(ids, F.lit(-1).cast("long"), lambda a, x: F.when(x > a, x)).isNotNull()
    # The last end, NULL from the first segment on that is out of bounds.
    sound = F.aggregate(segs, F.lit(0.0), lambda a, x: F.when((x["start"] >= a) & (x["end"] > x["start"]) & (x["end"] <= length), x["end"])).isNotNull()
    outside = [F.exists(F.coalesce(b["funasr"][k], F.from_json(F.lit("[]"), "array<struct<label:string,start:double,end:double>>")), lambda x: (x["start"] < 0) | (x["end"] <= x["start"]) | (x["end"] > length)) for k in RICH]
    listed = f.isin("verbose_json", "diarized_json")
    size = F.when(F.col(total) == 0, F.lit(0.0)).otherwise(F.col(total) / F.lit(16000.0))
    error = (
        F.when(f == "text", None).when(F.col(body).isNull() | F.json_object_keys(body).isNull() | b.isNull(), "no_json").when(~F.coalesce(_again(b, f) == F.col(body), F.lit(False)), "not_canonical")
        .when(listed & ~rising, "bad_id").when(listed & (~sound | outside[0] | outside[1]), "bad_bounds").when(listed & (length != size), "bad_duration")
    )
    return rows.withColumn("error", error).drop("__b")
