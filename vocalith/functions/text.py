"""Text: stripping, the joining rule for mixed scripts, speaker letters, control prefixes, canonical JSON and digests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# White space as Unicode defines it (``trim`` knows only U+0020).
WHITE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Scripts between whose characters no space is set (Hangul is spaced).
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
# Emotion and event tags of the recogniser and their names.
EMOTIONS = {"HAPPY": "happy", "SAD": "sad", "ANGRY": "angry", "NEUTRAL": "neutral", "FEARFUL": "fearful", "DISGUSTED": "disgusted", "SURPRISED": "surprised"}
EVENTS = {"Speech": "speech", "BGM": "bgm", "Applause": "applause", "Laughter": "laughter", "Cry": "cry", "Sneeze": "sneeze", "Breath": "breath", "Cough": "cough"}
# Tags that say nothing was recognised, and those of languages and of number writing.
UNSURE = {"emotion": "EMO_UNKNOWN", "audio_event": "Event_UNK"}
LANGUAGES = ["zh", "en", "yue", "ja", "ko"]
CONTROL = [*LANGUAGES, "auto", "nospeech", "withitn", "woitn"]
# What a tag that is not known must look like, and what its name begins with.
TAG_WORD, TAG_PREFIX = "[A-Za-z][A-Za-z0-9_]{0,63}", "unknown:sensevoice:"
# Fixed value: four tags before a text: language, emotion, event, number writing.
PREFIX = r"\A<\|([^|<>]{1,64})\|><\|([^|<>]{1,64})\|><\|([^|<>]{1,64})\|><\|([^|<>]{1,64})\|>"


def strip(text: Column) -> Column:
    """``text`` without white space at both ends, by the Unicode definition."""
    return F.regexp_replace(text, rf"\A{WHITE}+|(?<!{WHITE}){WHITE}+\z", "")


def is_blank(text: Column) -> Column:
    """Whether ``text`` is null or nothing but white space."""
    return F.length(strip(F.coalesce(text, F.lit("")))) == 0


def needs_space(left: Column, right: Column) -> Column:
    """Whether a space goes between two stripped, non-empty texts.

    None after an opening bracket or quote, before closing ones and other punctuation, nor beside Han or kana.
    """
    return ~(left.rlike(rf"[\p{{Ps}}\p{{Pi}}{UNSPACED}]\z") | right.rlike(rf"\A[\p{{Pe}}\p{{Pf}}\p{{Po}}{UNSPACED}]"))


def letters(ordinal: Column) -> Column:
    """The speaker label of an ordinal: 0 A, 25 Z, 26 AA, 701 ZZ, 702 AAA (bijective base 26, up to three letters)."""
    n = ordinal.cast("long")
    one = F.char(65 + F.pmod(n, F.lit(26)))
    two = F.char(65 + F.pmod(F.floor(n / 26) - 1, F.lit(26)))
    three = F.char(65 + F.pmod(F.floor((n - 26) / 676) - 1, F.lit(26)))
    return F.when(n < 0, None).when(n < 26, one).when(n < 702, F.concat(two, one)).when(n < 18278, F.concat(three, two, one))


def _mapped(tag: Column, names: dict[str, str], others: dict[str, str], slot: str) -> Column:
    """The name of a tag; a tag of another role, or one that is no word, gives NULL; unknown ones are kept with their slot."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    foreign = [*others, next(v for k, v in UNSURE.items() if k != slot), *CONTROL]
    return (
        F.when(F.map_contains_key(known, tag), F.try_element_at(known, tag))
        .when(~tag.isin(foreign) & matches(tag, TAG_WORD), F.concat(F.lit(f"{TAG_PREFIX}{slot}:"), tag))
    )


def control_prefix(raw: Column) -> Column:
    """The struct (valid, text, language, emotion, audio_event) of a recogniser's raw text.

    Valid needs four tags in their roles, of which the last is ``withitn``, and no further tag. ``nospeech`` is valid only with the unsure
    tags and an empty body (or a full stop); its text is empty and its language NULL. What is not valid has all else NULL.
    """
    language, emotion, event, itn = (F.regexp_extract(raw, PREFIX, i) for i in range(1, 5))
    body = F.regexp_replace(raw, PREFIX, "")
    feeling, sound = _mapped(emotion, EMOTIONS, EVENTS, "emotion"), _mapped(event, EVENTS, EMOTIONS, "audio_event")
    silent = (language == "nospeech") & (emotion == UNSURE["emotion"]) & (event == UNSURE["audio_event"]) & strip(body).isin("", ".")
    valid = F.coalesce(raw.rlike(PREFIX) & ~F.contains(body, F.lit("<|")) & (itn == "withitn") & (silent | (language.isin(LANGUAGES) & feeling.isNotNull() & sound.isNotNull())), F.lit(False))
    only = lambda c: F.when(valid, c)
    return F.struct(
        valid.alias("valid"), only(F.when(silent, "").otherwise(body)).alias("text"), only(F.when(~silent, language)).alias("language"),
        only(feeling).alias("emotion"), only(sound).alias("audio_event"),
    )


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Unicode case folding; ``lower`` keeps what folding joins (ß and SS)."""
    return text.map(str.casefold, na_action="ignore")


def escaped(text: Column) -> Column:
    """``text`` as it stands inside a JSON string: quotes, backslashes and control characters escaped, the latter in lower-case hexadecimal, nothing else."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    control = plain
    for c in map(chr, range(32)):
        control = F.replace(control, F.lit(c), F.lit(short.get(c, f"\\u{ord(c):04x}")))
    return F.when(text.rlike(r"[\x00-\x1F]"), control).otherwise(plain)


def quoted(text: Column) -> Column:
    """``text`` as a JSON string; NULL as null."""
    return F.coalesce(F.concat(F.lit('"'), escaped(text), F.lit('"')), F.lit("null"))


def seconds_text(samples: Column) -> Column:
    """Samples (0 or more) at 16,000 a second as the shortest decimal number of seconds, with one digit after the point at least; one sample is written 6.25e-05."""
    fraction = F.rtrim(F.lpad((F.pmod(samples, F.lit(16_000)) * 625).cast("string"), 7, "0"), F.lit("0"))
    return F.when(samples == 1, "6.25e-05").otherwise(F.concat(F.floor(samples / F.lit(16_000)).cast("string"), F.lit("."), F.when(fraction == "", "0").otherwise(fraction)))


def canonical_json(**fields: Column) -> Column:
    """One JSON object with keys in order, no spaces and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def matches(text: Column, pattern: str) -> Column:
    """Whether the whole text matches (``$`` would also match before a final line feed)."""
    return text.rlike(rf"\A(?:{pattern})\z")
