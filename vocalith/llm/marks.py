"""What is not speech in a transcript: time marks, model tags, speaker marks, sounds and fillers.

Every pattern is written in the common subset of Java's and Python's ``re`` syntax, so that the
same text serves ``regexp_replace`` in the JVM and ``re`` in Arrow batches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Hesitations of the languages of the corpus, as whole tokens.
FILLERS = [
    "u+h+", "u+m+", "u+h+m+", "h+m+", "e+r+", "e+r+m+", "m+h?m+", "a+h+m*", "euh+", "heu+", "e+h+",
    "[äÄ]+h+m*", "[öÖ]+h+m*", "嗯+", "呃+", "额+", "額+", "唔+", "えっと", "えーと", "ええと", "あのー?", "うーん+", "어+", "음+", "으음+",
]
# Hesitations that are also words, so only before a comma or stop.
PAUSED_FILLERS = ["hum", "este"]
# Words before a speaker's letters.
SPEAKER_WORDS = ["speaker", "spkr", "spk", "unknown", "说话人", "說話人", "話者", "화자", "sprecher", "locuteur", "locutor"]

TAG = r"<\|[^|>]{0,40}\|>"
CLOCK = r"[0-9]{1,6}:[0-9]{2}(?::[0-9]{2})?(?:[.,][0-9]{1,3})?"
TIME = (
    rf"[\[(<]\s?{CLOCK}\s?[\])>]|\[[0-9]+(?:\.[0-9]+)?s\]|{CLOCK}\s*-->\s*{CLOCK}"
    r"|[0-9]{1,6}:[0-9]{2}:[0-9]{2}[.,][0-9]{1,3}"
)
LEAD_TIME = r"^\s*[0-9]{1,6}:[0-9]{2} -(?=\s|$)"
SOUND = (
    r"\(\([^()\n]{0,60}\)\)|\([^()\n]{0,80}\)|（[^（）\n]{0,60}）|【[^【】\n]{0,60}】|［[^［］\n]{0,60}］|\[[^\[\]\n]{0,60}\]"
    r"|\{[^{}\n]{0,60}\}|\*[^*\n]{1,40}\*|<[^<>\n]{1,40}>|♪"
)
_WORDS = "|".join(SPEAKER_WORDS)
SPEAKER = (
    rf"^\s*(?:\[([A-Z]{{1,2}})\]|\((?i:(?:{_WORDS}))\s+([A-Za-z]{{1,3}})\)"
    rf"|(?:>>\s?)?(?i:(?:{_WORDS}))[\s_-]*([A-Za-z]{{1,3}})(?:\s?[:：>]|\s-(?=\s|$))"
    r"|(?:>>\s?)?([A-Z]{1,3})(?:\s?[:：>]))"
)
FILLER = rf"(?<![\p{{L}}\p{{N}}])(?i:(?:{'|'.join(FILLERS)})(?![\p{{L}}\p{{N}}])|(?:{'|'.join(PAUSED_FILLERS)})(?=\s?[,.，、…]))"
#: All white space, that beyond ASCII too (``\s`` differs between Java and Python).
SPACE = r"[\s\p{Z}\x{200B}\x{FEFF}]+"
#: A label as a whole: an optional word and the letters.
LABEL = rf"^(?:(?:{'|'.join(w.upper() for w in SPEAKER_WORDS)})[\s_-]*)?([A-Z]{{1,3}})\s*[:>]?$"
_WIDE = "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26)) + "：　"
_PLAIN = "".join(chr(65 + i) for i in range(26)) + "".join(chr(97 + i) for i in range(26)) + ": "


def label_letters(label: Column) -> Column:
    """The capitals a speaker label names (``speaker_a`` and full-width ``Ａ`` give ``A``), NULL where it names nobody."""
    plain = F.trim(F.regexp_replace(F.upper(F.translate(label, _WIDE, _PLAIN)), r"[\s ]+", " "))
    found = F.regexp_extract(plain, LABEL, 1)
    return F.when(found != "", found)


def split_marks(text: Column) -> tuple[Column, Column, Column]:
    """(the speaker's letters at the head of the text or NULL, the text without marks, whether it holds speech).

    Marks go in the order tags, times, speaker, sounds, fillers; a text of only these and punctuation is no speech.
    """
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), TAG, " ")
    bare = F.regexp_replace(F.regexp_replace(bare, TIME, " "), LEAD_TIME, " ")
    bare = F.regexp_replace(bare, r"^(?:\s|♪)+", "")
    named = F.upper(F.concat(*[F.coalesce(F.regexp_extract(bare, SPEAKER, i), F.lit("")) for i in range(1, 5)]))
    body = F.regexp_replace(F.regexp_replace(bare, SPEAKER, " "), SOUND, " ")
    clean = F.regexp_replace(body, FILLER + r"(?:\.{3}|[,，、…]+)?", " ")
    clean = F.trim(F.regexp_replace(clean, r"[\s 　]+", " "))
    return F.when(named != "", named), clean, clean.rlike(r"[\p{L}\p{N}]")


#: The wrapping of a JSON result line, up to its text, and what follows the text.
JSON_WRAP = r'^[^\S\n]*\{(?:"[a-z_]+":\s?[-0-9.a-z]+,\s?){0,6}"text":\s?"|"(?:,"[a-z_]+":[^{}\n]{0,80})?\}[^\S\n]*$|\\[nrt"]'
_JSON = re.compile(JSON_WRAP, re.M)
# Each branch begins with a fixed set of characters, which makes the search fast.
_ANY = re.compile(rf"{TAG}|{TIME}|{SOUND}")
#: Speaker marks at the head of a line; a line put into another's turn has several.
_HEAD = re.compile(
    rf"^(?:[^\S\n]*(?:[0-9]{{1,6}}:[0-9]{{2}} -[^\S\n]*)?(?:>>[^\S\n]?)?(?:(?i:{_WORDS})[^\S\n_-]*[_-]?[A-Za-z]{{1,3}}(?:[^\S\n]?[:：>]|[^\S\n]-(?=\s|$))|[A-Z]{{1,3}}[^\S\n]?[:：>]|>>))+", re.M
)
_LINE_TIME = re.compile(r"^[^\S\n]*[0-9]{1,6}:[0-9]{2} -(?=\s|$)", re.M)


def _by_first(pattern: str) -> tuple[str, str]:
    """The first sign (or class) of a filler and what follows it."""
    first = re.match(r"\[[^\]]*\]|.", pattern)[0]
    rest = pattern[len(first) :]
    return first, f"{first}*{rest[1:]}" if rest.startswith("+") else rest


def _fast_filler() -> re.Pattern:
    """``FILLER`` for ``re``: it begins with the class of the first signs, to which the search can leap, and looks back only there."""
    plain, paused = ([_by_first(p) for p in ps] for ps in (FILLERS, PAUSED_FILLERS))
    signs = sorted({x for first, _ in plain + paused for c in first.strip("[]") for x in (c.lower(), c.upper())})
    any_of = lambda parts: "|".join(f"(?<={first}){rest}" for first, rest in parts)
    return re.compile(rf"[{''.join(signs)}](?<![^\W_].)(?i:(?:{any_of(plain)})(?![^\W_])|(?:{any_of(paused)})(?=\s?[,.，、…]))")


_FILL = _fast_filler()


def _spaces(found: re.Match) -> str:
    text = found[0]
    return re.sub(r"[^\n]", " ", text) if "\n" in text else " " * len(text)


def blanked(text: str) -> str:
    """``text`` with marks overwritten by spaces, so that positions and line feeds stay as they are."""
    if '{"' in text:
        text = _JSON.sub(_spaces, text)
    return _LINE_TIME.sub(_spaces, _HEAD.sub(_spaces, _ANY.sub(_spaces, text)))


def without_fillers(text: str) -> str:
    """``text`` with fillers overwritten by spaces."""
    return _FILL.sub(_spaces, text)


_SPACE = re.compile(r"[\s\u200B\uFEFF]+")
_TAG, _TIME, _LEAD_TIME, _SOUND, _NAMED = (re.compile(x) for x in (TAG, TIME, LEAD_TIME, SOUND, SPEAKER))
_PAUSED = re.compile(_FILL.pattern + r"(?:\.{3}|[,，、…]+)?")
_SPOKEN = re.compile(r"[^\W_]")


def split_text(text: str | None) -> tuple[str | None, str, bool]:
    """What ``split_marks`` gives, for one text; many times faster in Arrow batches than the expressions are in the JVM."""
    bare = _LEAD_TIME.sub(" ", _TIME.sub(" ", _TAG.sub(" ", _SPACE.sub(" ", text or "")))).lstrip(" ♪")
    named = _NAMED.match(bare)
    body = _SOUND.sub(" ", bare[named.end() :] if named else bare)
    clean = _SPACE.sub(" ", _PAUSED.sub(" ", body)).strip()
    return next(g for g in named.groups() if g).upper() if named else None, clean, _SPOKEN.search(clean) is not None
