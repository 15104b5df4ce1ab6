import random
import re
import unicodedata

import numpy as np
from hypothesis import given, settings, strategies as st

from vocalith.llm import language, leaks, marks, pii

TEXT = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("\n\r\t []()<>{}|:*@._-+0123456789AaÄß你あア가♪　，。\"\\"))), max_size=80)
FEW = st.lists(TEXT, max_size=6)
WEIGHTS = np.zeros((language.BUCKETS, len(language.CODES)), np.float32)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_blanked_keeps_positions_and_lines(text):
    bare = marks.blanked(text)
    assert len(bare) == len(text) and all(b in (" ", t) for b, t in zip(bare, text)) and bare.count("\n") == text.count("\n")
    assert len(marks.without_fillers(bare)) == len(text)
    assert language.speech(text).count("\n") == text.count("\n")


@settings(max_examples=100, deadline=None)
@given(FEW)
def test_scores_have_a_row_for_each_line(texts):
    scores, letters = language.line_scores(texts, WEIGHTS)
    assert len(scores) == len(letters) == sum(t.count("\n") + 1 for t in texts)
    assert letters.sum() == sum(map(str.isalpha, "".join(texts)))


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_tokens_stand_where_they_say(text):
    words, places = leaks.tokens(text)
    for w, p in zip(words, places):
        assert unicodedata.normalize("NFKC", text[p]).casefold()[:1] == w[:1] or unicodedata.combining(text[p])


@settings(max_examples=100, deadline=None)
@given(FEW)
def test_pieces_lie_within_their_texts(texts):
    tokens = pii.Tokens(texts)
    assert (tokens.end > tokens.start).all() and (tokens.start[1:] >= tokens.end[:-1]).all()
    whole = "\n".join(texts)
    assert "".join(whole[s:e] for s, e in zip(tokens.start, tokens.end)) == "".join(c for c in whole if pii._chars()[0][ord(c)] not in (pii.SPACE, pii.BREAK))
    for d, _, s, e in pii.pieces(texts, pii.default_field()):
        assert 0 <= s < e <= len(texts[d])


@settings(max_examples=100, deadline=None)
@given(FEW)
def test_equal_words_have_equal_hashes(texts):
    tokens = pii.Tokens(texts)
    whole, fold = "\n".join(texts), pii._chars()[1]
    seen = {}
    for s, e, h in zip(tokens.start, tokens.end, tokens.word):
        key = tuple(int(fold[ord(c)]) for c in whole[s:e])
        assert seen.setdefault(key, h) == h and pii._hash_word(whole[s:e]) == int(h)


def test_the_fast_filler_pattern_is_the_plain_one():
    plain = re.compile(marks.FILLER.replace(r"[\p{L}\p{N}]", r"[^\W_]"))
    r = random.Random(5)
    for _ in range(20_000):
        text = "".join(r.choice("uhmerUHMEäÄö嗯呃额唔えっとーあのう어음으x, .,_1\nhumste") for _ in range(r.randint(0, 14)))
        assert marks._FILL.sub("#", text) == plain.sub("#", text), text
