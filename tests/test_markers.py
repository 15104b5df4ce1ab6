import pytest

from conftest import rows
from vocalith.operators.markers import paired
from vocalith.streaming.speech import LONGEST, PAD, RING, ProtocolError, SpeechCutter

CASES = [
    ([(10, None), (None, 20)], ["opened", "closed"], [(160, 320)]),
    ([(10, 20), (20, 30)], ["complete", "complete"], [(160, 320), (320, 480)]),
    ([(None, 5)], ["unopened"], []),
    ([(10, None), (15, None)], ["opened", "nested"], []),
    ([(10, 20), (15, 30)], ["complete", "rollback"], [(160, 320)]),
    ([(10, None), (None, 10)], ["opened", "void"], []),
    ([(None, None)], ["void"], []),
    ([(None, 50), (10, None), (None, 20)], ["unopened", "opened", "closed"], [(160, 320)]),
    ([(30, 30), (10, None), (None, 20), (15, None)], ["void", "opened", "closed", "rollback"], [(160, 320)]),
    ([(-1, 5)], ["void"], []),
    ([(10, None), (None, 20), (20, None), (None, 25)], ["opened", "closed", "opened", "closed"], [(160, 320), (320, 400)]),
]


@pytest.mark.parametrize("span", [1, 1000])
@pytest.mark.parametrize("marks,outcomes,spans", CASES)
def test_paired(spark, marks, outcomes, spans, span):
    df = spark.createDataFrame([("k", i, b, e) for i, (b, e) in enumerate(marks)], "k string, o long, b long, e long")
    got = rows(paired(df, "k", ["o"], "b", "e", span), "o", "outcome", "start", "stop")
    assert [g[1] for g in got] == outcomes
    assert [(g[2], g[3]) for g in got if g[2] is not None] == spans


def test_cutter_pads_and_closes():
    c = SpeechCutter()
    c.advance(20_000)
    c.begin(10_000)
    c.advance(5_000)
    c.complete(24_000)
    assert c.take() == [(10_000, 24_000, 10_000 - PAD)]
    c.begin(24_000)
    assert c.pcm_start == 24_000


def test_cutter_cuts_at_the_bound_from_the_padded_start():
    c = SpeechCutter()
    c.advance(19_200)
    c.begin(10_000)
    c.advance(LONGEST)
    first = 10_000 - PAD + LONGEST
    assert c.take() == [(10_000, first, 10_000 - PAD)]
    c.complete(first - PAD)  # within the allowed step back after a forced cut
    assert c.take() == [] and c.watermark == first
    c.begin(first - 1)
    assert c.cursor == first


def test_cutter_exactly_at_the_bound():
    c = SpeechCutter()
    c.begin(0)
    c.advance(LONGEST - 1)
    assert c.take() == []
    c.advance(1)
    assert c.take() == [(0, LONGEST, 0)]


@pytest.mark.parametrize("acts", [[("begin", 0), ("begin", 5)], [("complete", 5)], [("advance", 100), ("begin", 50), ("complete", 40)], [("begin", 0), ("complete", 50)], [("advance", RING * 3), ("begin", 0)], [("advance", -1)]])
def test_cutter_refuses(acts):
    c = SpeechCutter()
    with pytest.raises(ProtocolError):
        for name, at in acts:
            getattr(c, name)(at)
