import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from vocalith.operators import identity

OPTIONS = '{"chunking_strategy":null,"include":[],"known_speaker_ids":[],"language":"auto","model":"sensevoice","response_format":"json"}'
# Fixed value: the digest that version 1 gives for these options, 64 times "a" and a snapshot of no speakers.
GOLDEN = "b143205c1ee7e1c7fb65461d7c306315de5733572a51c824b9f8229aa15707f3"


def test_request_fingerprint(spark):
    df = spark.createDataFrame([(OPTIONS, "a" * 64, b'{"speakers":[],"version":1}'), (OPTIONS, "A" * 64, None), ("{}", "a" * 64, None), (None, None, None)], "o string, d string, s binary")
    got = [r[0] for r in df.select(identity.request_fingerprint(F.col("o"), F.col("d"), F.col("s"))).collect()]
    assert got == [GOLDEN, None, None, None]


@pytest.mark.parametrize(
    "text,error",
    [(OPTIONS, None), (None, "no_json"), ("", "no_json"), ("[1]", "no_json"), ("{", "no_json"), (OPTIONS.replace("model", "modle"), "unknown_key"), (OPTIONS[:-1] + ',"x":1}', "unknown_key"), (OPTIONS.replace(",", ", "), "not_canonical"), (OPTIONS.replace('"auto"', '"' + "a" * 5000 + '"'), "too_long")],
)
def test_options_error(spark, text, error):
    df = spark.createDataFrame([(text,)], "o string")
    assert df.select(identity.options_error(F.col("o"))).first()[0] == error


def test_snapshot_round_trip(spark):
    blob = lambda i: np.full(4, i, "<f4").tobytes()
    df = spark.createDataFrame([("j", "b", "Bo", blob(2)), ("j", "a", "Añ", blob(1)), ("j", "a", "Añ", blob(1)), ("k", "c", "Cy", blob(3))] + [("many", f"{i:03d}", "x", blob(0)) for i in range(33)], "job string, id string, name string, embedding binary")
    made = identity.packed(df, "job")
    texts = {r["job"]: r["snapshot"] and bytes(r["snapshot"]).decode() for r in made.collect()}
    assert texts["many"] is None and texts["k"].startswith('{"speakers":[{"embedding":"') and texts["k"].endswith('"id":"c","name":"Cy"}],"version":1}')
    back = rows(identity.unpacked(made.where("snapshot is not null"), "snapshot", ["job"]), "job", "position", "id", "name", "embedding")
    assert back == [("j", 0, "a", "Añ", [1.0] * 4), ("j", 1, "b", "Bo", [2.0] * 4), ("k", 0, "c", "Cy", [3.0] * 4)]


def test_unordered_or_broken_snapshots_give_nothing(spark):
    df = spark.createDataFrame([("j", b'{"speakers":[{"id":"b"},{"id":"a"}],"version":1}'), ("k", b"nope"), ("l", None)], "job string, s binary")
    assert identity.unpacked(df, "s", ["job"]).count() == 0
