import random

import pytest
from pyspark.sql import Window, functions as F

from conftest import rows
from vocalith.operators.ordered import along


@pytest.mark.parametrize("span", [1, 7, 50, 10_000])
def test_along_equals_plain_windows(spark, span):
    r = random.Random(span)
    data = [(r.choice(["a", "b", None]), i, r.choice([None, r.randint(0, 99)])) for i in r.sample(range(1000), 300)]
    df = spark.createDataFrame(data, "k string, o long, v long")
    got = along(df, "k", ["o"], span, prev={"p": F.col("v")}, next={"n": F.col("v")}, total={"t": F.col("v")}, top={"m": F.col("v")}, top_before={"b": F.col("v")}, last={"l": F.col("v")})
    df = df.where("k is not null")  # rows without a key are in no order
    w = Window.partitionBy("k").orderBy("o")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumns({"p": F.lag("v").over(w), "n": F.lead("v").over(w), "t": F.sum("v").over(w), "m": F.max("v").over(w), "b": F.max("v").over(past), "l": F.last("v", True).over(past)})
    assert rows(got) == rows(want, *got.columns)


def test_along_of_nothing(spark):
    df = spark.createDataFrame([], "k string, o long, v long")
    assert along(df, "k", ["o"], prev={"p": F.col("v")}).count() == 0
