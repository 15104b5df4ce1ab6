from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from vocalith.llm import clusters, components, encoding


def brute_groups(x, close):
    label = list(range(len(x)))
    like = x @ x.T >= close
    for i in range(len(x)):
        label[i] = min(label[i], *(label[j] for j in range(i) if like[i, j])) if like[i, :i].any() else i
    return label


def voices(sizes, seed=0, dim=192, noise=0.036):
    rng = np.random.default_rng(seed)
    centres = np.linalg.qr(rng.normal(size=(dim, len(sizes))))[0].T
    x = np.concatenate([c + rng.normal(size=(n, dim)) * noise for c, n in zip(centres, sizes)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


SIZES = [1] * 20 + [2] * 40 + [7] * 10 + [300]


@pytest.mark.parametrize("rows_a_cell", [16_000, 1, 0.001])
def test_groups_equal_brute_force(spark, rows_a_cell):
    x = voices(SIZES)
    x *= np.random.default_rng(1).uniform(0.2, 6, size=(len(x), 1))
    order = np.random.default_rng(2).permutation(len(x))
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in order], "id long, v array<double>").repartition(4)
    got = {r["vector_id"]: r["group_id"] for r in clusters.similarity_groups(df, "id", "v", cell_rows=rows_a_cell).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = unit @ unit.T
    assert not ((like > 0.65) & (like < 0.7)).any()  # what the operator asks of its input
    want = brute_groups(unit, 0.675)
    right = sum(got[i] == want[i] for i in range(len(x)))
    assert len(got) == len(x) and right >= 0.999 * len(x)


@pytest.mark.parametrize("shares", [100_000, 3])
def test_pairs_at_the_lower_bound_meet_at_every_depth(spark, monkeypatch, shares):
    """Pairs of cosine 0.705 and none else: each is found by the grids alone, whatever the depth."""
    monkeypatch.setattr(clusters, "SHARE_ROWS", shares)
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=(2, 400, 192))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.705 * a + (1 - 0.705**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    df = spark.createDataFrame([(int(2 * i + k), v.tolist()) for i in range(400) for k, v in enumerate((a[i], b[i]))], "id long, v array<double>").repartition(8)
    want = [(i - i % 2, i) for i in range(800)]
    for rows_a_cell in (16_000, 3, 0.001) if shares > 3 else (16_000,):
        got = rows(clusters.similarity_groups(df, "id", "v", cell_rows=rows_a_cell), "group_id", "vector_id")
        assert sum(x == y for x, y in zip(sorted(got, key=lambda g: g[1]), want)) >= 798


def test_crowded_cells_are_cut_without_losing_a_link(spark, monkeypatch):
    monkeypatch.setattr(clusters, "CROWD_ROWS", 2)
    monkeypatch.setattr(clusters, "CROWD_SHARE", 10**9)
    test_pairs_at_the_lower_bound_meet_at_every_depth(spark, monkeypatch, 100_000)
    test_groups_equal_brute_force(spark, 16_000)


def test_a_cell_of_many_heads_equals_all_pairs():
    x = voices([1] * 150 + [3] * 30, noise=0.03).astype(np.float32)
    ids = np.arange(len(x)) * 3
    cell, got = clusters._Cell(0.675), []
    for s in range(0, len(x), 17):
        got += cell.assign(5, ids[s : s + 17], x[s : s + 17]).tolist()
    assert got == [3 * i for i in brute_groups(x.astype(float), 0.675)]
    assert len(cell.heads) < 10

@pytest.mark.parametrize("depth", [1, 2, 3])
def test_vectors_at_the_lower_bound_share_cells_as_often_as_counted_on(depth):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 20_000, 192))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.7 * a + 0.51**0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    axes, chance = clusters.GRIDS[depth]
    x, y = a.astype(np.float32)[:5000], b.astype(np.float32)[:5000]
    shared = np.mean([(clusters._cells(x, t, depth, axes)[:, :, None] == clusters._cells(y, t, depth, axes)[:, None]).any((1, 2)) for t in range(1, 7)])
    assert shared > chance * 0.97


def test_unusable_repeated_and_lone(spark):
    a, b = voices([2, 1]).tolist()[:2], voices([2, 1]).tolist()[2]
    bad = [[0.0] * 192, [float("nan")] + [1.0] * 191, [float("inf")] + [1.0] * 191, [None] + [1.0] * 191, [1.0] * 191, [], None]
    data = [(5, a[0], "x"), (3, a[1], "y"), (5, a[0], "z"), (9, b, None), (9, b, None), (None, a[0], None)] + [(100 + i, v, None) for i, v in enumerate(bad)]
    df = spark.createDataFrame(data, "id long, v array<double>, cell string")
    assert rows(clusters.similarity_groups(df, "id", "v"), "group_id", "vector_id") == [(3, 3), (3, 5), (9, 9)]
    assert rows(clusters.similarity_groups(df, "id", "v", alone=False), "group_id", "vector_id") == [(3, 3), (3, 5)]
    assert clusters.similarity_groups(df.where("false"), "id", "v").count() == 0
    groups = clusters.similarity_groups(df, "id", "v")
    made = clusters.described(groups, df, "id", "v").orderBy("group_id").collect()
    assert [(r["group_id"], r["size"]) for r in made] == [(3, 2), (9, 1)] and set(made[0]["typical"]) == {3, 5} and made[1]["typical"] == [9]
    dense = clusters.densest(groups).orderBy("group_id").collect()
    assert [(r["group_id"], r["size"]) for r in dense] == [(3, 2), (9, 1)] and all(r["dense"] <= r["size"] and len(r["members"]) == min(5, r["dense"]) for r in dense)
    assert clusters.described(groups.where("false"), df, "id", "v").count() == 0


def test_typical_members_are_nearest_to_the_centre(spark):
    x = voices([40, 3, 1], seed=9)
    group = [0] * 40 + [40] * 3 + [43]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    groups = spark.createDataFrame([(g, i) for i, g in enumerate(group)], "group_id long, vector_id long")
    got = {r["group_id"]: (r["size"], r["typical"]) for r in clusters.described(groups, df, "id", "v").collect()}
    for g, n in ((0, 40), (40, 3), (43, 1)):
        own = [i for i in range(44) if group[i] == g]
        like = x[own] @ x[own].mean(0)
        assert got[g] == (n, [own[i] for i in np.argsort(-like)[:5]])


def test_least_labels(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(180, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["label"] for r in components.least_labels(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}
    assert components.least_labels(spark.createDataFrame([], "a long, b long")).count() == 0


tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    try:
        t = tokenizers.Tokenizer.from_file(encoding.VOCABULARY)
    except Exception:
        pytest.skip("no vocabulary file")
    t.encode_special_tokens = True
    return t


ODD = ["", " ", "a", "Hello world", "it's we'll I'VE", "  two  spaces \n\n x", "你好，世界。", "こんにちは", "안녕하세요 세계", "👩‍💻 ok", "<|endoftext|>", "½ × 3", "áé", "\x1c\x85 　﻿", "x" * 5000, "的" * 3000, "\U0010ffff", "1234567890" * 30, "\r\n\t\x0b"]


def test_ids_equal_the_public_tokenizer(spark, reference):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(99, None, "x"), (None, "n", "x"), (1, " ", "again")], "doc_id long, text string, ids string").repartition(3)
    got = encoding.encode_texts(df).collect()
    want = {i: reference.encode(t, add_special_tokens=False).ids for i, t in enumerate(ODD)} | {99: [], None: reference.encode("n", add_special_tokens=False).ids}
    assert len(got) == len(ODD) + 3
    assert all(r["ids"] == want[r["doc_id"]] for r in got)


def test_random_texts_equal_the_public_tokenizer(reference):
    from hypothesis import given, settings, strategies as st

    bpe = encoding.load(encoding.VOCABULARY)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
    def check(text):
        ids = array("i")
        bpe.encode(text, ids)
        assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids

    check()


def test_whole_corpus_round_trip(spark, data, reference):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = encoding.encode_texts(docs).join(docs.select("doc_id", "text"), "doc_id").where(F.col("text").isNotNull()).collect()
    assert all(r["ids"] == reference.encode(r["text"], add_special_tokens=False).ids for r in got)
