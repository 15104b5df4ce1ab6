import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith import catalogue
from vocalith.functions import vectors as V
from vocalith.operators import matching, spectral
from vocalith.plans import diarization


def test_usable_and_unit(spark):
    values = [[1.0, 0.0], [0.6, 0.8], [3.0, 4.0], [0.0, 0.0], [1.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [], None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<double>")
    got = [tuple(r) for r in df.orderBy("i").select(V.usable(F.col("v"), 2), V.is_unit(F.col("v"), 2)).collect()]
    assert got == [(True, True), (True, True), (True, False)] + [(False, False)] * 7


def test_cosine_and_blob(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 20, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist(), a[i].astype("<f4").tobytes()) for i in range(20)], "i int, a array<float>, b array<float>, blob binary")
    got = df.orderBy("i").select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.from_blob("blob").alias("f"), V.to_blob("a").alias("t")).collect()
    for i, r in enumerate(got):
        x, y = a[i].astype(float), b[i].astype(float)
        assert r["c"] == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
        assert np.array_equal(np.float32(r["f"]), a[i]) and bytes(r["t"]) == a[i].tobytes()


def test_mean_unit(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("b", [-1.0, 0.0])], "k string, v array<double>")
    got = {r["k"]: r for r in V.mean_unit(df, ["k"], "v", 2).collect()}
    assert got["a"]["centroid"] == pytest.approx([0.5**0.5] * 2) and got["a"]["n"] == 2
    assert got["b"]["centroid"] is None


def test_mean_of_means_weighs_samples_alike(spark):
    df = spark.createDataFrame([("s", 1, [1.0, 0.0])] * 9 + [("s", 2, [0.0, 1.0])], "speaker string, sample int, v array<double>")
    assert matching.mean_of_means(df, "speaker", "sample", "v", 2).first()["centroid"] == pytest.approx([0.5**0.5] * 2)
    got = matching.consistency(df, "speaker", "sample", "v", 2, 0.0).first()
    assert got["pairs"] == 1 and got["least"] == pytest.approx(0) and got["consistent"]


PROFILES = [("1", "Ann", [1.0, 0.0, 0.0]), ("2", "Bob", [0.0, 1.0, 0.0]), ("3", "Cy", [0.0, 2.0, 0.0]), ("4", "Bad", [0.0, 0.0, 0.0])]


@pytest.mark.parametrize("vector,want", [([5.0, 1.0, 0.0], "1"), ([0.0, 1.0, 0.1], None), ([0.0, 0.0, 1.0], None), ([0.31, 0.0, (1 - 0.31**2) ** 0.5], "1"), ([0.3, 0.0, (1 - 0.3**2) ** 0.5], None), ([0.0, 0.0, 0.0], None), (None, None), ([1.0], None)])
def test_best_known(spark, vector, want):
    profiles = spark.createDataFrame(PROFILES, "id string, name string, embedding array<double>")
    clusters = spark.createDataFrame([("j", vector)], "k string, centroid array<double>")
    got = matching.best_known(clusters, profiles, ["k"], dim=3).first()
    assert got["id"] == want and (got["similarity"] is None) == (want is None)


def test_best_known_without_profiles_or_with_too_many(spark):
    clusters = spark.createDataFrame([("j", [1.0, 0.0])], "k string, centroid array<double>")
    none = spark.createDataFrame([], "id string, name string, embedding array<double>")
    assert matching.best_known(clusters, none, ["k"], dim=2).first()["id"] is None
    many = spark.range(257).select(F.col("id").cast("string"), F.lit("x").alias("name"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    with pytest.raises(ValueError):
        matching.best_known(clusters, many, ["k"], dim=2)


def blobs(sizes, seed=0, dim=16, noise=0.05):
    rng = np.random.default_rng(seed)
    x = np.concatenate([np.eye(dim)[i] + rng.normal(size=(n, dim)) * noise for i, n in enumerate(sizes)])
    return x / np.linalg.norm(x, axis=1, keepdims=True), np.repeat(np.arange(len(sizes)), sizes)


@pytest.mark.parametrize("sizes", [[20, 20], [12, 15, 18], [10, 10, 10, 10]])
def test_spectral_finds_separate_blobs(sizes):
    x, truth = blobs(sizes)
    assert np.array_equal(spectral.clustered(x, gap=0.2), truth)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_spectral_of_few_is_one_cluster(n):
    assert spectral.clustered(np.eye(4)[:n]).tolist() == [0] * n


def test_affinity_keeps_at_least_six():
    x, _ = blobs([10])
    a = spectral.affinity(x, keep=0.1)
    assert (np.count_nonzero(a, axis=1) >= 5).all() and np.allclose(a, a.T) and not a.diagonal().any()


def test_eigengap_takes_the_smallest_of_equal_steps():
    assert spectral.count(np.array([0.0, 0.0, 1.0, 2.0, 2.1]), np.ones(5) * 5, gap=0.4) == 2
    assert spectral.count(np.array([0.0, 0.9, 1.0, 1.1]), np.ones(4), gap=0.5) == 1


def test_by_recording_tells_what_it_refuses(spark, monkeypatch):
    x, truth = blobs([8, 8], dim=192)
    data = [("short", i * 12_000, i * 12_000 + 24_000, v.tolist()) for i, v in enumerate(x)] + [("long", 0, 30_000_000, x[0].tolist()), ("short", 0, 24_000, None)]
    df = spark.createDataFrame(data, "job_id string, start_sample long, end_sample long, embedding array<double>")
    got = {(r["job_id"], r["start"]): (r["ordinal"], r["error"]) for r in spectral.by_recording(df, gap=0.2).collect()}
    assert len(got) == 17 and got["long", 0] == (None, "too_long")
    assert [got["short", i * 12_000] for i in range(16)] == [(o, None) for o in truth.tolist()]
    got = {(r["job_id"], r["start"]): (r["ordinal"], r["error"]) for r in spectral.by_recording(df, most=16, gap=0.2).collect()}
    assert got["long", 0] == (None, "too_long") and {got["short", i * 12_000] for i in range(16)} == {(None, "too_many")} and len(got) == 17
    # One recording that does not settle leaves the others as they are.
    whole = spectral.clustered

    def clustered(x, *more):
        if len(x) == 1:
            raise ValueError
        return whole(x, *more)

    monkeypatch.setattr(spectral, "clustered", clustered)
    got = {(r["job_id"], r["start"]): (r["ordinal"], r["error"]) for r in spectral.by_recording(df, longest=None, gap=0.2).collect()}
    assert got["long", 0] == (None, "unsettled") and [got["short", i * 12_000] for i in range(16)] == [(o, None) for o in truth.tolist()]


def test_a_start_without_distance_left_is_dropped():
    assert sorted(set(spectral.kmeans(np.array([[0.0, 0.0]] * 3 + [[1.0, 0.0]] * 2), 2))) == [0, 1]
    with pytest.raises(ValueError):
        spectral.kmeans(np.zeros((4, 2)), 2)


@pytest.mark.parametrize("sizes,dim,noise,gap", [([40, 30], 16, 0.05, 0.2), ([12, 15, 18], 24, 0.05, 0.2), ([60, 50, 40], 32, 0.05, 0.3), ([90], 16, 0.3, 0.5), ([90], 16, 0.3, 0.2), ([50, 50], 8, 0.4, 0.1)])
def test_clusters_without_the_matrix_equal_those_with_it(sizes, dim, noise, gap):
    x, _ = blobs(sizes, dim=dim, noise=noise)
    values, vectors, degree = spectral.spectrum(spectral.affinity(x))
    product = spectral.Product(x)
    assert np.allclose(product.degree, degree)
    for s in np.r_[values[0] - 1e-6, (values[1:] + values[:-1])[np.diff(values) > 1e-9] / 2]:
        assert product.below(s) == (values < s).sum()
    k = spectral.count(values, degree, gap=gap)
    assert product.count(2.0, gap) == k
    if k > 1:
        y = product.lowest(k)
        assert np.allclose(y @ y.T, vectors[:, :k] @ vectors[:, :k].T, atol=1e-8)
    assert np.array_equal(spectral.clustered(x, gap=gap, dense=2), spectral.clustered(x, gap=gap))


def test_long_recordings_are_clustered_and_have_regions(spark, tmp_path):
    x, truth = blobs([8, 8], dim=192)
    data = [("long", spectral.LONGEST + i * 12_000, spectral.LONGEST + i * 12_000 + 24_000, v.tolist()) for i, v in enumerate(x)]
    windows = spark.createDataFrame(data, "job_id string, start_sample long, end_sample long, embedding array<double>")
    windows.write.parquet(f"{tmp_path}/speaker_embedding_windows.parquet")
    got = {r["start"]: r["ordinal"] for r in catalogue.queries()["recording_clusters"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [r[1] for r in data]
    speech = spark.createDataFrame([("long", spectral.LONGEST, spectral.LONGEST + 204_000)], "job_id string, start long, end long")
    made = diarization.regions(speech, windows, gap=0.2).collect()
    assert sum(r["end"] - r["start"] for r in made) == 204_000 and {r["label"] for r in made} == {"A", "B"}
