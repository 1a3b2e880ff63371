"""Batched k-means against plain numpy, and its measures against the SQL-checked operators."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from strata.operators import kmeans_batch as kb
from strata.operators import segments as K


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.6, (60, 3)) for c in ([0, 0, 0], [6, 0, 0], [0, 6, 1])])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    return x, df.select("id", array_to_vector("v").alias("features"))


def lloyd(x, w, centres):
    for _ in range(101):
        near = kb.squared_distances(x, centres).argmin(axis=1)
        new = np.array([w[near == j] @ x[near == j] / w[near == j].sum() if w[near == j].any() else centres[j] for j in range(len(centres))])
        if ((new - centres) ** 2).sum(axis=1).max() <= 1e-8:
            return centres, float(w @ kb.squared_distances(x, centres).min(axis=1))
        centres = new


def test_runs_equal_separate_ones(blobs):
    """Runs of different k, starts and resamples in one batch end where each would alone."""
    data = kb.keyed(blobs[1], "id")
    rows = data.orderBy("key").collect()
    keys, x = np.array([r["key"] for r in rows], np.int64), np.array([r["x"] for r in rows])
    runs = [kb.Run(k, s, b) for k in (2, 3, 5) for s in (0, 1) for b in (None, 4)]
    for run in kb.fit_runs(data, runs):
        w = kb.weights(keys, run.resample)
        start = kb._plus_plus(x, w, run.k, np.random.default_rng([run.start, run.k, (run.resample or -1) + 1]))
        centres, cost = lloyd(x, w, start)
        assert np.allclose(run.centres, centres, atol=1e-9) and run.cost == pytest.approx(cost)


def test_weights_are_poisson():
    w = kb.weights(np.arange(100_000, dtype=np.int64) * 7919, 3)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert (w == kb.weights(np.arange(100_000, dtype=np.int64) * 7919, 3)).all() and not (w == kb.weights(np.arange(100_000, dtype=np.int64) * 7919, 4)).all()


def test_measures_equal_the_operators(blobs):
    data = kb.keyed(blobs[1], "id")
    models = [kb.best_of(kb.fit_runs(data, [kb.Run(k, s) for s in range(3)])) for k in (3, 4)]
    for m, got in zip(models, kb.quality(data, models), strict=True):
        near = kb.squared_distances(blobs[0], m.centres).argmin(axis=1)
        lng = blobs[1].sparkSession.createDataFrame(
            [(i, int(near[i]), d, float(v)) for i, p in enumerate(blobs[0]) for d, v in enumerate(p)], "id long, cluster int, dim int, value double")
        want = (K.silhouette(lng, "id").first()[0], K.davies_bouldin(lng, "id").first()[0], K.calinski_harabasz(lng, "id").first()[0])
        assert got == pytest.approx(want, rel=1e-9)


def test_choose_k_and_stability_on_planted_clusters(blobs, spark):
    rows = {r["k"]: r for r in K.choose_k(blobs[1], "id", range(2, 6)).collect()}
    assert max(rows, key=lambda k: rows[k]["silhouette"]) == 3
    assert all(rows[k]["inertia"] >= rows[k + 1]["inertia"] for k in (2, 3, 4))
    found = {r["k"]: r for r in K.bootstrap_stability(blobs[1], "id", range(3, 5), n_boot=4, seeds=range(4)).collect()}
    assert found[3]["ari_mean"] > 0.99 and found[4]["ari_mean"] < found[3]["ari_mean"]
    assert [r["inertia"] for r in K.choose_k(blobs[1].limit(0), "id", range(2, 4)).collect()] == [None, None]
    table = np.array([[5.0, 1], [2, 7]])
    pairs = spark.createDataFrame([(i, j) for i in (0, 1) for j in (0, 1) for _ in range(int(table[i, j]))], "a int, b int")
    assert kb.adjusted_rand(table) == pytest.approx(K.ari(pairs, "a", "b").first()[0])


def test_points_of_one_file_are_dealt_over_all_cores(blobs, spark):
    """A pass over many runs is not left to the one task that a small file has."""
    one = blobs[1].coalesce(1)
    assert kb.keyed(one, "id").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r["key"] for r in kb.keyed(one, "id").collect()) == sorted(r["key"] for r in kb.keyed(blobs[1], "id").collect())


def test_sums_of_many_tasks_equal_those_of_few(blobs, monkeypatch):
    data = kb.keyed(blobs[1], "id")
    runs = [(i, b, np.arange(3.0 * k).reshape(k, 3)) for i, (k, b) in enumerate([(2, None), (3, 1), (2, 4), (3, None)])]
    families, part = kb._assigned(runs)
    few = list(kb._unpacked(families, kb.partial_sums(data, part)))
    monkeypatch.setattr(kb, "FEW_PARTS", 0)
    many = list(kb._unpacked(families, kb.partial_sums(data, part)))
    keys, x = (np.array([r[c] for r in data.collect()]) for c in ("key", "x"))
    for a, b in zip(few, many, strict=True):
        _, resample, centres = runs[a[0]]
        w, d = kb.weights(keys, resample), kb.squared_distances(x, centres)
        near = d.argmin(axis=1)
        for got in (a, b):
            assert got[0] == a[0] and got[1] == pytest.approx(float(w @ d.min(axis=1)))
            assert np.allclose(got[2], [w[near == j].sum() for j in range(len(centres))])
            assert np.allclose(got[3], [w[near == j] @ x[near == j] for j in range(len(centres))])


def test_passes_read_blocks_of_points(blobs, spark, monkeypatch):
    """A pass of a fit reads a few blocks, no row a point, and its tasks follow the work, not the parts of the plan before."""
    data, cores = kb.keyed(blobs[1].repartition(40), "id"), spark.sparkContext.defaultParallelism
    sums, seen = kb.partial_sums, []
    monkeypatch.setattr(kb, "partial_sums", lambda d, part: seen.append(d) or sums(d, part))
    kb.fit_runs(data, [kb.Run(3, s) for s in (0, 1)])
    assert data.rdd.getNumPartitions() == 40 and all(d.rdd.getNumPartitions() == cores for d in seen)
    rows = seen[0].collect()
    assert sum(len(r["keys"]) for r in rows) == 8 * len(blobs[0]) and len(rows) <= 40
    families, part = kb._assigned([(0, None, np.arange(6.0).reshape(2, 3)), (1, 3, np.arange(9.0).reshape(3, 3))])
    for a, b in zip(kb._unpacked(families, sums(data, part)), kb._unpacked(families, sums(seen[0], part)), strict=True):
        assert a[0] == b[0] and all(np.allclose(x, y) for x, y in zip(a[1:], b[1:], strict=True))
    one = kb.packed(kb.keyed(blobs[1].limit(1), "id"), 1)
    assert [len(r["keys"]) for r in one.collect()] == [8]
