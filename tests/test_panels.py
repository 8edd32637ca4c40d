"""Discrimination and mixed panels against dense arithmetic."""

import hashlib

import numpy as np
import pytest

from tesserae.operators.panels import discrimination, mixed_panel, shared_discrimination
from tesserae.plans import scoring

SCHEMA = "g string, id string, own string, vec array<double>"


def dense(pred, true):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    d = np.round(1 - unit(pred) @ unit(true).T, 9)
    own = np.diagonal(d)[:, None]
    return 1 - ((d < own).sum(axis=1) + 0.5 * ((d == own).sum(axis=1) - 1)) / (len(true) - 1)


@pytest.mark.parametrize("block", [7, 1024])
def test_discrimination_equals_dense(spark, block):
    rng = np.random.default_rng(block)
    worlds = {}
    for g, n in (("a", 40), ("b", 23), ("c", 2)):
        true = rng.normal(size=(n, 3))
        true[n // 2 :] = np.round(true[n // 2 :])  # ties and a vector without length
        true[-1] = 0
        worlds[g] = (np.where(rng.random((n, 1)) < 0.4, true.mean(axis=0), true + rng.normal(size=(n, 3))), true)
    rows = lambda k: spark.createDataFrame([(g, f"p{i}", f"p{i}", v.tolist()) for g, w in worlds.items() for i, v in enumerate(w[k])], SCHEMA)
    got = {(r.g, r.id): r.score for r in discrimination(rows(0), rows(1), ["g"], "own", block=block).collect()}
    want = {(g, f"p{i}"): v for g, (p, t) in worlds.items() for i, v in enumerate(dense(p, t))}
    assert got.keys() == want.keys() and all(np.isclose(got[k], v) for k, v in want.items())
    one = spark.createDataFrame([("a", "x", "x", [1.0])], SCHEMA)
    assert discrimination(one, one, ["g"], "own").first().score is None and discrimination(one.limit(0), one.limit(0), ["g"], "own").count() == 0


def test_mixed_panel_equals_dense(spark):
    rng = np.random.default_rng(2)
    C, P, G, draws, shares = 3, 9, 6, 4, {2: 0.3, 1: 0.3}
    d = rng.normal(size=(C, P, G)) + 0.5
    responses = spark.createDataFrame([(f"c{i}", f"p{j}", f"g{k}", float(v)) for (i, j, k), v in np.ndenumerate(d)], "context string, perturbation string, gene string, delta double")
    weights = spark.createDataFrame([(f"c{i}", t, 0.5 + 0.1 * i + 0.01 * t) for i in range(C) for t in (2, 1)], "target string, tier int, weight double")
    got = {(r.target, r.draw): r for r in mixed_panel(responses, weights, shares, draws, 5, ("g1",)).collect()}
    assert len(got) == C * draws
    kept = [k for k in range(G) if k != 1]
    for i in range(C):
        src = [c for c in range(C) if c != i]
        e = d - d.mean(axis=1, keepdims=True)
        main = d[src].mean(axis=(0, 1))
        by_tier = {2: main + (0.52 + 0.1 * i) * e[src[:2]].mean(axis=0), 1: main + (0.51 + 0.1 * i) * e[src[0]], 0: np.tile(main, (P, 1))}
        for draw in range(draws):
            u = [int(hashlib.md5(f"5:{draw}:p{j}".encode()).hexdigest()[:8], 16) / 2**32 for j in range(P)]
            tier = [2 if x < 0.3 else 1 if x < 0.6 else 0 for x in u]
            pred, t, r = np.array([by_tier[k][j] for j, k in enumerate(tier)]), d[i], got[f"c{i}", draw]
            assert (r.n_tier2, r.n_tier1, r.n_tier0) == tuple(tier.count(k) for k in (2, 1, 0))
            want = [
                np.median([np.corrcoef(a, b)[0, 1] for a, b in zip(pred, t, strict=True)]), np.median([a @ b / np.linalg.norm(a) / np.linalg.norm(b) for a, b in zip(pred, t, strict=True)]),
                ((pred - t) ** 2).mean(), 1 - ((pred - t) ** 2).sum() / (t**2).sum(), dense(pred[:, kept], t[:, kept]).mean(),
            ]
            assert np.allclose([r.pearson_median, r.cosine_median, r.mse_mean, r.energy_explained, r.pds_mean], want)


def test_few_predictions_do_not_copy_the_truth(spark):
    """Shuffled bytes: the truth once for each block of predictions, of which there is one here, not for each block of its own."""
    rng = np.random.default_rng(8)
    true = spark.createDataFrame([("a", f"p{i}", f"p{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 32)))], SCHEMA)
    few = true.filter("id in ('p3', 'p7', 'p1999')")
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: store.executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert {r.score for r in discrimination(few, true, ["g"], "own", block=100).collect()} == {1.0}
    assert written() - before < 5 * 2000 * 32 * 8


@pytest.mark.parametrize(("block", "asking"), [(3, 11), (1024, 2**20)])
def test_shared_predictions_score_every_vector(spark, block, asking):
    rng = np.random.default_rng(block)
    true, label = rng.normal(size=(60, 3)), rng.integers(0, 7, 60)
    true[30:] = np.round(true[30:])  # ties and a vector without length
    true[-1] = 0
    means = np.array([true[label == i].mean(axis=0) if i else np.zeros(3) for i in range(7)])
    want = dense(means[label], true)
    for name in (lambda i: int(i) - 3, lambda i: f"l{i}"):
        kind = "int" if name(0) == -3 else "string"
        predicted = spark.createDataFrame([(name(i), v.tolist()) for i, v in enumerate(means)], f"label {kind}, vec array<double>")
        rows = [(7 * i, name(label[i]), v.tolist()) for i, v in enumerate(true)]
        truth = spark.createDataFrame(rows, f"id long, label {kind}, vec array<double>")
        got = {r.id: r.score for r in shared_discrimination(predicted, truth, "label", block=block, asking=asking).collect()}
        assert got.keys() == {7 * i for i in range(60)} and all(np.isclose(got[7 * i], v) for i, v in enumerate(want))
    more = truth.union(spark.createDataFrame([(-1, None, [1.0, 0.0, 0.0])], truth.schema))  # a candidate without a prediction
    got = {r.id: r.score for r in shared_discrimination(predicted, more, "label", block=block, asking=asking).collect()}
    own = dense(np.vstack([means[label], [[0, 0, 0]]]), np.vstack([true, [[1, 0, 0]]]))
    assert got.keys() == {7 * i for i in range(60)} and all(np.isclose(got[7 * i], own[i]) for i in range(60))
    one = truth.limit(1)
    assert shared_discrimination(predicted, one, "label").first().score is None
    assert shared_discrimination(predicted.limit(0), truth, "label").count() == shared_discrimination(predicted, truth.limit(0), "label").count() == 0


def test_pds_scores_every_vector(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    assert {r.query_id for r in scoring.Q["pds_cosine"](spark, sf).collect()} == want
