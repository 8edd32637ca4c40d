"""Predictions for unseen perturbations against dense solves, and what they may not read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import unseen as U

C, P, G = 3, 12, 7
CONTEXTS, NAMES = [f"c{i}" for i in range(C)], [f"p{j:02d}" for j in range(P)]


@pytest.fixture
def world():
    rng = np.random.default_rng(3)
    return rng.normal(size=(C, P, G)), rng.normal(size=(P, 4)), rng.normal(size=(P, 30))


def tables(spark, delta, features):
    rows = [(CONTEXTS[i], NAMES[j], f"g{k}", float(v)) for (i, j, k), v in np.ndenumerate(delta)]
    r = spark.createDataFrame(rows, "context string, perturbation string, gene string, delta double")
    f = spark.createDataFrame([(n, x.tolist()) for n, x in zip(NAMES, features, strict=True)], "perturbation string, features array<double>")
    return r, f, U.two_axis_splits(r.select("context").distinct(), r.select("perturbation").distinct(), 4, 5)


def plans(splits):
    out = {}
    for r in splits.collect():
        out.setdefault((r.regime, r.target, r.fold), {"train": [], "test": []})[r.part].append(NAMES.index(r.perturbation))
    return out


def test_splits_hold_out_both_axes(spark, world):
    _, _, splits = tables(spark, world[0], world[1])
    p = plans(splits)
    assert len(p) == 4 * (C + 1)
    for key, v in p.items():
        assert not set(v["train"]) & set(v["test"]) and sorted(v["train"] + v["test"]) == list(range(P)) and (key[0] == "P2") == (key[1] is not None)
    tested = [set(v["test"]) for k, v in p.items() if k[0] == "P1"]
    assert set.union(*tested) == set(range(P)) and sum(map(len, tested)) == P
    with pytest.raises(Exception, match="both trains and tests"):
        U.refuse_leaks(splits.union(splits.withColumn("part", F.lit("test")))).collect()
    with pytest.raises(Exception, match="target"):
        U.refuse_leaks(splits.withColumn("target", F.lit(None).cast("string"))).collect()


@pytest.mark.parametrize(("wide", "kind", "components"), [(False, "ridge", None), (True, "ridge", None), (True, "ridge", 3), (False, "nearest", None), (False, "knn", None), (False, "zero", None)])
def test_predictions_equal_dense_solves(spark, world, wide, kind, components):
    delta, features = world[0], world[2] if wide else world[1]
    r, f, splits = tables(spark, delta, features)
    got = {(x.regime, x.target, x.fold, x.perturbation, x.gene): x.predicted for x in U.predict_unseen(r, f, splits, kind, 0.7, 3, components).collect()}
    n = 0
    for (regime, target, fold), v in plans(splits).items():
        sources = [i for i, c in enumerate(CONTEXTS) if c != target]
        train, test = sorted(v["train"]), sorted(v["test"])
        m = delta[sources][:, train].mean(axis=0)
        beta, x, t = m - m.mean(axis=0), features[train], features[test]
        if components:
            _, _, vt = np.linalg.svd(x - x.mean(axis=0))
            x, t = (x - features[train].mean(axis=0)) @ vt[:components].T, (t - features[train].mean(axis=0)) @ vt[:components].T
        if kind == "ridge":
            xc = x - x.mean(axis=0)
            want = (t - x.mean(axis=0)) @ np.linalg.lstsq(np.vstack((xc, np.sqrt(0.7) * np.eye(x.shape[1]))), np.vstack((beta, np.zeros((x.shape[1], G)))), rcond=None)[0]
        elif kind == "zero":
            want = np.zeros((len(test), G))
        else:
            cos = (t / np.linalg.norm(t, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
            want = []
            for row in cos:
                top = np.argsort(-row)[: 1 if kind == "nearest" else 3]
                w = np.ones(1) if kind == "nearest" else np.maximum(row[top], 0)
                want.append(w @ beta[top] / w.sum() if w.sum() > 0 else np.zeros(G))
            want = np.array(want)
        for i, j in enumerate(test):
            for k in range(G):
                assert np.isclose(got[regime, target, fold, NAMES[j], f"g{k}"], want[i, k], atol=1e-9)
                n += 1
    assert n == len(got) == (C + 1) * P * G


def test_predictions_read_only_the_training_block(spark, world):
    delta, features, _ = world
    r, f, splits = tables(spark, delta, features)
    before = {tuple(x)[:5]: x.predicted for x in U.predict_unseen(r, f, splits).collect()}
    for (regime, target, fold), v in list(plans(splits).items())[::5]:
        spoiled = np.random.default_rng(9).normal(size=delta.shape) * 100
        sources = [i for i, c in enumerate(CONTEXTS) if c != target]
        block = np.ix_(sources, v["train"])
        spoiled[block] = delta[block]
        other, _, _ = tables(spark, spoiled, features)
        own = splits.filter((F.col("regime") == regime) & F.col("target").eqNullSafe(F.lit(target)) & (F.col("fold") == fold))
        after = {tuple(x)[:5]: x.predicted for x in U.predict_unseen(other, f, own).collect()}
        assert after and all(before[k] == x for k, x in after.items())  # to the bit


def test_holes_and_missing_features_are_refused(spark, world):
    r, f, splits = tables(spark, world[0], world[1])
    with pytest.raises(Exception, match="holes"):
        U.predict_unseen(r.filter("not (context = 'c0' and perturbation = 'p01' and gene = 'g2')"), f, splits).collect()
    with pytest.raises(ValueError, match="no features"):
        U.predict_unseen(r, f.filter("perturbation <> 'p03'"), splits)


def test_evaluation_equals_dense(spark, world):
    delta, features, _ = world
    r, f, splits = tables(spark, delta, features)
    pred = U.predict_unseen(r, f, splits)
    by = {(x.regime, x.target, x.fold, x.perturbation, x.gene): x.predicted for x in pred.collect()}
    tests = {k: v["test"] for k, v in plans(splits).items()}
    got = U.evaluate_unseen(pred, r).collect()
    assert len(got) == P * C + C * P
    for x in got:
        own = tests[x.regime, x.target, x.fold]
        i, j = CONTEXTS.index(x.context), NAMES.index(x.perturbation)
        o = delta[i, j] - delta[i, own].mean(axis=0)
        p = np.array([by[x.regime, x.target, x.fold, x.perturbation, f"g{k}"] for k in range(G)])
        assert np.isclose(x.pearson, np.corrcoef(o, p)[0, 1]) and np.isclose(x.unexplained, ((o - p) ** 2).sum() / (o**2).sum()) and np.isclose(x.cosine, o @ p / np.linalg.norm(o) / np.linalg.norm(p))
