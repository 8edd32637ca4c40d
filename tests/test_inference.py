"""Resampling by counts, null representations, tiers, analytic tests and the map between subspaces, against dense arithmetic."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import models as M
from tesserae.operators import nulls as N
from tesserae.operators import resample as R
from tesserae.operators import stats as X
from tesserae.operators import tiers as T

RESP = "context string, perturbation string, gene string, delta double"


def responses(spark, d):
    return spark.createDataFrame([(f"c{i}", f"p{j}", f"g{k:02d}", float(v)) for (i, j, k), v in np.ndenumerate(d)], RESP)


# --- resampling by counts


def test_draws_sum_to_the_rows_and_agree_with_slots(spark):
    rng = np.random.default_rng(2)
    num, den = rng.exponential(size=400), rng.exponential(size=400) + 1
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(num, den, strict=True))], "id long, num double, den double")
    sums = R.bootstrap_sums(rows, "id", ["num", "den"], 300, 7, blocks=9)
    got = {r.draw: r for r in sums.collect()}
    assert len(got) == 301 and all(r.n == 400 for r in got.values()) and math.isclose(got[-1].num, num.sum())
    assert got[0].num != got[1].num
    again = {r.draw: r.num for r in R.bootstrap_sums(rows.repartition(5), "id", ["num", "den"], 300, 7, blocks=9).collect()}
    assert all(math.isclose(again[d], r.num) for d, r in got.items())
    q = R.interval(sums, 1 - F.col("num") / F.col("den")).first()
    slots = [1 - num[i].sum() / den[i].sum() for i in (rng.integers(0, 400, 400) for _ in range(3000))]
    low, high = np.quantile(slots, [0.025, 0.975])
    assert math.isclose(q.estimate, 1 - num.sum() / den.sum()) and abs(q.low - low) < 0.02 and abs(q.high - high) < 0.02


def test_counts_of_a_row_are_binomial(spark):
    rows = spark.range(50).selectExpr("id", "double(id = 3) as one")
    x = np.array([r.one for r in R.bootstrap_sums(rows, "id", ["one"], 2000, 1, blocks=4).filter("draw >= 0").collect()])
    assert abs(x.mean() - 1) < 0.08 and abs(x.var() - 0.98) < 0.15 and (x == np.floor(x)).all()


def test_bootstrap_of_an_empty_table(spark):
    assert R.bootstrap_sums(spark.range(0).selectExpr("id", "1.0D as v"), "id", ["v"], 5, 1).count() == 0


# --- null representations


SETS = {"a": ["g00", "g01", "g02"], "b": ["g02", "g03"], "c": ["g05", "g06", "g07", "g08"]}


def weights(kind, genes, draw):
    return N.Representation(kind, genes, SETS, 5).rows(draw, genes)


def test_permuted_sets_keep_sizes_overlaps_and_degrees():
    genes = [f"g{k:02d}" for k in range(12)]
    own = weights("permuted", genes, -1) > 0
    for draw in range(5):
        now = weights("permuted", genes, draw) > 0
        assert np.array_equal(now.T.astype(int) @ now, own.T.astype(int) @ own) and sorted(now.sum(axis=1)) == sorted(own.sum(axis=1))
    assert len({weights("permuted", genes, d).tobytes() for d in range(5)}) == 5
    sizes = (weights("resampled", genes, 3) > 0).sum(axis=0)
    assert sizes.tolist() == [3, 2, 4] and np.allclose(weights("resampled", genes, 3).sum(axis=0), 1)
    x = np.array([N.normal_entry(1, 0, k, g) for k in range(40) for g in map(str, range(50))])
    assert abs(x.mean()) < 0.1 and abs(x.std() - 1) < 0.06 and abs((x > 1.96).mean() - 0.025) < 0.015


@pytest.mark.parametrize("kind", N.KINDS)
def test_projected_nulls_equal_dense(spark, kind, monkeypatch):
    d = np.random.default_rng(1).normal(size=(4, 6, 12))
    genes = [f"g{k:02d}" for k in range(12)]
    sets = spark.createDataFrame([(s, g) for s, own in SETS.items() for g in [*own, "absent"]], "set string, gene string")
    monkeypatch.setattr(N, "BLOCK_GENES", 5)
    got = N.project_nulls(responses(spark, d), sets, kind, 11, 5, draws_together=4)
    cells = {(r.draw, r.context, r.perturbation, r.component): r.value for r in got.collect()}
    assert len(cells) == 12 * 4 * 6 * 3
    score = {}
    for draw in range(-1, 11):
        w = weights(kind, genes, draw)
        if kind == "projected" and draw >= 0:
            w = w / np.linalg.norm(w, axis=0)
        y = d @ w
        assert all(np.isclose(cells[draw, f"c{i}", f"p{j}", k], v) for (i, j, k), v in np.ndenumerate(y))
        truth = (y - y.mean(axis=0) - y.mean(axis=1, keepdims=True) + y.mean(axis=(0, 1)))[0]
        lead = y[2] - y[1:].mean(axis=0)
        score[draw] = np.mean([np.corrcoef(t, g)[0, 1] for t, g in zip(truth, lead - lead.mean(axis=0), strict=True)])
    r = N.recovered(got, "c0", "c2")
    assert all(np.isclose(x.recoverability, score[x.draw]) for x in r.collect())
    one, null = N.among_nulls(r, "recoverability").first(), np.array([score[k] for k in range(11)])
    assert np.allclose([one.observed, one.null_mean, one.null_sd, one.z], [score[-1], null.mean(), null.std(ddof=1), (score[-1] - null.mean()) / null.std(ddof=1)])
    assert one.n_null == 11 and np.isclose(one.percentile, 100 * (null < score[-1]).mean()) and np.isclose(one.p_value, ((null >= score[-1]).sum() + 1) / 12)


def test_sets_that_can_not_be_drawn_are_refused():
    with pytest.raises(ValueError, match="without genes"):
        N.Representation("permuted", ["g"], {"a": []}, 1)
    with pytest.raises(ValueError, match="no representation"):
        N.Representation("other", ["g"], {}, 1)


# --- tiers


def nested(d, sources, tier, main, grid):
    """Errors by weight from the responses themselves."""
    def pooled(c):
        return d[list(c)].mean(axis=1).mean(axis=0)

    def shrunk(c):
        if len(c) == 1:
            return pooled(c)
        scales = [pooled([x for x in c if x != h]) @ d[h].mean(axis=0) / (pooled([x for x in c if x != h]) @ pooled([x for x in c if x != h])) for h in c]
        return np.median(scales) * pooled(c)

    total = np.zeros(len(grid))
    for held in sources:
        inner = [c for c in sources if c != held]
        m = {"pooled": pooled, "zero": lambda c: np.zeros(d.shape[2]), "shrunk": shrunk}[main](inner)
        subsets = list(itertools.combinations(inner, min(tier, len(inner))))
        for s in subsets:
            e = d[list(s)] - d[list(s)].mean(axis=1, keepdims=True)
            total += [((d[held] - m - w * e.mean(axis=0)) ** 2).mean() / len(subsets) for w in grid]
    return total / len(sources)


@pytest.mark.parametrize("main", ["pooled", "zero", "shrunk"])
@pytest.mark.parametrize("contexts", [3, 5])
def test_tiers_equal_nested_validation(spark, main, contexts):
    rng = np.random.default_rng(contexts)
    d = rng.normal(size=(contexts, 6, 4)) + rng.normal(size=(1, 6, 4)) + rng.normal(size=(contexts, 1, 4)) + 1
    got = T.tier_shrinkage(responses(spark, d), (2, 1), main).collect()
    assert len(got) == contexts * 2 * len(T.GRID)
    for target in range(contexts):
        sources = [c for c in range(contexts) if c != target]
        for tier in (2, 1):
            want = nested(d, sources, tier, main, T.GRID)
            own = sorted((r for r in got if r.target == f"c{target}" and r.tier == tier), key=lambda r: r.weight)
            assert np.allclose([r.error for r in own], want) and [r.chosen for r in own].index(True) == int(np.argmin(want)) and sum(r.chosen for r in own) == 1


def test_the_outer_target_is_not_read(spark):
    rng = np.random.default_rng(4)
    d = rng.normal(size=(4, 5, 3))
    before = {(r.tier, r.weight): r.error for r in T.tier_shrinkage(responses(spark, d)).filter("target = 'c1'").collect()}
    d[1] = rng.normal(size=(5, 3)) * 50
    after = {(r.tier, r.weight): r.error for r in T.tier_shrinkage(responses(spark, d)).filter("target = 'c1'").collect()}
    assert all(np.isclose(before[k], v) for k, v in after.items())


def test_tier_predictions(spark):
    d = np.random.default_rng(6).normal(size=(4, 3, 5))
    support = spark.createDataFrame([("p0", 2, "c1"), ("p0", 2, "c3"), ("p1", 1, "c2"), ("p2", 0, None)], "perturbation string, tier int, source string")
    weights_ = spark.createDataFrame([(2, 0.75), (1, 0.25)], "tier int, weight double")
    got = {(r.perturbation, r.gene): r.predicted for r in T.tier_prediction(responses(spark, d), "c0", ["c1", "c2", "c3"], support, weights_).collect()}
    m, e = d[1:].mean(axis=(0, 1)), d - d.mean(axis=1, keepdims=True)
    want = np.array([m + 0.75 * e[[1, 3], 0].mean(axis=0), m + 0.25 * e[2, 1], m])
    assert len(got) == 15 and all(np.isclose(got[f"p{j}", f"g{k:02d}"], v) for (j, k), v in np.ndenumerate(want))
    with pytest.raises(ValueError, match="source"):
        T.tier_prediction(responses(spark, d), "c1", ["c1"], support, weights_)


# --- analytic tests


def test_tails_at_any_distance(spark):
    z = [0.0, 1e-9, 0.3, 0.66, 0.67, 1.0, 1.96, 3.0, 5.65, 5.66, 8.0, 12.5, 20.0, 30.0, 37.0, -2.5]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z], "z double").select(X.normal_tails("z").alias("p")).collect()]
    assert np.allclose(got, [math.erfc(abs(v) / math.sqrt(2)) for v in z], rtol=1e-13, atol=0)
    assert spark.sql("select cast(null as double) z union all select double('NaN')").select(X.normal_tails("z").alias("p")).filter("p is null").count() == 2


def test_ideal_table_equals_dense(spark):
    rng = np.random.default_rng(8)
    x = rng.poisson(rng.gamma(0.5, 3, size=(40, 9))).astype(float)
    x[:, 8] = 0
    x[5] = 0
    depth = x.sum(axis=1)
    control = spark.createDataFrame([(int(i), f"g{k}", float(x[i, k])) for i, k in zip(*np.nonzero(x), strict=True)], "cell long, gene string, value double")
    sizes = spark.createDataFrame([(i, float(v)) for i, v in enumerate(depth)], "cell long, depth double")
    p = rng.dirichlet(np.ones(9), 3)
    p[1, 2] = 0
    predicted = spark.createDataFrame([(f"t{i}", f"g{k}", float(v)) for (i, k), v in np.ndenumerate(p) if v > 0], "target string, gene string, p double")
    tested = [0, 1, 2, 4, 8]
    got = {(r.target, r.gene): r for r in X.ideal_de(control, sizes, predicted, spark.createDataFrame([(f"g{k}",) for k in tested], "gene string"), 100).collect()}
    cpm = 1e6 * x / np.where(depth > 0, depth, 1)[:, None]
    m0, v0 = cpm.mean(axis=0)[tested], cpm.var(axis=0, ddof=1)[tested]
    assert len(got) == 15
    for i in range(3):
        m1 = 1e6 * p[i, tested]
        se = np.sqrt(v0 * np.where(m0 > 0, m1 / np.where(m0 > 0, m0, 1), 1) ** 2 / 100 + v0 / 40)
        z = np.where(se > 0, (m1 - m0) / np.where(se > 0, se, 1), 0)
        pv = np.array([math.erfc(abs(v) / math.sqrt(2)) for v in z])
        order = np.argsort(pv)
        adj = np.minimum.accumulate((pv[order] * 5 / np.arange(1, 6))[::-1])[::-1]
        for r, j in enumerate(order):
            row = got[f"t{i}", f"g{tested[j]}"]
            assert np.allclose([row.z, row.p, row.p_adj, row.lfc], [z[j], pv[j], min(1, adj[r]), np.log2((m1[j] + 1e-9) / (m0[j] + 1e-9))], rtol=1e-9)


# --- the map between subspaces


@pytest.mark.parametrize(("rank", "components"), [(3, 2), (3, 5), (1, 2), (0, 2)])
def test_subspace_map_equals_svd(spark, rank, components):
    rng = np.random.default_rng(rank)
    dev = rng.normal(size=(4, rank)) @ rng.normal(size=(rank, 30)) + rng.normal(size=30) if rank < 3 else rng.normal(size=(4, 30))
    alpha, target = rng.normal(size=(4, 30)), rng.normal(size=30)
    long = lambda m, c: spark.createDataFrame([(f"s{i}", f"g{k}", float(v)) for (i, k), v in np.ndenumerate(m)], f"source string, gene string, {c} double")
    t = spark.createDataFrame([(f"g{k}", float(v)) for k, v in enumerate(target)], "gene string, dev double")
    got = {r.gene: r.predicted for r in M.subspace_map(long(alpha, "alpha"), long(dev, "dev"), t, components, 0.8).collect()}
    centre = dev.mean(axis=0)
    _, s, vt = np.linalg.svd(dev - centre, full_matrices=False)
    basis = vt[: min(components, int((s > 1e-8).sum()))]
    coords = (dev - centre) @ basis.T
    want = (target - centre) @ basis.T @ np.linalg.solve(coords.T @ coords + 0.8 * np.eye(len(basis)), coords.T @ alpha)
    assert np.allclose([got[f"g{k}"] for k in range(30)], want)
