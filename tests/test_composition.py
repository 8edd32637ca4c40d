"""Compositions and counts against dense arithmetic and exact sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import composition as P


@pytest.fixture
def rng():
    return np.random.default_rng(0)


def test_two_moments_and_exact_sums(rng):
    depth = rng.integers(200, 2000, 60)
    share, lean = rng.dirichlet(np.ones(40) * 2), rng.normal(size=40) * 0.15
    base = rng.dirichlet(share * 50, 60)
    bulk = share * np.exp(lean)
    bulk /= bulk.sum()
    x = P.fit_two_moments(base, share, bulk, depth)
    assert np.allclose(x.sum(axis=1), 1) and np.abs(x.mean(axis=0) - share).sum() < 1e-4
    assert np.abs((depth / depth.mean()) @ x / 60 - bulk).sum() < 1e-3
    counts = P.whole_counts(x * depth[:, None], depth, rng)
    assert (counts >= 0).all() and np.array_equal(counts.sum(axis=1), depth)
    assert np.abs(counts.sum(axis=0) - (x * depth[:, None]).sum(axis=0)).max() < 1
    assert np.abs(counts - x * depth[:, None]).mean() < 1


@pytest.mark.parametrize(("lean", "fits"), [(0.02, True), (0.3, True), (6.0, False)])
def test_bulk_share_is_met_or_refused(rng, lean, fits):
    depth = rng.integers(100, 3000, 80)
    share = rng.dirichlet(np.ones(30) * 5)
    bulk = share * np.exp(rng.normal(size=30) * lean)
    bulk /= bulk.sum()
    z = depth / depth.mean()
    if not fits:
        with pytest.raises(ValueError, match="depths do not allow|no multiple"):
            P.fit_two_moments(rng.dirichlet(share * 40, 80), share, bulk, depth)
        return
    x = P.fit_two_moments(rng.dirichlet(share * 40, 80), share, bulk, depth)
    assert np.abs(x.mean(axis=0) - share).sum() < 1e-3 and np.abs(z @ x / 80 - P.nearest_reachable(bulk, share, z)).sum() < 1e-3


def test_reachable_share_sums_to_one_within_its_bounds(rng):
    z = np.array([0.5, 1.0, 1.5])
    share = rng.dirichlet(np.ones(12))
    bulk = share * np.exp(rng.normal(size=12))
    got = P.nearest_reachable(bulk / bulk.sum(), share, z)
    ratio = got / share
    assert abs(got.sum() - 1) < 1e-9 and ratio.min() >= 0.505 - 1e-9 and ratio.max() <= 1.495 + 1e-9
    free = (ratio > 0.505 + 1e-6) & (ratio < 1.495 - 1e-6)
    assert np.ptp((got / bulk)[free]) < 1e-9  # the others are one multiple
    assert np.allclose(P.nearest_reachable(share, share, z), share)


def test_equal_depths_allow_the_plain_mean_only(rng):
    share, bulk = np.array([0.5, 0.3, 0.2]), np.array([0.4, 0.4, 0.2])
    with pytest.raises(ValueError, match="depths do not allow"):
        P.fit_two_moments(np.ones((4, 3)), share, bulk, np.full(4, 9))
    for bad in (np.array([0.5, 0.5, 0.1]), np.array([0.6, 0.5, -0.1]), np.array([np.nan, 0.5, 0.5])):
        with pytest.raises(ValueError, match="sum to one|finite"):
            P.fit_two_moments(np.ones((4, 3)), bad, bulk, np.full(4, 9))
    with pytest.raises(ValueError, match="differ"):
        P.whole_counts(np.ones((4, 3)), np.full(4, 9), rng)


def test_equal_depths_and_genes_without_mass(rng):
    share = np.array([0.5, 0.5, 0.0])
    x = P.fit_two_moments(np.ones((5, 3)), share, share, np.full(5, 100))
    counts = P.whole_counts(x * 100, np.full(5, 100), rng)
    assert counts[:, 2].sum() == 0 and (counts.sum(axis=1) == 100).all() and counts.sum(axis=0).tolist() == [250, 250, 0]


def test_dual_moment_counts_repeat_and_keep_depths(spark, rng):
    genes = [f"g{k}" for k in range(8)]
    share = rng.dirichlet(np.ones(8))
    rows = [(f"t{c % 2}", c % 3, c, int(rng.integers(50, 300)), genes, rng.dirichlet(np.ones(8)).tolist(), share.tolist(), share.tolist()) for c in range(60)]
    t = spark.createDataFrame(rows, "target string, block int, cell long, depth long, genes array<string>, base array<double>, share array<double>, bulk array<double>")
    one, two = (sorted(map(tuple, P.dual_moment_counts(t.repartition(n), 3).collect())) for n in (1, 4))
    assert one == two
    total = {}
    for _, cell, _, value in one:
        total[cell] = total.get(cell, 0) + value
    assert total == {r[2]: r[3] for r in rows}


def test_dispersion_and_structure_equal_dense(spark, rng):
    x = rng.negative_binomial(2, 0.4, size=(30, 6)).astype(float)
    x[:, 0] += 1
    depth, share = x.sum(axis=1), x.sum(axis=0) / x.sum()
    rows = [("a", int(i), float(depth[i]), f"g{k}", float(x[i, k])) for i, k in zip(*np.nonzero(x))]
    cells = spark.createDataFrame(rows, "group string, cell long, depth double, gene string, value double")
    comp = spark.createDataFrame([("a", f"g{k}", float(share[k])) for k in range(6)], "group string, gene string, share double")
    mu = depth[:, None] * share
    want = np.maximum(0, (((x - mu) ** 2).sum(axis=0) - mu.sum(axis=0)) / (mu**2).sum(axis=0))
    got = {r.gene: r.phi for r in P.dispersion(cells, comp).collect()}
    assert np.allclose([got[f"g{k}"] for k in range(6)], want)
    log = np.log1p(1e4 * x / depth[:, None])
    for r in P.cell_structure(cells).collect():
        k = int(r.gene[1])
        assert np.allclose([r.gene_mean, r.gene_var, r.log_var, r.zero_fraction], [x[:, k].mean(), x[:, k].var(ddof=1), log[:, k].var(ddof=1), (x == 0).mean()])


def test_transported_cells_keep_what_does_not_change(spark, rng):
    genes, counts = ["a", "b", "c"], rng.integers(0, 50, (400, 3))
    donors = spark.createDataFrame([(i, int(c.sum()), genes, c.tolist()) for i, c in enumerate(counts)], "cell long, depth long, genes array<string>, counts array<int>")
    control = counts.sum(axis=0) / counts.sum()
    ratios = spark.createDataFrame([([0.5, 1.0, 2.0], control.tolist())], "ratio array<double>, control array<double>")
    got = {(r.cell, r.gene): r.value for r in P.transported_cells(donors, ratios, 5).collect()}
    assert all(got.get((i, "b"), 0) == counts[i, 1] and got.get((i, "a"), 0) <= counts[i, 0] and got.get((i, "c"), 0) >= counts[i, 2] for i in range(400))
    total = {g: sum(v for (_, h), v in got.items() if h == g) for g in genes}
    assert abs(total["a"] / counts[:, 0].sum() - 0.5) < 0.03 and abs(total["c"] / counts[:, 2].sum() - 2) < 0.05


def test_capped_shares_and_empty_compositions(spark):
    c = spark.createDataFrame([("t", "t", 0.2), ("t", "n", 0.5), ("t", "f", 0.3)], "target string, gene string, share double")
    control = spark.createDataFrame([("t", 0.2), ("n", 0.4), ("f", 0.4)], "gene string, control double")
    near = spark.createDataFrame([("t", "t", 0), ("t", "n", 100), ("t", "n", 4000)], "target string, gene string, distance long")
    got = {r.gene: (round(r.share, 9), r.lowered) for r in P.capped(c, control, near).collect()}
    assert got == {"t": (round(0.2 / 0.56, 9), False), "n": (round(0.06 / 0.56, 9), True), "f": (round(0.3 / 0.56, 9), False)}
    with pytest.raises(Exception, match="without mass"):
        P.shares(c.withColumn("raw", F.lit(0.0)), "raw").collect()
    with pytest.raises(ValueError, match="unknown space"):
        P.expected_composition(c, "other")


def test_blocks_and_panels_beyond_their_bound_are_refused(spark, monkeypatch):
    from tesserae.operators import generate, models

    monkeypatch.setattr(generate, "MAX_BLOCK", 2)
    monkeypatch.setattr(models, "MAX_PANEL", 2)
    rows = spark.createDataFrame([("t", 0, i, 10, ["a"], [1.0], [1.0]) for i in range(3)], "target string, block int, cell long, depth long, genes array<string>, base array<double>, share array<double>")
    with pytest.raises(Exception, match="a block of 3 cells"):
        generate.rake(rows, 1).collect()
    panel = spark.createDataFrame([("c", str(i), True, [1.0], 1.0) for i in range(3)], "context string, id string, is_anchor boolean, vec array<double>, y double")
    with pytest.raises(Exception, match="a panel of 3 rows"):
        models.kernel_ridge(panel, ["context"], 1.0, "context string, id string, predicted double").collect()
