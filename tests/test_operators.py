import hashlib
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions import scalars
from tesserae.operators import aggregate as A
from tesserae.operators import anova as V
from tesserae.operators import checks as C
from tesserae.operators import fusion as U
from tesserae.operators import generate as G
from tesserae.operators import joins as J
from tesserae.operators import models as M
from tesserae.operators import ranking as K
from tesserae.operators import resample as R
from tesserae.operators import similarity as S
from tesserae.operators import stats as X
from tesserae.sources import tables
from tesserae.streaming import moments as stream


@pytest.fixture
def rng():
    return np.random.default_rng(0)


def grid(rng, c=4, p=6, g=5):
    return [(f"c{i}", f"p{j}", f"g{k}", float(v)) for (i, j, k), v in np.ndenumerate(rng.normal(size=(c, p, g)))]


RESP = "context string, perturbation string, gene string, delta double"


def test_decomposition_recovers_planted_parts(spark, rng):
    c, p, g = 3, 5, 4
    mu = rng.normal(size=g)
    zero = lambda x, axis: x - x.mean(axis=axis, keepdims=True)
    alpha, beta = zero(rng.normal(size=(c, g)), 0), zero(rng.normal(size=(p, g)), 0)
    gamma = zero(zero(rng.normal(size=(c, p, g)), 0), 1)
    d = mu + alpha[:, None] + beta[None] + gamma
    rows = [(f"c{i}", f"p{j}", f"g{k}", float(d[i, j, k])) for i, j, k in np.ndindex(c, p, g)]
    parts = V.decompose(spark.createDataFrame(rows, RESP)).collect()
    for r in parts:
        i, j, k = int(r.context[1:]), int(r.perturbation[1:]), int(r.gene[1:])
        assert np.allclose([r.mu, r.alpha, r.beta, r.gamma], [mu[k], alpha[i, k], beta[j, k], gamma[i, j, k]])


def test_unbalanced_grid_is_refused(spark, rng):
    rows = grid(rng)
    assert V.assert_balanced(spark.createDataFrame(rows, RESP)).count() == len(rows)
    with pytest.raises(Exception, match="balanced"):
        V.assert_balanced(spark.createDataFrame(rows[1:], RESP)).collect()


def test_projection_leaves_nothing_along_the_template(spark, rng):
    rows = pd.DataFrame(grid(rng), columns=["context", "perturbation", "gene", "delta"])
    out = V.project_out_template(spark.createDataFrame(rows, RESP)).toPandas()
    t = rows.groupby(["context", "gene"])["delta"].mean()
    out["t"] = [t[(c, g)] for c, g in zip(out["context"], out["gene"])]
    assert np.allclose((out["projected"] * out["t"]).groupby([out["context"], out["perturbation"]]).sum(), 0)


def counts(rng, n=40, g=7):
    x = rng.poisson(0.7, size=(n, g))
    cells = [(i, f"c{i % 2}", f"p{i % 3}", f"b{i % 4}") for i in range(n)]
    expr = [(int(i), f"g{k}", float(x[i, k])) for i, k in zip(*np.nonzero(x))]
    return x, cells, expr


CELLS, EXPR = "cell long, context string, perturbation string, batch string", "cell long, gene string, value double"


def test_group_means_count_zeros(spark, rng):
    x, cells, expr = counts(rng)
    got = A.group_means(spark.createDataFrame(cells, CELLS), spark.createDataFrame(expr, EXPR), ["perturbation"]).collect()
    label = np.array([c[2] for c in cells])
    assert len(got) == 21
    for r in got:
        assert math.isclose(r["mean"], x[label == r.perturbation, int(r.gene[1:])].mean(), abs_tol=1e-12)


def test_variance_and_summary(spark, rng):
    x, cells, expr = counts(rng)
    c, e = spark.createDataFrame(cells, CELLS), spark.createDataFrame(expr, EXPR)
    label = np.array([k[1] for k in cells])
    for r in A.gene_variance(c, e).collect():
        assert math.isclose(r.variance, x[label == r.context, int(r.gene[1:])].var(), abs_tol=1e-12)
    for r in A.context_summary(c, e).collect():
        own = x[label == r.context]
        assert r.mean_depth == own.sum(axis=1).mean() and math.isclose(r.sparsity, 1 - (own > 0).mean())


def test_counts_come_back_from_their_logs(spark, rng):
    x = rng.poisson(3, size=(20, 6)) + 0
    x[:, 0] += 1
    expr = [(int(i), f"g{k}", float(x[i, k])) for i, k in zip(*np.nonzero(x))]
    n = A.normalise(spark.createDataFrame(expr, EXPR))
    got = {(r.cell, r.gene): r["count"] for r in A.recover_counts(n).collect()}
    for i in range(20):
        g = math.gcd(*[int(v) for v in x[i] if v])
        assert all(got[(i, f"g{k}")] == x[i, k] // g for k in range(6) if x[i, k])
    bad = n.withColumn("log_cp", F.col("log_cp") * (1 + F.rand(1) / 3))
    with pytest.raises(Exception, match="recovered"):
        A.recover_counts(bad, tolerance=1e-6).collect()


def test_a_cell_whose_counts_can_not_be_recovered_has_no_rows(spark):
    """The least count, 67, is more than the numbers tried, as in some large orders."""
    n = A.normalise(spark.createDataFrame([(1, "g0", 67.0), (1, "g1", 71.0), (2, "g0", 64.0), (2, "g1", 71.0), (3, "g0", 67.0)], EXPR))
    got = {(r.cell, r.gene): (r["count"], r.quantum) for r in A.recover_counts(n, strict=False).collect()}
    assert got == {(2, "g0"): (64, 64), (2, "g1"): (71, 64), (3, "g0"): (1, 1)}
    with pytest.raises(Exception, match="recovered"):
        A.recover_counts(n).collect()


def test_splits_are_disjoint_and_even(spark):
    cells = spark.range(103).select(F.col("id").alias("cell"), (F.col("id") % 5).cast("string").alias("g"))
    h = R.halves(cells, ["g"], 1).groupBy("g").pivot("half", [0, 1]).count().collect()
    assert all(r["0"] == r["1"] for r in h)
    kept = R.halves(cells, ["g"], 1, drop_odd=False)
    assert kept.count() == 103
    p = {(r.g, r.part): r["count"] for r in R.three_parts(cells, ["g"], 1).groupBy("g", "part").count().collect()}
    assert p[("0", "F")] == 10 and p[("0", "E1")] == 5 and p[("0", "E2")] == 6
    b = [r["count"] for r in R.blocks(cells, ["g"], 4, 1).groupBy("g", "block").count().collect()]
    assert min(b) >= 5 and max(b) <= 6
    assert R.halves(cells.limit(0), ["g"], 1).count() == 0


@pytest.mark.parametrize("drop_odd", [True, False])
def test_halves_are_those_of_ordered_groups_without_ordering_one_whole(spark, drop_odd):
    rows = [("a" if i % 7 else None, i) for i in range(5003)] + [("one", 6000), ("two", 6001), ("two", 6002)]
    out = R.halves(spark.createDataFrame(rows, "g string, cell long"), ["g"], 4, drop_odd)
    want = set()
    for g in {g for g, _ in rows}:
        key = lambda i, g=g: (hashlib.md5(":".join(v for v in ("4", g, str(i)) if v is not None).encode()).hexdigest(), i)
        own = sorted((i for h, i in rows if h == g), key=key)
        n = len(own) // 2
        want |= {(g, i, int(k >= n)) for k, i in enumerate(own) if k < 2 * n or not drop_odd}
    assert {(r.g, r.cell, r.half) for r in out.collect()} == want and out.count() == len(want)
    ordered = re.findall(r"row_number\(\) windowspecdefinition\((.*?) (?:ASC|DESC)", out._jdf.queryExecution().optimizedPlan().toString())
    assert ordered and all("digits" in w for w in ordered)


def dense_rank_sum(a, b):
    both = np.concatenate((a, b))
    order = np.argsort(both, kind="stable")
    rank = np.empty(len(both))
    rank[order] = np.arange(1, len(both) + 1)
    for v in np.unique(both):
        rank[both == v] = rank[both == v].mean()
    u = rank[: len(a)].sum() - len(a) * (len(a) + 1) / 2
    _, t = np.unique(both, return_counts=True)
    n = len(both)
    s = math.sqrt(len(a) * len(b) / 12 * ((n + 1) - (t**3 - t).sum() / (n * (n - 1))))
    return u, (abs(u - len(a) * len(b) / 2) - 0.5) / s if s else None


def test_rank_sums_with_zeros_that_are_not_stored(spark, rng):
    own, control, want, genes = [], [], {}, [f"g{k}" for k in range(30)]
    for k, g in enumerate(genes):
        b = rng.poisson(1, 35).astype(float) * (k != 29)
        control += [(g, float(v)) for v in b if v]
        for t, n in (("s", 20), ("t", 12)):
            a = rng.poisson(0.5 + k % 3, n).astype(float) * (k != 29)
            own += [(t, g, float(v)) for v in a if v]
            want[t, g] = dense_rank_sum(a, b)
    table = spark.createDataFrame
    got = X.rank_sums(
        table(own, "target string, gene string, value double"), table(control, "gene string, value double"), table([("s", 20), ("t", 12)], "target string, n1 long"),
        table([(35,)], "n0 long"), table([(g,) for g in genes], "gene string"),
    )
    found = got.withColumn("p", X.two_sided("z")).collect()
    assert {(r.target, r.gene) for r in found} == set(want) and len(found) == len(want)
    for r in found:
        u, z = want[r.target, r.gene]
        assert math.isclose(r.u, u) and (r.z is None if z is None else math.isclose(r.z, z, abs_tol=1e-9))
        assert math.isclose(r.p, 1 if z is None else min(1, math.erfc(max(z, 0) / math.sqrt(2))), abs_tol=1e-6)


def test_step_up_adjustment(spark, rng):
    p = np.round(rng.random(60), 2)
    got = X.adjust(spark.createDataFrame([("f", i, float(v)) for i, v in enumerate(p)], "f string, i int, p double"), ["f"]).orderBy("i").toPandas()
    order = np.argsort(p)
    q = np.minimum(1, np.minimum.accumulate((p[order] * 60 / np.arange(1, 61))[::-1])[::-1])
    want = np.empty(60)
    want[order] = q
    assert np.allclose(got["p_adj"], want)


def test_constant_rows_have_no_correlation(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", None, 1.0)], "k string, x double, y double")
    got = {r.k: r.pearson for r in S.row_metrics(rows, ["k"]).collect()}
    assert got["a"] is None and math.isclose(got["b"], 1.0)


def test_discrimination_counts_ties_half(spark):
    rows = [("a", "a", 0.9), ("a", "b", 0.95), ("a", "c", 0.9), ("b", "a", 0.1), ("b", "b", 0.99), ("b", "c", 0.2), ("c", "a", 0.5), ("c", "b", 0.6), ("c", "c", 0.4)]
    got = {r.query_id: r.score for r in S.discrimination(spark.createDataFrame(rows, "query_id string, ref_id string, cos double")).collect()}
    assert got == {"a": 1 - 1.5 / 2, "b": 1.0, "c": 0.0}


def test_band_join_equals_brute_force(spark, rng):
    l_ = [(i, f"k{rng.integers(3)}", int(rng.integers(0, 500))) for i in range(80)]
    r_ = [(i, f"k{rng.integers(3)}", int(rng.integers(0, 500))) for i in range(90)]
    schema = "id long, k string, pos long"
    got = {(r.l_id, r.r_id, r.distance) for r in J.band_join(spark.createDataFrame(l_, schema), spark.createDataFrame(r_, schema), ["k"], "pos", 25).collect()}
    assert got == {(a, b, abs(x - y)) for a, j, x in l_ for b, k, y in r_ if j == k and abs(x - y) <= 25}


def test_fusion_rules(spark):
    rows = [("s1", "t", "g", 1.0), ("s2", "t", "g", 3.0), ("s3", "t", "g", None), ("s1", "t", "h", None), ("s1", "u", "g", -1.0), ("s2", "u", "g", 2.0)]
    e = spark.createDataFrame(rows, "source string, target string, gene string, effect double")
    w = F.when(F.col("source") == "s1", 3.0).otherwise(1.0)
    got = {(r.target, r.gene): (r.fused, r.n_sources) for r in U.fuse(e, w).collect()}
    assert got == {("t", "g"): (1.5, 2), ("t", "h"): (0.0, 0), ("u", "g"): (-0.25, 2)}
    assert {(r.target, r.gene): r.fused for r in U.fuse(e, F.lit(0.0)).collect()}[("t", "g")] == 2.0
    assert {(r.target, r.gene): r.consensus for r in U.consensus(e).collect()} == {("t", "g"): 2, ("t", "h"): 0, ("u", "g"): 3}


def test_checks(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert not C.unique(rows, "k", ["k"]).first().passed
    with pytest.raises(Exception, match="check failed"):
        C.require(C.unique(rows, "k", ["k"])).collect()
    assert {r.k: r.copies for r in C.dedupe_identical(rows, ["k"]).collect()} == {1: 2, 2: 1}
    with pytest.raises(Exception, match="differ"):
        C.dedupe_identical(rows.union(spark.createDataFrame([(1, "z")], "k int, v string")), ["k"]).collect()
    assert C.table_digest(rows, "v").first() == C.table_digest(rows.orderBy(F.desc("k")).repartition(3), "v").first()


def test_models(spark, rng):
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3))
    y = x @ [1.0, -2.0, 0.5] + 3
    df = spark.createDataFrame([(i, *map(float, a), float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))], "id int, a double, b double, c double, y double, v array<double>")
    assert np.allclose(M.fit_ridge(df, ["a", "b", "c"], "y", 0.0), [3, 1, -2, 0.5])
    mean, parts, share = M.fit_pca(df.select("v"), "v", 2)
    assert np.allclose(mean, x.mean(axis=0))
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(parts), np.abs(vt[:2])) and np.allclose(share, (s**2 / (s**2).sum())[:2])
    scores = np.array([r.scores for r in M.apply_pca(df, "v", mean, parts).orderBy("id").collect()])
    assert np.allclose(scores, (x - mean) @ parts.T)
    g = x.T @ x
    assert np.allclose(M.simplex_weights(g, g @ [0.2, 0.3, 0.5]), [0.2, 0.3, 0.5], atol=1e-5)
    assert math.isclose(M.affine_weights(g, g @ [2.0, 0.0, 0.0]).sum(), 1.0)
    iso = M.fit_isotonic(spark.createDataFrame([(float(i), float(v)) for i, v in enumerate([1, 3, 2, 4])], "x double, y double"), "x", "y")
    assert [r.fitted for r in iso.orderBy("x").collect()] == [1.0, 2.5, 2.5, 4.0]


def test_generators_repeat_and_keep_totals(spark):
    p = spark.createDataFrame([(f"t{i % 2}", i, 50.0, ["a", "b", "c"], [1.0, 2.0, 1.0]) for i in range(40)], "target string, cell long, depth double, genes array<string>, shares array<double>")
    one, two = (sorted(map(tuple, G.draw_counts(q, "multinomial", 1).collect())) for q in (p, p.repartition(7)))
    assert one == two
    assert all(r.s == 50 for r in G.draw_counts(p, "multinomial", 1).groupBy("cell").agg(F.sum("value").alias("s")).collect())
    t = p.select("target", F.lit(0).alias("block"), "cell", "depth", "genes", F.col("shares").alias("base"), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25)).alias("share"))
    raked = G.rake(t, 1)
    assert all(r.s == 50 for r in raked.groupBy("cell").agg(F.sum("value").alias("s")).collect())
    total = {r.gene: r.s for r in raked.groupBy("gene").agg(F.sum("value").alias("s")).collect()}
    assert abs(total["a"] - 1000) <= 40
    assert G.draw_counts(p.limit(0), "binomial", 1).count() == 0
    with pytest.raises(ValueError):
        G.draw_counts(p, "other", 1)


def test_jackknife_equals_dense(spark, rng):
    x = rng.poisson(1.0, size=(12, 5)).astype(float)
    x[:, 0] += 1
    depth = x.sum(axis=1)
    rows = [("g", int(i), float(depth[i]), f"g{k}", float(x[i, k])) for i, k in zip(*np.nonzero(x))]
    rows += [("alone", 50, 3.0, "g0", 3.0), ("all", 60, 4.0, "g1", 4.0), ("all", 61, 0.0, "g1", 0.0)]
    got = {r.group: r.variance for r in G.jackknife(spark.createDataFrame(rows, "group string, cell long, depth double, gene string, value double")).collect()}
    loo = np.log1p(5e4 * (x.sum(axis=0) - x) / (depth.sum() - depth)[:, None])
    assert math.isclose(got["g"], 11 * loo.var(axis=0).sum(), rel_tol=1e-9) and got["alone"] == got["all"] == 0


def test_ranking(spark):
    rows = spark.createDataFrame([("g", i, float(10 - i), float(i)) for i in range(10)], "g string, id int, confidence double, risk double")
    got = {r.coverage: r.mean_risk for r in K.risk_coverage(rows, ["g"]).collect()}
    assert got == {1.0: 4.5, 0.75: 3.5, 0.5: 2.0, 0.25: 0.5, 0.1: 0.0}
    assert K.area_under_risk_coverage(rows, ["g"]).first().aurc == np.mean([i / 2 for i in range(10)])
    curve = spark.createDataFrame([("a", 1, 0.1), ("a", 10, 0.3), ("a", 100, 0.9), ("b", 1, 0.0)], "g string, k int, v double")
    at = {r.g: r.k_star for r in K.log_crossing(curve, ["g"], 0.6).collect()}
    assert math.isclose(at["a"], 10**1.5) and at["b"] is None


def test_seed_for_equals_library(spark):
    row = spark.range(1).select(scalars.seed_for(F.lit("a:1")).alias("s")).first()
    assert row.s == G.seed_of("a", 1)


def test_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"season": "s", "partition": "p", "panel_id": "x", "contexts": ["a"], "control_label": "c",\n "n_genes": 5, "cells_per_pert": 2, "per_context": {"a": {"control_cells": 7}}}')
    r = tables.read_manifest(spark, str(tmp_path / "m.json")).select(F.col("per_context")["a"]["control_cells"].alias("n"), "n_genes").first()
    assert (r.n, r.n_genes) == (7, 5)
    (tmp_path / "bad.json").write_text('{"season": "s"}')
    with pytest.raises(Exception, match="manifest lacks"):
        tables.read_manifest(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "f.tsv").write_text("# comment\nrole\tcontext\ntarget\ta\nsource\tb\n")
    schema = T.StructType([T.StructField("role", T.StringType()), T.StructField("context", T.StringType())])
    assert tables.read_delimited(spark, str(tmp_path / "f.tsv"), schema, "\t").count() == 2
    (tmp_path / "s.gmt").write_text("set1\tdesc\tg1\tg2\nset2\tdesc\n")
    assert {tuple(x) for x in tables.read_gene_sets(spark, str(tmp_path / "s.gmt")).collect()} == {("set1", "g1"), ("set1", "g2")}
    (tmp_path / "a.gtf").write_text('#h\nchr1\tx\tgene\t5\t9\t.\t-\t.\tgene_name "A";\nchr1\tx\texon\t5\t9\t.\t+\t.\tgene_name "A";\nchr2\tx\tgene\t3\t8\t.\t+\t.\tgene_name "B";\n')
    assert {tuple(x) for x in tables.read_annotation(spark, str(tmp_path / "a.gtf")).collect()} == {("A", "chr1", "-", 9), ("B", "chr2", "+", 3)}
    df = spark.range(10).withColumn("p", F.col("id") % 2)
    tables.write_table(df, str(tmp_path / "t"), ["p"])
    assert spark.read.parquet(str(tmp_path / "t")).filter("p = 1").count() == 5


def test_stream_equals_batch(spark, tmp_path, rng):
    rows = [(f"k{i % 3}", float(v), i) for i, v in enumerate(rng.normal(size=90))]
    df = spark.createDataFrame(rows, "k string, value double, i int")
    for part in range(3):
        df.filter(F.col("i") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = stream.stream_tables(spark, str(tmp_path / "in"), df.schema)
    q = stream.running_moments(s, ["k"], "value").writeStream.outputMode("complete").format("memory").queryName("m").start()
    q.processAllAvailable()
    q.stop()
    got, want = spark.table("m").orderBy("k").toPandas(), A.moments(df, ["k"]).orderBy("k").toPandas()
    assert np.allclose(got[["n", "mean", "variance"]].astype(float), want[["n", "mean", "variance"]].astype(float))
    timed = stream.windowed_moments(s.withColumn("t", F.timestamp_seconds("i")), ["k"], "value", "t", "30 seconds", "10 seconds")
    q = timed.writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {"window", "k", "n", "mean", "variance"} <= set(spark.table("w").columns)


def test_ridge_toward_a_prior(spark, rng):
    from tesserae.operators import calibration as B

    x, y = rng.normal(size=(12, 3)), rng.normal(size=12)
    b, w = B.solve_toward(x, y, 0.25, 2.0)
    cost = lambda b, w: ((y - b - x @ w) ** 2).sum() + 2.0 * ((w - 0.25) ** 2).sum()
    assert all(cost(b + e, w) >= cost(b, w) for e in (-1e-3, 1e-3))
    assert all(cost(b, w + e * np.eye(3)[i]) >= cost(b, w) for e in (-1e-3, 1e-3) for i in range(3))
    far, flat = B.solve_toward(x, y, 0.25, 1e12)
    assert np.allclose(flat, 0.25)
    rows = [("g", f"p{i}", [float(v) for v in x[i]], float(y[i]), i < 4, 0.75) for i in range(12)]
    df = spark.createDataFrame(rows, "gene string, perturbation string, sources array<double>, y double, is_anchor boolean, s double")
    got = {r.perturbation: r.e3 for r in B.per_gene_ridge(df).collect()}
    unit = ((x[:4] - x[:4].mean(axis=0)) ** 2).sum(axis=0).mean()
    b, w = B.solve_toward(x[:4], y[:4], 0.25, 100 * unit)
    assert all(math.isclose(got[f"p{i}"], b + x[i] @ w) for i in range(12))
    # Target values that are no anchors must not matter.
    changed = df.withColumn("y", F.when(F.col("is_anchor"), F.col("y")).otherwise(1e6))
    assert {r.perturbation: r.e3 for r in B.per_gene_ridge(changed).collect()} == got


def test_null_worlds_repeat(spark):
    from tesserae.operators import calibration as B

    worlds = spark.createDataFrame([(f"w{i}", 5, 200, 0.0, 0.5) for i in range(40)], "world string, contexts int, genes int, tau2 double, sigma2 double")
    one, two = (sorted(map(tuple, B.simulate_null(worlds.repartition(n), 3).collect())) for n in (1, 3))
    assert one == two
    assert abs(np.mean([r[1] for r in one]) - 1 / 1.5) < 0.03


def test_expression_error_equals_dense(spark, rng):
    from tesserae.operators import calibration as B

    p, r, c = rng.normal(size=(4, 6)), rng.normal(size=(4, 6)), rng.normal(size=6)
    cp, cr, cc, own = rng.random(4) * 6, rng.random(4), 0.3, [2, None, 0, None]
    rows = [(f"t{i}", f"g{k}", None if own[i] is None else f"g{own[i]}", float(p[i, k]), float(r[i, k]), float(c[k])) for i in range(4) for k in range(6)]
    got = B.expression_error(
        spark.createDataFrame(rows, "target string, gene string, own string, p double, r double, c double"),
        spark.createDataFrame([(f"t{i}", float(cp[i]), float(cr[i])) for i in range(4)], "target string, cp double, cr double"), F.lit(cc),
    ).first()
    keep = np.array([[k != own[i] for k in range(6)] for i in range(4)], dtype=float)
    g = keep.sum(axis=1)
    w = keep / g[:, None]
    mean = (w * p).sum(axis=0) / w.sum(axis=0)
    rho = min(1, (w * (p - mean) ** 2).sum() / (np.minimum(cp, cr) / g).sum())
    num = (((p - r) ** 2 * keep).sum(axis=1) - rho * np.minimum(cp, cr) - cr) / g
    den = (((r - c) ** 2 * keep).sum(axis=1) - cr - cc) / g
    assert math.isclose(got.rho, rho) and math.isclose(got.error, num.sum() / den.sum())


def test_one_penalty_serves_all_genes(spark, rng):
    from tesserae.operators import calibration as B

    rows, data = [], {}
    for g in range(6):
        x = rng.normal(size=(14, 3))
        y = x @ rng.normal(size=3) + rng.normal(size=14) * (g + 0.1)
        data[g] = x, y
        rows += [(f"g{g}", f"p{i}", [float(v) for v in x[i]], float(y[i]), i < 9, 0.6) for i in range(14)]
    got = {(r.gene, r.perturbation): r.e3 for r in B.per_gene_ridge(spark.createDataFrame(rows, "gene string, perturbation string, sources array<double>, y double, is_anchor boolean, s double")).collect()}
    loss = []
    for rel in B.RELATIVE:
        total = 0.0
        for x, y in data.values():
            unit = ((x[:9] - x[:9].mean(axis=0)) ** 2).sum(axis=0).mean()
            xt = np.column_stack((np.ones(9), x[:9]))
            inv = np.linalg.inv(xt.T @ xt + rel * unit * np.diag([0, 1, 1, 1]))
            z = y[:9] - x[:9] @ np.full(3, 0.2)
            e = (z - xt @ inv @ xt.T @ z) / (1 - np.diag(xt @ inv @ xt.T))
            total += (e * e).sum()
        loss.append(total)
    best = B.RELATIVE[int(np.argmin(loss))]
    for g, (x, y) in data.items():
        b, w = B.solve_toward(x[:9], y[:9], 0.2, best * B.penalty_unit(x[:9]))
        assert all(math.isclose(got[f"g{g}", f"p{i}"], b + x[i] @ w, rel_tol=1e-9, abs_tol=1e-9) for i in range(14))


def test_estimators_see_no_target_values_off_anchors(spark, rng):
    from tesserae.operators import calibration as B

    df = spark.createDataFrame(grid(rng), RESP)
    anchors = spark.createDataFrame([("p0",), ("p1",), ("p2",)], "perturbation string")
    hidden = df.withColumn("delta", F.when((F.col("context") == "c0") & ~F.col("perturbation").isin("p0", "p1", "p2"), 1e6).otherwise(F.col("delta")))
    a, b = (sorted(tuple(r) for r in B.anchored(B.source_view(d, "c0"), anchors).select("perturbation", "gene", "e0", "e0s", "e1", "e2").collect()) for d in (df, hidden))
    assert a == b


def test_slots_are_never_broadcast(spark):
    """Spark takes exploded slots for a few bytes; beyond its threshold they would be gathered by the driver."""
    rows = spark.range(150_000).select(F.col("id").alias("pos"), (F.col("id") % 7 + 1.0).alias("num"), (F.col("id") % 5 + 9.0).alias("den"))
    taken = R.slots(rows, 3, 29).join(rows, "pos")
    plan = taken._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {tuple(r) for r in taken.groupBy("draw").count().collect()} == {(d, 150_000) for d in range(3)}  # a draw is listed in runs
    assert R.slots(rows.limit(0), 3, 29).count() == 0


def test_drawn_counts_of_many_cells_leave_a_task_together(spark, monkeypatch):
    sizes = []
    made = spark.range(0, 300, 1, 1).select(F.lit("t").alias("target"), F.col("id").alias("cell"), F.lit(30.0).alias("depth"), F.array(*map(F.lit, "abcd")).alias("genes"), F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4))).alias("shares"))
    of = {}
    monkeypatch.setattr(type(made), "mapInPandas", lambda df, f, schema: of.update(f=f) or df)
    for kind in G.KINDS:
        G.draw_counts(made, kind, 3)
        out = list(of["f"](iter([made.toPandas(), made.limit(0).toPandas()])))
        sizes.append(len(out))
        got = {(r.cell, r.gene): r.value for r in out[0].itertuples()}
        for cell in (0, 299):
            rng, p = np.random.default_rng(G.seed_of(3, "t", cell)), np.array([0.1, 0.2, 0.3, 0.4]) / np.sum([0.1, 0.2, 0.3, 0.4])
            x = {"multinomial": lambda: rng.multinomial(30, p), "gamma_poisson": lambda: rng.poisson(30.0 * p * rng.gamma(5.0, 0.2, 4)), "binomial": lambda: rng.binomial(30, p)}[kind]()
            assert {g: v for (c, g), v in got.items() if c == cell} == {g: v for g, v in zip("abcd", x, strict=True) if v}
    assert sizes == [1, 1, 1]
