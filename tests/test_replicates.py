"""Replicate anchors against scoring the two halves one by one."""

import hashlib
import math

import numpy as np

from tesserae.operators import replicates
from tesserae.operators.replicates import replicate_anchor


def rank_p(x, y):
    """Two-sided asymptotic Mann-Whitney p with ties and continuity."""
    both = np.concatenate((x, y))
    values, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    n1, n0, n = len(x), len(y), len(both)
    u = rank[:n1].sum() - n1 * (n1 + 1) / 2
    sigma = math.sqrt(n1 * n0 / 12 * (n + 1 - (count**3 - count).sum() / (n * (n - 1))))
    z = (abs(u - n1 * n0 / 2) - 0.5) / sigma if sigma > 0 else 0
    return min(1.0, math.erfc(z / math.sqrt(2)))


def adjusted(p):
    order = np.argsort(p, kind="stable")
    out = np.empty(len(p))
    out[order] = np.minimum(1, np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
    return out


def bulk(x):
    return np.log1p(5e4 * x.sum(axis=0) / x.sum())


def jack(x):
    if len(x) < 2:
        return 0.0
    each = np.array([bulk(np.delete(x, i, axis=0)) for i in range(len(x))])
    return float(((len(x) - 1) / len(x) * ((each - each.mean(axis=0)) ** 2).sum(axis=0)).sum())


def test_anchor_equals_scoring_the_halves(spark):
    rng = np.random.default_rng(5)
    genes, targets, n = [f"g{k:02d}" for k in range(24)], ["g03", "g07", "t"], {"ctl": 60, "g03": 41, "g07": 30, "t": 24}
    base = rng.gamma(1.0, 4, size=24)
    label, x = [], []
    for t, m in n.items():
        shift = np.exp(rng.normal(size=24) * (0 if t == "ctl" else 0.9))
        label += [t] * m
        x.append(rng.poisson(base * shift, size=(m, 24)))
    label, x = np.array(label), np.concatenate(x).astype(float)
    x[:, 0] += 1
    x[:, 23] = 0
    x[0, 23] = 1
    cells = spark.createDataFrame([(i, str(t)) for i, t in enumerate(label)], "cell long, target string")
    values = spark.createDataFrame([(int(i), genes[k], float(x[i, k])) for i, k in zip(*np.nonzero(x), strict=True)], "cell long, gene string, value double")
    got = replicate_anchor(cells, values, "ctl", 9, ("g05",)).first()

    half = {}
    for t in n:
        own = sorted(np.flatnonzero(label == t), key=lambda i: (hashlib.md5(f"9:{t}:{i}".encode()).hexdigest(), i))
        half[t] = own[: len(own) // 2], own[len(own) // 2 :]
    cpm = np.round(1e6 * x / x.sum(axis=1, keepdims=True), 6)
    tested = np.flatnonzero(cpm[half["ctl"][1]].mean(axis=0) > 5)
    de = []
    for h in (0, 1):
        ctl = cpm[half["ctl"][h]][:, tested]
        rows = {}
        for t in targets:
            own = cpm[half[t][h]][:, tested]
            p = np.array([rank_p(own[:, k], ctl[:, k]) for k in range(len(tested))])
            rows[t] = p, adjusted(p), np.log2((own.mean(axis=0) + 1e-9) / (ctl.mean(axis=0) + 1e-9))
        de.append(rows)
    fid, reach, jac, nmae, n_pred, n_real, ks = [], [], [], [], [], [], []
    for t in targets:
        keep = np.array([genes[k] != t for k in tested])
        (pp, pa, pl), (_, ra, rl) = ([v[keep] for v in de[h][t]] for h in (0, 1))
        ps, rs, known = pa < 0.05, ra < 0.05, rl != 0
        k = (ps & known & (np.sign(pl) == np.sign(rl))).sum()
        n_pred.append((ps & known).sum()), n_real.append(rs.sum()), ks.append(k)
        fid.append(k / max(n_pred[-1], rs.sum()) if max(n_pred[-1], rs.sum()) else np.nan)
        jac.append((ps & rs).sum() / (ps | rs).sum() if (ps | rs).any() else 1.0)
        nmae.append(np.abs(pl - rl)[rs].sum() / np.abs(rl)[rs].sum() if rs.sum() >= 10 else np.nan)
        pool = sorted(np.flatnonzero(rs & known), key=lambda i: (not ps[i], pa[i], pp[i], -abs(pl[i]), i))
        pure = np.cumsum([np.sign(pl[i]) == np.sign(rl[i]) for i in pool]) / np.arange(1, len(pool) + 1)
        reach.append((max(np.flatnonzero(pure >= 0.9) + 1, default=0)) / rs.sum() if rs.sum() else np.nan)
    prof = [np.array([bulk(x[half[t][h]]) for t in targets]) for h in (0, 1)]
    ctl = bulk(x[half["ctl"][1]])
    use = [k for k in range(24) if k != 5]
    unit = [(p - ctl)[:, use] / np.linalg.norm((p - ctl)[:, use], axis=1, keepdims=True) for p in prof]
    d = np.round(1 - unit[0] @ unit[1].T, 9)
    own = np.diagonal(d)[:, None]
    pds = 1 - ((d < own).sum(axis=1) + 0.5 * ((d == own).sum(axis=1) - 1)) / 2
    assert np.allclose([got.pds, got.fidelity, got.reach, got.jaccard], [pds.mean(), np.nanmean(fid), np.nanmean(reach), np.mean(jac)])
    assert np.isclose(got.nmae, np.nanmean(nmae)) and got.predicted_median == np.median(n_pred) and got.real_median == np.median(n_real)
    assert np.isclose(got.precision, sum(ks) / max(1, sum(n_pred)))
    keep = np.array([[g != t for g in genes] for t in targets])
    cp, cr, c0 = [jack(x[half[t][0]]) for t in targets], [jack(x[half[t][1]]) for t in targets], jack(x[half["ctl"][1]])
    w = keep / keep.sum(axis=1, keepdims=True)
    mean = (w * prof[0]).sum(axis=0) / w.sum(axis=0)
    g = keep.sum(axis=1)
    credit = np.minimum(cp, cr)
    rho = min(1.0, (((prof[0] - mean) ** 2 * keep).sum(axis=1) / g).sum() / (credit / g).sum())
    num = (((prof[0] - prof[1]) ** 2 * keep).sum(axis=1) - rho * credit - cr) / g
    den = (((prof[1] - ctl) ** 2 * keep).sum(axis=1) - cr - c0) / g
    assert np.isclose(got.expression_error, num.sum() / den.sum(), rtol=1e-6)


def test_what_is_kept_grows_with_different_entries_and_not_with_cells(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.poisson(rng.gamma(1.0, 3, size=8), size=(12, 8)).astype(float)
    copies = 20
    cells = [(12 * k + i, "ctl" if i % 2 else "t") for k in range(copies) for i in range(12)]
    one = [(i, f"g{j}", x[i, j]) for i, j in zip(*(v.tolist() for v in np.nonzero(x)), strict=True)]
    values = [(12 * k + i, g, float(v)) for k in range(copies) for i, g, v in one]
    kept, keep = [], replicates.cut

    def noted(df):
        kept.append(keep(df))
        return kept[-1]

    monkeypatch.setattr(replicates, "cut", noted)
    got = replicate_anchor(spark.createDataFrame(cells, "cell long, target string"), spark.createDataFrame(values, "cell long, gene string, value double"), "ctl", 9).collect()
    assert len(got) == 1 and max(df.count() for df in kept) <= 2 * len(one) < len(values)
    r = kept[0].selectExpr("sum(m)", "sum(m * value)", "sum(starts)").first()
    assert tuple(r) == (len(values), copies * x.sum(), copies * (x.sum(axis=1) > 0).sum())
