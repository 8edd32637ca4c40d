"""Transfer of responses to a target context: baselines, anchored estimators, metric terms and their selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.anova import loo_scale
from tesserae.operators.generate import seed_of

AXIS = ["perturbation", "gene"]


def source_view(resp: DataFrame, target: str) -> DataFrame:
    """perturbation, gene, a (mean over the other contexts), t (its mean over perturbations), s (their pooled scale), y (target)."""
    sources = resp.filter(F.col("context") != target)
    a = sources.groupBy(*AXIS).agg(F.avg("delta").alias("a"))
    y = resp.filter(F.col("context") == target).select(*AXIS, F.col("delta").alias("y"))
    v = a.withColumn("t", F.avg("a").over(Window.partitionBy("gene"))).join(y, AXIS, "left")
    return v.crossJoin(F.broadcast(loo_scale(sources).withColumnRenamed("scale", "s")))


def anchored(view: DataFrame, anchors: DataFrame) -> DataFrame:
    """Adds e0, e0s, e1, e2: source mean, scaled source mean, template offset and affine fit on anchors.

    anchors: perturbation. Target values of other rows are not used.
    """
    v = view.join(F.broadcast(anchors.select("perturbation", F.lit(True).alias("is_anchor"))), "perturbation", "left")
    v = v.withColumn("is_anchor", F.coalesce("is_anchor", F.lit(False)))
    e0s = F.col("t") + F.col("s") * (F.col("a") - F.col("t"))
    gene = Window.partitionBy("gene")

    def on_anchors(c: Column) -> Column:
        return F.avg(F.when(F.col("is_anchor"), c)).over(gene)

    v = v.withColumns({"e0": F.col("a"), "e0s": e0s}).withColumns(
        {"offset": on_anchors(F.col("y") - F.col("e0s")), "y_k": on_anchors(F.col("y")), "a_k": on_anchors(F.col("a")), "at_k": on_anchors(F.col("a") - F.col("t"))}
    )
    ya, aa = F.col("y") - F.col("y_k"), F.col("a") - F.col("a_k")
    one = v.filter("is_anchor").agg(
        F.when((F.countDistinct("perturbation") >= 2) & (F.sum(aa * aa) > 0), F.sum(ya * aa) / F.sum(aa * aa)).alias("s2")
    )
    v = v.crossJoin(F.broadcast(one)).withColumn("s2", F.coalesce("s2", "s"))
    c = F.col("y_k") - F.col("s2") * F.col("at_k")
    return v.withColumns({"e1": F.col("e0s") + F.col("offset"), "e2": c + F.col("s2") * (F.col("a") - F.col("t"))}).drop("offset", "y_k", "a_k", "at_k")


def metric_terms(rows: DataFrame, prediction: str) -> DataFrame:
    """One row M0 to M4 of a prediction against two halves e1, e2 with the source mean a.

    M0 raw, M1 centred over perturbations, M2 along and M3 across the unit centred source mean, M4 M1's error over the source
    mean's own.
    """
    gene, row = Window.partitionBy("gene"), Window.partitionBy("perturbation")
    centre = lambda c: F.col(c) - F.avg(c).over(gene)
    r = rows.withColumns({"c1": centre("e1"), "c2": centre("e2"), "ca": centre("a"), "cp": centre(prediction)})
    norm = F.sqrt(F.sum(F.col("ca") * F.col("ca")).over(row))
    r = r.withColumn("u", F.when(norm > 1e-12, F.col("ca") / norm).otherwise(0.0))
    x1, x2 = F.col("c1") - F.col("cp"), F.col("c2") - F.col("cp")
    p = F.col(prediction)
    u = F.col("u")
    per = r.groupBy("perturbation").agg(
        F.sum((F.col("e1") - p) * (F.col("e2") - p)).alias("n0"), F.sum(F.col("e1") * F.col("e2")).alias("d0"),
        F.sum(x1 * x2).alias("n1"), F.sum(F.col("c1") * F.col("c2")).alias("d1"),
        (F.sum(x1 * u) * F.sum(x2 * u)).alias("n2"), (F.sum(F.col("c1") * u) * F.sum(F.col("c2") * u)).alias("d2"),
        F.sum((F.col("c1") - F.col("ca")) * (F.col("c2") - F.col("ca"))).alias("d4"),
    )
    total = per.agg(*[F.sum(c).alias(c) for c in ("n0", "d0", "n1", "d1", "n2", "d2", "d4")])
    m = lambda n, d: F.when(F.abs(d) > 1e-12, 1 - n / d)
    c = F.col
    return total.select(
        m(c("n0"), c("d0")).alias("m0"), m(c("n1"), c("d1")).alias("m1"), m(c("n2"), c("d2")).alias("m2"),
        m(c("n1") - c("n2"), c("d1") - c("d2")).alias("m3"), m(c("n1"), c("d4")).alias("m4"),
    )


def select_shrinkage(resp: DataFrame, grid: tuple[float, ...]) -> DataFrame:
    """Leave-one-context-out error of main effect + weight * beta for each weight, and the first best one.

    For a held context, the main effect is the mean over the others and perturbations, beta the others' centred mean.
    """
    whole = Window.partitionBy(*AXIS)
    n = F.count("delta").over(whole)
    r = resp.withColumn("others", (F.sum("delta").over(whole) - F.col("delta")) / (n - 1))
    m = F.avg("others").over(Window.partitionBy("context", "gene"))
    r = r.withColumn("m", m).withColumn("w", F.explode(F.array(*[F.lit(w) for w in grid])))
    e = F.col("delta") - F.col("m") - F.col("w") * (F.col("others") - F.col("m"))
    err = r.groupBy("w").agg(F.avg(e * e).alias("error"))
    best = err.agg(F.min(F.struct(F.round("error", 9).alias("e"), "w"))["w"].alias("best"))
    return err.crossJoin(F.broadcast(best)).select("w", "error", (F.col("w") == F.col("best")).alias("chosen"))


def exchangeable(resp: DataFrame, sigma2: str) -> DataFrame:
    """Per perturbation and gene: mean over contexts and the variance between them beyond their noise."""
    return resp.groupBy(*AXIS).agg(F.avg("delta").alias("m"), F.greatest(F.lit(0.0), F.var_samp("delta") - F.avg(sigma2)).alias("tau2"))


def expression_error(rows: DataFrame, dispersions: DataFrame, control_dispersion: Column) -> DataFrame:
    """One row: corrected squared error over corrected effect of predictions p against truth r and control c.

    rows: target, gene, own (the target's own gene or null), p, r, c; dispersions: target, cp, cr, one number each for a target's prediction
    and truth, and control_dispersion one for all. A target's own gene is left out of its two distances. The credit for a prediction's own
    noise is capped by how far predictions differ from their mean, in which a target weighs one over its kept genes.
    """
    kept = rows.filter(~F.col("own").eqNullSafe(F.col("gene")))
    r = kept.withColumn("w", 1 / F.count(F.lit(1)).over(Window.partitionBy("target")))
    gene = Window.partitionBy("gene")
    r = r.withColumn("mp", F.sum(F.col("w") * F.col("p")).over(gene) / F.sum("w").over(gene))
    sq = lambda a, b: F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    per = r.groupBy("target").agg(sq("p", "r").alias("err"), sq("r", "c").alias("eff"), sq("p", "mp").alias("spread"), F.count(F.lit(1)).alias("g"))
    per = per.join(dispersions, "target").withColumn("credit", F.least("cp", "cr"))
    rho = per.agg(F.sum(F.col("spread") / F.col("g")).alias("s"), F.sum(F.col("credit") / F.col("g")).alias("k")).select(
        F.when(F.col("k") > 0, F.least(F.lit(1.0), F.col("s") / F.col("k"))).otherwise(1.0).alias("rho")
    )
    x = per.crossJoin(F.broadcast(rho))
    num = (F.col("err") - F.col("rho") * F.col("credit") - F.col("cr")) / F.col("g")
    den = (F.col("eff") - F.col("cr") - control_dispersion) / F.col("g")
    return x.agg((F.sum(num) / F.sum(den)).alias("error"), F.first("rho").alias("rho"))


# Relative penalties, and the number of anchors below which the largest one is taken.
RELATIVE = (0.01, 0.1, 1.0, 10.0, 100.0)
FEW = 5


def solve_toward(x: np.ndarray, y: np.ndarray, prior: float, lam: float) -> tuple[float, np.ndarray]:
    """Intercept and weights of least squares with a penalty on the distance of every weight from `prior`."""
    mx, my = x.mean(axis=0), y.mean()
    xc = x - mx
    w = prior + np.linalg.solve(xc.T @ xc + lam * np.eye(x.shape[1]), xc.T @ (y - my - xc @ np.full(x.shape[1], prior)))
    return float(my - mx @ w), w


def penalty_unit(x: np.ndarray) -> float:
    """The mean of the centred Gram diagonal, which relative penalties multiply."""
    return max(float(((x - x.mean(axis=0)) ** 2).sum(axis=0).mean()), 1e-12)


def left_out_errors(x: np.ndarray, y: np.ndarray, prior: float) -> list[float]:
    """For each relative penalty the sum of squared leave-one-out errors, from residuals and the diagonal of the hat matrix."""
    xc, unit, out = x - x.mean(axis=0), penalty_unit(x), []
    for rel in RELATIVE:
        b, w = solve_toward(x, y, prior, rel * unit)
        h = 1 / len(y) + np.einsum("ki,ki->k", xc, np.linalg.solve(xc.T @ xc + rel * unit * np.eye(x.shape[1]), xc.T).T)
        out.append(float((((y - b - x @ w) / np.maximum(1 - h, 1e-6)) ** 2).sum()))
    return out


def per_gene_ridge(rows: DataFrame) -> DataFrame:
    """perturbation, gene, e3 from rows gene, perturbation, sources ARRAY, y, is_anchor, s: each gene's ridge on its anchors.

    One relative penalty serves all genes: the one with the least leave-one-out error over all of them, the largest where there are fewer
    than FEW anchors. A group is one gene's perturbation axis; genes spread over the tasks, and one sum for each penalty comes back.
    """

    def arrays(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
        x = np.array(g["sources"].tolist(), dtype=float)
        return x, g["y"].to_numpy(dtype=float), float(g["s"].iloc[0]) / x.shape[1]

    def errors(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(g)], "errors": [left_out_errors(*arrays(g))]})

    anchors = rows.filter("is_anchor").groupBy("gene").applyInPandas(errors, "n long, errors array<double>")
    total = anchors.agg(F.min("n").alias("n"), *[F.sum(F.col("errors")[i]).alias(f"e{i}") for i in range(len(RELATIVE))]).first()
    best = RELATIVE[-1]
    if total["n"] and total["n"] >= FEW:
        best = RELATIVE[int(np.argmin([total[f"e{i}"] for i in range(len(RELATIVE))]))]

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x, y, prior = arrays(g)
        k = g["is_anchor"].to_numpy(dtype=bool)
        out = g[["perturbation", "gene"]].copy()
        if not k.any():
            return out.assign(e3=x.mean(axis=1))
        b, w = solve_toward(x[k], y[k], prior, best * penalty_unit(x[k]))
        return out.assign(e3=b + x @ w)

    return rows.groupBy("gene").applyInPandas(fit, "perturbation string, gene string, e3 double")


def simulate_null(worlds: DataFrame, seed: int) -> DataFrame:
    """world, agreement, error: worlds in which contexts are exchangeable around one mean with variance tau2 and noise sigma2.

    worlds: world, contexts, genes, tau2, sigma2. agreement is the mean pairwise correlation of the first contexts - 1 noisy
    responses, error the squared distance of their mean from the last context's, per gene. Each world is a row with a seed of its own.
    """

    def draw(batches):
        for b in batches:
            out = []
            for d, contexts, genes, tau2, sigma2 in b[["world", "contexts", "genes", "tau2", "sigma2"]].itertuples(index=False):
                rng = np.random.default_rng(seed_of(seed, d))
                y = rng.normal(size=genes) + rng.normal(scale=tau2**0.5, size=(contexts, genes)) + rng.normal(scale=sigma2**0.5, size=(contexts, genes))
                r = np.corrcoef(y[:-1])[np.triu_indices(contexts - 1, 1)]
                out.append((d, float(r.mean()), float(((y[:-1].mean(axis=0) - y[-1]) ** 2).mean())))
            yield pd.DataFrame(out, columns=["world", "agreement", "error"])

    return worlds.mapInPandas(draw, "world string, agreement double, error double")
