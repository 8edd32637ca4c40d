"""Small models: the statistics come from Spark, only solves of a few columns run on the driver or per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PANEL = 10_000  # rows of a panel whose kernel is held at once


def gram(rows: DataFrame, features: list[str], target: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Centred cross products of a few features and a target, from one aggregation: matrix, vector, rows."""
    cols = [*features, target]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    r = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)], *sums).first()
    n, k = r["n"], len(cols)
    full = np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    mean = np.array([r[f"s{i}"] for i in range(k)], dtype=float)
    centred = full - np.outer(mean, mean) / max(n, 1)
    return centred[:-1, :-1], centred[:-1, -1], n


def fit_ridge(rows: DataFrame, features: list[str], target: str, alpha: float) -> np.ndarray:
    """Ridge coefficients with an intercept that is not penalised (first)."""
    xx, xy, n = gram(rows, features, target)
    beta = np.linalg.solve(xx + alpha * np.eye(len(features)), xy)
    means = rows.agg(*[F.avg(c).alias(c) for c in [*features, target]]).first()
    return np.concatenate(([means[target] - sum(b * means[f] for b, f in zip(beta, features, strict=True))], beta))


def predict_linear(rows: DataFrame, features: list[str], beta: np.ndarray, name: str = "predicted") -> DataFrame:
    out = F.lit(float(beta[0]))
    for b, f in zip(beta[1:], features, strict=True):
        out = out + float(b) * F.col(f)
    return rows.withColumn(name, out)


def simplex_weights(gram_: np.ndarray, target: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Non-negative weights with sum 1 that approximate a target from a few sources: coordinate descent, then renormalised."""
    w = np.zeros(len(target))
    for _ in range(steps):
        old = w.copy()
        for i in range(len(w)):
            if gram_[i, i] > 0:
                w[i] = max(0.0, w[i] + (target[i] - gram_[i] @ w) / gram_[i, i])
        if np.abs(w - old).max() < 1e-14:
            break
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))


def affine_weights(gram_: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights with sum 1 that approximate a target best, from the stationarity equations."""
    k = len(target)
    a = np.block([[gram_, np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
    return np.linalg.lstsq(a, np.concatenate((target, [1.0])), rcond=None)[0][:k]


def fit_isotonic(rows: DataFrame, x: str, y: str, increasing: bool = True) -> DataFrame:
    """Adds fitted: the monotone regression of y on x."""
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol=x, labelCol=y, predictionCol="fitted", isotonic=increasing).fit(rows)
    return model.transform(rows)


def fit_pca(rows: DataFrame, vec: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, first k components and their variance shares of short vectors, from one pass of cross products.

    The products of a vector of d elements are d * d sums whatever the number of rows; the largest element of each component is
    positive, so that signs are settled.
    """
    d = len(rows.select(vec).first()[0])
    pos = rows.select(F.monotonically_increasing_id().alias("row"), vec)

    def partial(batches):
        n, s, ss = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            x = np.array(b[vec].tolist(), dtype=float)
            if len(x):
                n, s, ss = n + len(x), s + x.sum(axis=0), ss + x.T @ x
        yield pd.DataFrame({"i": np.arange(d * d), "n": n, "s": np.resize(s, d * d), "ss": ss.ravel()})

    sums = pos.mapInPandas(partial, "i long, n long, s double, ss double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    t = sums.orderBy("i").toPandas()
    n, s, ss = int(t["n"][0]), t["s"].to_numpy()[:d], t["ss"].to_numpy().reshape(d, d)
    mean = s / n
    value, vector = np.linalg.eigh(ss / n - np.outer(mean, mean))
    order = np.argsort(-value)[:k]
    parts = vector[:, order].T
    parts *= np.sign(parts[np.arange(k), np.abs(parts).argmax(axis=1)])[:, None]
    return mean, parts, value[order] / value.sum()


def apply_pca(rows: DataFrame, vec: str, mean: np.ndarray, parts: np.ndarray) -> DataFrame:
    """Adds scores: centred vectors on the components, by array functions."""
    centred = F.zip_with(F.col(vec).cast("array<double>"), F.array(*[F.lit(float(m)) for m in mean]), lambda v, m: v - m)
    rows = rows.withColumn("centred", centred)
    scores = [
        F.aggregate(F.zip_with("centred", F.array(*[F.lit(float(v)) for v in p]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for p in parts
    ]
    return rows.withColumn("scores", F.array(*scores)).drop("centred")


def kernel_ridge(rows: DataFrame, keys: list[str], alpha: float, schema: str) -> DataFrame:
    """Per group of anchors and queries (id, is_anchor, vec, y): kernel ridge on cosine kernels, predictions for all rows.

    A group is a panel of one fold, a few hundred rows by design; its solve is a k x k system. More than MAX_PANEL rows are an error.
    """

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > MAX_PANEL:
            raise ValueError(f"a panel of {len(g)} rows; at most {MAX_PANEL} are solved together")
        x = np.array(g["vec"].tolist(), dtype=float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        a = g["is_anchor"].to_numpy(dtype=bool)
        k, y = x @ x[a].T, g["y"].to_numpy(dtype=float)[a]
        g = g.copy()
        g["predicted"] = y.mean() + k @ np.linalg.solve(k[a] + alpha * np.eye(a.sum()), y - y.mean()) if a.any() else 0.0
        return g[[*keys, "id", "predicted"]]

    return rows.groupBy(*keys).applyInPandas(solve, schema)


def subspace_map(alphas: DataFrame, deviations: DataFrame, target: DataFrame, n_components: int = 2, ridge: float = 1.0, tolerance: float = 1e-10) -> DataFrame:
    """gene, predicted: a target's response template from its basal deviation, by ridge on the low-rank space of the sources' deviations.

    alphas: source, gene, alpha; deviations: source, gene, dev; target: gene, dev. Sources are few and genes many, so singular vectors
    come from the products of sources with each other, and the map is one coefficient a source; nothing of genes x genes exists.
    Directions without length (a rank below the number of sources) carry nothing. A gene that a source lacks counts as zero.
    """
    both = deviations.select("source", "gene", "dev").unionByName(target.select(F.lit(None).cast("string").alias("source"), "gene", "dev"))
    names = sorted(r[0] for r in deviations.select("source").distinct().collect())  # an axis of sources
    wide = both.groupBy("gene").agg(*[F.sum(F.when(F.col("source") == n, F.col("dev")).otherwise(0.0)).alias(f"x{i}") for i, n in enumerate(names)], F.sum(F.when(F.col("source").isNull(), F.col("dev")).otherwise(0.0)).alias("t"))
    k = len(names)
    cols = [F.col(f"x{i}") for i in range(k)] + [F.col("t")]
    centre = sum(cols[:k], F.lit(0.0)) / k
    c = wide.select(*[(x - centre).alias(f"c{i}") for i, x in enumerate(cols)])
    r = c.agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"p{i}_{j}") for i in range(k + 1) for j in range(i + 1)]).first()
    p = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], dtype=float)
    square, u = np.linalg.eigh(p[:k, :k])
    keep = [i for i in np.argsort(-square, kind="stable")[: min(n_components, k)] if square[i] > tolerance * max(square.max(), 1e-300)]
    # Coordinates of the target are u' c(t) / s, the map has s / (s^2 + ridge): the lengths s cancel.
    coefficient = u[:, keep] @ ((u[:, keep].T @ p[:k, k]) / (square[keep] + ridge))
    weights = alphas.sparkSession.createDataFrame(list(zip(names, map(float, coefficient), strict=True)), "source string, w double")
    return alphas.join(F.broadcast(weights), "source").groupBy("gene").agg(F.sum(F.col("w") * F.col("alpha")).alias("predicted"))
