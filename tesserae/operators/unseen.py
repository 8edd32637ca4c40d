"""Predictions for perturbations that were never measured: splits along two axes and predictors from features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalars import cosine, pearson, ratio
from tesserae.operators.resample import folds

MAX_AXIS_VALUES = 1 << 25  # numbers in the features of all perturbations, or in the splits: what the driver and every task hold
SPLIT = ["regime", "target", "fold"]


def two_axis_splits(contexts: DataFrame, perturbations: DataFrame, n_folds: int, seed: int) -> DataFrame:
    """regime, target, fold, perturbation, part: whether a perturbation trains or tests in each split.

    P1 holds out a fold of perturbations from every context at once and reads all contexts; P2 also holds out the target
    context. The two axes are small tables of distinct names.
    """
    if n_folds < 2:
        raise ValueError("at least two folds")
    dealt = folds(perturbations.select("perturbation"), "perturbation", n_folds, seed)
    tested = perturbations.sparkSession.range(n_folds).select(F.col("id").cast("int").alias("fold"))
    one = perturbations.sparkSession.range(1).select(F.lit("P1").alias("regime"), F.lit(None).cast("string").alias("target"))
    regimes = one.union(contexts.select(F.lit("P2"), "context"))
    rows = dealt.withColumnRenamed("fold", "own").crossJoin(F.broadcast(tested)).crossJoin(F.broadcast(regimes))  # axes only
    return rows.select(*SPLIT, "perturbation", F.when(F.col("own") == F.col("fold"), "test").otherwise("train").alias("part"))


def refuse_leaks(splits: DataFrame) -> DataFrame:
    """The splits, or an error: a perturbation that both trains and tests, or a P2 without a context held out."""
    both = splits.groupBy(*SPLIT, "perturbation").agg(F.countDistinct("part").alias("parts"), F.first("part").alias("part"))
    return both.select(
        *[F.when(F.col("parts") > 1, F.raise_error(F.lit("a perturbation both trains and tests"))).otherwise(F.col(c)).alias(c) for c in ("regime",)],
        F.when((F.col("regime") == "P2") & F.col("target").isNull(), F.raise_error(F.lit("P2 needs a target context"))).otherwise(F.col("target")).alias("target"),
        "fold", "perturbation", "part",
    )


def smoother(kind: str, train: np.ndarray, test: np.ndarray, alpha: float, k: int, components: int | None) -> np.ndarray:
    """Weights (test x train) that a predictor gives the training responses; they depend on features alone.

    zero: none. nearest: the most similar one by cosine. knn: the k most similar by their similarity, negative ones left out.
    ridge: least squares with penalty alpha, by the Gram matrix of features or of rows, whichever is smaller. The responses are
    centred over training perturbations, and so are these weights.
    """
    if components is not None:
        centre = train.mean(axis=0)
        axes = np.linalg.svd(train - centre, full_matrices=False)[2][:components]
        train, test = (train - centre) @ axes.T, (test - centre) @ axes.T
    if kind == "zero":
        return np.zeros((len(test), len(train)))
    if kind == "ridge":
        x, t = train - train.mean(axis=0), test - train.mean(axis=0)
        n, d = x.shape
        if d <= n:
            return t @ np.linalg.solve(x.T @ x + alpha * np.eye(d), x.T)
        return t @ np.linalg.solve(x @ x.T + alpha * np.eye(n), x).T
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    like = unit(test) @ unit(train).T
    out = np.zeros_like(like)
    rows = np.arange(len(like))[:, None]
    if kind == "nearest":
        out[rows[:, 0], like.argmax(axis=1)] = 1.0
        return out
    if kind == "knn":
        top = np.argsort(-like, axis=1, kind="stable")[:, : min(k, like.shape[1])]
        weight = np.maximum(like[rows, top], 0.0)
        total = weight.sum(axis=1, keepdims=True)
        out[rows, top] = np.where(total > 0, weight / np.where(total > 0, total, 1.0), 0.0)
        return out
    raise ValueError(f"no predictor {kind}")


def predict_unseen(
    responses: DataFrame, features: DataFrame, splits: DataFrame, kind: str = "ridge", alpha: float = 1.0, k: int = 10, components: int | None = None
) -> DataFrame:
    """regime, target, fold, perturbation, gene, predicted: the effect that source contexts share, for each split's test perturbations.

    responses: context, perturbation, gene, delta on a whole grid; features: perturbation, features ARRAY<DOUBLE>.

    The shared effect is the mean over source contexts less its mean over training perturbations; nothing else of the responses is
    read. Predictors are weights over training perturbations, made once a split from features, so that genes, each one row of its
    grid, are dealt over tasks and meet all splits there. The two axes and the features are held by every task; their size is
    checked. A grid with holes, or a perturbation without features, is refused.
    """
    spark = responses.sparkSession
    contexts = sorted(r[0] for r in responses.select("context").distinct().collect())
    table = refuse_leaks(splits)
    width = features.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).first()
    if width.n * (width.d or 0) > MAX_AXIS_VALUES or table.count() > MAX_AXIS_VALUES:
        raise ValueError("the axis of perturbations is too large to be held by every task")
    vectors = {r.perturbation: np.asarray(r.features, dtype=float) for r in features.collect()}
    names = sorted(r[0] for r in responses.select("perturbation").distinct().collect())
    if missing := [n for n in names if n not in vectors]:
        raise ValueError(f"no features for {missing[:3]}")
    x = np.array([vectors[n] for n in names])
    at = {n: i for i, n in enumerate(names)}
    plans: dict[tuple, tuple[list, list]] = {}
    for r in table.collect():
        if r.perturbation in at:
            plans.setdefault((r.regime, r.target, r.fold), ([], []))[r.part == "test"].append(at[r.perturbation])
    whole = len(contexts) * len(names)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = []
        for (regime, target, fold), (train, test) in sorted(plans.items(), key=str):
            train, test = np.sort(train), np.sort(test)
            if len(train) and len(test):
                weights = smoother(kind, x[train], x[test], alpha, k, components)
                ready.append((regime, target, fold, [i for i, c in enumerate(contexts) if c != target], train, test, weights))
        labels = np.array(names, dtype=object)
        for b in batches:
            grid = np.array(b["grid"].tolist()).reshape(len(b), len(contexts), len(names))
            for regime, target, fold, sources, train, test, weights in ready:
                shared = grid[:, sources][:, :, train].mean(axis=1)
                beta = shared - shared.mean(axis=1, keepdims=True)
                yield pd.DataFrame(
                    {
                        "regime": regime, "target": target, "fold": fold, "perturbation": np.tile(labels[test], len(b)),
                        "gene": np.repeat(b["gene"].to_numpy(), len(test)), "predicted": (beta @ weights.T).ravel(),
                    }
                )

    axis = spark.createDataFrame([(c, p, i * len(names) + j) for i, c in enumerate(contexts) for j, p in enumerate(names)], "context string, perturbation string, place int")
    placed = responses.join(F.broadcast(axis), ["context", "perturbation"]).groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("place", "delta"))).alias("g"))
    full = F.when(F.size("g") == whole, F.transform("g", lambda s: s["delta"])).otherwise(F.raise_error(F.lit("the grid of responses has holes or repeats")))
    return placed.select("gene", full.alias("grid")).mapInPandas(solve, "regime string, target string, fold int, perturbation string, gene string, predicted double")


def evaluate_unseen(predicted: DataFrame, responses: DataFrame) -> DataFrame:
    """regime, target, fold, context, perturbation, pearson, cosine, unexplained: predictions against what each evaluated context shows.

    A split is evaluated in its target, or in all contexts. What a context shows of a perturbation is its response less the
    context's mean over the fold's tested perturbations.
    """
    tested = predicted.select(*SPLIT, "perturbation", "gene", "predicted")
    seen = tested.join(responses.select("context", "perturbation", "gene", "delta"), ["perturbation", "gene"]).filter("target is null or target = context")
    keys = [*SPLIT, "context"]
    middle = seen.groupBy(*keys, "gene").agg(F.avg("delta").alias("middle"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*keys, "gene"]]
    both = seen.alias("s").join(middle.alias("m"), same).select(*[f"s.{c}" for c in keys], "s.perturbation", "predicted", (F.col("delta") - F.col("middle")).alias("observed"))
    o, p = F.col("observed"), F.col("predicted")
    return both.groupBy(*keys, "perturbation").agg(
        pearson(p, o).alias("pearson"), cosine(p, o).alias("cosine"), ratio(F.sum((o - p) * (o - p)), F.sum(o * o)).alias("unexplained")
    )
