"""Models of what a target context's responses have beyond conserved transfer, and features of how far transfer can be trusted.

Contexts are a short axis, so a fold carries its sources as an array and responses are packed by context: every feature is an
array expression on a row, and only centring over perturbations moves rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import EPS

# Names and order of the features, the grids of penalties and of weights, the model families.
FEATURES = (
    "source_mean", "source_mean_centred", "source_sd", "source_range", "source_sign_agreement", "weighted_source", "weighted_source_centred",
    "weighted_minus_mean", "source_agreement", "source_reliability", "source_cells", "source_magnitude", "target_gene_basal",
    "basal_pathway_deviation", "target_basal_pathway", "gene_in_pathway", "pathway_size",
)
CONFIDENCE = (
    "source_agreement", "source_min_agreement", "source_sd_ratio", "source_sign_consistency", "source_reliability", "source_cells_mean",
    "source_cells_min", "source_magnitude", "source_reliable_energy", "source_magnitude_spread", "target_gene_basal", "basal_similarity_mean",
)
ALPHAS = (1.0, 10.0, 100.0, 1000.0, 10000.0)
LAMBDAS = (0.0, 0.25, 0.5, 0.75, 1.0)
MODELS = (("M0", 0.0), ("M1", 0.0), *(("M2", a) for a in ALPHAS))
SINGLE = FEATURES.index("weighted_minus_mean")

FOLD = ["outer", "target"]


def folds(contexts: list[str], nested: bool = True) -> list[tuple[str, str, list[str]]]:
    """(outer, target, sources): each context from all others and, if nested, each of those as a pseudo-target from the rest."""
    out = [(o, o, [c for c in contexts if c != o]) for o in contexts]
    if nested:
        out += [(o, t, [c for c in contexts if c not in (o, t)]) for o in contexts for t in contexts if t != o]
    return out


def fold_table(spark: SparkSession, contexts: list[str], nested: bool = True) -> DataFrame:
    return spark.createDataFrame(folds(contexts, nested), "outer string, target string, sources array<string>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def _sd(a: Column) -> Column:
    return F.sqrt(_mean(F.transform(a, lambda v: (v - _mean(a)) * (v - _mean(a)))))


def _no_null(c: Column) -> Column:
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def packed(y: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., m: the responses y of a (context, keys..., y) table as a map from context to value."""
    return y.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("context", "y"))).alias("m"))


def by_perturbation(fold: DataFrame, stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """outer, target, perturbation and what the sources' own cells say about it.

    stats: context, perturbation, reliability, cells, magnitude, gene_basal; pairs: a, b, perturbation, corr with a < b. Of the
    target only gene_basal, a property of its control cells, is read. Undefined reliabilities and correlations are left out of their means.
    """
    every = F.broadcast(fold)  # folds: a product of the context axis with itself
    inside = lambda c: F.expr(f"array_contains(sources, {c})")
    agree = pairs.crossJoin(every).filter(inside("a") & inside("b")).groupBy(*FOLD, "perturbation").agg(F.avg("corr").alias("agree"), F.min("corr").alias("least"))
    own = stats.crossJoin(every).filter(inside("context")).groupBy(*FOLD, "perturbation").agg(
        F.avg("reliability").alias("reliability"), F.avg("cells").alias("cells"), F.min("cells").alias("cells_min"), F.avg("magnitude").alias("magnitude"),
        F.stddev_pop("magnitude").alias("magnitude_sd"),
    )
    basal = stats.select(F.col("context").alias("target"), "perturbation", "gene_basal")
    return own.join(agree, [*FOLD, "perturbation"], "left").join(basal, ["target", "perturbation"], "left")


def design(
    fold: DataFrame, y: DataFrame, stats: DataFrame, pairs: DataFrame, similarity: DataFrame, basal: DataFrame, members: DataFrame, clean: bool = False
) -> DataFrame:
    """outer, target, perturbation, pathway, x ARRAY of FEATURES, b, scale, r, y.

    y: context, perturbation, pathway, y; similarity: target, source, sim of control profiles, whose positive part weighs the sources of a fold;
    basal: context, pathway, basal; members: perturbation, pathway, inside, size. b is the template plus the scaled rest of the source mean,
    r what the target's responses have beyond it or, if clean, beyond the source mean and centred over perturbations; r is null where the target is
    the outer one. Features never read the target's responses.
    """
    sims = similarity.groupBy("target").agg(F.map_from_entries(F.collect_list(F.struct("source", "sim"))).alias("s"))
    f = fold.join(sims, "target", "left")
    raw = F.transform("sources", lambda c: F.greatest(F.coalesce(F.col("s")[c], F.lit(0.0)), F.lit(0.0)))
    f = f.withColumn("w", raw).withColumn("w", F.when(_sum(F.col("w")) > 0, F.transform("w", lambda v: v / _sum(F.col("w")))).otherwise(F.transform("w", lambda v: 1 / F.size("w"))))
    ground = packed(basal.select("context", "pathway", F.col("basal").alias("y")), ["pathway"]).withColumnRenamed("m", "g")
    rows = packed(y, ["perturbation", "pathway"]).crossJoin(F.broadcast(f.drop("s"))).join(ground, "pathway", "left").join(members, ["perturbation", "pathway"], "left")
    v, g = F.transform("sources", lambda c: F.col("m")[c]), F.transform("sources", lambda c: F.col("g")[c])
    rows = rows.select(*FOLD, "perturbation", "pathway", "inside", "size", v.alias("v"), "w", F.col("m")[F.col("target")].alias("y"), F.col("g")[F.col("target")].alias("at"), g.alias("gs"))
    a, wa = _mean(F.col("v")), _sum(F.zip_with("v", "w", lambda p, q: p * q))
    axis = Window.partitionBy(*FOLD, "pathway")
    rows = rows.withColumns({"a": a, "wa": wa})
    rows = rows.withColumns({"t": F.avg("a").over(axis), "ac": F.col("a") - F.avg("a").over(axis), "wac": F.col("wa") - F.avg("wa").over(axis)})
    rows = rows.join(by_perturbation(fold, stats, pairs), [*FOLD, "perturbation"], "left").join(_scales(rows), FOLD)
    col = F.col
    x = [
        col("a"), col("ac"), _sd(col("v")), F.array_max("v") - F.array_min("v"), F.abs("a") / (_mean(F.transform("v", F.abs)) + EPS), col("wa"), col("wac"),
        col("wac") - col("ac"), col("agree"), col("reliability"), col("cells"), col("magnitude"), col("gene_basal"), col("at") - _mean(col("gs")), col("at"),
        col("inside").cast("double"), col("size").cast("double"),
    ]
    b = col("t") + col("scale") * col("ac")
    beyond = col("y") - col("a") if clean else col("y") - b
    rows = rows.withColumn("beyond", beyond)
    r = col("beyond") - F.avg("beyond").over(axis) if clean else col("beyond")
    return rows.select(
        *FOLD, "perturbation", "pathway", F.array(*[_no_null(c.cast("double")) for c in x]).alias("x"), b.alias("b"), "scale",
        F.when(col("outer") != col("target"), r).alias("r"), "y",
    )


def _scales(rows: DataFrame) -> DataFrame:
    """outer, target, scale: the pooled scalar that best predicts each source's centred responses from the mean of the other sources."""
    n = F.size("v")
    pair = F.transform("v", lambda own: F.struct(own.alias("own"), ((_sum(F.col("v")) - own) / (n - 1)).alias("rest")))
    each = rows.filter(n > 1).select(*FOLD, "pathway", F.posexplode(pair).alias("i", "p")).groupBy(*FOLD, "pathway", "i").agg(
        (F.covar_pop("p.own", "p.rest") * F.count(F.lit(1))).alias("num"), (F.var_pop("p.rest") * F.count(F.lit(1))).alias("den")
    )
    found = each.groupBy(*FOLD).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    whole = rows.select(*FOLD).distinct().join(found, FOLD, "left")
    return whole.select(*FOLD, F.when(F.col("den") > EPS, F.col("num") / F.col("den")).otherwise(1.0).alias("scale"))


def fold_moments(rows: DataFrame) -> tuple[np.ndarray, dict[tuple[str, str], np.ndarray]]:
    """A shift for the features, and for each pseudo-target the cross products of (1, x - shift, r): a few hundred numbers a fold."""
    k = len(FEATURES)
    trained = rows.filter("r is not null")
    shift = np.array(trained.agg(*[F.coalesce(F.avg(F.col("x")[i]), F.lit(0.0)).alias(f"x{i}") for i in range(k)]).first(), dtype=float)

    def partial(batches):
        for b in batches:
            for (o, t), g in b.groupby(FOLD):
                z = np.column_stack((np.ones(len(g)), np.array(g["x"].tolist(), dtype=float) - shift, g["r"].to_numpy(dtype=float)))
                yield pd.DataFrame({"outer": o, "target": t, "i": np.arange((k + 2) ** 2), "v": (z.T @ z).ravel()})

    sums = trained.select(*FOLD, "x", "r").mapInPandas(partial, "outer string, target string, i int, v double").groupBy(*FOLD, "i").agg(F.sum("v").alias("v"))
    found: dict[tuple[str, str], np.ndarray] = {}
    for r in sums.collect():
        found.setdefault((r.outer, r.target), np.zeros((k + 2) ** 2))[r.i] = r.v
    return shift, {f: m.reshape(k + 2, k + 2) for f, m in found.items()}


def fit_family(family: str, alpha: float, moments: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Intercept and coefficients of the features as they are, from cross products: M0 nothing, M1 one scalar on the standardised
    weighted_minus_mean, M2 ridge on all standardised features with a free intercept."""
    k = len(shift)
    n = moments[0, 0]
    out = np.zeros(k + 1)
    if family == "M0" or not n:
        return out
    mean, r = moments[0, 1:-1] / n, moments[0, -1] / n
    gram = moments[1:-1, 1:-1] - n * np.outer(mean, mean)
    with_r = moments[1:-1, -1] - n * mean * r
    sd = np.sqrt(np.maximum(np.diag(gram) / n, 0))
    sd = np.where(sd > EPS, sd, 1.0)
    if family == "M1":
        den = gram[SINGLE, SINGLE] / sd[SINGLE] ** 2
        out[1 + SINGLE] = with_r[SINGLE] / sd[SINGLE] / den / sd[SINGLE] if den > EPS else 0.0
        out[0] = -out[1 + SINGLE] * (shift + mean)[SINGLE]
        return out
    w = np.linalg.solve(gram / np.outer(sd, sd) + alpha * np.eye(k), with_r / sd) / sd
    return np.concatenate(([r - w @ (shift + mean)], w))


MODEL = "outer string, target string, family string, alpha double, coef array<double>"


def with_models(rows: DataFrame, models: list[tuple]) -> DataFrame:
    """rows with r_hat, the residual that each model of (outer, target, family, alpha, coef) predicts, centred over perturbations."""
    table = F.broadcast(rows.sparkSession.createDataFrame(models, MODEL))  # a few models a fold
    dot = F.aggregate(F.zip_with("x", F.slice("coef", 2, len(FEATURES)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    own = rows.join(table, FOLD).withColumn("raw", F.col("coef")[0] + dot)
    axis = Window.partitionBy(*FOLD, "family", "alpha", "pathway")
    return own.withColumn("r_hat", F.col("raw") - F.avg("raw").over(axis)).drop("raw", "coef", "x")


def nested_selection(rows: DataFrame, moments: tuple | None = None) -> DataFrame:
    """outer, family, alpha, lam, score, chosen: every model of the grid, scored on held pseudo-targets of an outer context.

    A model is fitted on the other pseudo-targets of the same outer context and scored by the median over perturbations of the correlation of
    b + lam * r_hat with the held responses over pathways, averaged over the held ones. Of equal scores the first of the grid is
    chosen. Rows of the outer context itself are not read.
    """
    shift, found = moments or fold_moments(rows)
    models = []
    for o, held in sorted(found):
        rest = sum((m for (a, t), m in found.items() if a == o and t != held), np.zeros_like(found[o, held]))
        models += [(o, held, family, alpha, fit_family(family, alpha, rest, shift).tolist()) for family, alpha in MODELS]
    r = with_models(rows.filter("r is not null"), models)
    names = {"y": "y", "b": "b", "h": "r_hat"}
    one = [F.sum(c).alias(k) for k, c in names.items()]
    two = [F.sum(F.col(names[p]) * F.col(names[q])).alias(p + q) for p, q in ("yy", "bb", "hh", "yb", "yh", "bh")]
    per = r.groupBy(*FOLD, "family", "alpha", "perturbation").agg(F.count(F.lit(1)).alias("n"), *one, *two)
    per = per.withColumn("lam", F.explode(F.array(*map(F.lit, LAMBDAS))))
    c, lam, n = F.col, F.col("lam"), F.col("n")
    p, pp, yp = c("b") + lam * c("h"), c("bb") + 2 * lam * c("bh") + lam * lam * c("hh"), c("yb") + lam * c("yh")
    den = F.sqrt(F.greatest(c("yy") - c("y") * c("y") / n, F.lit(0.0)) * F.greatest(pp - p * p / n, F.lit(0.0)))
    each = per.withColumn("corr", F.when(den > EPS, (yp - c("y") * p / n) / den))
    fold = each.groupBy(*FOLD, "family", "alpha", "lam").agg(F.expr("percentile(corr, 0.5)").alias("score"))
    score = fold.groupBy("outer", "family", "alpha", "lam").agg(F.avg("score").alias("score"))
    first = Window.partitionBy("outer").orderBy(F.desc(F.round("score", 10)), "family", "alpha", "lam")  # the grid's rows of one outer context
    return score.withColumn("chosen", F.row_number().over(first) == 1)


def outer_prediction(rows: DataFrame) -> DataFrame:
    """outer, perturbation, pathway, b, r_hat, predicted, lambda_theory, predicted_theory: the chosen model of each outer context, refitted
    on all its pseudo-targets.

    The outer context's own responses are not read. Beside the weight that was selected stands the one that theory gives a clean target:
    of n sources, whose interactions and the target's sum to zero, the mean carries minus one n-th of the target's, so that what is
    left beyond a mean scaled by s is (n + s) / (n + 1) of what models are fitted to.
    """
    shift, found = fold_moments(rows)
    picks = nested_selection(rows, (shift, found)).filter("chosen").collect()  # one row a context
    models, lams = [], []
    for s in picks:
        whole = sum(m for (o, _), m in found.items() if o == s.outer)
        models.append((s.outer, s.outer, s.family, s.alpha, fit_family(s.family, s.alpha, whole, shift).tolist()))
        lams.append((s.outer, s.lam, sum(o == s.outer for o, _ in found)))
    lam = F.broadcast(rows.sparkSession.createDataFrame(lams, "outer string, lam double, n int"))
    out = with_models(rows.filter("outer = target").drop("y", "r"), models).join(lam, "outer")
    theory = (F.col("n") + F.col("scale")) / (F.col("n") + 1)
    return out.select(
        "outer", "perturbation", "pathway", "b", "r_hat", (F.col("b") + F.col("lam") * F.col("r_hat")).alias("predicted"),
        theory.alias("lambda_theory"), (F.col("b") + theory * F.col("r_hat")).alias("predicted_theory"), "scale",
    )


def confidence(fold: DataFrame, y: DataFrame, halves: DataFrame, stats: DataFrame, pairs: DataFrame, similarity: DataFrame) -> DataFrame:
    """outer, target, perturbation and the CONFIDENCE features of transfer to the target, from its sources and its control cells.

    y: context, perturbation, gene, y; halves: context, perturbation, gene, h1, h2, means over independent halves (averaged over draws).
    Neither responses nor halves of the target are read. Undefined values become 0.
    """
    both = y.join(halves, ["context", "perturbation", "gene"])
    m = both.groupBy("perturbation", "gene").agg(F.map_from_entries(F.collect_list(F.struct("context", F.struct("y", "h1", "h2")))).alias("m"))
    rows = m.crossJoin(F.broadcast(fold)).select(*FOLD, "perturbation", F.transform("sources", lambda c: F.col("m")[c]).alias("s"))
    v = F.col("s.y")
    rows = rows.select(*FOLD, "perturbation", _mean(v).alias("a"), _sd(v).alias("sd"), _mean(F.transform(v, F.abs)).alias("size"), _mean(F.col("s.h1")).alias("h1"), _mean(F.col("s.h2")).alias("h2"))
    sq = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    per = rows.groupBy(*FOLD, "perturbation").agg(
        sq("a").alias("source_magnitude"), sq("sd").alias("sd_norm"), (F.sum(F.abs("a")) / (F.sum("size") + EPS)).alias("source_sign_consistency"),
        F.sum(F.col("h1") * F.col("h2")).alias("source_reliable_energy"),
    )
    near = similarity.join(F.broadcast(fold), "target").filter("array_contains(sources, source)").groupBy(*FOLD).agg(F.avg("sim").alias("basal_similarity_mean"))
    x = per.join(by_perturbation(fold, stats, pairs), [*FOLD, "perturbation"], "left").join(near, FOLD, "left")
    x = x.withColumns(
        {
            "source_sd_ratio": F.col("sd_norm") / (F.col("source_magnitude") + EPS), "source_agreement": F.col("agree"), "source_min_agreement": F.col("least"),
            "source_reliability": F.col("reliability"), "source_cells_mean": F.col("cells"), "source_cells_min": F.col("cells_min"),
            "source_magnitude_spread": F.col("magnitude_sd"), "target_gene_basal": F.col("gene_basal"),
        }
    )
    return x.select(*FOLD, "perturbation", *[_no_null(F.col(c).cast("double")).alias(c) for c in CONFIDENCE])
