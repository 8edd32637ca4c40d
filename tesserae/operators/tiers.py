"""Support tiers: how far a perturbation's own effect is trusted, by the number of sources that measured it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRID = (0.0, 0.25, 0.5, 0.75, 1.0)  # fixed values: the shrinkage weights that are tried
MAX_CONTEXTS = 16  # subsets of contexts are bit masks


def context_products(responses: DataFrame) -> DataFrame:
    """a, b, own, main for every ordered pair of contexts: mean over perturbations and genes of the product of what is left of responses
    after each context's mean over perturbations, and mean over genes of the product of those means. One pass over the grid."""
    by = Window.partitionBy("context", "gene")
    e = responses.withColumn("m", F.avg("delta").over(by)).withColumn("e", F.col("delta") - F.col("m"))
    cell = e.groupBy("perturbation", "gene").agg(F.collect_list(F.struct("context", "e", "m")).alias("c"))  # an axis of contexts
    pair = cell.select(F.explode("c").alias("x"), "c").select("x", F.explode("c").alias("y"))
    # A context's mean stands once for each perturbation, so its mean over cells is that over genes.
    return pair.groupBy(F.col("x.context").alias("a"), F.col("y.context").alias("b")).agg(
        F.avg(F.col("x.e") * F.col("y.e")).alias("own"), F.avg(F.col("x.m") * F.col("y.m")).alias("main")
    )


def _masks(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contexts with their bit, and every subset's mask with its size."""
    axis = products.select(F.col("a").alias("context")).distinct()
    numbered = axis.withColumn("bit", F.row_number().over(Window.orderBy("context")) - 1)  # one row a context
    count = axis.agg(F.count(F.lit(1)).alias("n"))
    allowed = F.when(F.col("n") <= MAX_CONTEXTS, F.col("n")).otherwise(F.raise_error(F.lit("too many contexts for bit masks")).cast("int"))
    masks = count.select(allowed.cast("int").alias("k")).select(F.expr("explode(sequence(1, shiftleft(1, k) - 1)) AS mask"))
    return numbered, masks.withColumn("size", F.bit_count("mask"))


def _has(mask: str, bit: str):
    return F.expr(f"({mask} & shiftleft(1, {bit})) > 0")


def subset_sums(products: DataFrame) -> DataFrame:
    """mask, size, held, own_with, own_self, main_with, main_self: for every subset of contexts and every context, products of the
    context with the subset's mean, and of that mean with itself."""
    axis, masks = _masks(products)
    numbered = products.join(axis.select(F.col("context").alias("a"), F.col("bit").alias("i")), "a").join(axis.select(F.col("context").alias("b"), F.col("bit").alias("j")), "b")
    inside = masks.join(numbered, _has("mask", "j"))  # subsets of a short axis
    toward = inside.groupBy("mask", "size", F.col("i").alias("held")).agg((F.sum("own") / F.first("size")).alias("own_with"), (F.sum("main") / F.first("size")).alias("main_with"))
    within = inside.filter(_has("mask", "i")).groupBy("mask").agg(
        (F.sum("own") / F.first("size") / F.first("size")).alias("own_self"), (F.sum("main") / F.first("size") / F.first("size")).alias("main_self")
    )
    return toward.join(within, "mask")


def tier_shrinkage(responses: DataFrame, tiers: tuple[int, ...] = (2, 1), main: str = "pooled", grid: tuple[float, ...] = GRID) -> DataFrame:
    """target, tier, weight, error, chosen: mean squared error of each weight by nested validation inside the sources of each target.

    Every context is a target in turn and is not read for it. One source after another is held; the others are the evidence: their
    pooled main effect (main: zero, pooled, or shrunk by the median of leave-one-out scales) and the mean own effect of every subset
    of as many as the tier has. The error is a quadratic in the weight, whose three numbers come from products of pairs of contexts,
    so neither subsets nor weights touch the responses again. Ties go to the smallest weight. Tier 0 always has weight 0.
    """
    products = context_products(responses)
    axis, _ = _masks(products)
    s = subset_sums(products)
    n = axis.agg(F.count(F.lit(1)).alias("n"))
    square = products.filter("a = b").join(axis, F.col("a") == F.col("context")).select(F.col("bit").alias("held"), F.col("own").alias("own_sq"), F.col("main").alias("main_sq"))
    folds = axis.select(F.col("bit").alias("target"), F.col("context").alias("name")).crossJoin(axis.select(F.col("bit").alias("held"))).filter("target <> held").crossJoin(F.broadcast(n))
    folds = folds.withColumn("inner", F.expr("shiftleft(1, cast(n AS int)) - 1 - shiftleft(1, target) - shiftleft(1, held)")).join(square, "held")
    pooled = s.select(F.col("mask").alias("inner"), "held", "main_with", "main_self")
    folds = folds.join(pooled, ["inner", "held"])
    if main == "pooled":
        scale = F.lit(1.0)
    elif main == "zero":
        scale = F.lit(0.0)
    elif main == "shrunk":
        folds = folds.join(_scales(s, folds), ["inner"], "left")
        scale = F.coalesce("scale", F.lit(1.0))
    else:
        raise ValueError(f"no main effect {main}")
    folds = folds.withColumn("base", F.col("own_sq") + F.col("main_sq") - 2 * scale * F.col("main_with") + scale * scale * F.col("main_self"))
    wanted = F.array(*[F.lit(t) for t in tiers])
    asked = folds.withColumn("tier", F.explode(wanted)).withColumn("taken", F.least("tier", F.col("n") - 2))
    subsets = asked.join(s.select("mask", "size", F.col("held").alias("h"), "own_with", "own_self"), (F.col("h") == F.col("held")) & (F.col("size") == F.col("taken")) & (F.expr("mask & ~inner") == 0))
    fold = subsets.groupBy("name", "tier", "held").agg(F.first("base").alias("a"), F.avg("own_with").alias("b"), F.avg("own_self").alias("c"))
    tried = fold.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in grid])))
    w = F.col("weight")
    error = tried.groupBy(F.col("name").alias("target"), "tier", "weight").agg(F.avg(F.col("a") - 2 * w * F.col("b") + w * w * F.col("c")).alias("error"))
    best = Window.partitionBy("target", "tier").orderBy(F.round("error", 12), "weight")
    return error.withColumn("chosen", F.row_number().over(best) == 1)


def _scales(s: DataFrame, folds: DataFrame) -> DataFrame:
    """For each evidence mask, the median over its contexts of the scale that fits the others' pooled main effect to the one left out."""
    evidence = folds.select("inner").distinct()
    out = s.select("mask", F.col("held").alias("left"), "main_with", "main_self")
    each = evidence.join(out, F.expr("(inner & shiftleft(1, left)) > 0 AND mask = inner - shiftleft(1, left)")).filter("main_self > 1e-12")
    return each.groupBy("inner").agg(F.expr("percentile(main_with / main_self, 0.5)").alias("scale"))  # one row a context


def tier_prediction(responses: DataFrame, target: str, sources: list[str], support: DataFrame, weights: DataFrame) -> DataFrame:
    """perturbation, gene, predicted: pooled main effect of the sources plus the tier's weight times the own effect that the supporting
    sources share. support: perturbation, tier, source (null in tier 0); weights: tier, weight. The target is not read."""
    if target in sources:
        raise ValueError("the target can not be a source")
    by = Window.partitionBy("context", "gene")
    seen = responses.filter(F.col("context").isin(sources)).withColumn("m", F.avg("delta").over(by))
    mean = seen.select("context", "gene", "m").distinct().groupBy("gene").agg(F.avg("m").alias("m_hat"))
    own = seen.withColumn("e", F.col("delta") - F.col("m")).select("perturbation", "gene", F.col("context").alias("source"), "e")
    beta = support.join(own, ["perturbation", "source"]).groupBy("perturbation", "gene").agg(F.avg("e").alias("beta"))
    tier = support.select("perturbation", "tier").distinct().join(weights, "tier", "left")
    weight = F.when(F.col("tier") == 0, 0.0).otherwise(F.col("weight"))
    grid = tier.select("perturbation", weight.alias("weight")).crossJoin(F.broadcast(mean))  # an axis of genes
    full = grid.join(beta, ["perturbation", "gene"], "left")
    return full.select("perturbation", "gene", (F.col("m_hat") + F.coalesce(F.col("weight") * F.col("beta"), F.lit(0.0))).alias("predicted"))
