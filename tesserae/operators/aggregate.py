"""Masked grouped means and moments over sparse counts; zeros that are not stored count."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import cp_k
from tesserae.operators.quantiles import exact_quantiles

QUANTILES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


def group_means(cells: DataFrame, expr: DataFrame, by: list[str], value: Column | None = None) -> DataFrame:
    """by..., gene, mean, n_cells over the full grid of groups and genes.

    Sums divide by the group's number of cells, so a value that is not stored is a zero. The group and gene axes are small
    next to the counts: the grid is built from them and sums are joined to it.
    """
    v = F.col("value") if value is None else value
    sums = expr.join(cells.select("cell", *by), "cell").groupBy(*by, "gene").agg(F.sum(v).alias("s"))
    sizes = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"))
    grid = sizes.crossJoin(expr.select("gene").distinct())
    return grid.join(sums, [*by, "gene"], "left").select(*by, "gene", (F.coalesce("s", F.lit(0.0)) / F.col("n_cells")).alias("mean"), "n_cells")


def response(means: DataFrame, control: str, keys: list[str]) -> DataFrame:
    """Adds delta, the mean minus the control label's mean at the same keys; the control itself drops out."""
    ctrl = means.filter(F.col("perturbation") == control).select(*keys, "gene", F.col("mean").alias("control_mean"))
    return means.filter(F.col("perturbation") != control).join(ctrl, [*keys, "gene"]).withColumn("delta", F.col("mean") - F.col("control_mean"))


def normalise(expr: DataFrame, target: float = 1e4) -> DataFrame:
    """Adds depth, cp and log1p of counts per `target`."""
    depth = F.sum("value").over(Window.partitionBy("cell"))
    cp = cp_k(F.col("value"), F.col("depth"), target)
    return expr.withColumn("depth", depth).withColumn("cp", cp).withColumn("log_cp", F.log1p("cp"))


def cell_profile(cells: DataFrame, expr: DataFrame) -> DataFrame:
    """Every cell with depth and genes detected; a cell without values has zeros."""
    per = expr.groupBy("cell").agg(F.sum("value").alias("depth"), F.count_if(F.col("value") != 0).alias("detected"))
    return cells.join(per, "cell", "left").na.fill({"depth": 0.0, "detected": 0})


def context_summary(cells: DataFrame, expr: DataFrame) -> DataFrame:
    """Per context: cells, genes, depth statistics, sparsity, genes detected."""
    genes = expr.agg(F.countDistinct("gene").alias("n_genes"))
    profile = cell_profile(cells, expr)
    per = profile.groupBy("context").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.avg("depth").alias("mean_depth"),
        F.min("depth").alias("min_depth"),
        F.max("depth").alias("max_depth"),
        F.avg("detected").alias("mean_detected"),
        F.sum("detected").alias("nonzero"),
    )
    middle = exact_quantiles(profile, ["context"], "depth", (0.5,)).select("context", F.col("q")[0].alias("median_depth"))
    per = per.join(middle, "context")
    return per.crossJoin(F.broadcast(genes)).withColumn("sparsity", 1 - F.col("nonzero") / (F.col("n_cells") * F.col("n_genes"))).drop("nonzero")


def depth_quantiles(profile: DataFrame, thresholds: tuple[float, ...] = (50.0, 100.0)) -> DataFrame:
    """Per context: exact linear quantiles of depth, coefficient of variation, cells below thresholds."""
    spread = profile.groupBy("context").agg((F.stddev_pop("depth") / F.avg("depth")).alias("cv"), *[F.count_if(F.col("depth") < t).alias(f"below_{t:g}") for t in thresholds])
    out = exact_quantiles(profile, ["context"], "depth", QUANTILES).join(spread, "context")  # one row a context
    return out.select("context", *[F.col("q")[i].alias(f"q{int(q * 100):03d}") for i, q in enumerate(QUANTILES)], "cv", *[f"below_{t:g}" for t in thresholds])


def gene_variance(cells: DataFrame, expr: DataFrame, by: str = "context") -> DataFrame:
    """Population variance of each gene per group from sums, zeros included, never negative."""
    sums = expr.join(cells.select("cell", by), "cell").groupBy(by, "gene").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    sizes = cells.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    mean = F.col("s1") / F.col("n")
    return sums.join(sizes, by).select(by, "gene", F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)).alias("variance"))


def rank_genes(variances: DataFrame) -> DataFrame:
    """Genes by mean variance over groups, ties by name.

    One row a gene is sorted, so the single window partition is the gene axis and not the data.
    """
    score = variances.groupBy("gene").agg(F.avg("variance").alias("score"))
    return score.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "gene")))


def batch_matched_control(cells: DataFrame, expr: DataFrame, control: str) -> DataFrame:
    """Per perturbation and gene: control means of each batch weighted by the perturbation's cells in it."""
    ctrl = group_means(cells.filter(F.col("perturbation") == control), expr, ["batch"]).select("batch", "gene", F.col("mean").alias("c"))
    weights = cells.filter(F.col("perturbation") != control).groupBy("perturbation", "batch").agg(F.count(F.lit(1)).alias("w"))
    return weights.join(ctrl, "batch").groupBy("perturbation", "gene").agg((F.sum(F.col("w") * F.col("c")) / F.sum("w")).alias("matched_control"))


def shrink(stats: DataFrame, prior: float = 1e5) -> DataFrame:
    """Counts n, control share c: shrunken share p and the weight f that the counts have against the prior."""
    total = F.sum("n").over(Window.partitionBy("target"))
    p = (F.col("n") + prior * F.col("c")) / (total + prior * F.sum("c").over(Window.partitionBy("target")))
    return stats.withColumns({"f": total / (total + prior), "p": p})


def bulk_profile(totals: DataFrame, keys: list[str], target: float = 5e4) -> DataFrame:
    """log1p of each gene's share of its group's total, per `target`."""
    return totals.withColumn("bulk", F.log1p(F.col("total") * target / F.sum("total").over(Window.partitionBy(*keys))))


def moments(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mergeable count, sum and sum of squares, with mean and sample variance."""
    v = F.col(value)
    out = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"))
    return finish_moments(out)


def finish_moments(sums: DataFrame) -> DataFrame:
    mean = F.col("s1") / F.col("n")
    var = F.greatest(F.col("s2") - F.col("n") * mean * mean, F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1))
    return sums.withColumns({"mean": mean, "variance": var})


def recover_counts(rows: DataFrame, tolerance: float = 0.01, max_quantum: int = 64, strict: bool = True) -> DataFrame:
    """Whole counts from log1p(counts per ten thousand): cell, gene, count, quantum.

    Values over the cell's least one are multiplied by the smallest whole number up to max_quantum that makes all of them whole
    within the tolerance; a cell without such a number is an error or, where not strict, has no rows. Which numbers suit a value are bits
    of a few words, which a cell's values share by `and`; no row is made for a trial.
    """
    cell = Window.partitionBy("cell")
    x = rows.withColumn("x", F.expm1("log_cp")).withColumn("x", F.col("x") / F.min("x").over(cell))
    words = [range(a, min(a + 32, max_quantum + 1)) for a in range(1, max_quantum + 1, 32)]

    def suits(ks: range) -> Column:
        @F.pandas_udf("bigint")
        def bits(x: pd.Series) -> pd.Series:
            v, out = x.to_numpy(), np.zeros(len(x), dtype=np.int64)
            for k in ks:
                out |= (np.abs(k * v - np.rint(k * v)) <= tolerance).astype(np.int64) << (k - ks[0])
            return pd.Series(out)

        return bits("x")

    x = x.withColumns({f"w{i}": suits(ks) for i, ks in enumerate(words)}).withColumns({f"w{i}": F.bit_and(f"w{i}").over(cell) for i in range(len(words))})
    lowest = lambda w: F.bit_count(w.bitwiseAND(-w) - 1)
    quantum = F.coalesce(*[F.when(F.col(f"w{i}") > 0, lowest(F.col(f"w{i}")) + ks[0]) for i, ks in enumerate(words)])
    fit = x.withColumn("quantum", F.coalesce(quantum, F.raise_error(F.lit("counts can not be recovered")).cast("int")) if strict else quantum)
    return fit.filter("quantum is not null").select("cell", "gene", F.rint(F.col("x") * F.col("quantum")).cast("bigint").alias("count"), "quantum")
