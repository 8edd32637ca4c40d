"""Balanced decomposition of responses (context, perturbation, gene, delta)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assert_balanced(resp: DataFrame) -> DataFrame:
    """The rows, or an error when they are read if the grid of contexts, perturbations and genes has holes or repeats."""
    size = resp.agg(
        (F.countDistinct("context") * F.countDistinct("perturbation") * F.countDistinct("gene")).alias("full"),
        F.count(F.lit(1)).alias("rows"),
        F.count("delta").alias("there"),
    )
    bad = (F.col("full") != F.col("rows")) | (F.col("there") != F.col("rows"))
    return resp.crossJoin(F.broadcast(size)).withColumn(
        "delta", F.when(bad, F.raise_error(F.lit("responses are not a balanced grid"))).otherwise(F.col("delta"))
    ).drop("full", "rows", "there")


def decompose(resp: DataFrame, value: str = "delta") -> DataFrame:
    """Adds mu, alpha, beta, gamma: grand, context, perturbation means and the rest, each gene on its own.

    All three windows cluster by gene, so the grid is dealt out once.
    """
    d = F.col(value)
    mean = F.avg(d).over(Window.partitionBy("gene"))
    by_c, by_p = F.avg(d).over(Window.partitionBy("gene", "context")), F.avg(d).over(Window.partitionBy("gene", "perturbation"))
    out = resp.withColumns({"mu": mean, "by_c": by_c, "by_p": by_p})
    return out.withColumns(
        {"alpha": F.col("by_c") - F.col("mu"), "beta": F.col("by_p") - F.col("mu"), "gamma": d - F.col("by_c") - F.col("by_p") + F.col("mu")}
    ).drop("by_c", "by_p")


def cells_of_grid() -> Column:
    return F.countDistinct("context", "perturbation")


def sums_of_squares(parts: DataFrame, value: str = "delta") -> DataFrame:
    """One row: each component's energy per (context, perturbation), and the total."""
    names = {"ss_mu": "mu", "ss_alpha": "alpha", "ss_beta": "beta", "ss_gamma": "gamma", "total": value}
    return parts.agg(*[(F.sum(F.col(c) * F.col(c)) / cells_of_grid()).alias(n) for n, c in names.items()])


def fractions(ss: DataFrame) -> DataFrame:
    return ss.select(*[(F.col(f"ss_{n}") / F.col("total")).alias(f"{n}_share") for n in ("mu", "alpha", "beta", "gamma")], "total")


def project_out_template(resp: DataFrame) -> DataFrame:
    """Removes from each response what lies along its context's mean response."""
    t = resp.withColumn("t", F.avg("delta").over(Window.partitionBy("context", "gene")))
    row = Window.partitionBy("context", "perturbation")
    along = F.sum(F.col("delta") * F.col("t")).over(row) / (F.sum(F.col("t") * F.col("t")).over(row) + 1e-30)
    return t.withColumn("projected", F.col("delta") - along * F.col("t")).drop("t")


def cross_half_signal(half_a: DataFrame, half_b: DataFrame) -> DataFrame:
    """One row: each component's inner product between two independent halves, per (context, perturbation)."""
    keys = ["context", "perturbation", "gene"]
    names = ["mu", "alpha", "beta", "gamma", "delta"]
    a = decompose(half_a).select(*keys, *[F.col(n).alias(f"a_{n}") for n in names])
    b = decompose(half_b).select(*keys, *[F.col(n).alias(f"b_{n}") for n in names])
    return a.join(b, keys).agg(*[(F.sum(F.col(f"a_{n}") * F.col(f"b_{n}")) / cells_of_grid()).alias(f"signal_{n}") for n in names])


def beta_fraction(parts: DataFrame) -> DataFrame:
    """Per perturbation: variance over genes of beta against that plus the mean over contexts of gamma's."""
    per = parts.groupBy("perturbation", "context").agg(F.var_pop("gamma").alias("g"), F.var_pop("beta").alias("b"))
    one = per.groupBy("perturbation").agg(F.avg("g").alias("g"), F.avg("b").alias("b"))
    return one.select("perturbation", (F.col("b") / (F.col("b") + F.col("g") + 1e-30)).alias("beta_fraction"))


def loo_scale(resp: DataFrame) -> DataFrame:
    """One row: the pooled scalar that best predicts each context's centred response from the mean of the others."""
    whole = Window.partitionBy("perturbation", "gene")
    n = F.count("delta").over(whole)
    x = resp.withColumn("x", (F.sum("delta").over(whole) - F.col("delta")) / (n - 1))
    axis = Window.partitionBy("context", "gene")
    c = x.select((F.col("delta") - F.avg("delta").over(axis)).alias("y"), (F.col("x") - F.avg("x").over(axis)).alias("x"))
    den = F.sum(F.col("x") * F.col("x"))
    return c.agg(F.when(den > 0, F.sum(F.col("y") * F.col("x")) / den).otherwise(1.0).alias("scale"))
