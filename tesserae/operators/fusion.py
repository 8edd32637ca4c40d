"""Combining effects of several sources. A null effect is not measured; a zero is a measured zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_effects(stats: DataFrame, minimum_cells: int = 20, pseudocount: float = 1.0) -> DataFrame:
    """stats: source, target, gene, cpm, control_cpm, n_cells, measured -> source, target, gene, effect.

    Log2 fold change where the gene is measured in enough cells, less the source's mean over its other targets' rows of that
    gene; the row of a target's own gene does not enter the mean.
    """
    raw = F.log2((F.col("cpm") + pseudocount) / (F.col("control_cpm") + pseudocount))
    there = (F.col("n_cells") >= minimum_cells) & F.col("measured")
    e = stats.withColumn("raw", F.when(there, raw))
    mean = F.avg(F.when(F.col("gene") != F.col("target"), F.col("raw"))).over(Window.partitionBy("source", "gene"))
    return e.select("source", "target", "gene", (F.col("raw") - F.coalesce(mean, F.lit(0.0))).alias("effect"))


def fuse(effects: DataFrame, weight: Column) -> DataFrame:
    """Per target and gene: weighted mean over measuring sources, plain mean if their weights sum to zero, 0 without any."""
    e, w = F.col("effect"), F.when(F.col("effect").isNotNull(), weight)
    mass = F.sum(w)
    fused = F.when(mass > 0, F.sum(w * e) / mass).otherwise(F.avg(e))
    return effects.groupBy("target", "gene").agg(F.coalesce(fused, F.lit(0.0)).alias("fused"), F.count("effect").alias("n_sources"))


def consensus(effects: DataFrame) -> DataFrame:
    """Per target and gene: 0 no source, 1 one, 2 all of one sign, 3 signs in conflict."""
    up, down = F.count_if(F.col("effect") > 0), F.count_if(F.col("effect") < 0)
    n = F.count("effect")
    code = F.when(n == 0, 0).when(n == 1, 1).when((up > 0) & (down > 0), 3).otherwise(2)
    return effects.groupBy("target", "gene").agg(code.alias("consensus"))


def pooled_tau2(effects: DataFrame) -> DataFrame:
    """Per gene: DerSimonian and Laird's between-source variance, pooled over targets with two sources or more.

    effects: source, target, gene, effect, sigma2.
    """
    w = 1 / F.col("sigma2")
    r = effects.filter("effect is not null and sigma2 > 0").withColumn("w", w)
    per = r.groupBy("target", "gene").agg(
        F.count(F.lit(1)).alias("k"), F.sum("w").alias("s1"), F.sum(F.col("w") * F.col("w")).alias("s2"),
        F.sum(F.col("w") * F.col("effect")).alias("we"), F.sum(F.col("w") * F.col("effect") * F.col("effect")).alias("wee"),
    ).filter("k >= 2")
    q = F.col("wee") - F.col("we") * F.col("we") / F.col("s1")
    num, den = F.sum(q - (F.col("k") - 1)), F.sum(F.col("s1") - F.col("s2") / F.col("s1"))
    return per.groupBy("gene").agg(F.when(den > 0, F.greatest(F.lit(0.0), num / den)).otherwise(0.0).alias("tau2"))


def shrinkage_multiplier(rows: DataFrame) -> DataFrame:
    """Adds the empirical Bayes multiplier tau2 / (tau2 + sigma2) with tau2 = max(0, mean effect^2 - mean sigma2) per gene;
    1 where sigma2 is missing."""
    own = Window.partitionBy("gene")
    tau2 = F.greatest(F.lit(0.0), F.avg(F.col("effect") * F.col("effect")).over(own) - F.avg("sigma2").over(own))
    r = rows.withColumn("tau2", tau2)
    m = F.when(F.col("sigma2").isNull(), 1.0).when(F.col("tau2") + F.col("sigma2") > 0, F.col("tau2") / (F.col("tau2") + F.col("sigma2"))).otherwise(0.0)
    return r.withColumn("multiplier", m)


def log_ratio_variance(m: Column, c: Column, f: Column, v_t: Column, n_t: Column, v_c: Column, n_c: Column) -> Column:
    """Delta-method variance of the shrunken log2 ratio of means m and c, f the weight of the counts."""
    ln2 = 0.6931471805599453
    a = f / ((m + 1) * ln2)
    b = ((1 - f) / (m + 1) - 1 / (c + 1)) / ln2
    return a * a * v_t / n_t + b * b * v_c / n_c


def inverse_variance(effects: DataFrame) -> DataFrame:
    """Adds weight 1 / sigma2, with the source's median for a missing sigma2, scaled to a mean of 1 within each source."""
    med = effects.groupBy("source").agg(F.expr("percentile(sigma2, 0.5)").alias("med"))
    e = effects.join(F.broadcast(med), "source").withColumn("w", 1 / F.coalesce("sigma2", "med"))
    return e.withColumn("weight", F.col("w") / F.avg("w").over(Window.partitionBy("source"))).drop("w", "med")
