"""Tests, multiple testing and small regressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import pearson
from tesserae.operators.models import gram
from tesserae.operators.resample import slots
from tesserae.operators.similarity import average_rank


def adjust(pvals: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """Adds p_adj: Benjamini and Hochberg's step-up within each family. Equal p share the value of the last of them."""
    own = Window.partitionBy(*family)
    m = F.count(F.lit(1)).over(own)
    rank = F.count(F.lit(1)).over(own.orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    raw = pvals.withColumn("step", F.col(p) * m / rank)
    later = own.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.withColumn("p_adj", F.least(F.lit(1.0), F.min("step").over(later))).drop("step")


def rank_sums(own: DataFrame, control: DataFrame, targets: DataFrame, n_control: DataFrame, genes: DataFrame, times: str | None = None) -> DataFrame:
    """target, gene, u, z: Mann-Whitney U and tie-corrected z of targets against one control, zeros that are not stored included.

    own: target, gene, value > 0; control: gene, value > 0; targets: target, n1 cells; n_control: one row n0; genes: gene.
    Control values are counted and accumulated once for each gene and meet the targets as counts of different values; no control
    cell is repeated for a target. The zeros are one tie group below everything stored. `times` names the column of own and control
    that says how many cells a row stands for; without it, one.
    """
    each = F.sum(times) if times else F.count(F.lit(1))
    c = control.groupBy("gene", "value").agg(each.alias("c")).withColumn("target", F.lit(None).cast("string"))
    t = own.groupBy("gene", "value", "target").agg(each.alias("m"))
    rows = c.withColumn("m", F.lit(0)).unionByName(t.withColumn("c", F.lit(0)))
    value = Window.partitionBy("gene").orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("gene", "value")
    met = rows.withColumns({"upto": F.sum("c").over(value), "eq": F.sum("c").over(same)}).filter("target is not null")
    cube = lambda x: x * x * x - x
    m, eq = F.col("m").cast("double"), F.col("eq").cast("double")
    per = met.groupBy("target", "gene").agg(
        F.sum(m).alias("s1"), F.sum(m * (F.col("upto") - eq / 2)).alias("above"), F.sum(cube(m + eq) - cube(eq)).alias("ties")
    )
    x = F.col("c").cast("double")
    base = genes.join(c.groupBy("gene").agg(F.sum(x).alias("s0"), F.sum(cube(x)).alias("own_ties")), "gene", "left").crossJoin(F.broadcast(n_control))
    full = F.broadcast(targets).crossJoin(base).join(per, ["target", "gene"], "left").na.fill(0.0, ["s1", "above", "ties", "s0", "own_ties"])
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    full = full.withColumns({"z1": n1 - F.col("s1"), "z0": n0 - F.col("s0"), "n": n1 + n0})
    full = full.withColumn("u", F.col("above") + F.col("s1") * F.col("z0") + F.col("z1") * F.col("z0") / 2)
    tie = F.col("ties") + F.col("own_ties") + cube(F.col("z1") + F.col("z0"))
    sigma = F.sqrt(n1 * n0 / 12 * ((F.col("n") + 1) - tie / (F.col("n") * (F.col("n") - 1))))
    z = F.when(sigma > 0, (F.abs(F.col("u") - n1 * n0 / 2) - 0.5) / sigma)
    return full.select("target", "gene", "u", z.alias("z"))


def two_sided(z: Column | str) -> Column:
    """Two-sided normal p of z >= 0 by a rational approximation of erfc (error below 1.2e-7); null z gives 1."""
    z = F.col(z) if isinstance(z, str) else z
    x = F.greatest(z, F.lit(0.0)) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    # Coefficients of the erfc approximation, constant term first.
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = poly * t + F.lit(c)
    return F.coalesce(F.least(F.lit(1.0), t * F.exp(-x * x + poly)), F.lit(1.0))


# Coefficients of Cody's rational approximations of erf and erfc, highest power first.
ERF_NUM = (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_DEN = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
MIDDLE_NUM = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
MIDDLE_DEN = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
FAR_NUM = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
FAR_DEN = (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_tails(z: Column | str) -> Column:
    """Two-sided normal p of z, accurate to about 1e-15 of its value at any z; null and NaN give null.

    erfc near zero is one less erf; further out it is exp(-x^2) times a ratio, and the square is split so that its rounding does not
    grow with x.
    """
    z = F.abs(F.col(z) if isinstance(z, str) else z)
    x = z / F.sqrt(F.lit(2.0))
    square = x * x
    near = 1 - x * _polynomial(square, ERF_NUM) / _polynomial(square, ERF_DEN)
    head = F.floor(x * 16) / 16
    fall = F.exp(-head * head) * F.exp(-(x - head) * (x + head))
    middle = fall * _polynomial(x, MIDDLE_NUM) / _polynomial(x, MIDDLE_DEN)
    inverse = 1 / F.greatest(square, F.lit(1.0))
    far = fall / F.greatest(x, F.lit(1.0)) * (F.lit(0.56418958354775628695) - inverse * _polynomial(inverse, FAR_NUM) / _polynomial(inverse, FAR_DEN))
    return F.when(z.isNull() | F.isnan(z), F.lit(None).cast("double")).when(x <= 0.46875, near).when(x <= 4.0, middle).when(x < 38.0, far).otherwise(0.0)


def ideal_de(control: DataFrame, sizes: DataFrame, predicted: DataFrame, genes: DataFrame, n_cells: int = 400, floor: float = 1e-9) -> DataFrame:
    """target, gene, z, p, p_adj, lfc of idealised cells: exact predicted means, the control's noise.

    control: cell, gene, value > 0, of control cells; sizes: cell, depth of all control cells, those without values included;
    predicted: target, gene, p (compositions, absent is zero); genes: gene, the tested ones. Means and variances are of counts per
    million in each cell; cells without a stored value count as zeros, through the number of cells. The predicted variance keeps the
    control's coefficient of variation. z is Welch's with n_cells on one side; p is adjusted within a target.
    """
    per = control.join(sizes, "cell").withColumn("cpm", F.when(F.col("depth") > 0, 1e6 * F.col("value") / F.col("depth")).otherwise(0.0))
    sums = per.groupBy("gene").agg(F.sum("cpm").alias("s"), F.sum(F.col("cpm") * F.col("cpm")).alias("ss"))
    n = sizes.agg(F.count(F.lit(1)).cast("double").alias("n"))
    ref = genes.select("gene").distinct().join(sums, "gene", "left").na.fill(0.0, ["s", "ss"]).crossJoin(F.broadcast(n))  # one row
    mean = F.col("s") / F.col("n")
    ref = ref.select("gene", "n", mean.alias("m0"), F.greatest((F.col("ss") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)).alias("v0"))
    grid = predicted.select("target").distinct().crossJoin(ref)  # axes of targets and tested genes
    full = grid.join(predicted.select("target", "gene", (1e6 * F.col("p")).alias("m1")), ["target", "gene"], "left").na.fill(0.0, ["m1"])
    m0, m1 = F.col("m0"), F.col("m1")
    scale = F.when(m0 > 0, m1 / m0).otherwise(1.0)
    se = F.sqrt(F.col("v0") * scale * scale / n_cells + F.col("v0") / F.col("n"))
    z = F.when(se > 0, (m1 - m0) / se).otherwise(0.0)
    out = full.select("target", "gene", z.alias("z"), F.log2((m1 + floor) / (m0 + floor)).alias("lfc")).withColumn("p", normal_tails("z"))
    return adjust(out, ["target"]).select("target", "gene", "z", "p", "p_adj", "lfc")


def welch(m1, v1, n1, m0, v0, n0):
    """Welch's z from means, variances and sizes; null without any variance."""
    se = F.sqrt(v1 / n1 + v0 / n0)
    return F.when(se > 0, F.abs(m1 - m0) / se)


def fixed_effect_slope(rows: DataFrame, group: str, y: str, x: str) -> DataFrame:
    """One row: least-squares slope of y on x with a constant for each group, and the number of rows."""
    own = Window.partitionBy(group)
    r = rows.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    c = r.select((F.col(y) - F.avg(y).over(own)).alias("y"), (F.col(x) - F.avg(x).over(own)).alias("x"))
    return c.agg((F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("slope"), F.count(F.lit(1)).alias("n"))


def partial_spearman(rows: DataFrame, keys: list[str], min_rows: int = 10) -> DataFrame:
    """Per group: Spearman of x and y without what both owe to z, from the three pairwise rank correlations."""
    ranked = rows.withColumns({f"r{c}": average_rank(keys, c) for c in "xyz"})
    r = ranked.groupBy(*keys).agg(
        pearson(F.col("rx"), F.col("ry")).alias("xy"), pearson(F.col("rx"), F.col("rz")).alias("xz"), pearson(F.col("ry"), F.col("rz")).alias("yz"),
        F.count(F.lit(1)).alias("n"),
    )
    den = F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    value = F.when((F.col("n") >= min_rows) & (den > 1e-9), (F.col("xy") - F.col("xz") * F.col("yz")) / den)
    return r.select(*keys, value.alias("partial"), "n")


def partial_rank_correlation(rows: DataFrame, keys: list[str], x: str, y: str, covariates: list[str], min_rows: int = 10) -> DataFrame:
    """keys..., partial, n: Spearman of x and y without what both owe to any number of covariates; null for few rows or a constant.

    Ranks are taken first; the rank correlations of a group are a few numbers, and the partial one is read from the inverse of their matrix.
    """
    cols = [x, y, *covariates]
    full = rows.dropna(subset=cols)
    ranked = full.withColumns({f"r{i}": average_rank(keys, c) for i, c in enumerate(cols)})
    entries = [pearson(F.col(f"r{i}"), F.col(f"r{j}")).alias(f"c{i}_{j}") for i in range(len(cols)) for j in range(i)]
    per = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *entries)
    size = len(cols)

    @F.pandas_udf("double")
    def partial(flat: pd.Series) -> pd.Series:
        out = []
        for values in flat:
            m = np.eye(size)
            m[np.tril_indices(size, -1)] = values
            m = m + np.tril(m, -1).T
            ok = np.isfinite(m).all() and np.linalg.matrix_rank(m) == size
            p = np.linalg.inv(m) if ok else None
            out.append(-p[0, 1] / np.sqrt(p[0, 0] * p[1, 1]) if ok else None)
        return pd.Series(out, dtype="float64")

    flat = F.array(*[F.col(f"c{i}_{j}") for i in range(size) for j in range(i)])
    usable = (F.col("n") >= min_rows) & ~F.exists(flat, lambda v: v.isNull())
    value = partial(F.when(usable, flat).otherwise(F.array_repeat(F.lit(float("nan")), size * (size - 1) // 2)))
    return per.select(*keys, value.alias("partial"), "n")


def fixed_effect_contrasts(rows: DataFrame, group: str, source: str, reference: str, y: str, covariates: list[str]) -> DataFrame:
    """source, contrast: least squares of y on source and covariates with a constant for each group, as differences from the reference.

    Sources are a short axis. One aggregation gives the cross products; a system of a few columns is solved.
    """
    full = rows.dropna(subset=[group, source, y, *covariates])
    names = [r[0] for r in full.select(source).distinct().orderBy(source).collect() if r[0] != reference]
    wide = full.select(group, F.col(y).alias("y"), *[(F.col(source) == n).cast("double").alias(f"s{i}") for i, n in enumerate(names)], *[F.col(c).alias(f"k{i}") for i, c in enumerate(covariates)])
    x = [f"s{i}" for i in range(len(names))] + [f"k{i}" for i in range(len(covariates))]
    own = Window.partitionBy(group)
    centred = wide.select(*[(F.col(c) - F.avg(c).over(own)).alias(c) for c in [*x, "y"]])
    xx, xy, _ = gram(centred, x, "y")
    coef = np.linalg.lstsq(xx, xy, rcond=None)[0]
    return rows.sparkSession.createDataFrame([(n, float(b)) for n, b in zip(names, coef, strict=False)], "source string, contrast double")


def paired_rank_difference(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """One row estimate, low, high: Spearman of score and q less the absolute one of other and q, with its interval over resampled rows.

    rows: pos from 0 to n - 1, score, other, q. A draw takes n positions by hash; draws are groups of a table.
    """
    full = rows.dropna(subset=["score", "other", "q"])
    taken = slots(full, draws, seed).join(full, "pos").select("draw", "score", "other", "q")
    both = taken.union(full.select(F.lit(-1).cast("bigint").alias("draw"), "score", "other", "q"))
    ranked = both.withColumns({f"r_{c}": average_rank(["draw"], c) for c in ("score", "other", "q")})
    per = ranked.groupBy("draw").agg((pearson(F.col("r_score"), F.col("r_q")) - F.abs(pearson(F.col("r_other"), F.col("r_q")))).alias("d"))
    return per.agg(F.max(F.when(F.col("draw") == -1, F.col("d"))).alias("estimate"), F.expr("percentile(case when draw >= 0 then d end, array(0.025, 0.975))").alias("q")).select(
        "estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")
    )
