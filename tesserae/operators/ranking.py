"""Selective prediction, calibration, prefixes and crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.order import in_order
from tesserae.operators.quantiles import exact_quantiles

COVERAGES = (1.0, 0.75, 0.5, 0.25, 0.1)


def risk_coverage(rows: DataFrame, group: list[str], coverages: tuple[float, ...] = COVERAGES) -> DataFrame:
    """Mean and median risk of the most confident share of each group, at least one row, for each coverage."""
    ranked = in_order(rows, group, "confidence", "id", descending=True)
    wide = ranked.withColumn("coverage", F.explode(F.array(*[F.lit(c) for c in coverages])))
    kept = wide.filter(F.col("position") <= F.greatest(F.lit(1), F.bround(F.col("coverage") * F.col("size"))))
    keys = [*group, "coverage"]
    middle = exact_quantiles(kept, keys, "risk", (0.5,)).select(*keys, F.col("q")[0].alias("median_risk"))
    means = kept.groupBy(*keys).agg(F.avg("risk").alias("mean_risk"), F.count(F.lit(1)).alias("kept"))
    return means.join(middle, keys, "left").select(*keys, "mean_risk", "median_risk", "kept")


def area_under_risk_coverage(rows: DataFrame, group: list[str]) -> DataFrame:
    """Mean over all prefixes by confidence of the prefix's mean risk."""
    ranked = in_order(rows, group, "confidence", "id", carry="risk", descending=True)
    return ranked.groupBy(*group).agg(F.avg(F.col("running") / F.col("position")).alias("aurc"))


def capture(rows: DataFrame, group: list[str], budgets: tuple[float, ...]) -> DataFrame:
    """Share of all (non-negative) risk that the least confident share of each group holds."""
    r = in_order(rows.withColumn("risk", F.greatest("risk", F.lit(0.0))), group, "confidence", "id")
    wide = r.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    inside = F.col("position") <= F.greatest(F.lit(1), F.bround(F.col("budget") * F.col("size")))
    return wide.groupBy(*group, "budget").agg((F.sum(F.when(inside, F.col("risk")).otherwise(0.0)) / F.sum("risk")).alias("captured"))


def quantile_bin(value: Column, edges: Column, bins: int) -> Column:
    """Bin from 0 by inner edges (an array of bins + 1 values); the last bin is closed."""
    out = F.lit(bins - 1)
    for i in range(bins - 2, -1, -1):
        out = F.when(value < F.get(edges, F.lit(i + 1)), i).otherwise(out)
    return out


def calibration(rows: DataFrame, bins: int = 5) -> DataFrame:
    """Per quantile bin of confidence: rows, mean confidence, mean and median quality."""
    binned = in_quantile_bins(rows, "confidence", bins)
    middle = exact_quantiles(binned, ["bin"], "quality", (0.5,)).select("bin", F.col("q")[0].alias("median_quality"))
    means = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.avg("quality").alias("quality"))
    return means.join(middle, "bin", "left")


def in_quantile_bins(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Adds bin, from 0, between exact quantiles of the value over all rows."""
    edges = exact_quantiles(rows, [], value, tuple(i / bins for i in range(bins + 1))).select(F.col("q").alias("edges"))  # one row
    return rows.crossJoin(F.broadcast(edges)).withColumn("bin", quantile_bin(F.col(value), F.col("edges"), bins)).drop("edges")


def first_crossing(curve: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """The least k >= 1 at which the value reaches the threshold; null if it never does."""
    return curve.groupBy(*group).agg(F.min(F.when((F.col("v") >= threshold) & (F.col("k") >= 1), F.col("k"))).alias("first_k"))


def log_crossing(curve: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """Where the curve first reaches the threshold, linear in log k between the budgets around it."""
    own = Window.partitionBy(*group).orderBy("k")
    c = curve.withColumns({"v0": F.lag("v").over(own), "k0": F.lag("k").over(own)})
    share = (F.lit(threshold) - F.col("v0")) / (F.col("v") - F.col("v0"))
    between = F.exp(F.log("k0") + share * (F.log("k") - F.log("k0")))
    hit = (F.col("v") >= threshold) & (F.col("v0").isNull() | (F.col("v0") < threshold))
    at = F.when(F.col("v0").isNull(), F.col("k").cast("double")).otherwise(between)
    return c.groupBy(*group).agg(F.min_by(F.when(hit, at), F.when(hit, F.col("k"))).alias("k_star"))


def prefix_purity_reach(rows: DataFrame, group: list[str], order: list[Column], purity: float = 0.9) -> DataFrame:
    """Length of the longest prefix, in the given order, of which at least `purity` match; and the number of rows."""
    own = Window.partitionBy(*group).orderBy(*order)
    r = rows.withColumns({"position": F.row_number().over(own), "share": F.avg(F.col("match").cast("double")).over(own.rowsBetween(Window.unboundedPreceding, 0))})
    return r.groupBy(*group).agg(F.max(F.when(F.col("share") >= purity, F.col("position")).otherwise(0)).alias("reach"), F.count(F.lit(1)).alias("n"))


def midrank_percentile(value: str, over: list[str]) -> Column:
    """(average rank - 1/2) / n of a value among those of its group that are there; 1/2 for a missing one."""
    from tesserae.operators.similarity import average_rank

    n = F.count(value).over(Window.partitionBy(*over))
    missing = F.count(F.lit(1)).over(Window.partitionBy(*over)) - n
    return F.when(F.col(value).isNull(), 0.5).otherwise((average_rank(over, value) - missing - 0.5) / n)
