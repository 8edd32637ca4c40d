"""Exact quantiles by selection: no task holds all values of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000  # a first pass places a quantile within one in so many of its rank
HELD_GROUPS = 10_000  # groups whose brackets go to every task; more are joined


def exact_quantiles(rows: DataFrame, group: list[str], value: str | Column, shares: tuple[float, ...], accuracy: int = ACCURACY) -> DataFrame:
    """group..., n, q: the number of values and the linear quantiles of each group (position (n - 1) * share between sorted values).

    The first pass is a mergeable sketch of each group, from which two values around each quantile follow. The second counts: values
    outside all brackets by the gap they are in, values inside each on its own. The wanted order statistics are then read from
    running counts over a small table. A statistic that the sketch did not bracket is found if it ends a gap; any other is an error.

    Null and NaN are no values. A group without values is left out; null is a group. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    x = rows.select(*group, (F.col(value) if isinstance(value, str) else value).cast("double").alias("v__")).filter("v__ is not null and not isnan(v__)")
    x = x.withColumn("v__", F.when(F.col("v__") == 0, 0.0).otherwise(F.col("v__")))
    off = 3.0 / accuracy
    ends = [e for s in shares for e in (max(s - off, 0.0), min(s + off, 1.0))]
    sketch = x.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.min("v__").alias("least"), F.max("v__").alias("most"), F.expr(f"percentile_approx(v__, array({', '.join(map(repr, ends))}), {accuracy})").alias("e")
    )
    low = [F.when(F.lit(ends[2 * i] <= 0), F.col("least")).otherwise(F.col("e")[2 * i]) for i in range(len(shares))]
    high = [F.when(F.lit(ends[2 * i + 1] >= 1), F.col("most")).otherwise(F.col("e")[2 * i + 1]) for i in range(len(shares))]
    brackets = F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in zip(low, high, strict=True)]).alias("brackets")
    sketch = sketch.select(*[F.col(c).alias(f"{c}__g") for c in group], "n", brackets)
    held = sketch.limit(HELD_GROUPS + 1).collect()
    few = len(held) <= HELD_GROUPS
    around = F.broadcast(spark.createDataFrame(held, sketch.schema)) if few else sketch
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__g"))
    met = x.join(around, same) if group else x.crossJoin(around)
    v = F.col("v__")
    inside = F.exists("brackets", lambda b: (v >= b["a"]) & (v <= b["b"]))
    gap = F.size(F.filter("brackets", lambda b: b["b"] < v))
    cells = met.groupBy(*group, "n", F.when(inside, v).alias("at"), F.when(~inside, gap).alias("gap")).agg(
        F.count(F.lit(1)).alias("c"), F.min(v).alias("first"), F.max(v).alias("last")
    )
    order = Window.partitionBy(*group).orderBy("first")  # values of brackets and one row a gap
    run = cells.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def statistic(rank: Column) -> Column:
        here = (F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto"))
        known = F.when((F.col("first") == F.col("last")) | (rank == F.col("upto") - F.col("c")), F.col("first")).when(rank == F.col("upto") - 1, F.col("last"))
        return F.max(F.when(here, F.coalesce(known, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))))

    place = [(F.col("n") - 1) * float(s) for s in shares]
    found = run.groupBy(*group, "n").agg(
        *[statistic(F.floor(p)).alias(f"l{i}") for i, p in enumerate(place)], *[statistic(F.least(F.floor(p) + 1, F.col("n") - 1)).alias(f"u{i}") for i, p in enumerate(place)]
    )
    between = lambda i, p: F.when(F.col(f"l{i}") == F.col(f"u{i}"), F.col(f"l{i}")).otherwise((1 - (p - F.floor(p))) * F.col(f"l{i}") + (p - F.floor(p)) * F.col(f"u{i}"))
    return found.select(*group, "n", F.array(*[between(i, p) for i, p in enumerate(place)]).alias("q"))
