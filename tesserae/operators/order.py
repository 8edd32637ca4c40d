"""Positions in a global order without one task that sorts everything."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

INF = float("inf")


def _range_of(rows: DataFrame, column: str, ends: list[float], out: str) -> DataFrame:
    """Adds the number of the range between ends that a value lies in; without ends all rows are in one."""
    if not ends:
        return rows.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=[-INF, *ends, INF], inputCol=column, outputCol=out).transform(rows)


def _inner(values: list[float] | None) -> list[float]:
    return sorted({v for v in values or [] if -INF < v < INF})


def in_order(rows: DataFrame, group: list[str], by: str, tie: str, carry: str | None = None, descending: bool = False) -> DataFrame:
    """Adds position (from 1 within each group, by `by` and then `tie`), size of the group and, if asked for, running: the sum of
    `carry` up to the row.

    Ranges of values, whose ends are approximate quantiles that the driver holds as a few numbers, are sorted each on its own;
    rows and sums of the ranges before come from a table of one row a group and range. A value that fills several ranges is cut by
    its ties, where these are numbers. Null and NaN stand last in either direction, after infinity, and count. Null groups are groups.
    An empty table gives an empty result.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(by).cast("double")
    missing = value.isNull() | F.isnan(value)
    # The number zero has two signs, which ranges and sorts would take for two values.
    r = rows.withColumns({"missing__": missing, "by__": F.when(missing, INF).when(value == 0, 0.0).otherwise(-value if descending else value)})
    wanted = ", ".join(str(i / parts) for i in range(1, parts))
    found = r.agg(F.expr(f"percentile_approx(by__, array({wanted}), {100 * parts})")).first()[0] if parts > 1 else []
    full = sorted({v for v in found or [] if v > -INF and found.count(v) > 1})
    # A full value begins and ends a range of its own.
    r = _range_of(r, "by__", sorted({x for v in full if v < INF for x in (v, math.nextafter(v, INF))} | set(_inner(found))), "range__")
    if full and isinstance(rows.schema[tie].dataType, NumericType):
        number = F.coalesce(F.nanvl(F.col(tie).cast("double"), F.lit(INF)), F.lit(-INF))
        fills = F.col("by__").isin(full) & ((F.col("by__") < INF) | F.col("missing__"))
        r = r.withColumn("tie__", F.when(fills, number).otherwise(-INF))
        many = r.filter(fills).agg(F.expr(f"percentile_approx(tie__, array({wanted}), {100 * parts})")).first()[0]
        r = _range_of(r, "tie__", _inner(many), "part__").drop("tie__")
    else:
        r = r.withColumn("part__", F.lit(0.0))
    ranges = ["range__", "part__"]
    carried = F.col(carry) if carry else F.lit(0.0)
    tally = r.groupBy(*group, *ranges).agg(F.count(F.lit(1)).alias("n"), F.sum(carried).alias("s"))
    own = Window.partitionBy(*group)
    before = own.orderBy(*ranges).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = tally.select(
        *[F.col(c).alias(f"{c}_b") for c in [*group, *ranges]],
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows__"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("sum__"), F.sum("n").over(own).alias("size"),
    )
    inside = Window.partitionBy(*group, *ranges).orderBy("by__", "missing__", tie)
    r = r.join(bases, _same([*group, *ranges])).drop(*[f"{c}_b" for c in [*group, *ranges]]).withColumn("position", F.col("rows__") + F.row_number().over(inside))
    if carry:
        r = r.withColumn("running", F.col("sum__") + F.coalesce(F.sum(carried).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    return r.drop("by__", "missing__", *ranges, "rows__", "sum__")


def _same(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"{c}_b"))
    return out
