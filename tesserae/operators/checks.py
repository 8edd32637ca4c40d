"""Constraint checks as rows (name, passed, detail), digests and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(rows: DataFrame, name: str, bad: Column) -> DataFrame:
    """One row: whether no row is bad, and how many are."""
    n = F.count_if(bad)
    return rows.agg(n.alias("n")).select(F.lit(name).alias("name"), (F.col("n") == 0).alias("passed"), F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"))


def unique(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """One row: whether keys are unique, and how many repeat."""
    return check(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_copies")), name, F.col("n_copies") > 1)


def require(checks: DataFrame) -> DataFrame:
    """The checks; reading them fails at the first that did not pass."""
    failed = F.raise_error(F.concat(F.lit("check failed: "), F.col("name"), F.lit(", "), F.col("detail")))
    return checks.withColumn("passed", F.when(~F.col("passed"), failed).otherwise(F.col("passed")))


def row_digest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds digest: SHA-256 over the columns in order, nulls marked."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in rows.columns if c not in keys]
    return rows.withColumn("digest", F.sha2(F.concat_ws("\x1f", *cols), 256))


def table_digest(rows: DataFrame, column: str) -> DataFrame:
    """One row: count and an order-free digest of a column's SHA-256s (their first 60 bits, summed modulo 2^61 - 1)."""
    head = F.conv(F.substring(F.sha2(F.col(column), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.sum(head) % F.lit((1 << 61) - 1).cast("decimal(38,0)")).cast("bigint").alias("digest"))


def difference(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: rows on both sides and on one, values that differ, the largest difference. Missing is not zero."""
    both = left.select(*keys, F.col(value).alias("x"), F.lit(1).alias("l")).join(right.select(*keys, F.col(value).alias("y"), F.lit(1).alias("r")), keys, "full")
    gap = F.abs(F.col("x") - F.col("y"))
    there = F.col("l").isNotNull() & F.col("r").isNotNull()
    return both.agg(
        F.count_if(there).alias("both"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"),
        F.count_if(gap > 0).alias("differing"), F.max(gap).alias("largest"),
    )


def dedupe_identical(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: copies fold, rows that differ under one key are an error when read."""
    g = row_digest(rows, keys).groupBy(*keys).agg(F.countDistinct("digest").alias("kinds"), F.count(F.lit(1)).alias("copies"))
    return g.withColumn("copies", F.when(F.col("kinds") > 1, F.raise_error(F.lit("rows differ under one key"))).otherwise(F.col("copies"))).drop("kinds")
