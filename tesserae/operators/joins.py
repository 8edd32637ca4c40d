"""Joins with structure: bands, edges, aliases, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], position: str, width: float) -> DataFrame:
    """Pairs on equal keys whose positions differ by at most width: keys..., l_id, r_id, distance.

    Positions fall into buckets of that width; a right row goes to its bucket and both neighbours, so the join is an equality
    on key and bucket and every pair meets once.
    """
    bucket = F.floor(F.col(position) / width)
    l_ = left.select(*keys, F.col("id").alias("l_id"), F.col(position).alias("l_pos"), bucket.alias("bucket"))
    near = F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket")
    r_ = right.select(*keys, F.col("id").alias("r_id"), F.col(position).alias("r_pos"), near)
    gap = F.abs(F.col("l_pos") - F.col("r_pos"))
    return l_.join(r_, [*keys, "bucket"]).withColumn("distance", gap).filter(F.col("distance") <= width).drop("bucket", "l_pos", "r_pos")


def neighbour_ceiling(control, distance):
    """The most that a gene next to a silenced one may keep: 15 % of control at 500 or less, all of it at 5,000."""
    share = F.log10(F.greatest(distance.cast("double"), F.lit(500.0)) / 500)
    return control * (0.15 + 0.85 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Both directions of every edge with the largest score seen either way; loops drop out."""
    both = edges.select("a", "b", "score").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    return both.filter("a != b").groupBy("a", "b").agg(F.max("score").alias("score"))


def resolve_aliases(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """Labels under their canonical name where an alias table (alias, canonical) has one, else as they are."""
    return labels.join(aliases, F.col("label") == F.col("alias"), "left").select(
        "label", F.coalesce("canonical", "label").alias("canonical"), F.col("alias").isNotNull().alias("alias_used")
    )


def coverage_tiers(usable: DataFrame, targets: DataFrame, cap: int = 3) -> DataFrame:
    """Per target: number of sources in which it is usable, the tier (number, at most cap) and their names."""
    good = usable.filter("usable").groupBy("target").agg(F.countDistinct("source").alias("n"), F.array_sort(F.collect_set("source")).alias("names"))
    out = targets.join(good, "target", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("target", n.alias("n_sources"), F.least(n, F.lit(cap)).alias("tier"), F.coalesce(F.array_join("names", "|"), F.lit("")).alias("sources"))


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a full order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("nth = 1").drop("nth")
