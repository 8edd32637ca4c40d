"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands the neighbours above it to the least of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and those it points to point to the least of them; edges go from the larger to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the edges (u, v); loops are ignored.

    Large and small stars alternate until nothing changes, after a logarithmic number of rounds whatever the shape. The minima
    are aggregations that combine before they shuffle, and the joins are ones that Spark can split at nodes with very many
    edges. Only a count and a checksum come to the driver.
    """
    loose = edges.filter("u != v")
    live = cut(loose.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = tuple(live.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before or not state[0]:
            break
        before = state
        live = cut(_small_star(_large_star(live)))
    roots = live.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return live.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
