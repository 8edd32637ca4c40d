"""Seeded splits, draws and resampling. Order comes from md5 of seed and keys, so other engines can repeat every draw."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import draw_index, draw_key


def with_repeats(rows: DataFrame, repeats: int) -> DataFrame:
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def shuffled(rows: DataFrame, group: list[str], key: Column) -> DataFrame:
    """Adds nth (from 1, in drawn order) and size of the group."""
    own = Window.partitionBy(*group)
    return rows.withColumn("draw", key).withColumns(
        {"nth": F.row_number().over(own.orderBy("draw", "cell")), "size": F.count(F.lit(1)).over(own)}
    ).drop("draw")


PREFIX = 4  # digits of a key whose cells are counted together


def halves(cells: DataFrame, group: list[str], seed: int, drop_odd: bool = True) -> DataFrame:
    """Adds half, 0 or 1, at random within each group; an odd cell is dropped, or kept in the second half.

    A group may be most of the table, so it is not put in order as one: cells are counted by the first digits of their keys, which are as
    good as uniform, and only those that share these digits with the last cell of a half are ordered.
    """
    of, key = F.struct(*group), F.struct("draw", "cell")  # as structs, nulls are equal
    drawn = cells.withColumns({"of": of, "draw": draw_key(seed, *[F.col(c).cast("string") for c in group], F.col("cell").cast("string"))})
    drawn = drawn.withColumn("digits", F.substring("draw", 1, PREFIX))
    n, own = drawn.groupBy("of", "digits").agg(F.count(F.lit(1)).alias("n")), Window.partitionBy("of")
    n = n.withColumns({"upto": F.sum("n").over(own.orderBy("digits")), "half": F.floor(F.sum("n").over(own) / 2)}).withColumn("before", F.col("upto") - F.col("n"))
    last = lambda k: (F.col("before") < k * F.col("half")) & (F.col("upto") >= k * F.col("half"))
    near = drawn.select("of", "digits", key.alias("key")).join(F.broadcast(n.filter(last(1) | last(2))), ["of", "digits"])  # two rows a group
    near = near.withColumn("nth", F.col("before") + F.row_number().over(Window.partitionBy("of", "digits").orderBy("key")))
    ends = near.groupBy("of").agg(*[F.max(F.when(F.col("nth") == k * F.col("half"), F.col("key"))).alias(f"end{k}") for k in (1, 2)])
    code = F.when(key <= F.col("end1"), 0)
    code = code.when(key <= F.col("end2"), 1) if drop_odd else code.otherwise(1)
    out = drawn.join(F.broadcast(ends), "of", "left").withColumn("half", code)  # a row a group
    return out.filter("half is not null").select(*cells.columns, "half")


def three_parts(cells: DataFrame, group: list[str], seed: int) -> DataFrame:
    """Adds part: F for the first half of each group in drawn order, E1 and E2 for the two last quarters."""
    s = shuffled(cells, group, draw_key(seed, F.col("cell").cast("string")))
    f, e = F.floor(F.col("size") / 2), F.floor(F.col("size") / 4)
    part = F.when(F.col("nth") <= f, "F").when(F.col("nth") <= f + e, "E1").otherwise("E2")
    return s.withColumn("part", part).drop("nth", "size")


def blocks(cells: DataFrame, group: list[str], n_blocks: int, seed: int) -> DataFrame:
    """Adds block: shuffled cells dealt in turn over n_blocks near-equal blocks."""
    s = shuffled(cells, group, draw_key(seed, F.col("cell").cast("string")))
    return s.withColumn("block", (F.col("nth") - 1) % n_blocks).drop("nth", "size")


def folds(labels: DataFrame, label: str, n_folds: int, seed: int) -> DataFrame:
    """Adds fold: near-equal disjoint parts of a label axis (one window over the labels, not the data)."""
    return labels.withColumn("fold", F.ntile(n_folds).over(Window.orderBy(draw_key(seed, F.col(label)), label)) - 1)


def subsample(cells: DataFrame, group: list[str], wanted: DataFrame, seed: int) -> DataFrame:
    """Cells of each group up to the number that `wanted` (group..., n) asks for."""
    s = shuffled(cells, group, draw_key(seed, F.col("cell").cast("string")))
    return s.join(wanted, group).filter(F.col("nth") <= F.col("n")).drop("nth", "size", "n")


SLOTS = 65_536  # slots of a draw that one row stands for until a task lists them


def slots(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """draw, pos: as many positions from 0 to n - 1 for each draw as there are rows, by hash.

    Spark takes the size of rows that are exploded for that of the few that they come from. Joined with rows of a table, they would be
    sent whole to the driver and every task; the hint has both sides meet by a shuffle instead.
    """
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    each = F.broadcast(n).crossJoin(rows.sparkSession.range(draws).withColumnRenamed("id", "draw"))
    runs = each.filter("n > 0").withColumn("first", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(SLOTS).cast("bigint"))))
    last = F.least(F.col("first") + SLOTS, F.col("n")) - 1
    key = draw_key(seed, F.col("draw").cast("string"), F.col("slot").cast("string"))
    listed = runs.withColumn("slot", F.explode(F.sequence(F.col("first"), last)))
    return listed.select("draw", draw_index(key, F.col("n")).alias("pos")).hint("merge")


def bootstrap_ratio(rows: DataFrame, num: str, den: str, draws: int, seed: int) -> DataFrame:
    """One row: estimate, low and high of 1 - sum(num) / sum(den) over resampled rows (pos from 0 to n - 1).

    Each draw takes n rows by hash; draws and slots are rows of a table, so they spread over tasks.
    """
    taken = slots(rows, draws, seed).join(rows, "pos")
    per = taken.groupBy("draw").agg((1 - F.sum(num) / F.sum(den)).alias("m"))
    ends = per.agg(F.expr("percentile(m, array(0.025, 0.975))").alias("q"))
    point = rows.agg((1 - F.sum(num) / F.sum(den)).alias("estimate"))
    return point.crossJoin(ends).select("estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def permutation_test(rows: DataFrame, flag: str, value: str, draws: int, seed: int) -> DataFrame:
    """One row: difference of means by flag, mean and sd of its null over shuffled flags, and the one-sided p.

    Rows have pos from 1 to n. A draw orders positions by hash and gives the k-th row the flag of the k-th drawn position.
    """
    diff = F.avg(F.when(F.col(flag) == 1, F.col(value))) - F.avg(F.when(F.col(flag) == 0, F.col(value)))
    drawn = rows.select("pos", value).crossJoin(rows.sparkSession.range(draws).withColumnRenamed("id", "draw"))
    order = Window.partitionBy("draw").orderBy(draw_key(seed, F.col("draw").cast("string"), F.col("pos").cast("string")), "pos")
    mixed = drawn.withColumn("k", F.row_number().over(order)).drop("pos").join(rows.select(F.col("pos").alias("k"), flag), "k")
    null = mixed.groupBy("draw").agg(diff.alias("null"))
    observed = rows.agg(diff.alias("observed"))
    return null.crossJoin(F.broadcast(observed)).groupBy("observed").agg(
        F.avg("null").alias("null_mean"),
        F.stddev_samp("null").alias("null_sd"),
        ((F.count_if(F.col("null") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"),
    )


BLOCK_ROWS = 100_000  # rows whose counts of a draw are made together
MAX_BLOCKS = 100_000


def bootstrap_sums(rows: DataFrame, key: str, values: list[str], draws: int, seed: int, blocks: int | None = None) -> DataFrame:
    """draw, n and the sum of each value over as many rows as there are, taken with replacement; draw -1 is the rows themselves.

    A draw is a number for every row, multinomial over all rows: the total is split over blocks of rows by a multinomial that every
    task makes alike from the sizes of blocks, and a block's share over its rows. No draw is a list of slots and none is joined; the
    cost is rows x draws, in memory a block. Rows are dealt to blocks by their key and ordered by it, so that a draw repeats.
    """
    total = rows.count()
    blocks = blocks or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_ROWS))
    if blocks > MAX_BLOCKS:
        raise ValueError(f"{blocks} blocks are more than {MAX_BLOCKS}")
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), F.col(key).alias("key"), *[F.col(v).cast("double").alias(v) for v in values])
    size = np.zeros(blocks, dtype=np.int64)
    for r in dealt.groupBy("block").count().collect():  # one number a block
        size[r["block"]] = r["count"]

    def take(g: pd.DataFrame) -> pd.DataFrame:
        block = int(g["block"].iloc[0])
        x = g.sort_values(["key", *values])[values].to_numpy()
        out = np.empty((draws + 1, len(values) + 1))
        out[0] = len(x), *x.sum(axis=0)
        for d in range(draws):
            mine = np.random.default_rng([seed, d]).multinomial(total, size / total)[block]
            count = np.random.default_rng([seed, d, block]).multinomial(mine, np.full(len(x), 1 / len(x)))
            out[d + 1] = mine, *(count @ x)
        return pd.DataFrame(out, columns=["n", *values]).assign(draw=np.arange(-1, draws))

    schema = "n double, " + ", ".join(f"`{v}` double" for v in values) + ", draw long"
    parts = dealt.groupBy("block").applyInPandas(take, schema)
    return parts.groupBy("draw").agg(F.sum("n").cast("bigint").alias("n"), *[F.sum(v).alias(v) for v in values])


def interval(draws: DataFrame, statistic: Column, level: float = 0.95) -> DataFrame:
    """One row estimate, low, high of a statistic of the sums that bootstrap_sums returns."""
    each = draws.select("draw", statistic.alias("s"))
    tail = (1 - level) / 2
    return each.agg(
        F.max(F.when(F.col("draw") < 0, F.col("s"))).alias("estimate"), F.expr(f"percentile(CASE WHEN draw >= 0 THEN s END, array({tail}, {1 - tail}))").alias("q")
    ).select("estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))  # one row a draw
