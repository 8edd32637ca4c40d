"""Null representations of responses: permuted, resampled and projected gene sets, and where an observed value lies among them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import pearson

BLOCK_GENES = 256  # genes whose part of a projection is summed in one task
MAX_AXIS = 1 << 20  # names of genes, and members of sets, that every task holds
KINDS = ("permuted", "resampled", "projected")


def _key(*parts: object) -> str:
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def normal_entry(seed: int, draw: int, component: int, gene: str) -> float:
    """A standard normal number that seed, draw, component and gene determine, from two uniform ones by Box and Muller."""
    h = _key(seed, draw, component, gene)
    one, two = (int(h[i : i + 8], 16) + 0.5 for i in (0, 8))
    return float(np.sqrt(-2 * np.log(one / 2**32)) * np.cos(2 * np.pi * two / 2**32))


class Representation:
    """Rows of the gene x component map of a draw, made where they are needed from keys; no map is stored.

    sets: sorted genes of each set. permuted: every gene bears the name that stands at its place in the order of keys, so that sizes,
    overlaps and degrees stay. resampled: each set takes as many genes as it has by least keys, so that sizes stay. projected: normal
    entries, each component scaled to length one, so that the number of components stays. Draw -1 is the sets themselves.
    """

    def __init__(self, kind: str, genes: list[str], sets: dict[str, list[str]], seed: int) -> None:
        if kind not in KINDS:
            raise ValueError(f"no representation {kind}")
        if any(len(s) == 0 or len(set(s)) > len(genes) for s in sets.values()):
            raise ValueError("a set without genes, or with more than there are")
        self.kind, self.genes, self.sets, self.seed = kind, genes, sets, seed
        self.names = sorted(sets)

    def members(self, draw: int) -> list[set[str]]:
        if draw < 0:
            return [set(self.sets[n]) for n in self.names]
        if self.kind == "permuted":
            order = sorted(self.genes, key=lambda g: (_key(self.seed, draw, g), g))
            now = dict(zip(self.genes, order, strict=True))
            return [{now[g] for g in self.sets[n]} for n in self.names]
        return [set(sorted(self.genes, key=lambda g: (_key(self.seed, draw, n, g), g))[: len(set(self.sets[n]))]) for n in self.names]

    def rows(self, draw: int, wanted: list[str]) -> np.ndarray:
        if draw >= 0 and self.kind == "projected":
            return np.array([[normal_entry(self.seed, draw, k, g) for k in range(len(self.names))] for g in wanted])
        members = self.members(draw)
        return np.array([[(g in m) / len(m) for m in members] for g in wanted])


def project_nulls(responses: DataFrame, sets: DataFrame, kind: str, draws: int, seed: int, draws_together: int = 8) -> DataFrame:
    """draw, context, perturbation, component, value: responses in each drawn representation; draw -1 has the sets themselves.

    responses: context, perturbation, gene, delta; sets: set, gene, of which genes without responses are left out. A task holds some
    genes and some draws, makes their rows of the map, and adds up; sums of the tasks meet by cell of the grid. The axis of
    genes and the sets are held by every task, checked.
    """
    genes = [r[0] for r in responses.select("gene").distinct().orderBy("gene").limit(MAX_AXIS + 1).collect()]
    own = responses.select("gene").distinct()
    members: dict[str, list[str]] = {}
    listed = sets.select("set", "gene").distinct().join(own, "gene").limit(MAX_AXIS + 1).collect()
    if max(len(genes), len(listed)) > MAX_AXIS:
        raise ValueError("the axis of genes is too large to be held by every task")
    for r in listed:
        members.setdefault(r["set"], []).append(r.gene)
    shape = Representation(kind, genes, members, seed)
    names = shape.names
    blocks = -(-len(genes) // BLOCK_GENES)

    def add_up(g: pd.DataFrame) -> pd.DataFrame:
        first = int(g["draws"].iloc[0])
        wide = g.pivot(index=["context", "perturbation"], columns="gene", values="delta")
        y, columns = wide.fillna(0.0).to_numpy(), list(wide.columns)
        out = []
        for draw in [-1] * (first == 0) + list(range(first, min(first + draws_together, draws))):
            w = shape.rows(draw, columns)
            part = pd.DataFrame({"context": wide.index.get_level_values(0), "perturbation": wide.index.get_level_values(1), "draw": draw, "part": list(y @ w)})
            part["norm"] = [(w * w).sum(axis=0)] * len(part)
            out.append(part)
        return pd.concat(out)[["draw", "context", "perturbation", "part", "norm"]]

    starts = responses.sparkSession.range(0, max(draws, 1), draws_together).select(F.col("id").cast("int").alias("draws"))
    dealt = responses.select("context", "perturbation", "gene", "delta", F.pmod(F.xxhash64("gene"), F.lit(blocks)).alias("block")).crossJoin(F.broadcast(starts))
    parts = dealt.groupBy("draws", "block").applyInPandas(add_up, "draw int, context string, perturbation string, part array<double>, norm array<double>")
    sums = parts.groupBy("draw", "context", "perturbation").agg(
        *[F.sum(F.col("part")[i]).alias(f"v{i}") for i in range(len(names))], *[F.sum(F.col("norm")[i]).alias(f"n{i}") for i in range(len(names))]
    )
    scaled = (F.col("draw") >= 0) & F.lit(kind == "projected")
    value = [F.when(scaled, F.col(f"v{i}") / F.sqrt(F.col(f"n{i}"))).otherwise(F.col(f"v{i}")) for i in range(len(names))]
    return sums.select("draw", "context", "perturbation", F.posexplode(F.array(*value)).alias("component", "value"))


def recovered(projected: DataFrame, target: str, predictor: str) -> DataFrame:
    """draw, recoverability: mean over perturbations of the correlation, over components, of the target's interaction with what a
    source predicts of it: the source less the mean of all sources, both centred over perturbations."""
    over = lambda *keys: Window.partitionBy("draw", "component", *keys)
    v = F.col("value")
    d = projected.withColumns({"truth": v - F.avg(v).over(over("context")) - F.avg(v).over(over("perturbation")) + F.avg(v).over(over())})
    cell = d.groupBy("draw", "component", "perturbation").agg(
        F.max(F.when(F.col("context") == target, F.col("truth"))).alias("truth"),
        (F.max(F.when(F.col("context") == predictor, v)) - F.avg(F.when(F.col("context") != target, v))).alias("lead"),
    )
    lead = F.col("lead") - F.avg("lead").over(over())
    each = cell.withColumn("guess", lead).groupBy("draw", "perturbation").agg(pearson(F.col("truth"), F.col("guess"), 1e-12).alias("r"))
    return each.groupBy("draw").agg(F.avg("r").alias("recoverability"))


def among_nulls(values: DataFrame, value: str) -> DataFrame:
    """One row observed (draw -1), null_mean, null_sd, percentile, p_value, z, n_null: where the observed value lies among the drawn ones.

    The p-value counts the observed one among the draws, so it is never zero. Draws without a value are left out.
    """
    x = F.col(value)
    null = F.when(F.col("draw") >= 0, x)
    one = values.agg(F.max(F.when(F.col("draw") < 0, x)).alias("observed"), F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_sd"), F.count(null).alias("n_null"))
    below = values.crossJoin(F.broadcast(one)).filter("draw >= 0").groupBy("observed", "null_mean", "null_sd", "n_null").agg(
        F.count_if(x < F.col("observed")).alias("below"), F.count_if(x >= F.col("observed")).alias("reached")
    )  # one row
    n, o = F.col("n_null"), F.col("observed")
    return below.select(
        "observed", "null_mean", "null_sd", F.when((n > 0) & o.isNotNull(), 100 * F.col("below") / n).alias("percentile"),
        F.when((n > 0) & o.isNotNull(), (F.col("reached") + 1) / (n + 1)).alias("p_value"),
        F.when(F.col("null_sd") > 1e-12, (o - F.col("null_mean")) / F.col("null_sd")).alias("z"), "n_null",
    )
