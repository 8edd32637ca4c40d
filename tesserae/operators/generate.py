"""Seeded synthetic counts, one group of cells at a time. Seeds come from keys, so a repeated task gives the same counts."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BLOCK = 8192  # cells of a block whose counts are held at once
HANDED_ON = 65_536  # counts of several cells that a task hands on at once
KINDS = ("multinomial", "gamma_poisson", "binomial")


def seed_of(*parts: object) -> int:
    """The first four bytes, little-endian, of the SHA-256 of the parts joined by colons."""
    return int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:4], "little")


def synthetic_cells(cells: DataFrame, seed: int, rate: float = 2.0, modulation: float = 0.3) -> DataFrame:
    """Poisson counts context, cell, gene, value > 0 for rows context, cell, genes ARRAY: each row is one cell.

    Every gene has a base rate and each context its own change of it, both from the seed and their names.
    """

    def draw(batches):
        rates: dict[tuple, np.ndarray] = {}
        for b in batches:
            at, value, row = [], [], []
            for i, (context, cell, genes) in enumerate(b[["context", "cell", "genes"]].itertuples(index=False)):
                if (context, len(genes)) not in rates:
                    base = np.random.default_rng(seed_of(seed, "base")).gamma(1.0, rate, len(genes))
                    rates[context, len(genes)] = base * np.exp(np.random.default_rng(seed_of(seed, context)).normal(0, modulation, len(genes)))
                x = np.random.default_rng(seed_of(seed, context, cell)).poisson(rates[context, len(genes)])
                there = np.flatnonzero(x)
                at.append(np.asarray(genes, dtype=object)[there])
                value.append(x[there].astype(float))
                row.append(np.full(len(there), i))
            if row:
                own = b.iloc[np.concatenate(row)]
                yield pd.DataFrame({"context": own["context"].to_numpy(), "cell": own["cell"].to_numpy(), "gene": np.concatenate(at), "value": np.concatenate(value)})

    return cells.mapInPandas(draw, "context string, cell long, gene string, value double")


def draw_counts(profiles: DataFrame, kind: str, seed: int, dispersion: float = 0.2) -> DataFrame:
    """Counts for cells of a target: profiles has target, cell, depth, genes ARRAY, shares ARRAY.

    multinomial: depth draws by share; gamma_poisson: Poisson with a gamma factor of the given dispersion; binomial: each
    expected count thinned on its own. A row is one cell, so no group is ever collected.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")

    def together(drawn):
        target, cell, gene, value = zip(*drawn, strict=True)
        size = [len(v) for v in value]
        return pd.DataFrame({"target": np.repeat(np.array(target, dtype=object), size), "cell": np.repeat(np.array(cell), size), "gene": np.concatenate(gene), "value": np.concatenate(value).astype("int64")})

    def draw(batches):
        for b in batches:
            drawn, held = [], 0
            for target, cell, depth, genes, shares in b[["target", "cell", "depth", "genes", "shares"]].itertuples(index=False):
                rng = np.random.default_rng(seed_of(seed, target, cell))
                p = np.maximum(np.asarray(shares, dtype=float), 0)
                p = p / p.sum() if p.sum() > 0 else np.full(len(p), 1 / max(len(p), 1))
                if kind == "multinomial":
                    x = rng.multinomial(int(depth), p)
                elif kind == "gamma_poisson":
                    x = rng.poisson(depth * p * rng.gamma(1 / dispersion, dispersion, len(p)))
                else:
                    x = rng.binomial(int(depth), np.minimum(p, 1))
                at = np.flatnonzero(x)
                drawn.append((target, cell, np.asarray(genes, dtype=object)[at], x[at]))
                held += len(at)
                if held >= HANDED_ON:
                    yield together(drawn)
                    drawn, held = [], 0
            if drawn:
                yield together(drawn)

    return profiles.mapInPandas(draw, "target string, cell long, gene string, value long")


def rake(template: DataFrame, seed: int, iterations: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """Whole counts per (target, block) whose row sums are the depths and whose column sums follow wanted shares.

    template: target, block, cell, depth, genes ARRAY, base ARRAY (starting counts), share ARRAY. A block is a bounded number of
    cells of one target. Rows and columns are scaled in turn, then rounded down, and what is missing from each row goes to the
    largest remainders.
    """

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > MAX_BLOCK:
            raise ValueError(f"a block of {len(g)} cells; at most {MAX_BLOCK} are made together")
        g = g.sort_values("cell")
        x = np.array(g["base"].tolist(), dtype=float) + 1e-6
        depth, share = g["depth"].to_numpy(dtype=float), np.asarray(g["share"].iloc[0], dtype=float)
        want = depth.sum() * share / share.sum()
        for _ in range(iterations):
            x *= (want / np.maximum(x.sum(axis=0), 1e-300))[None, :]
            scale = depth / np.maximum(x.sum(axis=1), 1e-300)
            x *= scale[:, None]
            if np.abs(x.sum(axis=0) - want).max() <= tolerance * max(want.max(), 1):
                break
        whole = np.floor(x).astype(np.int64)
        for i, gap in enumerate((depth - whole.sum(axis=1)).astype(int)):
            whole[i, np.argsort(-(x[i] - whole[i]), kind="stable")[:gap]] += 1
        genes = np.asarray(g["genes"].iloc[0], dtype=object)
        row, col = np.nonzero(whole)
        return pd.DataFrame({"target": g["target"].iloc[0], "cell": g["cell"].to_numpy()[row], "gene": genes[col], "value": whole[row, col]})

    return template.groupBy("target", "block").applyInPandas(fit, "target string, cell long, gene string, value long")


def jackknife(cells: DataFrame, target: float = 5e4) -> DataFrame:
    """group, variance: the sum over genes of the delete-one jackknife variance over cells of the bulk profile
    log1p(target * total / depth); 0 for fewer than two cells or where one cell holds all depth.

    cells: group, cell, depth, gene, value, zeros not stored.
    """
    depths = cells.select("group", "cell", "depth").distinct().groupBy("group", "depth").agg(F.count(F.lit(1)).alias("m"))
    return jackknife_counts(depths, cells.groupBy("group", "gene", "depth", "value").agg(F.count(F.lit(1)).alias("m")), target)


def jackknife_counts(depths: DataFrame, entries: DataFrame, target: float = 5e4) -> DataFrame:
    """What `jackknife` returns, from how often things are there: depths group, depth, m cells; entries group, gene, depth, value, m.

    What a gene's profile is without a cell depends on that cell's depth and value only, and without one that lacks the gene on its
    depth only, so these terms are taken once for each different depth of a group and corrected at different stored values.
    """
    m = F.col("m")
    whole = depths.groupBy("group").agg(F.sum("m").alias("n"), F.sum(m * F.col("depth")).alias("s"), F.max("depth").alias("top"))
    usable = whole.filter("n > 1 and s > top")
    totals = entries.groupBy("group", "gene").agg(F.sum(m * F.col("value")).alias("t")).join(usable, "group")
    # Distances from the whole profile, which are small, keep the digits that squares of the profiles would lose.
    away = lambda v: F.log1p(target * (F.col("t") - v) / (F.col("s") - F.col("depth"))) - F.log1p(target * F.col("t") / F.col("s"))
    lacking = totals.join(depths, "group").withColumn("x", away(F.lit(0.0)))
    lacking = lacking.groupBy("group", "gene").agg(F.sum(m * F.col("x")).alias("a"), F.sum(m * F.col("x") * F.col("x")).alias("aa"))
    x, y = away(F.col("value")), away(F.lit(0.0))
    stored = entries.join(totals, ["group", "gene"]).groupBy("group", "gene", "n").agg(F.sum(m * (x - y)).alias("b"), F.sum(m * (x * x - y * y)).alias("bb"))
    both = stored.join(lacking, ["group", "gene"]).withColumn("total", F.col("a") + F.col("b"))
    spread = F.col("aa") + F.col("bb") - F.col("total") * F.col("total") / F.col("n")
    per = both.groupBy("group").agg(F.sum((F.col("n") - 1) / F.col("n") * spread).alias("v"))
    return whole.join(per, "group", "left").select("group", F.coalesce("v", F.lit(0.0)).alias("variance"))
