"""From effects to expected compositions and counts, and what a group of cells looks like."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.generate import MAX_BLOCK, seed_of
from tesserae.operators.joins import neighbour_ceiling

# The scale of bulk profiles, the bound of effects, and the amplitude of effects in either space.
BULK_SCALE = 50_000.0
CLIP = 3.0
AMPLITUDE = {"log2fc": 0.6, "bulk_delta": 0.3}


def expected_composition(rows: DataFrame, space: str, amplitude: float | None = None, clip: float = CLIP) -> DataFrame:
    """target, gene, share from target, gene, control (a share), effect: the bounded effect on the control, shares summing to one a target.

    log2fc multiplies by a power of two; bulk_delta adds to log1p of the scaled profile, not below zero. A target whose shares cannot be
    normalised raises an error.
    """
    moved = moved_share(F.col("control"), F.col("effect"), space, amplitude, clip)
    return shares(rows.withColumn("raw", moved), "raw").select("target", "gene", "share")


def moved_share(control: Column, effect: Column, space: str, amplitude: float | None = None, clip: float = CLIP) -> Column:
    if space not in AMPLITUDE:
        raise ValueError(f"unknown space {space}")
    e = F.greatest(F.lit(-clip), F.least(F.lit(clip), effect * (AMPLITUDE[space] if amplitude is None else amplitude)))
    return control * F.pow(F.lit(2.0), e) if space == "log2fc" else F.expm1(F.greatest(F.log1p(control * BULK_SCALE) + e, F.lit(0.0)))


def expected_moments(rows: DataFrame, shrink: DataFrame | None = None, neighbours: DataFrame | None = None) -> DataFrame:
    """target, gene, cpm_share, bulk_share: the two compositions that a target's counts must meet, from one pass over its effects.

    rows: target, gene, cpm_control, cpm_effect, bulk_control, bulk_effect. shrink: target, factor, which multiplies a target's effects before
    amplitude and bound; a target without one keeps its effects. neighbours: target, gene, distance; genes next to a target's promoter keep at
    most their ceiling in either space, and shares sum to one again.
    """
    r = rows
    if shrink is not None:
        r = r.join(shrink.select("target", "factor"), "target", "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    factor = F.col("factor") if shrink is not None else F.lit(1.0)
    if neighbours is not None:
        near = neighbours.filter("target != gene").groupBy("target", "gene").agg(F.min("distance").alias("distance"))
        r = r.join(near, ["target", "gene"], "left")
    spaces = (("cpm", "log2fc"), ("bulk", "bulk_delta"))
    raw = {f"{n}_raw": moved_share(F.col(f"{n}_control"), factor * F.col(f"{n}_effect"), space) for n, space in spaces}
    r = r.withColumns(raw)
    by = Window.partitionBy("target")

    def normal(column: str) -> Column:
        total = F.sum(column).over(by)
        return F.col(column) / F.when(total > 0, total).otherwise(F.raise_error(F.lit("a composition without mass")).cast("double"))

    r = r.withColumns({f"{n}_share": normal(f"{n}_raw") for n, _ in spaces})
    if neighbours is not None:
        ceiling = lambda n: F.when(F.col("distance").isNotNull(), neighbour_ceiling(F.col(f"{n}_control"), F.col("distance")))
        r = r.withColumns({f"{n}_raw": F.least(f"{n}_share", ceiling(n)) for n, _ in spaces})
        r = r.withColumns({f"{n}_share": normal(f"{n}_raw") for n, _ in spaces})
    return r.select("target", "gene", "cpm_share", "bulk_share")


def shares(rows: DataFrame, value: str) -> DataFrame:
    """Adds share: the value over its sum within the target, which must be above zero."""
    total = F.sum(value).over(Window.partitionBy("target"))
    checked = F.when(total > 0, total).otherwise(F.raise_error(F.lit("a composition without mass")).cast("double"))
    return rows.withColumn("share", F.col(value) / checked)


def capped(composition: DataFrame, control: DataFrame, neighbours: DataFrame) -> DataFrame:
    """target, gene, share, lowered: genes next to a target's promoter keep at most their ceiling; then shares sum to one again.

    control: gene, control; neighbours: target, gene, distance. Nothing is ever raised by the ceiling itself.
    """
    near = neighbours.filter("target != gene").groupBy("target", "gene").agg(F.min("distance").alias("distance"))
    rows = composition.join(control, "gene").join(near, ["target", "gene"], "left")
    ceiling = F.when(F.col("distance").isNotNull(), neighbour_ceiling(F.col("control"), F.col("distance")))
    rows = rows.withColumns({"lowered": F.coalesce(F.col("share") > ceiling, F.lit(False)), "kept": F.least("share", ceiling)})
    return shares(rows, "kept").select("target", "gene", "share", "lowered")


def bulk_to_delta(rows: DataFrame) -> DataFrame:
    """Adds delta: the change of log1p of the scaled profile that a log2 fold change makes of a control share."""
    base = F.col("control") * BULK_SCALE
    return rows.withColumn("delta", F.log1p(base * F.pow(F.lit(2.0), F.col("effect"))) - F.log1p(base))


def effect_ratio(target: Column, control: Column) -> Column:
    """How much of the control remains: 1 where the control is zero."""
    return F.when(control > 1e-300, target / control).otherwise(1.0)


def dispersion(cells: DataFrame, composition: DataFrame) -> DataFrame:
    """group, gene, phi: the extra-Poisson dispersion by moments around depth * share, not below zero.

    cells: group, cell, depth, gene, value, zeros not stored; composition: group, gene, share. A cell without the gene contributes its expected
    count only, so sums over depths and stored values are enough.
    """
    depth = cells.select("group", "cell", "depth").distinct()
    sums = depth.groupBy("group").agg(F.sum("depth").alias("d"), F.sum(F.col("depth") * F.col("depth")).alias("dd"))
    x = cells.groupBy("group", "gene").agg(F.sum(F.col("value") * F.col("value")).alias("xx"), F.sum(F.col("value") * F.col("depth")).alias("xd"))
    c, both = F.col("share"), composition.join(sums, "group").join(x, ["group", "gene"], "left").na.fill(0.0, ["xx", "xd"])
    off = F.col("xx") - 2 * c * F.col("xd") + c * c * F.col("dd")
    mu = c * F.col("d")
    phi = F.when(c * c * F.col("dd") > 0, (off - mu) / (c * c * F.col("dd"))).otherwise(0.0)
    return both.select("group", "gene", F.greatest(phi, F.lit(0.0)).alias("phi"))


def cell_structure(cells: DataFrame, target: float = 1e4) -> DataFrame:
    """group, gene, gene_mean, gene_var, log_var, zero_fraction over all cells of the group, zeros that are not stored included.

    cells: group, cell, depth, gene, value. log_var is the variance of log1p of counts per `target`; zero_fraction is the group's over all its
    cells and the genes it has.
    """
    n = cells.select("group", "cell").distinct().groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    v = F.col("value").cast("double")
    log = F.log1p(v * target / F.col("depth"))
    sums = cells.filter("value > 0").groupBy("group", "gene").agg(
        F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.sum(log).alias("l"), F.sum(log * log).alias("ll"), F.count(F.lit(1)).alias("k")
    )
    x = sums.join(n, "group")
    var = lambda s, ss: F.when(F.col("n") > 1, (F.col(ss) - F.col(s) * F.col(s) / F.col("n")) / (F.col("n") - 1))
    own = Window.partitionBy("group")
    zero = 1 - F.sum("k").over(own) / (F.count(F.lit(1)).over(own) * F.col("n"))
    return x.select("group", "gene", (F.col("s") / F.col("n")).alias("gene_mean"), var("s", "ss").alias("gene_var"), var("l", "ll").alias("log_var"), zero.alias("zero_fraction"))


def diversity(effects: DataFrame) -> DataFrame:
    """context, effect_norm, deviation_norm (medians over perturbations), cosine and deviation_cosine (means over pairs), variance_share.

    effects: context, perturbation, gene, delta on a whole grid. The mean over all pairs of unit rows comes from the norm of their
    sum, so no pair is formed.
    """
    d = effects.withColumn("dev", F.col("delta") - F.avg("delta").over(Window.partitionBy("context", "gene")))
    row = Window.partitionBy("context", "perturbation")
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)).over(row))
    d = d.withColumns({"dn": norm("delta"), "en": norm("dev")})
    unit = lambda c, n: F.col(c) / F.greatest(F.col(n), F.lit(1e-12))
    by_gene = d.groupBy("context", "gene").agg(
        F.sum(unit("delta", "dn")).alias("u"), F.sum(unit("dev", "en")).alias("w"), F.sum(unit("delta", "dn") * unit("delta", "dn")).alias("uu"),
        F.sum(unit("dev", "en") * unit("dev", "en")).alias("ww"), F.sum(F.col("dev") * F.col("dev")).alias("b"), F.sum(F.col("delta") * F.col("delta")).alias("t"),
        F.count(F.lit(1)).alias("n"),
    )
    n = F.first("n")
    pairs = lambda s, own: (F.sum(F.col(s) * F.col(s)) - F.sum(own)) / (n * (n - 1))
    whole = by_gene.groupBy("context").agg(
        pairs("u", "uu").alias("cosine"), pairs("w", "ww").alias("deviation_cosine"), (F.sum("b") / F.greatest(F.sum("t"), F.lit(1e-12))).alias("variance_share")
    )
    rows = d.select("context", "perturbation", "dn", "en").distinct().groupBy("context").agg(
        F.expr("percentile(dn, 0.5)").alias("effect_norm"), F.expr("percentile(en, 0.5)").alias("deviation_norm")
    )
    return rows.join(whole, "context")


def matched_source(stats: DataFrame, reference: str) -> DataFrame:
    """source, reliability_gap, cells_gap, matched: how far each source's medians are from the reference's; the closest one, by reliability
    and then cells and name, is matched. stats: source, reliability, cells."""
    medians = stats.groupBy("source").agg(F.expr("percentile(reliability, 0.5)").alias("r"), F.expr("percentile(cells, 0.5)").alias("c"))
    ref = medians.filter(F.col("source") == reference).select(F.col("r").alias("rr"), F.col("c").alias("rc"))
    gaps = medians.filter(F.col("source") != reference).crossJoin(F.broadcast(ref))  # one row
    gaps = gaps.select("source", F.abs(F.col("r") - F.col("rr")).alias("reliability_gap"), F.abs(F.col("c") - F.col("rc")).alias("cells_gap"))
    order = Window.orderBy("reliability_gap", "cells_gap", "source")  # one row a source
    return gaps.withColumn("matched", F.row_number().over(order) == 1)


# How near the ends of what depths allow a bulk share may lie, how far it may be moved (L1), and what either moment may miss.
MARGIN, MOST_MOVED, MOST_MISSED = 0.01, 0.03, 1e-3


def nearest_reachable(bulk: np.ndarray, share: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The multiple of `bulk`, cut to what relative depths z allow each gene with that share, that sums to one.

    The sum is piecewise linear in the factor, with a corner where a gene leaves its least or meets its greatest share; its corners are
    sorted and the factor is read between two of them.
    """
    low, high = ((e + MARGIN * (1 - e)) * share for e in (z.min(), z.max()))
    on = bulk > 0
    at = np.concatenate((low[on] / bulk[on], high[on] / bulk[on]))
    order = np.argsort(at, kind="stable")
    slope = np.cumsum(np.concatenate((bulk[on], -bulk[on]))[order])
    total = low.sum() + np.concatenate(([0.0], np.cumsum(slope[:-1] * np.diff(at[order]))))
    if not len(total) or total[-1] < 1 - 1e-9:
        raise ValueError("no multiple of the bulk composition is within what depths allow")
    return np.clip(bulk * np.interp(1.0, np.maximum.accumulate(total), at[order]), low, high)


def fit_two_moments(base: np.ndarray, share: np.ndarray, bulk: np.ndarray, depth: np.ndarray, steps: int = 200, tolerance: float = 1e-7) -> np.ndarray:
    """Cell compositions near `base` whose plain mean is `share` and whose depth-weighted mean is `bulk`.

    Every gene carries a factor exp(a + b * z), z the relative depth; a Newton step for each gene moves both of its sums to what is wanted,
    rows are scaled back to one, and this repeats. A bulk composition that depths do not allow is moved to the nearest that they do; one
    that would move by more than MOST_MOVED, and moments that are missed by more than MOST_MISSED, are errors, as are compositions
    that do not sum to one, negative or missing values and cells without mass. Equal depths allow the plain mean only.
    """
    for v in (base, share, bulk, depth):
        if not np.isfinite(v).all() or (v < 0).any():
            raise ValueError("compositions and depths must be finite and not negative")
    if (depth < 1).any() or (base.sum(axis=1) <= 0).any():
        raise ValueError("cells must have depth and mass")
    if max(abs(share.sum() - 1), abs(bulk.sum() - 1)) > 1e-8:
        raise ValueError("compositions must sum to one")
    n, z = len(base), depth / depth.mean()
    reach = nearest_reachable(bulk, share, z) if np.ptp(depth) else share
    moved = float(np.abs(reach - bulk).sum())
    if moved > MOST_MOVED:
        raise ValueError(f"depths do not allow the bulk composition: the nearest is {moved:.3g} away")
    x = base / base.sum(axis=1, keepdims=True)
    x = 0.999 * x + 0.001 * share
    first, second = n * share, n * reach
    for _ in range(steps):
        s0, s1, s2 = x.sum(axis=0), z @ x, (z * z) @ x
        det = s0 * s2 - s1 * s1
        e0, e1 = first - s0, second - s1
        whole = det > 1e-9 * np.maximum(s0 * s2, 1e-300)
        safe = np.where(whole, det, 1.0)
        b = np.where(whole, (s0 * e1 - s1 * e0) / safe, 0.0)
        a = np.where(whole, (s2 * e0 - s1 * e1) / safe, e0 / np.maximum(s0, 1e-300))
        x *= np.exp(np.clip(a + b * z[:, None], -2.0, 2.0))
        x /= np.maximum(x.sum(axis=1, keepdims=True), 1e-30)
        missed = max(np.abs(x.mean(axis=0) - share).sum(), np.abs(z @ x / n - reach).sum())
        if missed < tolerance:
            break
    if missed > MOST_MISSED:
        raise ValueError(f"moments are missed by {missed:.3g}")
    return x


def whole_counts(expected: np.ndarray, depth: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Integers near `expected` with every row's sum its depth and every column's sum its rounded expectation.

    Rows are rounded down and filled at random by their fractions; then single counts move within rows from columns with too many to columns
    with too few, each in the row where that changes the distance from the expectation least. Expectations whose total is not that of the
    depths are refused.
    """
    if not np.isfinite(expected).all() or (expected < 0).any() or abs(expected.sum() - depth.sum()) > 0.5 or (np.abs(expected.sum(axis=1) - depth) > 0.5).any():
        raise ValueError("expected counts and depths differ")
    out = np.floor(expected).astype(np.int64)
    left = depth - out.sum(axis=1)
    part = expected - out
    for i, k in enumerate(left.tolist()):
        if k > 0:
            take = np.argsort(-(part[i] - rng.random(part.shape[1]) * 0.5), kind="stable")
            out[i] += np.bincount(take[np.arange(k) % len(take)], minlength=part.shape[1])
    columns = expected.sum(axis=0)
    goal = np.floor(columns).astype(np.int64)
    up = np.argsort(goal - columns, kind="stable")[: int(depth.sum() - goal.sum())]
    goal[up] += 1
    gap = out.sum(axis=0) - goal
    while (gap > 0).any():
        g, h = int(gap.argmax()), int(gap.argmin())
        gain = np.where(out[:, g] > 0, (out[:, g] - expected[:, g]) - (out[:, h] - expected[:, h]), -np.inf)
        k = min(int(gap[g]), int(-gap[h]), int((out[:, g] > 0).sum()))
        rows = np.argsort(-gain, kind="stable")[:k]
        out[rows, g] -= 1
        out[rows, h] += 1
        gap[g] -= k
        gap[h] += k
    return out


def dual_moment_counts(template: DataFrame, seed: int) -> DataFrame:
    """target, cell, gene, value: whole counts with exact depths whose plain and depth-weighted mean compositions are those wanted.

    template: target, block, cell, depth, genes ARRAY, base ARRAY (starting composition), share ARRAY, bulk ARRAY. A block is a bounded
    number of cells of one target; every block meets the moments by itself, or the job fails and says by how much.
    """

    def emit(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > MAX_BLOCK:
            raise ValueError(f"a block of {len(g)} cells; at most {MAX_BLOCK} are made together")
        g = g.sort_values("cell")
        depth, share, bulk = g["depth"].to_numpy(dtype=np.int64), *(np.asarray(g[c].iloc[0], dtype=float) for c in ("share", "bulk"))
        x = fit_two_moments(np.array(g["base"].tolist(), dtype=float), share, bulk, depth)
        rng = np.random.default_rng(seed_of(seed, g["target"].iloc[0], g["block"].iloc[0]))
        counts = whole_counts(x * depth[:, None], depth, rng)
        row, col = np.nonzero(counts)
        genes = np.asarray(g["genes"].iloc[0], dtype=object)
        return pd.DataFrame({"target": g["target"].iloc[0], "cell": g["cell"].to_numpy()[row], "gene": genes[col], "value": counts[row, col]})

    return template.groupBy("target", "block").applyInPandas(emit, "target string, cell long, gene string, value long")


def transported_cells(donors: DataFrame, ratios: DataFrame, seed: int) -> DataFrame:
    """cell, gene, value: donor cells carried to a target without drawing them anew: genes with a ratio below one are thinned, genes above
    one get Poisson counts on top, also in cells that had none.

    donors: cell, depth, genes ARRAY, counts ARRAY; ratios: one row of arrays ratio and control over the same genes. A row is one cell.
    """

    def carry(batches):
        for b in batches:
            out = []
            for cell, depth, genes, counts, ratio, control in b[["cell", "depth", "genes", "counts", "ratio", "control"]].itertuples(index=False):
                rng, x, r = np.random.default_rng(seed_of(seed, cell)), np.asarray(counts, dtype=np.int64), np.asarray(ratio, dtype=float)
                y = rng.binomial(x, np.minimum(r, 1.0)) + rng.poisson(depth * np.maximum(r - 1, 0) * np.asarray(control, dtype=float))
                at = np.flatnonzero(y)
                out.append(pd.DataFrame({"cell": cell, "gene": np.asarray(genes, dtype=object)[at], "value": y[at]}))
            if out:
                yield pd.concat(out)

    return donors.crossJoin(F.broadcast(ratios)).mapInPandas(carry, "cell long, gene string, value long")
