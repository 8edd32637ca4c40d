"""Panels whose targets have unlike support, scored together, and discrimination without a row for every pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import cosine, draw_key, pearson, ratio
from tesserae.operators.neighbours import unit_rows

HELD_BYTES = 2**23  # bytes of the vectors of a block
TOGETHER = 256  # predictions whose distances to a block are held at once
ASKING = 2**20  # own distances that meet a block together, where vectors share predictions
TIERS = (2, 1, 0)  # fixed values: how many sources support a target


def discrimination(predicted: DataFrame, truth: DataFrame, group: list[str], match: str = "id", digits: int = 9, block: int | None = None) -> DataFrame:
    """group..., id, score: 1 - (closer + half of the other ties) / (n - 1), over the n true vectors of the group by cosine distance.

    predicted: group..., id, vec and the column `match`, the id of the true vector that each is for; truth: group..., id, vec. A
    vector meets its own match by a join; blocks of both sides then count in memory how many others are closer or as close
    (distances rounded to `digits`), and the counts add up. Vectors without length have cosine 0. One true vector gives null.
    A block has as many vectors as HELD_BYTES hold, unless `block` says. Each side is copied once for each block of the other, so
    that few predictions copy the truth seldom.
    """
    keys = [F.col(g).alias(g) for g in group]  # columns of its own for each side
    size = truth.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    most = truth.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).agg(F.max("n"), F.max("width")).first()
    asked = predicted.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    block = block or max(1, HELD_BYTES // (8 * max(most[1] or 1, 1)))
    true_parts, parts = max(1, -(-(most[0] or 0) // block)), max(1, -(-asked // block))

    def unit(vec: str):
        norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, v: s + v * v))
        return F.transform(vec, lambda v: F.when(norm > 0, v / norm).otherwise(0.0))

    p = predicted.select(*keys, F.col("id"), F.col(match).alias("own_id"), unit("vec").alias("u"))
    t = truth.select(*keys, F.col("id").alias("true_id"), unit("vec").alias("v"))
    dot = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    own = p.join(t.withColumnRenamed("true_id", "own_id"), [*group, "own_id"]).withColumn("own", F.round(1 - dot, digits)).drop("v")
    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.withColumn("pp", hashed("id", parts)).withColumn("tp", each(true_parts))
    right = t.withColumn("tp", hashed("true_id", true_parts)).withColumn("pp", each(parts))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*group, "id").schema)

    def count(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q):
            return q[[*group, "id"]].assign(closer=[], tied=[])
        closer, tied = np.zeros(len(q)), np.zeros(len(q))
        if len(r):
            y, names = np.array(r["v"].tolist()), r["true_id"].to_numpy()
            for a in range(0, len(q), TOGETHER):
                part = q.iloc[a : a + TOGETHER]
                d = np.round(1 - np.array(part["u"].tolist()) @ y.T, digits)
                mine, others = part["own"].to_numpy()[:, None], names[None, :] != part["own_id"].to_numpy()[:, None]
                closer[a : a + TOGETHER] = ((d < mine) & others).sum(axis=1)
                tied[a : a + TOGETHER] = ((d == mine) & others).sum(axis=1)
        return q[[*group, "id"]].assign(closer=closer, tied=tied)

    cells = [*group, "pp", "tp"]
    counts = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInPandas(count, f"{kinds}, closer double, tied double")
    sums = counts.groupBy(*group, "id").agg((F.sum("closer") + F.sum("tied") / 2).alias("k"))
    joined = sums.join(size, group) if group else sums.crossJoin(F.broadcast(size))
    return joined.select(*group, "id", F.when(F.col("n") > 1, 1 - F.col("k") / (F.col("n") - 1)).alias("score"))


def shared_discrimination(predicted: DataFrame, truth: DataFrame, by: str, digits: int = 9, block: int | None = None, asking: int = ASKING) -> DataFrame:
    """id, score of every true vector: `discrimination` without groups, where all vectors of one `by` have the same prediction.

    predicted: `by`, vec, one row a value, read three times; truth: id, `by`, vec. A vector meets its prediction by a join, which
    gives its own distance. Blocks of predictions and of the truth then meet. A task sorts the distances between a prediction and its block
    once and looks up the own distances of those that share it, about `asking` at most; the counts add up. So distances are computed
    for each prediction and true vector, not for each two vectors.
    """
    kind = truth.schema["id"].dataType.simpleString()
    known = predicted.select(F.col(by).alias("by"), "vec").filter("by is not null")
    true = truth.select("id", F.col(by).alias("by"), "vec")
    n, width = true.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    block = block or max(1, HELD_BYTES // (8 * max(width or 1, 1)))
    parts, true_parts, turns = (max(1, -(-rows // most)) for rows, most in ((known.count(), block), (n, block), (n, asking)))
    hashed = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            own = np.round(1 - np.einsum("ij,ij->i", unit_rows(t["vec"]), unit_rows(t["mean"])), digits)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("by"), pa.array(own)], ["id", "by", "own"])

    means = known.withColumnRenamed("vec", "mean")
    met = true.join(F.broadcast(means) if parts == 1 else means, "by").select("id", "by", "vec", "mean")  # one part has a block's bytes
    own = met.mapInArrow(measure, f"id {kind}, by {true.schema['by'].dataType.simpleString()}, own double")
    asked = own.withColumns({"pp": hashed("by", parts), "turn": hashed("id", turns)}).withColumn("tp", each(true_parts))
    left = known.select(F.lit(None).cast(kind).alias("id"), "by", "vec", F.lit(False).alias("true"), hashed("by", parts).alias("pp")).withColumn("tp", each(true_parts))
    right = true.select("id", F.lit(None).cast(true.schema["by"].dataType).alias("by"), "vec", F.lit(True).alias("true"), each(parts).alias("pp")).withColumn("tp", hashed("id", true_parts))
    vectors = left.unionByName(right).withColumn("turn", each(turns))

    def count(a: pa.Table, v: pa.Table) -> pa.Table:
        a = a.sort_by("by")
        ids, keys, own = (a[c].to_numpy() for c in ("id", "by", "own"))
        closer, tied = np.zeros(len(ids)), np.zeros(len(ids))
        mask = v["true"].to_numpy()
        rows, them = v.filter(pa.array(mask)), v.filter(pa.array(~mask))
        if len(ids) and len(rows):
            names, y = rows["id"].to_numpy(), unit_rows(rows["vec"])
            order = np.argsort(names, kind="stable")
            at = order[np.minimum(np.searchsorted(names, ids, sorter=order), len(names) - 1)]
            here = names[at] == ids  # its own vector is in the block
            for key, u in zip(them["by"].to_numpy(), unit_rows(them["vec"]), strict=True):
                some = slice(np.searchsorted(keys, key), np.searchsorted(keys, key, "right"))
                if some.start < some.stop:
                    d = np.round(1 - y @ u, digits)
                    mine, itself, held = own[some], d[at[some]], np.sort(d)
                    below, upto = np.searchsorted(held, mine), np.searchsorted(held, mine, "right")
                    closer[some] = below - (here[some] & (itself < mine))
                    tied[some] = upto - below - (here[some] & (itself == mine))
        return pa.table({"id": a["id"], "k": closer + tied / 2})

    cells = ["pp", "tp", "turn"]
    counts = asked.groupBy(*cells).cogroup(vectors.groupBy(*cells)).applyInArrow(count, f"id {kind}, k double")
    return counts.groupBy("id").agg(F.sum("k").alias("k")).select("id", F.when(F.lit(n) > 1, 1 - F.col("k") / F.lit(max(n - 1, 1))).alias("score"))


def tier_rows(responses: DataFrame, weights: DataFrame) -> DataFrame:
    """target, tier, perturbation, gene, truth, predicted: each context predicted from the others in each tier of support.

    The pooled main effect of the sources, plus the tier's weight times the own effect that its first sources by name share: two,
    one or none. weights: target, tier, weight. The target's responses are the truth only.
    """
    by = Window.partitionBy("context", "gene")
    parts = responses.withColumn("m", F.avg("delta").over(by)).withColumn("e", F.col("delta") - F.col("m"))
    contexts = responses.select(F.col("context").alias("target")).distinct()  # an axis
    pairs = contexts.crossJoin(contexts.withColumnRenamed("target", "context")).filter("target <> context")
    ranked = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("target").orderBy("context")))
    seen = parts.join(F.broadcast(ranked), "context")
    mean = lambda c: F.avg(F.when(c, F.col("e")))
    one = seen.groupBy("target", "perturbation", "gene").agg(
        F.avg("m").alias("main"), mean(F.col("nth") <= 2).alias("b2"), mean(F.col("nth") == 1).alias("b1")
    )
    truth = responses.select(F.col("context").alias("target"), "perturbation", "gene", F.col("delta").alias("truth"))
    both = one.join(truth, ["target", "perturbation", "gene"])
    beta = F.when(F.col("tier") == 2, F.col("b2")).when(F.col("tier") == 1, F.col("b1")).otherwise(0.0)
    wide = both.withColumn("tier", F.explode(F.array(*map(F.lit, TIERS)))).join(F.broadcast(weights), ["target", "tier"], "left")
    predicted = F.col("main") + F.when(F.col("tier") == 0, 0.0).otherwise(F.coalesce("weight", F.lit(0.0))) * beta
    return wide.select("target", "tier", "perturbation", "gene", "truth", predicted.alias("predicted"))


def mixed_panel(responses: DataFrame, weights: DataFrame, shares: dict[int, float], draws: int, seed: int, exclude: tuple[str, ...] = ()) -> DataFrame:
    """target, draw, n_tier2, n_tier1, n_tier0, pearson_median, cosine_median, mse_mean, energy_explained, pds_mean.

    Each draw gives every perturbation a tier with the given shares, and the panel of mixed predictions is scored as one. A
    prediction is ranked among true responses, so what it scores depends on its tier alone: each tier's predictions are scored once
    and draws, keyed hashes, pick scores. Genes in `exclude` do not count for discrimination.
    """
    rows = tier_rows(responses, weights)
    t, p = F.col("truth"), F.col("predicted")
    cell = ["target", "tier", "perturbation"]
    off = (t - p) * (t - p)
    metric = rows.groupBy(*cell).agg(
        pearson(p, t, 1e-12).alias("pearson"), cosine(p, t).alias("cosine"), F.avg(off).alias("mse"), F.sum(off).alias("residual"), F.sum(t * t).alias("energy")
    )
    kept = rows.filter(~F.col("gene").isin(*exclude)) if exclude else rows
    packed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("gene", c))), lambda s: s[c]).alias("vec")
    vectors = kept.groupBy(*cell).agg(packed("predicted")).select("target", F.concat_ws(":", "tier", "perturbation").alias("id"), F.col("perturbation").alias("own"), "vec")
    true = kept.filter("tier = 0").groupBy("target", F.col("perturbation").alias("id")).agg(packed("truth"))
    score = discrimination(vectors, true, ["target"], "own").select(
        "target", F.substring_index("id", ":", 1).cast("int").alias("tier"), F.expr("substring(id, instr(id, ':') + 1)").alias("perturbation"), F.col("score").alias("pds")
    )
    scored = metric.join(score, cell)
    names = responses.select("perturbation").distinct()
    drawn = names.crossJoin(F.broadcast(names.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))))
    u = F.conv(F.substring(draw_key(seed, F.col("draw").cast("string"), F.col("perturbation")), 1, 8), 16, 10).cast("double") / 2.0**32
    tier = F.when(u < shares.get(2, 0.0), 2).when(u < shares.get(2, 0.0) + shares.get(1, 0.0), 1).otherwise(0)
    panel = drawn.withColumn("tier", tier).join(scored, ["perturbation", "tier"])
    keys = ["target", "draw"]
    means = panel.groupBy(*keys).agg(
        *[F.count_if(F.col("tier") == i).alias(f"n_tier{i}") for i in TIERS], F.avg("mse").alias("mse_mean"),
        (1 - ratio(F.sum("residual"), F.sum("energy"))).alias("energy_explained"), F.avg("pds").alias("pds_mean"),
        *[F.expr(f"percentile({c}, 0.5)").alias(f"{c}_median") for c in ("pearson", "cosine")],  # one value a perturbation
    )
    return means.select(*keys, "n_tier2", "n_tier1", "n_tier0", "pearson_median", "cosine_median", "mse_mean", "energy_explained", "pds_mean")
