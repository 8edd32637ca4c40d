"""Replicate anchors: one random half of every group of cells scored as a prediction of the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import ratio
from tesserae.operators.aggregate import bulk_profile
from tesserae.operators.calibration import expression_error
from tesserae.operators.generate import jackknife_counts
from tesserae.operators.lineage import cut
from tesserae.operators.panels import discrimination
from tesserae.operators.resample import halves
from tesserae.operators.stats import adjust, normal_tails, rank_sums

# Mean counts per million above which control cells have a gene tested, significance, purity of a prefix, least gate.
MIN_CPM, P_ADJUSTED, PURITY, GATE, FLOOR = 5.0, 0.05, 0.9, 10, 1e-9


def tested_genes(entries: DataFrame, control: str) -> DataFrame:
    """half, gene: what the control cells of each half express enough of. entries: half, target, gene, depth, value, m, starts."""
    own = entries.filter(F.col("target") == control)
    n = own.groupBy("half").agg(F.sum("starts").alias("n"))
    cpm = own.groupBy("half", "gene").agg(F.sum(F.col("m") * (1e6 * F.col("value") / F.col("depth"))).alias("s"))
    return cpm.join(n, "half").filter(F.col("s") / F.col("n") > MIN_CPM).select("half", "gene")


def tested_table(entries: DataFrame, half: int, control: str, genes: DataFrame) -> DataFrame:
    """target, gene, p, p_adj, lfc: a half's groups against its own control by rank sums of counts per million, over the given genes."""
    mine = entries.filter(F.col("half") == half)
    own = mine.select("target", "gene", F.round(1e6 * F.col("value") / F.col("depth"), 6).alias("value"), "m")
    is_control = F.col("target") == control
    sizes = mine.groupBy("target").agg(F.sum("starts").alias("n1"))
    n0 = sizes.filter(is_control).select(F.col("n1").alias("n0"))
    targets = sizes.filter(~is_control)
    kept = own.join(F.broadcast(genes), "gene")  # an axis of genes
    z = rank_sums(kept.filter(~is_control), kept.filter(is_control).drop("target"), targets, n0, genes, "m")
    p = F.when(F.col("z") > 0, normal_tails("z")).otherwise(1.0)
    sums = kept.groupBy("target", "gene").agg(F.sum(F.col("m") * F.col("value")).alias("s"))
    base = sums.filter(is_control).crossJoin(F.broadcast(n0)).select("gene", (F.col("s") / F.col("n0")).alias("m0"))
    out = adjust(z.withColumn("p", F.coalesce(p, F.lit(1.0))), ["target"]).join(targets, "target").join(sums, ["target", "gene"], "left").join(base, "gene", "left")
    mean = F.coalesce("s", F.lit(0.0)) / F.col("n1")
    return out.select("target", "gene", "p", "p_adj", F.log2((mean + FLOOR) / (F.coalesce("m0", F.lit(0.0)) + FLOOR)).alias("lfc"))


def tested_members(predicted: DataFrame, real: DataFrame) -> DataFrame:
    """target, fidelity, reach, jaccard, nmae, n_pred, n_real, k: what each target's tests score; its own gene does not count."""
    p = predicted.select("target", "gene", F.col("p").alias("pp"), F.col("p_adj").alias("pa"), F.col("lfc").alias("pl"), (F.col("p_adj") < P_ADJUSTED).alias("ps"))
    r = real.select("target", "gene", F.col("lfc").alias("rl"), (F.col("p_adj") < P_ADJUSTED).alias("rs"))
    both = p.join(r, ["target", "gene"]).filter("target <> gene").withColumn("known", F.col("rl") != 0)
    same = F.signum("pl") == F.signum("rl")
    hit = F.col("ps") & F.col("known")
    rank = Window.partitionBy("target").orderBy(~F.col("ps"), "pa", "pp", F.desc(F.abs("pl")), "gene")
    pool = both.filter("rs and known").withColumns({"nth": F.row_number().over(rank), "pure": F.avg(same.cast("double")).over(rank.rowsBetween(Window.unboundedPreceding, 0))})
    deep = pool.groupBy("target").agg(F.max(F.when(F.col("pure") >= PURITY, F.col("nth")).otherwise(0)).alias("deep"))
    n_pred, n_real, k = F.count_if(hit), F.count_if("rs"), F.count_if(hit & same)
    union = F.count_if(F.col("ps") | F.col("rs"))
    error = ratio(F.sum(F.when(F.col("rs"), F.abs(F.col("pl") - F.col("rl")))), F.sum(F.when(F.col("rs"), F.abs("rl"))))
    per = both.groupBy("target").agg(
        F.when(F.greatest(n_pred, n_real) > 0, k / F.greatest(n_pred, n_real)).alias("fidelity"), F.when(union == 0, 1.0).otherwise(F.count_if(F.col("ps") & F.col("rs")) / union).alias("jaccard"),
        F.when(n_real >= GATE, error).alias("nmae"), n_pred.alias("n_pred"), n_real.alias("n_real"), k.alias("k"),
    )
    reach = F.when(F.col("n_real") > 0, F.coalesce("deep", F.lit(0)) / F.col("n_real"))
    return per.join(deep, "target", "left").select("target", "fidelity", reach.alias("reach"), "jaccard", "nmae", "n_pred", "n_real", "k")


def replicate_anchor(cells: DataFrame, values: DataFrame, control: str, seed: int, exclude: tuple[str, ...] = ()) -> DataFrame:
    """One row: pds, expression_error, fidelity, reach, jaccard, nmae, predicted_median, real_median, precision, yield_median.

    cells: cell, target; values: cell, gene, value > 0. Each group of cells, the control too, is cut at random in two; the first half
    plays the prediction, the second the truth, each against the control of its own half. The half is one more level of every
    grouping, so profiles, their jackknife and depths come from one pass; genes that the second half's control has tested
    are tested in both. Genes in `exclude` do not count for discrimination, a target's own gene not for its tests and error.
    All of these need a value and its cell's depth, not the cell, so the pass leaves how often each such entry is there, and how many
    cells have their first entry among these.
    """
    own = Window.partitionBy("cell").orderBy(F.desc("value"))
    depth = F.sum("value").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    there = values.withColumns({"depth": depth, "nth": F.row_number().over(own)}).filter("value > 0")
    parts = halves(cells.select("cell", "target"), ["target"], seed, drop_odd=False)
    entries = there.join(parts, "cell").groupBy("half", "target", "gene", "depth", "value")
    entries = cut(entries.agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("nth") == 1).alias("starts")))  # all that follows reads it
    genes = cut(tested_genes(entries, control).filter("half = 1").select("gene"))
    tests = tested_members(*[cut(tested_table(entries, half, control, genes)) for half in (0, 1)])

    totals = cut(entries.groupBy("half", "target", "gene").agg(F.sum(F.col("m") * F.col("value")).alias("total")))
    grid = totals.select("half", "target").distinct().crossJoin(totals.select("gene").distinct())  # axes
    profile = bulk_profile(grid.join(totals, ["half", "target", "gene"], "left").na.fill(0.0, ["total"]), ["half", "target"])
    one = lambda half, of_control, name: profile.filter((F.col("half") == half) & ((F.col("target") == control) == F.lit(of_control))).select("target", "gene", F.col("bulk").alias(name))
    wide = cut(one(0, False, "p").join(one(1, False, "r"), ["target", "gene"]).join(one(1, True, "c").drop("target"), "gene"))
    grouped = entries.withColumn("group", F.concat_ws(":", "half", "target"))
    depths = grouped.filter("starts > 0").groupBy("group", "depth").agg(F.sum("starts").alias("m"))
    spread = cut(jackknife_counts(depths, grouped.select("group", "gene", "depth", "value", "m")))  # a row a group
    half, target = F.substring("group", 1, 1), F.expr("substring(group, 3)")
    spread = spread.select(half.alias("half"), target.alias("target"), "variance")
    cp, cr = (spread.filter((F.col("half") == h) & (F.col("target") != control)).select("target", F.col("variance").alias(n)) for h, n in (("0", "cp"), ("1", "cr")))
    noise = spread.filter((F.col("half") == "1") & (F.col("target") == control)).first()  # one number
    owned = wide.withColumn("own", F.col("target"))
    error = expression_error(owned, cp.join(cr, "target"), F.lit(noise.variance if noise else 0.0)).select(F.col("error").alias("expression_error"))

    kept = wide.filter(~F.col("gene").isin(*exclude)) if exclude else wide
    packed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("gene", (F.col(c) - F.col("c")).alias("d")))), lambda s: s["d"]).alias("vec")
    vectors = [kept.groupBy(F.col("target").alias("id")).agg(packed(c)) for c in "pr"]
    pds = discrimination(vectors[0], vectors[1], []).agg(F.avg("score").alias("pds"))
    share = F.when(F.col("n_real") > 0, F.least(F.lit(1.0), F.col("n_pred") / F.col("n_real"))).when(F.col("n_pred") > 0, 1.0)
    middle = lambda c: F.percentile(c, F.lit(0.5))  # one value a target
    summary = tests.agg(
        *[F.avg(c).alias(c) for c in ("fidelity", "reach", "jaccard", "nmae")], middle(F.col("n_pred")).alias("predicted_median"), middle(F.col("n_real")).alias("real_median"),
        (F.sum("k") / F.greatest(F.sum("n_pred"), F.lit(1))).alias("precision"), middle(share).alias("yield_median"),
    )
    return pds.crossJoin(error).crossJoin(summary)  # one row each
