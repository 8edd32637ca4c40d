"""Queries of expected compositions, counts that meet two moments, and the structure of groups of cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import r6
from tesserae.operators import aggregate as A
from tesserae.operators import composition as P
from tesserae.plans.base_sql import CELLS, RESP
from tesserae.sources.tables import CONTROL, cells, expression, responses

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def labelled(spark, sf_dir):
    """cell, context, perturbation, depth, gene, value."""
    depth = A.normalise(expression(spark, sf_dir)).select("cell", "gene", "value", "depth")
    return depth.join(cells(spark, sf_dir), "cell")


def effects(spark, sf_dir):
    """target, gene, control, effect: twenty times the log2 change of a label's share against the control label's."""
    total = labelled(spark, sf_dir).groupBy("perturbation", "gene").agg(F.sum("value").alias("s"))
    share = total.withColumn("share", F.col("s") / F.sum("s").over(Window.partitionBy("perturbation")))
    control = share.filter(F.col("perturbation") == CONTROL).select("gene", F.col("share").alias("control"))
    rows = share.filter(F.col("perturbation") != CONTROL).join(control, "gene")
    return rows.select(F.col("perturbation").alias("target"), "gene", "control", (F.log2(F.col("share") / F.col("control")) * 20).alias("effect"))


EFFECTS = CELLS + f""", tot AS (SELECT perturbation, gene, sum(value) AS s FROM expr JOIN cells USING (cell) GROUP BY ALL), sh AS (SELECT perturbation, gene, s / sum(s) OVER (PARTITION BY perturbation) AS share FROM tot),
ct AS (SELECT gene, share AS control FROM sh WHERE perturbation = '{CONTROL}'), ef AS (SELECT perturbation AS target, gene, control, log2(share / control) * 20 AS effect FROM sh JOIN ct USING (gene) WHERE perturbation <> '{CONTROL}'),
ra AS (SELECT *, control * pow(2, greatest(-3, least(3, 0.6 * effect))) AS raw, exp(greatest(ln(1 + 50000 * control) + greatest(-3, least(3, 0.3 * effect)), 0)) - 1 AS raw_b FROM ef),
ex AS (SELECT target, gene, raw / sum(raw) OVER (PARTITION BY target) AS share, raw_b / sum(raw_b) OVER (PARTITION BY target) AS share_b FROM ra)"""


@query(f"""WITH {EFFECTS} SELECT target, gene, round(share, 9) AS cpm_share, round(share_b, 9) AS bulk_share FROM ex""")
def expected_composition(spark, sf_dir):
    e = both_spaces(effects(spark, sf_dir))
    return P.expected_moments(e).select("target", "gene", *[F.round(c, 9).alias(c) for c in ("cpm_share", "bulk_share")])


def both_spaces(e):
    return e.select("target", "gene", *[F.col(c).alias(f"{n}_{c}") for n in ("cpm", "bulk") for c in ("control", "effect")])


@query(f"""WITH {EFFECTS}, f AS (SELECT *, CASE WHEN target = 'BUILDING' THEN 1.0 ELSE length(target) / 20.0 END AS f FROM ef),
m AS (SELECT target, gene, control, control * pow(2, greatest(-3, least(3, 0.6 * f * effect))) AS a, exp(greatest(ln(1 + 50000 * control) + greatest(-3, least(3, 0.3 * f * effect)), 0)) - 1 AS b,
  abs(replace(gene, 'Brand#', '')::INT * 700 - length(target) * 1000) AS d FROM f),
n AS (SELECT *, a / sum(a) OVER (PARTITION BY target) AS sa, b / sum(b) OVER (PARTITION BY target) AS sb, CASE WHEN d <= 5000 THEN control * (0.15 + 0.85 * least(1, greatest(0, log10(greatest(d, 500) / 500.0)))) END AS c FROM m)
SELECT target, gene, round(coalesce(least(sa, c), sa) / sum(coalesce(least(sa, c), sa)) OVER (PARTITION BY target), 9) AS cpm_share, round(coalesce(least(sb, c), sb) / sum(coalesce(least(sb, c), sb)) OVER (PARTITION BY target), 9) AS bulk_share FROM n""")
def expected_moments(spark, sf_dir):
    """Both compositions with effects shrunk by a factor for each target but one, and neighbours' ceilings."""
    e = effects(spark, sf_dir)
    distance = F.abs(F.replace("gene", F.lit("Brand#"), F.lit("")).cast("int") * 700 - F.length("target") * 1000)
    near = e.select("target", "gene", distance.alias("distance")).filter("distance <= 5000")
    factors = e.select("target").distinct().filter("target <> 'BUILDING'").select("target", (F.length("target") / 20.0).alias("factor"))
    return P.expected_moments(both_spaces(e), factors, near).select("target", "gene", *[F.round(c, 9).alias(c) for c in ("cpm_share", "bulk_share")])


@query(f"""WITH {EFFECTS}, d AS (SELECT target, gene, abs(replace(gene, 'Brand#', '')::INT * 700 - length(target) * 1000) AS distance FROM ex),
k AS (SELECT target, gene, share, CASE WHEN distance <= 5000 THEN control * (0.15 + 0.85 * least(1, greatest(0, log10(greatest(distance, 500) / 500.0)))) END AS ceiling FROM ex JOIN d USING (target, gene) JOIN ct USING (gene))
SELECT target, gene, round(coalesce(least(share, ceiling), share) / sum(coalesce(least(share, ceiling), share)) OVER (PARTITION BY target), 9) AS share, coalesce(share > ceiling, false) AS lowered FROM k""")
def capped_composition(spark, sf_dir):
    """Genes lie 700 apart by brand number, targets at a thousand times the length of their name."""
    e = effects(spark, sf_dir)
    distance = F.abs(F.replace("gene", F.lit("Brand#"), F.lit("")).cast("int") * 700 - F.length("target") * 1000)
    near = e.select("target", "gene", distance.alias("distance")).filter("distance <= 5000")
    out = P.capped(P.expected_composition(e, "log2fc"), e.select("gene", "control").distinct(), near)
    return out.withColumn("share", F.round("share", 9))


@query(f"""WITH {CELLS}, l AS (SELECT context AS grp, cell, gene, value FROM expr JOIN cells USING (cell)), d AS (SELECT grp, cell, sum(value) AS depth FROM l GROUP BY ALL),
s AS (SELECT grp, gene, sum(value) / sum(sum(value)) OVER (PARTITION BY grp) AS share FROM l GROUP BY grp, gene),
x AS (SELECT s.grp, s.gene, coalesce(value, 0) AS value, depth * share AS mu FROM s JOIN d USING (grp) LEFT JOIN l ON l.cell = d.cell AND l.gene = s.gene)
SELECT grp AS "group", gene, round(greatest(0, (sum((value - mu) * (value - mu)) - sum(mu)) / sum(mu * mu)), 6) AS phi FROM x GROUP BY ALL""")
def dispersion_fit(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumnRenamed("context", "group")
    total = rows.groupBy("group", "gene").agg(F.sum("value").alias("s"))
    share = total.select("group", "gene", (F.col("s") / F.sum("s").over(Window.partitionBy("group"))).alias("share"))
    return P.dispersion(rows, share).withColumn("phi", r6("phi"))


@query(f"""WITH {CELLS}, l AS (SELECT context AS grp, cell, gene, value FROM expr JOIN cells USING (cell)), d AS (SELECT grp, cell, sum(value) AS depth FROM l GROUP BY ALL), g AS (SELECT DISTINCT grp, gene FROM l),
x AS (SELECT g.grp, g.gene, coalesce(value, 0)::DOUBLE AS v, ln(1 + 1e4 * coalesce(value, 0) / depth) AS lg FROM g JOIN d USING (grp) LEFT JOIN l ON l.cell = d.cell AND l.gene = g.gene),
z AS (SELECT grp, avg((v = 0)::INT) AS zf FROM x GROUP BY 1)
SELECT grp AS "group", gene, round(avg(v), 6) AS gene_mean, round(var_samp(v), 6) AS gene_var, round(var_samp(lg), 6) AS log_var, round(any_value(zf), 6) AS zero_fraction FROM x JOIN z USING (grp) GROUP BY ALL""")
def cell_structure(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumnRenamed("context", "group")
    return P.cell_structure(rows).select("group", "gene", *[r6(c).alias(c) for c in ("gene_mean", "gene_var", "log_var", "zero_fraction")])


@query(f"""WITH {RESP}, v AS (SELECT context, perturbation, gene, delta - 25 AS x, delta - avg(delta) OVER (PARTITION BY context, gene) AS e FROM resp),
n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY context, perturbation)) AS xn, sqrt(sum(e * e) OVER (PARTITION BY context, perturbation)) AS en FROM v),
m AS (SELECT context, quantile_cont(xn, 0.5) AS effect_norm, quantile_cont(en, 0.5) AS deviation_norm FROM (SELECT DISTINCT context, perturbation, xn, en FROM n) GROUP BY 1),
p AS (SELECT a.context, a.perturbation AS p, b.perturbation AS q, sum(a.x / a.xn * b.x / b.xn) AS c, sum(a.e / a.en * b.e / b.en) AS d FROM n a JOIN n b ON a.context = b.context AND a.gene = b.gene AND a.perturbation <> b.perturbation GROUP BY ALL),
s AS (SELECT context, sum(e * e) / sum(x * x) AS variance_share FROM v GROUP BY 1)
SELECT context, round(effect_norm, 6) AS effect_norm, round(deviation_norm, 6) AS deviation_norm, round(avg(c), 6) AS cosine, round(avg(d), 6) AS deviation_cosine, round(variance_share, 6) AS variance_share
FROM p JOIN m USING (context) JOIN s USING (context) GROUP BY context, effect_norm, deviation_norm, variance_share""")
def context_diversity(spark, sf_dir):
    out = P.diversity(responses(spark, sf_dir).withColumn("delta", F.col("delta") - 25))
    return out.select("context", *[r6(c).alias(c) for c in ("effect_norm", "deviation_norm", "cosine", "deviation_cosine", "variance_share")])


@query(f"""WITH {RESP}, m AS (SELECT context, quantile_cont(delta, 0.5) AS r, quantile_cont(n_cells, 0.5) AS c FROM resp GROUP BY 1),
g AS (SELECT m.context AS source, abs(m.r - k.r) AS a, abs(m.c - k.c) AS b FROM m, m k WHERE k.context = 'ASIA' AND m.context <> 'ASIA')
SELECT source, round(a, 6) AS reliability_gap, round(b, 6) AS cells_gap, row_number() OVER (ORDER BY a, b, source) = 1 AS matched FROM g""")
def matched_source(spark, sf_dir):
    """Mean responses stand for reliabilities."""
    s = responses(spark, sf_dir).select(F.col("context").alias("source"), F.col("delta").alias("reliability"), F.col("n_cells").alias("cells"))
    return P.matched_source(s, "ASIA").withColumns({"reliability_gap": r6("reliability_gap"), "cells_gap": r6("cells_gap")})


BLOCK_CELLS = 128  # cells that meet their moments together


@query()
def dual_moment_counts(spark, sf_dir):
    """Counts for each context's control cells from its mean and its bulk composition; tested for exact depths and both moments."""
    rows = labelled(spark, sf_dir).filter(F.col("perturbation") == CONTROL)
    axis = Window.partitionBy("target")
    both = rows.groupBy(F.col("context").alias("target"), "gene").agg(F.sum(F.col("value") / F.col("depth")).alias("m"), F.sum("value").alias("b"))
    both = both.withColumns({"m": F.col("m") / F.sum("m").over(axis), "b": F.col("b") / F.sum("b").over(axis)})
    arrays = both.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("gene", "m", "b"))).alias("p"))  # an axis of genes
    arrays = arrays.select("target", F.col("p.gene").alias("genes"), F.col("p.m").alias("share"), F.col("p.b").alias("bulk"))
    own = rows.groupBy(F.col("context").alias("target"), "cell", F.round("depth").cast("long").alias("depth")).agg(F.map_from_entries(F.collect_list(F.struct("gene", "value"))).alias("v"))
    number = own.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CELLS).alias("blocks"))
    wide = own.join(arrays, "target").join(number, "target")
    base = F.transform("genes", lambda g: F.coalesce(F.col("v")[g], F.lit(0.0)))
    block = F.pmod(F.xxhash64("cell"), F.col("blocks"))
    return P.dual_moment_counts(wide.select("target", block.alias("block"), "cell", "depth", "genes", base.alias("base"), "share", "bulk"), 53)
