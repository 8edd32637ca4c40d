"""Queries of the residual and confidence models: regions are contexts, brands perturbations, types pathways of a few genes each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.scalars import pearson, r6
from tesserae.operators import residual as N
from tesserae.operators.lineage import cut
from tesserae.plans.base_sql import OBS
from tesserae.sources.tables import observations, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def fine(spark, sf_dir):
    """Observations whose genes are a part's type and a remainder of the line's number."""
    obs = observations(spark, sf_dir)
    return obs.withColumn("gene", F.concat_ws(" ", "gene", (F.col("cell") % 2).cast("string")))


def pathway(gene):
    return F.split(gene, " ")[0]


def source_statistics(spark, sf_dir):
    """What the operators need of each context's own cells: halves, statistics, pair correlations, similarities, basal profiles."""
    obs, keys = fine(spark, sf_dir), ["context", "perturbation", "gene"]
    ret = F.col("flag") == "R"
    both = obs.groupBy(*keys).agg(
        F.avg("value").alias("delta"), F.count(F.lit(1)).alias("n_cells"), F.sum(F.col("price") / 1000).alias("price"), F.avg(F.when(ret, F.col("value"))).alias("h1"), F.avg(F.when(~ret, F.col("value"))).alias("h2")
    ).withColumns({"h1": F.coalesce("h1", "delta") - 25, "h2": F.coalesce("h2", "delta") - 25, "y": F.col("delta") - 25})
    both = cut(both)  # one value a context, perturbation and gene; all that follows reads it
    y = both.select(*keys, "y")
    stats = both.groupBy("context", "perturbation").agg(
        pearson(F.col("h1"), F.col("h2")).alias("reliability"), F.sum("n_cells").cast("double").alias("cells"), F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("magnitude")
    )
    mean_price = F.sum("price") / F.sum("n_cells")
    basal_own = both.groupBy("context", "perturbation").agg(mean_price.alias("gene_basal"))
    a, b = (y.select(F.col("context").alias(n), "perturbation", "gene", F.col("y").alias(f"y_{n}")) for n in "ab")
    pairs = a.join(b, ["perturbation", "gene"]).filter("a < b").groupBy("a", "b", "perturbation").agg(pearson(F.col("y_a"), F.col("y_b")).alias("corr"))
    basal = both.groupBy("context", pathway(F.col("gene")).alias("pathway")).agg(mean_price.alias("basal"))
    t, s = (basal.select(F.col("context").alias(n), "pathway", F.col("basal").alias(f"basal_{n}")) for n in ("target", "source"))
    sims = t.join(s, "pathway").filter("target != source").groupBy("target", "source").agg(pearson(F.col("basal_target"), F.col("basal_source")).alias("sim"))
    return {"y": y, "halves": both.select(*keys, "h1", "h2"), "stats": stats.join(basal_own, ["context", "perturbation"]), "pairs": pairs, "similarity": sims, "basal": basal}


def contexts(spark, sf_dir):
    return [r.r_name for r in table(spark, sf_dir, "region").select("r_name").distinct().orderBy("r_name").collect()]  # an axis of a few labels


def design(spark, sf_dir, nested=True, clean=False):
    s = source_statistics(spark, sf_dir)
    y = s["y"].withColumn("pathway", pathway(F.col("gene")))
    size = y.groupBy("pathway").agg(F.countDistinct("gene").alias("size"))
    inside = F.length("pathway") % 5 == F.right("perturbation", F.lit(1)).cast("int") % 5
    members = y.select("perturbation", "pathway").distinct().join(size, "pathway").select("perturbation", "pathway", inside.cast("int").alias("inside"), "size")
    mean = y.groupBy("context", "perturbation", "pathway").agg(F.avg("y").alias("y"))
    fold = N.fold_table(spark, contexts(spark, sf_dir), nested)
    return N.design(fold, mean, s["stats"], s["pairs"], s["similarity"], s["basal"], members, clean)


def sql_corr(x: str, y: str) -> str:
    return f"""CASE WHEN sqrt(greatest(sum(({x}) * ({x})) - sum({x}) * sum({x}) / count(*), 0)) * sqrt(greatest(sum(({y}) * ({y})) - sum({y}) * sum({y}) / count(*), 0)) > 1e-9
THEN (sum(({x}) * ({y})) - sum({x}) * sum({y}) / count(*)) / (sqrt(greatest(sum(({x}) * ({x})) - sum({x}) * sum({x}) / count(*), 0)) * sqrt(greatest(sum(({y}) * ({y})) - sum({y}) * sum({y}) / count(*), 0))) END"""


BASE = OBS + f""", fo AS (SELECT * REPLACE (gene || ' ' || (cell % 2) AS gene) FROM obs), g AS (SELECT context, perturbation, gene, avg(value) - 25 AS y, count(*) AS n, coalesce(avg(value) FILTER (WHERE flag = 'R'), avg(value)) - 25 AS h1,
  coalesce(avg(value) FILTER (WHERE flag <> 'R'), avg(value)) - 25 AS h2 FROM fo GROUP BY ALL), own AS (SELECT context, perturbation, avg(price / 1000) AS gene_basal FROM fo GROUP BY ALL),
st AS (SELECT context, perturbation, {sql_corr('h1', 'h2')} AS reliability, sum(n)::DOUBLE AS cells, sqrt(sum(y * y)) AS magnitude FROM g GROUP BY ALL),
pc AS (SELECT p.context AS a, q.context AS b, perturbation, {sql_corr('p.y', 'q.y')} AS corr FROM g p JOIN g q USING (perturbation, gene) WHERE p.context < q.context GROUP BY ALL),
bp AS (SELECT context, split_part(gene, ' ', 1) AS pathway, avg(price / 1000) AS basal FROM fo GROUP BY ALL),
sm AS (SELECT t.context AS target, s.context AS source, {sql_corr('t.basal', 's.basal')} AS sim FROM bp t JOIN bp s USING (pathway) WHERE t.context <> s.context GROUP BY ALL),
cx AS (SELECT DISTINCT context AS target FROM g),
ss AS (SELECT target, perturbation, avg(reliability) AS reliability, avg(cells) AS cells, min(cells) AS cells_min, avg(magnitude) AS magnitude, stddev_pop(magnitude) AS magnitude_sd FROM cx JOIN st ON context <> target GROUP BY ALL),
ag AS (SELECT target, perturbation, avg(corr) AS agree, min(corr) AS lo FROM cx JOIN pc ON a <> target AND b <> target GROUP BY ALL)"""


@query(f"""WITH {BASE}, py AS (SELECT context, perturbation, split_part(gene, ' ', 1) AS pathway, avg(y) AS y, count(*) AS size FROM g GROUP BY ALL),
w AS (SELECT target, source, greatest(coalesce(sim, 0), 0) / sum(greatest(coalesce(sim, 0), 0)) OVER (PARTITION BY target) AS w FROM sm),
a AS (SELECT target, perturbation, pathway, avg(y) AS a, stddev_pop(y) AS sd, max(y) - min(y) AS rng, avg(abs(y)) AS mag, sum(w * y) AS wa FROM w JOIN py ON context = source GROUP BY ALL),
c AS (SELECT *, a - avg(a) OVER (PARTITION BY target, pathway) AS ac, wa - avg(wa) OVER (PARTITION BY target, pathway) AS wac, avg(a) OVER (PARTITION BY target, pathway) AS t FROM a),
i AS (SELECT target, source, x.perturbation, x.pathway, x.y, avg(z.y) AS rest FROM w JOIN py x ON x.context = source JOIN py z ON z.perturbation = x.perturbation AND z.pathway = x.pathway AND z.context <> source AND z.context <> target GROUP BY ALL),
k AS (SELECT *, y - avg(y) OVER (PARTITION BY target, source, pathway) AS yc, rest - avg(rest) OVER (PARTITION BY target, source, pathway) AS rc FROM i),
sc AS (SELECT target, sum(yc * rc) / sum(rc * rc) AS scale FROM k GROUP BY 1),
bd AS (SELECT t.context AS target, t.pathway, t.basal AS atv, t.basal - avg(s.basal) AS dev FROM bp t JOIN bp s ON s.pathway = t.pathway AND s.context <> t.context GROUP BY t.context, t.pathway, t.basal),
sz AS (SELECT pathway, max(size) AS size FROM py GROUP BY 1)
SELECT c.target, c.perturbation, c.pathway, round(a, 6) AS source_mean, round(ac, 6) AS source_mean_centred, round(sd, 6) AS source_sd, round(rng, 6) AS source_range, round(abs(a) / (mag + 1e-12), 6) AS source_sign_agreement,
  round(wa, 6) AS weighted_source, round(wac, 6) AS weighted_source_centred, round(wac - ac, 6) AS weighted_minus_mean, round(coalesce(agree, 0), 6) AS source_agreement, round(coalesce(reliability, 0), 6) AS source_reliability,
  round(cells, 6) AS source_cells, round(magnitude, 6) AS source_magnitude, round(gene_basal, 6) AS target_gene_basal, round(dev, 6) AS basal_pathway_deviation, round(atv, 6) AS target_basal_pathway,
  (length(c.pathway) % 5 = right(c.perturbation, 1)::INT % 5)::INT::DOUBLE AS gene_in_pathway, size::DOUBLE AS pathway_size, round(t + scale * ac, 6) AS baseline
FROM c JOIN sc USING (target) JOIN bd USING (target, pathway) JOIN sz USING (pathway) JOIN ss USING (target, perturbation) LEFT JOIN ag USING (target, perturbation) JOIN own ON own.context = c.target AND own.perturbation = c.perturbation""")
def residual_features(spark, sf_dir):
    rows = design(spark, sf_dir, nested=False)
    x = [r6(F.col("x")[i]).alias(name) for i, name in enumerate(N.FEATURES)]
    return rows.select("target", "perturbation", "pathway", *x, r6("b").alias("baseline"))


@query()
def nested_selection(spark, sf_dir):
    """Every model of the grid by outer region, with its score; tested against dense brute force."""
    return N.nested_selection(cut(design(spark, sf_dir))).withColumn("score", r6("score"))


@query()
def outer_prediction(spark, sf_dir):
    """Predictions for each region by the model that its sources chose; tested against dense brute force."""
    out = N.outer_prediction(cut(design(spark, sf_dir)))
    return out.select("outer", "perturbation", "pathway", *[r6(c).alias(c) for c in ("b", "r_hat", "predicted")])


@query()
def clean_gamma_prediction(spark, sf_dir):
    """The same with the interaction itself, free of the shared part, as what models are fitted to."""
    out = N.outer_prediction(cut(design(spark, sf_dir, clean=True)))
    return out.select("outer", "perturbation", "pathway", *[r6(c).alias(c) for c in ("b", "r_hat", "predicted", "lambda_theory", "predicted_theory")])


@query(f"""WITH {BASE}, a AS (SELECT target, perturbation, gene, avg(y) AS a, stddev_pop(y) AS sd, avg(abs(y)) AS mag, avg(h1) AS h1, avg(h2) AS h2 FROM cx JOIN g ON context <> target GROUP BY ALL),
p AS (SELECT target, perturbation, sqrt(sum(a * a)) AS nrm, sqrt(sum(sd * sd)) AS sdn, sum(abs(a)) / (sum(mag) + 1e-12) AS sc, sum(h1 * h2) AS e FROM a GROUP BY ALL), bs AS (SELECT target, avg(sim) AS sim FROM sm GROUP BY 1)
SELECT p.target, p.perturbation, round(coalesce(agree, 0), 6) AS source_agreement, round(coalesce(lo, 0), 6) AS source_min_agreement, round(sdn / (nrm + 1e-12), 6) AS source_sd_ratio, round(sc, 6) AS source_sign_consistency,
  round(coalesce(reliability, 0), 6) AS source_reliability, round(cells, 6) AS source_cells_mean, cells_min AS source_cells_min, round(nrm, 6) AS source_magnitude, round(e, 4) AS source_reliable_energy,
  round(magnitude_sd, 6) AS source_magnitude_spread, round(gene_basal, 6) AS target_gene_basal, round(coalesce(sim, 0), 6) AS basal_similarity_mean
FROM p JOIN ss USING (target, perturbation) LEFT JOIN ag USING (target, perturbation) JOIN own ON own.context = p.target AND own.perturbation = p.perturbation LEFT JOIN bs USING (target)""")
def confidence_features(spark, sf_dir):
    s = source_statistics(spark, sf_dir)
    x = N.confidence(N.fold_table(spark, contexts(spark, sf_dir), False), s["y"], s["halves"], s["stats"], s["pairs"], s["similarity"])
    digits = {"source_reliable_energy": 4}
    return x.select("target", "perturbation", *[F.round(c, digits.get(c, 6)).alias(c) for c in N.CONFIDENCE])
