"""Queries of unseen perturbations, support tiers, null representations, analytic tests and resampling by counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.scalars import r6
from tesserae.operators import aggregate as A
from tesserae.operators import models as M
from tesserae.operators import nulls as N
from tesserae.operators import panels as P
from tesserae.operators import replicates as E
from tesserae.operators import resample as R
from tesserae.operators import stats as T
from tesserae.operators import structure as V
from tesserae.operators import tiers as S
from tesserae.operators import unseen as U
from tesserae.operators.lineage import cut
from tesserae.plans.base_sql import CELLS, RESP
from tesserae.sources.tables import CONTROL, cells, expression, responses, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FOLDS = RESP + """, fo AS (SELECT perturbation, ntile(5) OVER (ORDER BY md5('61:' || perturbation), perturbation) - 1 AS own FROM (SELECT DISTINCT perturbation FROM resp)),
ta AS (SELECT 'P1' AS regime, NULL::VARCHAR AS target UNION ALL SELECT 'P2', context FROM (SELECT DISTINCT context FROM resp)),
sp AS (SELECT regime, target, k.fold, perturbation, CASE WHEN own = k.fold THEN 'test' ELSE 'train' END AS part FROM fo, range(5) k(fold), ta)"""


def splits(spark, sf_dir):
    r = responses(spark, sf_dir)
    return U.two_axis_splits(r.select("context").distinct(), r.select("perturbation").distinct(), 5, 61)


@query(f"WITH {FOLDS} SELECT regime, target, fold, perturbation, part FROM sp")
def two_axis_splits(spark, sf_dir):
    return U.refuse_leaks(splits(spark, sf_dir)).withColumn("fold", F.col("fold").cast("bigint"))


def brand_features(spark, sf_dir):
    """Mean size and price of a brand's parts stand for what is known of a perturbation."""
    part = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("perturbation"))
    return part.agg(F.array(F.avg("p_size") / 5, F.avg("p_retailprice") / 100).alias("features"))


@query(f"""WITH {FOLDS}, fe AS (SELECT p_brand AS perturbation, avg(p_size) / 5 AS f, avg(p_retailprice) / 100 AS g FROM part GROUP BY 1),
m AS (SELECT regime, target, perturbation, gene, avg(delta) AS m FROM resp, ta WHERE target IS NULL OR context <> target GROUP BY ALL),
x AS (SELECT sp.regime, sp.target, sp.fold, sp.part, perturbation, gene, m, f, g FROM m JOIN sp USING (regime, perturbation) JOIN fe USING (perturbation) WHERE sp.target IS NOT DISTINCT FROM m.target),
s AS (SELECT regime, target, fold, gene, avg(f) AS mf, avg(g) AS mg, var_pop(f) * count(*) + 0.5 AS ff, var_pop(g) * count(*) + 0.5 AS gg, covar_pop(f, g) * count(*) AS fg,
  covar_pop(f, m) * count(*) AS fm, covar_pop(g, m) * count(*) AS gm FROM x WHERE part = 'train' GROUP BY ALL)
SELECT x.regime, x.target, x.fold, perturbation, x.gene, round(((f - mf) * (gg * fm - fg * gm) + (g - mg) * (ff * gm - fg * fm)) / (ff * gg - fg * fg), 6) AS predicted
FROM x JOIN s ON x.regime = s.regime AND x.target IS NOT DISTINCT FROM s.target AND x.fold = s.fold AND x.gene = s.gene WHERE part = 'test'""")
def unseen_ridge(spark, sf_dir):
    p = U.predict_unseen(responses(spark, sf_dir), brand_features(spark, sf_dir), splits(spark, sf_dir), "ridge", 0.5)
    return p.withColumns({"fold": F.col("fold").cast("bigint"), "predicted": r6("predicted")})


@query()
def unseen_evaluation(spark, sf_dir):
    """Predictions of the two most similar brands, evaluated where they were held out; tested against dense arithmetic."""
    r = responses(spark, sf_dir)
    p = U.predict_unseen(r, brand_features(spark, sf_dir), splits(spark, sf_dir), "knn", k=2)
    return U.evaluate_unseen(p, r)


TIERS = RESP + """, mm AS (SELECT context, gene, avg(delta) AS m FROM resp GROUP BY ALL), e AS (SELECT context, perturbation, gene, delta, m, delta - m AS e FROM resp JOIN mm USING (context, gene)),
c AS (SELECT DISTINCT context FROM resp), th AS (SELECT t.context AS target, h.context AS held FROM c t, c h WHERE t.context <> h.context),
i AS (SELECT target, held, context AS src FROM th, c WHERE context NOT IN (target, held)),
sb AS (SELECT target, held, 1 AS tier, src AS a, src AS b FROM i UNION ALL SELECT x.target, x.held, 2, x.src, y.src FROM i x JOIN i y ON x.target = y.target AND x.held = y.held AND x.src < y.src),
mh AS (SELECT target, held, gene, avg(m) AS mh FROM i JOIN mm ON context = src GROUP BY ALL),
er AS (SELECT sb.target, sb.held, tier, sb.a, sb.b, w, avg(pow(tr.delta - mh - w * (x.e + y.e) / 2, 2)) AS err FROM sb JOIN mh ON sb.target = mh.target AND sb.held = mh.held
  JOIN e tr ON tr.context = sb.held AND tr.gene = mh.gene JOIN e x ON x.context = sb.a AND x.gene = mh.gene AND x.perturbation = tr.perturbation
  JOIN e y ON y.context = sb.b AND y.gene = mh.gene AND y.perturbation = tr.perturbation, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) g(w) GROUP BY ALL),
su AS (SELECT target, held, tier, w, avg(err) AS err FROM er GROUP BY ALL), al AS (SELECT target, tier, w AS weight, avg(err) AS error FROM su GROUP BY ALL),
ch AS (SELECT target, tier, weight FROM al QUALIFY row_number() OVER (PARTITION BY target, tier ORDER BY round(error, 12), weight) = 1)"""


@query(f"""WITH {TIERS} SELECT target, tier, weight, round(error, 6) AS error, row_number() OVER (PARTITION BY target, tier ORDER BY round(error, 12), weight) = 1 AS chosen FROM al""")
def tier_shrinkage(spark, sf_dir):
    return S.tier_shrinkage(responses(spark, sf_dir)).withColumn("error", r6("error"))


@query(f"""WITH {TIERS}, mn AS (SELECT gene, avg(m) AS mh FROM mm WHERE context <> 'ASIA' GROUP BY 1), br AS (SELECT DISTINCT perturbation, CASE WHEN perturbation < 'Brand#15' THEN 2 WHEN perturbation < 'Brand#2' THEN 1 ELSE 0 END AS tier FROM resp),
bt AS (SELECT perturbation, gene, avg(e) AS beta FROM e JOIN br USING (perturbation) WHERE (tier = 2 AND context IN ('AFRICA', 'EUROPE')) OR (tier = 1 AND context = 'EUROPE') GROUP BY ALL)
SELECT perturbation, gene, round(mh + coalesce(weight * beta, 0), 6) AS predicted FROM br CROSS JOIN mn LEFT JOIN bt USING (perturbation, gene) LEFT JOIN ch ON ch.target = 'ASIA' AND ch.tier = br.tier""")
def tier_prediction(spark, sf_dir):
    """ASIA from what others show: two sources for the first brands, one for some, none for the rest."""
    r = responses(spark, sf_dir)
    brand = r.select("perturbation").distinct()
    tier = F.when(F.col("perturbation") < "Brand#15", 2).when(F.col("perturbation") < "Brand#2", 1).otherwise(0)
    sources = F.when(F.col("tier") == 2, F.array(F.lit("AFRICA"), F.lit("EUROPE"))).when(F.col("tier") == 1, F.array(F.lit("EUROPE")))
    support = brand.withColumn("tier", tier).select("perturbation", "tier", F.explode_outer(sources).alias("source"))
    chosen = S.tier_shrinkage(r).filter("chosen AND target = 'ASIA'").select("tier", "weight")
    return S.tier_prediction(r, "ASIA", ["AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST"], support, chosen).withColumn("predicted", r6("predicted"))


NULL_DRAWS = 12
# Part types that share a letter stand for gene sets.
WORDS = """ge AS (SELECT DISTINCT gene FROM resp), se AS (SELECT DISTINCT s, gene FROM (SELECT unnest(string_split(gene, '')) AS s, gene FROM ge)), sz AS (SELECT s, count(DISTINCT gene) AS k FROM se GROUP BY 1),
nm AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS component FROM sz)"""
NULLS = RESP + f""", {WORDS}, dr AS (SELECT d::INT AS draw FROM range({NULL_DRAWS}) t(d)), pl AS (SELECT gene, row_number() OVER (ORDER BY gene) AS i FROM ge),
pk AS (SELECT draw, gene, row_number() OVER (PARTITION BY draw ORDER BY md5('71:' || draw || ':' || gene), gene) AS i FROM ge, dr),
pw AS (SELECT DISTINCT 'permuted' AS kind, draw, s, pk.gene FROM se JOIN pl USING (gene) JOIN pk USING (i)),
rw AS (SELECT 'resampled' AS kind, draw, s, gene FROM (SELECT draw, s, k, gene, row_number() OVER (PARTITION BY draw, s ORDER BY md5('71:' || draw || ':' || s || ':' || gene), gene) AS i FROM ge, dr, sz) WHERE i <= k),
h AS (SELECT draw, s, gene, md5('71:' || draw || ':' || component || ':' || gene) AS h FROM ge, dr, nm),
nw AS (SELECT draw, s, gene, sqrt(-2 * ln((('0x' || h[1:8])::BIGINT + 0.5) / 4294967296)) * cos(2 * pi() * (('0x' || h[9:16])::BIGINT + 0.5) / 4294967296) AS w FROM h),
ww AS (SELECT kind, draw, s, gene, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind, draw, s) AS w FROM (SELECT * FROM pw UNION ALL SELECT * FROM rw
    UNION ALL SELECT DISTINCT kind, -1, s, gene FROM se, (VALUES ('permuted'), ('resampled'), ('projected')) k(kind))
  UNION ALL SELECT 'projected', draw, s, gene, w / sqrt(sum(w * w) OVER (PARTITION BY draw, s)) FROM nw),
y AS (SELECT kind, draw, context, perturbation, s, sum(w * delta) AS v FROM ww JOIN resp USING (gene) GROUP BY ALL),
t AS (SELECT *, v - avg(v) OVER (PARTITION BY kind, draw, s, context) - avg(v) OVER (PARTITION BY kind, draw, s, perturbation) + avg(v) OVER (PARTITION BY kind, draw, s) AS g FROM y),
l AS (SELECT kind, draw, s, perturbation, max(CASE WHEN context = 'ASIA' THEN g END) AS g, max(CASE WHEN context = 'EUROPE' THEN v END) - avg(CASE WHEN context <> 'ASIA' THEN v END) AS d FROM t GROUP BY ALL),
c AS (SELECT *, d - avg(d) OVER (PARTITION BY kind, draw, s) AS e FROM l), r AS (SELECT kind, draw, perturbation, corr(g, e) AS r FROM c GROUP BY ALL),
z AS (SELECT kind, draw, avg(r) AS v FROM r GROUP BY ALL), o AS (SELECT kind, v AS o FROM z WHERE draw < 0)"""


@query(f"""WITH {NULLS} SELECT kind, round(any_value(o), 6) AS observed, round(avg(v), 6) AS null_mean, round(stddev_samp(v), 6) AS null_sd, round(100.0 * count(*) FILTER (WHERE v < o) / count(*), 6) AS percentile,
round((count(*) FILTER (WHERE v >= o) + 1) / (count(*) + 1), 6) AS p_value, round((any_value(o) - avg(v)) / stddev_samp(v), 5) AS z, count(*) AS n_null FROM z JOIN o USING (kind) WHERE draw >= 0 GROUP BY kind""")
def projection_null(spark, sf_dir):
    """Recoverability of ASIA's interaction from EUROPE in the space of letter sets, among permuted, resampled and projected ones."""
    r = responses(spark, sf_dir)
    sets = r.select("gene").distinct().select(F.explode(F.regexp_extract_all("gene", F.lit("(.)"))).alias("set"), "gene")
    out = None
    for kind in N.KINDS:
        drawn = N.recovered(N.project_nulls(r, sets, kind, NULL_DRAWS, 71), "ASIA", "EUROPE")
        one = N.among_nulls(drawn, "recoverability").withColumn("kind", F.lit(kind))
        out = one if out is None else out.union(one)
    return out.select("kind", *[r6(c).alias(c) for c in ("observed", "null_mean", "null_sd", "percentile", "p_value")], F.round("z", 5).alias("z"), "n_null")


def ideal_inputs(spark, sf_dir):
    """Control cells with depths, mean compositions of the other labels as predictions, and the genes that are tested."""
    lab, values = cells(spark, sf_dir), expression(spark, sf_dir)
    depth = A.cell_profile(lab, values).filter("depth > 0").select("cell", "perturbation", "depth")
    rows = values.join(depth, "cell")
    control = F.col("perturbation") == CONTROL
    n = depth.filter(~control).groupBy("perturbation").agg(F.count(F.lit(1)).alias("n"))
    share = rows.filter(~control).groupBy("perturbation", "gene").agg(F.sum(F.col("value") / F.col("depth")).alias("s")).join(n, "perturbation")
    predicted = share.select(F.col("perturbation").alias("target"), "gene", (F.col("s") / F.col("n")).alias("p"))
    return rows.filter(control).select("cell", "gene", "value"), depth.filter(control).select("cell", "depth"), predicted, values.select("gene").distinct().filter("gene < 'Brand#4'")


@query(f"""WITH {CELLS}, de AS (SELECT cell, sum(value) AS depth FROM expr GROUP BY 1), lc AS (SELECT cell, perturbation, depth FROM cells JOIN de USING (cell)),
x AS (SELECT perturbation, gene, value / depth AS f FROM expr JOIN lc USING (cell)), n AS (SELECT perturbation, count(*)::DOUBLE AS n FROM lc GROUP BY 1),
k AS (SELECT gene, sum(1e6 * f) / any_value(n) AS m0, (sum(1e12 * f * f) - pow(sum(1e6 * f), 2) / any_value(n)) / (any_value(n) - 1) AS v0, any_value(n) AS n0
  FROM x JOIN n USING (perturbation) WHERE perturbation = '{CONTROL}' GROUP BY 1),
p AS (SELECT perturbation AS target, gene, 1e6 * sum(f) / any_value(n) AS m1 FROM x JOIN n USING (perturbation) WHERE perturbation <> '{CONTROL}' GROUP BY ALL),
z AS (SELECT target, gene, (m1 - m0) / sqrt(v0 * pow(m1 / m0, 2) / 400 + v0 / n0) AS z, log2((m1 + 1e-9) / (m0 + 1e-9)) AS lfc FROM k JOIN p USING (gene) WHERE gene < 'Brand#4')
SELECT target, gene, round(z, 6) AS z, round(lfc, 6) AS lfc FROM z""")
def ideal_de_table(spark, sf_dir):
    """Welch's statistic and fold change; the tails are tested against the library's erfc."""
    return T.ideal_de(*ideal_inputs(spark, sf_dir)).select("target", "gene", r6("z").alias("z"), r6("lfc").alias("lfc"))


@query()
def ideal_de_tails(spark, sf_dir):
    return T.ideal_de(*ideal_inputs(spark, sf_dir)).select("target", "gene", "p", "p_adj")


@query()
def bootstrap_count_ci(spark, sf_dir):
    """Discounts' share of prices over resampled order lines, by counts; tested against resampled slots."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_extendedprice") * F.col("l_discount")).alias("num"), F.col("l_extendedprice").alias("den"))
    return R.interval(R.bootstrap_sums(rows, "id", ["num", "den"], 200, 67), F.col("num") / F.col("den"))


@query()
def subspace_map(spark, sf_dir):
    """ASIA's template from its control profile, by the other contexts; tested against singular values of dense matrices."""
    control = A.group_means(cells(spark, sf_dir).filter(F.col("perturbation") == CONTROL), expression(spark, sf_dir), ["context"])
    whole = A.group_means(cells(spark, sf_dir).filter(F.col("perturbation") != CONTROL), expression(spark, sf_dir), ["context"])
    alpha = whole.join(control.select("context", "gene", F.col("mean").alias("base")), ["context", "gene"]).select(F.col("context").alias("source"), "gene", (F.col("mean") - F.col("base")).alias("alpha"))
    dev = control.select(F.col("context").alias("source"), "gene", F.col("mean").alias("dev"))
    asia = F.col("source") == "ASIA"
    return M.subspace_map(alpha.filter(~asia), dev.filter(~asia), dev.filter(asia).drop("source"))


PANEL = RESP + """, sh AS (SELECT context, perturbation, gene, delta - 25 AS delta FROM resp), mm AS (SELECT context, gene, avg(delta) AS m FROM sh GROUP BY ALL), e AS (SELECT context, perturbation, gene, delta, m, delta - m AS e FROM sh JOIN mm USING (context, gene)),
c AS (SELECT DISTINCT context FROM sh), pr AS (SELECT t.context AS target, s.context AS src, row_number() OVER (PARTITION BY t.context ORDER BY s.context) AS nth FROM c t, c s WHERE t.context <> s.context),
b AS (SELECT target, perturbation, gene, avg(m) AS main, avg(CASE WHEN nth <= 2 THEN e END) AS b2, avg(CASE WHEN nth = 1 THEN e END) AS b1 FROM pr JOIN e ON src = context GROUP BY ALL),
w AS (SELECT target, tier, b.perturbation, b.gene, x.delta AS t, main + CASE tier WHEN 2 THEN 0.75 * b2 WHEN 1 THEN 0.5 * b1 ELSE 0 END AS p FROM b JOIN sh x ON x.context = target AND x.perturbation = b.perturbation AND x.gene = b.gene, (VALUES (2), (1), (0)) k(tier)),
mt AS (SELECT target, tier, perturbation, CASE WHEN sqrt(var_pop(p) * var_pop(t)) * count(*) > 1e-12 THEN corr(p, t) END AS r, sum(p * t) / sqrt(sum(p * p) * sum(t * t)) AS cs, avg(pow(t - p, 2)) AS mse, sum(pow(t - p, 2)) AS re, sum(t * t) AS en FROM w GROUP BY ALL),
d AS (SELECT a.target, a.tier, a.perturbation, q.perturbation AS other, round(1 - sum(a.p * q.t) / sqrt(sum(a.p * a.p) * sum(q.t * q.t)), 9) AS d FROM w a JOIN w q ON a.target = q.target AND a.gene = q.gene AND q.tier = 0 WHERE a.gene <> 'PROMO' GROUP BY ALL),
o AS (SELECT target, tier, perturbation, d AS own FROM d WHERE other = perturbation),
pd AS (SELECT target, tier, perturbation, 1 - (count(*) FILTER (WHERE d < own) + 0.5 * (count(*) FILTER (WHERE d = own) - 1)) / (count(*) - 1) AS pds FROM d JOIN o USING (target, tier, perturbation) GROUP BY ALL),
dr AS (SELECT draw, perturbation, ('0x' || md5('73:' || draw || ':' || perturbation)[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT perturbation FROM sh), range(6) x(draw)),
pn AS (SELECT draw, perturbation, CASE WHEN u < 0.25 THEN 2 WHEN u < 0.6 THEN 1 ELSE 0 END AS tier FROM dr)"""


@query(f"""WITH {PANEL} SELECT target, draw, count(*) FILTER (WHERE tier = 2) AS n_tier2, count(*) FILTER (WHERE tier = 1) AS n_tier1, count(*) FILTER (WHERE tier = 0) AS n_tier0, round(quantile_cont(r, 0.5), 5) AS pearson_median,
round(quantile_cont(cs, 0.5), 5) AS cosine_median, round(avg(mse), 5) AS mse_mean, round(1 - sum(re) / sum(en), 5) AS energy_explained, round(avg(pds), 5) AS pds_mean FROM pn JOIN mt USING (tier, perturbation) JOIN pd USING (target, tier, perturbation) GROUP BY target, draw""")
def mixed_panel_score(spark, sf_dir):
    """Every region predicted from the others by panels that mix tiers of support."""
    r = cut(responses(spark, sf_dir)).withColumn("delta", F.col("delta") - 25)
    weights = r.select(F.col("context").alias("target")).distinct().crossJoin(spark.createDataFrame([(2, 0.75), (1, 0.5)], "tier int, weight double"))
    out = P.mixed_panel(r, weights, {2: 0.25, 1: 0.35, 0: 0.4}, 6, 73, ("PROMO",))
    five = [F.round(c, 5).alias(c) for c in ("pearson_median", "cosine_median", "mse_mean", "energy_explained", "pds_mean")]
    return out.select("target", F.col("draw").cast("bigint").alias("draw"), "n_tier2", "n_tier1", "n_tier0", *five)


@query(f"""WITH {CELLS}, g AS (SELECT count(*) AS k FROM genes), pc AS (SELECT cell, sum(value) AS depth, count(*) AS det FROM expr GROUP BY 1),
kn AS (SELECT context AS grp, cell, coalesce(depth, 0) AS depth, coalesce(det, 0) AS det FROM cells LEFT JOIN pc USING (cell)),
lg AS (SELECT grp, cell, gene, ln(1 + value * 1e4 / depth) AS x FROM expr JOIN kn USING (cell)), nn AS (SELECT grp, count(*) AS n FROM kn GROUP BY 1),
ce AS (SELECT grp, gene, sum(x) / any_value(n) AS c FROM lg JOIN nn USING (grp) GROUP BY ALL),
di AS (SELECT kn.grp, kn.cell, sqrt(sum(pow(coalesce(lg.x, 0) - ce.c, 2))) AS d FROM kn JOIN ce ON ce.grp = kn.grp LEFT JOIN lg ON lg.cell = kn.cell AND lg.gene = ce.gene GROUP BY ALL),
sa AS (SELECT grp, cell FROM (SELECT grp, cell, row_number() OVER (PARTITION BY grp ORDER BY md5('79:' || cell)) AS k FROM kn) WHERE k <= 30),
un AS (SELECT grp, cell, gene, x / sqrt(sum(x * x) OVER (PARTITION BY grp, cell)) AS x FROM lg JOIN sa USING (grp, cell)),
pa AS (SELECT a.grp, a.cell AS a, b.cell AS b FROM sa a JOIN sa b ON a.grp = b.grp AND a.cell < b.cell),
pd AS (SELECT pa.grp, pa.a, pa.b, 1 - coalesce(sum(u.x * v.x), 0) AS d FROM pa LEFT JOIN un u ON u.cell = pa.a LEFT JOIN un v ON v.cell = pa.b AND v.gene = u.gene GROUP BY ALL),
q AS (SELECT grp, quantile_cont(depth, [0.5, 0.1, 0.9]) AS l, quantile_cont(det, [0.5, 0.1, 0.9]) AS t, count(*) AS n_cells, sum(det) AS nz FROM kn GROUP BY 1)
SELECT q.grp AS context, n_cells, round(1 - nz / (n_cells * k), 6) AS sparsity, round(l[1], 6) AS library_median, round(l[2], 6) AS library_q10, round(l[3], 6) AS library_q90, round(t[1], 6) AS detected_median, round(t[2], 6) AS detected_q10,
  round(t[3], 6) AS detected_q90, round((SELECT quantile_cont(d, 0.5) FROM di WHERE di.grp = q.grp), 5) AS heterogeneity_median, round((SELECT quantile_cont(d, 0.5) FROM pd WHERE pd.grp = q.grp), 5) AS cosine_distance_median FROM q, g""")
def spread_within_contexts(spark, sf_dir):
    values = expression(spark, sf_dir)
    n = values.select("gene").distinct().count()
    out = V.spread_summary(cells(spark, sf_dir).select(F.col("context").alias("group"), "cell"), values, n, 79, n=30)
    last = ("heterogeneity_median", "cosine_distance_median")
    six = [r6(c).alias(c) for c in ("sparsity", *[f"{a}_{b}" for a in ("library", "detected") for b in ("median", "q10", "q90")])]
    return out.select(F.col("group").alias("context"), "n_cells", *six, *[F.round(c, 5).alias(c) for c in last])


@query()
def replicate_anchor(spark, sf_dir):
    """Half of each market segment's orders scored as a prediction of the other half; tested against scoring the halves one by one."""
    lab = cells(spark, sf_dir).select("cell", F.col("perturbation").alias("target"))
    return E.replicate_anchor(lab, expression(spark, sf_dir), CONTROL, 83, ("Brand#11",))


COVARIATES = RESP + """, v AS (SELECT context, perturbation, gene, round(delta, 6) AS delta, n_cells, round(avg(delta) OVER (PARTITION BY perturbation, gene), 6) AS mean FROM resp)"""


@query(f"""WITH {COVARIATES}, c AS (SELECT perturbation, context, delta - avg(delta) OVER (PARTITION BY gene) AS y, n_cells - avg(n_cells) OVER (PARTITION BY gene) AS x, (context = 'ASIA')::INT - avg((context = 'ASIA')::INT) OVER (PARTITION BY gene) AS s
  FROM v WHERE context IN ('ASIA', 'EUROPE')), t AS (SELECT sum(s * s) AS ss, sum(x * x) AS xx, sum(s * x) AS sx, sum(s * y) AS sy, sum(x * y) AS xy FROM c)
SELECT 'ASIA' AS source, round((xx * sy - sx * xy) / (ss * xx - sx * sx), 6) AS contrast FROM t""")
def source_contrast(spark, sf_dir):
    """How far ASIA's responses lie from EUROPE's for the same gene, beyond what numbers of cells explain."""
    r = responses(spark, sf_dir).filter(F.col("context").isin("ASIA", "EUROPE")).withColumn("delta", r6("delta"))
    return T.fixed_effect_contrasts(r, "gene", "context", "EUROPE", "delta", ["n_cells"]).withColumn("contrast", r6("contrast"))


@query()
def partial_ranks(spark, sf_dir):
    """Rank correlation of responses with the shared mean, without numbers of cells and names' order; tested against dense inverses."""
    r = responses(spark, sf_dir)
    shared = r.groupBy("perturbation", "gene").agg(F.avg("delta").alias("mean"))
    rows = r.join(shared, ["perturbation", "gene"]).withColumn("size", F.length("gene").cast("double"))
    return T.partial_rank_correlation(rows, ["context"], "delta", "mean", ["n_cells", "size"])
