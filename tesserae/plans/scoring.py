"""Queries that compare vectors, rank, test and calibrate."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import pearson, r6
from tesserae.operators import ranking as K
from tesserae.operators import similarity as S
from tesserae.operators import stats as T
from tesserae.operators.lineage import cut
from tesserae.operators.neighbours import all_nearest, exact_nearest, searched
from tesserae.operators.panels import shared_discrimination
from tesserae.plans.base_sql import CELLS, OBS, PARTS, RESP
from tesserae.plans.decomposition import HALVES, half_responses
from tesserae.sources.tables import CONTROL, cells, expression, observations, responses, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Two views of a response: mean quantity and scaled mean price of the same grid cell.
PAIRS = OBS + """, pairs AS (SELECT context, perturbation, gene AS element, avg(value) - 25 AS x, avg(price) / 1000 - 25 AS y FROM obs GROUP BY ALL)"""
KEYS = ["context", "perturbation"]


def pairs(spark, sf_dir):
    g = observations(spark, sf_dir).groupBy("context", "perturbation", F.col("gene").alias("element"))
    return g.agg((F.avg("value") - 25).alias("x"), (F.avg("price") / 1000 - 25).alias("y"))


def sql_pearson(x, y, eps="1e-9"):
    return f"CASE WHEN sqrt(var_pop({x}) * var_pop({y})) * count(*) > {eps} THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END"


@query(f"WITH {PAIRS} SELECT context, perturbation, round({sql_pearson('x', 'y')}, 6) AS pearson FROM pairs GROUP BY ALL")
def row_pearson(spark, sf_dir):
    return S.row_metrics(pairs(spark, sf_dir), KEYS).select(*KEYS, r6("pearson").alias("pearson"))


@query(f"WITH {PAIRS} SELECT context, perturbation, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine FROM pairs GROUP BY ALL")
def row_cosine(spark, sf_dir):
    return S.row_metrics(pairs(spark, sf_dir), KEYS).select(*KEYS, r6("cosine").alias("cosine"))


@query(f"""WITH {PAIRS} SELECT context, perturbation, round(avg((x - y) * (x - y)), 6) AS mse, round(1 - sum((x - y) * (x - y)) / sum(y * y), 6) AS energy_explained,
  round(sqrt(sum(x * x) / sum(y * y)), 6) AS norm_ratio FROM pairs GROUP BY ALL""")
def energy_explained(spark, sf_dir):
    m = S.row_metrics(pairs(spark, sf_dir), KEYS)
    return m.select(*KEYS, *[r6(c).alias(c) for c in ("mse", "energy_explained", "norm_ratio")])


@query(f"""WITH {PAIRS}, r AS (SELECT *, rank() OVER (PARTITION BY context, perturbation ORDER BY x) + (count(*) OVER (PARTITION BY context, perturbation, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY context, perturbation ORDER BY y) + (count(*) OVER (PARTITION BY context, perturbation, y) - 1) / 2 AS ry FROM pairs)
SELECT context, perturbation, round({sql_pearson('rx', 'ry')}, 6) AS spearman FROM r GROUP BY ALL""")
def row_spearman(spark, sf_dir):
    return S.row_spearman(pairs(spark, sf_dir), KEYS).withColumn("spearman", r6("spearman"))


@query(f"""WITH {RESP} SELECT a.context AS a, b.context AS b, round({sql_pearson('a.delta', 'b.delta')}, 6) AS r
FROM resp a JOIN resp b USING (perturbation, gene) WHERE a.context < b.context GROUP BY 1, 2""")
def pairwise_context_corr(spark, sf_dir):
    r = responses(spark, sf_dir).select("context", "delta", F.concat_ws("|", "perturbation", "gene").alias("element"))
    p = S.pairs_within(r, [], "context", "element", "delta")
    return p.groupBy("a", "b").agg(r6(pearson(F.col("x"), F.col("y"))).alias("r"))


@query(f"""WITH {RESP}, p AS (SELECT perturbation, a.context AS a, b.context AS b, {sql_pearson('a.delta', 'b.delta')} AS r
FROM resp a JOIN resp b USING (perturbation, gene) WHERE a.context < b.context GROUP BY ALL)
SELECT perturbation, round(avg(r), 6) AS agreement, count(r) AS n_pairs FROM p GROUP BY 1""")
def source_agreement(spark, sf_dir):
    return S.agreement(responses(spark, sf_dir), ["perturbation"], "context", "gene", "delta").withColumn("agreement", r6("agreement"))


EMB = """q AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
r AS (SELECT vec_id AS ref_id, label, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT query_id, q.label AS query_label, ref_id, r.label AS ref_label, round(list_cosine_similarity(q.v, r.v), 6) AS cos FROM q, r)"""


def neighbours(spark, sf_dir, k):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    n = exact_nearest(e.filter("id % 100 = 0"), e, k)  # the stated query set: every id divisible by 100, against all rows
    return n.withColumn("cos", r6("cos"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings), r AS (SELECT vec_id AS ref_id, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT query_id, ref_id, round(list_cosine_similarity(q.v, r.v), 6) AS cos FROM q, r)
SELECT query_id, ref_id, cos, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, ref_id) AS position FROM c WHERE query_id <> ref_id QUALIFY position <= 5""")
def knn_topk_cosine(spark, sf_dir):
    """The nearest others of every vector."""
    n = all_nearest(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 5)
    return n.withColumn("cos", r6("cos")).withColumn("position", F.col("position").cast("bigint"))


@query()
def nearest_parts_searched(spark, sf_dir):
    """How many parts of clusters each query is compared with, of how many."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return searched(e.filter("id % 100 = 0"), e, 5)


@query(f"""WITH {EMB}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, ref_id) AS position FROM c WHERE query_id <> ref_id QUALIFY position <= 5)
SELECT query_id, round(CASE WHEN sum(greatest(cos, 0)) > 0 THEN sum(greatest(cos, 0) * ref_label) / sum(greatest(cos, 0)) ELSE 0 END, 6) AS predicted FROM n GROUP BY 1""")
def knn_predict(spark, sf_dir):
    n = neighbours(spark, sf_dir, 5)
    values = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref_id"), F.col("label").cast("double").alias("value"))
    return S.knn_predict(n, values).withColumn("predicted", r6("predicted"))


@query(f"""WITH {EMB} SELECT query_id, arg_max(ref_id, cos * 1e6 - ref_id * 1e-9) AS nearest, max(cos) AS cos FROM c WHERE query_id <> ref_id GROUP BY 1""")
def nearest_neighbour(spark, sf_dir):
    n = neighbours(spark, sf_dir, 1)
    return n.select("query_id", F.col("ref_id").alias("nearest"), "cos")


@query(f"""WITH {EMB}, n AS (SELECT query_id, ref_id, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, ref_id) AS position FROM c WHERE query_id <> ref_id QUALIFY position <= 5)
SELECT a.query_id, round(avg(list_cosine_similarity(x.v, y.v)), 5) AS agreement FROM n a JOIN n b ON a.query_id = b.query_id AND a.ref_id < b.ref_id
JOIN r x ON x.ref_id = a.ref_id JOIN r y ON y.ref_id = b.ref_id GROUP BY 1""")
def neighbour_agreement(spark, sf_dir):
    n = neighbours(spark, sf_dir, 5)
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    long = n.select("query_id", "ref_id").join(vec, "ref_id")
    each = S.pairs_within(long, ["query_id"], "ref_id", "i", "v").groupBy("query_id", "a", "b")
    cos = each.agg((F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("c"))
    return cos.groupBy("query_id").agg(F.round(F.avg("c"), 5).alias("agreement"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
m AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL) GROUP BY 1),
c AS (SELECT m.label, vec_id AS ref_id, 1 - round(list_cosine_similarity(m.v, e.v), 6) AS d FROM m, e), q AS (SELECT vec_id AS query_id, label FROM e),
o AS (SELECT query_id, q.label, d AS own FROM q JOIN c ON c.label = q.label AND c.ref_id = query_id)
SELECT query_id, round(1 - (count(*) FILTER (WHERE d < own) + 0.5 * (count(*) FILTER (WHERE d = own) - 1)) / (count(*) - 1), 6) AS score FROM o JOIN c USING (label) GROUP BY 1""")
def pds_cosine(spark, sf_dir):
    """The prediction for a vector is the mean of its label; all vectors are ranked and all are candidates."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    x = e.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
    out = shared_discrimination(cut(means), e, "label", digits=6)
    return out.select(F.col("id").alias("query_id"), r6("score").alias("score"))


@query(f"""WITH {PAIRS} SELECT context, perturbation, round(avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END), 6) AS sign_agreement FROM
(SELECT *, row_number() OVER (PARTITION BY context, perturbation ORDER BY abs(y) DESC, element) AS k FROM pairs) WHERE k <= 3 GROUP BY ALL""")
def sign_agreement_topk(spark, sf_dir):
    return S.top_sign_agreement(pairs(spark, sf_dir), KEYS, 3).withColumn("sign_agreement", r6("sign_agreement"))


def halves_joined(spark, sf_dir):
    a, b = half_responses(spark, sf_dir)
    return a.withColumnRenamed("delta", "a").join(b.withColumnRenamed("delta", "b"), ["context", "perturbation", "gene"])


@query(f"""WITH {HALVES}, e AS (SELECT context, perturbation, (d1 - avg(d1) OVER (PARTITION BY context, gene)) * (d2 - avg(d2) OVER (PARTITION BY context, gene)) AS e FROM hj)
SELECT context, perturbation, round(sum(e), 6) AS energy FROM e GROUP BY ALL""")
def reliable_energy(spark, sf_dir):
    return S.reliable_energy(halves_joined(spark, sf_dir), KEYS).withColumn("energy", r6("energy"))


@query(f"""WITH {HALVES}, c AS (SELECT context, perturbation, gene, d1 - avg(d1) OVER (PARTITION BY context, gene) AS a, d2 - avg(d2) OVER (PARTITION BY context, gene) AS b FROM hj),
p AS (SELECT s.context AS s, t.context AS t, sum((s.a + s.b) / 2 * (t.a + t.b) / 2) AS num, sum(s.a * s.b) AS ds, sum(t.a * t.b) AS dt
  FROM c s JOIN c t USING (perturbation, gene) WHERE s.context < t.context GROUP BY 1, 2)
SELECT s, t, round(CASE WHEN ds * dt > 0 THEN num / sqrt(ds * dt) END, 6) AS latent_cosine FROM p""")
def latent_cosine(spark, sf_dir):
    axis = Window.partitionBy("context", "gene")
    h = halves_joined(spark, sf_dir)
    c = h.select("context", "perturbation", "gene", (F.col("a") - F.avg("a").over(axis)).alias("a"), (F.col("b") - F.avg("b").over(axis)).alias("b"))
    s = c.select("perturbation", "gene", F.col("context").alias("s"), F.col("a").alias("sa"), F.col("b").alias("sb"))
    t = c.select("perturbation", "gene", F.col("context").alias("t"), F.col("a").alias("ta"), F.col("b").alias("tb"))
    both = s.join(t, ["perturbation", "gene"]).filter("s < t").groupBy("s", "t").agg(
        F.sum((F.col("sa") + F.col("sb")) / 2 * (F.col("ta") + F.col("tb")) / 2).alias("num"),
        F.sum(F.col("sa") * F.col("sb")).alias("ds"), F.sum(F.col("ta") * F.col("tb")).alias("dt"),
    )
    den = F.col("ds") * F.col("dt")
    return both.select("s", "t", r6(F.when(den > 0, F.col("num") / F.sqrt(F.greatest(den, F.lit(0.0))))).alias("latent_cosine"))


@query(f"""WITH {HALVES}, m AS (SELECT perturbation, gene, avg((d1 + d2) / 2) AS p FROM hj GROUP BY ALL)
SELECT context, perturbation, round(CASE WHEN sum(d1 * d2) > 1 THEN -sum((d1 - p) * (d2 - p)) / sum(d1 * d2) END, 6) AS quality, round(sum(d1 * d2), 6) AS signal
FROM hj JOIN m USING (perturbation, gene) GROUP BY ALL""")
def quality_d(spark, sf_dir):
    h = halves_joined(spark, sf_dir)
    p = h.groupBy("perturbation", "gene").agg(F.avg((F.col("a") + F.col("b")) / 2).alias("p"))
    q = S.quality(h.join(p, ["perturbation", "gene"]), "p", 1.0)
    return q.select(*KEYS, r6("quality").alias("quality"), r6("signal").alias("signal"))


# Differential tables: per target (brand) and gene (part type), prediction from returned lines, truth from the others.
DE = OBS + """, st AS (SELECT flag <> 'R' AS side, perturbation AS target, gene, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM obs GROUP BY ALL),
g AS (SELECT flag <> 'R' AS side, gene, avg(value) AS m0, var_samp(value) AS v0, count(*) AS n0 FROM obs GROUP BY ALL),
de AS (SELECT st.side, target, st.gene, round(abs(m - m0) / sqrt(v / n + v0 / n0), 9) AS z, round(log2((m + 1e-9) / (m0 + 1e-9)), 9) AS lfc FROM st JOIN g USING (side, gene)),
w AS (SELECT p.target, p.gene, p.z AS pz, r.z AS rz, p.lfc AS pl, r.lfc AS rl, p.z >= 1 AS ps, r.z >= 1 AS rs FROM de p JOIN de r USING (target, gene) WHERE NOT p.side AND r.side)"""


def de_tables(spark, sf_dir):
    """target, gene, pz, rz, pl, rl, ps, rs: z, log2 fold change and significance of prediction and truth."""
    obs = observations(spark, sf_dir).withColumn("side", F.col("flag") != "R")
    v = F.col("value")
    st = obs.groupBy("side", F.col("perturbation").alias("target"), "gene").agg(F.avg(v).alias("m"), F.var_samp(v).alias("v"), F.count(v).alias("n"))
    g = obs.groupBy("side", "gene").agg(F.avg(v).alias("m0"), F.var_samp(v).alias("v0"), F.count(v).alias("n0"))
    z = T.welch(F.col("m"), F.col("v"), F.col("n"), F.col("m0"), F.col("v0"), F.col("n0"))
    de = st.join(F.broadcast(g), ["side", "gene"]).select(
        "side", "target", "gene", F.round(z, 9).alias("z"), F.round(F.log2((F.col("m") + 1e-9) / (F.col("m0") + 1e-9)), 9).alias("lfc")
    )
    p = de.filter("not side").select("target", "gene", F.col("z").alias("pz"), F.col("lfc").alias("pl"), (F.col("z") >= 1).alias("ps"))
    r = de.filter("side").select("target", "gene", F.col("z").alias("rz"), F.col("lfc").alias("rl"), (F.col("z") >= 1).alias("rs"))
    return p.join(r, ["target", "gene"])


@query(f"""WITH {DE} SELECT target, CASE WHEN count(*) FILTER (WHERE ps OR rs) = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE ps AND rs) / count(*) FILTER (WHERE ps OR rs), 6) END AS jaccard FROM w GROUP BY 1""")
def jaccard_sets(spark, sf_dir):
    union = F.count_if(F.col("ps") | F.col("rs"))
    value = F.when(union == 0, 1.0).otherwise(F.count_if(F.col("ps") & F.col("rs")) / union)
    return de_tables(spark, sf_dir).groupBy("target").agg(r6(value).alias("jaccard"))


@query(f"""WITH {DE} SELECT target, round(CASE WHEN greatest(count(*) FILTER (WHERE ps), count(*) FILTER (WHERE rs)) > 0 THEN
  count(*) FILTER (WHERE ps AND rl <> 0 AND sign(pl) = sign(rl)) / greatest(count(*) FILTER (WHERE ps), count(*) FILTER (WHERE rs)) END, 6) AS fidelity FROM w GROUP BY 1""")
def direction_fidelity(spark, sf_dir):
    most = F.greatest(F.count_if("ps"), F.count_if("rs"))
    k = F.count_if(F.col("ps") & (F.col("rl") != 0) & (F.signum("pl") == F.signum("rl")))
    return de_tables(spark, sf_dir).groupBy("target").agg(r6(F.when(most > 0, k / most)).alias("fidelity"))


@query(f"""WITH {DE}, o AS (SELECT target, row_number() OVER win AS k, avg(CASE WHEN sign(pl) = sign(rl) THEN 1.0 ELSE 0.0 END) OVER (win ROWS UNBOUNDED PRECEDING) AS share, count(*) OVER (PARTITION BY target) AS n
  FROM w WHERE rs AND rl <> 0 WINDOW win AS (PARTITION BY target ORDER BY NOT ps, pz DESC, abs(pl) DESC, gene))
SELECT target, round(max(CASE WHEN share >= 0.9 THEN k ELSE 0 END) / any_value(n), 6) AS reach FROM o GROUP BY 1""")
def direction_reach(spark, sf_dir):
    real = de_tables(spark, sf_dir).filter("rs and rl <> 0").withColumn("match", F.signum("pl") == F.signum("rl"))
    order = [~F.col("ps"), F.desc("pz"), F.desc(F.abs("pl")), F.col("gene")]
    return K.prefix_purity_reach(real, ["target"], order).select("target", r6(F.col("reach") / F.col("n")).alias("reach"))


@query(f"""WITH {DE} SELECT target, round(CASE WHEN count(*) FILTER (WHERE rs) >= 1 THEN sum(abs(pl - rl)) FILTER (WHERE rs) / sum(abs(rl)) FILTER (WHERE rs) END, 6) AS nmae FROM w GROUP BY 1""")
def lfc_nmae(spark, sf_dir):
    rs = F.col("rs")
    value = F.when(F.count_if(rs) >= 1, F.sum(F.when(rs, F.abs(F.col("pl") - F.col("rl")))) / F.sum(F.when(rs, F.abs("rl"))))
    return de_tables(spark, sf_dir).groupBy("target").agg(r6(value).alias("nmae"))


@query(f"""WITH {DE}, p AS (SELECT target, gene, round(exp(-rz), 9) AS p FROM w), m AS (SELECT *, p * count(*) OVER (PARTITION BY target) / count(*) OVER (PARTITION BY target ORDER BY p RANGE UNBOUNDED PRECEDING) AS step FROM p)
SELECT target, gene, p, round(least(1, min(step) OVER (PARTITION BY target ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS p_adj FROM m""")
def bh_adjust(spark, sf_dir):
    p = de_tables(spark, sf_dir).select("target", "gene", F.round(F.exp(-F.col("rz")), 9).alias("p"))
    return T.adjust(p, ["target"]).withColumn("p_adj", r6("p_adj"))


RANKS = CELLS + f""", lab AS (SELECT cell, perturbation FROM cells), tgt AS (SELECT DISTINCT perturbation AS target FROM lab WHERE perturbation <> '{CONTROL}'),
sizes AS (SELECT target, gene, count(*) FILTER (WHERE perturbation = target) AS n1, count(*) FILTER (WHERE perturbation = '{CONTROL}') AS n0 FROM tgt, genes, lab GROUP BY ALL),
stored AS (SELECT target, gene, (perturbation = target)::INT AS side, value FROM expr JOIN lab USING (cell) JOIN tgt ON perturbation = target OR perturbation = '{CONTROL}' WHERE value > 0),
rk AS (SELECT *, rank() OVER (PARTITION BY target, gene ORDER BY value) + (count(*) OVER (PARTITION BY target, gene, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY target, gene, value) AS t FROM stored),
per AS (SELECT target, gene, sum(r) FILTER (WHERE side = 1) AS r1, count(*) FILTER (WHERE side = 1) AS s1, count(*) FILTER (WHERE side = 0) AS s0, sum(t * t - 1)::DOUBLE AS ties FROM rk GROUP BY ALL),
x AS (SELECT target, gene, n1::DOUBLE AS n1, n0::DOUBLE AS n0, coalesce(r1, 0) AS r1, coalesce(s1, 0) AS s1, n1 - coalesce(s1, 0) AS z1, (n1 + n0 - coalesce(s1, 0) - coalesce(s0, 0))::DOUBLE AS z, (n1 + n0)::DOUBLE AS n, coalesce(ties, 0) AS ties FROM sizes LEFT JOIN per USING (target, gene)),
u AS (SELECT *, z1 * (z + 1) / 2 + r1 + s1 * z - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n0 / 12 * ((n + 1) - (ties + z * z * z - z) / (n * (n - 1)))) AS sigma FROM x)"""


def rank_sums(spark, sf_dir):
    lab = cells(spark, sf_dir).select("cell", "perturbation")
    values = expression(spark, sf_dir)
    e = values.filter("value > 0").join(lab, "cell")
    mine = F.col("perturbation") != CONTROL
    targets = lab.filter(mine).groupBy(F.col("perturbation").alias("target")).agg(F.count(F.lit(1)).alias("n1"))
    n0 = lab.filter(~mine).agg(F.count(F.lit(1)).alias("n0"))
    own = e.filter(mine).select(F.col("perturbation").alias("target"), "gene", "value")
    return T.rank_sums(own, e.filter(~mine).select("gene", "value"), targets, n0, values.select("gene").distinct())


@query(f"""WITH {RANKS} SELECT target, gene, round(u, 6) AS u, round(CASE WHEN sigma > 0 THEN (abs(u - n1 * n0 / 2) - 0.5) / sigma END, 6) AS z FROM u""")
def rank_sum_statistic(spark, sf_dir):
    r = rank_sums(spark, sf_dir)
    return r.select("target", "gene", r6("u").alias("u"), r6("z").alias("z"))


ERFC = "1 / (1 + 0.5 * greatest(z, 0) / sqrt(2.0))"
# Coefficients of the erfc approximation that both engines use, constant term first.
ERFC_TERMS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
ERFC_POLY = " + ".join(f"({c}) * pow(t, {k})" for k, c in enumerate(ERFC_TERMS))


@query(f"""WITH {RANKS}, zz AS (SELECT target, gene, CASE WHEN sigma > 0 THEN (abs(u - n1 * n0 / 2) - 0.5) / sigma END AS z FROM u), tt AS (SELECT *, {ERFC} AS t FROM zz),
p AS (SELECT target, gene, z, round(coalesce(least(1, t * exp(-greatest(z, 0) * greatest(z, 0) / 2 + {ERFC_POLY})), 1), 9) AS p FROM tt),
m AS (SELECT *, p * count(*) OVER (PARTITION BY target) / count(*) OVER (PARTITION BY target ORDER BY p RANGE UNBOUNDED PRECEDING) AS step FROM p)
SELECT target, gene, round(z, 6) AS z, round(p, 6) AS p, round(least(1, min(step) OVER (PARTITION BY target ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS p_adj FROM m""")
def rank_sum_de_table(spark, sf_dir):
    """Rank-sum p by the normal tail, adjusted within target."""
    r = rank_sums(spark, sf_dir).withColumn("p", F.round(T.two_sided("z"), 9))
    return T.adjust(r, ["target"]).select("target", "gene", r6("z").alias("z"), r6("p").alias("p"), r6("p_adj").alias("p_adj"))


# Confidence and risk of orders: price stands for confidence, the customer's balance for risk.
RISK = """rr AS (SELECT o_orderpriority AS grp, o_orderkey AS id, o_totalprice AS confidence, c_acctbal AS risk FROM orders JOIN customer ON o_custkey = c_custkey)"""


def risks(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("confidence"), F.col("c_acctbal").alias("risk")
    )


@query(f"""WITH {RISK}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY confidence DESC, id) AS k, count(*) OVER (PARTITION BY grp) AS n FROM rr)
SELECT grp, coverage, round(avg(risk), 6) AS mean_risk, round(quantile_cont(risk, 0.5), 6) AS median_risk, count(*) AS kept
FROM k, (VALUES (1.0::DOUBLE), (0.75), (0.5), (0.25), (0.1)) t(coverage) WHERE k <= greatest(1, round_even(coverage * n, 0)) GROUP BY ALL""")
def risk_coverage(spark, sf_dir):
    r = K.risk_coverage(risks(spark, sf_dir), ["grp"])
    return r.select("grp", "coverage", r6("mean_risk").alias("mean_risk"), r6("median_risk").alias("median_risk"), "kept")


@query(f"""WITH {RISK}, k AS (SELECT grp, avg(risk) OVER (PARTITION BY grp ORDER BY confidence DESC, id ROWS UNBOUNDED PRECEDING) AS r FROM rr) SELECT grp, round(avg(r), 5) AS aurc FROM k GROUP BY 1""")
def aurc(spark, sf_dir):
    return K.area_under_risk_coverage(risks(spark, sf_dir), ["grp"]).withColumn("aurc", F.round("aurc", 5))


@query(f"""WITH {RISK}, k AS (SELECT grp, greatest(risk, 0) AS risk, row_number() OVER (PARTITION BY grp ORDER BY confidence, id) AS k, count(*) OVER (PARTITION BY grp) AS n FROM rr)
SELECT grp, budget, round(sum(CASE WHEN k <= greatest(1, round_even(budget * n, 0)) THEN risk ELSE 0 END) / sum(risk), 6) AS captured
FROM k, (VALUES (0.1::DOUBLE), (0.25), (0.5)) t(budget) GROUP BY ALL""")
def prioritisation_capture(spark, sf_dir):
    return K.capture(risks(spark, sf_dir), ["grp"], (0.1, 0.25, 0.5)).withColumn("captured", r6("captured"))


@query(f"""WITH {RISK}, e AS (SELECT quantile_cont(confidence, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM rr),
b AS (SELECT *, CASE WHEN confidence < e[2] THEN 0 WHEN confidence < e[3] THEN 1 WHEN confidence < e[4] THEN 2 WHEN confidence < e[5] THEN 3 ELSE 4 END AS bin FROM rr, e)
SELECT bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(risk), 6) AS quality, round(quantile_cont(risk, 0.5), 6) AS median_quality FROM b GROUP BY 1""")
def calibration_bins(spark, sf_dir):
    c = K.calibration(risks(spark, sf_dir).withColumnRenamed("risk", "quality"))
    return c.select("bin", "n", *[r6(x).alias(x) for x in ("confidence", "quality", "median_quality")])


@query(f"""WITH {RISK}, e AS (SELECT quantile_cont(confidence, [{", ".join(str(i / 10) for i in range(11))}]) AS e FROM rr),
b AS (SELECT *, {"CASE " + " ".join(f"WHEN confidence < e[{i + 2}] THEN {i}" for i in range(9)) + " ELSE 9 END"} AS bin FROM rr, e)
SELECT bin, count(*) AS n, round({sql_pearson('confidence', 'risk')}, 6) AS r, round(avg(CASE WHEN risk > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM b GROUP BY 1""")
def decile_table(spark, sf_dir):
    b = K.in_quantile_bins(risks(spark, sf_dir), "confidence", 10)
    return b.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), r6(pearson(F.col("confidence"), F.col("risk"))).alias("r"), r6(F.avg((F.col("risk") > 0).cast("double"))).alias("positive")
    )


CURVE = """cv AS (SELECT l_returnflag AS grp, l_linenumber AS k, round(avg(l_quantity * l_linenumber), 6) AS v FROM lineitem GROUP BY ALL)"""


def curve(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("k")).agg(r6(F.avg(F.col("l_quantity") * F.col("l_linenumber"))).alias("v"))


@query(f"WITH {CURVE} SELECT grp, min(CASE WHEN v >= 60 AND k >= 1 THEN k END) AS first_k FROM cv GROUP BY 1")
def first_crossing(spark, sf_dir):
    return K.first_crossing(curve(spark, sf_dir), ["grp"], 60.0)


@query(f"""WITH {CURVE}, l AS (SELECT *, lag(v) OVER (PARTITION BY grp ORDER BY k) AS v0, lag(k) OVER (PARTITION BY grp ORDER BY k) AS k0 FROM cv),
h AS (SELECT grp, k, CASE WHEN v0 IS NULL THEN k ELSE exp(ln(k0) + (60 - v0) / (v - v0) * (ln(k) - ln(k0))) END AS s FROM l WHERE v >= 60 AND (v0 IS NULL OR v0 < 60))
SELECT grp, round(arg_min(s, h.k), 6) AS k_star FROM cv LEFT JOIN h USING (grp) GROUP BY 1""")
def log_interp_crossing(spark, sf_dir):
    return K.log_crossing(curve(spark, sf_dir), ["grp"], 60.0).withColumn("k_star", r6("k_star"))


@query(f"""WITH {RESP}, v AS (SELECT context, perturbation, gene, CASE WHEN n_cells >= 60 THEN round(delta, 2) END AS v FROM resp),
r AS (SELECT *, count(v) OVER (PARTITION BY context) AS n, rank() OVER (PARTITION BY context ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY context, v) - 1) / 2 AS r FROM v)
SELECT context, perturbation, gene, round(CASE WHEN v IS NULL THEN 0.5 ELSE (r - 0.5) / n END, 6) AS percentile FROM r""")
def midrank_percentile(spark, sf_dir):
    v = responses(spark, sf_dir).withColumn("v", F.when(F.col("n_cells") >= 60, F.round("delta", 2)))
    return v.select("context", "perturbation", "gene", r6(K.midrank_percentile("v", ["context"])).alias("percentile"))


@query(f"""WITH {PARTS}, r AS (SELECT context, rank() OVER (PARTITION BY context ORDER BY x) + (count(*) OVER (PARTITION BY context, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY context ORDER BY y) + (count(*) OVER (PARTITION BY context, y) - 1) / 2 AS ry,
  rank() OVER (PARTITION BY context ORDER BY z) + (count(*) OVER (PARTITION BY context, z) - 1) / 2 AS rz FROM (SELECT context, round(delta, 6) AS x, round(beta, 6) AS y, n_cells AS z FROM parts)),
c AS (SELECT context, {sql_pearson('rx', 'ry')} AS xy, {sql_pearson('rx', 'rz')} AS xz, {sql_pearson('ry', 'rz')} AS yz, count(*) AS n FROM r GROUP BY 1)
SELECT context, n, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM c""")
def partial_rank_corr(spark, sf_dir):
    from tesserae.operators.anova import decompose

    p = decompose(responses(spark, sf_dir)).select("context", r6("delta").alias("x"), r6("beta").alias("y"), F.col("n_cells").alias("z"))
    return T.partial_spearman(p, ["context"]).select("context", "n", r6("partial").alias("partial"))


@query(f"""WITH {RESP}, c AS (SELECT delta - avg(delta) OVER (PARTITION BY perturbation) AS y, n_cells - avg(n_cells) OVER (PARTITION BY perturbation) AS x FROM resp)
SELECT round(sum(x * y) / sum(x * x), 8) AS slope, count(*) AS n FROM c""")
def fixed_effect_contrast(spark, sf_dir):
    return T.fixed_effect_slope(responses(spark, sf_dir), "perturbation", "delta", "n_cells").withColumn("slope", F.round("slope", 8))
