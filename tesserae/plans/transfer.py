"""Queries of transfer, calibration, selection and feature summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import draw_key, log2_fold_change, pearson, r6
from tesserae.operators import aggregate as A
from tesserae.operators import calibration as B
from tesserae.operators import resample as R
from tesserae.operators.lineage import cut
from tesserae.plans.base_sql import CELLS, OBS, RESP
from tesserae.plans.decomposition import HALVES, half_responses
from tesserae.plans.scoring import sql_pearson
from tesserae.sources.tables import cells, expression, observations, responses, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


VIEW = RESP + """, src AS (SELECT * FROM resp WHERE context <> 'ASIA'), a0 AS (SELECT perturbation, gene, avg(delta) AS a FROM src GROUP BY ALL),
x1 AS (SELECT *, (sum(delta) OVER (PARTITION BY perturbation, gene) - delta) / (count(*) OVER (PARTITION BY perturbation, gene) - 1) AS x FROM src),
x2 AS (SELECT delta - avg(delta) OVER (PARTITION BY context, gene) AS y, x - avg(x) OVER (PARTITION BY context, gene) AS x FROM x1), sc AS (SELECT sum(y * x) / sum(x * x) AS s FROM x2),
vw AS (SELECT a0.perturbation, a0.gene, a, avg(a) OVER (PARTITION BY a0.gene) AS t, s, r.delta AS y FROM a0 CROSS JOIN sc LEFT JOIN resp r ON r.context = 'ASIA' AND r.perturbation = a0.perturbation AND r.gene = a0.gene),
an AS (SELECT perturbation, row_number() OVER (ORDER BY md5('53:' || perturbation), perturbation) <= 6 AS k FROM (SELECT DISTINCT perturbation FROM vw)),
e0 AS (SELECT vw.*, k, t + s * (a - t) AS e0s FROM vw JOIN an USING (perturbation)),
e1 AS (SELECT *, avg(CASE WHEN k THEN y - e0s END) OVER (PARTITION BY gene) AS off, avg(CASE WHEN k THEN y END) OVER (PARTITION BY gene) AS yk, avg(CASE WHEN k THEN a END) OVER (PARTITION BY gene) AS ak,
  avg(CASE WHEN k THEN a - t END) OVER (PARTITION BY gene) AS atk FROM e0),
s2 AS (SELECT sum((y - yk) * (a - ak)) / sum((a - ak) * (a - ak)) AS s2 FROM e1 WHERE k),
est AS (SELECT perturbation, gene, a AS e0, e0s, e0s + off AS e1, yk - s2 * atk + s2 * (a - t) AS e2, a, y, k FROM e1, s2)"""


def estimates(spark, sf_dir, resp=None):
    """resp: the responses where a query reads them for more than this. All steps read the grid from where it is kept, not the lines."""
    view = B.source_view(cut(responses(spark, sf_dir)) if resp is None else resp, "ASIA")
    labels = view.select("perturbation").distinct()
    order = Window.orderBy(draw_key(53, F.col("perturbation")), "perturbation")  # the label axis, not the data
    anchors = labels.withColumn("nth", F.row_number().over(order)).filter("nth <= 6").select("perturbation")
    return B.anchored(view, anchors)


@query(f"WITH {VIEW} SELECT perturbation, gene, round(e0, 6) AS e0, round(e0s, 6) AS e0s, round(e1, 6) AS e1, round(e2, 6) AS e2 FROM est")
def anchored_estimators(spark, sf_dir):
    return estimates(spark, sf_dir).select("perturbation", "gene", *[r6(c).alias(c) for c in ("e0", "e0s", "e1", "e2")])


TERMS = VIEW + ", " + HALVES.removeprefix(OBS + ", ") + """, mt AS (SELECT est.perturbation, est.gene, d1 AS h1, d2 AS h2, a, e0s AS p FROM est JOIN hj ON hj.context = 'ASIA' AND hj.perturbation = est.perturbation AND hj.gene = est.gene),
mc AS (SELECT *, h1 - avg(h1) OVER (PARTITION BY gene) AS c1, h2 - avg(h2) OVER (PARTITION BY gene) AS c2, a - avg(a) OVER (PARTITION BY gene) AS ca, p - avg(p) OVER (PARTITION BY gene) AS cp FROM mt),
mu AS (SELECT *, ca / sqrt(sum(ca * ca) OVER (PARTITION BY perturbation)) AS u FROM mc),
mp AS (SELECT perturbation, sum((h1 - p) * (h2 - p)) AS n0, sum(h1 * h2) AS d0, sum((c1 - cp) * (c2 - cp)) AS n1, sum(c1 * c2) AS d1, sum((c1 - cp) * u) * sum((c2 - cp) * u) AS n2, sum(c1 * u) * sum(c2 * u) AS d2,
  sum((c1 - ca) * (c2 - ca)) AS d4 FROM mu GROUP BY 1)"""


@query(f"""WITH {TERMS} SELECT round(1 - sum(n0) / sum(d0), 6) AS m0, round(1 - sum(n1) / sum(d1), 5) AS m1, round(1 - sum(n2) / sum(d2), 5) AS m2,
  round(1 - (sum(n1) - sum(n2)) / (sum(d1) - sum(d2)), 5) AS m3, round(1 - sum(n1) / sum(d4), 5) AS m4 FROM mp""")
def metric_terms(spark, sf_dir):
    a, b = half_responses(spark, sf_dir)
    h = lambda d, n: d.filter("context = 'ASIA'").select("perturbation", "gene", F.col("delta").alias(n))
    e = estimates(spark, sf_dir).select("perturbation", "gene", "a", F.col("e0s").alias("p"))
    rows = e.join(h(a, "e1"), B.AXIS).join(h(b, "e2"), B.AXIS)
    return B.metric_terms(rows, "p").select(r6("m0").alias("m0"), *[F.round(f"m{i}", 5).alias(f"m{i}") for i in range(1, 5)])


@query(f"""WITH {RESP}, o AS (SELECT *, (sum(delta) OVER (PARTITION BY perturbation, gene) - delta) / (count(*) OVER (PARTITION BY perturbation, gene) - 1) AS o FROM resp),
m AS (SELECT *, avg(o) OVER (PARTITION BY context, gene) AS m FROM o),
e AS (SELECT w, avg(power(delta - m - w * (o - m), 2)) AS error FROM m, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) t(w) GROUP BY 1)
SELECT w, round(error, 6) AS error, w = (SELECT w FROM e ORDER BY round(error, 9), w LIMIT 1) AS chosen FROM e""")
def nested_shrinkage_choice(spark, sf_dir):
    return B.select_shrinkage(responses(spark, sf_dir), (0.0, 0.25, 0.5, 0.75, 1.0)).withColumn("error", r6("error"))


@query(f"""WITH {RESP}, n AS (SELECT perturbation, gene, avg(delta) AS m, greatest(0, var_samp(delta) - avg(1.0 / n_cells)) AS tau2 FROM resp GROUP BY ALL)
SELECT perturbation, gene, round(m, 6) AS m, round(tau2, 6) AS tau2 FROM n""")
def exchangeable_fit(spark, sf_dir):
    x = B.exchangeable(responses(spark, sf_dir).withColumn("sigma2", 1 / F.col("n_cells")), "sigma2")
    return x.select("perturbation", "gene", r6("m").alias("m"), r6("tau2").alias("tau2"))


@query(f"""WITH {HALVES} SELECT context, perturbation, round(sum((d1 - d2) * (d1 - d2)) / (4 * count(*)), 6) AS noise FROM hj GROUP BY ALL""")
def noise_variance(spark, sf_dir):
    a, b = half_responses(spark, sf_dir)
    j = a.withColumnRenamed("delta", "x").join(b.withColumnRenamed("delta", "y"), ["context", "perturbation", "gene"])
    d = F.col("x") - F.col("y")
    return j.groupBy("context", "perturbation").agg(r6(F.sum(d * d) / (4 * F.count(F.lit(1)))).alias("noise"))


@query(f"""WITH {VIEW}, g AS (SELECT perturbation, gene, (y - a) - avg(y - a) OVER (PARTITION BY gene) AS g, a - avg(a) OVER (PARTITION BY gene) AS b FROM vw)
SELECT perturbation, round({sql_pearson('g', 'b')}, 6) AS r FROM g GROUP BY 1""")
def gamma_recoverability(spark, sf_dir):
    v = B.source_view(responses(spark, sf_dir), "ASIA")
    gene = Window.partitionBy("gene")
    g = (F.col("y") - F.col("a")) - F.avg(F.col("y") - F.col("a")).over(gene)
    c = v.select("perturbation", g.alias("g"), (F.col("a") - F.avg("a").over(gene)).alias("b"))
    return c.groupBy("perturbation").agg(r6(pearson(F.col("g"), F.col("b"))).alias("r"))


@query(f"""WITH {CELLS}, d AS (SELECT cell, perturbation, n, r, row_number() OVER (PARTITION BY perturbation, n, r ORDER BY md5('59:' || n || ':' || r || ':' || cell), cell) AS k FROM cells, (VALUES (50), (150)) a(n), (VALUES (0), (1), (2)) b(r)),
h AS (SELECT cell, perturbation, n, r, (k > n)::INT AS half FROM d WHERE k <= 2 * n), s AS (SELECT perturbation, n, r, half, gene, sum(value) / any_value(n) AS m FROM expr JOIN h USING (cell) GROUP BY perturbation, n, r, half, gene),
c AS (SELECT a.perturbation, a.n, a.r, {sql_pearson('a.m', 'b.m')} AS rho FROM s a JOIN s b USING (perturbation, n, r, gene) WHERE a.half = 0 AND b.half = 1 GROUP BY ALL)
SELECT perturbation, n AS depth, round(avg(rho), 6) AS mean_rho, round(stddev_samp(rho), 6) AS sd_rho FROM c GROUP BY ALL""")
def depth_reliability(spark, sf_dir):
    c = cells(spark, sf_dir).select("cell", "perturbation").withColumn("n", F.explode(F.array(F.lit(50), F.lit(150))))
    c = c.withColumn("r", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    key = draw_key(59, *[F.col(x).cast("string") for x in ("n", "r", "cell")])
    h = R.shuffled(c, ["perturbation", "n", "r"], key).filter("nth <= 2 * n").withColumn("half", (F.col("nth") > F.col("n")).cast("int"))
    keys = ["perturbation", "n", "r"]
    s = expression(spark, sf_dir).join(h, "cell").groupBy(*keys, "half", "gene").agg((F.sum("value") / F.first("n")).alias("m"))
    a, b = (s.filter(F.col("half") == i).select(*keys, "gene", F.col("m").alias(x)) for i, x in ((0, "x"), (1, "y")))
    rho = a.join(b, [*keys, "gene"]).groupBy(*keys).agg(pearson(F.col("x"), F.col("y")).alias("rho"))
    return rho.groupBy("perturbation", F.col("n").alias("depth")).agg(r6(F.avg("rho")).alias("mean_rho"), r6(F.stddev_samp("rho")).alias("sd_rho"))


@query(f"""WITH {RESP}, d AS (SELECT perturbation, delta - avg(delta) OVER (PARTITION BY perturbation) AS y, n_cells - avg(n_cells) OVER (PARTITION BY perturbation) AS x FROM resp),
k AS (SELECT row_number() OVER (ORDER BY perturbation) - 1 AS pos, sum(x * y) AS xy, sum(x * x) AS xx FROM d GROUP BY perturbation), n AS (SELECT count(*) AS n FROM k),
pk AS (SELECT b, ('0x' || substr(md5('61:' || b || ':' || s), 1, 8))::BIGINT % n AS pos FROM range(200) a(b), n, unnest(range(n)) t(s)), m AS (SELECT b, sum(xy) / sum(xx) AS m FROM pk JOIN k USING (pos) GROUP BY 1)
SELECT (SELECT round(sum(xy) / sum(xx), 8) FROM k) AS slope, round(quantile_cont(m, 0.025), 8) AS low, round(quantile_cont(m, 0.975), 8) AS high FROM m""")
def cluster_bootstrap_slope(spark, sf_dir):
    own = Window.partitionBy("perturbation")
    d = responses(spark, sf_dir).select("perturbation", (F.col("delta") - F.avg("delta").over(own)).alias("y"), (F.col("n_cells") - F.avg("n_cells").over(own)).alias("x"))
    k = d.groupBy("perturbation").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    k = k.withColumn("pos", (F.row_number().over(Window.orderBy("perturbation")) - 1).cast("bigint"))  # one row a cluster
    drawn = R.slots(k, 200, 61).join(k, "pos")
    q = drawn.groupBy("draw").agg((F.sum("xy") / F.sum("xx")).alias("m")).agg(F.expr("percentile(m, array(0.025, 0.975))").alias("q"))
    one = k.agg((F.sum("xy") / F.sum("xx")).alias("slope"))
    return one.crossJoin(q).select(F.round("slope", 8).alias("slope"), F.round(F.col("q")[0], 8).alias("low"), F.round(F.col("q")[1], 8).alias("high"))


@query(f"""WITH {OBS}, st AS (SELECT perturbation AS target, gene, avg(value) FILTER (WHERE flag = 'R') AS p, avg(value) FILTER (WHERE flag <> 'R') AS r, var_samp(value) FILTER (WHERE flag = 'R') / count(*) FILTER (WHERE flag = 'R') AS dp,
  var_samp(value) FILTER (WHERE flag <> 'R') / count(*) FILTER (WHERE flag <> 'R') AS dr FROM obs GROUP BY ALL), ct AS (SELECT gene, avg(value) AS c, var_samp(value) / count(*) AS dc FROM obs GROUP BY 1),
ds AS (SELECT target, sum(dp) AS cp, sum(dr) AS cr FROM st GROUP BY 1), dc AS (SELECT sum(dc) AS cc FROM ct), own AS (SELECT target, min(gene) FILTER (WHERE target LIKE '%1') AS own FROM st GROUP BY 1),
k AS (SELECT st.*, c FROM st JOIN ct USING (gene) JOIN own USING (target) WHERE own IS DISTINCT FROM gene), w AS (SELECT *, 1 / count(*) OVER (PARTITION BY target) AS w FROM k),
x AS (SELECT *, sum(w * p) OVER (PARTITION BY gene) / sum(w) OVER (PARTITION BY gene) AS mp FROM w),
t AS (SELECT target, sum((p - r) * (p - r)) AS err, sum((r - c) * (r - c)) AS eff, sum((p - mp) * (p - mp)) AS spread, count(*) AS g FROM x GROUP BY 1), td AS (SELECT *, least(cp, cr) AS credit FROM t JOIN ds USING (target)),
h AS (SELECT CASE WHEN sum(credit / g) > 0 THEN least(1, sum(spread / g) / sum(credit / g)) ELSE 1 END AS rho FROM td)
SELECT round(sum((err - rho * credit - cr) / g) / sum((eff - cr - cc) / g), 6) AS error, round(any_value(rho), 6) AS rho FROM td, h, dc""")
def expression_error(spark, sf_dir):
    """The own gene of a brand ending in 1 is its first gene by name; the others have none."""
    obs = observations(spark, sf_dir)
    v, ret = F.col("value"), F.col("flag") == "R"
    side = lambda c: (F.avg(F.when(c, v)), F.var_samp(F.when(c, v)) / F.count_if(c))
    (p, dp), (r, dr) = side(ret), side(~ret)
    st = obs.groupBy(F.col("perturbation").alias("target"), "gene").agg(p.alias("p"), dp.alias("dp"), r.alias("r"), dr.alias("dr"))
    ct = obs.groupBy("gene").agg(F.avg(v).alias("c"), (F.var_samp(v) / F.count(v)).alias("dc"))
    own = F.when(F.col("target").endswith("1"), F.min("gene").over(Window.partitionBy("target")))
    rows = st.withColumn("own", own).join(ct.select("gene", "c"), "gene")
    each = st.groupBy("target").agg(F.sum("dp").alias("cp"), F.sum("dr").alias("cr"))
    every = F.broadcast(ct.agg(F.sum("dc").alias("cc")))
    return B.expression_error(rows, each.crossJoin(every), F.col("cc")).select(r6("error").alias("error"), r6("rho").alias("rho"))


@query(f"""WITH {OBS}, s AS (SELECT batch, perturbation AS target, gene, avg(value) AS m, count(*) AS n FROM obs GROUP BY ALL), c AS (SELECT *, CASE WHEN n >= 20 THEN m END AS u FROM s),
e AS (SELECT target, gene, u - avg(u) OVER (PARTITION BY batch, gene) AS e FROM c) SELECT target, gene, round(avg(e), 6) AS effect, count(e) AS n_conditions FROM e GROUP BY ALL""")
def condition_centred_mean(spark, sf_dir):
    s = observations(spark, sf_dir).groupBy("batch", F.col("perturbation").alias("target"), "gene").agg(F.avg("value").alias("m"), F.count("value").alias("n"))
    u = s.withColumn("u", F.when(F.col("n") >= 20, F.col("m")))
    e = u.withColumn("e", F.col("u") - F.avg("u").over(Window.partitionBy("batch", "gene")))
    return e.groupBy("target", "gene").agg(r6(F.avg("e")).alias("effect"), F.count("e").alias("n_conditions"))


@query("""SELECT event_type AS gene, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.5), 6) AS q50,
  round(quantile_cont(value, 0.9), 6) AS q90, round(count(*) FILTER (WHERE value < 20) / count(value), 6) AS low_share FROM events WHERE isfinite(value) GROUP BY 1""")
def feature_summaries(spark, sf_dir):
    v = F.col("value")
    e = table(spark, sf_dir, "events").filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    g = e.groupBy(F.col("event_type").alias("gene")).agg(
        F.count(v).alias("n"), r6(F.avg(v)).alias("mean"), r6(F.stddev_pop(v)).alias("sd"), F.expr("percentile(value, array(0.1, 0.5, 0.9))").alias("q"),
        r6(F.count_if(v < 20) / F.count(v)).alias("low_share"),
    )
    return g.select("gene", "n", "mean", "sd", *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(("q10", "q50", "q90"))], "low_share")


@query(f"""WITH {RESP} SELECT a.gene AS a, b.gene AS b, round({sql_pearson('a.delta', 'b.delta')}, 6) AS r FROM resp a JOIN resp b USING (context, perturbation) WHERE a.gene < b.gene GROUP BY 1, 2""")
def coexpression(spark, sf_dir):
    from tesserae.operators.similarity import pairs_within

    p = pairs_within(responses(spark, sf_dir).withColumn("profile", F.concat_ws("|", "context", "perturbation")), [], "gene", "profile", "delta")
    return p.groupBy("a", "b").agg(r6(pearson(F.col("x"), F.col("y"))).alias("r"))


@query(f"""WITH {RESP}, p AS (SELECT a.context AS a, b.context AS b, perturbation, {sql_pearson('a.delta', 'b.delta')} AS r, count(*) AS n FROM resp a JOIN resp b USING (perturbation, gene) WHERE a.context < b.context GROUP BY ALL HAVING count(*) >= 5),
m AS (SELECT a, b, median(r) AS r FROM p GROUP BY ALL), s AS (SELECT a AS c, r FROM m UNION ALL SELECT b, r FROM m)
SELECT c AS context, round(median(r), 6) AS bound FROM s GROUP BY 1""")
def reliability_bound(spark, sf_dir):
    from tesserae.operators.similarity import pairs_within

    p = pairs_within(responses(spark, sf_dir), ["perturbation"], "context", "gene", "delta").groupBy("perturbation", "a", "b")
    each = p.agg(pearson(F.col("x"), F.col("y")).alias("r"), F.count(F.lit(1)).alias("n")).filter("n >= 5")
    m = each.groupBy("a", "b").agg(F.expr("percentile(r, 0.5)").alias("r"))
    s = m.select(F.col("a").alias("context"), "r").union(m.select("b", "r"))
    return s.groupBy("context").agg(r6(F.expr("percentile(r, 0.5)")).alias("bound"))


@query(f"""WITH {RESP}, b AS (SELECT perturbation, gene, avg(delta) AS base FROM resp GROUP BY ALL)
SELECT context, perturbation, gene, round(least(10, greatest(-10, log2(greatest(exp(base / 10 + (delta - base)) - 1, 0.05) / greatest(exp(base / 10) - 1, 0.05)))), 6) AS lfc FROM resp JOIN b USING (perturbation, gene)""")
def bounded_fold_change(spark, sf_dir):
    r = responses(spark, sf_dir)
    b = r.groupBy("perturbation", "gene").agg(F.avg("delta").alias("base"))
    lfc = log2_fold_change(F.col("base") / 10, F.col("delta") - F.col("base"), F.lit(0.05))
    return r.join(b, ["perturbation", "gene"]).select("context", "perturbation", "gene", r6(lfc).alias("lfc"))


@query(f"""WITH {RESP}, f AS (SELECT delta, n_cells, unnest(CASE WHEN n_cells >= 50 THEN ['all', 'subset'] ELSE ['all'] END) AS grp FROM resp)
SELECT grp, count(*) AS n, round(median(delta), 6) AS median, round(avg(delta), 6) AS mean FROM f GROUP BY 1""")
def overlapping_groups(spark, sf_dir):
    names = F.when(F.col("n_cells") >= 50, F.array(F.lit("all"), F.lit("subset"))).otherwise(F.array(F.lit("all")))
    f = responses(spark, sf_dir).select("delta", F.explode(names).alias("grp"))
    return f.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), r6(F.expr("percentile(delta, 0.5)")).alias("median"), r6(F.avg("delta")).alias("mean"))


@query(f"""WITH {RESP}, w AS (SELECT gene, count(*) AS k FROM (SELECT DISTINCT p_type AS gene, p_size FROM part) GROUP BY 1), m AS (SELECT context, gene, avg(delta) AS d FROM resp GROUP BY ALL)
SELECT context, round(sum(k * d) / sum(k), 6) AS weighted FROM m JOIN w USING (gene) GROUP BY 1""")
def prevalence_weighted_mean(spark, sf_dir):
    w = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("gene")).agg(F.countDistinct("p_size").alias("k"))
    m = responses(spark, sf_dir).groupBy("context", "gene").agg(F.avg("delta").alias("d"))
    return m.join(F.broadcast(w), "gene").groupBy("context").agg(r6(F.sum(F.col("k") * F.col("d")) / F.sum("k")).alias("weighted"))


@query(f"""WITH {RESP}, s AS (SELECT context, stddev_pop(delta) AS sd, avg(delta) AS m, min(n_cells) AS least FROM resp GROUP BY 1)
SELECT context, CASE WHEN least < 10 THEN 'refused' WHEN sd > 2.2 AND m > 25.5 THEN 'strong' WHEN sd > 2.2 OR m > 25.5 THEN 'partial' ELSE 'weak' END AS verdict FROM s""")
def decision_rules(spark, sf_dir):
    s = responses(spark, sf_dir).groupBy("context").agg(F.stddev_pop("delta").alias("sd"), F.avg("delta").alias("m"), F.min("n_cells").alias("least"))
    wide, high = F.col("sd") > 2.2, F.col("m") > 25.5
    return s.select("context", F.when(F.col("least") < 10, "refused").when(wide & high, "strong").when(wide | high, "partial").otherwise("weak").alias("verdict"))


@query(f"""WITH {CELLS}, m AS (SELECT context, gene, sum(value) AS s FROM expr JOIN cells USING (cell) GROUP BY ALL), n AS (SELECT context, count(*) AS n FROM cells GROUP BY 1), b AS (SELECT context, gene, s / n AS v FROM m JOIN n USING (context)),
p AS (SELECT a.context AS target, c.context AS source, {sql_pearson('a.v', 'c.v')} AS sim FROM b a JOIN b c USING (gene) WHERE a.context <> c.context GROUP BY 1, 2)
SELECT target, source, round(sim, 6) AS sim, round(greatest(sim, 0) / sum(greatest(sim, 0)) OVER (PARTITION BY target), 6) AS weight, row_number() OVER (PARTITION BY target ORDER BY sim DESC, source) = 1 AS nearest FROM p""")
def basal_similarity_weights(spark, sf_dir):
    b = A.group_means(cells(spark, sf_dir), expression(spark, sf_dir), ["context"])
    x = b.select("gene", F.col("context").alias("target"), F.col("mean").alias("x"))
    y = b.select("gene", F.col("context").alias("source"), F.col("mean").alias("y"))
    p = x.join(y, "gene").filter("target != source").groupBy("target", "source").agg(pearson(F.col("x"), F.col("y")).alias("sim"))
    own = Window.partitionBy("target")
    w = F.greatest("sim", F.lit(0.0))
    nearest = F.row_number().over(own.orderBy(F.desc("sim"), "source")) == 1
    return p.select("target", "source", r6("sim").alias("sim"), r6(w / F.sum(w).over(own)).alias("weight"), nearest.alias("nearest"))


def source_vectors(spark, sf_dir):
    """gene, perturbation, sources ARRAY (other contexts by name), y, is_anchor, s."""
    r = cut(responses(spark, sf_dir))
    gene = Window.partitionBy("context", "gene")
    c = r.filter("context != 'ASIA'").withColumn("x", F.col("delta") - F.avg("delta").over(gene))
    packed = c.groupBy("perturbation", "gene").agg(F.array_sort(F.collect_list(F.struct("context", "x"))).alias("p"))
    e = estimates(spark, sf_dir, r).select("perturbation", "gene", "y", "is_anchor", "s")
    return cut(packed.select("perturbation", "gene", F.col("p.x").alias("sources")).join(e, ["perturbation", "gene"]))


@query()
def per_gene_ridge(spark, sf_dir):
    """Ridge by gene on anchors; tested against direct solves."""
    return B.per_gene_ridge(source_vectors(spark, sf_dir)).withColumn("e3", r6("e3"))


@query()
def simulated_null(spark, sf_dir):
    """For each perturbation, agreement and error in an exchangeable world with the variances and the size that its responses show."""
    r = responses(spark, sf_dir).withColumn("sigma2", F.lit(200.0) / F.col("n_cells"))
    size = r.groupBy(F.col("perturbation").alias("world")).agg(
        F.countDistinct("context").cast("int").alias("contexts"), F.countDistinct("gene").cast("int").alias("genes"), F.avg("sigma2").alias("sigma2")
    )
    between = B.exchangeable(r, "sigma2").groupBy(F.col("perturbation").alias("world")).agg(F.avg("tau2").alias("tau2"))
    return B.simulate_null(size.filter("contexts > 2").join(between, "world"), 67)
