"""Queries over the balanced response tensor."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.scalars import r6
from tesserae.operators import anova as V
from tesserae.plans.base_sql import OBS, PARTS, RESP
from tesserae.sources.tables import observations, responses

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def shares(spark, sf_dir, gene: str = "p_type"):
    ss = V.sums_of_squares(V.decompose(V.assert_balanced(responses(spark, sf_dir, gene))))
    return V.fractions(ss)


def flagship(spark, sf_dir):
    out = shares(spark, sf_dir, "l_returnflag")
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(f"""WITH {PARTS} SELECT context, perturbation, gene, round(mu, 6) AS mu, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(gamma, 6) AS gamma FROM parts""")
def anova_components(spark, sf_dir):
    p = V.decompose(responses(spark, sf_dir))
    return p.select("context", "perturbation", "gene", *[r6(c).alias(c) for c in ("mu", "alpha", "beta", "gamma")])


@query(f"""WITH {PARTS}, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT context, perturbation FROM parts))
SELECT round(sum(mu * mu) / sum(delta * delta), 6) AS mu_share, round(sum(alpha * alpha) / sum(delta * delta), 6) AS alpha_share,
  round(sum(beta * beta) / sum(delta * delta), 6) AS beta_share, round(sum(gamma * gamma) / sum(delta * delta), 6) AS gamma_share,
  round(sum(delta * delta) / any_value(n.n), 6) AS total FROM parts, n""")
def anova_ss_fractions(spark, sf_dir):
    out = shares(spark, sf_dir)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(f"""WITH {PARTS}, v AS (SELECT perturbation, context, var_pop(gamma) AS g, var_pop(beta) AS b FROM parts GROUP BY ALL)
SELECT perturbation, round(avg(b) / (avg(b) + avg(g) + 1e-30), 6) AS beta_fraction FROM v GROUP BY 1""")
def beta_fraction(spark, sf_dir):
    return V.beta_fraction(V.decompose(responses(spark, sf_dir))).withColumn("beta_fraction", r6("beta_fraction"))


@query(f"""WITH {RESP}, t AS (SELECT *, avg(delta) OVER (PARTITION BY context, gene) AS t FROM resp),
a AS (SELECT *, sum(delta * t) OVER (PARTITION BY context, perturbation) / (sum(t * t) OVER (PARTITION BY context, perturbation) + 1e-30) AS k FROM t)
SELECT context, perturbation, gene, round(delta - k * t, 6) AS projected FROM a""")
def template_projection(spark, sf_dir):
    return V.project_out_template(responses(spark, sf_dir)).select("context", "perturbation", "gene", r6("projected").alias("projected"))


def half_responses(spark, sf_dir):
    """Responses of two halves: cells by the first bit of the md5 of their number."""
    bit = F.conv(F.substring(F.md5(F.concat(F.lit("5:"), F.col("cell").cast("string"))), 1, 1), 16, 10).cast("int") % 2
    obs = observations(spark, sf_dir).withColumn("half", bit)
    keys = ["context", "perturbation", "gene"]
    return [obs.filter(F.col("half") == h).groupBy(*keys).agg(F.avg("value").alias("delta")) for h in (0, 1)]


HALVES = OBS + """, ho AS (SELECT *, substr(md5('5:' || cell), 1, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS half FROM obs),
hr AS (SELECT half, context, perturbation, gene, avg(value) AS delta FROM ho GROUP BY ALL),
hw AS (SELECT *, avg(delta) OVER (PARTITION BY half, gene) AS mu, avg(delta) OVER (PARTITION BY half, context, gene) AS by_c,
  avg(delta) OVER (PARTITION BY half, perturbation, gene) AS by_p FROM hr),
hp AS (SELECT half, context, perturbation, gene, delta, mu, by_c - mu AS alpha, by_p - mu AS beta, delta - by_c - by_p + mu AS gamma FROM hw),
hj AS (SELECT a.context, a.perturbation, a.gene, a.delta AS d1, b.delta AS d2, a.mu AS m1, b.mu AS m2, a.alpha AS a1, b.alpha AS a2, a.beta AS b1, b.beta AS b2,
  a.gamma AS g1, b.gamma AS g2 FROM hp a JOIN hp b USING (context, perturbation, gene) WHERE NOT a.half AND b.half)"""


@query(f"""WITH {HALVES}, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT context, perturbation FROM hj))
SELECT round(sum(m1 * m2) / any_value(n.n), 6) AS signal_mu, round(sum(a1 * a2) / any_value(n.n), 6) AS signal_alpha, round(sum(b1 * b2) / any_value(n.n), 6) AS signal_beta,
  round(sum(g1 * g2) / any_value(n.n), 6) AS signal_gamma, round(sum(d1 * d2) / any_value(n.n), 6) AS signal_delta FROM hj, n""")
def cross_half_signal(spark, sf_dir):
    out = V.cross_half_signal(*half_responses(spark, sf_dir))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(f"""WITH {HALVES}, {PARTS.split('resp AS', 1)[0].replace(OBS + ', ', '')}resp AS{PARTS.split('resp AS', 1)[1]},
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT context, perturbation FROM hj)),
t AS (SELECT sum(delta * delta) / any_value(n.n) AS total FROM parts, n),
s AS (SELECT sum(m1 * m2 + a1 * a2) / any_value(n.n) AS t, sum(b1 * b2) / any_value(n.n) AS b, sum(g1 * g2) / any_value(n.n) AS g FROM hj, n)
SELECT round(s.t / total, 6) AS template, round(b / total, 6) AS shared, round(g / total, 6) AS specific, round(1 - (s.t + b + g) / total, 6) AS noise FROM s, t""")
def noise_corrected_fractions(spark, sf_dir):
    s = V.cross_half_signal(*half_responses(spark, sf_dir))
    total = V.sums_of_squares(V.decompose(responses(spark, sf_dir))).select("total")
    t, b, g = F.col("signal_mu") + F.col("signal_alpha"), F.col("signal_beta"), F.col("signal_gamma")
    return s.crossJoin(F.broadcast(total)).select(
        r6(t / F.col("total")).alias("template"), r6(b / F.col("total")).alias("shared"),
        r6(g / F.col("total")).alias("specific"), r6(1 - (t + b + g) / F.col("total")).alias("noise"),
    )


@query(f"""WITH {RESP}, x AS (SELECT *, (sum(delta) OVER (PARTITION BY perturbation, gene) - delta) / (count(*) OVER (PARTITION BY perturbation, gene) - 1) AS x FROM resp),
c AS (SELECT delta - avg(delta) OVER (PARTITION BY context, gene) AS y, x - avg(x) OVER (PARTITION BY context, gene) AS x FROM x)
SELECT round(CASE WHEN sum(x * x) > 0 THEN sum(y * x) / sum(x * x) ELSE 1 END, 6) AS scale FROM c""")
def loo_scale(spark, sf_dir):
    return V.loo_scale(responses(spark, sf_dir)).select(r6("scale").alias("scale"))


@query(f"""WITH {PARTS} SELECT max(abs(mu + alpha + beta + gamma - delta)) < 1e-9 AS reconstructs,
  abs(sum(mu * mu) + sum(alpha * alpha) + sum(beta * beta) + sum(gamma * gamma) - sum(delta * delta)) < 1e-6 AS partitions,
  abs(sum(alpha * beta)) < 1e-6 AND abs(sum(alpha * gamma)) < 1e-6 AND abs(sum(beta * gamma)) < 1e-6 AS orthogonal,
  count(*) = count(DISTINCT context) * count(DISTINCT perturbation) * count(DISTINCT gene) AS balanced FROM parts""")
def anova_invariants(spark, sf_dir):
    p = V.decompose(responses(spark, sf_dir))
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    whole = F.col("mu") + F.col("alpha") + F.col("beta") + F.col("gamma") - F.col("delta")
    return p.agg(
        (F.max(F.abs(whole)) < 1e-9).alias("reconstructs"),
        (F.abs(s("mu", "mu") + s("alpha", "alpha") + s("beta", "beta") + s("gamma", "gamma") - s("delta", "delta")) < 1e-6).alias("partitions"),
        ((F.abs(s("alpha", "beta")) < 1e-6) & (F.abs(s("alpha", "gamma")) < 1e-6) & (F.abs(s("beta", "gamma")) < 1e-6)).alias("orthogonal"),
        (F.count(F.lit(1)) == F.countDistinct("context") * F.countDistinct("perturbation") * F.countDistinct("gene")).alias("balanced"),
    )
