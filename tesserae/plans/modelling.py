"""Queries of models and generators: no SQL form, tested against brute force or exact properties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import r6
from tesserae.operators import aggregate as A
from tesserae.operators import generate as G
from tesserae.operators import models as M
from tesserae.plans.base_sql import CELLS
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


@query("""WITH x AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), b AS (SELECT covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 10) AS b, avg(x) AS mx, avg(y) AS my FROM x)
SELECT round(my - b * mx, 4) AS intercept, round(b, 4) AS slope FROM b""")
def ridge_fit(spark, sf_dir):
    beta = M.fit_ridge(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", 10.0)
    return spark.createDataFrame([(round(float(beta[0]), 4), round(float(beta[1]), 4))], "intercept double, slope double")


@query("""WITH o AS (SELECT l_quantity AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY x) AS i FROM o),
ab AS (SELECT a.i AS a, b.i AS b, avg(c.y) AS m FROM n a JOIN n b ON a.i <= b.i JOIN n c ON c.i BETWEEN a.i AND b.i GROUP BY ALL),
lo AS (SELECT n.i, ab.a, min(m) AS lo FROM n JOIN ab ON ab.a <= n.i AND ab.b >= n.i GROUP BY ALL), f AS (SELECT i, max(lo) AS fitted FROM lo GROUP BY 1)
SELECT x, round(y, 4) AS y, round(fitted, 4) AS fitted FROM n JOIN f USING (i)""")  # the greatest of the least means of ranges around a value
def isotonic_fit(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.avg("l_extendedprice").alias("y"))
    return M.fit_isotonic(o, "x", "y").select("x", F.round("y", 4).alias("y"), F.round("fitted", 4).alias("fitted"))


@query()
def pca_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    mean, parts, _ = M.fit_pca(e.select("embedding"), "embedding", 3)
    return M.apply_pca(e, "embedding", mean, parts).select("vec_id", *[r6(F.col("scores")[i]).alias(f"pc{i + 1}") for i in range(3)])


@query()
def kernel_ridge_transfer(spark, sf_dir):
    """Each region in turn is the target: responses predict from the other regions' mean vectors; anchors have an even hash."""
    r, whole = responses(spark, sf_dir), Window.partitionBy("perturbation", "gene")
    others = (F.sum("delta").over(whole) - F.col("delta")) / (F.count("delta").over(whole) - 1)
    d = r.withColumn("d", others - 25.0)
    rows = d.groupBy("context", F.col("perturbation").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("gene", "d"))), lambda s: s["d"]).alias("vec"), F.avg("delta").alias("y")
    )
    rows = rows.withColumn("is_anchor", F.pmod(F.crc32("id"), F.lit(2)) == 0)
    out = M.kernel_ridge(rows, ["context"], 1.0, "context string, id string, predicted double")
    return out.withColumn("predicted", r6("predicted"))


@query()
def basal_weights(spark, sf_dir):
    """Weights of four regions' mean profiles that approximate the fifth's: non-negative and free."""
    means = A.group_means(cells(spark, sf_dir), expression(spark, sf_dir), ["context"])
    names = ["AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST"]
    wide = means.groupBy("gene").pivot("context", [*names, "ASIA"]).agg(F.first("mean")).fillna(0.0)
    cols = [f"`{n}`" for n in names]
    prods = wide.agg(*[F.sum(F.col(a) * F.col(b)) for a in [*cols, "ASIA"] for b in cols]).first()
    m = np.array(prods, dtype=float).reshape(5, 4)
    free, simplex = M.affine_weights(m[:4], m[4]), M.simplex_weights(m[:4], m[4])
    return spark.createDataFrame([(n, round(float(a), 6), round(float(b), 6)) for n, a, b in zip(names, free, simplex, strict=True)], "context string, affine double, simplex double")


def profiles(spark, sf_dir):
    """One row a control cell: its depth and its context's composition."""
    c = cells(spark, sf_dir).filter(F.col("perturbation") == CONTROL)
    share = A.group_means(c, expression(spark, sf_dir), ["context"])
    packed = share.groupBy("context").agg(F.array_sort(F.collect_list(F.struct("gene", "mean"))).alias("p"))
    arrays = packed.select("context", F.col("p.gene").alias("genes"), F.col("p.mean").alias("shares"))
    depth = A.cell_profile(c, expression(spark, sf_dir)).select("cell", "context", "depth")
    return depth.join(F.broadcast(arrays), "context").select(F.col("context").alias("target"), "cell", "depth", "genes", "shares")


@query()
def multinomial_counts(spark, sf_dir):
    return G.draw_counts(profiles(spark, sf_dir), "multinomial", 41)


@query()
def gamma_poisson_counts(spark, sf_dir):
    return G.draw_counts(profiles(spark, sf_dir), "gamma_poisson", 43)


BLOCK_CELLS = 128  # cells whose counts are raked together


@query()
def raked_counts(spark, sf_dir):
    p = profiles(spark, sf_dir)
    blocks = p.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CELLS).alias("blocks"))
    block = F.pmod(F.xxhash64("cell"), F.col("blocks"))
    t = p.join(blocks, "target").select("target", block.alias("block"), "cell", F.round("depth").alias("depth"), "genes", F.col("shares").alias("base"), F.col("shares").alias("share"))
    return G.rake(t, 47)


@query(f"""WITH {CELLS}, d AS (SELECT cell, sum(value) AS depth FROM expr GROUP BY 1), c AS (SELECT concat_ws('|', context, batch) AS grp, cell, depth FROM cells JOIN d USING (cell)),
s AS (SELECT grp, count(*) AS n, sum(depth) AS s FROM c GROUP BY 1), t AS (SELECT grp, gene, sum(value) AS t FROM expr JOIN c USING (cell) GROUP BY ALL),
v AS (SELECT grp, gene, s.n, ln(1 + 5e4 * (t - coalesce(value, 0)) / (s - depth)) - ln(1 + 5e4 * t / s) AS v FROM t JOIN s USING (grp) JOIN c USING (grp) LEFT JOIN expr USING (cell, gene))
SELECT grp AS "group", round(sum(w), 6) AS variance FROM (SELECT grp, (n - 1) * var_pop(v) AS w FROM v GROUP BY grp, gene, n) GROUP BY 1""")
def jackknife_dispersion(spark, sf_dir):
    c = cells(spark, sf_dir).select("cell", F.concat_ws("|", "context", "batch").alias("group"))
    e = A.normalise(expression(spark, sf_dir)).select("cell", "gene", "value", "depth")
    return G.jackknife(e.join(c, "cell")).withColumn("variance", r6("variance"))


@query()
def synthetic_contexts(spark, sf_dir):
    """Counts for the cells and genes of the tables; the axis of genes travels with each cell."""
    axis = expression(spark, sf_dir).select("gene").distinct().agg(F.array_sort(F.collect_list("gene")).alias("genes"))
    return G.synthetic_cells(cells(spark, sf_dir).select("context", "cell").crossJoin(F.broadcast(axis)), 0)


@query("""SELECT p_brand AS perturbation, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def streamed_moments(spark, sf_dir):
    """The mergeable moments that the streaming extension keeps, over a bounded table."""
    m = A.moments(observations(spark, sf_dir), ["perturbation"])
    return m.select("perturbation", "n", r6("mean").alias("mean"), r6("variance").alias("variance"))
