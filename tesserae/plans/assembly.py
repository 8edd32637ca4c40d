"""Queries that fuse sources, join structures, check constraints and summarise draws."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import draw_key, r6, seed_for
from tesserae.operators import checks as C
from tesserae.operators import fusion as U
from tesserae.operators import joins as J
from tesserae.operators import resample as R
from tesserae.operators.order import in_order
from tesserae.plans.base_sql import CELLS, OBS, RESP
from tesserae.sources.tables import cells, observations, responses, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Sources are contexts, targets brands, genes part types; a brand's own gene is the type whose position its number hits.
STATS = OBS + """, st AS (SELECT context AS source, perturbation AS target, gene, avg(value) AS cpm, var_samp(value) AS v, count(*) AS n_cells FROM obs GROUP BY ALL),
ct AS (SELECT context AS source, gene, avg(value) AS control_cpm, var_samp(value) AS vc, count(*) AS nc FROM obs GROUP BY ALL),
x AS (SELECT source, target, gene, cpm, v, n_cells, control_cpm, vc, nc, target = 'Brand#1' AND gene = 'STANDARD' AS own, n_cells >= 20 AS there FROM st JOIN ct USING (source, gene)),
rw AS (SELECT *, CASE WHEN there THEN log2((cpm + 1) / (control_cpm + 1)) END AS raw FROM x),
ef AS (SELECT source, target, gene, raw - coalesce(avg(CASE WHEN NOT own THEN raw END) OVER (PARTITION BY source, gene), 0) AS effect, v / n_cells + vc / nc AS sigma2 FROM rw)"""


def stats(spark, sf_dir):
    obs = observations(spark, sf_dir)
    v = F.col("value")
    st = obs.groupBy(F.col("context").alias("source"), F.col("perturbation").alias("target"), "gene").agg(F.avg(v).alias("cpm"), F.var_samp(v).alias("v"), F.count(v).alias("n_cells"))
    ct = obs.groupBy(F.col("context").alias("source"), "gene").agg(F.avg(v).alias("control_cpm"), F.var_samp(v).alias("vc"), F.count(v).alias("nc"))
    return st.join(F.broadcast(ct), ["source", "gene"]).withColumn("measured", F.lit(True))


def effects(spark, sf_dir):
    s = stats(spark, sf_dir)
    keyed = s.withColumn("axis", F.col("gene")).withColumn(
        "gene", F.when((F.col("target") == "Brand#1") & (F.col("gene") == "STANDARD"), F.col("target")).otherwise(F.col("gene"))
    )
    raw = F.when(F.col("n_cells") >= 20, F.log2((F.col("cpm") + 1) / (F.col("control_cpm") + 1)))
    mean = F.avg(F.when(F.col("gene") != F.col("target"), F.col("raw"))).over(Window.partitionBy("source", "axis"))
    e = keyed.withColumn("raw", raw).withColumn("effect", F.col("raw") - F.coalesce(mean, F.lit(0.0)))
    return e.select("source", "target", F.col("axis").alias("gene"), "effect", (F.col("v") / F.col("n_cells") + F.col("vc") / F.col("nc")).alias("sigma2"))


@query(f"WITH {STATS} SELECT source, target, gene, round(effect, 6) AS effect FROM ef")
def centered_source_effect(spark, sf_dir):
    return effects(spark, sf_dir).select("source", "target", "gene", r6("effect").alias("effect"))


PLAIN = OBS + """, st AS (SELECT context AS source, perturbation AS target, gene, avg(value) AS cpm, count(*) AS n_cells FROM obs GROUP BY ALL),
ct AS (SELECT context AS source, gene, avg(value) AS control_cpm FROM obs GROUP BY ALL),
rw AS (SELECT source, target, gene, CASE WHEN n_cells >= 20 THEN log2((cpm + 1) / (control_cpm + 1)) END AS raw FROM st JOIN ct USING (source, gene))"""


@query(f"""WITH {PLAIN}, e AS (SELECT target, gene, raw - coalesce(avg(raw) OVER (PARTITION BY source, gene), 0) AS effect, length(source) - 4 AS w FROM rw)
SELECT target, gene, round(coalesce(CASE WHEN sum(w) FILTER (WHERE effect IS NOT NULL) > 0 THEN sum(w * effect) / sum(w) FILTER (WHERE effect IS NOT NULL) ELSE avg(effect) END, 0), 6) AS fused,
  count(effect) AS n_sources FROM e GROUP BY ALL""")
def weighted_fusion(spark, sf_dir):
    e = U.source_effects(stats(spark, sf_dir), 20)
    return U.fuse(e, (F.length("source") - 4).cast("double")).withColumn("fused", r6("fused"))


@query(f"""WITH {STATS} SELECT target, gene, CASE WHEN count(effect) = 0 THEN 0 WHEN count(effect) = 1 THEN 1
  WHEN count(*) FILTER (WHERE effect > 0) > 0 AND count(*) FILTER (WHERE effect < 0) > 0 THEN 3 ELSE 2 END AS consensus FROM ef GROUP BY ALL""")
def consensus_classes(spark, sf_dir):
    return U.consensus(effects(spark, sf_dir))


@query(f"""WITH {STATS}, w AS (SELECT target, gene, count(*) AS k, sum(1 / sigma2) AS s1, sum(1 / (sigma2 * sigma2)) AS s2, sum(effect / sigma2) AS we, sum(effect * effect / sigma2) AS wee
  FROM ef WHERE effect IS NOT NULL AND sigma2 > 0 GROUP BY ALL HAVING count(*) >= 2)
SELECT gene, round(CASE WHEN sum(s1 - s2 / s1) > 0 THEN greatest(0, sum(wee - we * we / s1 - (k - 1)) / sum(s1 - s2 / s1)) ELSE 0 END, 6) AS tau2 FROM w GROUP BY 1""")
def pooled_tau2(spark, sf_dir):
    return U.pooled_tau2(effects(spark, sf_dir)).withColumn("tau2", r6("tau2"))


@query(f"""WITH {STATS}, s AS (SELECT source, target, gene, effect, CASE WHEN source <> 'ASIA' THEN sigma2 / 1e4 END AS sigma2 FROM ef),
t AS (SELECT *, greatest(0, avg(effect * effect) OVER (PARTITION BY gene) - avg(sigma2) OVER (PARTITION BY gene)) AS tau2 FROM s)
SELECT source, target, gene, round(CASE WHEN sigma2 IS NULL THEN 1 WHEN tau2 + sigma2 > 0 THEN tau2 / (tau2 + sigma2) ELSE 0 END, 6) AS multiplier FROM t""")
def eb_shrinkage(spark, sf_dir):
    e = effects(spark, sf_dir).withColumn("sigma2", F.when(F.col("source") != "ASIA", F.col("sigma2") / 1e4))
    return U.shrinkage_multiplier(e).select("source", "target", "gene", r6("multiplier").alias("multiplier"))


@query(f"""WITH {STATS}, f AS (SELECT *, n_cells / (n_cells + 100.0) AS f FROM x), m AS (SELECT *, f * cpm + (1 - f) * control_cpm AS m FROM f)
SELECT source, target, gene, round(power(f / ((m + 1) * ln(2)), 2) * v / n_cells + power(((1 - f) / (m + 1) - 1 / (control_cpm + 1)) / ln(2), 2) * vc / nc, 8) AS sigma2 FROM m""")
def delta_sigma2(spark, sf_dir):
    s = stats(spark, sf_dir).withColumn("f", F.col("n_cells") / (F.col("n_cells") + 100.0))
    s = s.withColumn("m", F.col("f") * F.col("cpm") + (1 - F.col("f")) * F.col("control_cpm"))
    v = U.log_ratio_variance(F.col("m"), F.col("control_cpm"), F.col("f"), F.col("v"), F.col("n_cells"), F.col("vc"), F.col("nc"))
    return s.select("source", "target", "gene", F.round(v, 8).alias("sigma2"))


@query(f"""WITH {STATS}, s AS (SELECT source, target, gene, CASE WHEN gene <> 'PROMO' THEN sigma2 END AS sigma2 FROM ef), m AS (SELECT source, median(sigma2) AS med FROM s GROUP BY 1),
w AS (SELECT source, target, gene, 1 / coalesce(sigma2, med) AS w FROM s JOIN m USING (source))
SELECT source, target, gene, round(w / avg(w) OVER (PARTITION BY source), 6) AS weight FROM w""")
def inverse_variance_weights(spark, sf_dir):
    e = effects(spark, sf_dir).withColumn("sigma2", F.when(F.col("gene") != "PROMO", F.col("sigma2")))
    return U.inverse_variance(e).select("source", "target", "gene", r6("weight").alias("weight"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events),
p AS (SELECT a.event_id AS l_id, b.event_id AS r_id, abs(a.t - b.t) AS distance FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.t - b.t) <= 3600000000
  WHERE a.event_type = 'click' AND b.event_type = 'purchase')
SELECT l_id, r_id, distance, round(0.15 + 0.85 * least(1, greatest(0, log10(greatest(distance / 1e6, 500) / 500))), 6) AS share FROM p""")
def promoter_band_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    p = J.band_join(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), ["user_id"], "t", 3_600_000_000)
    return p.select("l_id", "r_id", "distance", r6(J.neighbour_ceiling(F.lit(1.0), F.col("distance") / 1e6)).alias("share"))


EDGES = """ed AS (SELECT 's' || l_suppkey AS a, 's' || (l_partkey % 100 + 1) AS b, l_quantity AS score FROM lineitem)"""


@query(f"""WITH {EDGES}, bo AS (SELECT * FROM ed UNION ALL SELECT b, a, score FROM ed) SELECT a, b, max(score) AS score FROM bo WHERE a <> b GROUP BY ALL""")
def edge_symmetrise(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s = lambda c: F.concat(F.lit("s"), c.cast("string"))
    return J.symmetric_edges(li.select(s(F.col("l_suppkey")).alias("a"), s(F.col("l_partkey") % 100 + 1).alias("b"), F.col("l_quantity").alias("score")))


@query(f"""WITH {RESP}, sets AS (SELECT DISTINCT p_type AS gene, substr(p_type, 1, 1) AS set_name FROM part UNION SELECT DISTINCT p_type, 'all' FROM part),
sz AS (SELECT set_name, count(*) AS n FROM sets GROUP BY 1 HAVING count(*) >= 1)
SELECT context, perturbation, set_name, round(sum(delta) / any_value(n), 6) AS score FROM resp JOIN sets USING (gene) JOIN sz USING (set_name) GROUP BY ALL""")
def pathway_scores(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.col("p_type").alias("gene")).distinct()
    sets = t.select("gene", F.substring("gene", 1, 1).alias("set_name")).union(t.select("gene", F.lit("all")))
    sizes = sets.groupBy("set_name").agg(F.count(F.lit(1)).alias("n")).filter("n >= 1")
    joined = responses(spark, sf_dir).join(F.broadcast(sets.join(sizes, "set_name")), "gene")
    return joined.groupBy("context", "perturbation", "set_name").agg(r6(F.sum("delta") / F.first("n")).alias("score"))


DRAWS = CELLS + """, dr AS (SELECT context, perturbation AS estimator, extract(month FROM o_orderdate) AS k, avg(o_totalprice) / 9973 AS m FROM cells JOIN orders ON o_orderkey = cell GROUP BY ALL)"""


def draws(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), F.month("o_orderdate").alias("k"), "o_totalprice")
    g = cells(spark, sf_dir).join(o, "cell").groupBy("context", F.col("perturbation").alias("estimator"), "k")
    return g.agg((F.avg("o_totalprice") / 9973).alias("m"))


@query(f"""WITH {DRAWS} SELECT context, estimator, round(quantile_cont(m, 0.5), 6) AS median, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM dr GROUP BY ALL""")
def draw_summary(spark, sf_dir):
    q = draws(spark, sf_dir).groupBy("context", "estimator").agg(F.expr("percentile(m, array(0.5, 0.025, 0.975))").alias("q"))
    return q.select("context", "estimator", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("median", "low", "high"))])


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"""WITH {DRAWS}, p AS (SELECT context, k, {", ".join(f"avg(m) FILTER (WHERE estimator = '{s}') AS {s.lower()}" for s in SEGMENTS)} FROM dr GROUP BY ALL)
SELECT context, k, {", ".join(f"round({s.lower()}, 6) AS {s.lower()}" for s in SEGMENTS)}, round(greatest({", ".join(s.lower() for s in SEGMENTS)}) - automobile, 6) AS gain FROM p""")
def pivot_draws(spark, sf_dir):
    p = draws(spark, sf_dir).groupBy("context", "k").pivot("estimator", SEGMENTS).agg(F.avg("m"))
    return p.select("context", "k", *[F.round(s, 6).alias(s.lower()) for s in SEGMENTS], F.round(F.greatest(*SEGMENTS) - F.col("AUTOMOBILE"), 6).alias("gain"))


@query(f"""WITH {DRAWS}, a AS (SELECT context, k, max(m) FILTER (WHERE estimator = 'AUTOMOBILE') AS b, max(m) FILTER (WHERE estimator = 'MACHINERY') AS r FROM dr GROUP BY ALL)
SELECT context, estimator, round(avg(least(1, greatest(0, (m - b) / (r - b)))), 6) AS scaled FROM dr JOIN a USING (context, k) WHERE abs(r - b) > 0.0001 GROUP BY ALL""")
def scale_to_anchors(spark, sf_dir):
    d = draws(spark, sf_dir)
    m = lambda s: F.max(F.when(F.col("estimator") == s, F.col("m")))
    a = d.groupBy("context", "k").agg(m("AUTOMOBILE").alias("b"), m("MACHINERY").alias("r")).filter("abs(r - b) > 0.0001")
    x = (F.col("m") - F.col("b")) / (F.col("r") - F.col("b"))
    return d.join(a, ["context", "k"]).groupBy("context", "estimator").agg(r6(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))).alias("scaled"))


@query("""SELECT lang, count(*) AS n, (sum(('0x' || substr(sha256(text), 1, 15))::BIGINT::HUGEINT) % 2305843009213693951)::BIGINT AS digest FROM documents GROUP BY 1""")
def sha256_digest(spark, sf_dir):
    head = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    total = F.sum(head) % F.lit((1 << 61) - 1).cast("decimal(38,0)")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), total.cast("bigint").alias("digest"))


@query("""WITH al AS (SELECT r_name AS alias, lower(r_name) AS canonical FROM region WHERE r_regionkey < 3)
SELECT r_name AS label, coalesce(canonical, r_name) AS canonical, alias IS NOT NULL AS alias_used FROM region LEFT JOIN al ON r_name = alias""")
def alias_coalesce(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    al = region.filter("r_regionkey < 3").select(F.col("r_name").alias("alias"), F.lower("r_name").alias("canonical"))
    return J.resolve_aliases(region.select(F.col("r_name").alias("label")), al)


@query("""SELECT p_brand, p_type, p_size, count(*) AS copies FROM part GROUP BY ALL""")
def dedupe_identical(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size", F.length("p_brand").alias("width"))
    return C.dedupe_identical(p, ["p_brand", "p_type", "p_size"])


@query("""SELECT p_brand AS label, row_number() OVER (ORDER BY p_brand) - 1 AS position FROM
(SELECT p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 45 INTERSECT SELECT p_brand FROM part WHERE p_size > 40)""")
def shared_labels_intersection(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45")
    a = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand")
    both = a.intersect(part.filter("p_size > 40").select("p_brand"))
    position = (F.row_number().over(Window.orderBy("p_brand")) - 1).cast("bigint")  # the label axis, not the data
    return both.select(F.col("p_brand").alias("label"), position.alias("position"))


@query(r"""SELECT lang, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '(?i)licen[sc]e')) AS license, count(*) FILTER (WHERE regexp_matches(text, '[0-9]{4}')) AS number,
  count(*) FILTER (WHERE regexp_matches(text, '^[A-Z]') AND NOT regexp_matches(text, '^The')) AS capital FROM documents GROUP BY 1""")
def panel_composition_regex(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t.rlike("(?i)licen[sc]e")).alias("license"), F.count_if(t.rlike("[0-9]{4}")).alias("number"),
        F.count_if(t.rlike("^(?!The)[A-Z]")).alias("capital"),
    )


@query("""WITH panel AS (SELECT DISTINCT p_type AS gene FROM part UNION SELECT 'MISSING'), s AS (SELECT p_type AS gene, avg(p_retailprice) AS v FROM part WHERE p_size > 10 GROUP BY 1)
SELECT gene, s.gene IS NOT NULL AS supported, round(coalesce(v, 0), 6) AS v FROM panel LEFT JOIN s USING (gene)""")
def panel_map_support(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    panel = part.select(F.col("p_type").alias("gene")).union(spark.createDataFrame([("MISSING",)], "gene string")).distinct()
    s = part.filter("p_size > 10").groupBy(F.col("p_type").alias("gene")).agg(F.avg("p_retailprice").alias("v"))
    return panel.join(s, "gene", "left").select("gene", F.col("v").isNotNull().alias("supported"), r6(F.coalesce("v", F.lit(0.0))).alias("v"))


@query(f"""WITH {RESP}, u AS (SELECT perturbation AS target, context AS source, min(n_cells) >= 12 AS usable FROM resp GROUP BY ALL),
g AS (SELECT target, count(*) AS n, string_agg(source, '|' ORDER BY source) AS names FROM u WHERE usable GROUP BY 1), t AS (SELECT DISTINCT p_brand AS target FROM part)
SELECT target, coalesce(n, 0) AS n_sources, least(coalesce(n, 0), 3) AS tier, coalesce(names, '') AS sources FROM t LEFT JOIN g USING (target)""")
def coverage_tiers(spark, sf_dir):
    u = responses(spark, sf_dir).groupBy(F.col("perturbation").alias("target"), F.col("context").alias("source")).agg((F.min("n_cells") >= 12).alias("usable"))
    return J.coverage_tiers(u, table(spark, sf_dir, "part").select(F.col("p_brand").alias("target")).distinct())


@query("""SELECT 'order_key' AS name, count(*) = 0 AS passed, count(*) || ' rows' AS detail FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'supplier_name', count(*) = 0, count(*) || ' rows' FROM (SELECT s_name FROM supplier GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'part_type', count(*) = 0, count(*) || ' rows' FROM (SELECT p_type FROM part GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'whole_quantity', count(*) = 0, count(*) || ' rows' FROM lineitem WHERE l_quantity <> floor(l_quantity) OR l_quantity < 0 OR l_quantity IS NULL""")
def uniqueness_checks(spark, sf_dir):
    q = F.col("l_quantity")
    rows = [
        C.unique(table(spark, sf_dir, "orders"), "order_key", ["o_orderkey"]),
        C.unique(table(spark, sf_dir, "supplier"), "supplier_name", ["s_name"]),
        C.unique(table(spark, sf_dir, "part"), "part_type", ["p_type"]),
        C.check(table(spark, sf_dir, "lineitem"), "whole_quantity", (q != F.floor(q)) | (q < 0) | q.isNull()),
    ]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query(f"""WITH {CELLS}, b AS (SELECT DISTINCT context, batch, cell % 1000 AS barcode FROM cells)
SELECT a.context AS a, b.context AS b, count(*) AS shared FROM b a JOIN b ON a.barcode = b.barcode AND a.batch = b.batch AND a.context < b.context GROUP BY 1, 2""")
def cell_id_overlap(spark, sf_dir):
    b = cells(spark, sf_dir).select("context", "batch", (F.col("cell") % 1000).alias("barcode")).distinct()
    l_, r_ = b.select(F.col("context").alias("a"), "batch", "barcode"), b.select(F.col("context").alias("b"), "batch", "barcode")
    return l_.join(r_, ["batch", "barcode"]).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


@query(f"""WITH {RESP}, l AS (SELECT * FROM resp WHERE n_cells >= 15), r AS (SELECT context, perturbation, gene, CASE WHEN gene = 'SMALL' THEN delta + 1 ELSE delta END AS delta FROM resp WHERE n_cells <= 70)
SELECT count(*) FILTER (WHERE l.gene IS NOT NULL AND r.gene IS NOT NULL) AS both, count(*) FILTER (WHERE r.gene IS NULL) AS left_only, count(*) FILTER (WHERE l.gene IS NULL) AS right_only,
  count(*) FILTER (WHERE abs(l.delta - r.delta) > 0) AS differing, round(max(abs(l.delta - r.delta)), 6) AS largest FROM l FULL JOIN r USING (context, perturbation, gene)""")
def matrix_diff(spark, sf_dir):
    x = responses(spark, sf_dir)
    other = x.filter("n_cells <= 70").withColumn("delta", F.when(F.col("gene") == "SMALL", F.col("delta") + 1).otherwise(F.col("delta")))
    return C.difference(x.filter("n_cells >= 15"), other, ["context", "perturbation", "gene"], "delta").withColumn("largest", r6("largest"))


RATIO = """rt AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, abs(s_acctbal) AS num, abs(s_acctbal) + s_nationkey * 100 AS den FROM supplier)"""


def ratio_rows(spark, sf_dir):
    s = in_order(table(spark, sf_dir, "supplier"), [], "s_suppkey", "s_suppkey")
    return s.select((F.col("position") - 1).alias("pos"), F.abs("s_acctbal").alias("num"), (F.abs("s_acctbal") + F.col("s_nationkey") * 100).alias("den"))


@query(f"""WITH {RATIO}, n AS (SELECT count(*) AS n FROM rt), pk AS (SELECT d, ('0x' || substr(md5('29:' || d || ':' || s), 1, 8))::BIGINT % n AS pos FROM range(200) a(d), n, unnest(range(n)) b(s)),
m AS (SELECT d, 1 - sum(num) / sum(den) AS m FROM pk JOIN rt USING (pos) GROUP BY 1)
SELECT (SELECT round(1 - sum(num) / sum(den), 6) FROM rt) AS estimate, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def bootstrap_ratio_ci(spark, sf_dir):
    b = R.bootstrap_ratio(ratio_rows(spark, sf_dir), "num", "den", 200, 29)
    return b.select(*[r6(c).alias(c) for c in b.columns])


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS pos, (s_nationkey % 2)::INT AS flag, s_acctbal AS value FROM supplier),
d AS (SELECT d, pos, value, row_number() OVER (PARTITION BY d ORDER BY md5('31:' || d || ':' || pos), pos) AS k FROM p, range(200) a(d)),
m AS (SELECT d.d, avg(CASE WHEN f.flag = 1 THEN d.value END) - avg(CASE WHEN f.flag = 0 THEN d.value END) AS v FROM d JOIN p f ON f.pos = d.k GROUP BY 1),
o AS (SELECT avg(CASE WHEN flag = 1 THEN value END) - avg(CASE WHEN flag = 0 THEN value END) AS observed FROM p)
SELECT round(any_value(observed), 6) AS observed, round(avg(v), 6) AS null_mean, round(stddev_samp(v), 6) AS null_sd, round((count(*) FILTER (WHERE v >= observed) + 1) / (count(*) + 1), 6) AS p FROM m, o""")
def permutation_p(spark, sf_dir):
    s = in_order(table(spark, sf_dir, "supplier"), [], "s_suppkey", "s_suppkey")
    rows = s.select(F.col("position").alias("pos"), (F.col("s_nationkey") % 2).cast("int").alias("flag"), F.col("s_acctbal").alias("value"))
    t = R.permutation_test(rows, "flag", "value", 200, 31)
    return t.select(*[r6(c).alias(c) for c in t.columns])


@query(f"""WITH {RESP}, e AS (SELECT context, quantile_cont(delta, [1.0 / 3, 2.0 / 3]) AS e FROM resp GROUP BY 1),
t AS (SELECT context, CASE WHEN delta <= e[1] THEN 0 WHEN delta <= e[2] THEN 1 ELSE 2 END AS tercile, n_cells FROM resp JOIN e USING (context))
SELECT coalesce(context, 'ALL') AS context, tercile, count(*) AS n, round(avg(n_cells), 6) AS cells FROM t GROUP BY GROUPING SETS ((context, tercile), (tercile))""")
def grouping_set_terciles(spark, sf_dir):
    r = responses(spark, sf_dir)
    e = r.groupBy("context").agg(F.expr("percentile(delta, array(1.0D/3, 2.0D/3))").alias("e"))
    code = F.when(F.col("delta") <= F.col("e")[0], 0).when(F.col("delta") <= F.col("e")[1], 1).otherwise(2)
    t = r.join(F.broadcast(e), "context").select("context", code.alias("tercile"), "n_cells")
    g = t.groupingSets([["context", "tercile"], ["tercile"]], "context", "tercile").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("n_cells")).alias("cells"))
    return g.select(F.coalesce("context", F.lit("ALL")).alias("context"), "tercile", "n", "cells")


@query("""WITH c AS (SELECT DISTINCT r_name AS c FROM region) SELECT t.c AS target, s.c AS source FROM c t JOIN c s ON t.c <> s.c""")
def leave_one_out_folds(spark, sf_dir):
    c = table(spark, sf_dir, "region").select("r_name").distinct()
    return c.select(F.col("r_name").alias("target")).crossJoin(c.select(F.col("r_name").alias("source"))).filter("target != source")


@query("""WITH k AS (SELECT c_custkey, sha256(c_name) AS h FROM customer)
SELECT c_custkey, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT AS seed FROM k""")
def key_seeds(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", seed_for(F.col("c_name")).alias("seed"))


@query("""WITH f AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS v FROM events GROUP BY ALL)
SELECT user_id, event_type, v IS NULL AS missing, round(coalesce(v, avg(v) OVER (PARTITION BY event_type)), 6) AS filled,
  round((v - avg(v) OVER (PARTITION BY event_type)) / stddev_pop(v) OVER (PARTITION BY event_type), 6) AS z FROM f""")
def standardised_features(spark, sf_dir):
    own = Window.partitionBy("event_type")
    f = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    z = (F.col("v") - F.avg("v").over(own)) / F.stddev_pop("v").over(own)
    return f.select("user_id", "event_type", F.col("v").isNull().alias("missing"), r6(F.coalesce("v", F.avg("v").over(own))).alias("filled"), r6(z).alias("z"))


@query(f"""WITH {CELLS}, q AS (SELECT context, perturbation, row_number() OVER (PARTITION BY context, perturbation ORDER BY md5('37:' || cell), cell) AS nth FROM cells)
SELECT context, perturbation, max(nth) AS kept FROM q WHERE nth <= 50 GROUP BY ALL""")
def anchor_draw(spark, sf_dir):
    q = R.shuffled(cells(spark, sf_dir), ["context", "perturbation"], draw_key(37, F.col("cell").cast("string")))
    return q.filter("nth <= 50").groupBy("context", "perturbation").agg(F.max("nth").cast("bigint").alias("kept"))
