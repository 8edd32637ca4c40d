"""Common table expressions of the checking SQL, one for each table of tesserae.sources.tables."""

OBS = """obs AS (SELECT r_name AS context, p_brand AS perturbation, p_type AS gene, l_returnflag AS flag, l_quantity AS value,
  l_extendedprice AS price, l_orderkey * 8 + l_linenumber AS cell, o_orderpriority AS batch
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN orders ON l_orderkey = o_orderkey)"""
RESP = OBS + """, resp AS (SELECT context, perturbation, gene, avg(value) AS delta, count(*) AS n_cells FROM obs GROUP BY ALL)"""
CELLS = """cells AS (SELECT o_orderkey AS cell, r_name AS context, c_mktsegment AS perturbation, o_orderpriority AS batch
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
expr AS (SELECT l_orderkey AS cell, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
genes AS (SELECT DISTINCT gene FROM expr)"""
PARTS = RESP + """, w AS (SELECT *, avg(delta) OVER (PARTITION BY gene) AS mu, avg(delta) OVER (PARTITION BY context, gene) AS by_c,
  avg(delta) OVER (PARTITION BY perturbation, gene) AS by_p FROM resp),
parts AS (SELECT context, perturbation, gene, delta, n_cells, mu, by_c - mu AS alpha, by_p - mu AS beta, delta - by_c - by_p + mu AS gamma FROM w)"""
