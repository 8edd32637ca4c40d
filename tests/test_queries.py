"""Every query with SQL against DuckDB on the smallest driver tables at which the grid is whole."""

import duckdb
import pytest

from tesserae.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return "~"
    if isinstance(value, bool) or not isinstance(value, (int, float)) and not hasattr(value, "__float__"):
        return str(value)
    return repr(round(float(value), 9) + 0.0)


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in table)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_flagship_shares_sum_to_one(spark):
    r = catalog.flagship(spark, "/root/testdata/sf0.001").first()
    assert abs(r.mu_share + r.alpha_share + r.beta_share + r.gamma_share - 1) < 1e-5


@pytest.mark.parametrize(("name", "scans"), [("per_gene_ridge", 0), ("anchored_estimators", 0), ("metric_terms", 2), ("mixed_panel_score", 0), ("spread_within_contexts", 0)])
def test_steps_read_what_is_kept_and_not_the_lines_again(spark, name, scans):
    leaves = catalog.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert sum("l_quantity" in leaves.apply(i).toString() for i in range(leaves.size())) <= scans
