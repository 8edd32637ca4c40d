"""Positions in a global order: empty tables, one partition, missing and repeated values."""

import math

import pytest

from tesserae.operators.order import in_order

SCHEMA = "grp string, by double, id long, x double"


def brute(rows, descending):
    out, of = {}, {}
    for r in rows:
        of.setdefault(r[0], []).append(r)
    for own in of.values():
        gone = lambda v: v is None or math.isnan(v)
        ranked = sorted(own, key=lambda r: (gone(r[1]), 0 if gone(r[1]) else (-r[1] if descending else r[1]), r[2]))
        total = 0.0
        for i, r in enumerate(ranked, 1):
            total += r[3]
            out[r[2]] = (i, len(own), total)
    return out


@pytest.fixture
def width(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("width", ["1", "2", "7"], indirect=True)
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["mixed", "shared", "missing", "few"])
def test_positions(spark, width, descending, kind):
    values = {
        "mixed": [0.0, -0.0, float("inf"), float("-inf"), float("nan"), None, 1.5, -2.5, 1e300],
        "shared": [3.0] * 8 + [2.0, 4.0],
        "missing": [None, float("nan")],
        "few": [1.0],
    }[kind]
    rows = [(("a", "b", None)[i % 3], values[(i * 7) % len(values)], i, float(i)) for i in range(1 if kind == "few" else 200)]
    got = in_order(spark.createDataFrame(rows, SCHEMA), ["grp"], "by", "id", carry="x", descending=descending).collect()
    assert {r.id: (r.position, r.size, r.running) for r in got} == brute(rows, descending)


@pytest.mark.parametrize("width", ["1", "5"], indirect=True)
def test_empty_table(spark, width):
    out = in_order(spark.createDataFrame([], SCHEMA), ["grp"], "by", "id", carry="x")
    assert out.count() == 0 and out.columns == ["grp", "by", "id", "x", "size", "position", "running"]


def test_a_value_that_most_rows_share_is_cut_by_its_ties(spark):
    rows = spark.range(40_000).selectExpr("'a' as grp", "case when id % 10 = 0 then double(id) else -1.0 end as by", "id", "1.0D as x")
    out = in_order(rows, ["grp"], "by", "id")
    parts = out.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    assert max(r["count"] for r in parts) < 30_000
    assert out.filter("by = -1").selectExpr("max(position) = count(1)").first()[0]
