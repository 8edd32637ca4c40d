"""Neighbours against the comparison of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import neighbours as N
from tesserae.operators.neighbours import all_nearest, exact_nearest, searched
from tesserae.plans import scoring

SCHEMA = "id long, vec array<double>"


def brute(q, r, k):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    ids = sorted(r)
    y = unit(np.array([r[i] for i in ids]))
    out = set()
    for name, v in q.items():
        cos = np.round(unit(np.array([v])) @ y.T, 6)[0]
        ranked = sorted((-c, i) for c, i in zip(cos, ids, strict=True) if i != name)
        out |= {(name, i, p, round(-c, 6) + 0.0) for p, (c, i) in enumerate(ranked[:k], 1)}
    return out


def frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in m.items()], SCHEMA)


@pytest.mark.parametrize(("kind", "k", "centres", "block"), [("clustered", 5, 16, 20), ("uniform", 3, 8, 1000), ("ties", 4, 5, 7), ("few", 9, 256, 2048)])
def test_neighbours_equal_all_pairs(spark, kind, k, centres, block):
    rng = np.random.default_rng(len(kind))
    n = 6 if kind == "few" else 600
    if kind == "clustered":
        m = rng.normal(size=(12, 10))[rng.integers(0, 12, n)] + rng.normal(size=(n, 10)) * 0.05
    elif kind == "ties":
        m = rng.integers(-1, 2, size=(n, 3)).astype(float)  # copies, opposite and empty vectors
    else:
        m = rng.normal(size=(n, 5))
    r = dict(enumerate(m))
    q = {i: v for i, v in r.items() if i % 40 == 0} | {-1: np.zeros(m.shape[1]), -2: m[0] * 3}
    got = exact_nearest(frame(spark, q), frame(spark, r), k, centres=centres, block=block).collect()
    assert {(x.query_id, x.ref_id, x.position, round(x.cos, 6) + 0.0) for x in got} == brute(q, r, k)
    if kind == "clustered":
        s = searched(frame(spark, {i: v for i, v in q.items() if i >= 0}), frame(spark, r), k, centres=centres, block=block).collect()
        assert np.mean([x.searched / x.of for x in s]) < 0.5


def test_without_references_or_queries(spark):
    q = frame(spark, {1: np.ones(3)})
    assert exact_nearest(q, spark.createDataFrame([], SCHEMA), 3).count() == 0
    assert exact_nearest(spark.createDataFrame([], SCHEMA), q, 3).count() == 0


def test_tasks_hold_few_queries_and_hand_on_few_rows(spark, monkeypatch):
    """Every query asks every part: the rows for that leave a task in pieces, and queries meet a part in turns."""
    monkeypatch.setattr(N, "ASKING", 9)
    rng = np.random.default_rng(4)
    r = dict(enumerate(rng.normal(size=(400, 6))))
    q = {i: v for i, v in r.items() if i % 10 == 0}
    s = N.Search(frame(spark, q), frame(spark, r), 3, 6, 4, 20)
    assert s.turns == 5
    asked = s.asked(s.query, True).union(s.asked(s.later(s.matched(s.asked(s.query, True))), False))
    assert asked.count() > N.TOGETHER
    assert asked.groupBy("cluster", "part", "turn").count().agg(F.max("count")).first()[0] < 20
    got = exact_nearest(frame(spark, q), frame(spark, r), 3, centres=4, block=20).collect()
    assert {(x.query_id, x.ref_id, x.position, round(x.cos, 6) + 0.0) for x in got} == brute(q, r, 3)


@pytest.mark.parametrize(("kind", "held", "cells"), [("uniform", 8 * 5 * 97, 3000), ("ties", 8 * 3 * 150, 500), ("few", 2**24, 2**21)])
def test_every_vector_asks_all_others(spark, monkeypatch, kind, held, cells):
    monkeypatch.setattr(N, "CELLS", cells)
    rng = np.random.default_rng(len(kind))
    n = 4 if kind == "few" else 600
    m = rng.integers(-1, 2, size=(n, 3)).astype(float) if kind == "ties" else rng.normal(size=(n, 5))  # copies, opposite and empty vectors
    r = {3 * i - 50: v for i, v in enumerate(m)}
    got = all_nearest(frame(spark, r), 5, held=held).collect()
    assert {(x.query_id, x.ref_id, x.position, round(x.cos, 6) + 0.0) for x in got} == brute(r, r, 5)
    names = all_nearest(frame(spark, r).withColumn("id", F.concat(F.lit("v"), F.col("id") + 50)), 5, held=held).collect()
    assert {(x.query_id, x.ref_id) for x in names if x.position == 1 and kind == "uniform"} <= {(f"v{q + 50}", f"v{i + 50}") for q, i, p, _ in brute(r, r, 5) if p == 1}
    assert len(names) == len(got)


def test_without_vectors_none_is_near(spark):
    assert all_nearest(spark.createDataFrame([], SCHEMA), 3).count() == 0
    assert all_nearest(frame(spark, {1: np.ones(3)}), 3).count() == 0


def test_topk_answers_for_every_vector(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    got = scoring.Q["knn_topk_cosine"](spark, sf).groupBy("query_id").count().collect()
    assert {(r.query_id, r["count"]) for r in got} == {(i, 5) for i in want}


def test_cosines_closer_than_single_precision_are_told_apart(monkeypatch):
    """Vectors around one direction: single precision can not order them, and the candidates come in pieces."""
    monkeypatch.setattr(N, "EXACT", 7)
    rng = np.random.default_rng(6)
    n = 200
    y, ids = N._scaled(np.ones((n, 64)) + rng.normal(size=(n, 64)) * 3e-5), np.arange(n)
    pairs = np.einsum("ij,ij->i", np.repeat(y, n, axis=0), np.tile(y, (n, 1))).reshape(n, n)
    np.fill_diagonal(pairs, -2)
    for digits in (6, 12):
        name, ref, cos = N._closest(y, ids, y, ids, 4, digits)
        want = np.lexsort((np.tile(ids, (n, 1)), -np.round(pairs, digits)), axis=1)[:, :4]
        assert (name.reshape(n, 4) == ids[:, None]).all() and (ref.reshape(n, 4) == want).all()
        assert (cos.reshape(n, 4) == np.take_along_axis(pairs, want, axis=1)).all()
