"""Quantiles by selection against numpy, with ties, missing values and many groups."""

import numpy as np
import pytest

from tesserae.operators import quantiles
from tesserae.operators.quantiles import exact_quantiles

SHARES = (0.0, 0.05, 1 / 3, 0.5, 0.75, 0.999, 1.0)


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quantiles_equal_numpy(spark, accuracy):
    rng = np.random.default_rng(1)
    values = {
        "normal": rng.normal(size=5000), "ties": rng.integers(0, 4, 3000).astype(float), "one": np.array([2.5]), "two": np.array([-1.0, 1.0]), "same": np.full(700, -0.0),
        None: rng.exponential(size=999) ** 4, "wide": np.concatenate(([-np.inf, np.inf], rng.normal(size=50))), "few": rng.normal(size=7),
    }
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("normal", None), ("normal", float("nan")), ("nothing", None)]
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", SHARES, accuracy).collect()}
    assert set(got) == set(values)
    for k, x in values.items():
        s = np.sort(x)
        at = (len(s) - 1) * np.array(SHARES)
        low, high = s[np.floor(at).astype(int)], s[np.minimum(np.floor(at).astype(int) + 1, len(s) - 1)]
        want = np.where(low == high, low, (1 - at % 1) * low + (at % 1) * np.where(np.isfinite(high), high, np.sign(high) * 1e308))
        fine = np.isfinite(want) & np.isfinite(high)
        assert got[k].n == len(x) and np.allclose(np.array(got[k].q)[fine], want[fine], rtol=1e-12)


def test_no_groups_many_groups_and_nothing(spark, monkeypatch):
    rows = spark.range(10_001).selectExpr("id % 50 as g", "double(id) as v")
    assert exact_quantiles(rows, [], "v", (0.25, 0.5)).first().q == [2500.0, 5000.0]
    monkeypatch.setattr(quantiles, "HELD_GROUPS", 3)  # joined instead of held
    got = {r.g: r.q for r in exact_quantiles(rows, ["g"], "v", (0.5,)).collect()}
    assert len(got) == 50 and all(np.isclose(q[0], np.median(np.arange(g, 10_001, 50))) for g, q in got.items())
    assert exact_quantiles(rows.filter("v < 0"), ["g"], "v", (0.5,)).count() == 0


def test_no_task_holds_a_group(spark):
    plan = exact_quantiles(spark.range(1000).selectExpr("id % 2 as g", "double(id) as v"), ["g"], "v", (0.5,))._jdf.queryExecution().toString()
    assert " percentile(" not in plan and "partial_count" in plan
