"""Panel intake on small files, and statistics with several covariates against dense arithmetic."""

import gzip
import json

import numpy as np
import pytest

from tesserae.operators import stats as X
from tesserae.sources import panel as P


def entry(name, key="a", status="GREEN", qualification="qualified", role="main", place=1):
    return dict(name=name, licensing_key=key, license_status=status, qualification=qualification, role=role, kind="k", place=place)


def test_registry_checks_licences(spark, tmp_path):
    statuses = spark.createDataFrame([("a", "GREEN"), ("b", "BLOCKED")], "licensing_key string, status string")

    def read(*entries):
        (tmp_path / "r.json").write_text(json.dumps({"sources": entries}))
        return P.read_registry(spark, str(tmp_path / "r.json"), statuses)

    good = read(entry("two", place=2), entry("one"), entry("x", "b", "BLOCKED", role="audit"), entry("y", "c", "UNKNOWN", role="audit"))
    assert [r.name for r in P.sources_of(good, "main").collect()] == ["one", "two"]
    with pytest.raises(Exception, match="registry says one is GREEN, known is BLOCKED"):
        read(entry("one", "b")).collect()
    with pytest.raises(Exception, match="duplicate source names"):
        read(entry("one"), entry("one")).collect()
    for bad in (entry("one", "b", "BLOCKED"), entry("one", qualification="open")):
        with pytest.raises(Exception, match="one is registered as main but is not"):
            P.sources_of(read(bad), "main").collect()


def test_checksums_and_counts(spark, tmp_path):
    (tmp_path / "sums").write_text("ab12  dir/a b.txt\n\ncd34 *c.bin\n")
    assert {tuple(r) for r in P.read_checksums(spark, str(tmp_path / "sums")).collect()} == {("dir/a b.txt", "ab12"), ("c.bin", "cd34")}
    (tmp_path / "j").write_text(json.dumps({"obs_values": {"gene_target": {"categories": ["A", "B"], "counts": [30, 5]}}}))
    (tmp_path / "m").write_text("gene  cell_count other\nA 12 x\nB   40 y\n")
    (tmp_path / "c").write_text("gene_target,n_cells\nA,25\nC,3\n")
    with gzip.open(tmp_path / "g.gz", "wt") as f:
        f.write(">A_1\nACGT\n>A_2\nAC\n>D\nGG\n")
    read = lambda name, kind: {tuple(r) for r in P.read_target_counts(spark, str(tmp_path / name), kind).collect()}
    assert read("j", "coverage_obs_json") == {("A", 30.0), ("B", 5.0)} and read("m", "coverage_manifest") == {("A", 12.0), ("B", 40.0)}
    assert read("c", "coverage_counts_csv") == {("A", 25.0), ("C", 3.0)} and read("g.gz", "coverage_guide_library") == {("A", None), ("D", None)}
    table = spark.createDataFrame
    counts = table([("j", "A", 30.0), ("j", "B", 5.0), ("g", "D", None)], "source string, target string, cells double")
    usable = table([("s1", "A"), ("s2", "A"), ("s1", "B")], "source string, target string")
    got = P.coverage_audit(table([("A",), ("B",), ("D",), ("E",)], "target string"), usable, counts).collect()
    assert {(r.target, r.n_sources, tuple(r.audits)) for r in got} == {("A", 2, ("j",)), ("B", 1, ()), ("D", 0, ("g",)), ("E", 0, ())}


def test_control_files(spark, tmp_path):
    for name, labels in (("x", ["A", "A"]), ("context_B", ["q"]), ("y", ["C"]), ("z", ["C", "D"]), ("w", ["D"])):
        spark.createDataFrame([(v,) for v in labels], "ctx string").toPandas().to_parquet(tmp_path / f"{name}.parquet")
    got = P.control_files(spark, str(tmp_path), ["A", "B", "C"], {"A": "x.parquet"}, "ctx")
    assert {c: (p.rsplit("/", 1)[1], how) for c, (p, how) in got.items()} == {
        "A": ("x.parquet", "named by manifest"), "B": ("context_B.parquet", "usual name"), "C": ("y.parquet", "only file of the context")
    }
    with pytest.raises(ValueError, match="0 files hold"):
        P.control_files(spark, str(tmp_path), ["E"], {}, "ctx")
    with pytest.raises(ValueError, match="is not in the folder"):
        P.control_files(spark, str(tmp_path), ["E"], {"E": "../x.parquet"}, "ctx")


def test_gene_axes(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0)], "cell long, gene string, value double")
    got = {(r.cell, r.gene, r.place) for r in P.select_genes(rows, ["c", "a"]).collect()}
    assert got == {(2, "c", 0), (1, "a", 1)}
    with pytest.raises(Exception, match="requested gene is absent: z"):
        P.select_genes(rows, ["a", "z"]).collect()
    symbols = spark.createDataFrame([("a", "S"), ("b", "S"), ("c", "T")], "feature string, symbol string")
    out = P.collapse_symbols(rows.withColumnRenamed("gene", "feature"), symbols)
    assert {tuple(r) for r in out.collect()} == {(1, "S", 3.0), (2, "T", 3.0)}


def ranks(v):
    order = np.argsort(v, kind="stable")
    out = np.empty(len(v))
    out[order] = np.arange(1, len(v) + 1)
    for u in np.unique(v):
        out[v == u] = out[v == u].mean()
    return out


def test_statistics_with_several_covariates(spark):
    rng = np.random.default_rng(3)
    n = 80
    k = np.round(rng.normal(size=(n, 2)), 1)
    x, y = k @ [1, -0.5] + rng.normal(size=n), k @ [0.3, 0.8] + rng.normal(size=n)
    src, pert = rng.integers(0, 3, n), rng.integers(0, 8, n)
    rows = [(str(pert[i]), f"s{src[i]}", float(x[i]), float(y[i]), float(k[i, 0]), float(k[i, 1]), "g", i) for i in range(n)]
    t = spark.createDataFrame([*rows, ("0", "s0", None, 1.0, 1.0, 1.0, "g", n), ("1", "s0", 1.0, 1.0, 1.0, 1.0, "few", n + 1)], "pert string, src string, x double, y double, k double, l double, g string, pos long")
    got = {r.g: r for r in X.partial_rank_correlation(t, ["g"], "x", "y", ["k", "l"]).collect()}
    d = np.column_stack((np.ones(n), ranks(k[:, 0]), ranks(k[:, 1])))
    res = [ranks(v) - d @ np.linalg.lstsq(d, ranks(v), rcond=None)[0] for v in (x, y)]
    assert np.isclose(got["g"].partial, np.corrcoef(*res)[0, 1]) and got["g"].n == n
    assert got["few"].partial is None or np.isnan(got["few"].partial)
    contrasts = {r.source: r.contrast for r in X.fixed_effect_contrasts(t.filter("x is not null and g = 'g'"), "pert", "src", "s1", "y", ["k", "x"]).collect()}
    design = np.column_stack([src == 0, src == 2, k[:, 0], x, *[pert == p for p in range(8)]]).astype(float)
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    assert np.isclose(contrasts["s0"], want[0]) and np.isclose(contrasts["s2"], want[1])
    full = t.filter("x is not null and g = 'g'").selectExpr("pos", "x score", "k other", "y q")
    r = X.paired_rank_difference(full, 100, 5).first()
    point = np.corrcoef(ranks(x), ranks(y))[0, 1] - abs(np.corrcoef(ranks(k[:, 0]), ranks(y))[0, 1])
    assert np.isclose(r.estimate, point) and r.low <= point <= r.high
