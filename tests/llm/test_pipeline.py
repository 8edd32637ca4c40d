"""The pipeline's stages, each on its own input, against brute force on a small table."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_components, brute_exact
from test_scans import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_language_keeps_the_corpus_and_drops_what_has_no_language(spark, docs):
    junk = spark.createDataFrame([(5000, "12345 67890", None, "s", 11), (5001, None, "en", "s", 0), (5002, "xqzj wvkpt " * 90, None, "s", 990)], docs.schema)
    out = stage("language ID")(spark, docs.union(junk), SF)
    ids = {i for i, _ in texts(out)}
    assert out.columns == COLUMNS and not ids & {5000, 5001, 5002} and len(ids) >= docs.count() - 2


def test_exact_stage(spark, docs):
    out = stage("exact dedup")(spark, docs, SF)
    assert out.columns == COLUMNS
    assert {i for i, _ in texts(out)} == {keep for _, keep, _, _ in brute_exact(texts(docs))}


def test_near_stage(spark, docs):
    some = texts(docs)[:250]
    rng = random.Random(4)
    near = [(9000 + i, " ".join(w for w in t.split(" ") if rng.random() > 0.01)) for i, t in some[:40]]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in some + near], docs.schema)
    out = stage("near dedup")(spark, table, SF)
    assert {i for i, _ in texts(out)} == {c for _, _, c in brute_components(some + near, 5, 80)}


def test_decontamination_stage(spark, docs):
    out = stage("decontamination")(spark, docs, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    some = texts(docs)[:120]
    bad = {r[0] for r in brute(some, items[:40], 10) if r[5]}
    kept = {i for i, _ in texts(out)}
    assert {i for i, _ in some} - kept == bad


def test_run_chains_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns)
    by = {}
    for r in out.collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def lorem(seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))


@pytest.fixture
def odd(spark, docs):
    """Rows of (doc_id, text) with two files' worth of partitions, in the columns of documents."""
    return lambda rows: spark.createDataFrame([(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(rows)], docs.schema).repartition(3)


def got(name, spark, table):
    out = stage(name)(spark, table, SF)
    assert out.columns == COLUMNS
    return sorted(texts(out), key=str)


def test_repeated_shared_and_null_ids_in_the_exact_stage(spark, odd):
    a, b, c, d = map(lorem, "abcd")
    rows = [(1, a)] * 3 + [(2, a), (None, a), (3, b), (3, c), (None, c), (None, d), (None, d), (4, None), (4, "")]
    out = got("exact dedup", spark, odd(rows))
    assert [x for x in out if x[1]] == sorted([(1, a), (3, b), (3, c), (None, d)], key=str)
    assert len(out) == 5


def test_repeated_shared_and_null_ids_in_the_near_stage(spark, odd):
    a, b, c, d = map(lorem, "abcd")
    rows = [(1, a)] * 3 + [(0, a + " more"), (3, b), (3, c), (3, c + " more"), (None, d), (None, d + " more"), (None, d), (None, b), (5, None), (5, None)]
    out = got("near dedup", spark, odd(rows))
    first = [x for x in out if x[0] in (0, 1)]
    assert first == [(0, a + " more")]
    assert sum(x == (3, b) for x in out) == 1 and sum(x[0] == 3 and x[1].startswith(c) for x in out) == 1
    assert sum(x[0] is None for x in out) == 1 and next(x[1] for x in out if x[0] is None).startswith(d)
    assert sum(x == (5, None) for x in out) == 2 and len(out) == 6


def test_shared_and_null_ids_are_decided_by_row_in_the_decontamination_stage(spark, odd):
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean, bad = lorem("x"), f"{lorem('y')} {passage} {lorem('z')}"
    out = got("decontamination", spark, odd([(1, clean), (1, bad), (None, clean), (None, bad), (2, bad), (3, clean), (3, clean)]))
    assert out == sorted([(1, clean), (None, clean), (3, clean), (3, clean)], key=str)


def test_shared_and_null_ids_are_decided_by_row_in_the_language_stage(spark, docs):
    good = docs.filter("n_chars > 500").limit(1).select("text").first().text
    junk = [(7001, good), (7001, "12345"), (None, good), (None, "!!")]
    extra = spark.createDataFrame([(i, t, None, "s", 0) for i, t in junk], docs.schema)
    out = stage("language ID")(spark, docs.union(extra), SF)
    assert sorted(texts(out.filter("doc_id = 7001 or doc_id is null")), key=str) == sorted([(7001, good), (None, good)], key=str)


def test_an_unlabelled_corpus_loses_only_texts_without_a_letter(spark, odd):
    rows = [(1, lorem("a")), (1, "12 34"), (None, lorem("b")), (2, None), (3, ""), (3, "x")]
    table = odd(rows).withColumn("lang", F.lit(None).cast("string"))
    assert got("language ID", spark, table) == sorted([(1, lorem("a")), (None, lorem("b")), (3, "x")], key=str)


def test_stages_take_empty_tables_and_clashing_columns(spark, docs):
    names = ["row", "rank", "digest", "keep_id", "component_id", "t1", "spans", "n_words", "text_sha256", "rejected"]
    more = docs.limit(40).withColumns({c: F.lit(7) for c in names})
    for name, run in corpus_pipeline.STAGES:
        for table in (docs.limit(0), more):
            out = run(spark, table, SF)
            assert out.count() == 0 if table is not more else out.count() > 0
            if name != "packing":
                assert out.columns == table.columns
