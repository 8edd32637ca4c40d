"""The manifest against a direct recursion over lists."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tesserae.llm.merkle import fold, leaf_digest, merkle_manifest, visit

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string, pos int, tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def climb(digests):
    """Subroot and the siblings of every leaf, by levels."""
    proofs, owners, level = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(level) > 1:
        runs = [list(range(a, min(a + 16, len(level)))) for a in range(0, len(level), 16)]
        for run in runs:
            for n in run:
                for leaf in owners[n]:
                    proofs[leaf].append((run.index(n), "".join(level[m] for m in run if m != n)))
        owners = [[x for n in run for x in owners[n]] for run in runs]
        level = [h(*[level[n] for n in run]) for run in runs]
    return level[0], proofs


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = (own, *climb([leaf_of(r) for r in own]))
    root, above = climb([trees[s][1] for s in names])
    return sorted(
        (str(r[0]), leaf_of(r), trees[s][1], root, str(p + above[k])) for k, s in enumerate(names) for r, p in zip(trees[s][0], trees[s][2], strict=True)
    )


def table(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows, i = [], 0
    for source, n in sizes:
        for _ in range(n):
            text = rng.choice([None, "", "Ünï\ncode", "x" * 40_000 if i % 97 == 0 else f"Text {i}"])
            rows.append((i if i % 31 else None, source, rng.choice([None, "en"]), rng.choice([None, i]), text, "l", "r", 3, "t"))
            i += 1
    rows += rows[:3]  # repeated rows
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("sizes", [[("a", 1)], [("a", 17), (None, 1), ("b", 16)], [("é", 300), ("z", 257), ("", 5)], [(f"s{i}", 2) for i in range(40)] + [("s", 700)]])
def test_manifest_equals_recursion(spark, sizes):
    rows, docs = table(spark, sizes)
    got = merkle_manifest(docs).collect()
    mine = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, str([(s["index"], s["siblings"]) for s in r.proof])) for r in got)
    assert mine == brute(rows)


def test_proofs_lead_to_the_root_unless_a_leaf_changed(spark):
    _, docs = table(spark, [("a", 300), ("b", 3)])
    changed = leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.concat(F.col("text"), F.lit("!")))
    out = merkle_manifest(docs, extra={"other": changed}).select("leaf", "other", "root", fold(F.col("leaf"), F.col("proof")).alias("up"), fold(F.col("other"), F.col("proof")).alias("off"))
    for r in out.collect():
        assert r.up == r.root and (r.off == r.root) == (r.other == r.leaf)


def test_empty_table(spark):
    assert merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_last_run_of_one_is_hashed_again():
    leaves = [h(str(i)) for i in range(17)]
    steps = [[] for _ in leaves]
    assert visit(leaves, 0, 17, 2, steps) == climb(leaves)[0] and steps == climb(leaves)[1]
