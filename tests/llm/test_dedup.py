import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm.components import components
from tesserae.llm.exact_dedup import exact_dedup
from tesserae.llm.jaccard_join import SignatureTree, jaccard_join, routing_keys
from tesserae.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string, lang string, keep_id string, component_id string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, "x", "y") for i, t in texts], SCHEMA)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(texts, width, percent):
    sets = {i: shingles(t, width) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {(i, len(s), find(i)) for i, s in sets.items()}


def family(rng, n, size, edits, start):
    base = [f"w{rng.randrange(400)}" for _ in range(size)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append((start + i, " ".join(words[: size - rng.randrange(3)])))
    return out


@pytest.mark.parametrize(("width", "percent", "tile"), [(4, 85, 1024), (5, 80, 1024), (3, 60, 7)])
def test_jaccard_join_equals_brute_force(spark, width, percent, tile):
    rng = random.Random(width)
    texts = family(rng, 60, 120, 9, 0) + family(rng, 40, 30, 3, 100) + family(rng, 30, 700, 30, 200) + family(rng, 40, 9, 1, 300)
    line = "one very common line of eight words here"
    texts += [(400 + i, line + " " + " ".join(f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(12)))) for i in range(60)]
    texts += [(500, None), (501, ""), (502, " \n"), (503, "a"), (504, "A"), (505, "a b"), (506, "long " * 9000), (507, "LONG\t" * 9000)]
    got = jaccard_join(frame(spark, texts), width=width, percent=percent, tile_docs=tile)
    assert {tuple(r) for r in got.collect()} == brute_components(texts, width, percent)


def test_jaccard_join_odd_input(spark):
    assert jaccard_join(frame(spark, [])).count() == 0
    twice = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "only here"), (3, "x"), (3, "y")]
    got = jaccard_join(frame(spark, twice)).collect()
    want = [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 3), (3, 1, 3), (None, 1, None), (None, 2, 1)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300), st.integers(0, 40), st.integers(0, 40), st.integers(0, 10**6), st.sampled_from([60, 80, 85, 95]))
def test_linking_sets_share_a_key(size, less, more, seed, percent):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    b = np.union1d(a[min(less, len(a) - 1) :], rng.integers(0, 2**64, more, dtype=np.uint64))
    keys, owner = routing_keys(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), percent)
    common = len(np.intersect1d(a, b))
    if 100 * common >= percent * (len(a) + len(b) - common) and not np.array_equal(a, b):
        assert np.intersect1d(keys[owner == 0], keys[owner == 1]).size
    if len(a) + len(b) > 100:  # alone or together makes no difference
        alone, _ = routing_keys(a, np.array([0, len(a)]), percent)
        assert np.array_equal(np.sort(alone), np.sort(keys[owner == 0]))


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 30), st.integers(0, 4), st.integers(0, 4), st.integers(0, 10**6), st.sampled_from([60, 80, 85, 95]))
def test_small_linking_sets_share_a_key(size, less, more, seed, percent):
    test_linking_sets_share_a_key.hypothesis.inner_test(size, less, more, seed, percent)


@pytest.mark.parametrize(("low", "high", "percent"), [(6, 13, 85), (5, 13, 80), (12, 40, 85), (12, 40, 80)])
def test_unrelated_short_sets_share_no_key(low, high, percent):
    rng = np.random.default_rng(high)
    n = rng.integers(low, high, 100_000)
    hashes = rng.integers(0, 2**64, n.sum(), dtype=np.uint64)
    bounds = np.concatenate(([0], np.cumsum(n)))
    order = np.lexsort((hashes, np.repeat(np.arange(len(n)), n)))
    keys, owner = routing_keys(hashes[order], bounds, percent)
    _, times = np.unique(keys, return_counts=True)
    assert times.max() <= 2 and len(keys) <= 40 * len(n)


def test_a_common_line_in_short_texts_makes_no_hot_key():
    rng = np.random.default_rng(3)
    line = rng.integers(0, 2**64, 5, dtype=np.uint64)
    sets = [np.unique(np.concatenate((line, rng.integers(0, 2**64, 7, dtype=np.uint64)))) for _ in range(20_000)]
    keys, _ = routing_keys(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))), 85)
    assert np.unique(keys, return_counts=True)[1].max() <= 100  # 0.5 % of them


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([60, 85]))
def test_tree_loses_no_pair(seed, percent):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 80, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(20, 80)), rng.integers(0, 2**64, rng.integers(0, 30), dtype=np.uint64)))) for _ in range(60)]
    u, v = SignatureTree(sets).candidates(percent)
    found = {tuple(sorted(p)) for p in zip(u.tolist(), v.tolist())}
    for i in range(60):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                assert (j, i) in found


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200 + rng.randrange(80), 200 + rng.randrange(80)) for _ in range(50)]
    root = {}
    for a, b in edges:
        if a != b:
            x, y = root.setdefault(a, {a}), root.setdefault(b, {b})
            if x is not y:
                x |= y
                for n in y:
                    root[n] = x
    got = {(r.node, r.component) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(n, min(s)) for n, s in root.items()}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_exact(texts):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in texts]
    out = []
    for (i, _), n in zip(texts, norm):
        group = [(-len(t or ""), j is None, j) for (j, t), m in zip(texts, norm) if m == n]
        out.append((i, min(group)[2], len(group), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup(spark):
    rng = random.Random(0)
    texts = [(i, rng.choice(["a b", "ab", "a b", " ab ", None, "", " ", "é́", "hot text " + " " * (i % 3)])) for i in range(300)]
    texts += [(400 + i, "the hot one") for i in range(500)] + [(7, "a b"), (None, "ab"), (1000, "x" * 200000), (1001, "x " * 200000)]
    got = exact_dedup(frame(spark, texts)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(texts)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup(frame(spark, [])).count() == 0


def brute_lines(texts, window):
    lines = {i: (t or "").split("\n") for i, t in texts}
    seen, gone = set(), {i: set() for i in lines}
    for i in sorted(lines):
        for p in range(len(lines[i]) - window + 1):
            w = tuple(lines[i][p : p + window])
            if w in seen:
                gone[i] |= set(range(p, p + window))
            seen.add(w)
    return {(i, len(x), len(gone[i]), "\n".join(y for k, y in enumerate(x) if k not in gone[i])) for i, x in lines.items()}


def test_line_dedup(spark):
    rng = random.Random(3)
    texts = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(12)))) for i in range(80)]
    texts += [(90, None), (91, ""), (92, "x\ny"), (93, "q\n" * 5000), (94, "all\nthree\nlines"), (95, "all\nthree\nlines")]
    assert {tuple(r) for r in line_dedup(frame(spark, texts)).collect()} == brute_lines(texts, 3)
    assert line_dedup(frame(spark, [])).count() == 0
    odd = [(None, "p\nq\nr"), (1, "p\nq\nr"), (1, "p\nq\nr")]
    got = sorted(((r.doc_id, r.n_removed) for r in line_dedup(frame(spark, odd)).collect()), key=str)
    assert got == [(1, 3), (1, 3), (None, 0)]
