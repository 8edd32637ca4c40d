import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import suffix_dedup as s

SCHEMA = "doc_id long, text string, t1 string, start string"


def brute(texts, length):
    """By text position: (start, stop) runs that go."""
    raw = [(t or "").encode() for t in texts]
    places = {}
    for i, r in enumerate(raw):
        for p in range(len(r) - length + 1):
            places.setdefault(r[p : p + length], []).append((i, p))
    gone = [np.zeros(len(r) + 1, dtype=bool) for r in raw]
    for where in places.values():
        if len(where) > 1:
            for i, p in where:
                gone[i][p : p + length] = True
    out = []
    for r, g in zip(raw, gone):
        kept = bytes(b for b, x in zip(r, g) if not x)
        out.append((len(r), int(g.sum()), int((g[1:] < g[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, **more):
    ids = list(range(len(texts)))
    got = s.suffix_dedup(spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts)], SCHEMA), **more).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}
    assert got == dict(zip(ids, brute(texts, more.get("length", s.LENGTH))))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def corpus(rng):
    passage, wide = words(rng, 60), words(rng, 45)
    texts = [words(rng, rng.randrange(5, 300)) for _ in range(60)]
    for i in range(0, 60, 3):
        k = rng.randrange(len(texts[i]))
        texts[i] = texts[i][:k] + rng.choice([passage, wide, passage[: rng.randrange(150, 320)]]) + texts[i][k:]
    near = words(rng, 200).split(" ")
    for _ in range(12):
        own = list(near)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(200)] = "EDIT" + str(rng.randrange(99))
        texts.append(" ".join(own))
    texts += [texts[0], texts[0], None, "", "short", "z" * 700, "ab" * 500, "z" * 199, "x" * 200, "q" * 201]
    texts += [words(rng, 50) + passage + words(rng, 5) + passage]
    return texts


def test_equals_brute_force(spark):
    check(spark, corpus(random.Random(5)))


def test_split_shards_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(s, "SHARD_BYTES", 3000)
    check(spark, corpus(random.Random(6)), split_rows=3)


def test_frequent_anchors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(s, "SAMPLE", 1.0)
    monkeypatch.setattr(s, "SAMPLED_OFTEN", 5)
    rng = random.Random(8)
    line, wide = words(rng, 14), words(rng, 60)
    texts = corpus(rng) + [words(rng, 20) + line + words(rng, 20) for _ in range(30)] + [words(rng, 9) + wide[: rng.randrange(210, 330)] + words(rng, 9) for _ in range(20)]
    check(spark, texts)
    check(spark, texts, split_rows=3)


def test_long_text_and_odd_input(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(s, "CHUNK", 3000)
    long = words(rng, 4000)
    check(spark, [long, long[5000:5400] + "!" + long[2990:3300], words(rng, 30), long[:250]])
    assert s.suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    t = words(rng, 100)
    got = s.suffix_dedup(spark.createDataFrame([(1, t, "", ""), (1, t, "", ""), (None, "other", "", "")], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in got), key=str) == [(1, len(t.encode())), (1, len(t.encode())), (None, 0)]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.lists(st.integers(1, 4), min_size=1, max_size=400), st.lists(st.just(3), max_size=900, min_size=1)), st.integers(1, 300))
def test_suffix_array_and_prefixes(symbols, depth):
    text = np.array(symbols, dtype=np.uint16)
    order = s.suffix_array(text, depth)
    assert sorted(order.tolist()) == list(range(len(text)))
    cut = [tuple(symbols[i : i + depth]) for i in order.tolist()]
    assert cut == sorted(cut)
    full = s.suffix_array(text, len(text) + 1)
    prefix = s.common_prefixes(text, full, 100)
    for k in range(1, len(text)):
        a, b = symbols[full[k - 1] :], symbols[full[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert prefix[k] == n or (n > 100 and prefix[k] >= min(n, 100))
