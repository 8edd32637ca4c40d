"""Removed words against a count of all windows, with shifted copies, forced collisions and many chunks."""

import random
import re
from collections import Counter

import pytest

from tesserae.llm.block_dedup import Words, substring_dedup

SCHEMA = "doc_id long, text string, chunk long, removed string, words string"


def brute(texts, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed, window):
    rng = random.Random(seed)
    word = lambda: rng.choice(["aé", "b", "İc", "D,", "e\x00f", "日本"]) + str(rng.randrange(10**6))
    passages = [[word() for _ in range(n)] for n in (window - 1, window, window + 1, 2 * window, 5 * window)]
    texts = [None, "", " \t\n", "one", " ".join(word() for _ in range(window))]
    for _ in range(60):
        words = [word() for _ in range(rng.randrange(3 * window))]
        for p in rng.sample(passages, rng.randrange(3)):
            k = rng.randrange(len(words) + 1)
            words[k:k] = p
        texts.append("".join(w + rng.choice([" ", "  ", "\n", "\t", "\r\n"]) for w in words))
    texts += texts[-3:]
    texts.append(" ".join(["same"] * (3 * window)))  # overlaps itself
    texts.append(" ".join(passages[4] + [word()] + passages[4]))  # twice in one document
    a, b = passages[3], [word() for _ in range(window // 2)]
    texts.append(" ".join(b + a[: window // 2] + [word()] + a))  # a block occurs, the window does not
    return texts


@pytest.mark.parametrize(("seed", "window", "strength", "chunk"), [(1, 35, 64, 1 << 22), (2, 35, 3, 900), (3, 8, 5, 400), (4, 8, 64, 1), (5, 3, 2, 2000)])
def test_removed_words_equal_brute_force(spark, seed, window, strength, chunk):
    texts = corpus(seed, window)
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in substring_dedup(docs, window=window, strength=strength, chunk_bytes=chunk).collect()}
    want = brute(texts, window)
    assert len(got) == len(texts) and sum(n for _, n, _ in want) > 0
    for i, (n, removed, kept) in enumerate(want):
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_text) == (n, removed, kept)
        spans = list(zip(r.removed[::2], r.removed[1::2], strict=True))
        assert sum(z - a for a, z in spans) == removed and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_empty_table_and_null_ids(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    got = substring_dedup(spark.createDataFrame([(None, text, 1, "", ""), (None, text, 1, "", ""), (3, None, 1, "", "")], SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == [("3", 0, 0, ""), ("None", 40, 40, ""), ("None", 40, 40, "")]


def test_words_of_any_length_keep_their_places():
    w = Words([b"a  bb", b"", b"\tc" * 3, b"x" * 3_000_000 + b" y"])
    assert w.count.tolist() == [2, 0, 3, 2] and [w.data[a:z][:3] for a, z in zip(w.starts, w.stops, strict=True)] == [b"a", b"bb", b"c", b"c", b"c", b"xxx", b"y"]
    h = w.hashes(1)
    assert h[2] == h[3] == h[4] and len(set(h.tolist())) == 5
