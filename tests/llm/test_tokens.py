import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesserae.llm import packing
from tesserae.llm.encoder import Encoder
from tesserae.llm.packing import pack, plan_packing
from tesserae.llm.token_counts import split_safely, token_counts
from tesserae.llm.token_files import read_token_files, write_token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "Hello  World\n\tfoo's bar", "é́ ΣΑΣ <|endoftext|> x<|startoftext|>y", "a b　c\x1cd", "́x ́y",
    "hello world " * 3000, "x" * 70000, "<s> </s> <unk>  ▁a ▁", "日本語 テキスト", "trailing ",
]
ROWS = [(i, t, "z") for i, t in enumerate(TEXTS)] + [(None, "null id", "z"), (4, "Hello  World\n\tfoo's bar", "z")]
SCHEMA = "doc_id long, text string, n_tokens string"


def ids_of(text):
    return [*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_encoder_equals_library(texts):
    lib = Tokenizer.from_file(WORDS)
    enc = test_encoder_equals_library.__dict__.setdefault("enc", Encoder(WORDS))
    assert enc.by_word
    ids, offsets = enc.encode(pa.array(texts, pa.string()))
    assert [ids[a:z].tolist() for a, z in zip(offsets, offsets[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_counts_equal_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts(spark.createDataFrame(ROWS, SCHEMA), PIECES).collect()
    want = [(i, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 4096) for i, t, _ in ROWS]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    got = token_counts(spark.createDataFrame(ROWS, SCHEMA), WORDS).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, len(ids_of(t)) - 1) for i, t, _ in ROWS), key=str)
    assert token_counts(spark.createDataFrame([], SCHEMA), PIECES).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n▁é.", max_size=200))
def test_safe_split_keeps_counts(text):
    import sentencepiece

    lib = test_safe_split_keeps_counts.__dict__.setdefault("lib", sentencepiece.SentencePieceProcessor(model_file=PIECES))
    assert sum(len(lib.encode(p)) for p in split_safely(text, 10)) == len(lib.encode(text))


def test_token_files_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    manifest = write_token_files(df, WORDS)
    got = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in read_token_files(manifest, with_ids=True).collect()}
    want, at = set(), 0
    for i, t, _ in sorted(ROWS, key=lambda r: (-1 if r[0] is None else r[0])):
        ids = ids_of(t)
        want.add((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), tuple(ids)))
        at += len(ids)
    assert got == want
    assert read_token_files(write_token_files(spark.createDataFrame([], SCHEMA), WORDS)).count() == 0


def check_packing(rows, docs, capacity):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for i, t in docs:
        ids = ids_of(t)
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i])
        cuts = [ids[a : a + capacity] for a in range(0, len(ids), capacity)]
        assert own == [(k, k * capacity, len(c), zlib.crc32(np.array(c, dtype="<u4").tobytes())) for k, c in enumerate(cuts)]
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pack(spark, capacity):
    docs = [(i, t, "z") for i, t in enumerate(TEXTS)] + [(100 + i, "word " * (i % 37), "z") for i in range(300)]
    rows = pack(spark.createDataFrame(docs, SCHEMA), WORDS, capacity=capacity).collect()
    bins = check_packing(rows, [(i, t) for i, t, _ in docs], capacity)
    assert bins <= 1.02 * sum(r.length for r in rows) / capacity + 1
    assert pack(spark.createDataFrame([], SCHEMA), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_plan_places_every_piece_once(counts):
    c = np.zeros(51, dtype=np.int64)
    for n, k in counts.items():
        c[n] = k
    plan = plan_packing(c, 50)
    assert plan.used.tolist() == c.tolist()
    total = int((c * np.arange(51)).sum())
    assert plan.sequences <= 2 * total / 50 + 1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(1, 4)), max_size=7), st.integers(0, 10**6))
def test_index_of_sums(pieces, seed):
    rng = random.Random(seed)
    free = np.zeros(21, dtype=np.int64)
    for n, k in pieces:
        free[n] += k
    index = packing.SumIndex(free)
    for _ in range(5):
        there = np.flatnonzero(free)
        for total in range(21):
            ways = sum(1 for a in there for b in there if a + b == total and (a != b or free[a] > 1))
            assert index.pair[total] == ways
            singles = [x for n in there for x in [int(n)] * min(3, free[n])]
            some = any(sum(c) == total for k in (1, 2, 3) for c in set(itertools.combinations(singles, k)))
            found = index.complement(total)
            assert (found is not None) == some and (found is None or sum(found) == total)
        if not len(there):
            break
        n = rng.choice(there.tolist())
        index.take(np.array([n]), np.array([rng.randrange(1, int(free[n]) + 1)]))


def test_plan_is_no_worse_than_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(40, 700, 400)
        counts = np.bincount(lengths, minlength=1025)
        bins = []
        for n in sorted(lengths.tolist(), reverse=True):
            k = min((i for i, b in enumerate(bins) if b >= n), key=lambda i: bins[i], default=None)
            if k is None:
                bins.append(1024 - n)
            else:
                bins[k] -= n
        assert packing.plan_packing(counts, 1024).sequences <= len(bins)


def test_two_attempts_of_a_task_do_not_touch_each_other(spark, tmp_path, monkeypatch):
    import pyspark

    from tesserae.llm import token_files

    class Context:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 3

        def taskAttemptId(self):
            return self.attempt

    folder = f"file://{tmp_path}/files"
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": pa.array(["hello world", "x"])})
    opened = []

    def input_of(attempt):  # the second attempt runs whole while the first is in the midst of its file
        yield batch
        if attempt == 1:
            monkeypatch.setattr(pyspark.TaskContext, "get", lambda: Context(2))
            opened.extend(token_files._writer(WORDS, folder, 1)(iter([batch, batch])))
        yield batch

    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: Context(1))
    opened.extend(token_files._writer(WORDS, folder, 1)(input_of(1)))
    paths = [b["path"][0].as_py() for b in opened]
    assert len(set(paths)) == 2
    for path in paths:
        part = token_files.TokenFile(path)
        assert part.doc_ids.tolist() == [1, 2, 1, 2] and part.ids(0, 2).tolist() == ids_of("hello world") + ids_of("x")
    (tmp_path / "files" / f"{paths[0].rsplit('/', 1)[1]}.bin").unlink()  # the loser's files may go
    rows = spark.createDataFrame([(3, paths[1], 0)], "part long, path string, token_base long")
    assert [r.doc_id for r in read_token_files(rows).collect()] == [1, 2, 1, 2]
