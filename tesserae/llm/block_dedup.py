"""Removal of long word sequences that occur elsewhere, from anchors at fixed blocks of the texts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tesserae.llm.common import fresh_dir, id_and_text, shuffle_width, stored
from tesserae.llm.shingles import BYTE, IS_SPACE, _powers, mix
from tesserae.llm.suffix_dedup import _inverse_powers

WINDOW = 35
CHUNK_BYTES = 4 << 20  # text whose words are looked at together
BUCKET_BYTES = 8 << 20  # text whose probes meet in one bucket, about
HASHED = 1 << 20
UP, DOWN = _powers(HASHED), _inverse_powers(HASHED)


class Words:
    """The words of a chunk's texts: bytes with one space between words and a line feed between texts, where words start and
    stop there, and the text of each."""

    def __init__(self, texts: list[bytes]) -> None:
        lines = [b" ".join(t.split()) for t in texts]  # bytes are split at 20 and 09-0D
        self.data = b"\n".join(lines)
        self.count = np.array([x.count(b" ") + 1 if x else 0 for x in lines], dtype=np.int64)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        edge = np.diff(np.concatenate(([0], (~IS_SPACE[raw]).view(np.int8), [0])).astype(np.int8))
        self.starts, self.stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self.first = np.cumsum(self.count) - self.count

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int) -> np.ndarray:
        raw, out, a = np.frombuffer(self.data, dtype=np.uint8), np.empty(len(self), dtype=np.uint64), 0
        while a < len(self):
            base = self.starts[a]
            z = max(a + 1, int(np.searchsorted(self.stops, base + HASHED, side="right")))
            n = int(self.stops[z - 1] - base)
            up, down = (UP, DOWN) if n <= HASHED else (_powers(n), _inverse_powers(n))
            upto = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(BYTE[raw[base : base + n]] * up[:n], dtype=np.uint64)))
            lo, hi = self.starts[a:z] - base, self.stops[a:z] - base
            out[a:z] = mix((upto[hi] - upto[lo]) * down[lo], seed + 50)
            a = z
        return out

    def windows(self, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the sequences of `width` words of one text start, and their hashes."""
        n = len(self) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        upto = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(self.hashes(seed) * _powers(len(self)), dtype=np.uint64)))
        value = mix((upto[width:] - upto[:-width]) * _inverse_powers(n), seed + 51)
        at = np.flatnonzero(self.text[:n] == self.text[width - 1 :])
        return at, value[at]


def leading(value: np.ndarray, strength: int) -> np.ndarray:
    """The leading bits of hashes."""
    return value >> np.uint64(64 - strength) << np.uint64(64 - strength)


def in_buckets(codes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Buckets of sorted 64-bit codes by their leading bits, with the range of codes in each."""
    if len(codes):
        bucket = codes >> np.uint64(64 - bits)
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(codes)], strict=True):
            yield int(bucket[a]), a, z


class Probes:
    """Every rolling block of a chunk as a sorted code of `bits` + 32 bits, and which are blocks at fixed places."""

    def __init__(self, words: Words, block: int, bits: int) -> None:
        self.at, value = words.windows(block, 0)
        aligned = (self.at - words.first[words.text[self.at]]) % block == 0
        self.codes = value >> np.uint64(32 - bits) << np.uint64(32 - bits)
        both = np.sort(self.codes | aligned.astype(np.uint64))
        heads = np.flatnonzero(np.append(True, both[1:] >> np.uint64(1) != both[:-1] >> np.uint64(1))) if len(both) else np.zeros(0, np.int64)
        size = np.diff(np.append(heads, len(both)))
        self.unique = both[heads] & ~np.uint64(1)
        self.several, self.anchor = size > 1, (both[heads + size - 1] & np.uint64(1)).astype(bool)

    def hits(self, bits: int, answers: list[dict], n_words: int) -> np.ndarray:
        """For each word, whether a block that is an anchor elsewhere starts there."""
        found = np.zeros(len(self.unique), dtype=bool)
        told = {a["bucket"]: a["answer"] for a in answers}
        for bucket, a, z in in_buckets(self.unique, bits):
            if bucket in told:
                found[a:z] = np.unpackbits(np.frombuffer(told[bucket], dtype=np.uint8), count=z - a)
        out = np.zeros(n_words, dtype=bool)
        wanted = self.unique[found]
        if len(wanted):
            place = np.minimum(np.searchsorted(wanted, self.codes), len(wanted) - 1)
            out[self.at[wanted[place] == self.codes]] = True
        return out


class Candidates:
    """Windows of a chunk that hold a hit, as sorted hashes."""

    def __init__(self, words: Words, hits: np.ndarray, window: int, block: int, seed: int, strength: int) -> None:
        at, value = words.windows(window, seed)
        held = np.concatenate(([0], np.cumsum(hits)))
        keep = held[at + window - block + 1] > held[at]
        at, value = at[keep], leading(value[keep], strength)
        order = np.argsort(value, kind="stable")
        self.at, self.value = at[order], value[order]
        self.heads = np.flatnonzero(np.append(True, self.value[1:] != self.value[:-1])) if len(order) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.heads, len(order)))
        self.unique = self.value[self.heads]


CHUNK_ROW = "chunk bigint, size bigint, ids array<{kind}>, texts array<string>"
PROBE_ROW = "bucket int, chunk bigint, keys binary, marks binary"
ANSWER_ROW = "chunk bigint, bucket int, answer binary"
ASK_ROW = "partner bigint, chunk bigint, start bigint, n bigint, words string"
RUN_ROW = "chunk bigint, start bigint, n bigint, equal boolean"


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


PROBE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("marks", pa.binary())])
ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary())])
ASK = pa.schema([("partner", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("words", pa.string())])
RUN = pa.schema([("chunk", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("equal", pa.bool_())])


def _chunks(kind: pa.DataType, most: int):
    """Whole texts, `most` bytes together; a longer text is a chunk of its own."""
    schema = pa.schema([("chunk", pa.int64()), ("size", pa.int64()), ("ids", pa.list_(kind)), ("texts", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            cols = [pa.concat_arrays([b[c] for b in held]) for c in ("doc_id", "text")]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols]
            out = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size]), *lists], schema=schema)
            held, size, number = [], 0, number + 1
            return out

        for batch in batches:
            a = 0
            for i, n in enumerate(pc.binary_length(batch["text"]).to_pylist()):
                if (held or a < i) and size + n > most:
                    if a < i:
                        held.append(batch.slice(a, i - a))
                    yield flush()
                    a = i
                size += n
            if a < len(batch):
                held.append(batch.slice(a))
        if held:
            yield flush()

    return run


def _each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1)
            yield row, Words([t.as_buffer().to_pybytes() for t in row["texts"].flatten()])


def _probe(block: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words in _each_chunk(batches):
            p, chunk = Probes(words, block, bits), row["chunk"][0].as_py()
            keys = (p.unique >> np.uint64(32 - bits) & np.uint64(0xFFFFFFFF)).astype("<u4")
            rows = [
                (b, chunk, keys[a:z].tobytes(), np.packbits(p.several[a:z]).tobytes() + np.packbits(p.anchor[a:z]).tobytes()) for b, a, z in in_buckets(p.unique, bits)
            ]
            yield _batch(PROBE, rows)

    return run


def _each_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    rows = (r for batch in batches for r in zip(*(batch[c].to_pylist() for c in PROBE.names), strict=True))
    for bucket, own in groupby(rows, key=lambda r: r[0]):
        yield bucket, list(own)


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a bucket that occur twice or more, of which one is at a fixed place: a bit for each probe of each chunk."""
    for bucket, own in _each_bucket(batches):
        sizes = [len(r[2]) // 4 for r in own]
        keys = np.concatenate([np.frombuffer(r[2], dtype="<u4") for r in own]).astype(np.uint64)
        marks = [[np.unpackbits(np.frombuffer(half, np.uint8), count=n).astype(bool) for half in (r[3][: len(r[3]) // 2], r[3][len(r[3]) // 2 :])] for r, n in zip(own, sizes, strict=True)]
        several, anchor = (np.concatenate([m[k] for m in marks]) for k in (0, 1))
        place = np.sort(keys << np.uint64(32) | np.arange(len(keys), dtype=np.uint64))
        order, keys = (place & np.uint64(0xFFFFFFFF)).astype(np.int64), place >> np.uint64(32)
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(heads, len(keys)))
        hit = ((size > 1) | np.logical_or.reduceat(several[order], heads)) & np.logical_or.reduceat(anchor[order], heads)
        found = np.empty(len(keys), dtype=bool)
        found[order] = np.repeat(hit, size)
        ends = np.cumsum(sizes)
        yield _batch(ANSWER, [(r[1], bucket, np.packbits(found[z - n : z]).tobytes()) for r, n, z in zip(own, sizes, ends.tolist(), strict=True) if found[z - n : z].any()])


def _candidates(row: pa.RecordBatch, words: Words, window: int, block: int, bits: int, seed: int, strength: int) -> Candidates:
    hits = Probes(words, block, bits).hits(bits, row["blocks"][0].as_py() or [], len(words))
    return Candidates(words, hits, window, block, seed, strength)


def _send_windows(window: int, block: int, bits: int, seed: int, strength: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words in _each_chunk(batches):
            c = _candidates(row, words, window, block, bits, seed, strength)
            yield _batch(PROBE, [(b, row["chunk"][0].as_py(), c.unique[a:z].astype("<u8").tobytes(), b"") for b, a, z in in_buckets(c.unique, bits)])

    return run


def _join_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each window of each chunk the next chunk before it that has it, the second one for the first, or -1 for none."""
    for bucket, own in _each_bucket(batches):
        sizes = [len(r[2]) // 8 for r in own]
        keys = np.concatenate([np.frombuffer(r[2], dtype="<u8") for r in own])
        chunk = np.repeat(np.array([r[1] for r in own], dtype=np.int64), sizes)
        order = np.argsort(keys, kind="stable")
        new = np.append(True, keys[order][1:] != keys[order][:-1])
        last = np.append(new[1:], True)
        before, after = np.roll(chunk[order], 1), np.roll(chunk[order], -1)
        partner = np.empty(len(keys), dtype=np.int64)
        partner[order] = np.where(~new, before, np.where(~last, after, -1))
        ends = np.cumsum(sizes)
        yield _batch(ANSWER, [(r[1], bucket, partner[z - n : z].tobytes()) for r, n, z in zip(own, sizes, ends.tolist(), strict=True) if (partner[z - n : z] >= 0).any()])


def runs_of(at: np.ndarray, *same: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of ascending places that follow one another while the other arrays tell nothing else."""
    if len(at):
        new = np.append(True, at[1:] != at[:-1] + 1)
        for x in same:
            new[1:] |= x[1:] != x[:-1]
        cuts = np.flatnonzero(new)
        yield from zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True)


def extend(one: Words, at: np.ndarray, two: Words, place: np.ndarray, window: int) -> Iterator[tuple[int, int, bool]]:
    """Start, number and equality of windows at[i] of one and place[i] of the other, compared word by word as far as both run on."""
    for a, z in runs_of(at, at - place):
        s, p, n = int(at[a]), int(place[a]), z - a
        span = [w.data[w.starts[i] : w.stops[i + n + window - 2]] for w, i in ((one, s), (two, p))]
        if span[0] == span[1]:
            yield s, n, True
            continue
        for k in range(n):
            pair = [w.data[w.starts[i + k] : w.stops[i + k + window - 1]] for w, i in ((one, s), (two, p))]
            yield s + k, 1, pair[0] == pair[1]


def _ask(window: int, block: int, bits: int, seed: int, strength: int):
    """What a chunk's windows must be compared with: here at once where the chunk has them twice, else the words for the partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words in _each_chunk(batches):
            c, chunk = _candidates(row, words, window, block, bits, seed, strength), row["chunk"][0].as_py()
            told = {a["bucket"]: a["answer"] for a in row["partners"][0].as_py() or []}
            partner = np.full(len(c.unique), -1, dtype=np.int64)
            for bucket, a, z in in_buckets(c.unique, bits):
                if bucket in told:
                    partner[a:z] = np.frombuffer(told[bucket], dtype=np.int64)
            number = np.repeat(np.arange(len(c.unique)), c.size)
            twice = c.size[number] > 1
            first = np.zeros(len(number), dtype=bool)
            first[c.heads] = True
            other = np.where(first, np.roll(c.at, -1), np.roll(c.at, 1))
            here = np.flatnonzero(twice)
            here = here[np.argsort(c.at[here])]
            rows = [(-1, chunk, s, n if equal else -n, None) for s, n, equal in extend(words, c.at[here], words, other[here], window)]
            there = np.flatnonzero(~twice & (partner[number] >= 0))
            there = there[np.argsort(c.at[there])]
            at, whom = c.at[there], partner[number[there]]
            for a, z in runs_of(at, whom, words.text[at]):
                s, n = int(at[a]), z - a
                rows.append((int(whom[a]), chunk, s, n, words.data[words.starts[s] : words.stops[s + n + window - 2]].decode()))
            yield _batch(ASK, rows)

    return run


def _compare(window: int, seed: int, strength: int):
    """Asked words against a chunk: each window is looked up there and extended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words in _each_chunk(batches):
            asks = row["asks"][0].as_py()
            if not asks:
                continue
            mine_at, mine = words.windows(window, seed)
            mine = leading(mine, strength)
            order = np.argsort(mine, kind="stable")
            mine_at, mine = mine_at[order], mine[order]
            asked = Words([a["words"].encode() for a in asks])
            at, value = asked.windows(window, seed)
            place = np.minimum(np.searchsorted(mine, leading(value, strength)), len(mine) - 1)
            rows = []
            for s, n, equal in extend(asked, at, words, mine_at[place], window):
                k = int(asked.text[s])
                rows.append((asks[k]["chunk"], asks[k]["start"] + s - int(asked.first[k]), n, equal))
            yield _batch(RUN, rows)

    return run


def _removed(kind: pa.DataType, window: int):
    names = pa.schema([("doc_id", kind), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words in _each_chunk(batches):
            cover = np.zeros(len(words) + 1, dtype=np.int64)
            for r in row["runs"][0].as_py() or []:
                cover[r["start"]] += 1
                cover[r["start"] + r["n"] + window - 1] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            removed, kept, spans = [], [], []
            for first, n in zip(words.first.tolist(), words.count.tolist(), strict=True):
                own = gone[first : first + n]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
                stay = np.concatenate(([0], edge, [n])).reshape(-1, 2)  # ranges of words that stay
                kept.append(b" ".join(words.data[words.starts[first + a] : words.stops[first + z - 1]] for a, z in stay.tolist() if a < z).decode())
                removed.append(int(own.sum()))
                spans.append(edge.tolist())
            cols = [row["ids"].flatten(), pa.array(words.count), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, schema=names)

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(shuffle_width(rows), "bucket").sortWithinPartitions("bucket", "chunk")


def _told(answers: DataFrame, name: str) -> DataFrame:
    """One row for each chunk, of what was answered to it."""
    own = F.struct(*[c for c in answers.columns if c != "chunk"])
    return answers.groupBy("chunk").agg(F.collect_list(own).alias(name)).hint("shuffle_hash")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, strength: int = 64, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, removed.

    Words are runs of anything but ASCII white space. Every word covered by a sequence of `window` words of one document that
    also starts anywhere else goes; sequences are judged on the input. `kept_text` joins the other words by one space; `removed`
    holds the maximal removed runs of words as [start, end, start, end, ...].

    1. Whole texts become chunks of a table that is bucketed by chunk, so that no later step moves texts to meet answers.
    2. Blocks of (window + 1) // 2 words at fixed places, side by side, are the index; every sequence of `window` words holds
       one. Every rolling block is a probe. A chunk sends each different block once, as 32 bits in one of many buckets and
       whether it is at a fixed place; a bucket answers a bit for each probe: the block is an anchor and occurs twice.
    3. Windows around the hits are the candidates. A bucket tells for each which chunk has it too: the one before in
       the order of chunks, so that no chunk is asked by more than two others for one window, however often it occurs.
    4. Hits are extended: a chunk sends the words of each run of windows to the partner, which finds the place and compares
       the words as far as both run on. Hashes only bring texts together; words decide. Windows whose words differed from the
       partner's are matched again under another hash, until none is left that differed each time. `strength` is the number of
       bits that the first of these hashes has.
    5. Runs of equal windows meet per chunk and cut the texts.

    Null counts as empty. Texts shorter than `window` stay whole. Repeated rows count as several documents. An empty table gives
    an empty result. A text longer than a chunk is a chunk of its own.
    """
    spark, width, block = docs.sparkSession, shuffle_width(docs), (window + 1) // 2
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType
    arrow_kind = to_arrow_type(kind)
    out = fresh_dir(spark, "chunks")
    name = out.rsplit("/", 1)[1].replace("-", "_")
    cut = source.mapInArrow(_chunks(arrow_kind, chunk_bytes), CHUNK_ROW.format(kind=kind.simpleString()))
    cut.write.bucketBy(width, "chunk").option("compression", "zstd").option("path", out).saveAsTable(name)
    chunks = spark.table(name)
    total = chunks.agg(F.sum("size")).first()[0] or 0
    bits = max(1, (max(4 * width, total // BUCKET_BYTES) - 1).bit_length())
    texts = chunks.select("chunk", "texts")

    probes = texts.mapInArrow(_probe(block, bits), PROBE_ROW)
    blocks = stored(_dealt(probes).mapInArrow(_join_blocks, ANSWER_ROW))
    hit = texts.join(_told(blocks, "blocks"), "chunk", "left")
    equal, still, seed = None, None, 0
    while equal is None or not still.isEmpty():
        seed += 1
        keys = hit.mapInArrow(_send_windows(window, block, bits, seed, strength), PROBE_ROW)
        partners = stored(_dealt(keys).mapInArrow(_join_windows, ANSWER_ROW))
        asks = stored(hit.join(_told(partners, "partners"), "chunk", "left").mapInArrow(_ask(window, block, bits, seed, strength), ASK_ROW))
        own = asks.filter("partner < 0").select("chunk", "start", F.abs("n").alias("n"), (F.col("n") > 0).alias("equal"))
        wanted = asks.filter("partner >= 0").groupBy(F.col("partner").alias("chunk")).agg(F.collect_list(F.struct("chunk", "start", "words")).alias("asks")).hint("shuffle_hash")
        far = texts.join(wanted, "chunk").mapInArrow(_compare(window, seed, strength), RUN_ROW)
        seen = stored(own.union(far))
        good, bad = seen.filter("equal").drop("equal"), seen.filter("not equal").select("chunk", "start")
        equal, strength = good if equal is None else equal.union(good), 64
        still = bad if still is None else stored(still.join(bad, ["chunk", "start"], "left_semi"))
    whole = chunks.drop("size").join(_told(equal, "runs"), "chunk", "left")
    spark.sql(f"DROP TABLE {name}")  # its files stay in the shared folder and are read by what is returned
    return whole.mapInArrow(_removed(arrow_kind, window), f"doc_id {kind.simpleString()}, n_words bigint, n_removed bigint, kept_text string, removed array<bigint>")
