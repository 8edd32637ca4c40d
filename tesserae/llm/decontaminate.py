"""Benchmark decontamination by Wu-Manber search for windows of item words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, id_and_text
from tesserae.llm.shingles import BYTE, mix

WINDOW = 10
BLOCK_BYTES = 4 << 20  # item text that is searched for at once
BLOCKS_TOGETHER = 4  # blocks whose tables a task holds, so that one read of the texts serves them all
PIECE_WORDS = 4096  # words of an item that stay together
LANE = 512  # bytes of text that one scanning lane covers
CHUNK = 1 << 20  # bytes of text scanned together

# A word is a run of bytes outside 00-2F, 3A-60 and 7B-7F after A-Z became a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[0x00:0x30] = IS_WORD[0x3A:0x61] = IS_WORD[0x7B:0x80] = False
GAP = np.uint8(0x20)
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words in text that was not lower-cased
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def spell(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of joined texts, each followed by one gap byte, texts led by one; and each text's end in that spelling.

    data: bytes of all texts, ends: where each text ends in them. Mapping whole texts keeps this one pass of numpy calls.
    """
    low = LOWER[data]
    word = IS_WORD[low]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inside = ends[(ends > 0) & (ends < len(data))]
    last[inside - 1] = word[inside - 1]
    size = word.astype(np.int64)
    size += last
    upto = np.concatenate(([0], np.cumsum(size)))
    # One more gap leads every text, so that a pattern can begin with a gap everywhere.
    order = np.arange(1, len(ends) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(lead, starts, 1)
    lead = np.cumsum(lead)
    out = np.full(int(upto[-1]) + len(ends), GAP, dtype=np.uint8)
    at = np.flatnonzero(word)
    out[upto[at] + lead[at]] = low[at]
    return out, upto[ends] + order


def split_words(text: str) -> list[bytes]:
    low = LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    return np.where(IS_WORD[low], low, GAP).tobytes().split()


def _pieces(width: int, piece_words: int):
    """Words of items in pieces of bounded length that overlap, so that every window is whole in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = split_words(text or "")
                step = max(1, piece_words - width + 1)
                parts = [b" ".join(words[i : i + step + width - 1]) for i in range(0, max(1, len(words) - width + 1), step)] if words else []
                cols = [pa.array([str(item)] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["item", "nth", "words"])

    return run


def _eight(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; places beyond the end read as zeros."""
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8)))
    return np.ndarray(shape=(len(text),), dtype="<u8", buffer=padded, strides=(1,))


def window_digest(store: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128 bits that tell the strings store[start:stop] apart."""
    up = np.full(len(store) + 1, SPREAD, dtype=np.uint64)
    up[:1] = 1
    down = np.full(len(store) + 1, pow(int(SPREAD), -1, 1 << 64), dtype=np.uint64)
    down[:1] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    out = np.zeros(len(start), dtype="u8,u8")
    for c, salt in (("f0", 51), ("f1", 52)):
        upto = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(BYTE, salt)[store] * up[:-1], dtype=np.uint64)))
        out[c] = mix((upto[stop] - upto[start]) * down[start] + mix((stop - start).astype(np.uint64), salt))
    return out


class WuManber:
    """Shift table and suffix-hash buckets for patterns of one length class, in plain arrays that can be sent to tasks.

    Patterns are places in a store of spelled words: start and size. Every pattern is judged on its first m bytes, m the
    shortest size. shift[h] tells how far the window may move when its last block of `block` bytes hashes to h, in a table whose
    size follows the number of blocks. bucket holds, sorted, the hash of each pattern's last such block and below it a hash of its first
    m bytes, so that one binary search picks the test strings that are worth a comparison.
    """

    def __init__(self, start: np.ndarray, size: np.ndarray, eight: np.ndarray):
        self.m = int(size.min())
        self.block = min(8, max(1, self.m // 2))
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        blocks = self.m - self.block + 1
        self.bits = max(12, (4 * min(len(start) * blocks, len(eight))).bit_length())
        self.shift = np.full(1 << self.bits, min(255, blocks), dtype=np.uint8)
        for k in range(blocks):  # shorter shifts come later and replace longer ones
            self.shift[self._hash(eight[start + k] & self.mask)] = min(255, blocks - 1 - k)
        bucket = self._bucket(eight, start)
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.order = bucket[order], order.astype(np.int32)

    def _hash(self, value: np.ndarray) -> np.ndarray:
        return ((value * SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _bucket(self, eight: np.ndarray, at: np.ndarray) -> np.ndarray:
        front = np.zeros(len(at), dtype=np.uint64)
        for j in range(0, self.m - 7, 8):
            front = (front ^ eight[at + j]) * SPREAD
            front ^= front >> np.uint64(29)
        tail = self._hash(eight[at + self.m - self.block] & self.mask).astype(np.uint64)
        return tail << np.uint64(64 - self.bits) | front >> np.uint64(self.bits)

    def candidates(self, eight: np.ndarray) -> np.ndarray:
        """Places where the shift table lets a pattern begin."""
        n, m, b = len(eight), self.m, self.block
        # Lanes move on their own, each by its own shift; a lane owns the window starts [k * LANE, (k + 1) * LANE).
        pos = np.arange(0, n - m + 1, LANE, dtype=np.int64)
        stop = np.minimum(pos + LANE, n - m + 1)
        found = [np.zeros(0, dtype=np.int64)]
        while len(pos):
            step = self.shift[self._hash(eight[pos + m - b] & self.mask)]
            found.append(pos[step == 0])
            pos = pos + np.maximum(step, 1)
            live = pos < stop
            if not live.all():
                pos, stop = pos[live], stop[live]
        return np.concatenate(found)

    def find(self, eight: np.ndarray, pattern: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all occurrences in a text and the pattern found there; `eight` and `pattern` spell text and store."""
        at = self.candidates(eight)
        key = self._bucket(eight, at)
        lo = np.searchsorted(self.bucket, key)
        some = self.bucket[np.minimum(lo, len(self.bucket) - 1)] == key
        at, lo, key = at[some], lo[some], key[some]
        many = np.searchsorted(self.bucket, key, side="right") - lo
        place = np.repeat(at, many)
        which = self.order[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(len(place))].astype(np.int64)
        inside = place + size[which] <= len(eight)
        place, which = place[inside], which[inside]
        # The direct comparison: block after block, the last one where the pattern ends.
        tail = size[which] - self.block
        for j in range(0, int(size.max()), self.block):
            k = np.minimum(tail, j)
            same = ((eight[place + k] ^ pattern[start[which] + k]) & self.mask) == 0
            if not same.all():
                place, which, tail = place[same], which[same], tail[same]
            if not len(place) or j >= tail.max():
                break
        return place, which


class Searcher:
    """Wu-Manber tables by length class over the distinct windows of some pieces of items."""

    def __init__(self, pieces: list[tuple[str, bytes]], width: int):
        self.names = sorted({item for item, _ in pieces})
        number = {item: i for i, item in enumerate(self.names)}
        self.store = np.frombuffer(b"".join(b" " + text + b" " for _, text in pieces), dtype=np.uint8)
        self.eight = _eight(self.store)
        ends = np.cumsum([len(text) + 2 for _, text in pieces], dtype=np.int64)
        gaps = np.flatnonzero(self.store == GAP)
        upto = np.searchsorted(gaps, ends).tolist()
        start, stop, words, item = ([np.zeros(0, dtype=np.int64)] for _ in range(4))
        for (name, _), lo, hi in zip(pieces, [0, *upto], upto, strict=False):
            k = min(width, hi - lo - 1)
            start.append(gaps[lo : hi - k])
            stop.append(gaps[lo + k : hi] + 1)
            words.append(np.full(len(start[-1]), k))
            item.append(np.full(len(start[-1]), number[name]))
        start, stop, words, item = (np.concatenate(x) for x in (start, stop, words, item))
        name = window_digest(self.store, start, stop)
        _, first, pattern = np.unique(name, return_index=True, return_inverse=True)
        self.start, self.size, self.words = start[first], (stop - start)[first], words[first]
        both = np.unique(pattern.astype(np.int64) << 32 | item)
        self.item = both & 0xFFFFFFFF
        self.item_from = np.searchsorted(both >> 32, np.arange(len(first) + 1))
        kind = np.minimum(6, np.frexp(self.size)[1])
        members = [np.flatnonzero(kind == c) for c in range(7)]
        self.tables = [(own, WuManber(self.start[own], self.size[own], self.eight)) for own in members if len(own)]

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all occurrences in spelled text and the pattern found there."""
        at, which = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        eight = _eight(text)
        for own, table in self.tables:
            if table.m <= len(text):
                place, k = table.find(eight, self.eight, self.start[own], self.size[own])
                at.append(place)
                which.append(own[k])
        return np.concatenate(at), np.concatenate(which)

    def texts(self, text: pa.Array) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
        """Of each text: its number of words, hit word ranges as [start, end, ...] and the items found."""
        text = text.cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
        words = np.zeros(len(text), dtype=np.int64)
        spans: list[list[int]] = [[] for _ in range(len(text))]
        items: list[list[str]] = [[] for _ in range(len(text))]
        for a, z in _chunks(np.diff(offsets), CHUNK):
            base = offsets[a]
            spelled, ends = spell(data[base : offsets[z]], offsets[a + 1 : z + 1] - base)
            gaps = np.concatenate(([0], np.cumsum(spelled == GAP)))
            starts = np.concatenate(([0], ends[:-1]))
            words[a:z] = gaps[ends] - gaps[starts] - 1
            at, which = self.find(spelled)
            doc = np.searchsorted(ends, at, side="right")
            first = gaps[at] - gaps[starts[doc]]
            order = np.lexsort((first, doc))
            doc, first, which = doc[order], first[order], which[order]
            bounds = [*np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))[: len(doc)].tolist(), len(doc)]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                i = a + int(doc[lo])
                spans[i] = _merge(first[lo:hi], first[lo:hi] + self.words[which[lo:hi]])
                found = {n for p in set(which[lo:hi].tolist()) for n in self.item[self.item_from[p] : self.item_from[p + 1]].tolist()}
                items[i] = [self.names[n] for n in sorted(found)]
        return words, spans, items


def _merge(start: np.ndarray, stop: np.ndarray) -> list[int]:
    """The union of half-open ranges, sorted by start, as [start, end, start, end, ...]."""
    reach = np.maximum.accumulate(stop)
    new = np.append(True, start[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(start)) - 1
    return np.column_stack((start[heads], reach[tails])).ravel().tolist()


def _chunks(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most about limit bytes each."""
    upto, start = np.cumsum(lengths), 0
    while start < len(lengths):
        base = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, base + limit, side="right")))
        yield start, stop
        start = stop


RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, hit_spans array<bigint>"


def _result(doc_id: pa.Array, words: pa.Array, spans: list[list[int]], items: list[list[str]]) -> pa.RecordBatch:
    hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
    sha = [hashlib.sha256(",".join(names).encode()).hexdigest() for names in items]
    return pa.RecordBatch.from_arrays(
        [
            doc_id, words, pa.array(hit, pa.int64()), pa.array([len(n) for n in items], pa.int64()), pa.array(sha, pa.string()),
            pa.array([h > 0 for h in hit], pa.bool_()), pa.array(spans, pa.list_(pa.int64())),
        ],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"],
    )


def _arrays(searcher: Searcher) -> dict:
    """The searcher as plain values: what is broadcast names no class of this package."""
    tables = [(own, vars(table)) for own, table in searcher.tables]
    return {k: v for k, v in vars(searcher).items() if k != "eight"} | {"tables": tables}


def _searcher(arrays: dict) -> Searcher:
    def filled(kind, values):
        out = kind.__new__(kind)
        vars(out).update(values)
        return out

    return filled(Searcher, arrays | {"eight": _eight(arrays["store"]), "tables": [(own, filled(WuManber, t)) for own, t in arrays["tables"]]})


def _scan_all(sent):
    """Result columns where one block holds all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(sent.value)
        for batch in batches:
            words, spans, items = searcher.texts(batch["text"])
            yield _result(batch["doc_id"], pa.array(words), spans, items)

    return run


def _scan_blocks(sent: list):
    """Of texts with hits of these blocks: digest, spans, items. Every block searches a batch before the next batch is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = [_searcher(s.value) for s in sent]
        for batch in batches:
            for searcher in searchers:
                _, spans, items = searcher.texts(batch["text"])
                some = pa.array([i for i, s in enumerate(spans) if s], pa.int64())
                cols = [batch["t1"].take(some), batch["t2"].take(some)]
                cols += [pa.array(spans, pa.list_(pa.int64())).take(some), pa.array(items, pa.list_(pa.string())).take(some)]
                yield pa.RecordBatch.from_arrays(cols, names=["t1", "t2", "spans", "items"])

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result columns from what all blocks found."""
    for batch in batches:
        spans, items = [], []
        for lists, names in zip(batch["spans"].to_pylist(), batch["items"].to_pylist(), strict=True):
            both = sorted((a, z) for one in lists or [] for a, z in zip(one[::2], one[1::2], strict=True))
            spans.append(_merge(*(np.array(x, dtype=np.int64) for x in zip(*both, strict=True))) if both else [])
            items.append(sorted({n for one in names or [] for n in one}))
        yield _result(batch["doc_id"], batch["n_words"], spans, items)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    piece_words: int = PIECE_WORDS,
    blocks_together: int = BLOCKS_TOGETHER,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans.

    A window is `width` consecutive words of an item, or a shorter item as a whole. hit_spans holds merged, half-open word
    ranges as [start, end, start, end, ...]; n_hit counts the words in them.

    Texts are scanned where they are read. Items are cut into overlapping pieces of at most `piece_words` words and the pieces dealt over
    blocks of about block_bytes of text. With one block, the scan gives the result and nothing is shuffled. With more, the
    texts are scanned once for every `blocks_together` blocks; hits are written to the shared folder before the next ones begin, so that
    driver and tasks hold the tables of that many blocks at a time, and meet by a 128-bit digest of their text.

    Null or wordless texts have no words and no hits; null or wordless items have no windows. A null item id counts as the
    string None. Repeated items count once by id. Repeated documents and null ids each get a row; other columns of either table
    are ignored. Empty tables are allowed.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    pieces = cut(items.mapInArrow(_pieces(width, piece_words), "item string, nth bigint, words binary"))
    size = pieces.agg(F.sum(F.octet_length("words") + 2)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item", "nth"), F.lit(blocks))

    def send(k: int):
        own = pieces.filter(block == k).select("item", "words").orderBy("item", "nth").collect()
        return spark.sparkContext.broadcast(_arrays(Searcher([(r.item, bytes(r.words)) for r in own], width)))

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    if blocks == 1:
        return rows.mapInArrow(_scan_all(send(0)), f"doc_id {kind}, {RESULT}")
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    found = None
    for k in range(0, blocks, blocks_together):
        sent = [send(j) for j in range(k, min(k + blocks_together, blocks))]
        hits = cut(rows.select("t1", "t2", "text").mapInArrow(_scan_blocks(sent), "t1 bigint, t2 bigint, spans array<bigint>, items array<string>"))
        for s in sent:
            s.destroy()
        found = hits if found is None else found.union(hits)
    by_text = found.groupBy("t1", "t2").agg(F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items"))
    counted = rows.select("doc_id", "t1", "t2", F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words"))
    met = counted.join(by_text, ["t1", "t2"], "left").select("doc_id", "n_words", "spans", "items")
    return met.mapInArrow(_gather, f"doc_id {kind}, {RESULT}")
