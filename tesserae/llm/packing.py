"""Best-fit packing of token sequences by exact complements of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import cut, id_and_text, shuffle_width
from tesserae.llm.encoder import worker_encoder

CAPACITY = 4096
END_ID = 1


class Plan:
    """Which ranks of which length go where: a piece of length L and rank r is in the slot of L that holds r."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.used = np.zeros(capacity + 1, dtype=np.int64)
        self.sequences = 0
        self.slots: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset

    def add(self, lengths: tuple[int, ...], times: int) -> None:
        """Open `times` sequences that hold pieces of these lengths each."""
        at = 0
        for n in lengths:
            self.slots.append((n, int(self.used[n]), self.sequences, at))
            self.used[n] += times
            at += n
        self.sequences += times


class SumIndex:
    """Which sums single lengths, pairs and triples of the free lengths make, addressed by the sum.

    single[s] says whether length s is free, pair[s] how many ordered pairs of free lengths sum to s; triples are a third length
    and a pair, looked up in both. A length that is used up is taken out of the index.
    """

    def __init__(self, free: np.ndarray):
        self.free, n = free, len(free)
        self.single = free > 0
        self.single[0] = False
        there = self.single.astype(np.float64)
        self.pair = np.rint(np.fft.irfft(np.fft.rfft(there, 2 * n) ** 2, 2 * n))[:n].astype(np.int64)
        for a in np.flatnonzero(free[: (n + 1) // 2] == 1).tolist():  # a pair of one piece with itself is none
            self.pair[2 * a] -= int(self.single[a])

    def take(self, lengths: np.ndarray, number: np.ndarray) -> None:
        """Use up pieces of these different lengths, so many of each."""
        for a, k in zip(lengths.tolist(), number.tolist(), strict=True):
            before = int(self.free[a])
            self.free[a] -= k
            if before >= 2 and self.free[a] <= 1 and 2 * a < len(self.pair):
                self.pair[2 * a] -= 1
            if self.free[a] == 0:
                self.single[a] = False
                self.pair[a:] -= 2 * self.single[: len(self.pair) - a]

    def best_pair(self, total: int) -> tuple[int, ...] | None:
        """The pair of free lengths with this sum that can be taken most often."""
        if total < 2 or self.pair[total] <= 0:
            return None
        a = np.arange(1, total // 2 + 1)
        times = np.minimum(self.free[a], self.free[total - a])
        if total % 2 == 0:
            times[-1] = self.free[total // 2] // 2
        k = int(times.argmax())
        return (total - k - 1, k + 1) if times[k] > 0 else None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three free lengths that fill the gap exactly."""
        if self.free[gap] > 0:
            return (gap,)
        if two := self.best_pair(gap):
            return two
        for third in np.flatnonzero((self.free[: gap + 1] > 0) & (self.pair[gap::-1] > 0))[::-1].tolist():
            self.free[third] -= 1
            two = self.best_pair(gap - third)
            self.free[third] += 1
            if two:
                return (third, *two)
        return None


def _exact_fills(counts: np.ndarray, capacity: int) -> tuple[Plan, list[tuple[int, int]]]:
    """Sequences filled by exact complements, and the lengths and numbers of pieces that have none.

    From the longest length down, a piece takes the complement that the index finds as often as the counts allow; every step uses up a
    length or meets its own multiplicity, so steps are bounded by the number of lengths and not by the number of pieces.
    """
    free, plan = counts.astype(np.int64).copy(), Plan(capacity)
    index = SumIndex(free)
    rest: list[tuple[int, int]] = []
    for n in range(capacity, 0, -1):
        while free[n]:
            if n == capacity:
                plan.add((n,), int(free[n]))
                index.take(np.array([n]), free[[n]])
                break
            free[n] -= 1
            found = index.complement(capacity - n)
            free[n] += 1
            kinds, need = np.unique(np.array((n, *(found or ()))), return_counts=True)
            times = int((free[kinds] // need).min()) if found else 0
            if not times:
                rest.append((n, int(free[n])))
                index.take(np.array([n]), free[[n]])
                break
            index.take(kinds, need * times)
            plan.add((n, *found), times)
    return plan, rest


def _best_fit(plan: Plan, rest: list[tuple[int, int]], capacity: int) -> Plan:
    """The plan with the rest added, longest first, each piece where the least room is left that holds it; in bulk."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n, left in rest:
        while left:
            gap = min((g for g in open_ if g >= n), default=capacity)
            held, bins = open_[gap].pop() if gap in open_ else ((), -(-left // (capacity // n)))
            if gap in open_ and not open_[gap]:
                del open_[gap]
            each = gap // n
            full = min(bins, left // each)
            part = min(left - full * each, each - 1) if full < bins else 0
            for size, number in ((each, full), (part, int(part > 0)), (0, bins - full - int(part > 0))):
                if number:
                    content = held + (n,) * size
                    if content:
                        open_.setdefault(capacity - sum(content), []).append((content, number))
            left -= full * each + part
    for groups in open_.values():
        for content, number in groups:
            plan.add(content, number)
    return plan


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Packing plan for counts[L] pieces of each length L: exact complements first and best fit for what has none.

    Complements may use up the short pieces that long ones needed later, so best fit for all pieces is planned as well and
    returned where it takes fewer sequences.
    """
    exact = _best_fit(*_exact_fills(counts, capacity), capacity)
    every = [(n, int(counts[n])) for n in range(capacity, 0, -1) if counts[n]]
    plain = _best_fit(Plan(capacity), every, capacity)
    return plain if plain.sequences < exact.sequences else exact


def _cutter(model: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for batch in batches:
            enc = enc or worker_encoder(model)
            row, piece, start, length, crc = [], [], [], [], []
            for a, _, ids, offsets in enc.slices(batch["text"]):
                flat = np.insert(ids, offsets[1:], end_id).astype("<u4")
                bounds = offsets + np.arange(len(offsets))
                for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    for k, s in enumerate(range(lo, hi, capacity)):
                        e = min(s + capacity, hi)
                        row.append(a + i)
                        piece.append(k)
                        start.append(s - lo)
                        length.append(e - s)
                        crc.append(zlib.crc32(flat[s:e]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def _placer(slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = slots[:, 0] << 44 | slots[:, 1]
        for batch in batches:
            rank = batch["rank"].to_numpy()
            k = np.searchsorted(key, batch["length"].to_numpy() << 44 | rank, side="right") - 1
            cols = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(slots[k, 2] + rank - slots[k, 1]), pa.array(slots[k, 3])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text and end_id; only documents longer than `capacity` are cut, into pieces of that length and
    a last one that may be shorter. The plan is made from the number of pieces of each length, at most `capacity` numbers
    however many pieces there are; pieces get a rank among those of their length, counted over salts so that no length meets
    in one task, and take the place that the plan has for that rank.

    Null text counts as empty (a piece of the end id). Repeated rows are packed each. An empty table gives an empty result.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    salts = shuffle_width(docs)
    pieces = cut(rows.mapInArrow(_cutter(model, capacity, end_id), schema)).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts))
    )
    tally = pieces.groupBy("length", "salt").count()
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in tally.groupBy("length").agg(F.sum("count")).collect():  # one row a length
        counts[n] = k
    plan = plan_packing(counts, capacity)
    slots = np.array(sorted(plan.slots), dtype=np.int64).reshape(-1, 4)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # one row a salt
    bases = tally.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(own) - 1).join(bases, ["length", "salt"])
    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return placed.mapInArrow(_placer(slots), f"{schema}, sequence_id bigint, offset bigint")
