"""Removal of long byte strings that occur elsewhere, by suffix arrays over shards that share content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import cut, discard, id_and_text, shuffle_width, stored
from tesserae.llm.shingles import BASE, BYTE, _powers, mix

LENGTH = 200
GRAM = 40  # bytes of an anchor
CHUNK = 1_000_000  # bytes in which anchors are sought together; below 2**20
SHARD_BYTES = 1 << 20  # bytes of a suffix array
STRIDE = 256  # suffixes after which a common prefix is compared anew
SPLIT_ROWS = 2048  # different surroundings of one anchor that a shard takes
SAMPLE, SAMPLED_OFTEN = 0.01, 500  # anchors that 500 places in a hundredth of the texts have, 50,000 in all, do not meet in one window
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _inverse_powers(n: int) -> np.ndarray:
    out = np.full(n, INVERSE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


UP, DOWN = _powers(1 << 20), _inverse_powers(1 << 20)


def find_anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts data[begins[i]:ends[i]]: text, position, anchor hash, hash of its surroundings, their start and end,
    and 32-bit hashes of the nearer surroundings on the left and on the right (-1 where the text ends before).

    Any string of `length` bytes around an anchor holds all of its nearer surroundings on one side or the other. Of each string of `length` bytes the anchor is the GRAM-byte piece with the least hash, the last of several: equal strings
    have equal anchors at equal places. The surroundings are what the strings that pick the anchor cover; those strings start
    side by side.
    """
    n, reach = len(data), length - GRAM + 1
    if n < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray(shape=(n,), dtype="<u8", buffer=padded, strides=(1,))
    grams = n - GRAM + 1
    h = np.zeros(grams, dtype=np.uint64)
    for j in range(0, GRAM, 8):
        h += mix(eight[j : j + grams], 41) * UP[j + 1]
    h = mix(h, 42)
    place = np.uint64((1 << 20) - 1)
    low = (h & ~place) | (place - np.arange(grams, dtype=np.uint64))
    span = 1
    while span * 2 <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    starts = n - length + 1
    low = np.minimum(low[:starts], low[reach - span : reach - span + starts])
    text = np.searchsorted(begins, np.arange(starts), side="right") - 1
    inside = np.arange(starts) + length <= ends[text]
    window = np.flatnonzero(inside)
    at, head = np.unique((place - (low[window] & place)).astype(np.int64), return_index=True)
    who = np.searchsorted(begins, at, side="right") - 1
    lo, hi = window[head], window[np.append(head[1:], len(window)) - 1] + length
    upto = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(BYTE[data] * UP[:n], dtype=np.uint64)))
    around = mix((upto[hi] - upto[lo]) * DOWN[lo] + mix(((at - lo) << 20 | (hi - at)).astype(np.uint64), 43))
    near = (length - GRAM) // 2
    has_left, has_right = at - near >= lo, at + GRAM + near <= hi
    left, right = np.maximum(at - near, 0), np.minimum(at + GRAM, n)
    sides = []
    for has, a, z in ((has_left, left, at), (has_right, right, np.minimum(right + near, n))):
        side = mix((upto[z] - upto[a]) * DOWN[np.minimum(a, n - 1)], 44)
        sides.append(np.where(has, (side >> np.uint64(33)).astype(np.int64), -1))
    return who, at, h[at], around, lo, hi, *sides


ANCHOR_ROW = "ah bigint, sh bigint, t1 bigint, t2 bigint, lo bigint, hi bigint, mid bigint, weight bigint, left int, right int, done boolean"
ANCHOR = ["ah", "sh", "t1", "t2", "lo", "hi", "mid", "weight", "left", "right", "done"]


def combine(who: np.ndarray, ah: np.ndarray, sh: np.ndarray, lo: np.ndarray, hi: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row of each anchor with its surroundings, how often it occurs here, and what repeats here: text, start and end of runs.

    Surroundings that occur twice are settled where they are read, so that a line or passage that fills the corpus goes on as one
    row for each chunk of text.
    """
    _, first, same = np.unique(mix(ah, 47) ^ sh, return_index=True, return_inverse=True)
    total = np.bincount(same, weights=times, minlength=len(first)).astype(np.int64)
    many = np.flatnonzero(total[same] > 1)
    many = many[np.lexsort((lo[many], who[many]))]
    w, a, z = who[many], lo[many], hi[many]
    if not len(many):
        return first, total, w, a, z
    reach = np.maximum.accumulate(w * (1 << 40) + z)
    head = np.append(True, (w[1:] * (1 << 40) + a[1:] > reach[:-1]))
    at = np.flatnonzero(head)
    return first, total, w[at], a[at], reach[np.append(at[1:], len(many)) - 1] - w[at] * (1 << 40)


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Copies within a batch are one text with a weight.
            names = list(zip(batch["t1"].to_pylist(), batch["t2"].to_pylist(), strict=True))
            first: dict[tuple[int, int], int] = {}
            weight: dict[int, int] = {}
            for i, name in enumerate(names):
                k = first.setdefault(name, i)
                weight[k] = weight.get(k, 0) + 1
            raw = batch["text"].cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
            data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8) if len(raw) else np.zeros(0, np.uint8)
            group: list[int] = []
            held = 0

            def flush(group: list[int], data=data, offsets=offsets, weight=weight, names=names) -> Iterator[pa.RecordBatch]:
                sizes = [int(offsets[i + 1] - offsets[i]) for i in group]
                if len(group) == 1 and sizes[0] > CHUNK:
                    parts = _long_text(data[offsets[group[0]] : offsets[group[0] + 1]], length)
                else:
                    ends = np.cumsum(sizes)
                    begins = ends - sizes
                    joined = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in group])
                    who, at, ah, sh, lo, hi, left, right = find_anchors(joined, begins, ends, length)
                    parts = [(who, at - lo, ah, sh, lo - begins[who], hi - begins[who], left, right)]
                for who, mid, ah, sh, lo, hi, left, right in parts:
                    times = np.array([weight[g] for g in group])[who]
                    first, total, who_, lo_, hi_ = combine(who, ah, sh, lo, hi, times)
                    t1, t2 = (np.array([names[g][k] for g in group], dtype=np.int64) for k in (0, 1))
                    done = np.append(np.zeros(len(first), dtype=bool), np.ones(len(who_), dtype=bool))
                    nothing = np.zeros(len(who_), dtype=np.int64)
                    cols = [
                        (ah[first].view(np.int64), t1[who_]), (sh[first].view(np.int64), nothing), (t1[who[first]], t1[who_]), (t2[who[first]], t2[who_]),
                        (lo[first], lo_), (hi[first], hi_), (mid[first], nothing), (total, nothing),
                    ]
                    sides = [np.append(x[first], nothing - 1) for x in (left, right)]
                    arrays = [pa.array(np.concatenate(c), pa.int64()) for c in cols]
                    arrays += [pa.array(x, pa.int32(), mask=x < 0) for x in sides]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(done)], names=ANCHOR)

            for i in weight:
                size = int(offsets[i + 1] - offsets[i])
                if size < length:
                    continue
                if group and held + size > CHUNK:
                    yield from flush(group)
                    group, held = [], 0
                group.append(i)
                held += size
            if group:
                yield from flush(group)

    return run


def _long_text(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of one text that is longer than a chunk, by overlapping chunks."""
    last, step = -1, CHUNK - 4 * length
    for c in range(0, len(data), step):
        a, z = max(0, c - 2 * length), min(len(data), c + step + 2 * length)
        # Anchors near an end of the chunk that is not the text's own may miss strings: the next chunk has them whole.
        who, at, ah, sh, lo, hi, left, right = find_anchors(data[a:z], np.array([0]), np.array([z - a]), length)
        mid, at, lo, hi = at - lo, at + a, lo + a, hi + a
        sound = ((at - length >= a) | (a == 0)) & ((at + length <= z) | (z == len(data))) & (at > last)
        if sound.any():
            last = int(at[sound][-1])
        yield tuple(x[sound] for x in (who, mid, ah, sh, lo, hi, left, right))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order by the first `depth` symbols at least (symbols 0 to 256), by Larsson and Sadakane's refinement.

    Ranks by the first seven symbols are refined by doubling; only groups that are still undecided are sorted again, by the rank
    of the suffix that many symbols on.
    """
    n = len(text)
    wide = np.concatenate((text.astype(np.uint64), np.zeros(7, dtype=np.uint64)))
    key = np.zeros(n, dtype=np.uint64)
    for j in range(7):
        key |= wide[j : j + n] << np.uint64(9 * (6 - j))
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    rank = np.zeros(n + 1, dtype=np.int64)  # a group's rank is where it starts in the order, plus one; 0 past the end
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    step = 7
    while step < depth:
        last = np.append(new[1:], True)
        places = np.flatnonzero(~(new & last))  # of groups with two suffixes or more
        if not len(places):
            break
        these = order[places]
        then = rank[np.minimum(these + step, n)]
        both = (rank[these] << 31 | then) if n < 1 << 31 else None
        by = np.argsort(both) if both is not None else np.lexsort((then, rank[these]))
        these, then = these[by], then[by]
        order[places] = these
        head = rank[these]
        split = np.ones(len(these), dtype=bool)
        split[1:] = (head[1:] != head[:-1]) | (then[1:] != then[:-1])
        new[places] = split
        rank[these] = np.maximum.accumulate(np.where(split, places, 0)) + 1
        step *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, exact up to `limit`.

    Kasai's relation: where a suffix and its predecessor are preceded by the same symbol, the prefix is one shorter than that of
    the suffix before. Only the others, and one in STRIDE, are compared, four symbols at a time.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    known = np.zeros(n, dtype=bool)
    known[1:] = (before[1:] > 0) & (before[1:] == before[:-1] + 1)
    known[known] = text[i[known] - 1] == text[before[known] - 1]
    known[::STRIDE] = False
    ask = np.flatnonzero(~known & (before >= 0))
    most = limit + STRIDE
    wide = np.concatenate((text.astype("<u2"), np.zeros(most + 8, dtype="<u2")))
    four = np.ndarray(shape=(n + most,), dtype="<u8", buffer=wide, strides=(2,))
    got = np.zeros(n, dtype=np.int64)
    a, b, at = ask, before[ask], 0
    while len(a) and at < most:
        same = four[a + at] == four[b + at]
        a, b = a[same], b[same]
        at += 4
        got[a] = at
    own, other = got[ask], before[ask]
    for _ in range(3):
        own += (wide[ask + own] == wide[other + own]) & (own < most)
    got[ask] = np.minimum(own, n - np.maximum(ask, other))
    base = np.maximum.accumulate(np.where(~known, i, 0))
    got = np.where(before >= 0, np.maximum(got[base] - (i - base), 0), 0)
    return got[order]


def repeated_starts(pieces: list[bytes], text_of: np.ndarray, at: np.ndarray, several: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Piece and offset of every string of `length` bytes in the pieces, its group of equal strings, and whether it repeats.

    text_of and at tell which text a piece is from and where it starts there: a place that two pieces show is one place. Strings
    of a piece that stands for several equal ones repeat anyway.
    """
    sizes = np.array([len(p) + 1 for p in pieces])
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", dtype=np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(sizes) - 1
    text[ends] = 0
    order = suffix_array(text, length)
    prefix = common_prefixes(text, order, length)
    piece = np.searchsorted(ends, order, side="left")
    begin = ends + 1 - sizes
    fits = order + length <= ends[piece]
    order, piece = order[fits], piece[fits]
    # The least common prefix over suffixes that were left out between two that fit stays below `length` where one differs.
    group = np.cumsum(prefix < length)[fits]
    offset = order - begin[piece]
    if not len(order):
        return piece, offset, group, np.zeros(0, dtype=bool)
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    where = text_of[piece].astype(np.int64) << 40 | (at[piece] + offset)
    many = np.minimum.reduceat(where, heads) != np.maximum.reduceat(where, heads)
    many |= np.logical_or.reduceat(several[piece], heads)
    number = np.cumsum(np.append(False, group[1:] != group[:-1]))
    return piece, offset, number, many[number]


def shared_reach(groups: np.ndarray, sides: list[bytes]) -> np.ndarray:
    """How many leading bytes each side has in common with some other side of its group."""
    if not sides:
        return np.zeros(0, dtype=np.int64)
    sizes = np.fromiter(map(len, sides), dtype=np.int64, count=len(sides))
    wide = max(1, int(sizes.max()))
    order = np.array(sorted(range(len(sides)), key=lambda i: (groups[i], sides[i])))
    rows = np.frombuffer(b"".join(sides[i].ljust(wide, b"\0") for i in order.tolist()), dtype=np.uint8).reshape(-1, wide)
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    common = np.minimum(common, np.minimum(sizes[order][1:], sizes[order][:-1]))
    common[groups[order][1:] != groups[order][:-1]] = 0
    out = np.zeros(len(sides), dtype=np.int64)
    out[order] = np.maximum(np.append(common, 0), np.append(0, common))
    return out


def string_digests(pieces: list[bytes], piece: np.ndarray, offset: np.ndarray, length: int) -> list[np.ndarray]:
    """Two 64-bit hashes of the strings of `length` bytes at these offsets of these pieces."""
    need, row = np.unique(piece, return_inverse=True)
    wide = max(len(pieces[p]) for p in need.tolist())
    rows = np.frombuffer(b"".join(pieces[p].ljust(wide, b"\0") for p in need.tolist()), dtype=np.uint8).reshape(len(need), wide)
    out = []
    for salt in (45, 46):
        upto = np.zeros((len(need), wide + 1), dtype=np.uint64)
        np.cumsum(mix(BYTE, salt)[rows] * UP[:wide], axis=1, dtype=np.uint64, out=upto[:, 1:])
        out.append(mix((upto[row, offset + length] - upto[row, offset]) * DOWN[offset], salt).view(np.int64))
    return out


SPAN = ["t1", "t2", "start", "stop", "d1", "d2", "known"]


def _shard(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, current = 0, None

        def finish() -> pa.RecordBatch:
            group = np.array([r[0] for r in rows], dtype=np.int64)
            pieces = [r[7] for r in rows]
            mid = [r[6] for r in rows]
            spread = np.array([r[5] for r in rows], dtype=bool)
            # What no other piece of the group reaches is cut off; pieces whose rivals are in other shards stay whole.
            left = shared_reach(group, [p[:m][::-1] for p, m in zip(pieces, mid, strict=True)])
            right = shared_reach(group, [p[m + GRAM :] for p, m in zip(pieces, mid, strict=True)])
            same: dict[tuple, list[int]] = {}
            for i, (g, p, m) in enumerate(zip(group.tolist(), pieces, mid, strict=True)):
                a, z = (0, len(p)) if spread[i] else (m - int(left[i]), m + GRAM + int(right[i]))
                if z - a >= length:
                    same.setdefault((g, m - a, p[a:z], bool(spread[i])), []).append(i)
            spans: list[tuple] = []
            kept, first, several = [], [], []
            for (_, before, p, _), own in same.items():
                several.append(len(own) > 1 or rows[own[0]][4])
                kept.append(p)
                first.append((own[0], mid[own[0]] - before))
                if several[-1]:  # equal pieces repeat as a whole
                    spans += [(*rows[i][1:3], rows[i][3] + mid[i] - before, rows[i][3] + mid[i] - before + len(p)) for i in own if not rows[i][4]]
            found: list[list] = [list(x) for x in zip(*spans, strict=True)] or [[], [], [], []]
            extra: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * 6 + [np.zeros(0, dtype=bool)]
            if kept:
                texts: dict[tuple[int, int], int] = {}
                text_of = np.array([texts.setdefault(rows[i][1:3], len(texts)) for i, _ in first], dtype=np.int64)
                at = np.array([rows[i][3] + a for i, a in first], dtype=np.int64)
                many = np.array(several, dtype=bool)
                piece, offset, number, repeats = repeated_starts(kept, text_of, at, many, length)
                mine = repeats & ~many[piece]
                code = np.unique(text_of[piece[mine]] << 40 | (at[piece[mine]] + offset[mine]))
                owner, start = code >> 40, code & ((1 << 40) - 1)
                cut_ = np.flatnonzero((owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)) + 1
                back = list(texts)
                for a, z in zip([0, *cut_.tolist()], [*cut_.tolist(), len(code)], strict=True) if len(code) else ():
                    for c, v in enumerate((*back[int(owner[a])], int(start[a]), int(start[z - 1]) + length)):
                        found[c].append(v)
                # Of anchors that several shards share, one of each different string goes on, to be looked for in the others.
                far = np.array([rows[i][5] for i, _ in first], dtype=bool)[piece]
                if far.any():
                    w = np.flatnonzero(far)
                    w = w[np.unique(number[w], return_index=True)[1]]
                    names = np.array(back, dtype=np.int64).reshape(-1, 2)[text_of[piece[w]]]
                    begin = at[piece[w]] + offset[w]
                    extra = [names[:, 0], names[:, 1], begin, begin + length, *string_digests(kept, piece[w], offset[w], length), repeats[w]]
            local = len(found[0])
            cols = [pa.array(np.concatenate((np.array(c, dtype=np.int64), e))) for c, e in zip(found, extra[:4], strict=True)]
            none = np.concatenate((np.ones(local, dtype=bool), np.zeros(len(extra[0]), dtype=bool)))
            cols += [pa.array(np.concatenate((np.zeros(local, dtype=np.int64), e)), pa.int64(), mask=none) for e in extra[4:6]]
            cols.append(pa.array(np.concatenate((np.zeros(local, dtype=bool), extra[6])), pa.bool_(), mask=none))
            return pa.RecordBatch.from_arrays(cols, names=SPAN)

        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("ah", "part", "t1", "t2", "lo", "several", "spread", "mid", "piece")]
            for ah, part, *row in zip(*cols, strict=True):
                if (ah, part) != current and held >= SHARD_BYTES:
                    yield finish()
                    rows, held = [], 0
                current = (ah, part)
                rows.append((ah, *row))
                held += len(row[-1])
        yield finish()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of several shards in the order of their digests: where equal ones begin and end is found by binary search."""
    rest: pa.Table | None = None

    def settle(table: pa.Table) -> pa.RecordBatch:
        one, two = table["d1"].to_numpy(), table["d2"].to_numpy()
        take = np.zeros(len(one), dtype=bool)
        if len(one):
            heads = np.searchsorted(one, np.unique(one), side="left")
            heads = np.union1d(heads, np.flatnonzero(two[1:] != two[:-1]) + 1)
            codes: dict[tuple, int] = {}
            place = [codes.setdefault(x, len(codes)) for x in zip(*(table[c].to_pylist() for c in ("t1", "t2", "start")), strict=True)]
            many = np.minimum.reduceat(place, heads) != np.maximum.reduceat(place, heads)
            many |= np.logical_or.reduceat(table["known"].to_numpy().astype(bool), heads)
            take = np.repeat(many, np.diff(np.append(heads, len(one))))
        kept = table.filter(pa.array(take, pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array(kept[c].to_numpy(), pa.int64()) for c in SPAN[:4]], names=SPAN[:4])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        digest = table["d1"].to_numpy()
        ready = int(np.searchsorted(digest, digest[-1], side="left")) if len(digest) else 0
        yield settle(table.slice(0, ready))
        rest = table.slice(ready)
    if rest is not None:
        yield settle(rest)


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            raw = text.as_buffer()
            runs: list[list[int]] = []
            for s in sorted((s["start"], s["stop"]) for s in spans.as_py() or []):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            digest, at = hashlib.sha256(), 0
            for a, z in runs:
                digest.update(raw[at:a])
                at = z
            digest.update(raw[at:])
            for c, v in enumerate((raw.size, sum(z - a for a, z in runs), len(runs), digest.hexdigest(), [x for r in runs for x in r])):
                out[c].append(v)
        kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.int64())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)


def _slice_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the places that texts are asked for."""
    keep = ["ah", "part", "t1", "t2", "lo", "several", "spread", "mid"]
    for batch in batches:
        pieces: list[bytes] = []
        owner: list[int] = []
        asked: list[dict] = []
        for i, (text, want) in enumerate(zip(batch["text"], batch["want"], strict=True)):
            raw = text.as_buffer()
            for w in want.as_py():
                pieces.append(raw[w["lo"] : w["hi"]].to_pybytes())
                asked.append(w)
                owner.append(i)
        index = pa.array(owner, pa.int64())
        cols = {"t1": batch["t1"].take(index), "t2": batch["t2"].take(index), "piece": pa.array(pieces, pa.binary())}
        for c, k in (("ah", pa.int64()), ("part", pa.int64()), ("lo", pa.int64()), ("mid", pa.int64()), ("several", pa.bool_()), ("spread", pa.bool_())):
            cols[c] = pa.array([w[c] for w in asked], k)
        yield pa.RecordBatch.from_pydict({c: cols[c] for c in [*keep, "piece"]})


WANT = ["ah", "part", "lo", "hi", "mid", "several", "spread"]


def _settle_in_windows(anchors: DataFrame, split_rows: int) -> tuple[DataFrame, DataFrame]:
    """Spans (t1, t2, start, stop) that repeat as a whole, and places (t1, t2, w) whose surroundings must be looked at."""
    same, near = Window.partitionBy("ah"), Window.partitionBy("ah", "sh")

    def alike(side: str) -> Column:
        return F.when(F.col(side).isNotNull(), F.sum("weight").over(Window.partitionBy("ah", side)))

    seen = (
        anchors.withColumns({"all": F.sum("weight").over(same)})
        .filter("all > 1 or done")
        .withColumns({"equal": F.sum("weight").over(near), "on_left": alike("left"), "on_right": alike("right")})
        .withColumn("open", _reached())
        .filter("equal > 1 or open or done")
        .withColumn("nth", F.dense_rank().over(same.orderBy(F.desc("open"), "sh")))
        .withColumns({"kinds": F.max(F.when(F.col("open"), F.col("nth"))).over(same), "first": F.row_number().over(near.orderBy("t1", "t2", "lo")) == 1})
    )
    seen = cut(seen.select("ah", "t1", "t2", "lo", "hi", "mid", "equal", "open", "nth", "kinds", "first", "done"))
    whole = seen.filter("equal > 1 or done").select("t1", "t2", F.col("lo").alias("start"), F.col("hi").alias("stop"))
    spread = F.col("kinds") > split_rows
    part = F.when(spread, F.floor(F.col("nth") / split_rows)).otherwise(0)
    several = F.col("equal") > 1
    asked = seen.filter("first and open").withColumns({"part": part, "several": several, "spread": spread})
    return whole, asked.select("t1", "t2", F.struct(*WANT).alias("w"))


def _reached() -> Column:
    """Whether different surroundings of the anchor share a nearer side."""
    return F.coalesce(F.col("on_left") > F.col("equal"), F.lit(False)) | F.coalesce(F.col("on_right") > F.col("equal"), F.lit(False))


def _settle_by_sums(anchors: DataFrame, split_rows: int) -> tuple[DataFrame, DataFrame]:
    """The same for frequent anchors, by aggregations that combine before they shuffle and joins that Spark can split."""
    rows = cut(anchors)
    place = F.struct("t1", "t2", "lo", "hi", "mid")
    kinds = rows.groupBy("ah", "sh").agg(F.sum("weight").alias("equal"), F.min(place).alias("at"), F.min("left").alias("left"), F.min("right").alias("right"))
    kinds = cut(kinds)
    for side in ("left", "right"):
        total = kinds.filter(F.col(side).isNotNull()).groupBy("ah", side).agg(F.sum("equal").alias(f"on_{side}"))
        kinds = kinds.join(total, ["ah", side], "left")
    kinds = cut(kinds.withColumn("open", _reached()).filter("equal > 1 or open"))
    number = stored(kinds.filter("open").groupBy("ah").agg(F.count(F.lit(1)).alias("kinds")))  # one row a frequent anchor
    whole = rows.join(kinds.filter("equal > 1").select("ah", "sh"), ["ah", "sh"]).select("t1", "t2", F.col("lo").alias("start"), F.col("hi").alias("stop"))
    parts = F.ceil(F.col("kinds") / split_rows)
    asked = kinds.filter("open").join(number, "ah").select(
        "at.*", "ah", F.pmod(F.xxhash64("sh"), parts).alias("part"), (F.col("equal") > 1).alias("several"), (parts > 1).alias("spread")
    )
    return whole, asked.select("t1", "t2", F.struct(*WANT).alias("w"))


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed.

    Every byte covered by a string of `length` bytes that also starts anywhere else goes; strings are judged on the input.
    `removed` holds the maximal removed runs as [start, end, start, end, ...].

    1. Anchors: every string of `length` bytes has a piece that its content alone picks. Anchors and hashes of what the strings
       that pick them cover are rows of a few numbers; what repeats within a chunk of text is settled there and goes on once.
    2. An anchor that is alone is done. Surroundings that occur twice repeat as a whole. Surroundings that share neither of
       their nearer sides with different ones can hold no string that those have.
       Anchors that a sample of the texts finds to be frequent are settled by sums and joins, the others in windows.
    3. The other different surroundings of an anchor, one of each, go to a shard: a suffix array by Larsson and Sadakane's refinement
       and common prefixes by Kasai's relation tell which strings repeat. Anchors with very many surroundings are dealt over
       several shards, whose strings are merged afterwards, sorted by digest and found by binary search.
    4. Spans meet per text and cut it.

    Null counts as empty. Texts shorter than `length` stay whole. Repeated rows count as several documents and get equal rows.
    An empty table gives an empty result.
    """
    parts = shuffle_width(docs)
    texts = id_and_text(docs, id_col, text_col).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    anchors = texts.select("t1", "t2", "text").mapInArrow(_anchor_rows(length), ANCHOR_ROW)
    some = texts.select("t1", "t2", "text").sample(SAMPLE, 7).mapInArrow(_anchor_rows(length), ANCHOR_ROW)
    hot = stored(some.filter("not done").groupBy("ah").agg(F.sum("weight").alias("n")).filter(F.col("n") >= SAMPLED_OFTEN).select("ah"))
    if hot.isEmpty():
        whole, asked = _settle_in_windows(anchors, split_rows)
    else:
        anchors = stored(anchors)
        cold = anchors.join(hot.withColumn("hot", F.lit(True)), "ah", "left").filter("done or hot is null").select(*ANCHOR)
        sides = [_settle_in_windows(cold, split_rows), _settle_by_sums(anchors.filter("not done").join(hot, "ah", "left_semi"), split_rows)]
        whole, asked = (x.union(y) for x, y in zip(*sides, strict=True))
        discard(anchors)  # both sides keep what they need of them
    want = asked.groupBy("t1", "t2").agg(F.collect_list("w").alias("want"))
    one = texts.withColumn("nth", F.row_number().over(Window.partitionBy("t1", "t2").orderBy(F.octet_length("text")))).filter("nth = 1")
    pieces = one.join(want, ["t1", "t2"]).select("t1", "t2", "text", "want").mapInArrow(
        _slice_texts, "ah bigint, part bigint, t1 bigint, t2 bigint, lo bigint, several boolean, spread boolean, mid bigint, piece binary"
    )
    dealt = pieces.repartition(parts, "ah", "part").sortWithinPartitions("ah", "part", "t1", "t2", "lo")
    found = cut(dealt.mapInArrow(_shard(length), "t1 bigint, t2 bigint, start bigint, stop bigint, d1 bigint, d2 bigint, known boolean"))
    local = found.filter("d1 is null").select("t1", "t2", "start", "stop")
    across = found.filter("d1 is not null").repartitionByRange(parts, "d1").sortWithinPartitions("d1", "d2")
    spans = whole.union(local).union(across.mapInArrow(_merge, "t1 bigint, t2 bigint, start bigint, stop bigint"))
    by_text = spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return (
        texts.join(by_text, ["t1", "t2"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(
            _cut_texts,
            f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<bigint>",
        )
    )
