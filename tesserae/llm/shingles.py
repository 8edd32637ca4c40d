"""Sets of word shingles of whole Arrow batches as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes whose words are hashed together
SLICE_BYTES = 1 << 20  # text whose shingles are made together

# Words are runs of bytes other than 20 and 09-0D, after A-Z became a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[0x20] = IS_SPACE[0x09:0x0E] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values, one for each salt."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(256, dtype=np.uint64), 7) | np.uint64(1)
BASE = np.uint64(0xD1342543DE82EF95)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of joined texts, in order, and how many words end up to each text's end."""
    hashes, starts_at = [], []
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    a = 0
    while a < len(data):
        z = min(a + CHUNK, len(data))
        while z < len(data) and not IS_SPACE[data[z]]:  # a chunk ends at a space: no word is cut
            more = np.flatnonzero(IS_SPACE[data[z : z + CHUNK]])
            z = z + int(more[0]) if len(more) else min(z + CHUNK, len(data))
        low = LOWER[data[a:z]]
        word = ~IS_SPACE[low]
        first = word.copy()
        first[1:] &= ~word[:-1]
        own = begins[(begins >= a) & (begins < z)] - a
        first[own] = word[own]
        at = np.flatnonzero(word)
        if len(at):
            head = np.flatnonzero(first[at])
            starts = at[head]
            length = np.diff(np.append(head, len(at)))
            place = np.arange(len(at)) - np.repeat(head, length)
            terms = BYTE[low[at]] * _powers(int(length.max()))[place]
            hashes.append(mix(np.add.reduceat(terms, head) + mix(length.astype(np.uint64), 3)))
            starts_at.append(starts + a)
        a = z
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(ends), dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_at), ends)


def shingle_sets(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of joined texts (at most 65,535): distinct shingle hashes, sorted within each text, and the offsets of texts in them."""
    words, upto = word_hashes(data, ends)
    count = np.diff(np.concatenate(([0], upto)))
    doc = np.repeat(np.arange(len(ends), dtype=np.uint16), count)
    some, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint16)
    if len(words) >= width:
        whole = doc[: len(doc) - width + 1] == doc[width - 1 :]
        value = np.zeros(len(words) - width + 1, dtype=np.uint64)
        for j in range(width):
            value += mix(words[j : len(words) - width + 1 + j], 11 + j)
        some, owner = value[whole], doc[: len(whole)][whole]
    for n in range(1, width):  # texts of fewer words: the whole sequence
        short = np.flatnonzero(count == n)
        if len(short):
            value = np.full(len(short), mix(np.array([n], dtype=np.uint64), 5)[0])
            for j in range(n):
                value += mix(words[upto[short] - n + j], 11 + j)
            some, owner = np.concatenate((some, value)), np.concatenate((owner, short.astype(np.uint16)))
    some = mix(some, 2)
    order = np.argsort(some)
    order = order[np.argsort(owner[order], kind="stable")]
    some, owner = some[order], owner[order]
    new = np.ones(len(some), dtype=bool)
    new[1:] = (some[1:] != some[:-1]) | (owner[1:] != owner[:-1])
    some, owner = some[new], owner[new]
    return some, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(ends)))))


def batches_of_sets(text: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about SLICE_BYTES each with shingle hashes and offsets."""
    raw = text.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8) if len(raw) else np.zeros(0, np.uint8)
    a = 0
    while a < len(raw):
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, side="right")) - 1)
        z = min(z, len(raw), a + 65_000)
        hashes, bounds = shingle_sets(data[offsets[a] : offsets[z]], offsets[a + 1 : z + 1] - offsets[a], width)
        yield a, z, hashes, bounds
        a = z


def digests(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell whole sets apart, as two signed 64-bit columns."""
    out = []
    for salt in (21, 22):
        upto = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(hashes, salt), dtype=np.uint64)))
        out.append((upto[bounds[1:]] - upto[bounds[:-1]]).view(np.int64))
    return out[0], out[1]
