"""Token ids of whole Arrow batches with a tokenizers file, encoding each distinct word once."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 3 << 20  # text encoded together
LEARN_WORDS = 256  # new words that the library encodes at once
CACHE_WORDS = 600_000  # words remembered before the memory of them starts anew


def words_stand_alone(spec: dict) -> bool:
    """Whether text can be cut at ASCII white space without changing its ids.

    True if white space is dropped before the model sees words, every kept match is free of it, and normalisation changes
    characters one by one or composes them: then nothing reaches across a space.
    """
    steps = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
    plain = all(
        s.get("type") in ("NFC", "Lowercase") or (s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"}) for s in steps
    )
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", r"\s")
    kept = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    spaceless = " " not in pattern and r"\s" not in pattern.replace(r"[^\s", "[^") and "." not in pattern
    clean = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
    return plain and kept and spaceless and clean and spec.get("post_processor") is None


class Encoder:
    """Encodes Arrow string arrays to flat ids and offsets."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back to the machine between slices
        self.lib = Tokenizer.from_file(model)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(model, encoding="utf-8") as f:
            self.by_word = words_stand_alone(json.load(f))
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.starts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _learn(self, words: list[str]) -> None:
        """Encode new words, many in one text; a token belongs to the word in which its characters start."""
        flat, sizes = [self.flat], [self.sizes]
        for a in range(0, len(words), LEARN_WORDS):
            some = words[a : a + LEARN_WORDS]
            begins = np.cumsum([0, *(len(w) + 1 for w in some)])
            got = self.lib.encode(" ".join(some), add_special_tokens=False)
            starts = np.fromiter((o[0] for o in got.offsets), dtype=np.int64)
            sizes.append(np.diff(np.searchsorted(starts, begins)))
            flat.append(np.array(got.ids, dtype=np.uint32))
        self.flat, self.sizes = np.concatenate(flat), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and the offsets at which each text's ids start."""
        if not self.by_word:
            ids = [x.ids for x in self.lib.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(sizes.sum()))
            return flat, np.concatenate(([0], np.cumsum(sizes)))
        lists = pc.ascii_split_whitespace(texts)
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        if not len(words):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
        if len(self.known) > CACHE_WORDS:
            self._forget()
        found = pc.index_in(words, value_set=self.known)
        new = found.is_null()
        fresh = new.to_numpy(zero_copy_only=False)
        place = found.fill_null(0).to_numpy().astype(np.int64)
        if found.null_count:
            place[fresh] = len(self.known) + np.arange(found.null_count)
            added = words.filter(new)
            self._learn(added.to_pylist())
            self.known = pa.concat_arrays([self.known, added])
        word = place[coded.indices.to_numpy()]
        sizes = self.sizes[word]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.flat[np.repeat(self.starts[word] - upto[:-1], sizes) + np.arange(upto[-1])]
        return flat, upto[bounds - bounds[0]]

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Row ranges of about SLICE_BYTES each, with ids and offsets."""
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(texts):
            base = upto[a - 1] if a else 0
            z = max(a + 1, int(np.searchsorted(upto, base + SLICE_BYTES, side="right")))
            ids, offsets = self.encode(texts.slice(a, z - a))
            yield a, min(z, len(texts)), ids, offsets
            a = z


@functools.lru_cache(1)
def _kept(model: str) -> Encoder:
    return Encoder(model)


def worker_encoder(model: str) -> Encoder:
    """The worker's encoder. Where the package can be imported it keeps its words from task to task."""
    try:
        from tesserae.llm import encoder
    except ImportError:
        return Encoder(model)
    return encoder._kept(model)
