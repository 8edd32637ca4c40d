"""Token counts: Arrow batches balanced by bytes, lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import id_and_text

LIMIT = 4096
BATCH_BYTES = 1 << 20
PIECE_BYTES = 1 << 16


def cuts_are_safe(pieces: list[str]) -> bool:
    """Whether no vocabulary piece has the word mark after another character, so that tokens never cross a word start."""
    return not any(re.search("[^▁]▁", p) for p in pieces)


def split_safely(text: str, limit: int) -> list[str]:
    """Parts of about limit characters at most, cut at single spaces between two other non-space characters.

    Such a space is dropped: the encoder puts its word mark before a part just as it does for the space. A text with no such
    place near the limit is cut at the next one.
    """
    parts, start = [], 0
    while len(text) - start > limit:
        at = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])").search(text, start + limit)
        if at is None:
            break
        parts.append(text[start : at.start()])
        start = at.end()
    return [*parts, text[start:]]


def _count_pieces(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        safe = cuts_are_safe([lib.id_to_piece(i) for i in range(lib.vocab_size())])

        def count(texts: list[str]) -> list[int]:
            return [len(x) for x in lib.encode(texts, num_threads=1)]

        for batch in batches:
            parts: list[str] = []
            owner: list[int] = []
            totals, held = [0] * len(batch), 0

            def flush() -> None:
                nonlocal held
                for o, n in zip(owner, count(parts), strict=True):
                    totals[o] += n
                parts.clear()
                owner.clear()
                held = 0

            for i, (text, size) in enumerate(zip(batch["text"], batch["n_bytes"].to_pylist(), strict=True)):
                text = text.as_py()
                long = safe and size > PIECE_BYTES
                for part in split_safely(text, PIECE_BYTES if size == len(text) else PIECE_BYTES // 4) if long else (text,):
                    parts.append(part)
                    owner.append(i)
                    held += len(part.encode()) if long else size
                    if held >= BATCH_BYTES:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_bytes"], pa.array(totals, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def _count_words(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(model)
        lib.no_truncation()
        lib.no_padding()
        for batch in batches:
            totals: list[int] = []
            group: list[str] = []
            held = 0
            for text, size in zip(batch["text"], batch["n_bytes"].to_pylist(), strict=True):
                group.append(text.as_py())
                held += size
                if held >= BATCH_BYTES:
                    totals += [len(x.ids) for x in lib.encode_batch(group, add_special_tokens=False)]
                    group, held = [], 0
            totals += [len(x.ids) for x in lib.encode_batch(group, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_bytes"], pa.array(totals, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens (as the library of `model` gives them), over_limit.

    `model` is a .model file (sentencepiece) or a .json file (tokenizers), at the same path on every worker. No begin, end or
    added special tokens, no truncation or padding. Tasks return lengths only, with no shuffle. Batches go to the encoder by
    bytes; with sentencepiece, texts over PIECE_BYTES are split at single spaces, if the vocabulary has no piece that crosses a
    word start.

    Null text counts as empty and has no tokens. Repeated rows each get a row; an empty table gives an empty result.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    count = _count_pieces(model) if model.endswith(".model") else _count_words(model)
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
