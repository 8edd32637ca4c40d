"""Binary token files: flat unsigned ids, 64-bit document offsets, partition bases from prefix sums."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import cut, fresh_dir, id_and_text, shuffle_width
from tesserae.llm.encoder import worker_encoder

END_ID = 1
READ_DOCS = 4096

# Fixed values of the file format. NAME.bin: ids one after another, little-endian, of the width that the index states.
# NAME.idx: eight bytes MAGIC, then little-endian 64-bit integers: the bytes of an id (2 or 4), the number n of documents,
# n + 1 offsets in ids into NAME.bin, n document ids, n flags (1: the document id is null).
MAGIC = b"TSRTOK01"
HEADER = 3 * 8


def _put(fs: pafs.FileSystem, path: str, write) -> None:
    with fs.open_output_stream(path) as out:
        write(out)


def _writer(model: str, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        own = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        name = f"{root}/{own}"
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        fs.create_dir(root, recursive=True)
        enc = worker_encoder(model)
        width = 2 if max(enc.lib.get_vocab_size(with_added_tokens=True), end_id) < 1 << 16 else 4
        sizes, docs, nulls = [], [], []

        def body(out) -> None:
            batch: pa.RecordBatch | None = first
            while batch is not None:
                docs.append(batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls.append(batch["doc_id"].is_null().to_numpy(zero_copy_only=False).astype("<i8"))
                for a, z, ids, offsets in enc.slices(batch["text"]):
                    n = np.diff(offsets) + 1
                    sizes.append(n)
                    out.write(np.insert(ids, offsets[1:], end_id).astype(f"<u{width}").tobytes())
                batch = next(batches, None)

        _put(fs, f"{name}.bin", body)
        upto = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype("<i8")
        head = np.array([width, len(upto) - 1], dtype="<i8")
        _put(fs, f"{name}.idx", lambda out: out.write(b"".join([MAGIC, *(x.tobytes() for x in (head, upto, *docs, *nulls))])))
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([task.partitionId()], pa.int64()), "path": pa.array([f"{folder}/{own}"]), "n_docs": pa.array([len(upto) - 1], pa.int64()), "n_tokens": pa.array([int(upto[-1])], pa.int64())}
        )

    return run


def write_token_files(
    docs: DataFrame, model: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID
) -> DataFrame:
    """Write the ids of every text, each followed by end_id, in ascending document order (null ids first).

    Returns the manifest: part, path, n_docs, n_tokens, doc_base, token_base; bases are prefix sums over the parts, so the
    parts read one after another are one array. `folder` is a URI that all workers can write to and pyarrow can open; unset, a new one below the
    shared folder. Ids take two bytes if the vocabulary allows it, else four. Parts are ranges of document ids. File names
    carry the attempt that wrote them and no attempt touches another's files: the manifest has those of the attempt whose result counts,
    and what a lost or slower attempt left is named nowhere.

    Null text counts as empty (the end id only). Repeated ids are ordered by a hash of the text. An empty table writes nothing.
    """
    folder = folder or fresh_dir(docs.sparkSession, "tokens")
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(shuffle_width(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    parts = cut(dealt.mapInArrow(_writer(model, folder, end_id), "part bigint, path string, n_docs bigint, n_tokens bigint"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    return parts.select(
        "part",
        "path",
        "n_docs",
        "n_tokens",
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base"),
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("token_base"),
    )


class TokenFile:
    """One part, memory-mapped where its file system is local and read by ranges elsewhere."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        opened = (lambda p: pa.memory_map(p)) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
        index = opened(f"{path}.idx").read_buffer()
        if index[:8].to_pybytes() != MAGIC:
            raise ValueError(f"{uri}.idx is not a token index")
        self.width, n = (int(x) for x in np.frombuffer(index, dtype="<i8", count=2, offset=8))
        self.offsets = np.frombuffer(index, dtype="<i8", count=n + 1, offset=HEADER)
        self.doc_ids = np.frombuffer(index, dtype="<i8", count=n, offset=HEADER + 8 * (n + 1))
        self.null = np.frombuffer(index, dtype="<i8", count=n, offset=HEADER + 8 * (2 * n + 1)).astype(bool)
        self.file = opened(f"{path}.bin")

    def ids(self, a: int, z: int) -> np.ndarray:
        """Ids of documents a to z - 1."""
        lo, hi = int(self.offsets[a]), int(self.offsets[z])
        self.file.seek(lo * self.width)
        return np.frombuffer(self.file.read_buffer((hi - lo) * self.width), dtype=f"<u{self.width}")


def _reader(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch["path"].to_pylist(), batch["token_base"].to_pylist(), strict=True):
                part = TokenFile(uri)
                for a in range(0, len(part.doc_ids), READ_DOCS):
                    z = min(a + READ_DOCS, len(part.doc_ids))
                    bounds = part.offsets[a : z + 1]
                    span, at = part.ids(a, z).astype("<u4"), bounds - bounds[0]
                    docs = [span[lo:hi] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    out = {
                        "doc_id": pa.array(part.doc_ids[a:z], pa.int64(), mask=part.null[a:z]),
                        "start": pa.array(base + bounds[:-1], pa.int64()),
                        "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(d) for d in docs], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([d.astype(np.int64) for d in docs], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    return run


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files in a manifest: doc_id, start (over all parts), n_tokens, ids_crc32, and ids if asked for."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    dealt = manifest.select("part", "path", "token_base").repartition(shuffle_width(manifest), "part")
    return dealt.mapInArrow(_reader(with_ids), schema)
