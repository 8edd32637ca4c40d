"""Exact deduplication by a distributed content sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import cut, id_and_text, shuffle_width

SPACE = r"[\x20\x09-\x0D]+"
HEAD = 48  # leading characters that, with a fingerprint, place a text in the sort order


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space. Of equal texts the one with the most code points in
    the original stays, then the smallest id (null ids last).

    The content sort: splitters sampled by Spark range-partition the rows by the head of the normalised text and its
    fingerprint, each partition is sorted externally by the whole text, and neighbours are compared in full. Heads keep the
    sampled splitters small. A text that holds more than its share of a partition is dealt over several salts; the few
    winners of those parts are merged afterwards by digest, at most four parts of the table per partition.

    Null text counts as empty; empty texts form one group. Repeated rows each get a row and only one of them is kept.
    An empty table gives an empty result. Other columns of the input are ignored.
    """
    width = shuffle_width(docs)
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", F.char_length("text").alias("n_cp"), normalised(F.col("text")).alias("norm")
    ).withColumn("print", F.xxhash64("norm"))
    share = max(1, docs.count() // (4 * width))
    hot = [r[0] for r in rows.groupBy("print").count().filter(F.col("count") > share).select("print").collect()]
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(width)).cast("int")
    dealt = rows.withColumn("head", F.substring("norm", 1, HEAD))
    keys = ["head", "print"]
    if hot:  # a constant would keep the windows from using the ranges as they are
        dealt, keys = dealt.withColumn("salt", F.when(F.col("print").isin(hot), spread).otherwise(F.lit(-1))), [*keys, "salt"]
    dealt = dealt.repartitionByRange(width, *keys)
    same = Window.partitionBy(*keys, "norm")
    first = same.orderBy(F.desc("n_cp"), F.asc_nulls_last("doc_id"))
    out = dealt.select(
        "doc_id",
        *(["salt"] if hot else []),
        F.first("doc_id").over(first).alias("keep_id"),
        F.first("n_cp").over(first).alias("top_cp"),
        F.count(F.lit(1)).over(same).alias("group_size"),
        (F.row_number().over(first) == 1).alias("kept"),
        F.sha2(F.col("norm"), 256).alias("text_sha256"),
    )
    if hot:
        out = _merge_parts(cut(out))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _merge_parts(parts: DataFrame) -> DataFrame:
    """Rows of salted texts get the winner and the size over all salts."""
    rank = F.struct(-F.col("top_cp"), F.col("keep_id").isNull(), "keep_id", "salt")
    whole = (
        parts.filter((F.col("salt") >= 0) & F.col("kept"))
        .groupBy("text_sha256")
        .agg(F.min(rank).alias("best"), F.sum("group_size").alias("size"))
        .select("text_sha256", F.col("best.keep_id").alias("best_id"), F.col("best.salt").alias("best_salt"), "size")
    )
    mine = F.col("size").isNotNull()
    return parts.join(whole, "text_sha256", "left").select(
        "doc_id",
        F.when(mine, F.col("best_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", "group_size").alias("group_size"),
        (F.col("kept") & (~mine | (F.col("salt") == F.col("best_salt")))).alias("kept"),
        "text_sha256",
    )
