"""The corpus pipeline: language, exact copies, near copies, benchmark passages, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and returns a DataFrame; all but the last
return the columns of documents. Decisions are by row, so ids may repeat or be null: where an operator looks at one text at a
time the row itself goes through it, and where it compares rows each gets a number of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import fresh_dir, stored
from tesserae.llm.decontaminate import decontaminate
from tesserae.llm.exact_dedup import exact_dedup
from tesserae.llm.jaccard_join import jaccard_join
from tesserae.llm.language import fit_language_models, identify
from tesserae.llm.packing import pack

ORACLE_SQL = None  # language models and tokens have no SQL; the stages are tested against brute force


def carried(docs: DataFrame) -> DataFrame:
    """Each row as one value `row`, next to its text; an operator that decides by text alone passes it on as the id."""
    return docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), "text")


def unpacked(found: DataFrame, columns: list[str]) -> DataFrame:
    """The carried rows, columns as they were."""
    return found.select(*[F.col(f"doc_id.c{i}").alias(c) for i, c in enumerate(columns)])


def numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs as c0, c1, ... with `text`, `row`, a number of its own for each row, and `rank`, which orders rows by id (null last)
    and content.

    Written out, so that every read of it, also one after a lost task, finds the same numbers. Rows that differ in nothing may
    swap numbers from run to run.
    """
    digest = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in docs.columns])
    values = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = stored(docs.select(*values, F.monotonically_increasing_id().alias("row"), digest.alias("digest")))
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    rank = F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), "digest", "row")
    return rows.withColumns({"rank": rank, "text": text}).drop("digest")


def without(rows: DataFrame, dropped: DataFrame, columns: list[str]) -> DataFrame:
    """The numbered rows that are not dropped; columns as they were.

    The numbers of dropped rows are written first, so that Spark knows their size and moves no texts where they are few.
    """
    kept = rows.join(stored(dropped.select("row")), "row", "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language model rejects; models learn from the labelled documents of the table itself.

    Where nothing is labelled there is no model, and only texts without a letter go.
    """
    found = identify(carried(docs), fit_language_models(docs), id_col="row")
    return unpacked(found.filter(~F.col("rejected")), docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one that the operator keeps."""
    rows = numbered(spark, docs)
    return without(rows, exact_dedup(rows, id_col="rank").filter("not kept").select("doc_id.row"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, 0.8): the one with the smallest id, null last."""
    rows = numbered(spark, docs)
    found = jaccard_join(rows, id_col="row", width=5, percent=80).select(F.col("doc_id").alias("row"), "component_id")
    groups = stored(found.join(rows.select("row", "rank"), "row"))
    first = groups.groupBy("component_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return without(rows, groups.join(first, "component_id").filter("rank != first"), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(carried(docs), benchmark, id_col="row")
    return unpacked(found.filter(~F.col("contaminated")), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in their sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
