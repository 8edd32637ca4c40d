"""Line deduplication over overlapping windows of consecutive lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import id_and_text

WINDOW = 3


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_text.

    Lines are the parts between line feeds. Of equal windows of `window` consecutive lines the first (by document id, then
    position; null ids first) stays; every line that a later one covers is removed, also where it overlaps the first.

    Windows are compared by 128 hash bits. First positions come from an aggregation that combines before it shuffles, so a
    window that fills the corpus is a row for each task; the join that finds later ones can be split by Spark where a window
    is frequent. Covered positions meet per document, never per window.

    Null text counts as empty: one empty line. Documents shorter than a window keep all lines. Rows that repeat both id and
    text count as one occurrence and get equal rows. An empty table gives an empty result.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    lines = F.split("text", "\n", -1)

    def print_(i: Column) -> Column:
        part = F.array_join(F.slice("lines", i + 1, F.lit(window)), "\n")
        return F.struct(F.xxhash64(part).alias("a"), F.xxhash64(F.lit(1), part).alias("b"))

    starts = F.when(F.size("lines") >= window, F.sequence(F.lit(0), F.size("lines") - window)).otherwise(F.array().cast("array<int>"))
    windows = (
        rows.withColumn("lines", lines)
        .select("doc_id", "tie", F.posexplode(F.transform(starts, print_)).alias("pos", "w"))
        .select(F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.struct("doc_id", "tie", "pos").alias("at"))
    )
    firsts = windows.groupBy("a", "b").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first != last")
    later = windows.join(firsts, ["a", "b"]).filter(F.col("at") > F.col("first"))
    covered = (
        later.groupBy(F.col("at.doc_id").alias("k_id"), F.col("at.tie").alias("k_tie"))
        .agg(F.collect_set("at.pos").alias("starts"))
        .withColumn("gone", F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (window - 1)))))
        .select("k_id", "k_tie", "gone")
    )
    own = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("tie") == F.col("k_tie"))
    kept = F.when(F.col("gone").isNull(), F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(
        F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    )
    return (
        rows.join(covered, own, "left")
        .select("doc_id", lines.alias("lines"), "gone")
        .select("doc_id", "lines", kept.alias("kept"))
        .select(
            "doc_id",
            F.size("lines").cast("bigint").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("bigint").alias("n_removed"),
            F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n").alias("kept_text"),
        )
    )
