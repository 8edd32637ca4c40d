"""What the corpus operators share: the cluster's shared folder and input columns."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_BYTES = "8MB"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a temporary one where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        atexit.register(shutil.rmtree, where.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from the shared folder, with no lineage before them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder, whose size Spark then knows."""
    out = fresh_dir(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def discard(table: DataFrame) -> None:
    """Remove the files of a stored table that nothing will read again."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES to Python, where the session still has Spark's own default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64MB").lower() in ("64mb", "67108864", "67108864b"):
        spark.conf.set(key, BATCH_BYTES)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two input columns, under names of our own; null text becomes empty."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ordered(rows: DataFrame, keys: list[str | Column], within: list[str] | None = None) -> DataFrame:
    """The rows as a stored table with `at`, a number that ascends in the order of the keys over the whole table.

    Sampled ranges of the keys are sorted each on its own, so a group that fills a third of the table is spread like the others.
    `within` gives the whole order where keys are short forms of it, since the driver samples keys.
    """
    ranges = rows.repartitionByRange(shuffle_width(rows), *keys).sortWithinPartitions(*(within or keys))
    return stored(ranges.withColumn("at", F.monotonically_increasing_id()))


def positions(table: DataFrame, group: list[str]) -> DataFrame:
    """Of a table that `ordered` returned, by keys that begin with `group`: adds pos, from 0 within each group.

    The few numbers that this takes are one row for each group and range.
    """
    rows = table.withColumn("range", F.shiftrightunsigned("at", 33))
    tally = rows.groupBy("range", *group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(tally.select("range", *group, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base")))
    same = F.lit(True)
    for c in ["range", *group]:
        same = same & rows[c].eqNullSafe(bases[c])
    return rows.join(bases, same).select(*[rows[c] for c in table.columns], (rows["at"] + bases["base"]).alias("pos"))
