"""Rows that several later steps read, kept once in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from the folder that spark.checkpoint.dir names, without what led to them; in local mode a temporary one where it is unset.

    Lost executors do not lose them, and they take no executor memory.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="tesserae-")
            atexit.register(shutil.rmtree, where.removeprefix("file://"), ignore_errors=True)
            spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint()
