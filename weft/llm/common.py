"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the controls from tab to carriage return.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. A temporary one serves local sessions only."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="weft-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of its file system, the default one where it names none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_of(id_col: str) -> Column:
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` runs; null has none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, WS_RUN))).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from the columns' values."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))
