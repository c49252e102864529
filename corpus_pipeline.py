"""The corpus pipeline: language, exact and near copies, benchmark passages, mix.

Each stage takes the documents that the one before it kept, written as Parquet and
read again; `run` does so in the shared folder. Decisions are made row by row: a
row's key is its place in the Parquet files it was read from, so rows that repeat
an id and rows without one are documents of their own in every stage.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import jaccard, simhash
from weft.llm.common import cut, shared_dir
from weft.llm.decontam import decontaminate
from weft.llm.exact_dedup import exact_dedup
from weft.llm.graph import connected_components
from weft.llm.langid import UNKNOWN, fit, predict
from weft.llm.mixing import mix


def _keyed(docs: DataFrame) -> DataFrame:
    """docs, as read from files, with `_row`: the number of a row's file and its place there.

    Files are numbered by name; unlike counters of rows as they are scanned, the key
    does not depend on how a scan is split.
    """
    plain = lambda path: F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")  # noqa: E731  # file:/ and file:/// are both given
    names = docs.sparkSession.createDataFrame(list(enumerate(sorted(docs.inputFiles()))), "_file long, _path string").select("_file", plain(F.col("_path")).alias("_path"))
    rows = docs.select("*", plain(F.col("_metadata.file_path")).alias("_path"), F.col("_metadata.row_index").alias("_at"))
    key = F.when(F.col("_file").isNotNull(), F.col("_file") * F.lit(1 << 40) + F.col("_at")).otherwise(F.raise_error(F.lit("a row of no known file")).cast("long"))
    return rows.join(F.broadcast(names), "_path", "left").select(*docs.columns, key.alias("_row"))


def _collect(spark: SparkSession) -> None:
    """Frees what earlier steps left in the driver: plans and broadcast tables stay until a collection, which a heap with room puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _ranked() -> Column:
    """Orders rows by id, null ones last, then by key."""
    return F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of keyed whose key is not in gone(_gone), without their keys."""
    return keyed.join(gone, F.col("_row") == F.col("_gone"), "left_anti").drop("_row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is ambiguous."""
    seen = predict(docs, fit(docs), extra=docs.columns)
    return seen.where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    keyed = _keyed(docs)
    decided = exact_dedup(keyed.select(_ranked().alias("_key"), "text"), "_key")
    return _without(keyed, decided.where(~F.col("kept")).select(F.col("_key.row").alias("_gone")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near copies.

    Near copies are linked by op6's fingerprints, and by a similarity of 0.8 or more on
    five-word shingles, since most of such texts are beyond op6's radius. A component
    is of links of both.
    """
    keyed = _keyed(docs)
    _collect(spark)
    prints = cut(simhash.links(keyed, "_row"))
    _collect(spark)
    both = prints.union(jaccard.links(keyed, "_row"))
    _collect(spark)
    parts = connected_components(both).select(F.col("node").alias("_member"), "component")
    rows = cut(keyed.select("_row", "doc_id").join(parts, F.col("_row") == F.col("_member")).select(_ranked().alias("key"), "component"))
    # Cut, so that both sides of the join are plain shuffles, whose hot keys Spark can split.
    firsts = cut(rows.groupBy("component").agg(F.min("key").alias("first")))
    gone = rows.join(firsts, "component").where(F.col("key.row") != F.col("first.row"))
    return _without(keyed, gone.select(F.col("key.row").alias("_gone")))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    keyed = _keyed(docs)
    found = decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "_row")
    return _without(keyed, found.where("contaminated").select(F.col("_row").alias("_gone")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, numbered by copy.

    Documents are told apart by id and text, which unlike a row's place repeat from
    run to run, and so do the draws. Rows that agree in both are taken alike.
    """
    named = docs.withColumn("_print", F.xxhash64("text"))
    taken = mix(named.withColumn("_key", F.struct("doc_id", "_print")), "_key").where("copies > 0")
    taken = taken.groupBy(F.col("_key.doc_id").alias("_id"), F.col("_key._print").alias("_of")).agg(F.max("copies").alias("_copies"))
    rows = named.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_of")))
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("copy"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", clean),
    ("source_mixing", mixed),
]

#: The classifier and the random rounding have no SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
