"""Writers: tables, state that is updated by key, citations and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.ledger import upsert


def write_table(df: DataFrame, path: str, kind: str = "parquet", **options: object) -> None:
    """Overwrites by Spark's commit protocol: readers see the old table or the new one."""
    df.write.mode("overwrite").options(**options).format(kind).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    write_table(df, path, "csv", header=True)


def current_state(spark: SparkSession, root: str) -> str | None:
    """The path of the state's current version; None if there is none yet."""
    try:
        return spark.read.text(f"{root}/current").first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def update_state(spark: SparkSession, root: str, news: DataFrame, keys: list[str], order: str, tries: int = 5) -> str:
    """Writes the state under root with news put in by key, as a new version; gives its path.

    Versions are folders; the pointer table names the current one and is written last, so a
    failed update leaves the old state in place. If another writer has moved the pointer
    meanwhile, the news are put into its version instead, `tries` times at most.
    """
    for _ in range(tries):
        old = current_state(spark, root)
        state = spark.read.parquet(old) if old else news.drop(order).limit(0)
        new = f"{root}/version-{uuid.uuid4().hex}"
        upsert(state, news, keys, order).write.parquet(new)
        if current_state(spark, root) == old:
            spark.createDataFrame([(new,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/current")
            return new
    raise RuntimeError(f"other writers moved {root} {tries} times")


def bibtex(refs: DataFrame) -> DataFrame:
    """(value): an entry for each of refs(key, author, title, year, doi)."""
    field = lambda k: F.concat(F.lit(f"  {k} = {{"), F.coalesce(F.col(k).cast("string"), F.lit("")), F.lit("},\n"))
    return refs.select(F.concat(F.lit("@article{"), "key", F.lit(",\n"), *[field(k) for k in ("author", "title", "year", "doi")], F.lit("}")).alias("value"))


def export_manifest(files: DataFrame, by: str) -> DataFrame:
    """(by, manifest JSON) of files(by, name, bytes, sha256), names in order."""
    return files.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "bytes", "sha256")))).alias("manifest"))


def forest_rows(effects: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """What a forest plot draws: study, effect, interval and share of weight."""
    w = 1 / (F.col("se") * F.col("se"))
    total = effects.agg(F.sum(w).alias("_total"))
    return effects.join(F.broadcast(total)).select("study", "effect", (F.col("effect") - z * F.col("se")).alias("low"), (F.col("effect") + z * F.col("se")).alias("high"), (w / F.col("_total")).alias("weight"))


def pack_version(packs: DataFrame, fresh: DataFrame) -> DataFrame:
    """fresh(slug, pack_data) that differ from the latest of packs(slug, version, pack_hash), with their next version."""
    last = packs.groupBy("slug").agg(F.max("version").alias("_v"), F.max_by("pack_hash", "version").alias("_h"))
    new = fresh.withColumn("pack_hash", F.sha2("pack_data", 256)).join(last, "slug", "left")
    return new.where(~F.col("pack_hash").eqNullSafe(F.col("_h"))).select("slug", (F.coalesce("_v", F.lit(0)) + 1).alias("version"), "pack_hash", "pack_data")
