"""Ledger operators over an event stream.

Each function takes a streaming DataFrame of events(event_id, ts, user_id,
event_type, value) and gives a streaming one. State is bounded by the watermark, but for distinct().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "1 day"


def read_events(spark: SparkSession, path: str, max_files: int | None = 8) -> DataFrame:
    """A file stream with the schema of what lies there; event time is a timestamp.

    Without max_files one trigger takes every file there is, so that events of a
    finished table, whose files are in no order of time, are never late.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    stream = (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily(events: DataFrame) -> DataFrame:
    """(day, event_type, n, total) by event time."""
    return (
        events.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("day"), "event_type", "n", "total")
    )


def sliding(events: DataFrame, width: str = "7 days", step: str = "1 day") -> DataFrame:
    """(start, user_id, n) over trailing windows."""
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", width, step).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events less than a gap apart."""
    return events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys)


def distinct(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key, however far apart; state is a row for each key."""
    return events.dropDuplicates(keys)


def run_once(stream: DataFrame, folder: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what there is; gives the rows it wrote under folder.

    Each batch is written whole, under its number, so a batch that is run again
    replaces itself. In complete mode the last batch counts, in update mode each key's
    row of its last batch.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of a row")
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    query: StreamingQuery = writer.foreachBatch(sink or save).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == last)
    elif mode == "update":
        values = [c for c in rows.columns if c != "batch"]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_r")).select("_r.*")
        return rows
    return rows.drop("batch")
