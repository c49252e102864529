"""Registered queries that run a stream over the events there are."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weft.operators.select import _shared
from weft.plans.tables import registrar
from weft.streaming import ledger

QUERIES, SQL, query = registrar()


def folder(spark):
    _shared(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def events(spark, sf_dir):
    # A pattern, since a stream takes folders and patterns and the table may be one file.
    # The table is finished: all of it in one trigger, since later ones would find events late.
    return ledger.read_events(spark, f"{sf_dir}/events.parque[t]", None)


@query("stream_daily", "select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_daily(spark, sf_dir):
    return ledger.run_once(ledger.daily(events(spark, sf_dir)), folder(spark), "complete").withColumn("day", F.to_date("day").cast("string"))


_CLOSED = "select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n, round(sum(value), 4) as total from events where cast(cast(ts as date) as timestamp) + interval 1 day <= (select max(ts) - interval 1 day from events) group by 1, 2"


@query("stream_daily_closed", _CLOSED)
def stream_daily_closed(spark, sf_dir):
    """The days that the watermark has passed, each written once and then forgotten."""
    return ledger.run_once(ledger.daily(events(spark, sf_dir)), folder(spark)).withColumn("day", F.to_date("day").cast("string"))


@query("stream_daily_latest", "select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_daily_latest(spark, sf_dir):
    """In update mode: each day's last row."""
    return ledger.run_once(ledger.daily(events(spark, sf_dir)), folder(spark), "update", keys=["day", "event_type"]).withColumn("day", F.to_date("day").cast("string"))


@query("stream_trailing", "select cast(cast(ts as date) - cast(g as int) as varchar) as start, user_id, count(*) as n from events, range(0, 7) as r(g) group by 1, 2")
def stream_trailing(spark, sf_dir):
    return ledger.run_once(ledger.sliding(events(spark, sf_dir)), folder(spark), "complete").withColumn("start", F.to_date("start").cast("string"))


@query("stream_sessions", """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as s from events), r as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, min(ts) as start, max(ts) + interval 6 hour as "end", count(*) as n from r group by user_id, k""")
def stream_sessions(spark, sf_dir):
    return ledger.run_once(ledger.sessions(events(spark, sf_dir)), folder(spark), "complete")


@query("stream_distinct", "select count(distinct event_id) as events, count(distinct user_id) as users from events")
def stream_distinct(spark, sf_dir):
    rows = ledger.run_once(ledger.distinct(events(spark, sf_dir), ["event_id"]), folder(spark))
    return rows.agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))
