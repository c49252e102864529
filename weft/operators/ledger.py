"""Ledger queries: funnels, time-to-live, trailing windows and upserts.

A ledger is a table of events (id, ts, topic, status). `now` is an argument
everywhere, so that results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def conversion_funnel(events: DataFrame, who: str, stages: dict[str, Column]) -> DataFrame:
    """(stage, candidates): distinct candidates in each stage, in one pass over candidates."""
    flags = events.groupBy(who).agg(*[F.bool_or(c).alias(k) for k, c in stages.items()])
    return flags.agg(*[F.count_if(F.col(k)).alias(k) for k in stages]).unpivot([], list(stages), "stage", "candidates")


def top_blockers(events: DataFrame, who: str, code: str, k: int = 8) -> DataFrame:
    """The k codes that block most candidates; ties by code."""
    return events.groupBy(code).agg(F.countDistinct(who).alias("candidates")).orderBy(F.desc("candidates"), code).limit(k)


def daily_throughput(events: DataFrame, ts: str, status: str, run: str) -> DataFrame:
    """(day, runs, done): a run counts once a day with its latest status."""
    last = events.groupBy(F.to_date(ts).alias("day"), run).agg(F.max_by(status, F.struct(ts, "event_id")).alias("status"))
    return last.groupBy("day").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "purchase").alias("done"))


def recent(events: DataFrame, ts: str, fallback: str, now: Column, days: int) -> DataFrame:
    return events.where(F.coalesce(ts, fallback) >= now - F.expr(f"interval {days} days"))


def last_wins(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key, whole; any one of equal rows."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")


def trailing_top(events: DataFrame, ts: str, bucket: str, now: Column, days: int = 30, k: int = 8) -> DataFrame:
    return events.where((F.col(ts) >= now - F.expr(f"interval {days} days")) & (F.col(ts) <= now)).groupBy(bucket).agg(F.count("*").alias("n")).orderBy(F.desc("n"), bucket).limit(k)


def yield_stop(pages: DataFrame, lane: str, page: str, size: int = 5) -> DataFrame:
    """(lane, page, stop): new < 2 %, core < 1 % or noise > 95 % over the last `size` pages.

    pages(lane, page, hits, new, core, noise); a lane's window is a few rows wide.
    """
    w = W.partitionBy(lane).orderBy(page).rowsBetween(1 - size, 0)
    share = lambda c: F.sum(c).over(w) / F.greatest(F.sum("hits").over(w), F.lit(1))
    full = F.count("*").over(w) == size
    return pages.select(lane, page, (full & ((share("new") < 0.02) | (share("core") < 0.01) | (share("noise") > 0.95))).alias("stop"))


def compact_history(events: DataFrame, key: str, status: str, terminal: list[str], order: list[str], rounds: int) -> DataFrame:
    """Of each key the latest row of each terminal status, and the last `rounds` other rows."""
    down = [F.desc(c) for c in order]
    ends = events.where(F.col(status).isin(*terminal)).withColumn("_k", F.row_number().over(W.partitionBy(key, status).orderBy(*down))).where("_k = 1")
    rest = events.where(~F.col(status).isin(*terminal)).withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*down))).where(F.col("_k") <= rounds)
    return ends.union(rest).drop("_k")


def drought(events: DataFrame, by: str, ts: str, now: Column, degraded_h: int, failed_h: int) -> DataFrame:
    """(by, hours, status) since the last event: pass, degraded or fail."""
    hours = ((F.unix_timestamp(now) - F.unix_timestamp(F.max(ts))) / 3600).alias("hours")
    rows = events.groupBy(by).agg(hours)
    return rows.select(by, F.round("hours", 4).alias("hours"), F.when(F.col("hours") > failed_h, "fail").when(F.col("hours") > degraded_h, "degraded").otherwise("pass").alias("status"))


def blocker_histogram(events: DataFrame, topic: str, gate: str, ts: str, order: str, samples: int = 3) -> DataFrame:
    """(topic, gate, n, last_seen, samples): the latest ids come from a ranking cut early."""
    w = W.partitionBy(topic, gate).orderBy(F.desc(ts), F.desc(order))
    counts = events.groupBy(topic, gate).agg(F.count("*").alias("n"), F.max(ts).alias("last_seen"))
    top = events.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= samples).groupBy(topic, gate).agg(F.array_sort(F.collect_list(order)).alias("samples"))
    return counts.join(top, [topic, gate])


def cooldown(attempts: DataFrame, topic: str, ts: str, done: Column, now: Column, days: int) -> DataFrame:
    """(topic, last_attempt, blocked): unfinished attempts inside the window."""
    inside = F.col(ts) >= now - F.expr(f"interval {days} days")
    return attempts.groupBy(topic).agg(F.max(ts).alias("last_attempt"), F.count_if(inside & ~done).alias("blocked"))


def upsert(state: DataFrame, news: DataFrame, keys: list[str], order: str) -> DataFrame:
    """state with the newest row of news for each key put in its place."""
    new = news.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in state.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")
    return state.join(new, keys, "left_anti").unionByName(new.select(*state.columns))


def reviews_by_day(reviews: DataFrame, day: str, review: str, decision: str, order: str) -> DataFrame:
    """(day, decision, n): a review counts once a day, with its last decision."""
    last = reviews.groupBy(day, review).agg(F.max_by(decision, order).alias(decision))
    return last.groupBy(day, decision).agg(F.count("*").alias("n"))


def capped(events: DataFrame, title: str, handled: Column, cap: int) -> DataFrame:
    """(title, rounds, capped)."""
    return events.groupBy(title).agg(F.count_if(handled).alias("rounds")).withColumn("capped", F.col("rounds") >= cap)


def repeated_gate(events: DataFrame, topic: str, code: str, order: list[str], prefix: str, threshold: int) -> DataFrame:
    """(topic, code, n) where a topic's last code with a prefix has come up `threshold` times."""
    own = events.where(F.col(code).startswith(prefix))
    last = own.groupBy(topic).agg(F.max_by(code, F.struct(*order)).alias(code))
    return own.join(last, [topic, code]).groupBy(topic, code).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
