"""Submissions that wait for their publication: keyed state with timers."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times are microseconds here, since those in pandas depend on the session's zone.
OUT = "marker string, run string, submitted_at long, published_at long, status string"


class Settler(StatefulProcessor):
    """Keeps a marker's submissions and publications until they meet or `ttl` microseconds are over.

    One timer stands, at the end of the first wait; when it is due, what waited so long
    by the watermark goes, submissions as expired and publications in silence, and the
    next one is set. So state is what arrived within the time to live, and is read and
    written once for a marker's rows and once for its waits that end together.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "run string, at long")
        self.published = handle.getListState("published", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        waiting, published = self._kept()
        had = bool(waiting), bool(published)
        for f in rows:
            for kind, run, at in zip(f["kind"], f["run"], f["us"].astype("int64"), strict=True):
                if kind == "submission":
                    waiting.append((run, int(at)))
                else:
                    published.append(int(at))
        published.sort()
        out, left = [], []
        for run, at in waiting:
            k = bisect_left(published, at - self.ttl)
            if k < len(published) and published[k] <= at + self.ttl:
                out.append((key[0], run, at, published[k], "published"))
            else:
                left.append((run, at))
        self._keep(left, published, had)
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        due = timerValues.getCurrentWatermarkInMs() * 1000 - self.ttl
        waiting, published = self._kept()
        self._keep([w for w in waiting if w[1] > due], [p for p in published if p > due], (bool(waiting), bool(published)))
        yield _frame([(key[0], run, at, None, "expired") for run, at in waiting if at <= due])

    def _kept(self) -> tuple[list, list]:
        return [tuple(w) for w in self.waiting.get()], [p[0] for p in self.published.get()]

    def _keep(self, waiting: list, published: list, had: tuple[bool, bool]) -> None:
        for state, rows, old in ((self.waiting, waiting, had[0]), (self.published, [(p,) for p in published], had[1])):
            if rows:
                state.put(rows)
            elif old:
                state.clear()
        first = min([at for _, at in waiting] + published, default=None)
        if first is not None:
            self.handle.registerTimer(-(-(first + self.ttl) // 1000))

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["marker", "run", "submitted_at", "published_at", "status"])
    return f.astype({"submitted_at": "Int64", "published_at": "Int64"})


def settled(events: DataFrame, ttl_ms: int, late: str = "1 day") -> DataFrame:
    """(marker, run, submitted_at, published_at, status) of a stream of events(marker, kind, run, ts): each submission once, as published or expired.

    kind is submission or publication. They meet if at most ttl_ms lies between them. Rows
    later than the watermark are dropped, so a submission waits ttl_ms and `late` at most.
    Needs a session whose state store is STATE_STORE.
    """
    rows = events.withWatermark("ts", late).select("marker", "kind", "run", "ts", F.unix_micros("ts").alias("us"))
    out = rows.groupBy("marker").transformWithStateInPandas(Settler(ttl_ms * 1000), OUT, "Append", "EventTime")
    return out.select("marker", "run", F.timestamp_micros("submitted_at").alias("submitted_at"), F.timestamp_micros("published_at").alias("published_at"), "status")
