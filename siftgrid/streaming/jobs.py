"""Structured Streaming jobs over event and document streams.

Each takes a streaming DataFrame and returns one; the caller starts the query
with a checkpoint location. State is bounded by watermarks, by a time to live, or
by a limit a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftgrid.operators import detect

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def scan(docs: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Stateless: matches of the broad rules in each record (doc_id, source, content) as it arrives."""
    return detect.app_findings(docs, patterns).select("doc_id", "source", "rule", "value", "line", "severity")


def dedup(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def counters(events: DataFrame, idle: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Running count and sum by user and kind, sent whenever they change; update mode.

    A pair without events for `idle` (event time, behind the watermark) is forgotten and starts
    again from nothing, so state is bounded by active pairs.
    """
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0.0)
        newest = state.getCurrentWatermarkMs()
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
            newest = max(newest, int(b["ts"].max().timestamp() * 1000))
        state.update((n, total))
        state.setTimeoutTimestamp(newest + millis)
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "n": [n], "total": [total]})

    return events.withWatermark("ts", late).groupBy("user_id", "event_type").applyInPandasWithState(
        update, "user_id long, event_type string, n long, total double", "n long, total double", "update", GroupStateTimeout.EventTimeTimeout
    )


def windowed_counters(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by window and kind; a window is final once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def suppressed(findings: DataFrame, hidden: DataFrame) -> DataFrame:
    """Stream-static anti-join: findings whose id isn't in the table of hidden ids."""
    return findings.join(hidden, "id", "left_anti")


def top_by_value(events: DataFrame, most: int = 300, idle: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """user_id, seen, event_id, value: each user's events of highest value, kept in state; a `reset` event empties it.

    Emits a user's whole list whenever events come; the list with the highest `seen` (events so far) is the last. A user without events for `idle`
    (event time, behind the watermark) is forgotten, so state is bounded by
    active users times `most`.
    """
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, values, seen = state.get if state.exists else ([], [], 0)
        top = dict(zip(ids, values, strict=True))
        newest = state.getCurrentWatermarkMs()
        for b in batches:
            b = b.sort_values("event_id")
            seen += len(b)
            newest = max(newest, int(b["ts"].max().timestamp() * 1000))
            resets = b.loc[b["event_type"] == "reset", "event_id"]
            if len(resets):
                top.clear()
                b = b[b["event_id"] > resets.max()]
            top.update(zip(b["event_id"].astype(int), b["value"].astype(float), strict=True))
            top = dict(sorted(top.items(), key=lambda x: (-x[1], x[0]))[:most])
        state.update((list(top), list(top.values()), seen))
        state.setTimeoutTimestamp(newest + millis)
        yield pd.DataFrame({"user_id": key[0], "seen": seen, "event_id": list(top), "value": list(top.values())})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(
        update, "user_id long, seen long, event_id long, value double", "ids array<long>, vals array<double>, seen long", "update", GroupStateTimeout.EventTimeTimeout
    )


def probe_budget(events: DataFrame, budget: int = 30, idle: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The first `budget` distinct kinds of each user; state holds at most that many names, of users with events within `idle`."""
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("event_id")
        newest = max(state.getCurrentWatermarkMs(), int(rows["ts"].max().timestamp() * 1000))
        rows = rows.drop_duplicates("event_type")
        fresh = rows[~rows["event_type"].isin(seen)].head(max(0, budget - len(seen)))
        state.update((seen + fresh["event_type"].tolist(),))
        state.setTimeoutTimestamp(newest + millis)
        yield fresh.assign(user_id=key[0])[["user_id", "event_type", "event_id"]]

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(update, "user_id long, event_type string, event_id long", "seen array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def file_watch(files: DataFrame, path: str, checkpoint: str):
    """New or changed files scanned as they come; each batch's findings are written to a folder of its own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        scan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
