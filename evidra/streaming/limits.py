"""Rate limits over ordered requests, in batches and streams, and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "key string, id long, at double, limited boolean"


def fixed_windows(events: DataFrame, key: str, at: str, ids: str, limit: int, seconds: float) -> DataFrame:
    """key, id, at, limited. A window opens at a key's first request and closes `seconds` later.

    Requests beyond the limit of their window are limited. Keys are dealt out and sorted, and the
    fold keeps three numbers per key, so a key's rows are streamed and never held together.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, opened, count = None, 0.0, 0
        for f in frames:
            out = []
            for k, t in zip(f["key"], f["at"]):
                if k != now or t >= opened + seconds:
                    now, opened, count = k, t, 0
                count += 1
                out.append(count > limit)
            yield f.assign(limited=out)

    return _ordered(events, key, at, ids).mapInPandas(fold, RESULT)


def sliding_log(events: DataFrame, key: str, at: str, ids: str, limit: int, seconds: float) -> DataFrame:
    """key, id, at, limited: at most `limit` accepted requests in any `seconds`; limited ones aren't logged."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, log = None, []
        for f in frames:
            out = []
            for k, t in zip(f["key"], f["at"]):
                if k != now:
                    now, log = k, []
                log = [x for x in log if x > t - seconds]
                out.append(len(log) >= limit)
                if len(log) < limit:
                    log.append(t)
            yield f.assign(limited=out)

    return _ordered(events, key, at, ids).mapInPandas(fold, RESULT)


def _ordered(events: DataFrame, key: str, at: str, ids: str) -> DataFrame:
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ids).cast("long").alias("id"), seconds.alias("at")).where("key is not null and at is not null")
    return rows.repartition("key").sortWithinPartitions("key", "at", "id")


def stream_fixed_windows(events: DataFrame, key: str, at: str, limit: int, seconds: int) -> DataFrame:
    """fixed_windows() over a stream: state per key is (window start, count), dropped when the window is over."""

    def fold(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, count = state.get if state.exists else (None, 0)
        for f in frames:
            f = f.sort_values("at")
            out = []
            for t in f["at"]:
                if opened is None or t >= opened + seconds:
                    opened, count = t, 0
                count += 1
                out.append(count > limit)
            yield pd.DataFrame({"key": [k[0]] * len(f), "at": f["at"], "limited": out})
        state.update((opened, count))
        state.setTimeoutDuration(seconds * 1000)

    rows = events.select(F.col(key).cast("string").alias("key"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(fold, "key string, at double, limited boolean", "opened double, count long", "append", "ProcessingTimeTimeout")


def first_responses(requests: DataFrame, key: str, at: str, delay: str = "10 minutes") -> DataFrame:
    """A stream without requests that repeat a key within the delay (idempotency keys)."""
    return requests.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def window_counts(events: DataFrame, at: str, kind: str, length: str = "1 day", delay: str | None = None) -> DataFrame:
    """start, kind, n per tumbling window; with a delay, late events of a stream are dropped beyond it."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp") if delay else F.col(at))
    rows = rows.withWatermark("_at", delay) if delay else rows
    counts = rows.groupBy(F.window("_at", length).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), kind, "n")
