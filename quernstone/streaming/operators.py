"""Structured Streaming: following files, resuming without repeats, keyed session state; windows by event time beyond that."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Lines of text files as they appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder)


def iterations(lines: DataFrame, after: int = -1) -> DataFrame:
    """iteration and pairs of training-log lines beyond an iteration."""
    from quernstone.functions.answers import log_pairs

    it = F.regexp_extract("value", r"iteration\s+([0-9]+)", 1)
    return lines.filter(it != "").select(it.cast("long").alias("iteration"), log_pairs(F.col("value")).alias("pairs")).filter(F.col("iteration") > after)


def once(rows: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key once, over restarts too (state is in the query's checkpoint, kept for `late`)."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling(rows: DataFrame, time: str, width: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Counts by window and keys (beyond the reference's own operators)."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def _slot(key: str, slots: int) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % slots


def routed(rows: DataFrame, key: str, time: str, slots: int = 8, idle_ms: int = 1_800_000) -> DataFrame:
    """key, n, slot of each key in each batch: a key sticks to the slot that it was given at first while it is known; what has been idle for long is forgotten, so
    that the state is bounded by the keys of that time (a cache whose least recently used entries go)."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [], "n": [], "slot": []}).astype({"key": "object", "n": "int64", "slot": "int32"})
            return
        (slot,) = state.get if state.exists else (_slot(k[0], slots),)
        n = sum(len(b) for b in batches)
        state.update((slot,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + idle_ms)
        yield pd.DataFrame({"key": [k[0]], "n": [n], "slot": [slot]})

    marked = rows.withWatermark(time, "10 minutes").select(F.col(key).cast("string").alias("key"), time)
    return marked.groupBy("key").applyInPandasWithState(step, "key string, n long, slot int", "slot int", "append", GroupStateTimeout.EventTimeTimeout)


def cached(rows: DataFrame, key: str, value: str, time: str, idle_ms: int = 86_400_000) -> DataFrame:
    """key, hits, misses, value of each key in each batch: the first request of a key is a miss whose value (of the earliest row) answers all later ones."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [], "hits": [], "misses": [], "value": []}).astype({"key": "object", "hits": "int64", "misses": "int64", "value": "object"})
            return
        known, n, first = state.exists, 0, None
        for b in batches:
            n += len(b)
            at = b[time].idxmin()
            first = min(first or (b[time][at], b[value][at]), (b[time][at], b[value][at]))
        answer = state.get[0] if known else str(first[1])
        state.update((answer,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + idle_ms)
        yield pd.DataFrame({"key": [k[0]], "hits": [n - (not known)], "misses": [int(not known)], "value": [answer]})

    marked = rows.withWatermark(time, "10 minutes").select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias(value), time)
    return marked.groupBy("key").applyInPandasWithState(step, "key string, hits long, misses long, value string", "value string", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited(rows: DataFrame, key: str, time: str, cost_ms: int, burst: int) -> DataFrame:
    """key, allowed, refused of each key in each batch, by a token bucket: a request costs `cost_ms` of credit, credit grows with time up to `burst` requests.

    Requests of a batch are taken in order of time; credit and time of the last one are the state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        credit, last = state.get if state.exists else (burst * cost_ms, None)
        times = sorted(int(t.value // 1_000_000) for b in batches for t in b[time])
        allowed = 0
        for t in times:
            credit = min(burst * cost_ms, credit + max(0, t - (t if last is None else last)))
            last = t if last is None else max(last, t)
            if credit >= cost_ms:
                credit, allowed = credit - cost_ms, allowed + 1
        state.update((credit, last))
        yield pd.DataFrame({"key": [k[0]], "allowed": [allowed], "refused": [len(times) - allowed]})

    marked = rows.select(F.col(key).cast("string").alias("key"), time)
    return marked.groupBy("key").applyInPandasWithState(step, "key string, allowed long, refused long", "credit long, last long", "append", GroupStateTimeout.NoTimeout)
