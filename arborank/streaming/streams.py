"""Windowed and stateful operators that run alike on a stream and on a table; `ts` must be a timestamp."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late(events: DataFrame, delay: str | None) -> DataFrame:
    return events.withWatermark("ts", delay) if delay and events.isStreaming else events


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = "1 hour") -> DataFrame:
    """STR-1: user_id, n, start and stop (first and last event) of each session."""
    by = late(events, delay).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("stop")).drop("w")


def session_items(events: DataFrame, gap: str = "30 minutes", delay: str | None = "1 hour") -> DataFrame:
    """STR-1: user_id, start and items (newest first) of each session. events: user_id, item, ts, event_id."""
    by = late(events, delay).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    held = by.agg(F.min("ts").alias("start"), F.sort_array(F.collect_list(F.struct("ts", "event_id", "item")), asc=False).alias("x"))
    return held.select("user_id", "start", F.transform("x", lambda r: r["item"]).alias("items"))


def trending(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", delay: str | None = "1 hour") -> DataFrame:
    """STR-2: start, event_type, n, value of sliding windows."""
    by = late(events, delay).groupBy(F.window("ts", width, step).alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def hourly(events: DataFrame, delay: str | None = "1 hour") -> DataFrame:
    """STR-3: start, event_type, n of whole hours."""
    by = late(events, delay).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_of_each(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """STR-4: rows whose key has not been seen within the delay."""
    return late(events, delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def last_items(events: DataFrame, n: int = 10) -> DataFrame:
    """STR-5: user_id and its last n items after each batch, newest first, kept as state. events: user_id, item, ts."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in frames:
            held += list(zip(pdf["ts"].astype("int64"), pdf["item"], strict=True))
        held = sorted(held, reverse=True)[:n]
        state.update(([int(a) for a, _ in held], [int(b) for _, b in held]))
        yield pd.DataFrame({"user_id": [key[0]], "items": [[int(b) for _, b in held]]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, items array<long>", "ts array<long>, items array<long>", "update", "NoTimeout")
