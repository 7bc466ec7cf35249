"""Streams: request limits by gap, failure health, deduplication, sampling. Each takes a
streaming or a batch DataFrame with (user_id, ts, event_id, event_type)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.streaming.stateful import ordered


def sessions(events: DataFrame, gap: str = "60 seconds", limit: int = 5, late: str = "10 minutes") -> DataFrame:
    """A counter whose expiry each hit renews is a session with that gap; those above the limit."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", (F.col("n") > limit).alias("limited"))


REST = pd.Timedelta(hours=1)
HEALTH = "user_id long, event_id long, failures int, until timestamp"


def _health(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
    """R2: consecutive failures of a key; from the third on it rests an hour. Events of one
    batch are put in order of time; batches are taken in the order they arrive in."""
    failures = state.get[0] if state.exists else 0
    out = []
    for ts, event, kind in ordered(batches, ["event_type"], "ts"):
        failures = failures + 1 if kind == "error" else 0
        out.append((key[0], event, failures, ts + REST if failures >= 3 else pd.NaT))
    state.update((failures,))
    yield pd.DataFrame(out, columns=["user_id", "event_id", "failures", "until"])


def health(events: DataFrame) -> DataFrame:
    """R2 as a stateful operator."""
    return events.filter(F.col("event_type").isin("error", "purchase")).select("user_id", "event_id", "event_type", "ts").groupBy("user_id").applyInPandasWithState(_health, HEALTH, "failures int", "append", "NoTimeout")


def hourly(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events an hour. An hour is closed once the watermark, the latest time seen less
    `late`, has passed its end; what arrives for it afterwards is dropped, what arrives
    within `late` still counts."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def sampled(events: DataFrame, share: int = 10, slow_ms: int = 2000) -> DataFrame:
    """Errors and slow events always, of the others one in `share` by hash."""
    hashed = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    keep = (F.col("event_type") == "error") | (F.col("value") > slow_ms) | (hashed % share == 0)
    return events.filter(keep)


def remembered(events: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Events whose key an earlier run has not seen; works on a stream against a table."""
    return events.join(known.select(key).distinct().withColumn("_k", F.lit(True)), key, "left").filter("_k is null").drop("_k")
