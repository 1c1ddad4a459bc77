"""Counts kept over streams of events: windows with watermarks, sessions, and transitions between an id's events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.ship import ship


def windowed_counts(events: DataFrame, ts: str, item: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, item, n) per window; events later than `late` are left out."""
    own = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window), item).agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), item, "n")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user, start, end, n): events of a user with no longer gap between them."""
    own = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count(F.lit(1)).alias("n"))
    return own.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def transitions(events: DataFrame, user: str, item: str, order: str) -> DataFrame:
    """(user, a, b): an item and the one that follows it, the last item of each user kept as state."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        own = pd.concat(list(frames)).sort_values(order)
        items = ([last] if last is not None else []) + own[item].tolist()
        state.update((str(items[-1]),))
        yield pd.DataFrame({"user": [key[0]] * (len(items) - 1), "a": items[:-1], "b": items[1:]})

    ship(events.sparkSession)
    keyed = events.select(F.col(user).cast("string").alias(user), F.col(item).cast("string").alias(item), order)
    return keyed.groupBy(user).applyInPandasWithState(step, "user string, a string, b string", "last string", "append", GroupStateTimeout.NoTimeout)
