"""Gate and kinematics over an event stream. The batch operators on a stream, with watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hodograph.functions.scalar import probe, verdict

#: After a day without an event a user's state is dropped.
IDLE_MS = 24 * 3600 * 1000
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def gate_windows(events: DataFrame, length: str = "1 hour", late: str = "30 minutes", threshold: float = 0.5) -> DataFrame:
    """``(start, verdict, n, mean_score)`` per tumbling window: events gated by their value. Null times and values drop out.

    Rows later than the watermark are left out of closed windows; state is one row per open window and verdict.
    """
    score = probe(F.col("value") / 100.0, F.abs("value") / 1000.0)
    g = events.filter("ts IS NOT NULL AND value IS NOT NULL").withWatermark("ts", late).withColumn("score", score)
    g = g.withColumn("verdict", verdict(F.col("score"), F.lit(0), F.lit(1), threshold))
    return g.groupBy(F.window("ts", length).alias("w"), "verdict").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")).select(
        F.col("w.start").alias("start"), "verdict", "n", "mean_score"
    )


def _advance(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Velocity, change and count per user in order of arrival; the state is the last velocity and the count.

    A user who sends nothing for :data:`IDLE_MS` is forgotten."""
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    last, n = state.get if state.exists else (None, 0)
    out = []
    for e, v in zip(rows["event_id"], rows["value"].abs(), strict=True):
        out.append((key[0], int(e), float(v), 0.0 if last is None else float(v - last), n))
        last, n = float(v), n + 1
    state.update((last, n))
    seen = rows["ts"].max()
    now = state.getCurrentWatermarkMs()
    state.setTimeoutTimestamp(max(now + 1, now if pd.isna(seen) else int(seen.timestamp() * 1000)) + IDLE_MS)
    yield pd.DataFrame(out, columns=["user_id", "event_id", "v", "a", "n_before"])


def user_states(events: DataFrame, late: str = "7 days") -> DataFrame:
    """``(user_id, event_id, v, a, n_before)``: kinematic state of each user's events, kept across micro-batches.

    Within a batch events go in order of time; across batches in order of arrival. Null users and values drop out. State is one
    row per user who sent something within a day of event time; rows later than ``late`` are left out.
    """
    e = events.filter("user_id IS NOT NULL AND value IS NOT NULL").select("user_id", "event_id", "ts", "value").withWatermark("ts", late)
    return e.groupBy("user_id").applyInPandasWithState(
        _advance, "user_id long, event_id long, v double, a double, n_before long", "last double, n long", "append", GroupStateTimeout.EventTimeTimeout
    )
