"""Streaming forms: deduplication, rates and the adaptive delay of hosts.

The row-local functions and parsers of this package work on streams as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import urls
from ..operators.frontier import delay_after


def dedup(pages: DataFrame, at: str = "fetched_at", within: str = "1 hour") -> DataFrame:
    """pages whose normal form hasn't been seen within the time: the visited set as state."""
    return pages.withColumn("norm", urls.normalize("url")).withWatermark(at, within).dropDuplicatesWithinWatermark(["norm"])


def rates(events: DataFrame, at: str = "ts", key: str = "event_type", window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, key, n) of tumbling or sliding windows; works on tables too."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    return events.withWatermark(at, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, at: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, stop, key, n) of runs of events with gaps below the given one."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n")


def adaptive_delay(responses: DataFrame, initial_ms: int = 1000) -> DataFrame:
    """(host, n, delay_ms) of a stream responses(host, at, status): the host's delay after each batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, delay = state.get if state.exists else (0, initial_ms)
        rows = pd.concat(list(batches)).sort_values(["at", "status"], kind="stable")
        for s in rows["status"]:
            n, delay = n + 1, delay_after(delay, int(s), initial_ms)
        state.update((n, delay))
        yield pd.DataFrame({"host": [key[0]], "n": [n], "delay_ms": [delay]})

    return responses.groupBy("host").applyInPandasWithState(update, "host string, n long, delay_ms long", "n long, delay_ms long", "update", GroupStateTimeout.NoTimeout)
