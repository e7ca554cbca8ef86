"""From a start to the next end of its key, over two streams.

The batch operator is ``correlation.event_latency``. Both streams have a watermark, and an
end counts only for a bounded time after its start, so Spark can drop what no longer meets
anything, and can tell that a start stayed alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def live_pairs(starts: DataFrame, ends: DataFrame, key: list[str], at: str, lookahead: str, lateness: str = "1 hour") -> DataFrame:
    """(key, started_at, ended_at, start_count, latency_seconds), one row per key and start time.

    ``ended_at`` is the earliest end from the start on, at most ``lookahead`` later; it is
    null where none came. A row is told when no earlier end can come any more. Events more
    than ``lateness`` behind the latest of their stream may be left out. Use the
    ``append`` output mode.
    """
    begun = starts.select(*(F.col(k).alias(f"_s_{k}") for k in key), F.col(at).alias("started_at")).withWatermark("started_at", lateness)
    ended = ends.select(*(F.col(k).alias(f"_e_{k}") for k in key), F.col(at).alias("_ended_at")).withWatermark("_ended_at", lateness)
    same = [F.col(f"_s_{k}") == F.col(f"_e_{k}") for k in key]
    within = (F.col("_ended_at") >= F.col("started_at")) & (F.col("_ended_at") <= F.col("started_at") + F.expr(f"INTERVAL {lookahead}"))
    # Starts of one time are merged first, so that each end is met once by them.
    merged = begun.groupBy("started_at", *(f"_s_{k}" for k in key)).agg(F.count("*").alias("start_count"))
    met = merged.join(ended, [*same, within], "left_outer")
    first = met.groupBy("started_at", *(f"_s_{k}" for k in key), "start_count").agg(F.min("_ended_at").alias("ended_at"))
    return first.select(*(F.col(f"_s_{k}").alias(k) for k in key), "started_at", "ended_at", "start_count",
                        F.timestamp_diff("SECOND", "started_at", "ended_at").alias("latency_seconds"))
