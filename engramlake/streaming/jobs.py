"""Structured Streaming forms of the stateful operators.

Sources are any streaming DataFrame; every job states its watermark and key.
The state of a key is bounded by the watermark, and checkpoints belong in a
shared folder, so a lost executor replays a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A file source of events with a UTC ``ts``; new files are found incrementally."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, key: str, width: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sliding_bursts(events: DataFrame, key: str, width: str, slide: str, least: int, late: str) -> DataFrame:
    """(start, key, n) of windows with ``least`` events or more."""
    n = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), key).agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= least).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), key, "n")


def deduplicated(events: DataFrame, key: str, late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def settled_outcomes(plays: DataFrame, signals: DataFrame, key: str, within: str, late: str) -> DataFrame:
    """(key, ts, reward): plays joined with signals of the same key up to ``within``
    later; a play without one gets .5 when the watermark has passed it."""
    p = plays.withWatermark("ts", late).select(F.col(key), F.col("ts"), F.col("event_id").alias("play"))
    s = signals.withWatermark("ts", late).select(F.col(key).alias("k2"), F.col("ts").alias("at"), F.lit(1.0).alias("hit"))
    near = (F.col(key) == F.col("k2")) & (F.col("at") > F.col("ts")) & (F.col("at") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    joined = p.join(s, near, "leftOuter").select(key, "ts", "play", F.coalesce("hit", F.lit(0.5)).alias("reward"))
    return joined.dropDuplicatesWithinWatermark(["play"])  # a play with several signals settles once


def limiter(events: DataFrame, key: str, most: int, seconds: int, late: str) -> DataFrame:
    """Sliding-window rate limit: (key, ts, event_id, allowed).  Refused requests do
    not count, so the window is state: the times of accepted ones, ``most`` at most."""
    schema = f"{key} long, ts timestamp, event_id long, allowed boolean"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [float(x) for x in state.get[0].split(",") if x] if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed = []
        for t in rows["ts"].map(lambda x: x.timestamp()):
            held = [x for x in held if t - x < seconds]
            allowed.append(len(held) < most)
            if allowed[-1]:
                held.append(t)
        state.update((",".join(repr(x) for x in held),))
        state.setTimeoutTimestamp(max(int(rows["ts"].iloc[-1].timestamp()), state.getCurrentWatermarkMs() // 1000) * 1000 + seconds * 1000)
        yield pd.DataFrame({key: k[0], "ts": rows["ts"], "event_id": rows["event_id"], "allowed": allowed})

    return events.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, schema, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there and returns its rows (tests, backfills)."""
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
