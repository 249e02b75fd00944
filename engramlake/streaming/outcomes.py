"""Pending outcomes as a keyed state machine with event-time timers.

An outcome opens with an event of one kind and collects the signals of its key
that come within its time to live; when the watermark has passed the end of that
time a timer settles it.  Signals and outcomes may come in any order and in
batches of any size: the state of a key holds the outcomes that are open and the
signals that an outcome may still come for, so each pair meets once, whichever
is first.  A signal that no outcome has taken by then goes to the side output.
The state of a key is bounded by the rate of its events times the time to live
and the lateness allowed.  Rows behind the watermark are left out by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: ``status`` is settled (an outcome, with its signals and label) or unmatched (a signal that found no outcome).
SETTLED = "{key} long, event_id long, ts timestamp, status string, signals long, label double"


def pending_outcomes(events: DataFrame, key: str, opens: str, signal: str, seconds: int, late: str, fallback: float = 0.5, kind: str = "event_type", value: str = "value") -> DataFrame:
    """(key, event_id, ts, status, signals, label) of a stream (key, event_id, ts,
    kind, value).  A label is the sum of the values, between 0 and 1, or
    ``fallback`` without signals; a null value counts as 0."""
    life = seconds * 1_000_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # open: [ts, id, signals, sum]; waiting: [ts, id, value, taken]; times in microseconds
        held = json.loads(state.get[0]) if state.exists else {"open": [], "waiting": []}
        for rows in [] if state.hasTimedOut else batches:
            at = rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            new = list(zip(at.tolist(), rows["event_id"].tolist(), rows[kind].tolist(), rows[value].fillna(0.0).tolist()))
            fresh = [[t, i, 0, 0.0] for t, i, what, _ in new if what == opens]
            came = [[t, i, v, 0] for t, i, what, v in new if what == signal]
            _meet(held["open"], came, life)
            _meet(fresh, held["waiting"] + came, life)
            held["open"] += fresh
            held["waiting"] += came
        mark = state.getCurrentWatermarkMs() * 1000
        done = sorted(o for o in held["open"] if o[0] + life < mark)
        lost = sorted(s for s in held["waiting"] if s[0] < mark and not s[3])
        held = {"open": [o for o in held["open"] if o[0] + life >= mark], "waiting": [s for s in held["waiting"] if s[0] >= mark]}
        if ends := [o[0] + life for o in held["open"]] + [s[0] for s in held["waiting"]]:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(min(ends) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if done or lost:
            out = [(t, i, "settled", n, min(1.0, max(0.0, v)) if n else fallback) for t, i, n, v in done] + [(t, i, "unmatched", 0, v) for t, i, v, _ in lost]
            frame = pd.DataFrame(out, columns=["ts", "event_id", "status", "signals", "label"])
            frame["ts"] = pd.to_datetime(frame["ts"], unit="us")
            frame.insert(0, key, k[0])
            yield frame[[key, "event_id", "ts", "status", "signals", "label"]]

    used = events.where(F.col(kind).isin(opens, signal) & F.col(key).isNotNull()).withWatermark("ts", late)
    return used.select(key, "event_id", "ts", kind, value).groupBy(key).applyInPandasWithState(step, SETTLED.format(key=key), "held string", "append", GroupStateTimeout.EventTimeTimeout)


def _meet(outcomes: list[list], signals: list[list], life: int) -> None:
    """Gives outcomes the signals that come after them within their life; both sorted by time, each pair once."""
    outcomes.sort()
    order = sorted(signals)
    times = np.array([s[0] for s in order], dtype=np.int64)
    for o in outcomes:
        for s in order[np.searchsorted(times, o[0], "right") : np.searchsorted(times, o[0] + life, "right")]:
            o[2], o[3], s[3] = o[2] + 1, o[3] + s[2], s[3] + 1


def run_to_files(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs over what is there into parquet files; the sink's log makes each row come once, also after a restart."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
