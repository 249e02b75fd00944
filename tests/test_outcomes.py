import datetime as dt

import pytest
from pyspark.sql import functions as F

from engramlake.plans.catalog import QUERIES
from engramlake.streaming import jobs as J
from engramlake.streaming import outcomes as O

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
SF = "/root/testdata/sf0.001"


def add(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def job(spark, folder, files):
    live = J.event_stream(spark, folder, SCHEMA, files).withColumn("value", F.col("value") / 100)
    return O.pending_outcomes(live, "user_id", "view", "click", 2 * 3600, "1 day")


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").collect()


@pytest.mark.parametrize(("parts", "files", "restart"), [(1, 1, False), (9, 1, False), (9, 4, True)])
def test_rows_of_the_batch_query_at_any_batch_size_and_after_a_restart(spark, tmp_path, parts, files, restart):
    rows = events(spark)
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    # an event that comes a month later moves the watermark past all the others
    last = [r.asDict() for r in rows[-1:]]
    last[0] |= {"event_id": 10**6, "ts": rows[-1].ts + dt.timedelta(days=30), "event_type": "view", "user_id": 10**6}
    pieces = [rows[k * len(rows) // parts : (k + 1) * len(rows) // parts] for k in range(parts)]
    for k, piece in enumerate(pieces):
        add(spark, piece, folder)
        if restart and k in (2, 5):
            O.run_to_files(job(spark, folder, files), out, check)
    add(spark, [tuple(last[0][c.split()[0]] for c in SCHEMA.split(", "))], folder)
    O.run_to_files(job(spark, folder, files), out, check)
    done = spark.read.parquet(out).where("user_id < 1000000").collect()
    settled = sorted((r.event_id, r.signals, round(r.label, 6)) for r in done if r.status == "settled")
    want = sorted((r.event_id, r.signals, r.label) for r in QUERIES["pending_outcomes"](spark, SF).collect())
    assert settled == want and any(n for _, n, _ in settled)
    lost = sorted(r.event_id for r in done if r.status == "unmatched")
    views = [(r.user_id, r.ts) for r in rows if r.event_type == "view"]
    hours = dt.timedelta(hours=2)
    assert lost == sorted(r.event_id for r in rows if r.event_type == "click" and not any(u == r.user_id and t < r.ts <= t + hours for u, t in views))


def test_order_bounds_and_state(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    at = lambda minutes: t + dt.timedelta(minutes=minutes)
    folder = str(tmp_path / "in")
    # the signal first, then its outcome; signals at the very start and end; a null value; other kinds and keys
    add(spark, [(1, at(10), 7, "click", 40.0, None), (2, at(5), 8, "click", 40.0, None)], folder)
    add(spark, [(3, at(0), 7, "view", None, None), (4, at(10), 7, "view", None, None), (9, at(3), 7, "other", 1.0, None), (10, at(3), None, "view", 1.0, None)], folder)
    add(spark, [(5, at(120), 7, "click", 90.0, None), (6, at(130), 7, "click", None, None), (7, at(130) + dt.timedelta(microseconds=1), 7, "click", 5.0, None)], folder)
    add(spark, [(8, at(60 * 24 * 9), 9, "view", 0.0, None)], folder)
    out = str(tmp_path / "out")
    O.run_to_files(job(spark, folder, 1), out, str(tmp_path / "check"))
    got = {r.event_id: (r.status, r.signals, r.label, r.ts) for r in spark.read.parquet(out).collect()}
    assert got[3][:3] == ("settled", 2, 1.0) and got[3][3] == t
    assert got[4][:3] == ("settled", 2, 0.9)
    assert got[2][:2] == ("unmatched", 0) and got[7][0] == "unmatched"
    assert set(got) == {2, 3, 4, 7}
