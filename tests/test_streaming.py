import datetime as dt

import pytest
from pyspark.sql import functions as F

from engramlake.streaming import jobs as S

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture()
def folder(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").collect()
    for k in range(4):
        part = rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def run(spark, tmp_path, stream, name):
    return S.drain(stream, name, str(tmp_path / name)).collect()


def closed(rows, batch, late, end):
    """Batch windows that ended before the last watermark."""
    top = max(r.start for r in batch)
    limit = top - late - end
    return sorted(map(tuple, (r for r in rows if r.start < limit))), sorted(map(tuple, (r for r in batch if r.start < limit)))


def test_windows_agree_with_batch(spark, tmp_path, folder):
    live = S.event_stream(spark, folder, SCHEMA)
    still = spark.read.schema(SCHEMA).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    batch = still.groupBy(F.window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "user_id", "n").collect()
    a, b = closed(run(spark, tmp_path, S.tumbling_counts(live, "user_id", "6 hours", "1 day"), "tumbling"), batch, dt.timedelta(days=1), dt.timedelta(hours=6))
    assert a == b and a
    batch = still.groupBy(F.window("ts", "12 hours", "3 hours"), "user_id").agg(F.count("*").alias("n")).where("n >= 3").select(F.col("window.start").alias("start"), "user_id", "n").collect()
    a, b = closed(run(spark, tmp_path, S.sliding_bursts(live, "user_id", "12 hours", "3 hours", 3, "1 day"), "bursts"), batch, dt.timedelta(days=1), dt.timedelta(hours=12))
    assert a == b and a


def test_sessions_and_duplicates(spark, tmp_path, folder):
    live = S.event_stream(spark, folder, SCHEMA)
    got = run(spark, tmp_path, S.sessions(live, "user_id", "8 hours", "1 day"), "sessions")
    assert got and all(r.stop > r.start and r.n >= 1 for r in got)
    spark.read.schema(SCHEMA).parquet(folder).limit(100).coalesce(1).write.mode("append").parquet(folder)
    got = run(spark, tmp_path, S.deduplicated(S.event_stream(spark, folder, SCHEMA, 10), "event_id", "60 days"), "unique")
    assert len(got) == len({r.event_id for r in got}) == 1000


def test_outcomes_settle(spark, tmp_path, folder):
    live = lambda: S.event_stream(spark, folder, SCHEMA)
    got = run(spark, tmp_path, S.settled_outcomes(live().where("event_type = 'view'"), live().where("event_type = 'purchase'"), "user_id", "4 hours", "1 day"), "settled")
    hits = {(r.play) for r in got if r.reward == 1.0}
    e = spark.read.schema(SCHEMA).parquet(folder)
    a = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("play"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"))
    want = {r.play for r in a.join(b, "user_id").where("at > ts AND at <= ts + INTERVAL 4 HOURS").collect()}
    assert hits == want and any(r.reward == 0.5 for r in got)
    assert len(got) == len({r.play for r in got}) <= a.count()  # the last ones are open still


def test_limiter_keeps_accepted_requests_only(spark, tmp_path, folder):
    got = run(spark, tmp_path, S.limiter(S.event_stream(spark, folder, SCHEMA), "user_id", 2, 6 * 3600, "1 day"), "limiter")
    rows = sorted((r.user_id, r.ts, r.event_id, r.allowed) for r in got)
    assert len(rows) == 1000
    held: dict = {}
    for user, ts, _, allowed in rows:
        recent = [t for t in held.get(user, []) if (ts - t).total_seconds() < 6 * 3600]
        assert allowed == (len(recent) < 2)
        held[user] = recent + [ts] * allowed
