"""What SQL cannot check: folds against loops, hooks, files."""

import datetime
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from engramlake.functions import language as L
from engramlake.operators import hooks, lifecycle
from engramlake.operators import store as S
from engramlake.plans.catalog import QUERIES
from engramlake.sources import files

SF = "/root/testdata/sf0.001"


def test_token_buckets_against_a_loop(spark):
    got = {r.user_id: (r.n, r.passed) for r in QUERIES["token_buckets"](spark, SF).collect()}
    rows = sorted((r.ts, r.user_id) for r in spark.read.parquet(f"{SF}/events.parquet").collect())
    state: dict = {}
    for ts, user in rows:
        tokens, at, n, passed = state.get(user, (10.0, ts, 0, 0))
        tokens = min(10.0, tokens + (ts - at).total_seconds() / 60)
        state[user] = (tokens - (tokens >= 1), ts, n + 1, passed + (tokens >= 1))
    assert got == {u: s[2:] for u, s in state.items()}
    fast = spark.createDataFrame([(1, float(t)) for t in range(30)], "k long, s double")
    assert S.token_bucket(fast, "k", "s", 0.1, 5).first().passed == 5 + 2


def test_keyed_hash_is_the_standard_one(spark):
    texts = ["", "plain", "é" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for key in ("k", "long " * 30):
        got = [r.h for r in df.select(S.hmac_sha256(F.col("t"), key).alias("h")).collect()]
        assert got == [hmac.new(key.encode(), t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_chain_notices_a_rehashed_tail(spark):
    df = spark.createDataFrame([(1, k, f"body {k}") for k in range(6)], "log long, k long, text string")
    made = lifecycle.chain(df, "k", F.col("text"))
    assert lifecycle.verify_chain(made, "k").first().broken == 0
    # a body changed and its own hash made anew: the next record's link tells
    forged = made.withColumn("body", F.when(F.col("k") == 3, "other").otherwise(F.col("body")))
    forged = forged.withColumn("content_hash", F.when(F.col("k") == 3, F.sha2(F.concat("previous", "body"), 256)).otherwise(F.col("content_hash")))
    assert lifecycle.verify_chain(forged, "k").first().broken == 1


def test_dates_and_gates(spark):
    day = datetime.date
    text = "on 2024-03-05, 8 May, 2023 and 2024-13-40; from 2023-05-08 to 2023-05-10"
    row = spark.range(1).select(L.dates(F.lit(text)).alias("d"), L.interval(F.lit(text)).alias("i"), L.session_date(F.lit("1:56 pm on 8 May, 2023")).cast("timestamp_ntz").alias("s")).first()
    assert row.d == [day(2023, 5, 8), day(2023, 5, 10), day(2024, 3, 5)] and tuple(row.i) == (day(2023, 5, 8), day(2023, 5, 10))
    assert row.s == datetime.datetime(2023, 5, 8, 13, 56)
    says = {"2 weeks ago": day(2024, 1, 17), "in 1 month": day(2024, 2, 29), "last year": day(2023, 1, 31), "Yesterday": day(2024, 1, 30), "some time": None}
    df = spark.createDataFrame([(t,) for t in says], "t string")
    assert {r.t: r.d for r in df.select("t", L.relative_day(F.col("t"), F.lit("2024-01-31").cast("date")).alias("d")).collect()} == says
    gate = {"OK.": False, " Thank you! ": False, "short": False, "a note of some length": True}
    df = spark.createDataFrame([(t,) for t in gate], "t string")
    assert {r.t: r.g for r in df.select("t", L.informative(F.col("t")).alias("g")).collect()} == gate
    marked = spark.range(1).select(L.watermark(F.lit("hello"), F.lit(5)).alias("w")).select(L.read_watermark(F.col("w")).alias("k"), F.translate("w", "​‌", "").alias("t")).first()
    assert tuple(marked) == (5, "hello")


def test_channels_filters_and_hooks(spark):
    class Fixed:
        def search(self, queries, top_k):
            return queries.select("query_id", F.lit(7).alias("fact_id"), F.lit(0.5).alias("score")).limit(top_k)

    class Broken:
        def search(self, queries, top_k):
            raise RuntimeError("no index")

    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    found = hooks.Channels()
    found.register("fixed", Fixed())
    found.register("broken", Broken())
    found.register_filter(lambda df: df.where("query_id > 1"))
    assert [tuple(r) for r in found.run(queries, 10).collect()] == [("fixed", 2, 7, 0.5)]
    assert found.run(queries, 10, only={"broken"}) is None
    with pytest.raises(TypeError):
        found.register("odd", object())
    log, steps = [], hooks.Hooks()
    steps.pre("store", lambda x: log.append(("pre", x)))
    steps.post("store", lambda x: 1 / 0)
    steps.listen(lambda op, x: log.append((op, x)))
    assert steps.run("store", lambda x: x + 1, 4) == 5 and log == [("pre", 4), ("store", 5)]

    def veto(x):
        raise PermissionError("no")

    steps.pre("erase", veto)
    with pytest.raises(PermissionError):
        steps.run("erase", lambda x: log.append("done"), 1)
    assert "done" not in log


def test_mail_calendar_and_folders(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.mbox").write_text("From a@x Mon\nFrom: A <a@x>\nSubject: one\n two\nDate: Mon, 1 Jan 2024\n\nhello\n>From here\n\nFrom b@x Tue\nFrom: b@x\nSubject: three\n\nbye\n")
    got = files.mailbox(spark, str(tmp_path / "m")).orderBy("place").collect()
    assert [(r.sender, r.subject, r.body) for r in got] == [("A <a@x>", "one two", "hello\nFrom here"), ("b@x", "three", "bye")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.ics").write_text("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Tea\\, la\r\n ter\r\nDTSTART:20240305T101500Z\r\nDTEND;VALUE=DATE:20240306\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    e = files.calendar(spark, str(tmp_path / "c")).select("uid", "summary", F.col("starts").cast("timestamp_ntz"), F.col("ends").cast("timestamp_ntz")).first()
    assert tuple(e) == ("1", "Tea, later", datetime.datetime(2024, 3, 5, 10, 15), datetime.datetime(2024, 3, 6))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nAnn: hi\n")
    (tmp_path / "t" / "b.txt").write_text("one\n\ntwo\n")
    (tmp_path / "t" / "c.txt").write_text("one\n\ntwo\n")
    rows = files.by_suffix(spark, str(tmp_path / "t"))
    assert sorted(r.text for r in rows.collect()) == ["hi", "one", "one", "two", "two"]
    assert sorted(r.text for r in files.new_files(rows, rows.where("speaker = 'Ann'")).collect()) == ["one", "two"]
    with pytest.raises(FileNotFoundError):
        files.by_suffix(spark, str(tmp_path / "nothing"))


def test_updates_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, note string, n int")
    ids = df.where("k = 2").select("k")
    assert sorted(tuple(r) for r in files.update(df, "k", {"note": ["x", "y"]}, ids, ("note",)).collect()) == [(1, "a", 1), (2, '["x", "y"]', 2)]
    for bad in ({}, {"n": 3}):
        with pytest.raises(ValueError):
            files.update(df, "k", bad, ids, ("note",))
    e = spark.createDataFrame([(1, "view")], "event_id long, event_type string")
    files.log_events(e, str(tmp_path / "log"), ("view",))
    files.log_events(e, str(tmp_path / "log"), ("view",))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    with pytest.raises(ValueError):
        files.log_events(e, str(tmp_path / "log"), ("click",))
