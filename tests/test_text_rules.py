import duckdb
import pytest
from pyspark.sql import functions as F

from engramlake.functions import language as L
from engramlake.plans.catalog import ORACLES, QUERIES

TEXTS = ["été demain", "déago", "agoé", "naïvewas", "LİKE", "Élove it", "love", "wént", "went", "ſaid", "weeK", "met́", "日like本", "a_like", "like it", None, ""]


def test_cues_end_at_letters_beyond_ascii_as_in_sql(spark, tmp_path):
    rows = [(k, 0, "user", t) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = QUERIES["sentence_kinds"](spark, str(tmp_path)).collect()
    assert sorted((r.kind, r.n) for r in got) == sorted(con.execute(ORACLES["sentence_kinds"]).fetchall())


@pytest.mark.parametrize("key", [0, 1, 65_535, 65_536, 89_999, 2**63 - 1, -1, -(2**63), None])
def test_watermarks_hold_any_key_in_sixteen_marks(spark, key):
    df = spark.createDataFrame([("note", key), ("", key), (None, key)], "text string, key long")
    got = df.select(L.watermark(F.col("text"), F.col("key")).alias("w")).select("w", L.read_watermark(F.col("w")).alias("key"), F.length("w").alias("n")).collect()
    assert [(r.key, r.n) for r in got] == [(key, 20), (key, 16), (None, None)]
    assert "".join(c for c in got[0].w if c.isascii()) == "note"
