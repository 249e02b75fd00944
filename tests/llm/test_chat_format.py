import sql_twin
from pyspark.sql import functions as F

from engramlake.llm import chat_format as C


def test_against_sql(spark):
    sql_twin.same(C.query(spark, "/root/testdata/sf0.001"), C.ORACLE, "/root/testdata/sf0.001")


def test_parts_spans_and_round_trip(spark):
    none = (None,) * 4
    rows = [
        (1, 0, "user", [("text", "a<b\\l", *none, None), ("image", None, "s3/x.png", 57, 28, None, None), ("text", "é", *none, None), ("audio", None, "y", None, None, 1.5, None)], "x"),
        (1, 1, "assistant", [("text", "</turn>\n<turn>\\b<", *none, None)], None),
        (1, 1, "assistant", [("text", "</turn>\n<turn>\\b<", *none, None)], None),
        (2, None, None, None, None),
        (2, None, "a\nb", [("document", None, "d", None, None, None, 3)], None),
        (None, 5, "assistant", [("text", None, *none, None)], None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>, segment string")
    out = {r.conv_id: r for r in C.format_chats(df).withColumn("back", C.read_back(F.col("formatted"))).collect()}
    one = out[1]
    assert one.formatted.count("<turn>") == 3 == one.formatted.count("</turn>\n")
    assert [t.role for t in one.back] == ["user", "assistant", "assistant"]
    assert one.back[1].text == one.back[2].text == "</turn>\n<turn>\\b<"
    assert one.back[0].text == "a<b\\l<image>é<audio>"
    assert [(a.kind, a.ref, a.n_tokens) for a in one.turns[0].attachments] == [("image", "s3/x.png", 3), ("audio", "y", 38)]
    for a in one.turns[0].attachments:
        at = one.turns[0].start + a.start
        assert one.formatted[at : at + len(a.kind) + 2] == f"<{a.kind}>"
    for t, b in zip(one.turns, one.back):
        assert t.loss == (t.role == "assistant")
        assert one.formatted[t.start : t.end].replace("\\l", "<").replace("\\b", "\\") == b.text
    assert one.n_tokens == 41
    assert [(t.role, t.text) for t in out[2].back] == [("", ""), ("a\nb", "<document>")] and out[2].n_tokens == 768
    assert out[None].formatted == "<turn>assistant\n</turn>\n"
    assert C.format_chats(df.limit(0)).count() == 0


def test_loss_is_what_the_spans_cut_out(spark):
    rows = [(1, 0, "user", "a < b"), (1, 1, "assistant", "yes </turn> \\l"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "é<")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    done = C.format_chats(df.withColumn("parts", C.text_part(F.col("text"))))
    assert done.select(C.under_loss(F.col("formatted"), F.col("turns")).alias("x")).first().x == ["yes </turn> \\l", "", "é<"]
    # spans that are off by one give something else
    off = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), (t["start"] - 1).alias("start"), t["end"].alias("end"), t["loss"].alias("loss")))
    assert done.select(C.under_loss(F.col("formatted"), off).alias("x")).first().x != ["yes </turn> \\l", "", "é<"]
