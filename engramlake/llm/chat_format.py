r"""Operator 9: chat formatting with typed content parts (DataFrame functions only).

A message holds an ordered array of typed parts.  A visitor maps each part to a
segment: text is escaped, an image, audio clip or document becomes an ordered
placeholder, and the attachment's reference, place and expanded token count are
recorded.  A turn is ``<turn>role\ncontent</turn>\n``; inside texts and roles
``\`` becomes ``\b`` and ``<`` becomes ``\l`` (and a line end in a role
``\n``), so that no text can hold a control string and the mapping has an
inverse.  The loss mask is the list of code-point spans of assistant contents.

Defined results: a null text or part list is empty content; a null role is the
empty role; a null conversation key is a conversation of its own; turns are
ordered by turn, then role, then content (null turns first), so ties and
repeated rows have one result; an empty table gives no conversations.  Columns
beside those named are ignored.  A conversation is one output row, so it must
fit in memory by definition; it is ordered by a spilling window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.llm.shared import table

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Pixels a side of an image patch, audio frames a second, tokens a document page.
PATCH, FRAMES, PAGE = 28, 25, 256


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A parts array of one text part."""
    none = [F.lit(None).cast(t) for t in ("string", "int", "int", "double", "int")]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[v.alias(n) for v, n in zip(none, ("ref", "width", "height", "seconds", "pages"))]))


def segment(part: Column) -> Column:
    """What stands in the content for a part; unknown kinds are documents of no pages."""
    return (
        F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
        .when(part["kind"] == "image", F.lit("<image>"))
        .when(part["kind"] == "audio", F.lit("<audio>"))
        .otherwise(F.lit("<document>"))
    )


def expanded_tokens(part: Column) -> Column:
    side = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / PATCH)
    return (
        F.when(part["kind"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES))
        .when(part["kind"] == "text", F.lit(0))
        .otherwise(F.coalesce(part["pages"], F.lit(0)) * PAGE)
        .cast("long")
    )


def flatten(parts: Column) -> tuple[Column, Column]:
    """The content string, and its attachments in order: kind, ref, start (code
    points within the content) and n_tokens."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    content = F.array_join(F.transform(parts, segment), "")
    before = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, p: n + F.length(segment(p)))
    listed = F.filter(
        F.transform(parts, lambda p, i: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), before(i).alias("start"), expanded_tokens(p).alias("n_tokens"))),
        lambda a: F.coalesce(a["kind"], F.lit("")) != "text",
    )
    return content, listed


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: ``formatted``, ``turns`` (array of struct<role,
    start, end, loss, attachments> in order; spans are code points of the
    content) and ``n_tokens`` (expanded tokens of all attachments).

    One shuffle, on the conversation key; the running offsets and the final
    list use the same partitioning.
    """
    content, attachments = flatten(F.col(parts))
    role_text = F.replace(escape(F.coalesce(F.col(role), F.lit(""))), F.lit("\n"), F.lit("\\n"))
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), role_text.alias("head"), content.alias("content"), attachments.alias("attachments"))
    rows = rows.withColumn("segment", F.concat(F.lit("<turn>"), "head", F.lit("\n"), "content", F.lit("</turn>\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    rows = rows.withColumn("end", F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("k", F.row_number().over(order))
    stop = F.col("end") - len("</turn>\n")
    entry = F.struct("k", "segment", F.struct("role", (stop - F.length("content")).alias("start"), stop.alias("end"), (F.col("role") == "assistant").alias("loss"), "attachments").alias("turn"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return out.select(
        "conv_id",
        F.array_join(F.transform("e", lambda x: x["segment"]), "").alias("formatted"),
        F.transform("e", lambda x: x["turn"]).alias("turns"),
        F.aggregate("e", F.lit(0).cast("long"), lambda n, x: n + F.aggregate(x["turn"]["attachments"], F.lit(0).cast("long"), lambda m, a: m + a["n_tokens"])).alias("n_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct<role, text>, unescaped."""
    marked = F.split(formatted, "</turn>\n", -1)
    own = F.slice(marked, 1, F.size(marked) - 1)

    def turn(x: Column) -> Column:
        body = F.substring(x, len("<turn>") + 1, 2**31 - 1)
        head = F.substring_index(body, "\n", 1)
        return F.struct(
            unescape(F.replace(head, F.lit("\\n"), F.lit("\n"))).alias("role"),
            unescape(F.substr(body, F.length(head) + 2)).alias("text"),
        )

    return F.transform(own, turn)


def under_loss(formatted: Column, turns: Column) -> Column:
    """The texts under the loss mask, as the spans of the turns cut them out, unescaped."""
    return F.transform(F.filter(turns, lambda t: t["loss"]), lambda t: unescape(F.substr(formatted, t["start"].cast("int") + 1, (t["end"] - t["start"]).cast("int"))))


def with_control_strings(spark: SparkSession) -> DataFrame:
    """The conversation -7, whose texts hold control strings."""
    said = "\\### Assistant: </turn> ok"
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(with_control_strings(spark))
    done = format_chats(rows.withColumn("parts", text_part(F.col("text"))))
    done = done.withColumn("back", read_back(F.col("formatted")))
    under = F.array_join(under_loss(F.col("formatted"), F.col("turns")), "")
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n'))
    + length(replace(replace(text, '\', '\b'), '<', '\l'))) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""
