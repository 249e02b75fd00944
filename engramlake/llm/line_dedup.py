"""Operator 1: line dedup by content-defined chunks (DataFrame functions only).

A text is its lines.  A polynomial over the hashes of a line and the lines
before it (a window of ``WINDOW``) rolls along; where it is divisible by
``DIVISOR`` a chunk ends, so boundaries depend on nearby content alone and come
back after an insertion.  A chunk of two or more lines that is not blank and
whose hash occurs before (smallest doc_id, then place) is compared byte by byte
with that first occurrence and, if equal, removed.

Plan.  Hashes of chunks (not texts) are written once and grouped with a map-side
minimum; the few chunks that hold a two-thousandth of all rows or more are joined back
by broadcast, the others dealt.  Texts are dealt once, by doc_id, and only
repeated chunks are dealt again, by hash, for the comparison; a chunk met more
than ``SALT`` times goes to as many tasks as hold ``SALT`` each.

Defined results: a null text stays null and has no lines; an empty text is one
empty line; rows without doc_id stay as they are and count as no occurrence;
rows of one doc_id are documents of their own, in order of a hash of their
texts, but equal rows get equal results; other columns are untouched, but those named
``kept_text``, ``n_lines``, ``n_chunks`` or ``lines_removed`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm.shared import join_counted, materialize, table

WINDOW, DIVISOR, BASE, MODULUS = 2, 3, 31, 1 << 31
#: Occurrences of a chunk that are compared in one task.
SALT = 1000
ADDED = ("kept_text", "n_lines", "n_chunks", "lines_removed")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that is computed once a row, also where lambdas use it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _chunked(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``_lines`` and ``_chunks``: array of struct<s, n>, first line (from 1) and lines."""
    df = _once(df, "_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    df = _once(df, "_h", F.transform("_lines", lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long")))
    rolled: Column = F.col("_h")
    for k in range(1, WINDOW):
        before = F.concat(F.transform(F.slice("_h", 1, k), lambda x: x * 0), F.slice("_h", 1, F.greatest(F.size("_h") - k, F.lit(0))))
        before = F.when(F.size("_h") > k, before).otherwise(F.transform("_h", lambda x: x * 0))
        weight = BASE**k
        rolled = F.zip_with(rolled, before, lambda r, b: (r + b * weight) % MODULUS)
    df = _once(df, "_ends", F.filter(F.transform(rolled, lambda r, i: F.when((r % DIVISOR == 0) | (i == F.size("_h") - 1), i + 1)), lambda e: e.isNotNull()))
    firsts = F.concat(F.array(F.lit(1)), F.transform(F.slice("_ends", 1, F.size("_ends") - 1), lambda e: e + 1))
    return _once(df, "_chunks", F.zip_with(firsts, "_ends", lambda s, e: F.struct(s.alias("s"), (e - s + 1).alias("n")))).drop("_h", "_ends")


def _content(c: Column) -> Column:
    return F.array_join(F.slice("_lines", c["s"], c["n"]), "\n")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines``, ``n_chunks`` and ``lines_removed``."""
    names = [c for c in docs.columns if c not in ADDED]
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    own = held.select(F.col(f"c{names.index(key)}").alias("_d"), F.col(f"c{names.index(text)}").alias("_t")).where("_d is not null and _t is not null")
    own = own.withColumn("_r", F.xxhash64("_t"))
    here = F.struct("_d", "_r", "pos")
    parts = _chunked(own, "_t").select("_d", "_r", "_lines", F.posexplode("_chunks").alias("pos", "c")).where("c.n > 1").select("_d", "_r", "pos", _content(F.col("c")).alias("content"))
    parts = parts.where(F.trim(F.translate("content", "\n\t\r", "")) != "")
    light = materialize(parts.select("_d", "_r", "pos", F.xxhash64("content").alias("h"), F.length("content").alias("w")), "chunks")
    first = light.groupBy("h", "w").agg(F.min(here).alias("first"), F.max(here).alias("last"), F.count("*").alias("n")).where("first <> last").drop("last")
    marked = join_counted(light, first, ["h", "w"], light.count())
    marked = marked.groupBy("_d", "_r").agg(F.collect_set(F.struct("pos", "h", "w", "first", "n")).alias("marks"))
    # only repeated chunks' contents go on
    again = _chunked(own.dropDuplicates(["_d", "_r"]).join(marked, ["_d", "_r"]), "_t")
    again = again.select("_d", "_r", "_lines", "_chunks", F.explode("marks").alias("m")).select(
        "_d", "_r", "m.*", _content(F.element_at("_chunks", F.col("m.pos") + 1)).alias("content")
    )
    salts = F.ceil(F.col("n") / SALT).cast("int")
    leads = again.where(here == F.col("first")).select("h", "w", F.col("content").alias("lead"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    rest = again.where(here != F.col("first")).withColumn("salt", F.pmod(F.xxhash64("_d", "_r", "pos"), salts).cast("int"))
    equal = rest.join(leads, ["h", "w", "salt"]).where(F.col("content").cast("binary") == F.col("lead").cast("binary"))
    gone = equal.groupBy("_d", "_r").agg(F.collect_set("pos").alias("_gone"))
    body = F.col(f"c{names.index(text)}")
    out = _chunked(held.withColumn("_d", F.col(f"c{names.index(key)}")).withColumn("_r", F.xxhash64(body)).join(gone, ["_d", "_r"], "left"), f"c{names.index(text)}")
    out = _once(out, "_keep", F.filter("_chunks", lambda c, i: ~F.coalesce(F.array_contains("_gone", i), F.lit(False))))
    out = _once(out, "_left", F.aggregate("_keep", F.lit(0), lambda n, c: n + c["n"]))
    none = body.isNull()
    return out.select(
        *[f"c{k}" for k in range(len(names))],
        F.when(none, F.lit(None)).when(F.col("_gone").isNull(), body).otherwise(F.array_join(F.flatten(F.transform("_keep", lambda c: F.slice("_lines", c["s"], c["n"]))), "\n")).alias("a0"),
        F.when(none, 0).otherwise(F.size("_lines")).cast("long").alias("a1"),
        F.when(none, 0).otherwise(F.size("_chunks")).cast("long").alias("a2"),
        F.when(none, 0).otherwise(F.size("_lines") - F.col("_left")).cast("long").alias("a3"),
    ).toDF(*names, *ADDED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_chunks", "lines_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("text_sha256"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), hashed AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM lines
), rolled AS (
  SELECT *, (h + {BASE} * coalesce(lag(h) OVER w, 0)) % {MODULUS} AS r FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(CASE WHEN r % {DIVISOR} = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM rolled
), chunks AS (
  SELECT doc_id, pos, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS content FROM numbered GROUP BY doc_id, pos
), judged AS (
  SELECT *, n > 1 AND trim(translate(content, chr(10) || chr(9) || chr(13), '')) <> ''
    AND row_number() OVER (PARTITION BY n > 1, content ORDER BY doc_id, pos) > 1 AS gone FROM chunks
), kept AS (
  SELECT doc_id, sum(n) AS n_lines, count(*) AS n_chunks, coalesce(sum(n) FILTER (gone), 0) AS lines_removed,
    coalesce(string_agg(content, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS content FROM judged GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_chunks, 0) AS BIGINT) AS n_chunks,
  CAST(coalesce(lines_removed, 0) AS BIGINT) AS lines_removed, sha256(coalesce(k.content, '')) AS text_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
