"""Operator 11: fill-in-middle transformation by overlapping chunks.

A text is tokens: words with the white space before them, and white space at its
end.  So a token ends where a visible byte stands before a blank one, a predicate
of two adjacent bytes (blanks are ASCII, so it holds inside UTF-8).  The bytes of
a batch are cut into chunks of ``CHUNK`` that overlap by one byte; token ends and
first bytes of code points are counted in all chunks at once, prefix sums of the
counts route each of a text's two cut ranks to the chunk that owns it, and only
those chunks are scanned again for the place itself.

Cut ranks and form come from a hash of seed and key, so a row has one result at
any partitioning.  The step is narrow: no shuffle, any skew of keys; memory is
bounded by a batch and the longest text.

Defined results: a null text is an empty text; an empty text, and one that
holds a sentinel, is plain; a null key is hashed as an empty one; equal rows get
equal results; other columns are untouched, but those named ``n``, ``form``,
``prefix_chars``, ``middle_chars`` or ``output`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.llm.shared import arrow_map, table

CHUNK = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True


class Chunks:
    """Counts of a batch's chunks, and the places of cut ranks.

    ``data`` holds the bytes of the texts and ``at`` where they begin and end.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, size: int = CHUNK):
        self.data, self.at = data, at
        per_text = -(-np.diff(at) // size)
        self.first = np.concatenate([[0], np.cumsum(per_text)])  # of each text, among the chunks
        of = np.repeat(np.arange(len(at) - 1), per_text)
        self.start = at[:-1][of] + (np.arange(len(of)) - self.first[of]) * size
        self.stop = np.minimum(self.start + size, at[1:][of])
        self.end = at[1:][of]  # of the chunk's text
        # the texts before the first chunk and after the last are empty, so the chunks cover the bytes without gaps
        sums = lambda x: np.add.reduceat(x, self.start - at[0], dtype=np.int64) if len(of) else np.zeros(0, np.int64)
        own = data[at[0] : at[-1]]
        blank = _BLANK[own]
        ends = ~blank
        ends[:-1] &= blank[1:]
        last = at[1:][np.diff(at) > 0] - 1 - at[0]
        ends[last] = ~blank[last]  # a text's last byte has no neighbour
        self.words = np.concatenate([[0], np.cumsum(sums(ends))])
        self.chars = np.concatenate([[0], np.cumsum(sums((own & 0xC0) != 0x80))])
        self.tail = np.zeros(len(at) - 1, dtype=bool)
        self.tail[np.diff(at) > 0] = blank[last]
        self.n = self.words[self.first[1:]] - self.words[self.first[:-1]] + self.tail

    def place(self, text: int, rank: int) -> tuple[int, int]:
        """Byte and code-point offset behind the first ``rank`` tokens of a text."""
        lo, hi = self.first[text], self.first[text + 1]
        if rank == 0 or lo == hi:
            return 0, 0
        sought = self.words[lo] + rank
        if sought > self.words[hi]:  # the white space at the end
            return int(self.at[text + 1] - self.at[text]), int(self.chars[hi] - self.chars[lo])
        owner = lo + int(np.searchsorted(self.words[lo + 1 : hi + 1], sought))
        start, stop = self.start[owner], self.stop[owner]
        own = self.data[start : min(stop + 1, self.end[owner])]  # with the byte that the next chunk begins with
        blank = _BLANK[own]
        ends = ~blank[: stop - start]
        ends[: len(own) - 1] &= blank[1:]
        k = int(np.flatnonzero(ends)[sought - self.words[owner] - 1]) + 1
        return int(start - self.at[text]) + k, int(self.chars[owner] - self.chars[lo] + ((own[:k] & 0xC0) != 0x80).sum())


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where each value begins and the last ends, without a copy."""
    _, at, data = column.buffers()
    at = np.frombuffer(at, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), at


def draws(key: Column, seed: str) -> list[Column]:
    """The first four groups of eight digits of the hex hash of seed and key, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(df: DataFrame, text: str = "text", key: str = "doc_id", seed: str = "42", percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """``df`` with ``n`` (tokens), ``form`` (plain, psm or spm), ``prefix_chars``
    and ``middle_chars`` (null if plain) and ``output``.

    ``percent`` of the texts are transformed, ``spm_percent`` of those with the suffix first.
    """
    names = [c for c in df.columns if c not in ADDED]
    kept = [f for f in df.schema if f.name in names]
    long = T.LongType()
    out = T.StructType([*kept, *[T.StructField(c, t) for c, t in zip(ADDED, (long, T.StringType(), long, long, T.StringType()))]])
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _bytes(batch.column(0))
            h = [batch.column(1 + k).to_numpy() for k in range(4)]
            chunks = Chunks(data, at)
            a, b = h[0] % (chunks.n + 1), h[1] % (chunks.n + 1)
            low, high = np.minimum(a, b), np.maximum(a, b)
            chosen, suffix_first = h[2] % 100 < percent, h[3] % 100 < spm_percent
            forms, heads, middles, made = [], [], [], []
            for k in range(len(batch)):
                whole = data[at[k] : at[k + 1]].tobytes()
                if not whole or not chosen[k] or any(x in whole for x in marks):
                    forms.append("plain")
                    heads.append(None)
                    middles.append(None)
                    made.append(whole)
                    continue
                (i, chars), (j, until) = chunks.place(k, int(low[k])), chunks.place(k, int(high[k]))
                forms.append("spm" if suffix_first[k] else "psm")
                heads.append(chars)
                middles.append(until - chars)
                made.append(b"".join((s, whole[j:], p, whole[:i], m, whole[i:j]) if suffix_first[k] else (p, whole[:i], s, whole[j:], m, whole[i:j])))
            columns = [batch.column(5 + k) for k in range(len(names))]
            columns += [pa.array(chunks.n, pa.int64()), pa.array(forms), pa.array(heads, pa.int64()), pa.array(middles, pa.int64()), pa.array(made, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    plain = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t"), *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col(f"`{key}`"), seed))], *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    return arrow_map(plain, run, out)


def restore(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form."""
    part = lambda c, mark, k: F.split_part(c, F.lit(mark), F.lit(k))
    middle = part(output, MIDDLE, 2)
    psm = F.concat(part(part(output, SUFFIX, 1), PREFIX, 2), middle, part(part(output, SUFFIX, 2), MIDDLE, 1))
    spm = F.concat(part(part(output, PREFIX, 2), MIDDLE, 1), middle, part(part(output, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents
), drawn AS (
  SELECT *, len(tokens) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM docs
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(tokens[1:a], '') AS pre, array_to_string(tokens[a + 1:b], '') AS mid, array_to_string(tokens[b + 1:], '') AS suf FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
