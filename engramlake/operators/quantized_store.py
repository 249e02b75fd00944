"""Vectors kept in 32, 8, 4 or 2 bits a component, and searched in that form.

The store is a written table of blocks, one width a block: ids, radii, packed
codes and, for 4 bits or fewer, a sign sketch of what quantising has lost with
its length.  A query becomes a table of what each value of each packed byte adds
to the dot product, so codes are looked up; blocks of queries read a block's codes
once and multiply.  The sketch's estimate of the lost part is added.  Stated queries, packed in blocks too, meet all
blocks, each pair keeps the best of each query, and the best overall are scored
anew by the full vectors of the facts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import quantize as Z
from engramlake.functions import vectors as V
from engramlake.functions.arrow import arrow_map
from engramlake.sources.scratch import written

BLOCK, QUERY_BLOCK, SKETCH = 2048, 64, 128
#: Up to this width the lost part has a sketch.
SKETCHED = 4
SCHEMA = "bits int, ids array<long>, radius binary, norm binary, codes binary, sketch binary, lost binary"


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def write_store(facts: DataFrame) -> DataFrame:
    """The store of (fact_id, v, bits); facts of width 0 or without a vector are left out.

    A narrow step: a batch's facts of one width are a block, or several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids, x, width = batch.column(0).to_numpy(), _rows(batch.column(1)), batch.column(2).to_numpy()
            turn = Z.rotation(x.shape[1])
            for bits in np.unique(width):
                at = np.flatnonzero(width == bits)
                for part in np.split(at, range(BLOCK, len(at), BLOCK)):
                    yield _block(int(bits), ids[part], x[part], turn)

    good = facts.where(F.col("bits").isin(2, 4, 8, 32) & F.col("v").isNotNull())
    return written(arrow_map(good.select(F.col("fact_id").cast("long").alias("fact_id"), F.col("v").cast("array<double>").alias("v"), F.col("bits").cast("int").alias("bits")), run, SCHEMA), "quantised")


def _block(bits: int, ids: np.ndarray, x: np.ndarray, turn: np.ndarray) -> pa.RecordBatch:
    radius = np.linalg.norm(x, axis=1)
    if bits == 32:
        codes, norm, sketch, lost = x.astype(np.float32).tobytes(), radius, b"", b""
    else:
        _, c = Z.encode(x, bits, turn)
        back = Z.decode(radius, c, bits, turn)
        codes, norm, sketch, lost = b"".join(Z.pack(c, bits)), np.linalg.norm(back, axis=1), b"", b""
        if bits <= SKETCHED:
            sketch = np.packbits(Z.sign_sketch(x - back, SKETCH), axis=1).tobytes()
            lost = np.linalg.norm(x - back, axis=1).astype(np.float32).tobytes()
    values = [bits, ids.tolist(), radius.astype(np.float32).tobytes(), norm.astype(np.float32).tobytes(), codes, sketch, lost]
    kinds = [pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["bits", "ids", "radius", "norm", "codes", "sketch", "lost"])


def similarities(q: np.ndarray, block: dict, turn: np.ndarray, sketched: bool = True) -> np.ndarray:
    """Approximate cosines of a query with a block's vectors; 0 where one has no length."""
    n, bits = len(block["ids"]), block["bits"]
    numbers = lambda c: np.frombuffer(block[c], dtype=np.float32).astype(float)
    size = np.linalg.norm(q)
    if bits == 32:
        dots = np.frombuffer(block["codes"], dtype=np.float32).reshape(n, -1).astype(float) @ q
    else:
        table = Z.byte_tables(q, bits, turn)
        packed = np.frombuffer(block["codes"], dtype=np.uint8).reshape(n, -1)
        dots = table[np.arange(packed.shape[1])[None, :], packed].sum(axis=1) * numbers("radius")
    norms = numbers("norm")
    if sketched and block["sketch"]:
        signs = np.unpackbits(np.frombuffer(block["sketch"], dtype=np.uint8).reshape(n, -1), axis=1).astype(bool)
        dots, norms = dots + Z.sketch_dot(q, signs, numbers("lost")), numbers("radius")  # the whole vector's length now
    return np.divide(dots, norms * size, out=np.zeros(n), where=norms * size > 1e-12)


def block_similarities(q: np.ndarray, block: dict, turn: np.ndarray) -> np.ndarray:
    """``similarities`` of the rows of ``q``: the codes' vectors are read once and multiplied with all queries."""
    n, bits, dims = len(block["ids"]), block["bits"], q.shape[1]
    numbers = lambda c: np.frombuffer(block[c], dtype=np.float32).astype(float)
    if bits == 32:
        x = np.frombuffer(block["codes"], dtype=np.float32).reshape(n, -1).astype(float)
    else:
        x = Z.decode(numbers("radius"), Z.unpack(_cut(block["codes"], n), bits, dims), bits, turn)
    dots, norms = q @ x.T, numbers("norm")
    if block["sketch"]:
        signs = np.unpackbits(np.frombuffer(block["sketch"], dtype=np.uint8).reshape(n, -1), axis=1).astype(float)
        dots, norms = dots + Z.sketch_dot(q, signs, numbers("lost")), numbers("radius")  # the whole vector's length now
    lengths = np.linalg.norm(q, axis=1)[:, None] * norms[None, :]
    return np.divide(dots, lengths, out=np.zeros(dots.shape), where=lengths > 1e-12)


def _cut(raw: bytes, n: int) -> list[bytes]:
    size = len(raw) // n
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def approximate(store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, fact_id, score): the k best of each (query_id, v) by approximate cosine."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), QUERY_BLOCK):
                part = batch.slice(a, QUERY_BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([_rows(part.column(1)).tobytes()], pa.binary())], names=["qids", "q"])

    asked = arrow_map(queries.where("v IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v")), pack, "qids array<long>, q binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                q = np.frombuffer(row["q"]).reshape(len(row["qids"]), -1)
                turn = turns.setdefault(q.shape[1], Z.rotation(q.shape[1]))
                ids = np.array(row["ids"])
                s = np.round(block_similarities(q, row, turn), 9)
                floor = np.partition(s, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(q), -np.inf)
                a, b = np.nonzero(s >= floor[:, None])
                order = np.lexsort((ids[b], -s[a, b], a))
                a, b = a[order], b[order]
                best = np.arange(len(a)) - np.searchsorted(a, a) < k
                a, b = a[best], b[best]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(row["qids"])[a], pa.int64()), pa.array(ids[b], pa.int64()), pa.array(s[a, b])], names=["query_id", "fact_id", "score"])

    pairs = store.crossJoin(asked)  # the stated queries, in blocks, against all blocks
    return _top(arrow_map(pairs, run, "query_id long, fact_id long, score double"), k)


def search(store: DataFrame, queries: DataFrame, facts: DataFrame, k: int, wider: int = 2) -> DataFrame:
    """(query_id, fact_id, score, rank): ``wider`` times as many by the store, scored by the cosine of full vectors."""
    near = approximate(store, queries, k * wider).select("query_id", "fact_id")
    rows = near.join(facts.select("fact_id", F.col("v").alias("x")), "fact_id").join(queries.select("query_id", F.col("v").alias("q")), "query_id")
    scored = rows.select("query_id", "fact_id", F.round(V.cosine(F.col("q").cast("array<double>"), F.col("x").cast("array<double>")), 9).alias("score"))
    return _top(scored, k)


def _top(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "fact_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
