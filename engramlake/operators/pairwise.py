"""Every stated query against every vector, as products of matrices.

Queries and vectors are dealt into parts of bounded size by a hash of their
keys; a part of queries and a part of vectors meet in one task (a cogroup by the
pair of parts).  So a vector is sent once for each part of queries and a query
once for each part of vectors, memory of a task has a bound, and a task hands on
one row a query: its best k and sums over all.  Work is as the number of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.sources.scratch import written

#: Rows of a part at most, pairs of a task where there are more tasks than ``TASKS``, rows of a product.
PART, PAIRS, TASKS = 65_536, 1 << 26, 48
ROWS, COLUMNS, FIRST = 512, 4096, 512
#: Partitions that parts of communities are dealt into, at most.
MOST_DEALT = 4096
#: Scores are ranked by nine digits: those of half a digit and a trifle less may tie.
HALF = 0.5001e-9
SCHEMA = "query_id long, ids array<long>, scores array<double>, low double, high double, total double"


def _by_size(vectors: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length; those that are or hold nulls are left out."""
    column = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(int)
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    flat = column.flatten()
    hollow = np.unique(np.searchsorted(starts, np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)), side="right") - 1)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes[hollow] = -1
    out = {}
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        out[int(d)] = rows, values[starts[rows][:, None] + np.arange(d)]
    return out


class _Best:
    """The k best of each of some queries, by score to nine digits, then the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.row, self.ids, self.scores = k, np.empty(0, int), np.empty(0, np.int64), np.empty(0)
        self.floor = np.full(n, -np.inf)

    def add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        row, ids, scores = np.concatenate([self.row, row]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -np.round(scores, 9), row))
        row, ids, scores = row[order], ids[order], scores[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.row, self.ids, self.scores = row[keep], ids[keep], scores[keep]
        last = place == self.k - 1
        self.floor[row[last]] = scores[last]

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """A product's scores (queries by ``ids``)."""
        least = np.round(self.floor, 9) - HALF
        if scores.shape[1] > self.k:
            open_ = np.flatnonzero(np.isneginf(least))
            if len(open_):
                least[open_] = np.round(np.partition(scores[open_], -self.k, axis=1)[:, -self.k], 9) - HALF
        row, col = np.nonzero(scores >= least[:, None])
        if len(row):
            self.add(row, ids[col], scores[row, col])


def _meet(qids: np.ndarray, queries: dict, ids: np.ndarray, vectors: dict, k: int, beta: float | None, known: np.ndarray | None) -> list:
    """For each query with a vector: its id, best ids, their scores, least and largest score, sum of exp(score - largest).
    With ``known``, high and total of each query over all vectors, the best are by exp(score - high) / total."""
    out = []
    for d, (at, q) in queries.items():
        rows, x = vectors.get(d, (np.empty(0, int), np.empty((0, d))))
        if beta is None:  # cosines; nearly no length counts as none
            size = np.linalg.norm(x, axis=1)
            rows, x = rows[size >= 1e-6], x[size >= 1e-6] / size[size >= 1e-6, None]
            size = np.linalg.norm(q, axis=1)
            q = np.where(size[:, None] >= 1e-6, q / np.maximum(size, 1e-6)[:, None], 0.0)
        else:
            q = q * beta
        # vectors that a query cannot be compared with have cosine 0, and no dot product
        others = np.sort(np.delete(ids, rows))[: k] if beta is None and len(rows) < len(ids) else np.empty(0, np.int64)
        own = ids[rows]
        for a in range(0, len(at), ROWS):
            part = q[a : a + ROWS]
            n = len(part)
            best = _Best(n, k)
            low, high, total = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n)
            if len(others):
                best.offer(np.zeros((n, len(others))), others)
                low, high = np.minimum(low, 0.0), np.maximum(high, 0.0)
            b = 0
            while b < len(own):
                e = b + (COLUMNS if b else FIRST)
                scores = part @ x[b:e].T
                if known is not None:
                    high, sum_ = known[at[a : a + ROWS]].T
                    best.offer(np.exp(scores - high[:, None]) / sum_[:, None], own[b:e])
                    b = e
                    continue
                if k:
                    best.offer(scores, own[b:e])
                low, top = np.minimum(low, scores.min(axis=1)), np.maximum(high, scores.max(axis=1))
                if beta is not None:
                    with np.errstate(invalid="ignore"):
                        total = np.where(total > 0, total * np.exp(high - top), 0.0) + np.exp(scores - top[:, None]).sum(axis=1)
                high, b = top, e
            ends = np.searchsorted(best.row, np.arange(n + 1))
            for i in range(n):
                if len(own) or len(others):
                    s = slice(ends[i], ends[i + 1])
                    out.append((qids[at[a + i]], best.ids[s], best.scores[s], low[i], high[i], total[i]))
    return out


def products(queries: DataFrame, vectors: DataFrame, k: int, beta: float | None = None, known: DataFrame | None = None) -> DataFrame:
    """(query_id, ids, scores, low, high, total), a row for each query and part of vectors:
    the k best of the part, the extremes of all its scores and the sum of exp(score - high).

    Scores of (query_id, v) and (fact_id, v) are cosines, 0 where a vector is null, of
    another length or nearly zero; or with ``beta`` dot products times it, of vectors
    of the query's length.  ``known`` (query_id, high, total) of an earlier pass turns
    these into shares of the sum of exponents.  Ids are distinct.
    """
    n, m = vectors.count(), queries.count()
    chunks = -(-n // PART) or 1
    sides = -(-m // PART) or 1
    wanted = min(TASKS, -(-n * m // PAIRS))
    chunks = max(chunks, -(-wanted // sides))
    cells = chunks * sides
    cell = lambda side, chunk: (side * chunks + chunk).cast("int").alias("cell")
    part = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of))
    more = [] if known is None else ["high", "total"]
    queries = queries if known is None else queries.join(known.select("query_id", *more), "query_id")
    asked = queries.where("query_id IS NOT NULL AND v IS NOT NULL").select(part("query_id", sides).alias("s"), F.col("query_id").cast("long").alias("id"), F.col("v").alias("q"), *more)
    asked = asked.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select(cell(F.col("s"), F.col("c")), "id", "q", *more)
    there = vectors.where("fact_id IS NOT NULL").select(part("fact_id", chunks).alias("c"), F.col("fact_id").cast("long").alias("id"), F.col("v").alias("x"))
    there = there.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))).select(cell(F.col("s"), F.col("c")), "id", "x")
    deal = lambda df: df.repartition(4 * cells, "cell").groupBy("cell")  # noqa: E731  # a stated number is not merged into fewer

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = lambda t: t["id"].to_numpy()
        sizes = np.stack([left[c].to_numpy() for c in more], axis=1) if more else None
        rows = _meet(ids(left), _by_size(left["q"]), ids(right), _by_size(right["x"]), k, beta, sizes) if len(left) and len(right) else []
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), *[pa.float64()] * 3)
        columns = list(zip(*rows)) or [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "ids", "scores", "low", "high", "total"])

    return deal(asked).cogroup(deal(there)).applyInArrow(meet, SCHEMA)


def candidates(found: DataFrame) -> DataFrame:
    """(query_id, fact_id, score) of the rows of ``products``."""
    return found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("p")).select("query_id", F.col("p.ids").alias("fact_id"), F.col("p.scores").alias("score"))


def sums(found: DataFrame) -> DataFrame:
    """(query_id, low, high, total): extremes of all scores and the sum of exp(score - high)."""
    parts = found.select("query_id", "low", "high", "total").groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list(F.struct("high", "total")).alias("p"))
    return parts.select("query_id", "low", "high", F.expr("aggregate(p, 0.0D, (s, x) -> s + x.total * exp(x.high - high))").alias("total"))


def nearest_within(queries: DataFrame, vectors: DataFrame, k: int, least: float | None = None, earlier: bool = False) -> DataFrame:
    """(query_id, fact_id, score, rank): the k best cosines of each (query_id, community, v) among the
    (fact_id, community, v) of its community but itself, of those before it if ``earlier``, and of ``least`` or more.

    A community is dealt into parts as ``products`` deals all rows.  Cosines are 0 as there; ranks are by nine digits, then by id.
    """
    there = vectors.groupBy("community").agg(F.count("*").alias("n"))
    asked = queries.groupBy("community").agg(F.count("*").alias("m"))
    parts = lambda n: F.greatest(F.ceil(F.col(n) / F.lit(PART)), F.lit(1)).cast("int")
    sizes = there.join(asked, "community").withColumns({"sides": parts("m"), "chunks": parts("n")})
    # as many parts of vectors as keep a pair of parts within PAIRS
    more = F.ceil(F.col("n") * F.col("m") / F.lit(PAIRS) / F.col("sides")).cast("int")
    sizes = written(sizes.withColumn("chunks", F.greatest("chunks", more)).select("community", "sides", "chunks"), "parts")
    cells = sizes.agg(F.coalesce(F.sum(F.col("sides") * F.col("chunks")), F.lit(1))).first()[0]
    part = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = queries.where("query_id IS NOT NULL").join(sizes, "community").select(F.col("community").alias("g"), part("query_id", "sides").alias("s"), F.col("query_id").cast("long").alias("id"), F.col("v").alias("q"), every("chunks").alias("c"))
    right = vectors.where("fact_id IS NOT NULL").join(sizes, "community").select(F.col("community").alias("g"), part("fact_id", "chunks").alias("c"), F.col("fact_id").cast("long").alias("id"), F.col("v").alias("x"), every("sides").alias("s"))
    deal = lambda df: df.repartition(min(4 * cells, MOST_DEALT), "g", "s", "c").groupBy("g", "s", "c")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = _within(a["id"].to_numpy(), _by_size(a["q"]), b["id"].to_numpy(), _by_size(b["x"]), k, least, earlier) if len(a) and len(b) else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "fact_id", "score"])

    met = deal(left).cogroup(deal(right)).applyInArrow(meet, "query_id long, fact_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "fact_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; nearly no length counts as none."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(size >= 1e-6, x / np.maximum(size, 1e-6), 0.0)


def _within(qids: np.ndarray, queries: dict, ids: np.ndarray, vectors: dict, k: int, least: float | None, earlier: bool) -> list[np.ndarray]:
    """Query ids, ids and cosines of the k best of each query; a query without a vector, and a vector of another length, has cosine 0."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), int)
    place[order] = np.arange(len(ids))
    ids = ids[order]
    whole = {d: (at, q) for d, (at, q) in queries.items()}
    bare = np.setdiff1d(np.arange(len(qids)), np.concatenate([at for at, _ in whole.values()] or [np.empty(0, int)]))
    if len(bare):
        whole[0] = bare, np.zeros((len(bare), 1))
    out: list[list[np.ndarray]] = [[], [], []]
    for d, (at, q) in whole.items():
        x = np.zeros((len(ids), max(d, 1)))
        if d in vectors:
            rows, own = vectors[d]
            x[place[rows]] = _unit(own)
        q = _unit(q)
        for a in range(0, len(at), ROWS):
            own, part = qids[at[a : a + ROWS]], q[a : a + ROWS]
            best = _Best(len(own), k)
            for b in range(0, len(ids), COLUMNS):
                there = ids[b : b + COLUMNS]
                if earlier and there[0] >= own.max():
                    break
                scores = part @ x[b : b + COLUMNS].T
                scores[there[None, :] >= own[:, None] if earlier else there[None, :] == own[:, None]] = -np.inf
                if least is not None:
                    scores[scores < least] = -np.inf
                best.offer(scores, there)
            real = ~np.isneginf(best.scores)
            for held, new in zip(out, (own[best.row[real]], best.ids[real], best.scores[real])):
                held.append(new)
    return [np.concatenate(x) if x else np.empty(0) for x in out]
