"""Operator 7: embedding near-duplicates by a subspace pigeonhole join.

Vectors are normalised in double precision and rotated by a seeded orthonormal
matrix, then split into blocks of few dimensions.  Cosine >= c means a squared
distance of at most 2 (1 - c), so in one block at least the squared distance is
within the block's share of it by dimensions.  Each block is range-joined under that
budget: pivots cut the block's space into cells, every vector is at home in
its nearest pivot's cell and a guest of each cell (of a later pivot) whose
bisecting plane it is within the radius of.  Cells are dealt out in pieces of
bounded size; a piece verifies its candidates with the full vectors, which are
dealt as they came (in single precision if that is how they are stored) and
normalised where they are compared, so a row is as small as its input.

A pair is counted in the first block within budget only, so the union of the
blocks counts each link once; of the links a piece sends out counts per vector and
a spanning forest, never the pairs.  Equal vectors are one row with a number
before the join, so copies are not compared.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, link with nothing, not even their copies; vectors of different
lengths are not compared; a null id gets no component; repeated rows count as
vectors.  ``label`` and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.llm.shared import arrow_map, components, materialize, table

#: Dimensions of a block, rows of a cell aimed at, pivots at most, rows of a piece.
BLOCK, CELL, MOST_PIVOTS, PIECE = 16, 8000, 4096, 16000
#: Slack for rounding: budgets are widened by it; the cosine itself is not.
SLACK, COARSE = 1e-9, 1e-5


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def unit(rows: list | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, which rows are usable); all rows have one length."""
    if not len(rows):
        return np.zeros((0, 0)), np.zeros(0, dtype=bool)
    x = np.array(rows, dtype=np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        x = x / scale
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x, np.isfinite(x).all(axis=1) & (scale[:, 0] > 0) & np.isfinite(scale[:, 0])


class Blocks:
    """The rotation, the blocks and each block's pivots for one vector length."""

    def __init__(self, sample: np.ndarray, count: int, cosine: float):
        self.dims, self.cosine = sample.shape[1], cosine
        self.turn = rotation(self.dims)
        self.cuts = [(a, min(a + BLOCK, self.dims)) for a in range(0, self.dims, BLOCK)]
        self.budget = [2 * (1 - cosine) * (b - a) / self.dims + SLACK for a, b in self.cuts]
        pivots = int(min(MOST_PIVOTS, len(sample), max(1, count // CELL)))
        turned = sample @ self.turn
        rng = np.random.default_rng(7)
        self.pivots = []
        for a, b in self.cuts:
            centres = turned[rng.choice(len(turned), pivots, replace=False), a:b]
            for _ in range(4):  # a few k-means steps even out the cells
                near = self.squares(turned[:, a:b], centres).argmin(axis=1)
                counts = np.bincount(near, minlength=pivots)
                sums = np.stack([np.bincount(near, weights=turned[:, a + d], minlength=pivots) for d in range(b - a)], axis=1)
                centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
            self.pivots.append(np.unique(centres, axis=0))

    @staticmethod
    def squares(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (x * x).sum(axis=1)[:, None] - 2 * x @ p.T + (p * p).sum(axis=1)

    def cells(self, turned: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(block, row, cell, at home?) of rotated vectors: homes, and later cells within reach."""
        for k, (a, b) in enumerate(self.cuts):
            p = self.pivots[k]
            gap = np.sqrt(np.maximum(self.squares(p, p), 0))
            for start in range(0, len(turned), 2000):
                d = self.squares(turned[start : start + 2000, a:b], p)
                home = d.argmin(axis=1)
                rows = np.arange(len(d))
                # distance to the plane that halves the way between two pivots
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d - d[rows, home][:, None]) / (2 * gap[home])
                # pivots too near to tell apart have no plane: the other's cell is within reach
                reach = ((gap[home] <= 1e-6) | (plane <= np.sqrt(self.budget[k]) + SLACK)) & (np.arange(len(p)) > home[:, None])
                i, j = np.nonzero(reach)
                yield k, np.concatenate([rows, i]) + start, np.concatenate([home, j]), np.concatenate([np.ones(len(rows), dtype=bool), np.zeros(len(i), dtype=bool)])

    def links(self, left: np.ndarray, right: np.ndarray, block: int, triangle: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of linked unit vectors whose first block within budget is ``block``."""
        a, b = self.cuts[block]
        own_l, own_r = left @ self.turn, right @ self.turn
        near_l, near_r = own_l[:, a:b].astype(np.float32), own_r[:, a:b].astype(np.float32)
        half = ((near_r * near_r).sum(axis=1) - np.float32(self.budget[block] + COARSE)) / 2
        for start in range(0, len(left), 256):
            part = near_l[start : start + 256]
            # |l - r|^2 <= budget, in single precision with slack: what passes is verified below
            i, j = np.nonzero(part @ near_r.T >= half + (part * part).sum(axis=1)[:, None] / 2)
            i += start
            if triangle:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 100_000):
                x, y = i[k : k + 100_000], j[k : k + 100_000]
                # sums of the same products in the same order wherever a pair is met
                good = (left[x] * right[y]).sum(axis=1) >= self.cosine
                x, y = x[good], y[good]
                if len(x):
                    apart = (own_l[x] - own_r[y]) ** 2
                    first = np.zeros(len(x), dtype=bool)
                    for e, (c, d) in reversed(list(enumerate(self.cuts[: block + 1]))):
                        within = apart[:, c:d].sum(axis=1) <= self.budget[e]
                        first = within if e == block else first & ~within
                    x, y = x[first], y[first]
                yield x, y


def _forest(pairs: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id joined with it) over pairs of positions, by repeated minima."""
    if not pairs:
        return ids[:0], ids[:0]
    i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    low = np.arange(len(ids))
    while True:
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if (low == before).all():
            break
    at = np.flatnonzero(low != np.arange(len(ids)))
    return ids[at], ids[low[at]]


def near_duplicates(df: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``df``.

    Shuffles: rows by equal vector (with a map-side minimum and count), the
    distinct vectors by cell, edges and counts by id.
    """
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull())
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero
    same = materialize(rows.where("sound").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    found = None
    narrow = df.select(F.col(vector)).schema[0].dataType == T.ArrayType(T.FloatType())
    for r in same.groupBy(F.size("v").alias("dims")).count().collect():  # vectors of one length each time
        one = _links(same.where(F.size("v") == r.dims), r["count"], cosine, "float" if narrow else "double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = df.sparkSession.createDataFrame([], "id long, links long, low long")
    found = materialize(found, "vector-links")
    counts = found.where("links is not null").groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    labels = components(found.where("low is not null").select(F.col("id").alias("a"), F.col("low").alias("b")))
    known = same.join(counts, "rep", "left").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = known.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    joined = rows.join(known.withColumn("sound", F.lit(True)), ["v", "sound"], "left")
    out = joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: Vectors that place the pivots; every vector is dealt to cells and compared.
SAMPLE = 20_000


def _links(same: DataFrame, count: int, cosine: float, number: str) -> DataFrame:
    """(id, links, null) and (id, null, low): link counts weighted by copies, and forest edges.

    ``number`` is the type that holds the vectors' components without loss.
    """
    share = min(1.0, SAMPLE / max(1, count))
    place = F.pmod(F.xxhash64(F.lit("pivots"), "rep"), F.lit(1 << 40)) / float(1 << 40)
    sample, _ = unit([r.v for r in same.where(place < share * 1.05).select("v", "rep").orderBy("rep").toLocalIterator()] or [same.first().v])
    blocks = Blocks(sample, count, cosine)
    home = T.StructType.fromDDL(f"block int, cell int, home boolean, id long, copies long, v array<{number}>")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            raw = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            x, _ = unit(raw)
            for block, row, cell, own in blocks.cells(x @ blocks.turn):
                for k in range(0, len(row), 4000):
                    part = pa.array(row[k : k + 4000])
                    values = raw[row[k : k + 4000]]
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * x.shape[1]), pa.array(values.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), block, dtype=np.int32)), pa.array(cell[k : k + 4000].astype(np.int32)), pa.array(own[k : k + 4000]), batch.column(0).take(part), batch.column(1).take(part), vectors],
                        names=home.names,
                    )

    dealt = materialize(arrow_map(same.select("rep", "copies", F.col("v").cast(f"array<{number}>")), deal, home), "cells")
    # pieces of a cell: homes p meet homes and guests q >= p; guests count on after the homes
    sizes = dealt.groupBy("block", "cell").agg(F.ceil(F.count_if("home") / PIECE).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("home")) / PIECE).cast("int").alias("guests")).where("homes > 0")
    placed = dealt.join(sizes, ["block", "cell"])
    mix = F.xxhash64("id")
    placed = placed.withColumn("p", F.when(F.col("home"), F.pmod(mix, F.col("homes"))).otherwise(F.col("homes") + F.pmod(mix, F.greatest("guests", F.lit(1)))).cast("int"))
    every = F.sequence(F.lit(0), F.when(F.col("home"), F.col("homes") + F.col("guests") - 1).otherwise(F.col("homes") - 1))
    pieces = placed.withColumn("q", F.explode(every))
    pieces = pieces.select("block", "cell", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), (F.col("p") > F.col("q")).alias("second"), "id", "copies", "v")
    out = T.StructType.fromDDL("id long, links long, low long")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        block = group.column("block")[0].as_py()
        ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
        v, _ = unit(group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
        second = group.column("second").to_numpy()
        alone = group.column("x")[0].as_py() == group.column("y")[0].as_py()
        order = np.argsort(ids, kind="stable")
        left = order if alone else order[~second[order]]
        right = order if alone else order[second[order]]
        links = np.zeros(len(ids), dtype=np.int64)
        pairs = []
        for i, j in blocks.links(v[left], v[right], block, alone):
            i, j = left[i], right[j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            pairs.append((i, j))
        at = np.flatnonzero(links)
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        node, low = _forest([(rank[i], rank[j]) for i, j in pairs], ids[order])
        return pa.table({
            "id": pa.array(np.concatenate([ids[at], node])),
            "links": pa.array([*links[at].tolist(), *[None] * len(node)], pa.int64()),
            "low": pa.array([*[None] * len(at), *low.tolist()], pa.int64()),
        })

    return pieces.groupBy("block", "cell", "x", "y").applyInArrow(compare, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
