"""Rules that depend on what came before: the similarity gate and scenes, profile by profile.

The gate deals facts by profile and sorts them in their tasks by (created_on,
fact_id); a task reads them as a stream and holds a ring of ``window`` vectors.
Profiles run in parallel; within one the order is the rule's own.

Scenes may be nearly as many as facts, so their work is as the square of a
profile.  A profile is cut in blocks in order.  Round by round its next block meets
all earlier scenes in tiles that run in parallel, and one task goes through
the block in order with the scenes that the block itself opens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions.arrow import arrow_map
from engramlake.sources.scratch import Scratch, new_path, written


def _unit(x: list[float] | None) -> np.ndarray | None:
    """A vector of length 1; one without length is as far from all others as can be."""
    if x is None:
        return None
    v = np.array(x, dtype=float)
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


class Ring:
    """The last ``window`` vectors that passed."""

    def __init__(self, window: int, threshold: float):
        self.window, self.threshold, self.at, self.held = window, threshold, 0, None

    def __call__(self, v: np.ndarray | None) -> bool:
        if v is None:
            return True
        if self.held is None:
            self.held = np.zeros((self.window, len(v)))
        if len(v) != self.held.shape[1]:
            return True
        if (self.held @ v > self.threshold).any():
            return False
        self.held[self.at % self.window] = v
        self.at += 1
        return True


def _in_order(facts: DataFrame, columns: list[Column], start: Callable, step: Callable, schema: str) -> DataFrame:
    """``step(state, row)`` of each fact in order, with a state that ``start()`` makes for each profile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile, state = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["_profile"] != profile:
                    profile, state = row["_profile"], start()
                out.append(step(state, row))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    rows = facts.select(F.col("profile_id").alias("_profile"), "created_on", "fact_id", *columns).repartition("_profile").sortWithinPartitions("_profile", "created_on", "fact_id")
    return arrow_map(rows, run, schema)


def similarity_gate(facts: DataFrame, informative: Column, threshold: float = 0.95, window: int = 50) -> DataFrame:
    """(fact_id, verdict): pass, rule (not ``informative``) or similar (to one of the
    last ``window`` vectors that passed in its profile, by a cosine over the threshold).

    Facts without a vector pass and are not remembered.
    """

    def step(ring: Ring, row: dict) -> dict:
        verdict = "rule" if not row["ok"] else "pass" if ring(_unit(row["v"])) else "similar"
        return {"fact_id": row["fact_id"], "verdict": verdict}

    return _in_order(facts, [F.coalesce(informative, F.lit(False)).alias("ok"), F.col("v").cast("array<double>").alias("v")], lambda: Ring(window, threshold), step, "fact_id long, verdict string")


#: Facts of a profile in a round; scenes of a tile, and tiles of a round, at most, beyond which they grow.
BLOCK, TILE, TILES = 32_768, 4_096, 24
#: Facts and scenes that one product of matrices compares.
ROWS, COLUMNS = 512, 8_192
NONE = -2.0


def _units(column: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose vector has ``dim`` components, and their vectors of length 1."""
    a = column.combine_chunks()
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    at = np.flatnonzero(np.asarray(pc.equal(pc.list_value_length(a), dim).fill_null(False)))
    x = a.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dim)
    n = np.sqrt((x * x).sum(axis=1))
    return at, x / np.where(n > 0, n, 1.0)[:, None]


def _nearest(v: np.ndarray, themes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``v`` the theme of most likeness to nine digits, of ties the first, and the likeness."""
    best, at = np.full(len(v), NONE), np.zeros(len(v), int)
    for a in range(0, len(v), ROWS):
        for b in range(0, len(themes), COLUMNS):
            s = v[a : a + ROWS] @ themes[b : b + COLUMNS].T
            s[np.isnan(s)] = NONE
            top = s.max(axis=1)
            k = np.argmax(s >= top[:, None] - 2e-9, axis=1)  # the first that may tie
            own = s[np.arange(len(s)), k]
            for i in np.flatnonzero(np.round(own, 9) != np.round(top, 9)):
                k[i] = np.argmax(np.round(s[i], 9))
                own[i] = s[i, k[i]]
            more = np.flatnonzero(np.round(own, 9) > np.round(best[a : a + ROWS], 9))
            best[a + more], at[a + more] = own[more], b + k[more]
    return best, at


def _met(facts: pa.Table, scenes: pa.Table) -> pa.Table:
    """The nearest scene of a tile for each fact of a block: (place, opened, scene, similarity)."""
    empty = {"place": pa.array([], pa.int64()), "opened": pa.array([], pa.int64()), "scene": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())}
    if not len(facts) or not len(scenes):
        return pa.table(empty)
    scenes = scenes.sort_by("place")
    _, themes = _units(scenes["theme"], scenes["dim"][0].as_py())
    rows, v = _units(facts["v"], themes.shape[1])
    s, at = _nearest(v, themes)
    near = np.flatnonzero(s > NONE)
    to = scenes.take(pa.array(at[near]))
    return pa.table({"place": facts["place"].take(pa.array(rows[near])), "opened": to["place"], "scene": to["fact_id"], "similarity": s[near]})


def _through(block: pa.Table, threshold: float) -> pa.Table:
    """A block of a profile in order, each fact with its nearest earlier scene: (fact_id, scene, similarity) and what it opens."""
    block = block.sort_by("place")
    n, ids = len(block), block["fact_id"].to_pylist()
    best, to = block["similarity"].to_pylist(), block["scene"].to_pylist()
    sizes = pc.list_value_length(block["theme"].combine_chunks()).to_pylist()
    dim = block["known"][0].as_py()
    # the first scene fixes how many components a theme has; a fact before it is near none
    if dim is None:
        dim = next((d for d in sizes if d is not None), None)
    opens = [None] * n
    if dim is not None:
        themed, t = _units(block["theme"], dim)
        likely, u = _units(block["v"], dim)
        themes, v = np.zeros((n, dim)), np.zeros((n, dim))
        themes[themed], v[likely] = t, u
        has = np.zeros(n, bool)
        has[likely] = True
        new, owner = np.zeros((n, dim)), np.zeros(n, np.int64)
    count = 0
    for a in range(0, n, ROWS):
        if dim is not None:
            rows = slice(a, min(a + ROWS, n))
            s, at = _nearest(v[rows], new[:count])
            inner = v[rows] @ themes[rows].T
            inner[np.isnan(inner)] = NONE
            inner, begun = np.round(inner, 9), np.zeros(inner.shape[1], bool)
        for k in range(a, min(a + ROWS, n)):
            value, scene = (best[k], to[k]) if best[k] is not None else (NONE, None)
            if dim is not None and has[k]:
                if round(s[k - a], 9) > round(value, 9):
                    value, scene = float(s[k - a]), ids[owner[at[k - a]]]
                if begun.any():
                    own = np.where(begun, inner[k - a], NONE)
                    j = int(np.argmax(own))
                    if own[j] > round(value, 9):
                        value, scene = float(v[k] @ themes[a + j]), ids[a + j]
            if round(value, 9) >= threshold and value > NONE:
                best[k], to[k] = value, scene
                continue
            best[k], to[k] = None, ids[k]
            if dim is not None and sizes[k] == dim:
                new[count], owner[count] = themes[k], k
                count += 1
                begun[k - a] = True
                opens[k] = dim
    out = {"p": block["p"], "n": block["n"], "place": block["place"], "fact_id": block["fact_id"], "scene": pa.array(to, pa.int64()), "similarity": pa.array(best, pa.float64()), "dim": pa.array(opens, pa.int32())}
    return pa.table(out | {"theme": block["theme"]})


def _placed(facts: DataFrame, columns: list[Column]) -> DataFrame:
    """(p, n, place, at, fact_id, columns): the profile, its size, and a fact's place in all and in its profile."""
    order = ["_profile", "created_on", "fact_id"]
    rows = facts.select(F.col("profile_id").alias("_profile"), "created_on", F.col("fact_id").cast("long").alias("fact_id"), *columns)
    rows = written(rows.orderBy(*order).withColumn("row", F.monotonically_increasing_id()).drop("created_on"), "in-order")
    # the sorted partitions one behind another: a row each
    part = F.shiftright("row", 33)
    sizes = sorted((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for k, n in sizes:
        starts.append((k, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "part long, before long")
    rows = rows.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("place", F.col("before") + F.col("row").bitwiseAND((1 << 33) - 1)).drop("row", "part", "before")
    own = rows.groupBy(F.col("_profile").alias("whose")).agg(F.min("place").alias("p"), F.count("*").alias("n"))
    return rows.join(own, F.col("_profile").eqNullSafe(F.col("whose"))).drop("_profile", "whose").withColumn("at", F.col("place") - F.col("p"))


def scenes(facts: DataFrame, threshold: float = 0.6, block: int = BLOCK) -> DataFrame:
    """(fact_id, scene, similarity): each fact goes to the scene of its profile whose
    theme (``theme``, the vector of the beginning of its first fact) is nearest to
    ``v``, if near enough, else it opens one, named after it, with a null similarity.

    Likeness counts to nine digits; of ties the earliest scene is taken.  ``block``
    facts of a profile are a round; it changes no result.
    """
    spark = facts.sparkSession
    exact = lambda c: F.col(c) if facts.schema[c].dataType.simpleString() == "array<float>" else F.col(c).cast("array<double>").alias(c)
    kind = facts.select(exact("theme")).schema["theme"].dataType.simpleString()
    schema = f"p long, n long, place long, fact_id long, scene long, similarity double, dim int, theme {kind}"
    with Scratch(spark, "scenes") as scratch:
        rows = _placed(facts, [exact("v"), exact("theme")])
        rows = scratch.written(rows.withColumn("round", F.floor(F.col("at") / block)).repartitionByRange("round", "place").sortWithinPartitions("round", "place"))
        last = rows.agg(F.max("round")).first()[0]
        done, path = None, new_path(spark, "scenes-done")
        for k in range((-1 if last is None else last) + 1):
            now = rows.where(F.col("round") == k).drop("round", "at")
            if k == 0:
                now = now.select("*", F.lit(None).cast("long").alias("scene"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("int").alias("known"))
            else:
                begun = done.where((F.col("n") > k * block) & F.col("dim").isNotNull())
                tiles = min(TILES, -(-k * block // TILE))
                sent = now.where("v is not null").select("p", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), "place", "v")
                held = begun.select("p", F.pmod("place", F.lit(tiles)).cast("int").alias("tile"), "place", "fact_id", "dim", "theme")
                met = sent.groupBy("p", "tile").cogroup(held.groupBy("p", "tile")).applyInArrow(_met, "place long, opened long, scene long, similarity double")
                near = F.max_by(F.struct("scene", "similarity"), F.struct(F.round("similarity", 9), -F.col("opened"))).alias("near")
                near = met.groupBy("place").agg(near).select("place", "near.*")
                known = begun.groupBy("p").agg(F.max("dim").alias("known"))
                now = now.join(near, "place", "left").join(known, "p", "left")
            now.groupBy("p").applyInArrow(lambda t: _through(t, threshold), schema).write.parquet(f"{path}/{k}")
            done = spark.read.schema(schema).parquet(*[f"{path}/{i}" for i in range(k + 1)])
    if done is None:
        return spark.createDataFrame([], "fact_id long, scene long, similarity double")
    return done.select("fact_id", "scene", "similarity")
