"""Operators of the store and learning paths: edges, merges, gates, queues.

Every one is a plan of joins, windows and aggregates on keys; none collects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def causal_edges(rows: DataFrame, group: str, key: str, cue: str, reach: int, most: int, weight: float = 0.8) -> DataFrame:
    """(src, dst, weight) from the ``most`` rows of a group before a row with a cue, within ``reach`` ids."""
    before = Window.partitionBy(group).orderBy(key).rowsBetween(-most, -1)
    found = rows.withColumn("_before", F.collect_list(key).over(before)).where(cue).select(F.col(key).alias("dst"), F.explode("_before").alias("src"))
    return found.where(F.col("src") >= F.col("dst") - reach).select("src", "dst", F.lit(weight).alias("weight"))


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def noisy_step(old: Column, gain: float) -> Column:
    """A confidence moved by ``gain`` of what it lacks."""
    return old + (1 - old) * gain


def token_bucket(rows: DataFrame, key: str, seconds: str, rate: float, burst: float) -> DataFrame:
    """``rows`` with ``allowed``: whether a bucket of ``burst`` tokens, filled at ``rate`` a
    second, has one for the row.  A running state over a key's rows in order, as one fold."""
    rows = rows.withColumn("_k", F.struct(F.col(seconds).alias("t"), F.monotonically_increasing_id().alias("i")))
    order = F.sort_array(F.collect_list(F.col(seconds).cast("double")))
    start = F.struct(F.lit(float(burst)).alias("tokens"), F.lit(None).cast("double").alias("at"), F.lit(0).cast("long").alias("passed"))

    def step(s: Column, t: Column) -> Column:
        have = F.least(F.lit(float(burst)), s["tokens"] + F.coalesce(t - s["at"], F.lit(0.0)) * rate)
        return F.struct(F.when(have >= 1, have - 1).otherwise(have).alias("tokens"), t.alias("at"), (s["passed"] + (have >= 1).cast("long")).alias("passed"))

    return rows.groupBy(key).agg(F.count("*").alias("n"), F.aggregate(order, start, step)["passed"].alias("passed"))


def promoted(ranked: DataFrame, query: str, group: str, score: str, key: str, most: int, least: int) -> DataFrame:
    """The ``most`` best rows of a query, but with the best rows of other groups put in
    until ``least`` groups are there; ``rank`` by score, ties by key."""
    best = Window.partitionBy(query).orderBy(F.col(score).desc(), key)
    rows = ranked.withColumn("rank", F.row_number().over(best))
    rows = rows.withColumn("_first", F.min("rank").over(Window.partitionBy(query, group)))
    rows = rows.withColumn("_group", F.dense_rank().over(Window.partitionBy(query).orderBy("_first")))
    keep = (F.col("rank") <= most) | ((F.col("_group") <= least) & (F.col("rank") == F.col("_first")))
    return rows.where(keep).drop("_first", "_group")


def survivors(pairs: DataFrame, better: list[Column], a: str = "a", b: str = "b") -> DataFrame:
    """(loser, winner) of pairs: each loser with its best winner."""
    order = Window.partitionBy(b).orderBy(*better)
    return pairs.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(F.col(b).alias("loser"), F.col(a).alias("winner"))


def activate(seeds: DataFrame, edges: DataFrame, hops: int, keep: float = 0.7, least: float = 0.05) -> DataFrame:
    """(node, activation): the strongest way a seed's activation reaches a node in up to
    ``hops`` steps, each of which keeps ``keep`` times the edge's weight; weak ones stop."""
    from engramlake.operators.graph import cut

    seen = front = cut(seeds.select("node", "activation"))
    for _ in range(hops):
        sent = front.join(edges, front.node == edges.src).groupBy(F.col("dst").alias("node")).agg(F.max(F.col("activation") * keep * F.col("weight")).alias("activation"))
        front = cut(sent.where(F.col("activation") >= least))
        seen = seen.unionByName(front)
    return seen.groupBy("node").agg(F.max("activation").alias("activation"))


def suppressed(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """Scores (node, score, made) after ``supersedes`` edges (what they start from
    counts .3) and ``contradiction`` edges (the older end counts .5, if both were found)."""
    gone = edges.where("kind = 'supersedes'").select(F.col("src").alias("node")).distinct().withColumn("gone", F.lit(0.3))
    ends = edges.where("kind = 'contradiction'").select("src", "dst")
    a, b = (scores.select(F.col("node").alias(k), F.col("made").alias(f"{k}_made")) for k in ("src", "dst"))
    both = ends.join(a, "src").join(b, "dst")
    old = both.select(F.when(F.col("src_made") < F.col("dst_made"), F.col("src")).otherwise(F.col("dst")).alias("node")).distinct().withColumn("old", F.lit(0.5))
    out = scores.join(gone, "node", "left").join(old, "node", "left")
    return out.select("node", (F.col("score") * F.coalesce("gone", F.lit(1.0)) * F.coalesce("old", F.lit(1.0))).alias("score"))


def hmac_sha256(text: Column, key: str) -> Column:
    """The keyed hash of RFC 2104 over SHA-256, from the plain hash."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(x ^ pad for x in raw).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def debounced(rows: DataFrame, key: str, at: str, quiet: str) -> DataFrame:
    """The rows after which a key is quiet for a time: the last of each burst."""
    after = F.lead(at).over(Window.partitionBy(key).orderBy(at))
    return rows.withColumn("_next", after).where(F.col("_next").isNull() | (F.col("_next") - F.col(at) > F.expr(f"INTERVAL {quiet}"))).drop("_next")


def fair_order(rows: DataFrame, lane: str, order: str, shares: dict[str, float]) -> DataFrame:
    """``rows`` with ``place``: lanes served by their shares, each in its own order."""
    share = F.lit(None).cast("double")
    for name, s in shares.items():
        share = F.when(F.col(lane) == name, s).otherwise(share)
    k = F.row_number().over(Window.partitionBy(lane).orderBy(order))
    return rows.withColumn("_due", F.round(k / share, 9)).withColumn("place", F.row_number().over(Window.orderBy("_due", lane))).drop("_due")
