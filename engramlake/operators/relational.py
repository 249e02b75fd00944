"""Filters, joins, aggregates and windows of the memory model.

Each takes DataFrames and returns one.  Joins are equi-joins (with a range
condition where the operator has one), aggregates combine map-side, and windows
partition by a key; what is small is left to the optimiser to broadcast by its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- filters -------------------------------------------------------------------


def visible(profile: str, include_global: bool = True, include_shared: bool = True) -> Column:
    """Own personal facts, and global and shared ones if asked."""
    seen = (F.col("scope") == "personal") & (F.col("profile_id") == profile)
    if include_global:
        seen = seen | (F.col("scope") == "global")
    if include_shared:
        seen = seen | (F.col("scope") == "shared")
    return seen


def valid_at(validity: DataFrame, moment: str) -> DataFrame:
    """Facts with valid_from <= t < valid_until; open ends are null."""
    t = F.lit(moment).cast("timestamp_ntz")
    return validity.where((F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_until").isNull() | (t < F.col("valid_until"))))


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``ids``: a semi join, whatever the number of ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def denied(requests: DataFrame, policies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests that no deny row matches: allowed unless denied."""
    return requests.join(policies.select(*keys).distinct(), list(keys), "left_anti")


def forget_filter(scores: DataFrame, retention: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Scores times the weight of the fact's zone; zones of weight 0 go; facts
    without retention stay as they are."""
    w = F.lit(None).cast("double")
    for zone, weight in weights.items():
        w = F.when(F.col("zone") == zone, F.lit(weight)).otherwise(w)
    joined = scores.join(retention.select("fact_id", "zone"), "fact_id", "left")
    kept = joined.withColumn("w", F.when(F.col("zone").isNull(), F.lit(1.0)).otherwise(F.coalesce(w, F.lit(0.0))))
    return kept.where("w > 0").withColumn("score", F.col("score") * F.col("w")).drop("w", "zone")


# ---- joins ---------------------------------------------------------------------

#: Rows of a partition of what is joined with itself.
DEALT = 1 << 16


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into partitions of about DEALT rows each, if it has ``rows``.

    A join of rows that meet many others makes many times what it reads; what a task
    of it makes and combines stays the same then, however large the table.  A stated number of
    partitions is not merged into fewer.
    """
    return df.repartition(max(1, -(-rows // DEALT)), *keys)


def two_hop(edges: DataFrame, rows: int) -> DataFrame:
    """(src, mid, dst) of edges that follow each other, without returns; ``rows``: how many edges there are, or more."""
    e2 = dealt(edges.select(F.col("src").alias("mid"), F.col("dst").alias("far")), rows, "mid")
    return dealt(edges.select("src", F.col("dst").alias("mid"), "weight"), rows, "mid").join(e2, "mid").where("src <> far").select("src", "mid", F.col("far").alias("dst"), "weight")


def within(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, after: str, seconds: int) -> DataFrame:
    """Pairs of equal keys with ``at`` < ``after`` <= ``at`` + seconds.

    Both sides are dealt by key and time bucket of the interval's width, the
    left one to its bucket and the next: a range join as an equi-join, so a busy
    key is spread over time.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c)) / (seconds * 1_000_000))
    a = left.withColumn("_b", F.explode(F.array(bucket(at), bucket(at) + 1)))
    b = right.withColumn("_b", bucket(after))
    close = (F.col(after) > F.col(at)) & (F.unix_micros(F.col(after)) - F.unix_micros(F.col(at)) <= seconds * 1_000_000)
    return a.join(b, [*keys, "_b"]).where(close).drop("_b")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before ``at``: one sorted union, no range join."""
    both = left.select(key, at, F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1).alias("_left"), *[c for c in left.columns if c not in (key, at)])
    other = right.select(key, at, F.col(value).alias("_v"), F.lit(0).alias("_left"))
    w = Window.partitionBy(key).orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.unionByName(other, allowMissingColumns=True).withColumn(f"last_{value}", F.last("_v", ignorenulls=True).over(w))
    return joined.where("_left = 1").drop("_v", "_left")


def co_occurrences(df: DataFrame, group: str, item: str, place: str | None = None, reach: int | None = None, rows: int | None = None) -> DataFrame:
    """(a, b, n): unordered pairs of distinct items in a group, within ``reach`` places if given.
    With ``rows``, the number of rows or more, they are dealt for it."""
    df = df if rows is None else dealt(df, rows, group)
    left = df.select(group, F.col(item).alias("a"), *([F.col(place).alias("pa")] if place else []))
    right = df.select(group, F.col(item).alias("b"), *([F.col(place).alias("pb")] if place else []))
    pairs = left.join(right, group).where("a < b")
    if place and reach:
        pairs = pairs.where(F.abs(F.col("pa") - F.col("pb")) <= reach)
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


# ---- aggregates ----------------------------------------------------------------


def conditional_counts(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def share_of_total(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share): shares of all rows, from one aggregate and one scalar."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))  # total is one row


def noisy_or(df: DataFrame, keys: Sequence[str], value: str, confidence: str) -> DataFrame:
    """Combined confidence 1 - prod(1 - c), evidence count and the value of most confidence."""
    gone = F.sum(F.log1p(-F.least(F.col(confidence), F.lit(0.999999))))
    return df.groupBy(*keys).agg(F.round(1 - F.exp(gone), 6).alias("confidence"), F.count("*").alias("evidence"), F.max_by(value, F.struct(confidence, value)).alias("best"))


def density(daily: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """Counts per day with zeros for the days without rows."""
    days = daily.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    counts = daily.groupBy(F.to_date(day).alias("day")).agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


# ---- windows -------------------------------------------------------------------


def transitions(df: DataFrame, key: str, order: Sequence[str], item: str, least: int, share: float) -> DataFrame:
    """(a, b, n, share): consecutive different items, often enough among those that leave a."""
    nxt = df.withColumn("b", F.lead(item).over(Window.partitionBy(key).orderBy(*order))).where(F.col("b").isNotNull() & (F.col("b") != F.col(item)))
    counts = nxt.groupBy(F.col(item).alias("a"), "b").agg(F.count("*").alias("n"))
    out = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("a")))
    return out.where((F.col("n") >= least) & (F.col("share") >= share)).withColumn("share", F.round("share", 6))


def islands(df: DataFrame, key: str, at: str, gap_days: int) -> DataFrame:
    """``df`` with ``island``: a new number after each gap of more than ``gap_days``."""
    w = Window.partitionBy(key).orderBy(at)
    fresh = F.when(F.datediff(F.col(at), F.lag(at).over(w)) > gap_days, 1).otherwise(0)
    return df.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def top_per_group(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def ngrams(df: DataFrame, key: str, order: Sequence[str], item: str, size: int) -> DataFrame:
    """(gram, n): runs of ``size`` items without equal neighbours, joined by ``>``."""
    w = Window.partitionBy(key).orderBy(*order)
    items = [F.lead(item, k).over(w) for k in range(size)]
    rows = df.select(*[c.alias(f"i{k}") for k, c in enumerate(items)]).where(F.col(f"i{size - 1}").isNotNull())
    for k in range(1, size):
        rows = rows.where(F.col(f"i{k}") != F.col(f"i{k - 1}"))
    return rows.groupBy(F.concat_ws(">", *[f"i{k}" for k in range(size)]).alias("gram")).agg(F.count("*").alias("n"))


def turn_chunks(turns: DataFrame, key: str, order: str, size: int = 10, overlap: int = 2) -> DataFrame:
    """(key, chunk, turns): windows of ``size`` turns that overlap; a row goes to its chunks by arithmetic."""
    step = size - overlap
    at = turns.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    first = F.greatest(F.ceil((F.col("_i") - size + 1) / step), F.lit(0))
    spread = at.withColumn("chunk", F.explode(F.sequence(first.cast("long"), F.floor(F.col("_i") / step))))
    return spread.groupBy(key, "chunk").agg(F.count("*").alias("turns"))
