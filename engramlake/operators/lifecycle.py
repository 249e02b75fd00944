"""Lifecycle, learning and governance operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import vectors as V


def decay(facts: DataFrame, hours: Column, salience: Column, confirmations: Column) -> DataFrame:
    """``facts`` with strength, retention, zone and bits after ``hours`` without access."""
    s = V.memory_strength(F.col("access_count"), F.col("importance"), confirmations, salience)
    out = facts.withColumn("strength", s).withColumn("retention", V.retention(hours, F.col("strength")))
    return out.withColumn("zone", V.zone(F.col("retention"))).withColumn("bits", V.precision_bits(F.col("retention")))


def tier(idle_days: Column, accesses: Column, importance: Column, pinned: Column) -> Column:
    """active, warm, cold or archived by idle days against 30, 180 and 365, stretched
    twice for five accesses or more, three times for importance of .8 or more; a fact can fall several tiers."""
    stretch = F.least(F.greatest(F.when(accesses >= 5, 2).otherwise(1), F.when(importance >= 0.8, 3).otherwise(1)), F.lit(3))
    return (
        F.when(pinned, "active").when(idle_days >= 365 * stretch, "archived").when(idle_days >= 180 * stretch, "cold").when(idle_days >= 30 * stretch, "warm").otherwise("active")
    )


def edge_decay(edges: DataFrame, days: int = 30, rate: float = 0.01, least: float = 0.05) -> DataFrame:
    import math

    return edges.withColumn("weight", F.col("weight") * math.exp(-rate * days)).where(F.col("weight") >= least)


def prefix_duplicates(facts: DataFrame, length: int = 100) -> DataFrame:
    """(canonical, duplicate) of facts with the same first characters in a profile, the oldest kept."""
    w = Window.partitionBy("profile_id", F.substring("content", 1, length)).orderBy("fact_id")
    first = F.first("fact_id").over(w)
    return facts.select(first.alias("canonical"), F.col("fact_id").alias("duplicate")).where("canonical <> duplicate")


def trust(signals: DataFrame, key: str, gains: dict[str, tuple[float, float]], column: str) -> DataFrame:
    """(key, alpha, beta, trust): a Beta(1, 1) prior plus each signal's deltas."""
    a, b = F.lit(0.0), F.lit(0.0)
    for name, (x, y) in gains.items():
        a = F.when(F.col(column) == name, F.lit(x)).otherwise(a)
        b = F.when(F.col(column) == name, F.lit(y)).otherwise(b)
    out = signals.groupBy(key).agg((1.0 + F.sum(a)).alias("alpha"), (1.0 + F.sum(b)).alias("beta"))
    return out.withColumn("trust", F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 6))


def decayed_prior(alpha: Column, beta: Column, idle_days: Column, rate: float = 0.05, free: int = 30) -> tuple[Column, Column]:
    """Shrinks both towards 1 by ``rate`` a day beyond ``free`` idle days."""
    keep = F.when(idle_days > free, F.pow(F.lit(1 - rate), idle_days - free)).otherwise(F.lit(1.0))
    return 1 + (alpha - 1) * keep, 1 + (beta - 1) * keep


def bandit_posterior(plays: DataFrame, keys: list[str], reward: str, cap: float = 1000.0) -> DataFrame:
    """Alpha and beta of each arm: 1 plus rewards, 1 plus their complements, capped."""
    return plays.groupBy(*keys).agg(
        F.least(F.lit(cap), 1.0 + F.sum(reward)).alias("alpha"), F.least(F.lit(cap), 1.0 + F.sum(1.0 - F.col(reward))).alias("beta"), F.count("*").alias("plays")
    )


def arm(query_id: Column) -> Column:
    """The arm of a shadow test: parity of the first 32 bits of the id's hash."""
    return (F.conv(F.substring(F.sha2(query_id.cast("string"), 256), 1, 8), 16, 10).cast("long") % 2).cast("int")


def paired(df: DataFrame, pair: str, group: str, value: str) -> DataFrame:
    """One row: pairs with both arms, mean difference of arm 1 over arm 0, and the paired t."""
    side = lambda g: F.avg(F.when(F.col(group) == g, F.col(value)))
    d = df.groupBy(pair).agg((side(1) - side(0)).alias("d")).where("d IS NOT NULL")
    one = d.agg(F.count("*").alias("pairs"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    return one.select("pairs", F.round("m", 6).alias("difference"), F.round(F.col("m") / (F.col("s") / F.sqrt("pairs")), 6).alias("t"))


def chain(entries: DataFrame, order: str, body: Column) -> DataFrame:
    """(log, order, body, content_hash, previous): each hash covers its body and the hash before it.

    A chain is sequential by nature: a log is folded in one task, logs in parallel.
    """
    rows = entries.select("log", F.col(order).cast("long").alias(order), body.alias("body"))

    def fold(log):
        import hashlib

        log = log.sort_values(order)
        hashes, before = [], [""]
        for text in log["body"]:
            hashes.append(hashlib.sha256((before[-1] + text).encode()).hexdigest())
            before.append(hashes[-1])
        return log.assign(content_hash=hashes, previous=before[:-1])

    return rows.groupBy("log").applyInPandas(fold, f"log long, {order} long, body string, content_hash string, previous string")


def verify_chain(entries: DataFrame, order: str) -> DataFrame:
    """(log, entries, broken): records whose hash or link to the one before is wrong.

    Each record is checked by what it and its predecessor state, so it needs no fold.
    """
    w = Window.partitionBy("log").orderBy(order)
    good = (F.col("content_hash") == F.sha2(F.concat("previous", "body"), 256)) & (F.col("previous") == F.coalesce(F.lag("content_hash").over(w), F.lit("")))
    return entries.withColumn("good", good).groupBy("log").agg(F.count("*").alias("entries"), F.count_if(~F.col("good")).alias("broken"))


def expired(facts: DataFrame, rules: DataFrame, age_days: Column) -> DataFrame:
    """Facts older than the strictest rule of their profile."""
    strict = rules.groupBy("profile_id").agg(F.min("days").alias("days"))
    return facts.join(strict, "profile_id").where(age_days > F.col("days"))


def settle(plays: DataFrame, hits: DataFrame, requeries: DataFrame, key: str) -> DataFrame:
    """(key, reward): 0 for plays asked again, else 1 for plays with a hit, else .5."""
    h = hits.select(key).distinct().withColumn("hit", F.lit(True))
    r = requeries.select(key).distinct().withColumn("again", F.lit(True))
    joined = plays.select(key).join(h, key, "left").join(r, key, "left")
    return joined.select(key, F.when(F.col("again"), 0.0).when(F.col("hit"), 1.0).otherwise(0.5).alias("reward"))


def bursts(events: DataFrame, key: str, at: str, seconds: int, least: int) -> DataFrame:
    """(key, at, n): moments at which ``least`` events or more lie in the trailing window."""
    w = Window.partitionBy(key).orderBy("_s").rangeBetween(-seconds, 0)
    return events.withColumn("_s", F.unix_seconds(F.col(at))).withColumn("n", F.count("*").over(w)).where(F.col("n") >= least).select(key, at, "n")
