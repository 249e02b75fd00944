"""Vector, retention and scoring arithmetic: Column in, Column out.

Vectors are ``array<double>``; lambdas stay in the JVM.  Constants are the
model's defaults and can be passed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where ``body`` uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing, of another length, or nearly zero."""
    na, nb = norm(a), norm(b)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (na < 1e-6) | (nb < 1e-6), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def fisher_mean(a: Column) -> Column:
    return let(norm(a), lambda n: F.when(n < 1e-12, a).otherwise(F.transform(a, lambda x: x / n)))


def fisher_variance(a: Column, low: float = 0.05, high: float = 2.0) -> Column:
    """High where a component says little: 2 - 1.95 |m| / max |m|, clipped."""
    spread = lambda x, top: F.when(top < 1e-12, F.lit(high)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), high - (high - low) * x / top)))
    return let(F.transform(fisher_mean(a), F.abs), lambda m: let(F.array_max(m), lambda top: F.transform(m, lambda x: spread(x, top))))


def fisher_similarity(query: Column, mean: Column, variance: Column, temperature: float = 15.0) -> Column:
    """exp(-sum((q - m)^2 / max(v, 1e-6)) / T)."""
    parts = F.zip_with(F.zip_with(query, mean, lambda q, m: (q - m) * (q - m)), variance, lambda d, v: d / F.greatest(v, F.lit(1e-6)))
    return F.exp(-F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / temperature)


def acosh1p(delta: Column) -> Column:
    """acosh(1 + delta) without cancellation near 0."""
    return F.log1p(delta + F.sqrt(delta * (delta + 2.0)))


def fisher_rao_distance(m1: Column, v1: Column, m2: Column, v2: Column) -> Column:
    """sqrt(sum 2 acosh(1 + ((dm)^2 + 2 (dv)^2) / (4 v1 v2))^2)."""
    z = F.arrays_zip(m1.alias("m1"), v1.alias("v1"), m2.alias("m2"), v2.alias("v2"))
    term = lambda x: acosh1p(((x["m1"] - x["m2"]) * (x["m1"] - x["m2"]) + 2.0 * (x["v1"] - x["v2"]) * (x["v1"] - x["v2"])) / (4.0 * x["v1"] * x["v2"]))
    return F.sqrt(F.aggregate(F.transform(z, term), F.lit(0.0), lambda s, t: s + 2.0 * t * t))


def bayes_variance(old: Column, seen: Column) -> Column:
    return F.zip_with(old, seen, lambda a, b: F.greatest(F.lit(0.05), F.least(F.lit(2.0), 1.0 / (1.0 / a + 1.0 / b))))


def quantized_variance(v: Column, bits: int) -> Column:
    k = (32.0 / bits) ** 0.5
    return F.transform(v, lambda x: F.greatest(F.lit(0.05), F.least(F.lit(10.0), x * k)))


def retention(hours: Column, strength: Column) -> Column:
    """e^(-h / S), S at least .1; 1 for times to come."""
    return F.when(hours < 0, F.lit(1.0)).otherwise(F.exp(-hours / F.greatest(strength, F.lit(0.1))))


def trusted_retention(hours: Column, strength: Column, trust: Column) -> Column:
    """Retention that fades up to three times as fast for sources of no trust."""
    rate = (1.0 / F.greatest(strength, F.lit(0.1))) * (1.0 + 2.0 * (1.0 - trust))
    return F.when(hours < 0, F.lit(1.0)).otherwise(F.exp(-hours * rate))


def memory_strength(accesses: Column, importance: Column, confirmations: Column, salience: Column) -> Column:
    s = 2.0 * F.log1p(accesses) + 1.5 * importance + 1.0 * confirmations + 0.5 * salience
    return F.greatest(F.lit(0.1), F.least(F.lit(100.0), s))


def spaced_repetition(strength: Column, hours: Column, rate: float = 1.0) -> Column:
    return strength + rate * F.log1p(hours / 24.0)


def zone(r: Column) -> Column:
    return F.when(r > 0.8, "active").when(r > 0.5, "warm").when(r > 0.2, "cold").when(r > 0.05, "archive").otherwise("forgotten")


def zone_weight(z: Column) -> Column:
    return F.when(z == "active", 1.0).when(z == "warm", 0.7).when(z == "cold", 0.3).otherwise(0.0)


def precision_bits(r: Column) -> Column:
    return F.when(r > 0.8, 32).when(r > 0.5, 8).when(r > 0.2, 4).when(r > 0.05, 2).otherwise(0)


def centrality_bits(c: Column) -> Column:
    """2 + 30 c, rounded up to a width there is."""
    want = 2 + 30 * c
    return F.when(want <= 2, 2).when(want <= 4, 4).when(want <= 8, 8).otherwise(32)


def date_proximity(days: Column, width: float = 30.0, limit: float = 365.0) -> Column:
    return F.when(F.abs(days) > limit, F.lit(0.0)).otherwise(F.exp(-(days * days) / (2 * width * width)))


def recency_boost(age_days: Column) -> Column:
    return 1.0 + 0.2 * (F.greatest(F.lit(0.1), 1.0 - age_days / 365.0) - 0.5)


def coboundary(a: Column, b: Column) -> Column:
    """|b - a| / (|a| + |b| + eps): the disagreement of two facts on an edge."""
    gap = norm(F.zip_with(a, b, lambda x, y: y - x))
    return gap / (norm(a) + norm(b) + F.lit(1e-12))


def effective_temperature(mean_variance: Column, accesses: Column, base: float = 0.3) -> Column:
    confidence = 1.0 / (1.0 + mean_variance) + F.least(F.lit(0.2), accesses * F.lit(0.02))
    return F.coalesce(base / (confidence + 0.1), F.lit(base))


def equilibrium_radius(accesses: Column, age_days: Column, importance: Column, temperature: float = 0.3, dims: int = 8) -> Column:
    pull = 3.0 + 0.08 * F.log1p(accesses) - 0.005 * F.least(age_days, F.lit(365)) / 365.0 + 0.5 * importance
    return F.least(F.lit(0.9405), F.sqrt(temperature * dims / (2.0 * pull)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def beta_mean(successes: Column, failures: Column) -> Column:
    return (1.0 + successes) / (2.0 + successes + failures)


def reward_label(cited: Column, edited: Column, dwell_s: Column, requeried: Column) -> Column:
    """.5 + .4 cite + .25 edit + dwell (up to .15) - .5 requery, within 0 and 1."""
    raw = 0.5 + 0.4 * cited + 0.25 * edited + F.least(F.lit(0.15), dwell_s / 60.0 * 0.15) - 0.5 * requeried
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def relevance_grade(reward: Column, position: Column) -> Column:
    graded = F.when(reward >= 0.9, 4).when(reward >= 0.6, 3).when(reward >= 0.3, 2).when(reward > 0, 1).otherwise(0)
    placed = F.when(position == 0, 4).when(position <= 2, 3).when(position <= 4, 2).when(position <= 9, 1).otherwise(0)
    return F.when(reward.isNotNull(), graded).otherwise(placed)
