"""Dates, vectors, Fisher metric, retention curves and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.functions import vectors as V
from engramlake.operators import retrieval as Q
from engramlake.plans.registry import query
from engramlake.sources.tables import FACTS_SQL, events, facts, stored, table, vectors

VEC_SQL = "vec AS (SELECT vec_id AS fact_id, CAST(embedding AS DOUBLE[]) AS v, label AS community, vec_id % 20 AS access_count FROM embeddings)"
COS = "list_cosine_similarity"


def _norm(x: str) -> str:
    return f"sqrt(list_sum(list_transform({x}, lambda e: e * e)))"


@query("SELECT o_orderkey, round(CASE WHEN abs(d) > 365 THEN 0.0 ELSE exp(-(d * d) / 1800.0::DOUBLE) END, 6) AS proximity FROM (SELECT o_orderkey, CAST(date_diff('day', DATE '1997-06-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS d FROM orders)")
def date_proximity(spark, sf):
    d = F.datediff(F.to_date("o_orderdate"), F.lit("1997-06-01").cast("date")).cast("double")
    return table(spark, sf, "orders").select("o_orderkey", F.round(V.date_proximity(d), 6).alias("proximity"))


@query("""SELECT CASE WHEN h BETWEEN 6 AND 11 THEN 'morning' WHEN h BETWEEN 12 AND 17 THEN 'afternoon' WHEN h >= 18 THEN 'evening' ELSE 'night' END AS bucket, count(*) AS n FROM (SELECT hour(ts) AS h FROM events) GROUP BY 1""")
def hour_buckets(spark, sf):
    h = F.hour("ts")
    b = F.when(h.between(6, 11), "morning").when(h.between(12, 17), "afternoon").when(h >= 18, "evening").otherwise("night")
    return events(spark, sf).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT strftime(ts, '%Y-W%W') AS week, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1""")
def weekly_timeline(spark, sf):
    # Monday-first weeks; days before the first Monday are week 00
    week = F.floor((F.dayofyear("ts") + 6 - F.weekday("ts")) / 7)
    label = F.format_string("%d-W%02d", F.year("ts"), week)
    return events(spark, sf).groupBy(label.alias("week")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query(f"WITH {FACTS_SQL} SELECT fact_id, round(1.0 + 0.2 * (greatest(0.1, 1.0 - date_diff('day', created_on, DATE '2025-01-01') / 365.0::DOUBLE) - 0.5), 6) AS boost FROM facts")
def recency_boost(spark, sf):
    age = F.datediff(F.lit("2025-01-01").cast("date"), F.col("created_on"))
    return facts(spark, sf).select("fact_id", F.round(V.recency_boost(age), 6).alias("boost"))


@query(f"""WITH {VEC_SQL}, s AS (SELECT q.fact_id AS query_id, x.fact_id, round({COS}(q.v, x.v), 9) AS s FROM vec q, vec x WHERE q.fact_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, fact_id) AS rank FROM s)
SELECT query_id, fact_id, round(s, 6) AS score, rank FROM r WHERE rank <= 10""")
def cosine_topk(spark, sf):
    v = stored(spark, sf)
    q = v.where("fact_id % 20 = 0").select(F.col("fact_id").alias("query_id"), "v")
    return Q.nearest(q, v, 10).select("query_id", "fact_id", F.round(F.round("score", 9), 6).alias("score"), F.col("rank").cast("long").alias("rank"))


FISHER_SQL = f"""{VEC_SQL}, m AS (SELECT fact_id, list_transform(v, lambda x: x / n) AS m FROM (SELECT fact_id, v, {_norm('v')} AS n FROM vec)),
f AS (SELECT fact_id, m, list_transform(m, lambda x: greatest(0.05::DOUBLE, least(2.0::DOUBLE, 2.0::DOUBLE - 1.95::DOUBLE * abs(x) / t))) AS s FROM (SELECT *, list_max(list_transform(m, lambda x: abs(x))) AS t FROM m))"""


def _fisher(spark, sf):
    return vectors(spark, sf).select("fact_id", V.fisher_mean(F.col("v")).alias("m"), V.fisher_variance(F.col("v")).alias("s"))


@query(f"WITH {FISHER_SQL} SELECT fact_id, round(list_avg(s), 6) AS mean_variance, round(list_max(s), 6) AS most, round(list_sum(m), 6) AS total FROM f")
def fisher_params(spark, sf):
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
    return _fisher(spark, sf).select("fact_id", F.round(add(F.col("s")) / F.size("s"), 6).alias("mean_variance"), F.round(F.array_max("s"), 6).alias("most"), F.round(add(F.col("m")), 6).alias("total"))


@query(f"""WITH {FISHER_SQL} SELECT a.fact_id AS a, b.fact_id AS b, round(sqrt(list_sum(list_transform(list_zip(list_zip(a.m, a.s), list_zip(b.m, b.s)), lambda z:
  2.0 * power(acosh(1.0 + (power(z[1][1] - z[2][1], 2) + 2.0 * power(z[1][2] - z[2][2], 2)) / (4.0 * z[1][2] * z[2][2])), 2)))), 4) AS distance FROM f a JOIN f b ON b.fact_id = a.fact_id + 1""")
def fisher_rao_neighbours(spark, sf):
    f = _fisher(spark, sf)
    b = f.select((F.col("fact_id") - 1).alias("fact_id"), F.col("fact_id").alias("b"), F.col("m").alias("mb"), F.col("s").alias("sb"))
    return f.join(b, "fact_id").select(F.col("fact_id").alias("a"), "b", F.round(V.fisher_rao_distance(F.col("m"), F.col("s"), F.col("mb"), F.col("sb")), 4).alias("distance"))


@query(f"""WITH {FISHER_SQL} SELECT a.fact_id AS a, b.fact_id AS b, round(exp(-list_sum(list_transform(list_zip(list_zip(a.m, b.m), b.s), lambda z: power(z[1][1] - z[1][2], 2) / greatest(z[2], 1e-6))) / 15.0), 6) AS similarity FROM f a JOIN f b ON b.fact_id = a.fact_id + 7""")
def fisher_similarity(spark, sf):
    f = _fisher(spark, sf)
    b = f.select((F.col("fact_id") - 7).alias("fact_id"), F.col("fact_id").alias("b"), F.col("m").alias("mb"), F.col("s").alias("sb"))
    return f.join(b, "fact_id").select(F.col("fact_id").alias("a"), "b", F.round(V.fisher_similarity(F.col("m"), F.col("mb"), F.col("sb")), 6).alias("similarity"))


@query(f"""WITH {FISHER_SQL} SELECT a.fact_id AS a, round(list_sum(list_transform(list_zip(a.s, b.s), lambda z: greatest(0.05, least(2.0, 1.0 / (1.0 / z[1] + 1.0 / z[2]))))), 6) AS total,
  round(list_sum(list_transform(a.s, lambda x: greatest(0.05, least(10.0, x * sqrt(32.0::DOUBLE / 4))))), 6) AS quantized FROM f a JOIN f b ON b.fact_id = a.fact_id + 1""")
def bayes_variance(spark, sf):
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
    f = _fisher(spark, sf).select("fact_id", "s")
    b = f.select((F.col("fact_id") - 1).alias("fact_id"), F.col("s").alias("sb"))
    return f.join(b, "fact_id").select(F.col("fact_id").alias("a"), F.round(add(V.bayes_variance(F.col("s"), F.col("sb"))), 6).alias("total"), F.round(add(V.quantized_variance(F.col("s"), 4)), 6).alias("quantized"))


STRENGTH = "greatest(0.1, least(100.0, 2.0 * ln(1 + access_count) + 1.5 * importance + 1.0 * (fact_id % 3) + 0.5 * confidence))"


@query(f"""WITH {FACTS_SQL}, s AS (SELECT fact_id, CAST(fact_id % 97 AS DOUBLE) - 2 AS h, confidence AS tau, {STRENGTH} AS s FROM facts), r AS (SELECT *, CASE WHEN h < 0 THEN 1.0 ELSE exp(-h / greatest(s, 0.1)) END AS r FROM s)
SELECT fact_id, round(s, 6) AS strength, round(r, 6) AS retention, CASE WHEN h < 0 THEN 1.0 ELSE round(exp(-h * (1.0 / greatest(s, 0.1)) * (1.0 + 2.0 * (1.0 - tau))), 6) END AS trusted,
  CASE WHEN r > 0.8 THEN 'active' WHEN r > 0.5 THEN 'warm' WHEN r > 0.2 THEN 'cold' WHEN r > 0.05 THEN 'archive' ELSE 'forgotten' END AS zone, round(s + ln(1 + greatest(h, 0.0) / 24.0), 6) AS reviewed FROM r""")
def retention_curves(spark, sf):
    h = (F.col("fact_id") % 97).cast("double") - 2
    s = V.memory_strength(F.col("access_count"), F.col("importance"), F.col("fact_id") % 3, F.col("confidence"))
    r = V.retention(h, s)
    return facts(spark, sf).select(
        "fact_id", F.round(s, 6).alias("strength"), F.round(r, 6).alias("retention"), F.round(V.trusted_retention(h, s, F.col("confidence")), 6).alias("trusted"), V.zone(r).alias("zone"),
        F.round(V.spaced_repetition(s, F.greatest(h, F.lit(0.0))), 6).alias("reviewed"),
    )


@query(f"""WITH {FISHER_SQL}, c AS (SELECT f.fact_id, list_avg(s) AS mv, CAST(f.fact_id % 20 AS DOUBLE) AS acc, CAST(f.fact_id % 400 AS DOUBLE) AS age FROM f)
SELECT fact_id, round(0.3 / (1.0 / (1.0 + mv) + least(0.2, acc * 0.02) + 0.1), 6) AS temperature, round(least(0.9405, sqrt(0.3 * 8 / (2.0 * (3.0 + 0.08 * ln(1 + acc) - 0.005 * least(age, 365.0) / 365.0 + 0.5 * 0.5)))), 6) AS radius FROM c""")
def coupling_state(spark, sf):
    f = _fisher(spark, sf)
    mv = F.aggregate("s", F.lit(0.0), lambda x, y: x + y) / F.size("s")
    acc, age = (F.col("fact_id") % 20).cast("double"), (F.col("fact_id") % 400).cast("double")
    return f.select("fact_id", F.round(V.effective_temperature(mv, acc), 6).alias("temperature"), F.round(V.equilibrium_radius(acc, age, F.lit(0.5)), 6).alias("radius"))


@query(f"""WITH {VEC_SQL}, p AS (SELECT fact_id AS b, v AS w, lag(fact_id) OVER o AS a, lag(v) OVER o AS u FROM vec WINDOW o AS (PARTITION BY community ORDER BY fact_id))
SELECT a, b, round(sqrt(list_sum(list_transform(list_zip(u, w), lambda z: power(z[2] - z[1], 2)))) / ({_norm('u')} + {_norm('w')} + 1e-12), 6) AS disagreement FROM p WHERE a IS NOT NULL""")
def sheaf_contradictions(spark, sf):
    """Each fact against the one before it in its community."""
    from pyspark.sql import Window

    o = Window.partitionBy("community").orderBy("fact_id")
    pairs = vectors(spark, sf).select(F.lag("fact_id").over(o).alias("a"), F.col("fact_id").alias("b"), F.lag("v").over(o).alias("u"), F.col("v").alias("w")).where("a IS NOT NULL")
    return pairs.select("a", "b", F.round(V.coboundary(F.col("u"), F.col("w")), 6).alias("disagreement"))


@query(f"""WITH {VEC_SQL}, z AS (SELECT q.fact_id AS query_id, x.fact_id, list_dot_product(q.v, x.v) / sqrt(64.0::DOUBLE) AS z FROM vec q, vec x WHERE q.fact_id % 20 = 0), e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY query_id)) AS e FROM z),
s AS (SELECT query_id, fact_id, e / sum(e) OVER (PARTITION BY query_id) AS s FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, fact_id) AS rank FROM s)
SELECT query_id, fact_id, round(s, 6) AS attention, rank FROM r WHERE rank <= 5""")
def hopfield_topk(spark, sf):
    v = stored(spark, sf)
    q = v.where("fact_id % 20 = 0").select(F.col("fact_id").alias("query_id"), "v")
    return Q.hopfield(q, v, 64.0**-0.5, 5).select("query_id", "fact_id", F.round("score", 6).alias("attention"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {FACTS_SQL} SELECT fact_id, CAST(CASE WHEN r > 0.8 THEN 32 WHEN r > 0.5 THEN 8 WHEN r > 0.2 THEN 4 WHEN r > 0.05 THEN 2 ELSE 0 END AS BIGINT) AS by_retention,
  CAST(CASE WHEN 2 + 30 * c <= 2 THEN 2 WHEN 2 + 30 * c <= 4 THEN 4 WHEN 2 + 30 * c <= 8 THEN 8 ELSE 32 END AS BIGINT) AS by_centrality FROM (SELECT fact_id, importance AS r, (fact_id % 30) / 100.0::DOUBLE AS c FROM facts)""")
def precision_bits(spark, sf):
    c = (F.col("fact_id") % 30) / F.lit(100.0)
    return facts(spark, sf).select("fact_id", V.precision_bits(F.col("importance")).cast("long").alias("by_retention"), V.centrality_bits(c).cast("long").alias("by_centrality"))


@query("""SELECT event_id, round(greatest(0.0, least(1.0, 0.5 + 0.4 * (event_type = 'click')::INT + 0.25 * (event_type = 'purchase')::INT + least(0.15, value / 60.0 * 0.15) - 0.5 * (event_type = 'error')::INT)), 6) AS reward FROM events""")
def reward_labels(spark, sf):
    is_ = lambda k: (F.col("event_type") == k).cast("int")
    return events(spark, sf).select("event_id", F.round(V.reward_label(is_("click"), is_("purchase"), F.col("value"), is_("error")), 6).alias("reward"))


@query("""SELECT l.doc_id, CAST(CASE WHEN r IS NULL THEN CASE WHEN p = 0 THEN 4 WHEN p <= 2 THEN 3 WHEN p <= 4 THEN 2 WHEN p <= 9 THEN 1 ELSE 0 END WHEN r >= 0.9 THEN 4 WHEN r >= 0.6 THEN 3 WHEN r >= 0.3 THEN 2 WHEN r > 0 THEN 1 ELSE 0 END AS BIGINT) AS grade
FROM (SELECT doc_id, doc_id % 12 AS p, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 11) / 10.0::DOUBLE END AS r FROM labels) l""")
def relevance_grades(spark, sf):
    d = F.col("doc_id")
    r = F.when(d % 3 != 0, (d % 11) / F.lit(10.0))
    return table(spark, sf, "labels").select("doc_id", V.relevance_grade(r, d % 12).cast("long").alias("grade"))


@query("""WITH t AS (SELECT user_id, date_diff('microsecond', ts, TIMESTAMP '2024-02-01') / 3600000000.0::DOUBLE AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events)
SELECT user_id, round(1.0 / (1.0 + exp(-ln(sum(power(greatest(h, 0.01), -0.5))))), 6) AS base_level FROM t WHERE n <= 100 GROUP BY user_id""")
def act_r_base_level(spark, sf):
    from engramlake.operators import relational as R

    e = events(spark, sf).withColumn("h", (F.lit(1706745600000000) - F.unix_micros("ts")) / 3600000000.0)
    last = R.top_per_group(e, "user_id", [F.col("ts").desc(), F.col("event_id")], 100)
    return last.groupBy("user_id").agg(F.round(1 / (1 + F.exp(-F.log(F.sum(F.pow(F.greatest("h", F.lit(0.01)), F.lit(-0.5)))))), 6).alias("base_level"))
