"""Joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramlake.functions import text as T
from engramlake.functions import vectors as V
from engramlake.operators import relational as R
from engramlake.plans.registry import query
from engramlake.plans.text_queries import STOP, TOKENS_ALL_SQL, VALID_SQL
from engramlake.sources.tables import FACTS_SQL, PART_EDGES_SQL, events, facts, part_edges, table, validity

# ---- joins ---------------------------------------------------------------------


@query(f"""WITH {FACTS_SQL} SELECT f.fact_id, f.access_count, CAST(coalesce(l.quality, 0) AS BIGINT) AS quality, coalesce(l.toxic, -1)::BIGINT AS toxic FROM facts f LEFT JOIN labels l ON f.fact_id = l.doc_id WHERE f.fact_id NOT IN (SELECT item_id * 5 FROM benchmark)""")
def facts_with_metadata(spark, sf):
    core = table(spark, sf, "benchmark").select((F.col("item_id") * 5).alias("fact_id"))
    lab = table(spark, sf, "labels").withColumnRenamed("doc_id", "fact_id")
    f = facts(spark, sf).join(lab, "fact_id", "left").join(core, "fact_id", "left_anti")
    return f.select("fact_id", "access_count", F.coalesce("quality", F.lit(0)).cast("long").alias("quality"), F.coalesce("toxic", F.lit(-1)).cast("long").alias("toxic"))


@query("SELECT o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) >= 3")
def entities_across_sessions(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    o = table(spark, sf, "orders").join(returned, "o_orderkey", "left_semi")
    return o.groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n")).where("n >= 3").select("o_custkey")


@query(f"WITH {PART_EDGES_SQL} SELECT e1.src, count(*) AS paths, count(DISTINCT e2.dst) AS reached, round(max(e1.weight), 6) AS weight FROM edges e1 JOIN edges e2 ON e1.dst = e2.src WHERE e1.src <> e2.dst GROUP BY 1")
def two_hop_paths(spark, sf):
    e = part_edges(spark, sf)
    n = table(spark, sf, "lineitem").count()
    ends = R.dealt(R.two_hop(e, n), 4 * n, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("n"), F.max("weight").alias("w"))  # a path is some twenty an edge
    return ends.groupBy("src").agg(F.sum("n").alias("paths"), F.count("*").alias("reached"), F.round(F.max("w"), 6).alias("weight"))


@query("""SELECT a.event_id AS play, count(*) AS hits FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'view' AND b.event_type IN ('click', 'purchase') GROUP BY a.event_id""")
def evidence_window(spark, sf):
    e = events(spark, sf)
    a = e.where("event_type = 'view'").select(F.col("event_id").alias("play"), "user_id", F.col("ts").alias("at"))
    b = e.where("event_type IN ('click', 'purchase')").select("user_id", F.col("ts").alias("later"))
    return R.within(a, b, ["user_id"], "at", "later", 6 * 3600).groupBy("play").agg(F.count("*").alias("hits"))


@query("""SELECT p.event_id, p.user_id, (SELECT v.event_id FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS last_view FROM events p WHERE p.event_type = 'purchase'""")
def as_of_recall(spark, sf):
    e = events(spark, sf)
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view"))
    return R.as_of(left, right, "user_id", "ts", "view").select("event_id", "user_id", F.col("last_view"))


@query("""WITH s AS (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2""")
def co_retrieval(spark, sf):
    s = table(spark, sf, "lineitem").join(table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").select("o_custkey", "l_suppkey").distinct()
    return R.co_occurrences(s, "o_custkey", "l_suppkey", rows=table(spark, sf, "lineitem").count())


@query("""SELECT c.c_custkey, n.n_name FROM customer c JOIN (SELECT lower(n_name) AS alias, n_name, n_nationkey FROM nation) n ON lower('NATION_' || c.c_nationkey) = n.alias""")
def alias_lookup(spark, sf):
    n = table(spark, sf, "nation").select(F.lower("n_name").alias("alias"), "n_name")
    c = table(spark, sf, "customer").select("c_custkey", F.lower(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).alias("alias"))
    return c.join(n, "alias").select("c_custkey", "n_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10)")
def stale_links(spark, sf):
    live = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(live, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH p AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b, abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) AS days FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey)
SELECT a, b, round(exp(-days / 30.0::DOUBLE), 6) AS weight FROM p WHERE days <= 90""")
def temporal_edges(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    # within 90 days: dealt by customer and 90-day bucket, one side also to its neighbours
    a = o.select("o_custkey", F.col("o_orderkey").alias("a"), F.col("day").alias("da")).withColumn("b0", F.floor(F.unix_date("da") / 90)).withColumn("bucket", F.explode(F.array(F.col("b0") - 1, F.col("b0"), F.col("b0") + 1)))
    b = o.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("day").alias("db")).withColumn("bucket", F.floor(F.unix_date("db") / 90))
    days = F.abs(F.datediff("da", "db"))
    return a.join(b, ["o_custkey", "bucket"]).where((F.col("a") < F.col("b")) & (days <= 90)).select("a", "b", F.round(F.exp(-days / 30.0), 6).alias("weight"))


# ---- aggregates ----------------------------------------------------------------

KINDS = ("click", "view", "purchase", "signup", "error")


@query(f"""SELECT user_id, {', '.join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in KINDS)}, count(DISTINCT CAST(ts AS DATE)) AS active_days, round(count(*) / (count(*) + 20.0::DOUBLE), 6) AS score FROM events GROUP BY user_id""")
def engagement_stats(spark, sf):
    e = events(spark, sf)
    more = e.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in KINDS], F.count_distinct(F.to_date("ts")).alias("active_days"), F.count("*").alias("n"))
    return more.withColumn("score", F.round(F.col("n") / (F.col("n") + 20.0), 6)).drop("n")


@query("""SELECT user_id, CASE WHEN n >= 10 THEN 'active' WHEN n >= 3 THEN 'warm' WHEN n >= 1 THEN 'cold' ELSE 'inactive' END AS health FROM (SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-30') AS n FROM events GROUP BY user_id)""")
def health_bands(spark, sf):
    n = events(spark, sf).groupBy("user_id").agg(F.count_if((F.col("ts") >= "2024-01-23") & (F.col("ts") < "2024-01-30")).alias("n"))
    return n.select("user_id", F.when(F.col("n") >= 10, "active").when(F.col("n") >= 3, "warm").when(F.col("n") >= 1, "cold").otherwise("inactive").alias("health"))


@query("SELECT event_type, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 4) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def type_distribution(spark, sf):
    return R.share_of_total(events(spark, sf), "event_type")


@query(f"""WITH {FACTS_SQL}, c AS (SELECT profile_id, session_id, confidence - 0.1 * (fact_id % 3) AS c, fact_type FROM facts)
SELECT profile_id, session_id, round(1 - exp(sum(ln(1 - least(c, 0.999999)))), 6) AS confidence, count(*) AS evidence FROM c GROUP BY 1, 2""")
def noisy_or_patterns(spark, sf):
    c = facts(spark, sf).withColumn("c", F.col("confidence") - F.lit(0.1) * (F.col("fact_id") % 3))
    return R.noisy_or(c, ["profile_id", "session_id"], "fact_type", "c").drop("best")


@query("SELECT l_suppkey, round((1.0 + count(*) FILTER (l_returnflag = 'N')) / (2.0 + count(*) FILTER (l_returnflag IN ('N', 'R'))), 6) AS quality FROM lineitem GROUP BY l_suppkey")
def source_quality(spark, sf):
    good, bad = F.count_if(F.col("l_returnflag") == "N"), F.count_if(F.col("l_returnflag") == "R")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(V.beta_mean(good, bad), 6).alias("quality"))


@query("""SELECT user_id, round((count(*) FILTER (event_type = 'purchase') + 0.5 * count(*) FILTER (event_type = 'click')) / CAST(count(*) AS DOUBLE), 6) AS rate, round(avg(value), 6) AS mean FROM events GROUP BY user_id HAVING count(*) >= 5""")
def outcome_rates(spark, sf):
    n = F.count("*")
    out = events(spark, sf).groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("good"), F.count_if(F.col("event_type") == "click").alias("part"), n.alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return out.where("n >= 5").select("user_id", F.round((F.col("good") + 0.5 * F.col("part")) / F.col("n"), 6).alias("rate"), "mean")


@query("""SELECT coalesce(event_type, 'all') AS event_type, coalesce(CAST(hour(ts) AS BIGINT), -1) AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ROLLUP (event_type, hour(ts))""")
def event_rollup(spark, sf):
    out = events(spark, sf).rollup("event_type", F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("hour", F.lit(-1)).alias("hour"), "n", "total")


@query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, day, n FROM (SELECT *, avg(n) OVER (PARTITION BY user_id) AS m FROM s) WHERE n > 1.5 * m""")
def busy_sessions(spark, sf):
    s = events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return s.withColumn("m", F.avg("n").over(Window.partitionBy("user_id"))).where(F.col("n") > 1.5 * F.col("m")).select("user_id", "day", "n")


@query(f"WITH {FACTS_SQL}, c AS (SELECT session_id, fact_type, count(*) AS n FROM facts GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, fact_type) AS k, sum(n) OVER (PARTITION BY session_id) AS t FROM c) SELECT session_id, fact_type AS dominant, round(n / CAST(t AS DOUBLE), 6) AS share FROM r WHERE k = 1")
def dominant_types(spark, sf):
    c = facts(spark, sf).groupBy("session_id", "fact_type").agg(F.count("*").alias("n"))
    best = c.withColumn("t", F.sum("n").over(Window.partitionBy("session_id")))
    return R.top_per_group(best, "session_id", [F.col("n").desc(), F.col("fact_type")], 1).select("session_id", F.col("fact_type").alias("dominant"), F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query(f"""WITH w AS (SELECT source, doc_id, unnest({TOKENS_ALL_SQL}) AS term FROM documents), t AS (SELECT source, term, count(*) AS tf FROM w WHERE term NOT IN ({STOP}) AND length(term) >= 5 GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(DISTINCT source) AS n FROM documents), r AS (SELECT source, term, tf * ln(1 + n / CAST(1 + df AS DOUBLE)) AS s FROM t JOIN d USING (term), n),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(s, 6) DESC, term) AS k FROM r) SELECT source, term, round(s, 4) AS score, k AS rank FROM k WHERE k <= 3""")
def community_labels(spark, sf):
    d = table(spark, sf, "documents")
    terms = d.select("source", F.explode(F.filter(T.tokenize(F.col("text")), lambda w: F.length(w) >= 5)).alias("term")).groupBy("source", "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    n = d.agg(F.count_distinct("source").alias("n"))  # one row
    scored = terms.join(df, "term").crossJoin(F.broadcast(n)).withColumn("s", F.col("tf") * F.log(1 + F.col("n") / (1 + F.col("df"))))
    top = R.top_per_group(scored, "source", [F.round("s", 6).desc(), F.col("term")], 3)
    return top.select("source", "term", F.round("s", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT o_custkey, max_by(o_orderpriority, struct_pack(a := n, b := o_orderpriority)) AS preferred, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS confidence FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY o_custkey""")
def profile_preferences(spark, sf):
    c = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return c.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("n", "o_orderpriority")).alias("preferred"), F.round(F.max("n") / F.sum("n"), 6).alias("confidence"))


@query("""SELECT c_mktsegment, round(sum(c_acctbal * exp(-a / 365.0::DOUBLE)) / sum(exp(-a / 365.0::DOUBLE)), 4) AS merged FROM (SELECT c_mktsegment, c_acctbal, CAST(c_custkey % 700 AS DOUBLE) AS a FROM customer) GROUP BY c_mktsegment""")
def decay_weighted_merge(spark, sf):
    w = F.exp(-(F.col("c_custkey") % 700) / 365.0)
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.round(F.sum(F.col("c_acctbal") * w) / F.sum(w), 4).alias("merged"))


@query("""SELECT l_suppkey, avg_price, n FROM (SELECT l_suppkey, round(avg(l_extendedprice), 2) AS avg_price, count(*) AS n, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY l_suppkey) WHERE p >= 2 AND n >= 3""")
def promoted_assertions(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_extendedprice"), 2).alias("avg_price"), F.count("*").alias("n"), F.count_distinct("l_partkey").alias("p")).where("p >= 2 AND n >= 3").drop("p")


# ---- windows -------------------------------------------------------------------


@query("""WITH x AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), c AS (SELECT a, b, count(*) AS n FROM x WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2), s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) AS share FROM c)
SELECT a, b, n, round(share, 6) AS share FROM s WHERE n >= 3 AND share >= 0.05""")
def tool_transitions(spark, sf):
    return R.transitions(events(spark, sf).select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type", 3, 0.05)


@query("""WITH x AS (SELECT event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT a || '>' || b || '>' || c AS gram, count(*) AS n FROM x WHERE c IS NOT NULL AND a <> b AND b <> c GROUP BY 1""")
def activity_ngrams(spark, sf):
    return R.ngrams(events(spark, sf), "user_id", ["ts", "event_id"], "event_type", 3)


@query("""WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders), g AS (SELECT *, CASE WHEN date_diff('day', lag(day) OVER (PARTITION BY o_custkey ORDER BY day), day) > 60 THEN 1 ELSE 0 END AS f FROM d),
i AS (SELECT *, sum(f) OVER (PARTITION BY o_custkey ORDER BY day) AS island FROM g) SELECT o_custkey, CAST(island AS BIGINT) AS island, min(day) AS first, max(day) AS last, count(*) AS days FROM i GROUP BY 1, 2""")
def gap_clusters(spark, sf):
    d = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()
    w = Window.partitionBy("o_custkey").orderBy("day")
    rows = d.withColumn("f", F.when(F.datediff("day", F.lag("day").over(w)) > 60, 1).otherwise(0)).withColumn("island", F.sum("f").over(w))
    return rows.groupBy("o_custkey", F.col("island").cast("long").alias("island")).agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days"))


@query("""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations), c AS (SELECT conv_id, k AS chunk FROM t, range(0, 100) r(k) WHERE i >= k * 2 AND i < k * 2 + 3)
SELECT conv_id, chunk, count(*) AS turns FROM c GROUP BY 1, 2""")
def turn_chunks(spark, sf):
    return R.turn_chunks(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn", 3, 1)


@query("""SELECT conv_id, turn, length(a) + 1 + length(b) AS chars FROM (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE length(a) + 1 + length(b) <= 300""")
def adjacent_pairs(spark, sf):
    c = table(spark, sf, "conversations").withColumn("b", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.withColumn("chars", F.length("text") + 1 + F.length("b")).where("chars <= 300").select("conv_id", "turn", F.col("chars").cast("long").alias("chars"))


@query(f"WITH {FACTS_SQL}, r AS (SELECT fact_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, fact_id) AS rank FROM facts) SELECT fact_id, session_id, rank FROM r WHERE rank <= 5")
def per_group_cap(spark, sf):
    return R.top_per_group(facts(spark, sf).select("fact_id", "session_id", "importance"), "session_id", [F.col("importance").desc(), F.col("fact_id")], 5).select("fact_id", "session_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT min(doc_id) AS fact_id, count(*) AS copies FROM documents GROUP BY lower(trim(text)) HAVING count(*) > 1")
def exact_content_dedupe(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy(F.sha2(F.lower(F.trim("text")), 256).alias("k")).agg(F.min("doc_id").alias("fact_id"), F.count("*").alias("copies")).where("copies > 1").select("fact_id", "copies")


@query("""SELECT CAST(d AS DATE) AS day, coalesce(n, 0) AS n FROM range(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY) r(d) LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) c ON CAST(d AS DATE) = c.day""")
def dense_daily_series(spark, sf):
    return R.density(events(spark, sf).select("ts"), "ts", "2024-01-01", "2024-02-04")


@query("""WITH o AS (SELECT user_id, ts, event_id, event_type, count(*) FILTER (event_type IN ('purchase', 'click')) OVER w AS good, count(*) FILTER (event_type = 'error') OVER v AS bad FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), v AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
SELECT event_id, CASE WHEN bad > 0 THEN -1 WHEN good > 0 THEN 1 ELSE 0 END::BIGINT AS score FROM o WHERE event_type = 'view'""")
def trace_scores(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, sf).withColumn("good", F.count_if(F.col("event_type").isin("purchase", "click")).over(w.rowsBetween(1, 10))).withColumn("bad", F.count_if(F.col("event_type") == "error").over(w.rowsBetween(1, 3)))
    return e.where("event_type = 'view'").select("event_id", F.when(F.col("bad") > 0, -1).when(F.col("good") > 0, 1).otherwise(0).cast("long").alias("score"))


# ---- set operations ------------------------------------------------------------


@query(f"WITH {PART_EDGES_SQL} SELECT count(*) AS nodes FROM (SELECT src FROM edges UNION SELECT dst FROM edges)")
def distinct_nodes(spark, sf):
    e = part_edges(spark, sf)
    return e.select("src").union(e.select("dst")).distinct().agg(F.count("*").alias("nodes"))


@query("SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def arms_intersect(spark, sf):
    e = events(spark, sf)
    return e.where("event_type = 'error'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def unmapped_entities(spark, sf):
    used = table(spark, sf, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").select("p_partkey").distinct().join(used, "p_partkey", "left_anti")


@query(f"""WITH {VALID_SQL}, t AS (SELECT 'event' AS kind, ts AS moment, event_id AS id FROM events UNION ALL SELECT 'opened', valid_from, fact_id FROM validity UNION ALL SELECT 'closed', valid_until, fact_id FROM validity WHERE valid_until IS NOT NULL)
SELECT kind, moment, id FROM t ORDER BY moment DESC, kind, id LIMIT 50 OFFSET 10""")
def merged_timeline(spark, sf):
    v = validity(spark, sf)
    e = table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("ts").alias("moment"), F.col("event_id").alias("id"))
    opened = v.select(F.lit("opened").alias("kind"), F.col("valid_from").alias("moment"), F.col("fact_id").alias("id"))
    closed = v.where("valid_until IS NOT NULL").select(F.lit("closed").alias("kind"), F.col("valid_until").alias("moment"), F.col("fact_id").alias("id"))
    return e.unionByName(opened).unionByName(closed).orderBy(F.col("moment").desc(), "kind", "id").offset(10).limit(50)
