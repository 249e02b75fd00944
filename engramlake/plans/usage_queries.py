"""Statistics of use: access, rewards, trust, habits, queues and dashboards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramlake.functions import language as L
from engramlake.operators import relational as R
from engramlake.operators import store as S
from engramlake.plans.registry import query
from engramlake.sources.tables import FACTS_SQL, PART_EDGES_SQL, events, facts, part_edges, table


def _rank(df, by, order, name="rank"):
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


@query(f"WITH {FACTS_SQL} SELECT session_id, fact_id, row_number() OVER (PARTITION BY session_id ORDER BY confidence DESC, fact_id) AS rank FROM facts")
def facts_of_session(spark, sf):
    return _rank(facts(spark, sf), ["session_id"], [F.col("confidence").desc(), "fact_id"]).select("session_id", "fact_id", "rank")


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_name), c_custkey) AS rank FROM customer WHERE c_mktsegment = 'BUILDING'")
def entities_by_scope(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return _rank(c, ["c_nationkey"], [F.lower("c_name"), "c_custkey"]).select("c_nationkey", "c_custkey", "rank")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS rank FROM events WHERE event_type = 'purchase'")
def entity_timeline(spark, sf):
    e = events(spark, sf).where("event_type = 'purchase'")
    return _rank(e, ["user_id"], [F.col("ts").desc_nulls_last(), "event_id"]).select("user_id", "event_id", "rank")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate <= TIMESTAMP '1997-03-01' AND (l_shipdate IS NULL OR TIMESTAMP '1997-03-01' < l_shipdate)")
def known_at(spark, sf):
    o = table(spark, sf, "orders").where("o_orderdate <= TIMESTAMP'1997-03-01 00:00:00'").select("o_orderkey")
    li = table(spark, sf, "lineitem").where("l_shipdate IS NULL OR TIMESTAMP'1997-03-01 00:00:00' < l_shipdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber")


_TRUST_SQL = "trust AS (SELECT user_id, (1 + count(*) FILTER (event_type = 'purchase')) / (2.0::DOUBLE + count(*) FILTER (event_type IN ('purchase', 'error', 'view'))) AS trust FROM events GROUP BY user_id)"


def _trust(spark, sf):
    good, seen = F.count_if(F.expr("event_type = 'purchase'")), F.count_if(F.expr("event_type IN ('purchase', 'error', 'view')"))
    return events(spark, sf).groupBy("user_id").agg(((good + 1) / (seen + F.lit(2.0))).alias("trust"))


@query(f"WITH {_TRUST_SQL} SELECT user_id, TRUE AS may_read, trust >= 0.3 AS may_write, trust >= 0.5 AS may_delete FROM trust")
def access_gate(spark, sf):
    return _trust(spark, sf).select("user_id", F.lit(True).alias("may_read"), (F.col("trust") >= 0.3).alias("may_write"), (F.col("trust") >= 0.5).alias("may_delete"))


@query(f"WITH {_TRUST_SQL} SELECT CASE WHEN trust >= 0.7 THEN 'high' WHEN trust >= 0.4 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, round(avg(trust), 3) AS mean FROM trust GROUP BY 1")
def trust_buckets(spark, sf):
    band = F.when(F.col("trust") >= 0.7, "high").when(F.col("trust") >= 0.4, "medium").otherwise("low")
    return _trust(spark, sf).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("trust"), 3).alias("mean"))


@query("SELECT DISTINCT p_type AS domain, p_brand FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 40)")
def domain_tags(spark, sf):
    p = table(spark, sf, "part")
    return p.join(p.where("p_size > 40").select("p_name").distinct(), "p_name", "left_semi").select(F.col("p_type").alias("domain"), "p_brand").distinct()


_LAST = "TIMESTAMP '2024-01-30'"


@query(f"SELECT user_id, avg(value) AS reward FROM events WHERE ts >= {_LAST} - INTERVAL 10 DAY AND ts <= {_LAST} GROUP BY user_id HAVING avg(value) >= 50".replace("avg(value) AS reward", "round(avg(value), 6) AS reward"))
def high_reward_filter(spark, sf):
    e = events(spark, sf).where("ts BETWEEN TIMESTAMP'2024-01-20 00:00:00' AND TIMESTAMP'2024-01-30 00:00:00'")
    return e.groupBy("user_id").agg(F.avg("value").alias("r")).where("r >= 50").select("user_id", F.round("r", 6).alias("reward"))


@query(f"WITH {FACTS_SQL} SELECT fact_id FROM facts f WHERE access_count < 3 AND (fact_id % 6 = 3 OR (fact_id % 6 = 2 AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = f.fact_id AND e.event_type = 'purchase' AND e.ts >= {_LAST} - INTERVAL 20 DAY)))")
def being_forgotten_filter(spark, sf):
    rewarded = events(spark, sf).where("event_type = 'purchase' AND ts >= TIMESTAMP'2024-01-10 00:00:00'").select(F.col("user_id").alias("fact_id")).distinct()
    low = facts(spark, sf).where("access_count < 3").select("fact_id")
    return low.where("fact_id % 6 = 3").unionByName(low.where("fact_id % 6 = 2").join(rewarded, "fact_id", "left_anti"))


@query("""SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS DOUBLE) / 100 >= 0.5 THEN 'temporal' WHEN CAST(json_extract(props, '$.k') AS DOUBLE) / 100 >= 0.25 THEN 'multi_hop' ELSE 'open_domain' END AS kind FROM events""")
def json_case_projection(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double") / 100
    return events(spark, sf).select("event_id", F.when(k >= 0.5, "temporal").when(k >= 0.25, "multi_hop").otherwise("open_domain").alias("kind"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 0 ELSE len(string_split(CAST(event_id AS VARCHAR), '1')) END AS n FROM events""".replace("len(", "CAST(len(").replace("'1')) END", "'1')) AS INTEGER) END"))
def json_list_codec(spark, sf):
    """Lists kept as JSON: empty and null texts are empty lists."""
    raw = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.lit(None)).otherwise(F.to_json(F.split(F.col("event_id").cast("string"), "1", -1)))
    e = events(spark, sf).select("event_id", raw.alias("raw"))
    return e.select("event_id", F.size(F.coalesce(F.from_json(F.nullif("raw", F.lit("")), "array<string>"), F.array().cast("array<string>"))).alias("n"))


@query(f"WITH {FACTS_SQL} SELECT fact_id FROM facts WHERE access_count < 8 AND confidence < 0.8 AND fact_id NOT IN (SELECT unnest([o_orderkey, o_custkey]) FROM orders WHERE o_orderstatus = 'F')")
def not_in_blocks(spark, sf):
    ids = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.explode(F.array("o_orderkey", "o_custkey")).alias("fact_id")).distinct()
    return facts(spark, sf).where("access_count < 8 AND confidence < 0.8").select("fact_id").join(ids, "fact_id", "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE list_contains([o_custkey, o_custkey + 1], c_custkey) AND o_totalprice > 300000 AND o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 60 DAY)")
def exists_in_outcomes(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 300000 AND o_orderdate >= TIMESTAMP'1998-04-02 00:00:00'").select(F.explode(F.array("o_custkey", F.col("o_custkey") + 1)).alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query(f"WITH {PART_EDGES_SQL} SELECT src, dst, a.p_name AS src_name, b.p_name AS dst_name FROM edges LEFT JOIN part a ON a.p_partkey = src AND a.p_size > 5 LEFT JOIN part b ON b.p_partkey = dst AND b.p_size > 5")
def edges_with_contents(spark, sf):
    p = table(spark, sf, "part").where("p_size > 5")
    a, b = (p.select(F.col("p_partkey").alias(k), F.col("p_name").alias(f"{k}_name")) for k in ("src", "dst"))
    return part_edges(spark, sf).drop("weight").join(a, "src", "left").join(b, "dst", "left").select("src", "dst", "src_name", "dst_name")


@query("""WITH m AS (SELECT event_id, user_id AS sender, CASE event_id % 4 WHEN 0 THEN user_id + 1 END AS peer, CASE event_id % 4 WHEN 1 THEN 'all' END AS broadcast, CASE WHEN event_id % 4 = 2 THEN user_id % 3 END AS project FROM events WHERE event_type <> 'error'),
i AS (SELECT DISTINCT n_nationkey AS peer, event_id FROM nation JOIN m ON m.peer = n_nationkey OR broadcast = 'all' OR project = n_regionkey) SELECT CAST(i.peer AS BIGINT) AS peer, count(*) AS n, count(*) FILTER (r.event_id IS NULL) AS unread FROM i LEFT JOIN (SELECT DISTINCT event_id, user_id % 25 AS peer FROM events WHERE event_id % 3 = 0) r ON r.event_id = i.event_id AND r.peer = i.peer GROUP BY 1""")
def inbox(spark, sf):
    """Direct, broadcast and project messages of each peer, and how many are unread."""
    m = events(spark, sf).where("event_type <> 'error'")
    peers = F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("peer"), "n_regionkey"))  # a list of peers
    direct = m.where("event_id % 4 = 0").select((F.col("user_id") + 1).alias("peer"), "event_id").join(peers.select("peer"), "peer")
    project = m.where("event_id % 4 = 2").select((F.col("user_id") % 3).alias("n_regionkey"), "event_id").join(peers, "n_regionkey").select("peer", "event_id")
    everyone = m.where("event_id % 4 = 1").select("event_id").crossJoin(peers.select("peer")).select("peer", "event_id")
    got = direct.unionByName(project).unionByName(everyone).distinct()
    read = events(spark, sf).where("event_id % 3 = 0").select("event_id", (F.col("user_id") % 25).alias("peer"), F.lit(True).alias("read")).distinct()
    return got.join(read, ["peer", "event_id"], "left").groupBy("peer").agg(F.count("*").alias("n"), F.count_if(F.col("read").isNull()).alias("unread"))


@query("""WITH o AS (SELECT l_partkey, l_suppkey, CASE l_returnflag WHEN 'N' THEN 1.0 WHEN 'A' THEN 0.5 ELSE 0.0 END AS reward FROM lineitem)
SELECT l_partkey, count(*) AS n, round(avg(CAST(reward AS DOUBLE)), 6) AS mean FROM o GROUP BY 1""")
def reward_by_fact(spark, sf):
    return _rewards(spark, sf)


def _rewards(spark, sf):
    reward = F.when(F.col("l_returnflag") == "N", 1.0).when(F.col("l_returnflag") == "A", 0.5).otherwise(0.0)
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.avg(reward), 6).alias("mean"))


_REWARDS_SQL = "r AS (SELECT l_partkey, count(*) AS n, round(avg(CASE l_returnflag WHEN 'N' THEN 1.0::DOUBLE WHEN 'A' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS mean FROM lineitem GROUP BY 1)"


@query(f"WITH {_REWARDS_SQL} SELECT l_partkey FROM r JOIN part ON p_partkey = l_partkey WHERE mean >= 0.6 AND n >= 1 AND p_size > 3")
def high_reward_set(spark, sf):
    live = table(spark, sf, "part").where("p_size > 3").select(F.col("p_partkey").alias("l_partkey"))
    return _rewards(spark, sf).where("mean >= 0.6 AND n >= 1").select("l_partkey").join(live, "l_partkey", "left_semi")


@query(f"WITH {_REWARDS_SQL} SELECT p_partkey, coalesce(round((s + 0.0) / n2, 6), 0.5) AS rate FROM part LEFT JOIN (SELECT l_partkey, CAST(count(*) FILTER (l_returnflag = 'N') AS DOUBLE) AS s, count(*) AS n2 FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) x ON x.l_partkey = p_partkey")
def fact_success_rate(spark, sf):
    o = table(spark, sf, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.count_if(F.col("l_returnflag") == "N") / F.count("*"), 6).alias("rate"))
    return table(spark, sf, "part").select("p_partkey").join(o, "p_partkey", "left").select("p_partkey", F.coalesce("rate", F.lit(0.5)).alias("rate"))


@query(f"WITH {_REWARDS_SQL} SELECT l_partkey, least((l_partkey % 10) / 20.0::DOUBLE + 0.1::DOUBLE, 0.5::DOUBLE) AS prior FROM r WHERE n >= 3 AND mean > 0.6".replace("least(", "round(least(").replace("0.5::DOUBLE) AS", "0.5::DOUBLE), 6) AS"))
def strong_memory_boost(spark, sf):
    return _rewards(spark, sf).where("n >= 3 AND mean > 0.6").select("l_partkey", F.round(F.least((F.col("l_partkey") % 10) / 20.0 + 0.1, F.lit(0.5)), 6).alias("prior"))


@query(f"WITH {_REWARDS_SQL} SELECT p_partkey FROM part WHERE p_retailprice < 1000 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'N' AND l_shipdate >= TIMESTAMP '1998-01-01' - INTERVAL 60 DAY)")
def reward_gated_archive(spark, sf):
    kept = table(spark, sf, "lineitem").where("l_returnflag = 'N' AND l_shipdate >= TIMESTAMP'1997-11-02 00:00:00'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(spark, sf, "part").where("p_retailprice < 1000").select("p_partkey").join(kept, "p_partkey", "left_anti")


@query(f"WITH {FACTS_SQL} SELECT fact_id, round(greatest(0.1::DOUBLE, confidence - 0.001::DOUBLE), 6) AS confidence FROM facts WHERE access_count = 0 AND created_on < DATE '2024-12-01' - 7")
def confidence_decay(spark, sf):
    f = facts(spark, sf).where("access_count = 0 AND created_on < DATE'2024-11-24'")
    return f.select("fact_id", F.round(F.greatest(F.lit(0.1), F.col("confidence") - 0.001), 6).alias("confidence"))


@query("""SELECT user_id, round(CASE WHEN g + b = 0 THEN 0.5 ELSE g / (g + b) END, 6) AS success FROM (SELECT user_id, CAST(sum(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.6 ELSE 0 END) AS DOUBLE) AS g, CAST(sum(CASE event_type WHEN 'error' THEN 1.0 ELSE 0 END) AS DOUBLE) AS b FROM events GROUP BY user_id)""")
def outcome_inference(spark, sf):
    g = F.sum(F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "signup", 0.6).otherwise(0.0))
    b = F.sum(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
    return events(spark, sf).groupBy("user_id").agg(g.alias("g"), b.alias("b")).select("user_id", F.round(F.when(F.col("g") + F.col("b") == 0, 0.5).otherwise(F.try_divide(F.col("g"), F.col("g") + F.col("b"))), 6).alias("success"))


@query("SELECT event_type, round(CASE WHEN n >= 5 THEN 0.7 + 0.8 * h / n ELSE 1.0 END, 6) AS weight FROM (SELECT event_type, count(*) AS n, CAST(count(*) FILTER (value > 50) AS DOUBLE) AS h FROM events GROUP BY 1)")
def channel_credit_weights(spark, sf):
    c = events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("h"))
    return c.select("event_type", F.round(F.when(F.col("n") >= 5, 0.7 + 0.8 * F.col("h") / F.col("n")).otherwise(1.0), 6).alias("weight"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (value > 50) AS hits, round(count(*) FILTER (value > 50) / CAST(count(*) AS DOUBLE), 6) AS rate FROM events GROUP BY 1")
def signal_stats(spark, sf):
    hits = F.count_if(F.col("value") > 50)
    return events(spark, sf).groupBy("event_type").agg(F.count("*").alias("total"), hits.alias("hits"), F.round(hits / F.count("*"), 6).alias("rate"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS active_days FROM events WHERE ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-30' GROUP BY 1")
def weekly_summary(spark, sf):
    e = events(spark, sf).where("ts >= TIMESTAMP'2024-01-23 00:00:00' AND ts < TIMESTAMP'2024-01-30 00:00:00'")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("active_days"))


@query(f"WITH {FACTS_SQL} SELECT count(*) AS facts, count(DISTINCT session_id) AS sessions, count(DISTINCT profile_id) AS profiles, count(*) FILTER (created_on >= DATE '2024-12-23') AS recent FROM facts")
def overview_counts(spark, sf):
    return facts(spark, sf).agg(F.count("*").alias("facts"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("profile_id").alias("profiles"), F.count_if(F.col("created_on") >= "2024-12-23").alias("recent"))


@query(f"WITH {PART_EDGES_SQL}, d AS (SELECT node, sum(n) AS degree FROM (SELECT src AS node, count(*) AS n FROM edges GROUP BY 1 UNION ALL SELECT dst, count(*) FROM edges GROUP BY 1) GROUP BY 1) SELECT node, CAST(degree AS BIGINT) AS degree FROM d ORDER BY degree DESC, node LIMIT 5")
def degree_top5(spark, sf):
    e = part_edges(spark, sf)
    ends = e.select(F.col("src").alias("node")).unionAll(e.select("dst"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(5)


@query("SELECT user_id, max(ts) AS latest, count(*) AS n FROM events GROUP BY user_id")
def latest_access(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.max("ts").cast("timestamp_ntz").alias("latest"), F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS rank FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id HAVING count(*) >= 20")
def frequent_facts(spark, sf):
    n = events(spark, sf).where("event_type IN ('view', 'click')").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 20")
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "user_id")))


@query("SELECT user_id, hour, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, hour) AS k FROM (SELECT user_id, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1, 2)) WHERE k <= 5")
def active_hours(spark, sf):
    n = events(spark, sf).groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return _rank(n, ["user_id"], [F.desc("n"), "hour"], "k").where("k <= 5").drop("k")


@query("SELECT user_id, hour, round(n / t, 6) AS share FROM (SELECT user_id, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS t FROM events GROUP BY 1, 2) WHERE n / t > 0.08")
def peak_hours(spark, sf):
    n = events(spark, sf).groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    n = n.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    return n.where("s > 0.08").select("user_id", "hour", F.round("s", 6).alias("share"))


@query("SELECT user_id, part, round(n / t, 6) AS share FROM (SELECT user_id, CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(ts) >= 18 THEN 'evening' ELSE 'night' END AS part, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS t FROM events GROUP BY 1, 2)")
def temporal_pattern(spark, sf):
    n = events(spark, sf).groupBy("user_id", L.part_of_day(F.hour("ts"), (6, 12, 18), 24).alias("part")).agg(F.count("*").alias("n"))
    return n.select("user_id", "part", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 6).alias("share"))


@query("""SELECT part, event_type FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, event_type) AS k, sum(n) OVER (PARTITION BY part) AS t FROM (SELECT CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(ts) >= 18 THEN 'evening' ELSE 'night' END AS part, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE k = 1 AND t >= 5""")
def temporal_dominance(spark, sf):
    n = events(spark, sf).groupBy(L.part_of_day(F.hour("ts"), (6, 12, 18), 24).alias("part"), "event_type").agg(F.count("*").alias("n"))
    n = n.withColumn("t", F.sum("n").over(Window.partitionBy("part")))
    return _rank(n, ["part"], [F.desc("n"), "event_type"], "k").where("k = 1 AND t >= 5").select("part", "event_type")


@query("SELECT c_nationkey, term, c FROM (SELECT c_nationkey, p_type AS term, count(*) AS c FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) WHERE c >= 2".replace("term, c FROM (", "term, round(least(1.0::DOUBLE, c / greatest(0.1 * sum(c) OVER (PARTITION BY c_nationkey), 10)), 6) AS confidence FROM (", 1))
def tech_preferences(spark, sf):
    c, o, li, p = (table(spark, sf, t) for t in ("customer", "orders", "lineitem", "part"))
    j = li.select("l_orderkey", "l_partkey").join(p.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    n = j.groupBy("c_nationkey", F.col("p_type").alias("term")).agg(F.count("*").alias("c")).where("c >= 2")
    return n.select("c_nationkey", "term", F.round(F.least(F.lit(1.0), F.col("c") / F.greatest(0.1 * F.sum("c").over(Window.partitionBy("c_nationkey")), F.lit(10))), 6).alias("confidence"))


@query("WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM documents), n AS (SELECT lang, w, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 3) SELECT lang, w AS topic, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS k FROM n) WHERE k <= 15")
def topic_interests(spark, sf):
    w = table(spark, sf, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("topic"))
    n = w.groupBy("lang", "topic").agg(F.count("*").alias("n")).where("n >= 3")
    return _rank(n, ["lang"], [F.desc("n"), "topic"], "k").where("k <= 15").drop("k")


@query("SELECT o_custkey, c_name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE regexp_matches(c_name, '[A-Za-z]') GROUP BY 1, 2 HAVING count(*) >= 3")
def entity_preferences(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 3")
    return n.join(table(spark, sf, "customer").where(F.col("c_name").rlike("[A-Za-z]")), F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "c_name", "n")


@query("SELECT count(*) AS communities, max(n) AS largest, round(avg(n), 6) AS mean FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def knowledge_structure(spark, sf):
    n = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("communities"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean"))


@query("SELECT user_id, round(count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE), 6) AS rate FROM events GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (event_type = 'error') > 0.15 * count(*)")
def correction_rates(spark, sf):
    c = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    return c.where("n >= 3 AND e > 0.15 * n").select("user_id", F.round(F.col("e") / F.col("n"), 6).alias("rate"))


@query("SELECT user_id, event_type, round(s, 6) AS share FROM (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS s, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE n >= 3 AND s > 0.1 AND k <= 5")
def tool_preferences(spark, sf):
    n = events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    return _rank(n, ["user_id"], [F.desc("n"), "event_type"], "k").where("n >= 3 AND s > 0.1 AND k <= 5").select("user_id", "event_type", F.round("s", 6).alias("share"))


@query("SELECT o_custkey, o_orderkey AS kept FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def contradiction_resolution(spark, sf):
    """Of a customer's claims the newer one wins, then the more confident one."""
    return _rank(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_totalprice"), "o_orderkey"], "k").where("k = 1").select("o_custkey", F.col("o_orderkey").alias("kept"))


@query("SELECT event_type AS operation, count(*) AS n, sum(count(*)) OVER () AS total FROM events GROUP BY 1".replace("sum(count(*)) OVER ()", "CAST(sum(count(*)) OVER () AS BIGINT)"))
def audit_stats(spark, sf):
    n = events(spark, sf).groupBy(F.col("event_type").alias("operation")).agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy()))


@query("SELECT event_id, event_type FROM events WHERE user_id = 3 AND event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' ORDER BY event_id DESC LIMIT 50")
def audit_query(spark, sf):
    e = events(spark, sf).where("user_id = 3 AND event_type = 'click' AND ts >= TIMESTAMP'2024-01-05 00:00:00'")
    return e.select("event_id", "event_type").orderBy(F.desc("event_id")).limit(50)


@query("SELECT l_suppkey AS skill, count(*) AS n, round((count(*) FILTER (l_returnflag = 'N') - count(*) FILTER (l_returnflag = 'R')) / CAST(count(*) AS DOUBLE), 6) AS score, count(DISTINCT l_orderkey) AS sessions FROM lineitem GROUP BY 1")
def skill_metrics(spark, sf):
    good, bad = (F.count_if(F.col("l_returnflag") == f) for f in "NR")
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("skill")).agg(F.count("*").alias("n"), F.round((good - bad) / F.count("*"), 6).alias("score"), F.count_distinct("l_orderkey").alias("sessions"))


@query("SELECT skill FROM (SELECT l_suppkey AS skill, count(*) AS n, (count(*) FILTER (l_returnflag = 'N') - count(*) FILTER (l_returnflag = 'R')) / CAST(count(*) AS DOUBLE) AS s FROM lineitem GROUP BY 1) WHERE n >= 10 AND s < 0.2")
def degradation_trigger(spark, sf):
    good, bad = (F.count_if(F.col("l_returnflag") == f) for f in "NR")
    m = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("skill")).agg(F.count("*").alias("n"), ((good - bad) / F.count("*")).alias("s"))
    return m.where("n >= 10 AND s < 0.2").select("skill")


@query("WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a, b, n FROM (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 2) ORDER BY n DESC, a, b LIMIT 10")
def skill_correlations(spark, sf):
    lines = table(spark, sf, "lineitem")
    pairs = R.co_occurrences(lines.select("l_orderkey", "l_suppkey").distinct(), "l_orderkey", "l_suppkey", rows=lines.count()).where("n >= 2")
    return pairs.orderBy(F.desc("n"), "a", "b").limit(10)


@query("""SELECT user_id, round(sum(CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'click' THEN 0.7::DOUBLE WHEN 'view' THEN 0.6::DOUBLE WHEN 'signup' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END), 6) AS value FROM events GROUP BY 1""")
def implicit_feedback(spark, sf):
    """The fixed values of feedback kinds, summed by user."""
    kind = {"purchase": "user_positive", "click": "recall_hit", "view": "access_pattern", "signup": "user_correction", "error": "recall_miss"}
    value = F.lit(0.0)
    for event, name in kind.items():
        value = F.when(F.col("event_type") == event, L.FEEDBACK[name]).otherwise(value)
    return events(spark, sf).groupBy("user_id").agg(F.round(F.sum(value), 6).alias("value"))


@query("SELECT event_type, count(*) AS n, max(ts) AS latest, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM events GROUP BY 1")
def feedback_summary(spark, sf):
    n = events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").cast("timestamp_ntz").alias("latest"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy()))


@query("SELECT user_id, round(least(n / 10.0::DOUBLE, 1.0) * abs(g / n - 0.5) * 2, 4) AS confidence FROM (SELECT user_id, count(*) AS n, CAST(count(*) FILTER (value > 40) AS DOUBLE) AS g FROM events WHERE event_type = 'purchase' GROUP BY 1)")
def pattern_confidence(spark, sf):
    c = events(spark, sf).where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 40).alias("g"))
    return c.select("user_id", F.round(F.least(F.col("n") / 10.0, F.lit(1.0)) * F.abs(F.col("g") / F.col("n") - 0.5) * 2, 4).alias("confidence"))


@query("SELECT user_id, event_type, count(*) AS n, round(least(1.0::DOUBLE, count(*) / 100.0::DOUBLE), 6) AS confidence FROM events GROUP BY 1, 2")
def behaviour_upsert(spark, sf):
    return events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("n") / 100.0), 6))


@query("SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY least(1.0, count(*) / 100.0) DESC, count(*) DESC, user_id) AS k FROM events GROUP BY 1, 2) WHERE k <= 10")
def top_entities(spark, sf):
    n = behaviour_upsert(spark, sf)
    return _rank(n, ["event_type"], [F.desc("confidence"), F.desc("n"), "user_id"], "k").where("k <= 10").select("event_type", "user_id", "n")


@query("SELECT user_id + 1000 AS profile, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE n >= 12 AND event_type <> 'error'")
def pattern_transfer(spark, sf):
    return behaviour_upsert(spark, sf).where("n >= 12 AND event_type <> 'error'").select((F.col("user_id") + 1000).alias("profile"), "event_type", "n")


@query(f"WITH {FACTS_SQL} SELECT CASE WHEN access_count > 10 OR a < 7 THEN 'active' WHEN a < 30 THEN 'warm' WHEN a < 90 THEN 'cold' ELSE 'archived' END AS zone, count(*) AS n, min(a) AS youngest, max(a) AS oldest, round(avg(a), 4) AS mean FROM (SELECT access_count, CAST(DATE '2024-12-31' - created_on AS BIGINT) AS a FROM facts) GROUP BY 1")
def lifecycle_by_age(spark, sf):
    f = facts(spark, sf).select("access_count", F.datediff(F.lit("2024-12-31"), "created_on").cast("long").alias("a"))
    zone = F.when((F.col("access_count") > 10) | (F.col("a") < 7), "active").when(F.col("a") < 30, "warm").when(F.col("a") < 90, "cold").otherwise("archived")
    return f.groupBy(zone.alias("zone")).agg(F.count("*").alias("n"), F.min("a").alias("youngest"), F.max("a").alias("oldest"), F.round(F.avg("a"), 4).alias("mean"))


@query(f"WITH {FACTS_SQL} SELECT fact_id, 'active' AS zone FROM facts WHERE fact_id % 6 IN (1, 2) AND access_count >= 3")
def tier_promotion(spark, sf):
    return facts(spark, sf).where("fact_id % 6 IN (1, 2) AND access_count >= 3").select("fact_id", F.lit("active").alias("zone"))


@query(f"WITH {FACTS_SQL} SELECT fact_id FROM facts WHERE fact_id % 6 = 0 AND access_count >= 3 AND confidence >= 0.5 AND created_on <= DATE '2024-09-01'")
def fact_promotion(spark, sf):
    return facts(spark, sf).where("fact_id % 6 = 0 AND access_count >= 3 AND confidence >= 0.5 AND created_on <= DATE'2024-09-01'").select("fact_id")


@query("SELECT l_suppkey AS label, count(*) AS n, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1")
def cluster_listing(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"))


@query("SELECT c_custkey, n FROM (SELECT c_custkey, coalesce(n, 0) AS n, row_number() OVER (ORDER BY coalesce(n, 0) DESC, c_custkey) AS k FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey) WHERE k > 20 AND k <= 40")
def entity_listing(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))
    return c.orderBy(F.desc("n"), "c_custkey").offset(20).limit(20)


@query("SELECT CAST(floor(event_id / 50) * 50 + 49 AS BIGINT) AS at, count(*) AS n FROM events GROUP BY 1 HAVING count(*) = 50")
def step_trigger(spark, sf):
    return events(spark, sf).groupBy((F.floor(F.col("event_id") / 50) * 50 + 49).alias("at")).agg(F.count("*").alias("n")).where("n = 50")


@query("SELECT user_id, CASE WHEN max(ts) < TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 30 MINUTE THEN 'dead' WHEN max(ts) < TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 5 MINUTE THEN 'stale' ELSE 'alive' END AS state FROM events WHERE ts <= TIMESTAMP '2024-01-30 20:00:00' GROUP BY 1")
def heartbeat_expiry(spark, sf):
    last = events(spark, sf).where("ts <= TIMESTAMP'2024-01-30 20:00:00'").groupBy("user_id").agg(F.max("ts").alias("t"))
    return last.select("user_id", F.expr("CASE WHEN t < TIMESTAMP'2024-01-30 19:30:00' THEN 'dead' WHEN t < TIMESTAMP'2024-01-30 19:55:00' THEN 'stale' ELSE 'alive' END").alias("state"))


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), s AS (SELECT event_id AS signal, user_id, ts FROM events WHERE event_type = 'click'),
m AS (SELECT s.signal, p.event_id, s.ts AS came, p.ts AS opened FROM s ASOF JOIN p ON s.user_id = p.user_id AND s.ts >= p.ts) SELECT signal, event_id, came <= opened + INTERVAL 6 HOUR AS accepted FROM m""")
def late_signals(spark, sf):
    """Signals after the last view of their user: accepted within its time to live, else late."""
    e = events(spark, sf).where("event_type IN ('view', 'click')")
    last = F.last(F.when(F.col("event_type") == "view", F.struct("event_id", "ts")), True).over(Window.partitionBy("user_id").orderBy("ts", F.col("event_type").desc(), "event_id"))
    s = e.withColumn("p", last).where("event_type = 'click' AND p IS NOT NULL")
    return s.select(F.col("event_id").alias("signal"), F.col("p.event_id").alias("event_id"), (F.col("ts") <= F.col("p.ts") + F.expr("INTERVAL 6 HOURS")).alias("accepted"))


@query("SELECT event_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-30' - INTERVAL 1 HOUR AND event_id % 3 <> 0")
def stale_reaper(spark, sf):
    return events(spark, sf).where("event_type = 'signup' AND ts < TIMESTAMP'2024-01-29 23:00:00' AND event_id % 3 <> 0").select("event_id")


@query("SELECT event_id FROM events WHERE NOT (event_type = 'purchase' AND ts < TIMESTAMP '2024-01-30' - INTERVAL 7 DAY)")
def play_retention(spark, sf):
    return events(spark, sf).where("NOT (event_type = 'purchase' AND ts < TIMESTAMP'2024-01-23 00:00:00')").select("event_id")


@query("SELECT event_type AS stratum, user_id AS arm, n FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS k FROM events GROUP BY 1, 2) WHERE k <= 3")
def bandit_snapshot(spark, sf):
    n = events(spark, sf).groupBy(F.col("event_type").alias("stratum"), F.col("user_id").alias("arm")).agg(F.count("*").alias("n"))
    return _rank(n, ["stratum"], [F.desc("n"), "arm"], "k").where("k <= 3").drop("k")


@query("SELECT user_id, round(0.7 * p / CAST(p + m + 1 AS DOUBLE) + 0.3 * 0.5, 6) AS effectiveness FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'error') AS m FROM events GROUP BY 1)")
def prompt_effectiveness(spark, sf):
    c = events(spark, sf).groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("p"), F.count_if(F.col("event_type") == "error").alias("m"))
    return c.select("user_id", F.round(0.7 * F.col("p") / (F.col("p") + F.col("m") + 1) + F.lit(0.3) * 0.5, 6).alias("effectiveness"))


@query("SELECT user_id, CASE WHEN n >= 20 AND r < 0.5 THEN 'precision' ELSE 'balanced' END AS preset FROM (SELECT user_id, count(*) AS n, avg(CASE WHEN event_type IN ('purchase', 'click') THEN 1.0 ELSE 0.0 END) AS r FROM events GROUP BY 1)")
def adaptive_weights(spark, sf):
    c = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.avg(F.col("event_type").isin("purchase", "click").cast("double")).alias("r"))
    return c.select("user_id", F.when((F.col("n") >= 20) & (F.col("r") < 0.5), "precision").otherwise("balanced").alias("preset"))


@query("""WITH u AS (SELECT user_id, count(*) AS n, avg(value) / 100 AS now, avg(value) FILTER (ts < TIMESTAMP '2024-01-10') / 100 AS base FROM events GROUP BY 1), t AS (SELECT *, CASE WHEN base >= 0.07 THEN 0.02 * base WHEN base <= 0.03 THEN 0.02 ELSE 0.02 + (0.02 * 0.07 - 0.02) * (base - 0.03) / 0.04 END AS least FROM u)
SELECT user_id, n >= 200 AND base - now >= least AS rollback FROM t WHERE base IS NOT NULL""")
def rollback_rule(spark, sf):
    """Back to the old model after enough observations and a drop that depends on the baseline."""
    c = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), (F.avg("value") / 100).alias("now"), (F.avg(F.when(F.col("ts") < "2024-01-10", F.col("value"))) / 100).alias("base")).where("base IS NOT NULL")
    blend = F.lit(0.02) + (F.lit(0.02) * 0.07 - 0.02) * (F.col("base") - 0.03) / 0.04
    least = F.when(F.col("base") >= 0.07, 0.02 * F.col("base")).when(F.col("base") <= 0.03, 0.02).otherwise(blend)
    return c.select("user_id", ((F.col("n") >= 200) & (F.col("base") - F.col("now") >= least)).alias("rollback"))


@query("""WITH q AS (SELECT event_type AS grade, user_id, event_id FROM events WHERE event_type IN ('view', 'click', 'purchase')) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position, CASE grade WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS label FROM q""")
def training_matrix(spark, sf):
    q = events(spark, sf).where("event_type IN ('view', 'click', 'purchase')")
    label = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return _rank(q, ["user_id"], ["event_id"], "position").select("user_id", "event_id", "position", label.alias("label"))


@query("SELECT user_id, CASE WHEN n < 50 THEN 'baseline' WHEN n < 200 THEN 'heuristic' ELSE 'model' END AS phase, CASE WHEN n < 200 THEN 1.0::DOUBLE WHEN n < 500 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END AS bandit_share FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def ranker_phase(spark, sf):
    n = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.when(F.col("n") < 50, "baseline").when(F.col("n") < 200, "heuristic").otherwise("model").alias("phase"), F.when(F.col("n") < 200, 1.0).when(F.col("n") < 500, 0.4).otherwise(0.2).alias("bandit_share"))


@query(f"WITH {FACTS_SQL} SELECT fact_id, round(importance + 0.1 * exp(-CAST(DATE '2024-12-31' - created_on AS DOUBLE) / 30) + 0.05 * least(access_count / 10.0::DOUBLE, 1.0) + 0.1 * (confidence - 0.5), 6) AS score FROM facts")
def heuristic_rerank(spark, sf):
    age = F.datediff(F.lit("2024-12-31"), "created_on")
    score = F.col("importance") + 0.1 * F.exp(-age / 30.0) + 0.05 * F.least(F.col("access_count") / 10.0, F.lit(1.0)) + 0.1 * (F.col("confidence") - 0.5)
    return facts(spark, sf).select("fact_id", F.round(score, 6).alias("score"))


@query("SELECT user_id, CASE WHEN top >= 0.8 AND n >= 5 THEN TRUE WHEN top < 0.3 OR n < 2 THEN FALSE ELSE top >= 0.5 END AS sufficient FROM (SELECT user_id, max(value) / 200 AS top, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1)")
def sufficiency_test(spark, sf):
    c = events(spark, sf).where("event_type = 'signup'").groupBy("user_id").agg((F.max("value") / 200).alias("top"), F.count("*").alias("n"))
    return c.select("user_id", F.when((F.col("top") >= 0.8) & (F.col("n") >= 5), True).when((F.col("top") < 0.3) | (F.col("n") < 2), False).otherwise(F.col("top") >= 0.5).alias("sufficient"))


@query("""WITH r AS (SELECT user_id, CAST(event_id AS BIGINT) AS event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events), f AS (SELECT *, min(rank) OVER (PARTITION BY user_id, event_type) AS first FROM r),
g AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY first) AS g FROM f) SELECT user_id, event_id, rank FROM g WHERE rank <= 20 OR (g <= 3 AND rank = first)""")
def session_diversity(spark, sf):
    return S.promoted(events(spark, sf).select("user_id", "event_id", "event_type", "value"), "user_id", "event_type", "value", "event_id", 20, 3).select("user_id", "event_id", "rank")


@query("""WITH r AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, row_number() OVER (PARTITION BY user_id, event_type IN ('signup', 'error') ORDER BY value DESC, event_id) AS k FROM events)
SELECT user_id, event_id, rank FROM r WHERE rank <= 10 OR (event_type IN ('signup', 'error') AND k <= 2)""")
def channel_diversity(spark, sf):
    """The ten best of a user, and at least two of the structure channels."""
    e = events(spark, sf).select("user_id", "event_id", "value", F.col("event_type").isin("signup", "error").alias("structure"))
    e = _rank(e, ["user_id"], [F.desc("value"), "event_id"])
    return _rank(e, ["user_id", "structure"], ["rank"], "k").where("rank <= 10 OR (structure AND k <= 2)").select("user_id", "event_id", "rank")




@query()
def token_buckets(spark, sf):
    """Requests that a bucket of ten tokens, one a minute, lets pass; tested against a loop."""
    e = events(spark, sf).select("user_id", F.unix_micros("ts").alias("us"))
    return S.token_bucket(e.withColumn("s", F.col("us") / 1e6), "user_id", "s", 1 / 60, 10)


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events QUALIFY age <= 100")
def context_cache(spark, sf):
    """What a cache of the hundred newest entries a user holds."""
    return _rank(events(spark, sf), ["user_id"], [F.desc("ts"), F.desc("event_id")], "age").where("age <= 100").select("user_id", "event_id", "age")


@query("SELECT user_id, user_id % 4 >= CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS granted, count(*) AS n FROM events GROUP BY 1, 2")
def grant_check(spark, sf):
    need = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return events(spark, sf).groupBy("user_id", (F.col("user_id") % 4 >= need).alias("granted")).agg(F.count("*").alias("n"))
