"""Retrieval channels, fusion, graphs, lifecycle, learning and governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.functions import vectors as V
from engramlake.operators import centrality as C
from engramlake.operators import communities as M
from engramlake.operators import graph as G
from engramlake.operators import lifecycle as L
from engramlake.operators import retrieval as Q
from engramlake.plans.registry import query
from engramlake.plans.text_queries import STOP, TOKENS_ALL_SQL, WORDS_SQL
from engramlake.sources.tables import FACTS_SQL, PART_EDGES_SQL, events, facts, part_edges, table

# ---- retrieval -----------------------------------------------------------------

TOKENS_SQL = f"""tok AS (SELECT doc_id AS fact_id, list_filter({TOKENS_ALL_SQL}, lambda x: x NOT IN ({STOP})) AS w FROM documents),
post AS (SELECT fact_id, term, count(*) AS tf, max(n) AS n FROM (SELECT fact_id, len(w) AS n, unnest(w) AS term FROM tok) GROUP BY 1, 2),
size AS (SELECT avg(len(w)) AS a, count(*) AS docs FROM tok),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter({TOKENS_ALL_SQL}, lambda x: x NOT IN ({STOP}))) AS term FROM benchmark WHERE item_id % 20 = 0),
df AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term),
bm AS (SELECT query_id, fact_id, sum(ln((docs + 1) / CAST(df AS DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / a)) + 1.0)) AS score FROM post JOIN qt USING (term) JOIN df USING (term), size GROUP BY 1, 2),
lex AS (SELECT query_id, fact_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fact_id) AS rank FROM bm)"""


def _lexical(spark, sf, k):
    q = table(spark, sf, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return Q.top(Q.bm25(facts(spark, sf).select("fact_id", "content"), q), k)


@query(f"WITH {TOKENS_SQL} SELECT query_id, fact_id, round(score, 6) AS score, rank FROM lex WHERE rank <= 10")
def bm25_topk(spark, sf):
    return _lexical(spark, sf, 10).select("query_id", "fact_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


#: A channel of dates: facts near a day that the query stands for.
DATES_SQL = """dates AS (SELECT query_id, fact_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fact_id) AS rank FROM (
  SELECT q.item_id AS query_id, fact_id, CASE WHEN abs(d) > 365 THEN 0.0 ELSE exp(-(d * d) / 1800.0::DOUBLE) END AS score FROM (SELECT q.item_id, f.fact_id, CAST(date_diff('day', DATE '2024-01-01' + CAST(q.item_id * 40 AS INTEGER), f.created_on) AS DOUBLE) AS d FROM benchmark q, facts f WHERE q.item_id % 20 = 0) q) WHERE score > 0)"""


def _dates(spark, sf, k):
    q = table(spark, sf, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("item_id") * 40).cast("int")).alias("day"))
    d = F.datediff("created_on", "day").cast("double")
    pairs = facts(spark, sf).select("fact_id", "created_on").crossJoin(q)  # the stated queries against all facts
    return Q.top(pairs.select("query_id", "fact_id", V.date_proximity(d).alias("score")).where("score > 0"), k)


@query(f"WITH {FACTS_SQL}, {DATES_SQL} SELECT query_id, fact_id, round(score, 6) AS score, rank FROM dates WHERE rank <= 10")
def temporal_channel(spark, sf):
    return _dates(spark, sf, 10).select("query_id", "fact_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


RRF_SQL = f"""{FACTS_SQL}, {TOKENS_SQL}, {DATES_SQL}, ch AS (SELECT query_id, fact_id, 'lexical' AS channel, rank FROM lex WHERE rank <= 50 UNION ALL SELECT query_id, fact_id, 'dates', rank FROM dates WHERE rank <= 50),
fused AS (SELECT query_id, fact_id, sum(CASE channel WHEN 'lexical' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END * (1.0 / (rank + 15) - 1.0::DOUBLE / 1015)) + 1.6::DOUBLE / 1015 AS score, count(DISTINCT channel) AS channels FROM ch GROUP BY 1, 2)"""


def _fused(spark, sf):
    ch = _lexical(spark, sf, 50).withColumn("channel", F.lit("lexical")).unionByName(_dates(spark, sf, 50).withColumn("channel", F.lit("dates")))
    return Q.weighted_rrf(ch, {"lexical": 1.0, "dates": 0.6})


@query(f"WITH {RRF_SQL} SELECT query_id, fact_id, round(score, 6) AS score, channels FROM fused")
def rrf_fusion(spark, sf):
    return _fused(spark, sf).select("query_id", "fact_id", F.round("score", 6).alias("score"), "channels")


FINAL_SQL = f"""{RRF_SQL}, fin AS (SELECT query_id, f.fact_id, score * CASE WHEN channels >= 3 THEN 2.0::DOUBLE WHEN channels = 2 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * (1.0 + 0.2 * (greatest(0.1, 1.0 - date_diff('day', created_on, DATE '2025-01-01') / 365.0::DOUBLE) - 0.5))
 * CASE WHEN length(content) < 20 THEN 0.3::DOUBLE WHEN length(content) < 60 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * (0.5 + confidence) AS score FROM fused JOIN facts f USING (fact_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fact_id) AS rank FROM fin)"""


def _recall(spark, sf, k):
    f = facts(spark, sf)
    age = F.datediff(F.lit("2025-01-01").cast("date"), F.col("created_on"))
    return Q.top(Q.final_score(Q.cross_channel(_fused(spark, sf)), f, F.col("confidence"), age).select("query_id", "fact_id", "score"), k)


@query(f"WITH {FINAL_SQL} SELECT query_id, fact_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def recall_topk(spark, sf):
    """The flagship: lexical and date channels, fused, boosted, scored; ten facts a query."""
    return _recall(spark, sf, 10).select("query_id", "fact_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {FINAL_SQL}, gold AS (SELECT DISTINCT query_id, fact_id FROM lex WHERE rank <= 3), hit AS (SELECT query_id, min(rank) AS r FROM ranked JOIN gold USING (query_id, fact_id) WHERE rank <= 10 GROUP BY 1)
SELECT query_id, round(coalesce(1.0 / r, 0.0), 6) AS mrr FROM (SELECT DISTINCT query_id FROM gold) LEFT JOIN hit USING (query_id)""")
def mrr_at_10(spark, sf):
    gold = _lexical(spark, sf, 3).select("query_id", "fact_id")
    return Q.reciprocal_rank(_recall(spark, sf, 10), gold, 10).select("query_id", F.round("mrr", 6).alias("mrr"))


@query("""WITH g AS (SELECT source AS query_id, d.doc_id, CAST((quality * 3 + d.doc_id) % 5 AS DOUBLE) AS grade, row_number() OVER (PARTITION BY source ORDER BY d.doc_id) AS rank FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS best FROM g), s AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (power(2.0, grade) - 1) / log2(rank + 1.0::DOUBLE) ELSE 0.0 END) AS dcg, sum(CASE WHEN best <= 10 THEN (power(2.0, grade) - 1) / log2(best + 1.0::DOUBLE) ELSE 0.0 END) AS idcg FROM b GROUP BY 1)
SELECT query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END, 6) AS ndcg FROM s""")
def ndcg_at_10(spark, sf):
    from pyspark.sql import Window

    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    g = d.select(F.col("source").alias("query_id"), ((F.col("quality") * 3 + F.col("doc_id")) % 5).cast("double").alias("grade"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"))
    return Q.ndcg(g).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query()
def spreading_activation(spark, sf):
    """Three rounds from the parts whose key 20 divides; no SQL, as each round keeps its best twenty."""
    e = part_edges(spark, sf)
    seeds = e.where("src % 20 = 0").select(F.col("src").alias("fact_id")).distinct().withColumn("activation", F.lit(1.0))
    return Q.spread(seeds, e).select("fact_id", F.round("activation", 6).alias("activation"))


# ---- graphs --------------------------------------------------------------------


@query(f"WITH {PART_EDGES_SQL}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) SELECT node, degree, round(degree / CAST((SELECT count(*) FROM d) - 1 AS DOUBLE), 6) AS centrality FROM d")
def degree_centrality(spark, sf):
    return G.degree_centrality(part_edges(spark, sf)).select("node", "degree", F.round("centrality", 6).alias("centrality"))


@query()
def bridge_scores(spark, sf):
    """Betweenness of parts by paths from every twentieth part; no SQL, tested against a plain pass over small graphs."""
    e = part_edges(spark, sf)
    sources = e.where("src % 20 = 0").select(F.col("src").alias("node")).distinct()
    return C.betweenness(e, sources).select("node", F.round("betweenness", 9).alias("bridge_score"))


@query()
def modular_communities(spark, sf):
    """Communities of parts by modularity; no SQL, as levels depend on those before."""
    return M.communities(part_edges(spark, sf))


def _pagerank_sql(rounds: int) -> str:
    steps = ""
    for k in range(1, rounds + 1):
        steps += f""", r{k} AS MATERIALIZED (SELECT b.node, b.stuck, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0.0) + lost / n) AS rank FROM base b LEFT JOIN (SELECT dst, sum(rank * p) AS got FROM r{k - 1} JOIN links ON node = src GROUP BY dst) g ON b.node = g.dst,
  (SELECT coalesce(sum(rank) FILTER (stuck), 0.0) AS lost FROM r{k - 1}), cnt)"""
    return f"""WITH {PART_EDGES_SQL}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), cnt AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes),
 links AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM edges), base AS (SELECT node, node NOT IN (SELECT src FROM edges) AS stuck FROM nodes), r0 AS (SELECT node, stuck, 1.0 / n AS rank FROM base, cnt) {steps}
 SELECT node, round(rank, 6) AS rank FROM r{rounds}"""


@query(_pagerank_sql(8))
def pagerank(spark, sf):
    return G.pagerank(part_edges(spark, sf), rounds=8).select("node", F.round("rank", 6).alias("rank"))


def _label_sql(rounds: int) -> str:
    steps = ""
    for k in range(1, rounds + 1):
        steps += f""", l{k} AS MATERIALIZED (SELECT node, label FROM (SELECT s.src AS node, l.label, row_number() OVER (PARTITION BY s.src ORDER BY round(sum(s.weight), 6) DESC, l.label) AS n FROM sym s JOIN l{k - 1} l ON s.dst = l.node GROUP BY s.src, l.label) WHERE n = 1)"""
    return f"""WITH {PART_EDGES_SQL}, sym AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) GROUP BY 1, 2),
 l0 AS (SELECT src AS node, src AS label FROM sym GROUP BY src) {steps} SELECT node, label FROM l{rounds}"""


@query(_label_sql(3))
def label_propagation(spark, sf):
    return G.label_propagation(part_edges(spark, sf), rounds=3)


@query(f"""WITH RECURSIVE {PART_EDGES_SQL}, e AS (SELECT src AS a, dst AS b FROM edges WHERE weight >= 2 UNION SELECT dst, src FROM edges WHERE weight >= 2),
r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node AND r.root <= e.a) SELECT node, min(root) AS component FROM (SELECT * FROM r UNION SELECT a, least(a, (SELECT min(root) FROM r WHERE node = a)) FROM e) GROUP BY node""")
def connected_component(spark, sf):
    """Components of the part graph's edges of weight 2 or more, directions left aside."""
    return G.connected_components(part_edges(spark, sf).where("weight >= 2"))


@query(f"""WITH {PART_EDGES_SQL}, d0 AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 20 = 0), d1 AS (SELECT DISTINCT dst AS node FROM d0 JOIN edges ON node = src WHERE dst NOT IN (SELECT node FROM d0)),
d2 AS (SELECT DISTINCT dst AS node FROM d1 JOIN edges ON node = src WHERE dst NOT IN (SELECT node FROM d0 UNION SELECT node FROM d1)) SELECT node, 0 AS depth FROM d0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2""")
def blast_radius(spark, sf):
    seeds = table(spark, sf, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("node"))
    return G.reach(part_edges(spark, sf), seeds, 2)


@query("""WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, l_quantity AS weight FROM lineitem) SELECT src, dst, round(max(weight), 6) AS weight FROM e WHERE src <> dst AND src IN (SELECT p_partkey FROM part WHERE p_size > 5) AND dst IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY 1, 2""")
def edge_pruning(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight"))
    known = table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("node"))
    return G.prune(e, known)


@query(f"""WITH {PART_EDGES_SQL}, e AS (SELECT * FROM edges), t AS (SELECT a.src, a.dst AS mid, b.dst AS far, a.weight FROM e a JOIN e b ON a.dst = b.src), added AS (SELECT src, far AS dst, max(weight) AS weight FROM t WHERE src <> far GROUP BY 1, 2),
kept AS (SELECT src, dst, weight FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.mid = e.src AND t.far = e.dst)) SELECT src, dst, max(weight) AS weight FROM (SELECT * FROM kept UNION ALL SELECT * FROM added) GROUP BY 1, 2""")
def supersedes_chains(spark, sf):
    return G.collapse_chains(part_edges(spark, sf))


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS fact_id, l_partkey AS entity FROM lineitem), k AS (SELECT * FROM b)
SELECT x.fact_id AS a, y.fact_id AS b, count(*) AS shared FROM k x JOIN k y ON x.entity = y.entity AND x.fact_id < y.fact_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def shared_entities(spark, sf):
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").alias("entity")).distinct()
    return G.shared_entity_pairs(b, 2)


# ---- lifecycle, learning, governance -------------------------------------------


@query(f"""WITH {FACTS_SQL}, s AS (SELECT fact_id, greatest(0.1, least(100.0, 2.0 * ln(1 + access_count) + 1.5 * importance + 1.0 * (fact_id % 2) + 0.5 * confidence)) AS s, CAST(fact_id % 60 AS DOUBLE) AS h FROM facts), r AS (SELECT *, exp(-h / greatest(s, 0.1)) AS r FROM s)
SELECT zone, count(*) AS n, round(avg(r), 6) AS mean FROM (SELECT r, CASE WHEN r > 0.8 THEN 'active' WHEN r > 0.5 THEN 'warm' WHEN r > 0.2 THEN 'cold' WHEN r > 0.05 THEN 'archive' ELSE 'forgotten' END AS zone FROM r) GROUP BY zone""")
def decay_cycle(spark, sf):
    f = L.decay(facts(spark, sf), (F.col("fact_id") % 60).cast("double"), F.col("confidence"), F.col("fact_id") % 2)
    return f.groupBy("zone").agg(F.count("*").alias("n"), F.round(F.avg("retention"), 6).alias("mean"))


@query(f"""WITH {FACTS_SQL}, t AS (SELECT fact_id, fact_id % 50 = 0 AS pinned, (fact_id * 7) % 1200 AS idle, least(greatest(CASE WHEN access_count >= 5 THEN 2 ELSE 1 END, CASE WHEN importance >= 0.8 THEN 3 ELSE 1 END), 3) AS k FROM facts)
SELECT fact_id, CASE WHEN pinned THEN 'active' WHEN idle >= 365 * k THEN 'archived' WHEN idle >= 180 * k THEN 'cold' WHEN idle >= 30 * k THEN 'warm' ELSE 'active' END AS tier FROM t""")
def tier_evaluation(spark, sf):
    t = L.tier((F.col("fact_id") * 7) % 1200, F.col("access_count"), F.col("importance"), F.col("fact_id") % 50 == 0)
    return facts(spark, sf).select("fact_id", t.alias("tier"))


@query(f"WITH {PART_EDGES_SQL} SELECT src, dst, round(w, 6) AS weight FROM (SELECT src, dst, weight / 10.0::DOUBLE * exp(-0.3::DOUBLE) AS w FROM edges) WHERE w >= 0.05")
def edge_decay(spark, sf):
    e = part_edges(spark, sf).withColumn("weight", F.col("weight") / 10.0)
    return L.edge_decay(e).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"WITH {FACTS_SQL}, w AS (SELECT fact_id AS duplicate, min(fact_id) OVER (PARTITION BY profile_id, substr(content, 1, 100)) AS canonical FROM facts) SELECT canonical, duplicate FROM w WHERE canonical <> duplicate")
def prefix_dedupe(spark, sf):
    return L.prefix_duplicates(facts(spark, sf).select("fact_id", "profile_id", "content"))


TRUST = {"click": (1.0, 0.0), "purchase": (0.5, 0.0), "error": (0.0, 3.0), "view": (0.0, 1.5)}


@query("""SELECT user_id, 1.0 + sum(CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'purchase' THEN 0.5::DOUBLE ELSE 0.0 END) AS alpha, 1.0 + sum(CASE event_type WHEN 'error' THEN 3.0::DOUBLE WHEN 'view' THEN 1.5::DOUBLE ELSE 0.0 END) AS beta,
round((1.0 + sum(CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'purchase' THEN 0.5::DOUBLE ELSE 0.0 END)) / (2.0 + sum(CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'purchase' THEN 0.5::DOUBLE WHEN 'error' THEN 3.0::DOUBLE WHEN 'view' THEN 1.5::DOUBLE ELSE 0.0 END)), 6) AS trust FROM events GROUP BY user_id""")
def beta_trust(spark, sf):
    return L.trust(events(spark, sf), "user_id", TRUST, "event_type")


@query("""SELECT user_id, round(1 + 4.0 * k, 6) AS alpha, round(1 + 2.0 * k, 6) AS beta FROM (SELECT user_id, CASE WHEN d > 30 THEN power(0.95::DOUBLE, d - 30) ELSE 1.0 END AS k FROM (SELECT user_id, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-03-10') AS d FROM events GROUP BY user_id))""")
def trust_prior_decay(spark, sf):
    idle = events(spark, sf).groupBy("user_id").agg(F.datediff(F.lit("2024-03-10").cast("date"), F.max(F.to_date("ts"))).alias("d"))
    a, b = L.decayed_prior(F.lit(5.0), F.lit(3.0), F.col("d"))
    return idle.select("user_id", F.round(a, 6).alias("alpha"), F.round(b, 6).alias("beta"))


@query("""SELECT user_id % 5 AS stratum, event_type AS arm, round(least(1000.0, 1.0 + sum(r)), 6) AS alpha, round(least(1000.0, 1.0 + sum(1.0 - r)), 6) AS beta, count(*) AS plays FROM (SELECT user_id, event_type, least(1.0, value / 500.0::DOUBLE) AS r FROM events) GROUP BY 1, 2""")
def bandit_posteriors(spark, sf):
    p = events(spark, sf).select((F.col("user_id") % 5).alias("stratum"), F.col("event_type").alias("arm"), F.least(F.lit(1.0), F.col("value") / 500.0).alias("r"))
    return L.bandit_posterior(p, ["stratum", "arm"], "r").select("stratum", "arm", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), "plays")


SHADOW_SQL = "arms AS (SELECT event_id, value, CAST(('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) % 2 AS arm FROM events)"


@query(f"WITH {SHADOW_SQL} SELECT event_id, arm FROM arms")
def shadow_routing(spark, sf):
    return events(spark, sf).select("event_id", L.arm(F.col("event_id")).cast("long").alias("arm"))


@query(f"""WITH {SHADOW_SQL}, d AS (SELECT user_id, avg(value) FILTER (arm = 1) - avg(value) FILTER (arm = 0) AS d FROM arms JOIN (SELECT event_id, user_id FROM events) USING (event_id) GROUP BY 1)
SELECT count(d) AS pairs, round(avg(d), 6) AS difference, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t FROM d""")
def shadow_decision(spark, sf):
    """Arms of the same user's queries are pairs."""
    return L.paired(events(spark, sf).withColumn("arm", L.arm(F.col("event_id"))), "user_id", "arm", "value")


@query("""WITH RECURSIVE o AS (SELECT user_id AS log, event_id, event_type || ':' || CAST(event_id AS VARCHAR) AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
c AS (SELECT log, event_id, body, k, sha256(body) AS h, '' AS previous FROM o WHERE k = 1 UNION ALL SELECT o.log, o.event_id, o.body, o.k, sha256(c.h || o.body), c.h FROM c JOIN o ON o.log = c.log AND o.k = c.k + 1),
f AS (SELECT log, k, CASE WHEN event_id % 97 = 5 THEN 'forged' ELSE body END AS body, h, previous FROM c), p AS (SELECT *, lag(h) OVER (PARTITION BY log ORDER BY k) AS before FROM f)
SELECT log, count(*) AS entries, count(*) FILTER (h <> sha256(previous || body) OR previous <> coalesce(before, '')) AS broken FROM p GROUP BY log""")
def audit_chain(spark, sf):
    body = F.concat_ws(":", "event_type", F.col("event_id").cast("string"))
    made = L.chain(events(spark, sf).withColumn("log", F.col("user_id")), "event_id", body)
    return L.verify_chain(made.withColumn("body", F.when(F.col("event_id") % 97 == 5, "forged").otherwise(F.col("body"))), "event_id")


@query(f"""WITH {FACTS_SQL}, rules AS (SELECT * FROM (VALUES ('en', 200), ('en', 120), ('fr', 300), ('de', 90)) t(profile_id, days)), m AS (SELECT profile_id, min(days) AS days FROM rules GROUP BY 1) SELECT fact_id, CAST(days AS BIGINT) AS days FROM facts JOIN m USING (profile_id) WHERE date_diff('day', created_on, DATE '2024-12-31') > days""")
def retention_enforcement(spark, sf):
    rules = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(p).alias("profile_id"), F.lit(d).alias("days")) for p, d in (("en", 200), ("en", 120), ("fr", 300), ("de", 90))])).alias("r")).select("r.*")
    return L.expired(facts(spark, sf), rules, F.datediff(F.lit("2024-12-31").cast("date"), F.col("created_on"))).select("fact_id", F.col("days").cast("long").alias("days"))


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), h AS (SELECT DISTINCT p.event_id FROM p JOIN events e ON e.user_id = p.user_id AND e.event_type = 'purchase' AND e.ts > p.ts AND e.ts <= p.ts + INTERVAL 4 HOUR),
a AS (SELECT DISTINCT p.event_id FROM p JOIN events e ON e.user_id = p.user_id AND e.event_type = 'view' AND e.ts > p.ts AND e.ts <= p.ts + INTERVAL 1 HOUR)
SELECT event_id, CASE WHEN a.event_id IS NOT NULL THEN 0.0::DOUBLE WHEN h.event_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS reward FROM p LEFT JOIN h USING (event_id) LEFT JOIN a USING (event_id)""")
def proxy_settlement(spark, sf):
    from engramlake.operators import relational as R

    e = events(spark, sf)
    p = e.where("event_type = 'view'").select("event_id", "user_id", F.col("ts").alias("at"))
    after = lambda k: e.where(F.col("event_type") == k).select("user_id", F.col("ts").alias("later"))
    return L.settle(p, R.within(p, after("purchase"), ["user_id"], "at", "later", 4 * 3600), R.within(p, after("view"), ["user_id"], "at", "later", 3600), "event_id")


@query("""SELECT user_id, ts, n FROM (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n >= 4""")
def burst_detector(spark, sf):
    return L.bursts(events(spark, sf).select("user_id", "ts"), "user_id", "ts", 21600, 4)
