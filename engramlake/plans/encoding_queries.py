"""Encoding, quantisation, further learning and code-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.functions import quantize as Z
from engramlake.functions import text as T
from engramlake.functions import vectors as V
from engramlake.operators import encoding as E
from engramlake.operators import graph as G
from engramlake.operators import lifecycle as L
from engramlake.operators import pairwise as P
from engramlake.operators import quantized_store as QS
from engramlake.operators import relational as R
from engramlake.operators import retrieval as Q
from engramlake.plans.math_queries import COS, VEC_SQL
from engramlake.plans.registry import query
from engramlake.plans.text_queries import STOP, TOKENS_ALL_SQL, WORDS_SQL
from engramlake.sources.tables import FACTS_SQL, PART_EDGES_SQL, events, facts, part_edges, stored, table, vectors


@query()
def fact_extraction(spark, sf):
    """Facts of conversations: sentences by score, ten a conversation."""
    return E.extract_facts(table(spark, sf, "conversations").where("text IS NOT NULL")).select("conv_id", "turn", "place", "fact_type", "importance")


@query("""WITH m AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'NATION_' || c_nationkey WHEN c_custkey % 3 = 1 THEN 'nation_' || c_nationkey ELSE 'N' || c_nationkey END AS mention FROM customer),
r AS (SELECT mention, (SELECT min(n_nationkey) FROM nation WHERE n_name = mention) AS a, (SELECT min(n_nationkey) FROM nation WHERE lower(n_name) = lower(mention)) AS b, (SELECT min(n_nationkey) FROM nation WHERE n_nationkey < 20 AND lower('n' || n_nationkey) = lower(mention)) AS c FROM m)
SELECT mention, CAST(coalesce(a, b, c) AS BIGINT) AS entity_id, CASE WHEN a IS NOT NULL THEN 'name' WHEN b IS NOT NULL THEN 'case' WHEN c IS NOT NULL THEN 'alias' ELSE 'new' END AS how FROM r""")
def entity_resolution(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("c_nationkey").cast("string")
    c = F.col("c_custkey") % 3
    mention = F.when(c == 0, F.concat(F.lit("NATION_"), k)).when(c == 1, F.concat(F.lit("nation_"), k)).otherwise(F.concat(F.lit("N"), k))
    ents = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("entity_id"))
    alias = n.where("n_nationkey < 20").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("alias"), F.col("n_nationkey").cast("long").alias("entity_id"))
    return E.resolve(table(spark, sf, "customer").select(mention.alias("mention")), ents, alias)


@query("""SELECT DISTINCT l_orderkey AS fact_id, CASE WHEN l_partkey = 7 THEN 11 ELSE l_partkey END AS entity FROM lineitem""")
def entity_merge(spark, sf):
    return E.merge_entity(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").alias("entity")), 7, 11)


@query(f"""WITH {VEC_SQL}, p AS (SELECT a.fact_id AS new, b.fact_id AS old, round({COS}(a.v, b.v), 9) AS s, a.fact_id % 4 = b.fact_id % 4 AS same, (a.fact_id + b.fact_id) % 11 = 0 AS contra FROM vec a JOIN vec b ON a.community = b.community AND b.fact_id < a.fact_id WHERE a.fact_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY new ORDER BY s DESC, old) AS n FROM p) SELECT new, old, round(s, 4) AS similarity, CASE WHEN contra AND s > 0.85 THEN 'supersede' WHEN s > 0.95 THEN 'noop' WHEN s > 0.85 AND same THEN 'update' WHEN s > 0.85 THEN 'supersede' ELSE 'add' END AS action FROM k WHERE n = 1""")
def consolidation_actions(spark, sf):
    v = vectors(spark, sf)
    asked = v.where("fact_id % 20 = 0").withColumnRenamed("fact_id", "query_id")  # the stated new facts
    best = P.nearest_within(asked, v, 1, earlier=True).select(F.col("query_id").alias("new"), F.col("fact_id").alias("old"), F.col("score").alias("s"))
    act = E.consolidation(F.round("s", 9), F.col("new") % 4 == F.col("old") % 4, (F.col("new") + F.col("old")) % 11 == 0)
    return best.select("new", "old", F.round("s", 4).alias("similarity"), act.alias("action"))


@query(f"""WITH {VEC_SQL}, p AS (SELECT a.fact_id AS src, b.fact_id AS dst, {COS}(a.v, b.v) AS w FROM vec a JOIN vec b ON a.community = b.community AND a.fact_id <> b.fact_id WHERE a.fact_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) AS n FROM p WHERE w >= 0.2)
SELECT src, dst, round(w, 6) AS weight FROM k WHERE n <= 5""")
def semantic_edges(spark, sf):
    v = vectors(spark, sf)
    return E.semantic_edges(v.where("fact_id % 20 = 0"), v, 0.2, 5).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"""WITH {FACTS_SQL}, b AS (SELECT DISTINCT l_orderkey AS fact_id, l_partkey AS entity FROM lineitem), r AS (SELECT entity, fact_id, content, row_number() OVER (PARTITION BY entity ORDER BY fact_id DESC) AS n FROM b JOIN facts USING (fact_id))
SELECT entity, count(*) AS facts, md5(string_agg(content, ' | ' ORDER BY fact_id)) AS summary FROM r WHERE n <= 20 GROUP BY entity""")
def entity_profiles(spark, sf):
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").alias("entity")).distinct()
    return E.entity_profiles(b, facts(spark, sf)).withColumn("summary", F.md5("summary"))


@query(f"""WITH {FACTS_SQL}, r AS (SELECT session_id, fact_id, row_number() OVER (PARTITION BY session_id ORDER BY round(importance * confidence, 9) DESC, fact_id) AS n, count(*) OVER (PARTITION BY session_id) AS facts FROM facts) SELECT session_id, fact_id AS gist, facts FROM r WHERE n = 1""")
def cluster_gists(spark, sf):
    return E.gist(facts(spark, sf), "session_id")


def _widths(spark, sf):
    """Vectors with the width that their retention leaves them: full, 8, 4, 2 bits or none."""
    f = facts(spark, sf).select("fact_id", "importance", "created_on")
    v = vectors(spark, sf).join(f, "fact_id")
    strength = V.memory_strength(F.col("access_count"), F.col("importance"), F.lit(0), F.lit(0.0))
    kept = V.retention(F.datediff(F.lit("2025-01-01").cast("date"), F.col("created_on")) / 24.0, strength)
    return v.select("fact_id", "v", V.precision_bits(kept).alias("bits"))


@query()
def mixed_precision(spark, sf):
    """What the vectors of each width take and lose; seeded rotation, no SQL."""
    w = _widths(spark, sf)
    coded = [Z.quantise(w.where(F.col("bits") == b), b).select(F.lit(b).alias("bits"), (F.octet_length("codes")).cast("long").alias("bytes"), "error") for b in (2, 4, 8)]
    full = w.where("bits = 32").select("bits", (4 * F.size("v")).cast("long").alias("bytes"), F.lit(0.0).alias("error"))
    for c in coded:
        full = full.unionByName(c)
    return full.groupBy("bits").agg(F.count("*").alias("facts"), F.sum("bytes").alias("bytes"), F.round(F.avg("error"), 6).alias("mean_error"))


@query()
def quantised_search(spark, sf):
    """Ten nearest of every twentieth vector from the quantised store, forgotten facts left out; recall is tested."""
    w = _widths(spark, sf)
    asked = vectors(spark, sf).where("fact_id % 20 = 0").select(F.col("fact_id").alias("query_id"), "v")
    found = QS.search(QS.write_store(w), asked, w.where("bits > 0"), 10)
    return found.select("query_id", "fact_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def polar_codes(spark, sf):
    """Four-bit polar angles of every vector with their error; seeded rotation, no SQL."""
    return Z.polar(vectors(spark, sf), 4).select("fact_id", F.round("radius", 6).alias("radius"), F.hex("codes").alias("codes"), F.round("error", 6).alias("error"))


@query()
def vector_quantisation(spark, sf):
    """Four-bit codes of every vector with their error; seeded rotation, no SQL."""
    return Z.quantise(vectors(spark, sf), 4).select("fact_id", F.round("radius", 6).alias("radius"), F.hex("codes").alias("codes"), F.round("error", 6).alias("error"))


@query()
def langevin_step(spark, sf):
    """Steps at temperature .3, drift and noise, from a start that the fact's key gives; no SQL."""
    f = facts(spark, sf).withColumn("age_days", F.datediff(F.lit("2025-01-01").cast("date"), F.col("created_on")))
    return Z.langevin(f, "fact_id", 0.3, rounds=20).select("fact_id", F.round("radius", 6).alias("radius"), F.round("weight", 6).alias("weight"))


@query()
def thompson_choice(spark, sf):
    """An arm a stratum by seeded Beta draws; no SQL."""
    p = events(spark, sf).select((F.col("user_id") % 5).alias("stratum"), F.col("event_type").alias("arm"), F.least(F.lit(1.0), F.col("value") / 500.0).alias("r"))
    return Z.thompson(L.bandit_posterior(p, ["stratum", "arm"], "r"), ["stratum"], "arm", 11).select("stratum", "arm", F.round("sample", 6).alias("sample"))


@query(f"""WITH {FACTS_SQL}, p AS (SELECT p_partkey AS entity, p_name FROM part), q AS (SELECT entity FROM p WHERE entity % 20 = 0) SELECT q.entity AS query_id, l_orderkey AS fact_id, 0.95::DOUBLE AS score FROM q JOIN (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) ON l_partkey = q.entity""")
def profile_channel(spark, sf):
    q = table(spark, sf, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"))
    b = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("query_id"), F.col("l_orderkey").alias("fact_id")).distinct()
    return q.join(b, "query_id").withColumn("score", F.lit(0.95))


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS f, l_partkey AS e FROM lineitem), s AS (SELECT o_orderkey AS f FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20), p AS (SELECT x.f AS a, y.f AS b FROM s x JOIN s y ON y.f = (SELECT min(f) FROM s WHERE f > x.f)),
o AS (SELECT p.a, p.b, m.f, count(DISTINCT m1.e) AS n1 FROM p JOIN b m1 ON m1.f = p.a JOIN b m ON m.e = m1.e AND m.f <> p.a AND m.f <> p.b GROUP BY 1, 2, 3), t AS (SELECT p.a, p.b, m.f, count(DISTINCT m1.e) AS n2 FROM p JOIN b m1 ON m1.f = p.b JOIN b m ON m.e = m1.e AND m.f <> p.a AND m.f <> p.b GROUP BY 1, 2, 3)
SELECT a, b, f AS bridge, CAST(round(least(1.0, 0.5 + 0.15 * (n1 + n2)), 6) AS DOUBLE) AS score FROM o JOIN t USING (a, b, f)""")
def bridge_discovery(spark, sf):
    from pyspark.sql import Window

    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("f"), F.col("l_partkey").alias("e")).distinct()
    seeds = table(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20).select(F.col("o_orderkey").alias("f"))
    # the twenty seeds of a ranking, in one order
    pairs = seeds.select(F.col("f").alias("a"), F.lead("f").over(Window.partitionBy(F.lit(0)).orderBy("f")).alias("b")).where("b IS NOT NULL")
    side = lambda end, n: (
        pairs.join(b.select(F.col("f").alias(end), "e"), end).join(b, "e").where("f <> a AND f <> b").groupBy("a", "b", "f").agg(F.count_distinct("e").alias(n))
    )
    return side("a", "n1").join(side("b", "n2"), ["a", "b", "f"]).select("a", "b", F.col("f").alias("bridge"), F.round(F.least(F.lit(1.0), 0.5 + 0.15 * (F.col("n1") + F.col("n2"))), 6).alias("score"))


@query(f"""WITH {FACTS_SQL}, seed AS (SELECT fact_id, session_id, importance * confidence AS s FROM facts ORDER BY round(importance * confidence, 9) DESC, fact_id LIMIT 20) SELECT f.fact_id, round(max(0.8 * s), 6) AS score FROM seed JOIN facts f USING (session_id) WHERE f.fact_id NOT IN (SELECT fact_id FROM seed) GROUP BY f.fact_id""")
def scene_expansion(spark, sf):
    f = facts(spark, sf).select("fact_id", "session_id", (F.col("importance") * F.col("confidence")).alias("s"))
    seed = f.orderBy(F.round("s", 9).desc(), "fact_id").limit(20)  # the twenty best seeds
    rest = f.drop("s").join(seed.select("fact_id"), "fact_id", "left_anti")
    return rest.join(seed.select("session_id", "s"), "session_id").groupBy("fact_id").agg(F.round(F.max(0.8 * F.col("s")), 6).alias("score"))


@query(rf"""WITH n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name AS id, unnest({WORDS_SQL.replace('text', 'p_name')}) AS w FROM n), g AS (SELECT DISTINCT id, substr(w, CAST(i AS INTEGER), 3) AS g FROM w, range(1, 40) r(i) WHERE i <= length(w) - 2),
q AS (SELECT id AS name, g FROM g) SELECT name, id AS found, count(*) AS hits FROM g JOIN q USING (g) GROUP BY 1, 2 HAVING count(*) >= 2""")
def trigram_lookup(spark, sf):
    g = table(spark, sf, "part").select("p_name").distinct().select(F.col("p_name").alias("found"), F.explode(T.trigrams(F.col("p_name"))).alias("g"))
    return g.join(g.withColumnRenamed("found", "name"), "g").groupBy("name", "found").agg(F.count("*").alias("hits")).where("hits >= 2")


@query(f"""WITH {PART_EDGES_SQL}, c AS (SELECT p_partkey AS node, p_brand AS community FROM part), x AS (SELECT least(a.community, b.community) AS a, greatest(a.community, b.community) AS b FROM edges JOIN c a ON src = a.node JOIN c b ON dst = b.node WHERE a.community <> b.community)
SELECT a, b, count(*) AS n, CASE WHEN count(*) >= 10 THEN 'high' WHEN count(*) >= 5 THEN 'med' ELSE 'low' END AS level FROM x GROUP BY 1, 2""")
def coupling_warnings(spark, sf):
    return E.coupling(part_edges(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community")))


@query(f"""WITH {PART_EDGES_SQL}, d AS (SELECT src AS node, count(*) AS out FROM edges GROUP BY 1), i AS (SELECT dst AS node, count(*) AS callers FROM edges GROUP BY 1)
SELECT p_partkey AS node, round(least(0.25, coalesce(out, 0) * 0.05) + CASE WHEN p_size > 25 THEN 0.3 ELSE 0.05 END + least(0.1, coalesce(callers, 0) / 20.0::DOUBLE), 6) AS risk FROM part LEFT JOIN d ON node = p_partkey LEFT JOIN i ON i.node = p_partkey""")
def risk_scores(spark, sf):
    e = part_edges(spark, sf)
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"))
    inn = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("callers"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), "p_size").join(out, "node", "left").join(inn, "node", "left")
    risk = F.least(F.lit(0.25), F.coalesce("out", F.lit(0)) * 0.05) + F.when(F.col("p_size") > 25, 0.3).otherwise(0.05) + F.least(F.lit(0.1), F.coalesce("callers", F.lit(0)) / 20.0)
    return p.select("node", F.round(risk, 6).alias("risk"))


@query("SELECT DISTINCT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber > 1) OR p_name LIKE 'small%'")
def entry_points(spark, sf):
    called = table(spark, sf, "lineitem").where("l_linenumber > 1").select(F.col("l_partkey").alias("node"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), "p_name")
    return p.select("node").join(called, "node", "left_anti").union(p.where(F.col("p_name").startswith("small")).select("node")).distinct()


@query(f"""WITH {VEC_SQL}, u AS (SELECT community, unnest(range(1, 65)) AS i, unnest(v) AS x FROM vec), m AS (SELECT community, i, avg(x) AS x FROM u GROUP BY 1, 2), c AS (SELECT community, list(x ORDER BY i) AS c FROM m GROUP BY 1)
SELECT community, round(least(1.0, greatest(0.0, 1 - avg(list_cosine_similarity(v, c)))), 6) AS gap FROM vec JOIN c USING (community) GROUP BY 1""")
def entropy_gap(spark, sf):
    """One less the mean cosine of a cluster's vectors with its centre."""
    from engramlake.functions import vectors as V

    v = vectors(spark, sf).select("community", "v")
    mean = v.select("community", F.posexplode("v").alias("p", "x")).groupBy("community", "p").agg(F.avg("x").alias("x"))
    centre = mean.groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("c"))
    gap = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.avg(V.cosine(F.col("v"), F.col("c")))))
    return v.join(centre, "community").groupBy("community").agg(F.round(gap, 6).alias("gap"))


@query(f"""WITH {VEC_SQL}, c AS (SELECT community, list_transform(range(1, 65), lambda i: i) AS d FROM vec GROUP BY community), u AS (SELECT community, unnest(range(1, 65)) AS i, unnest(v) AS x FROM vec)
SELECT community, i AS dim, round(avg(x), 6) AS mean FROM u GROUP BY 1, 2""")
def community_centroids(spark, sf):
    u = vectors(spark, sf).select("community", F.posexplode("v").alias("p", "x"))
    return u.groupBy("community", (F.col("p") + 1).cast("long").alias("dim")).agg(F.round(F.avg("x"), 6).alias("mean"))


@query(f"""WITH w AS (SELECT doc_id, unnest(list_filter({TOKENS_ALL_SQL}, lambda x: x NOT IN ({STOP}) AND length(x) >= 4)) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS k FROM c)
SELECT doc_id, string_agg(w, ',' ORDER BY k) AS keywords FROM r WHERE k <= 3 GROUP BY doc_id""")
def keyword_extraction(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", F.explode(F.filter(T.tokenize(F.col("text")), lambda x: F.length(x) >= 4)).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    top = R.top_per_group(w, "doc_id", [F.col("n").desc(), F.col("w")], 3)
    out = top.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "w"))).alias("l"))
    return out.select("doc_id", F.array_join(F.transform("l", lambda x: x["w"]), ",").alias("keywords"))


@query("""WITH g AS (SELECT event_type, user_id % 4 AS grp, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 4), ())) SELECT coalesce(event_type, '*') AS event_type, coalesce(grp, -1) AS grp, n FROM g""")
def event_grouping_sets(spark, sf):
    events(spark, sf).withColumn("grp", F.col("user_id") % 4).createOrReplaceTempView("engramlake_events")
    return spark.sql("SELECT coalesce(event_type, '*') AS event_type, coalesce(grp, -1) AS grp, count(*) AS n FROM engramlake_events GROUP BY GROUPING SETS ((event_type), (grp), ())")


@query("""WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, event_id FROM events) SELECT user_id, event_id AS last_event, event_type FROM s WHERE n = 1""")
def latest_state(spark, sf):
    return G.last_per_group(events(spark, sf), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", F.col("event_id").alias("last_event"), "event_type")


@query("""SELECT event_id, CASE WHEN age < 2 THEN 'hot' WHEN age < 14 THEN 'warm' WHEN age < 30 THEN 'cold' END AS tier FROM (SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS age FROM events) WHERE age < 30""")
def event_pruning(spark, sf):
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    return events(spark, sf).where(age < 30).select("event_id", F.when(age < 2, "hot").when(age < 14, "warm").otherwise("cold").alias("tier"))


@query(f"""WITH {FACTS_SQL}, a AS (SELECT fact_id, 0.40 * confidence + 0.25 * exp(-date_diff('day', created_on, DATE '2025-01-01') / 90.0::DOUBLE) + 0.20 * ln(1 + access_count) / (SELECT ln(1 + max(access_count)) FROM facts) + 0.15 * importance AS s FROM facts)
SELECT fact_id, round(s, 6) AS score FROM a WHERE s >= 0.12 ORDER BY round(s, 9) DESC, fact_id LIMIT 30""")
def auto_invoke(spark, sf):
    f = facts(spark, sf)
    most = f.agg(F.log1p(F.max("access_count")).alias("m"))  # one row
    age = F.datediff(F.lit("2025-01-01").cast("date"), F.col("created_on"))
    s = 0.40 * F.col("confidence") + 0.25 * F.exp(-age / 90.0) + 0.20 * F.log1p("access_count") / F.col("m") + 0.15 * F.col("importance")
    return f.crossJoin(F.broadcast(most)).select("fact_id", s.alias("s")).where("s >= 0.12").orderBy(F.round("s", 9).desc(), "fact_id").limit(30).select("fact_id", F.round("s", 6).alias("score"))


@query(f"""WITH {VEC_SQL}, s AS (SELECT q.fact_id AS query_id, x.fact_id, {COS}(q.v, x.v) AS s FROM vec q, vec x WHERE q.fact_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, fact_id) AS n, max(s) OVER (PARTITION BY query_id) AS m, min(s) OVER (PARTITION BY query_id) AS l FROM s)
SELECT query_id, fact_id, round((s - l) / (m - l), 6) AS scaled FROM r WHERE n <= 20""")
def minmax_rerank(spark, sf):
    v = stored(spark, sf)
    q = v.where("fact_id % 20 = 0").select(F.col("fact_id").alias("query_id"), "v")
    return Q.scaled_nearest(q, v, 20).select("query_id", "fact_id", F.round("score", 6).alias("scaled"))
