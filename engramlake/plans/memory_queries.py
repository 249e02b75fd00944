"""Dynamics, graph channels, the code graph and the store path."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramlake.functions import vectors as V
from engramlake.operators import graph as G
from engramlake.operators import relational as R
from engramlake.operators import store as S
from engramlake.plans.math_queries import COS, VEC_SQL, _norm
from engramlake.plans.registry import ORACLES, query
from engramlake.sources.tables import FACTS_SQL, PART_EDGES_SQL, events, facts, part_edges, table, vectors


def _rank(df, by, order, name="rank"):
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


# ---- dynamics ------------------------------------------------------------------


@query(f"WITH {VEC_SQL} SELECT community, round(greatest(0.1::DOUBLE, 15.0::DOUBLE * (1 + avg(list_avg(list_transform(v, lambda x: abs(x) * 2)))) / 2), 6) AS temperature FROM vec GROUP BY 1")
def adaptive_temperature(spark, sf):
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x) * 2) / F.size("v")
    return vectors(spark, sf).groupBy("community").agg(F.round(F.greatest(F.lit(0.1), 15.0 * (1 + F.avg(mean)) / 2), 6).alias("temperature"))


@query(f"WITH {FACTS_SQL} SELECT fact_id, round(2 * (3.0::DOUBLE + 0.08::DOUBLE * ln(access_count + 1.0::DOUBLE) - 0.005::DOUBLE * least(a, 365) / 365.0::DOUBLE + 0.5::DOUBLE * importance) * (fact_id % 10) / 10.0::DOUBLE, 6) AS pull FROM (SELECT *, date_diff('day', created_on, DATE '2024-12-31') AS a FROM facts)")
def langevin_gradient(spark, sf):
    age = F.datediff(F.lit("2024-12-31"), "created_on")
    alpha = 3.0 + 0.08 * F.log(F.col("access_count") + 1.0) - 0.005 * F.least(age, F.lit(365)) / 365.0 + 0.5 * F.col("importance")
    return facts(spark, sf).select("fact_id", F.round(2 * alpha * (F.col("fact_id") % 10) / 10.0, 6).alias("pull"))


@query(f"WITH {VEC_SQL}, r AS (SELECT fact_id, least(0.99::DOUBLE, {_norm('v[1:8]')} * 2) AS r FROM vec), w AS (SELECT fact_id, 1.0::DOUBLE - 0.9::DOUBLE * r / 0.99::DOUBLE AS w FROM r) SELECT fact_id, round(w, 6) AS weight, CASE WHEN (1 - w) / 0.9 * 0.99 < 0.3 THEN 'active' WHEN (1 - w) / 0.9 * 0.99 < 0.55 THEN 'warm' WHEN (1 - w) / 0.9 * 0.99 < 0.8 THEN 'cold' ELSE 'archived' END AS state FROM w")
def lifecycle_weight(spark, sf):
    """Weight in [.1, 1] from the radius of a position, and the state from the weight."""
    r = F.least(F.lit(0.99), V.norm(F.slice("v", 1, 8)) * 2)
    w = vectors(spark, sf).select("fact_id", (1.0 - 0.9 * r / 0.99).alias("w"))
    near = (1 - F.col("w")) / 0.9 * 0.99
    return w.select("fact_id", F.round("w", 6).alias("weight"), F.when(near < 0.3, "active").when(near < 0.55, "warm").when(near < 0.8, "cold").otherwise("archived").alias("state"))


@query(f"WITH {FACTS_SQL}, r AS (SELECT fact_id, exp(-(fact_id % 40) / 10.0::DOUBLE) AS r FROM facts) SELECT fact_id, round(0.3::DOUBLE * (1 + 0.5 * (1 - r)), 6) AS temperature, round(0.8 * CASE WHEN r > 0.8 THEN 1.0 WHEN r > 0.5 THEN 0.7 WHEN r > 0.2 THEN 0.3 ELSE 0.0 END, 6) AS weight FROM r".replace("0.8 * CASE", "CAST(0.8 * CASE").replace("0.0 END, 6)", "0.0 END AS DOUBLE), 6)"))
def forgetting_coupling(spark, sf):
    r = facts(spark, sf).select("fact_id", F.exp(-(F.col("fact_id") % 40) / 10.0).alias("r"))
    zone = F.when(F.col("r") > 0.8, 1.0).when(F.col("r") > 0.5, 0.7).when(F.col("r") > 0.2, 0.3).otherwise(0.0)
    return r.select("fact_id", F.round(0.3 * (1 + 0.5 * (1 - F.col("r"))), 6).alias("temperature"), F.round(0.8 * zone, 6).alias("weight"))


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"


@query(f"""WITH {VEC_SQL}, p AS (SELECT a.fact_id, a.v, list_transform(list_zip(b.v, a.v), lambda z: z[1] - z[2]) AS d FROM vec a JOIN vec b ON b.fact_id = a.fact_id + 1),
q AS (SELECT *, {_DOT.format('d', 'v')} / {_DOT.format('d', 'd')} AS k FROM p) SELECT fact_id, round({_norm('list_transform(list_zip(v, d), lambda z: 0.7::DOUBLE * z[1] + 0.3::DOUBLE * k * z[2])')}, 6) AS length FROM q""")
def sheaf_restriction(spark, sf):
    """Length of R v for entity edges: .7 v + .3 d (d.v) / |d|^2, without the matrix."""
    v = vectors(spark, sf).select("fact_id", "v")
    p = v.join(v.select((F.col("fact_id") - 1).alias("fact_id"), F.col("v").alias("b")), "fact_id").withColumn("d", F.zip_with("b", "v", lambda x, y: x - y))
    p = p.withColumn("k", V.dot(F.col("d"), F.col("v")) / V.dot(F.col("d"), F.col("d")))
    return p.select("fact_id", F.round(V.norm(F.zip_with("v", "d", lambda x, y: x * 0.7 + F.col("k") * y * 0.3)), 6).alias("length"))


_STATE_SQL = f"{VEC_SQL}, s AS (SELECT q.fact_id AS query_id, 8.0::DOUBLE * {_DOT.format('q.v', 'x.v')} AS a, x.v FROM vec q JOIN vec x ON q.community = x.community WHERE q.fact_id % 50 = 0)"


def _states(spark, sf):
    """Stated queries against the vectors of their community; beta is 8."""
    v = vectors(spark, sf)
    q = v.where("fact_id % 50 = 0").select(F.col("fact_id").alias("query_id"), F.col("v").alias("q"), "community")
    return q.join(v.select("community", "v"), "community").withColumn("a", 8.0 * V.dot(F.col("q"), F.col("v")))


@query(f"WITH {_STATE_SQL}, m AS (SELECT query_id, max(a) AS m FROM s GROUP BY 1) SELECT query_id, round(-(max(m) + ln(sum(exp(a - m)))) / 8.0 + 0.5, 6) AS energy FROM s JOIN m USING (query_id) GROUP BY 1")
def hopfield_energy(spark, sf):
    """-lse(beta X q) / beta + |q|^2 / 2, for unit vectors; a maximum first, so that no sum overflows."""
    s = _states(spark, sf).select("query_id", "a")
    e = s.join(s.groupBy("query_id").agg(F.max("a").alias("m")), "query_id").groupBy("query_id").agg(F.max("m").alias("m"), F.sum(F.exp(F.col("a") - F.col("m"))).alias("z"))
    return e.select("query_id", F.round(-(F.col("m") + F.log("z")) / 8.0 + 0.5, 6).alias("energy"))


@query(f"WITH {_STATE_SQL}, z AS (SELECT query_id, sum(exp(a - 8)) AS z FROM s GROUP BY 1), u AS (SELECT query_id, exp(a - 8) AS w, unnest(range(1, 65)) AS dim, unnest(v) AS x FROM s) SELECT query_id, dim, round(sum(w * x) / max(z), 6) AS x FROM u JOIN z USING (query_id) GROUP BY 1, 2")
def hopfield_update(spark, sf):
    """One step of retrieval: the softmax-weighted mean of what is stored; a is at most beta."""
    s = _states(spark, sf).withColumn("w", F.exp(F.col("a") - 8.0))
    u = s.select("query_id", "w", F.posexplode("v").alias("p", "x"))
    return u.groupBy("query_id", (F.col("p") + 1).cast("long").alias("dim")).agg(F.round(F.sum(F.col("w") * F.col("x")) / F.sum("w"), 6).alias("x"))


@query(f"WITH {FACTS_SQL} SELECT fact_id, CASE WHEN b > c THEN 'up' WHEN b < c THEN 'down' ELSE 'keep' END AS action, b AS bits FROM (SELECT fact_id, greatest([2, 4, 8, 32][CAST(fact_id % 4 AS INTEGER) + 1], [2, 4, 8, 32][CAST(access_count % 4 AS INTEGER) + 1]) AS b, [32, 8, 4][CAST(fact_id % 3 AS INTEGER) + 1] AS c FROM facts)")
def precision_merge(spark, sf):
    """The higher of the two schedules' precisions against the present one."""
    pick = lambda of, k: F.element_at(F.array(*[F.lit(b) for b in of]), (F.col(k[0]) % k[1] + 1).cast("int"))
    bits = F.greatest(pick((2, 4, 8, 32), ("fact_id", 4)), pick((2, 4, 8, 32), ("access_count", 4)))
    f = facts(spark, sf).select("fact_id", bits.alias("bits"), pick((32, 8, 4), ("fact_id", 3)).alias("now"))
    return f.select("fact_id", F.when(F.col("bits") > F.col("now"), "up").when(F.col("bits") < F.col("now"), "down").otherwise("keep").alias("action"), "bits")


# ---- graph channels ------------------------------------------------------------

_LINKS_SQL = f"{PART_EDGES_SQL}, top AS (SELECT max(weight) AS t FROM edges), links AS (SELECT src, dst, weight / t AS weight FROM edges, top WHERE weight >= 2)"
_SEEDS_SQL = "seeds AS (SELECT p_partkey AS node, 1.0::DOUBLE AS activation FROM part WHERE p_brand = 'Brand#2' AND p_size > 10)"
_ACT_SQL = f"""{_LINKS_SQL}, {_SEEDS_SQL}, a1 AS (SELECT dst AS node, max(activation * 0.7::DOUBLE * weight) AS activation FROM seeds JOIN links ON src = node GROUP BY 1 HAVING max(activation * 0.7::DOUBLE * weight) >= 0.05),
a2 AS (SELECT dst AS node, max(activation * 0.7::DOUBLE * weight) AS activation FROM a1 JOIN links ON src = node GROUP BY 1 HAVING max(activation * 0.7::DOUBLE * weight) >= 0.05),
a3 AS (SELECT dst AS node, max(activation * 0.7::DOUBLE * weight) AS activation FROM a2 JOIN links ON src = node GROUP BY 1 HAVING max(activation * 0.7::DOUBLE * weight) >= 0.05),
act AS (SELECT node, max(activation) AS activation FROM (SELECT * FROM seeds UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3) GROUP BY 1)"""


def _links(spark, sf):
    e = part_edges(spark, sf)
    top = e.agg(F.max("weight").alias("t"))  # one row
    return e.where("weight >= 2").crossJoin(F.broadcast(top)).select("src", "dst", (F.col("weight") / F.col("t")).alias("weight"))


def _active(spark, sf):
    seeds = table(spark, sf, "part").where("p_brand = 'Brand#2' AND p_size > 10").select(F.col("p_partkey").alias("node"), F.lit(1.0).alias("activation"))
    return S.activate(seeds, _links(spark, sf), 3)


@query(f"WITH {_ACT_SQL} SELECT node, round(activation / max(activation) OVER (), 6) AS score FROM act")
def entity_graph_channel(spark, sf):
    """Facts of the query's entity at 1, what they reach in three hops by the strongest way, normalised."""
    a = _active(spark, sf)
    top = a.agg(F.max("activation").alias("t"))  # one row
    return a.crossJoin(F.broadcast(top)).select("node", F.round(F.col("activation") / F.col("t"), 6).alias("score"))


@query(f"WITH {_ACT_SQL}, c AS (SELECT node, activation FROM act WHERE node % 3 = 0) SELECT node, round(activation / max(activation) OVER (), 6) AS score FROM c")
def graph_score_enhancer(spark, sf):
    """The same activation for candidates only."""
    a = _active(spark, sf).where("node % 3 = 0")
    top = a.agg(F.max("activation").alias("t"))  # one row
    return a.crossJoin(F.broadcast(top)).select("node", F.round(F.col("activation") / F.col("t"), 6).alias("score"))


@query(f"WITH {_ACT_SQL}, e AS (SELECT src, dst, CASE WHEN src % 2 = 0 THEN 'supersedes' ELSE 'contradiction' END AS kind FROM links WHERE (src + dst) % 5 = 0), s AS (SELECT node, activation AS score, (node * 37) % 101 AS made FROM act),\n" + """g AS (SELECT DISTINCT src AS node FROM e WHERE kind = 'supersedes'), o AS (SELECT DISTINCT CASE WHEN a.made < b.made THEN src ELSE dst END AS node FROM e JOIN s a ON a.node = src JOIN s b ON b.node = dst WHERE kind = 'contradiction')
SELECT node, round(score * CASE WHEN node IN (SELECT node FROM g) THEN 0.3::DOUBLE ELSE 1.0 END * CASE WHEN node IN (SELECT node FROM o) THEN 0.5::DOUBLE ELSE 1.0 END, 6) AS score FROM s""")
def contradiction_suppression(spark, sf):
    e = _links(spark, sf).where("(src + dst) % 5 = 0").select("src", "dst", F.when(F.col("src") % 2 == 0, "supersedes").otherwise("contradiction").alias("kind"))
    s = _active(spark, sf).select("node", F.col("activation").alias("score"), ((F.col("node") * 37) % 101).alias("made"))
    return S.suppressed(s, e).select("node", F.round("score", 6).alias("score"))


@query(f"WITH {_ACT_SQL} SELECT node, round(activation, 6) AS activation FROM act WHERE (SELECT max(activation) FROM act) >= 0.05")
def fok_gate(spark, sf):
    """What was activated, or nothing if nothing was activated enough."""
    a = _active(spark, sf)
    enough = a.agg((F.max("activation") >= 0.05).alias("ok"))  # one row
    return a.crossJoin(F.broadcast(enough)).where("ok").select("node", F.round("activation", 6).alias("activation"))


@query(f"WITH {PART_EDGES_SQL}, a AS (SELECT l_partkey AS src, l_suppkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2) SELECT node, count(*) AS n, round(sum(weight), 6) AS weight FROM (SELECT src AS node, weight FROM edges UNION ALL SELECT dst, weight FROM edges UNION ALL SELECT src, weight FROM a UNION ALL SELECT dst, weight FROM a) GROUP BY 1")
def unified_neighbours(spark, sf):
    """Edges and associations, from either end."""
    a = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    both = G.symmetric(part_edges(spark, sf)).unionByName(G.symmetric(a))
    return both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query(f"WITH {PART_EDGES_SQL}, a AS (SELECT l_partkey AS src, l_suppkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2), u AS (SELECT src, dst, max(weight) AS weight FROM (SELECT * FROM edges UNION ALL SELECT * FROM a) GROUP BY 1, 2) SELECT src, dst, weight FROM u UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_partkey NOT IN (SELECT src FROM u UNION SELECT dst FROM u)")
def graph_assembly(spark, sf):
    """Edges and associations, the heaviest of each pair, and the nodes without any."""
    a = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    u = part_edges(spark, sf).unionByName(a).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    alone = table(spark, sf, "part").select(F.col("p_partkey").alias("node")).join(G.nodes(u), "node", "left_anti")
    return u.unionByName(alone.select(F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("weight")))


@query("WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n, round(least(1.0::DOUBLE, 0.1::DOUBLE + 0.05::DOUBLE * count(*)), 6) AS weight FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def co_access_strengthening(spark, sf):
    lines = table(spark, sf, "lineitem")
    pairs = R.co_occurrences(lines.select("l_orderkey", "l_suppkey").distinct(), "l_orderkey", "l_suppkey", rows=lines.count())
    return pairs.withColumn("weight", F.round(F.least(F.lit(1.0), 0.1 + 0.05 * F.col("n")), 6))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders), p AS (SELECT a.o_orderkey AS src, b.o_orderkey AS dst, abs(date_diff('day', a.d, b.d)) AS days FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey WHERE abs(date_diff('day', a.d, b.d)) <= 7)
SELECT src, dst, round(exp(-days / 30.0::DOUBLE), 6) AS weight FROM p""")
def temporal_decay_edges(spark, sf):
    """Both ways between an entity's facts a week apart at most: an equi-join on the entity and on buckets of a week."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d")).withColumn("w", F.floor(F.unix_date("d") / 7))
    b = o.select(F.col("o_orderkey").alias("dst"), "o_custkey", F.col("d").alias("e"), F.explode(F.array(F.col("w") - 1, F.col("w"), F.col("w") + 1)).alias("w"))
    p = o.join(b, ["o_custkey", "w"]).where((F.col("o_orderkey") != F.col("dst")) & (F.abs(F.datediff("d", "e")) <= 7))
    return p.select(F.col("o_orderkey").alias("src"), "dst", F.round(F.exp(-F.abs(F.datediff("d", "e")) / 30.0), 6).alias("weight"))


@query(f"""WITH pr AS ({ORACLES['pagerank']}), {PART_EDGES_SQL}, d AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1), a AS (SELECT l_partkey AS node, count(*) AS a FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT node, round(0.5 * rank / max(rank) OVER () + 0.3 * d / max(d) OVER () + 0.2 * coalesce(a, 0) / max(coalesce(a, 0)) OVER (), 4) AS centrality FROM pr JOIN d USING (node) LEFT JOIN a USING (node)""")
def sagq_centrality(spark, sf):
    """Half rank, three tenths degree, a fifth recent use, each against its maximum."""
    e = part_edges(spark, sf)
    rank = G.pagerank(e, rounds=8).select("node", F.round("rank", 6).alias("r"))
    used = table(spark, sf, "lineitem").where("l_shipdate >= TIMESTAMP'1998-01-01 00:00:00'").groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("a"))
    j = rank.join(G.degree_centrality(e).select("node", F.col("degree").alias("d")), "node").join(used, "node", "left").fillna(0, ["a"])
    top = j.agg(*[F.max(c).alias(f"{c}m") for c in "rda"])  # one row
    return j.crossJoin(F.broadcast(top)).select("node", F.round(0.5 * F.col("r") / F.col("rm") + 0.3 * F.col("d") / F.col("dm") + 0.2 * F.col("a") / F.col("am"), 4).alias("centrality"))


@query("SELECT event_id, round((0.4 * value / 100 + 0.6 * (event_id % 7) / 7.0) * CASE event_type WHEN 'click' THEN 1.2 WHEN 'error' THEN 0.8 ELSE 1.0 END, 6) AS score FROM events")
def bandit_reweight(spark, sf):
    bias = F.when(F.col("event_type") == "click", 1.2).when(F.col("event_type") == "error", 0.8).otherwise(1.0)
    return events(spark, sf).select("event_id", F.round((0.4 * F.col("value") / 100 + 0.6 * (F.col("event_id") % 7) / 7.0) * bias, 6).alias("score"))


# ---- the code graph: parts are symbols, brands their files ----------------------


@query(f"WITH {PART_EDGES_SQL} SELECT p_partkey AS node, (SELECT count(*) FROM edges WHERE dst = p_partkey) AS callers, (SELECT count(*) FROM edges WHERE src = p_partkey) AS callees FROM part")
def callers_callees(spark, sf):
    e = part_edges(spark, sf)
    ends = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("callers")), e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("callees"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node")).join(ends[0], "node", "left").join(ends[1], "node", "left").fillna(0)


_TESTED_SQL = "tested AS (SELECT DISTINCT dst AS node FROM edges JOIN part ON p_partkey = src WHERE p_brand = 'Brand#1')"


def _tested(spark, sf):
    tests = table(spark, sf, "part").where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("src"))
    return part_edges(spark, sf).join(tests, "src").select(F.col("dst").alias("node"), "src")


@query(f"WITH {PART_EDGES_SQL} SELECT dst AS node, src AS test FROM edges JOIN part ON p_partkey = src WHERE p_brand = 'Brand#1'")
def tests_for_node(spark, sf):
    return _tested(spark, sf).select("node", F.col("src").alias("test"))


@query(f"WITH {PART_EDGES_SQL}, {_TESTED_SQL} SELECT p_partkey AS node, p_partkey IN (SELECT node FROM tested) AS covered FROM part WHERE p_brand <> 'Brand#1'")
def test_coverage(spark, sf):
    covered = _tested(spark, sf).select("node").distinct().withColumn("covered", F.lit(True))
    p = table(spark, sf, "part").where("p_brand <> 'Brand#1'").select(F.col("p_partkey").alias("node"))
    return p.join(covered, "node", "left").select("node", F.coalesce("covered", F.lit(False)).alias("covered"))


_FLOW_SQL = f"{PART_EDGES_SQL}, calls AS (SELECT src, dst FROM edges WHERE dst > src AND src % 4 = 0), entries AS (SELECT DISTINCT src AS entry FROM calls WHERE src NOT IN (SELECT dst FROM calls) AND src % 3 = 0), flow AS (SELECT entry, entry AS node, 0 AS depth FROM entries UNION SELECT entry, dst, depth + 1 FROM flow JOIN calls ON src = node WHERE depth < 15)"


def _flows(spark, sf):
    calls = G.cut(part_edges(spark, sf).where("dst > src AND src % 4 = 0").select("src", "dst"))
    entries = calls.select(F.col("src").alias("entry")).distinct().join(calls.select(F.col("dst").alias("entry")), "entry", "left_anti").where("entry % 3 = 0")
    front = seen = entries.select("entry", F.col("entry").alias("node"), F.lit(0).alias("depth"))
    for d in range(1, 16):
        step = front.join(calls, front.node == calls.src).select("entry", F.col("dst").alias("node")).distinct()
        front = G.cut(step.join(seen, ["entry", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


@query(f"WITH RECURSIVE {_FLOW_SQL} SELECT entry, node, min(depth) AS depth FROM flow GROUP BY 1, 2")
def flow_trace(spark, sf):
    """What each entry point reaches over calls, and in how few steps, 15 at most."""
    return _flows(spark, sf)


_CRIT_SQL = f"""{_FLOW_SQL}, {_TESTED_SQL}, f AS (SELECT entry, node, min(depth) AS depth FROM flow GROUP BY 1, 2), c AS (SELECT entry, max(depth) AS depth, count(*) AS n, count(DISTINCT p_brand) AS files, avg(CASE WHEN t.node IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS untested, max(CASE WHEN p_type LIKE '%PROMO%' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS guarded
FROM f JOIN part ON p_partkey = f.node LEFT JOIN tested t ON t.node = f.node GROUP BY 1)"""
_CRIT = "0.10 * least(depth / 15.0::DOUBLE, 1.0) + 0.15 * least(n / 50.0::DOUBLE, 1.0) + 0.30 * least(files / 10.0::DOUBLE, 1.0) + 0.20 * untested + 0.25 * guarded"


def _critical(spark, sf):
    tested = _tested(spark, sf).select("node").distinct().withColumn("t", F.lit(0.0))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), "p_brand", "p_type")
    j = _flows(spark, sf).join(p, "node").join(tested, "node", "left")
    c = j.groupBy("entry").agg(F.max("depth").alias("depth"), F.count("*").alias("n"), F.count_distinct("p_brand").alias("files"), F.avg(F.coalesce("t", F.lit(1.0))).alias("untested"), F.max(F.col("p_type").contains("PROMO").cast("double")).alias("guarded"))
    part = lambda x, most: F.least(F.col(x) / most, F.lit(1.0))
    return c.withColumn("criticality", F.round(0.10 * part("depth", 15.0) + 0.15 * part("n", 50.0) + 0.30 * part("files", 10.0) + 0.20 * F.col("untested") + 0.25 * F.col("guarded"), 6))


@query(f"WITH RECURSIVE {_CRIT_SQL} SELECT entry, round({_CRIT}, 6) AS criticality FROM c")
def flow_criticality(spark, sf):
    return _critical(spark, sf).select("entry", "criticality")


@query(f"WITH RECURSIVE {_CRIT_SQL} SELECT entry, CAST(n AS BIGINT) AS n, row_number() OVER (ORDER BY round({_CRIT}, 6) DESC, entry) AS rank FROM c WHERE n >= 2")
def flows_ranked(spark, sf):
    c = _critical(spark, sf).where("n >= 2")
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("criticality"), "entry"))).select("entry", "n", "rank")


@query("SELECT p_brand AS folder, count(*) AS symbols, count(DISTINCT p_type) AS kinds FROM part GROUP BY 1 HAVING count(*) >= 2")
def directory_communities(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("folder")).agg(F.count("*").alias("symbols"), F.count_distinct("p_type").alias("kinds")).where("symbols >= 2")


@query(f"WITH {PART_EDGES_SQL}, x AS (SELECT a.p_brand AS f, b.p_brand AS g FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst) SELECT f AS folder, count(*) AS calls, count(*) FILTER (f <> g) AS outward, count(DISTINCT g) FILTER (f <> g) AS partners FROM x GROUP BY 1")
def architecture_overview(spark, sf):
    p = table(spark, sf, "part")
    a, b = (p.select(F.col("p_partkey").alias(k), F.col("p_brand").alias(n)) for k, n in (("src", "folder"), ("dst", "g")))
    x = part_edges(spark, sf).join(a, "src").join(b, "dst")
    out = F.col("folder") != F.col("g")
    return x.groupBy("folder").agg(F.count("*").alias("calls"), F.count_if(out).alias("outward"), F.count_distinct(F.when(out, F.col("g"))).alias("partners"))


@query(f"WITH {PART_EDGES_SQL} SELECT DISTINCT b.p_brand AS file, a.p_brand AS dependent FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand")
def dependents(spark, sf):
    p = table(spark, sf, "part")
    a, b = (p.select(F.col("p_partkey").alias(k), F.col("p_brand").alias(n)) for k, n in (("src", "dependent"), ("dst", "file")))
    return part_edges(spark, sf).join(a, "src").join(b, "dst").where("file <> dependent").select("file", "dependent").distinct()


@query(f"""WITH {PART_EDGES_SQL}, t AS (SELECT p_partkey AS target, p_brand, p_type FROM part WHERE p_partkey % 40 = 0) SELECT 'callers_of' AS pattern, target, src AS node FROM t JOIN edges ON dst = target UNION ALL SELECT 'callees_of', target, dst FROM t JOIN edges ON src = target
UNION ALL SELECT 'contains', target, p_partkey FROM t JOIN part USING (p_brand) UNION ALL SELECT 'inherits', target, p_partkey FROM t JOIN part p ON p.p_type = t.p_type AND p.p_partkey <> target""")
def graph_patterns(spark, sf):
    """Callers, callees, file mates and kin of stated symbols."""
    e, p = part_edges(spark, sf), table(spark, sf, "part")
    t = p.where("p_partkey % 40 = 0").select(F.col("p_partkey").alias("target"), "p_brand", "p_type")
    named = lambda n, df: df.select(F.lit(n).alias("pattern"), "target", "node")
    return (
        named("callers_of", t.join(e, t.target == e.dst).withColumn("node", F.col("src")))
        .unionAll(named("callees_of", t.join(e, t.target == e.src).withColumn("node", F.col("dst"))))
        .unionAll(named("contains", t.join(p.select("p_brand", F.col("p_partkey").alias("node")), "p_brand")))
        .unionAll(named("inherits", t.join(p.select("p_type", F.col("p_partkey").alias("node")), "p_type").where("node <> target")))
    )


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS lines FROM part WHERE p_size >= 30 ORDER BY p_size DESC, p_partkey LIMIT 50")
def large_functions(spark, sf):
    return table(spark, sf, "part").where("p_size >= 30").select("p_partkey", F.col("p_size").cast("long").alias("lines")).orderBy(F.desc("lines"), "p_partkey").limit(50)


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%small%' AND lower(p_name) LIKE '%ring%'")
def code_keyword_search(spark, sf):
    """Symbols whose names hold every word of the query, ten at most."""
    out = table(spark, sf, "part")
    for word in "small ring".split()[:10]:
        out = out.where(F.lower("p_name").contains(word))
    return out.select("p_partkey")


@query(f"WITH {PART_EDGES_SQL}, {_TESTED_SQL}, d AS (SELECT dst AS node, count(*) AS callers FROM edges GROUP BY 1), r AS (SELECT p_partkey AS node, t.node IS NULL AS gap, round(0.6 * least(coalesce(callers, 0) / 20.0::DOUBLE, 1.0) + 0.4 * CASE WHEN t.node IS NULL THEN 1 ELSE 0 END, 6) AS risk FROM part LEFT JOIN d ON d.node = p_partkey LEFT JOIN tested t ON t.node = p_partkey WHERE p_partkey % 10 = 3) SELECT node, gap, risk FROM r ORDER BY risk DESC, node LIMIT 10")
def review_context(spark, sf):
    """The ten riskiest of the changed symbols, and whether they lack tests."""
    callers = part_edges(spark, sf).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    tested = _tested(spark, sf).select("node").distinct().withColumn("t", F.lit(True))
    j = table(spark, sf, "part").where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("node")).join(callers, "node", "left").join(tested, "node", "left")
    r = j.select("node", F.col("t").isNull().alias("gap"), F.round(0.6 * F.least(F.coalesce("n", F.lit(0)) / 20.0, F.lit(1.0)) + 0.4 * F.col("t").isNull().cast("int"), 6).alias("risk"))
    return r.orderBy(F.desc("risk"), "node").limit(10)


@query("SELECT CASE WHEN l_linestatus = 'F' THEN 'already_stale' WHEN p_partkey IS NULL THEN 'marked' ELSE 'verified' END AS state, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 2 GROUP BY 1")
def bulk_link_verify(spark, sf):
    """Links by whether their symbol is there still."""
    known = table(spark, sf, "part").where("p_size > 2").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("there"))
    j = table(spark, sf, "lineitem").select("l_partkey", "l_linestatus").join(known, "l_partkey", "left")
    return j.groupBy(F.when(F.col("l_linestatus") == "F", "already_stale").when(F.col("there").isNull(), "marked").otherwise("verified").alias("state")).agg(F.count("*").alias("n"))


# ---- the store path ------------------------------------------------------------


@query("SELECT user_id, max(ts) AS accessed, count(*) AS accesses, round(least(10.0::DOUBLE, 1.0 + 0.3 * ln(1.0::DOUBLE + count(*))), 6) AS strength, 1.0::DOUBLE AS retention FROM events WHERE event_type = 'view' GROUP BY 1")
def access_event(spark, sf):
    e = events(spark, sf).where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").cast("timestamp_ntz").alias("accessed"), F.count("*").alias("accesses"))
    return e.withColumn("strength", F.round(F.least(F.lit(10.0), 1.0 + 0.3 * F.log(1.0 + F.col("accesses"))), 6)).withColumn("retention", F.lit(1.0))


@query(f"WITH {FACTS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY fact_type ORDER BY importance DESC, fact_id) AS k FROM facts) SELECT fact_type AS block, substr(string_agg(substr(content, 1, 120), ' ' ORDER BY k), 1, 500) AS body FROM k WHERE k <= 5 GROUP BY 1")
def core_blocks(spark, sf):
    """Blocks of the five foremost facts of a kind, 500 characters each."""
    k = _rank(facts(spark, sf), ["fact_type"], [F.desc("importance"), "fact_id"], "k").where("k <= 5")
    rows = F.array_sort(F.collect_list(F.struct("k", F.substring(F.coalesce("content", F.lit("")), 1, 120).alias("c"))))
    return k.groupBy(F.col("fact_type").alias("block")).agg(F.substring(F.array_join(F.transform(rows, lambda x: x["c"]), " "), 1, 500).alias("body"))


@query(f"WITH {FACTS_SQL} SELECT profile_id, session_id, count(*) AS n, round(avg(confidence), 6) AS confidence, 0.8::DOUBLE AS importance FROM facts WHERE fact_id % 6 IN (1, 2) GROUP BY 1, 2 HAVING count(*) >= 3")
def cluster_merge(spark, sf):
    """Three facts or more of a cluster become one of their mean confidence."""
    f = facts(spark, sf).where("fact_id % 6 IN (1, 2)")
    return f.groupBy("profile_id", "session_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence")).where("n >= 3").withColumn("importance", F.lit(0.8))


_DUP_SQL = f"{FACTS_SQL}, d AS (SELECT fact_id, md5(content) AS h, row_number() OVER (PARTITION BY md5(content) ORDER BY importance DESC, confidence DESC, created_on, fact_id) AS k, first_value(fact_id) OVER (PARTITION BY md5(content) ORDER BY importance DESC, confidence DESC, created_on, fact_id) AS winner FROM facts WHERE content IS NOT NULL)"


def _merged(spark, sf):
    order = [F.desc("importance"), F.desc("confidence"), "created_on", "fact_id"]
    w = Window.partitionBy("h").orderBy(*order)
    f = facts(spark, sf).where("content IS NOT NULL").withColumn("h", F.md5("content"))
    return f.withColumn("k", F.row_number().over(w)).withColumn("winner", F.first("fact_id").over(w))


@query(f"WITH {_DUP_SQL} SELECT fact_id, winner AS merged_into, 'merged' AS archive_status, TRUE AS reversible FROM d WHERE k > 1")
def apply_merges(spark, sf):
    return _merged(spark, sf).where("k > 1").select("fact_id", F.col("winner").alias("merged_into"), F.lit("merged").alias("archive_status"), F.lit(True).alias("reversible"))


@query(f"WITH {_DUP_SQL} SELECT fact_id, CASE WHEN k > 1 AND fact_id % 2 = 1 THEN 'merged' ELSE 'live' END AS archive_status FROM d")
def unmerge(spark, sf):
    """The state after the even losers' merges are taken back."""
    return _merged(spark, sf).select("fact_id", F.when((F.col("k") > 1) & (F.col("fact_id") % 2 == 1), "merged").otherwise("live").alias("archive_status"))


@query("""SELECT o_orderkey AS fact_id, lead(o_orderdate) OVER w AS valid_until, lead(o_orderdate) OVER w IS NOT NULL AS invalidated FROM orders WHERE o_orderstatus <> 'P' WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)""")
def temporal_invalidation(spark, sf):
    """A newer claim of the same kind closes the older one when it comes."""
    until = F.lead("o_orderdate").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("fact_id"), until.alias("valid_until"), until.isNotNull().alias("invalidated"))


@query("SELECT l_suppkey, round((1.0 + count(*) FILTER (l_returnflag = 'N')) / (2.0::DOUBLE + count(*) FILTER (l_returnflag = 'N') + 3 * count(*) FILTER (l_returnflag = 'R')), 6) AS trust FROM lineitem GROUP BY 1")
def trust_on_contradiction(spark, sf):
    """Each contradiction counts three against a source."""
    good, bad = (F.count_if(F.col("l_returnflag") == f) for f in "NR")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round((1.0 + good) / (2.0 + good + 3 * bad), 6).alias("trust"))


@query(f"WITH {FACTS_SQL} SELECT session_id, profile_id AS entity, count(*) AS n, min(fact_id) AS first, max(fact_id) AS last FROM facts GROUP BY 1, 2")
def session_close(spark, sf):
    return facts(spark, sf).groupBy("session_id", F.col("profile_id").alias("entity")).agg(F.count("*").alias("n"), F.min("fact_id").alias("first"), F.max("fact_id").alias("last"))


@query("SELECT doc_id AS fact_id, source AS created_by, lang AS source_type, substr(md5(concat_ws(':', source, lang, CAST(doc_id AS VARCHAR))), 1, 12) AS record_id FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def provenance_by_source(spark, sf):
    d = table(spark, sf, "documents").where("source IN ('src1', 'src2', 'src3')")
    return d.select(F.col("doc_id").alias("fact_id"), F.col("source").alias("created_by"), F.col("lang").alias("source_type"), F.substring(F.md5(F.concat_ws(":", "source", "lang", "doc_id")), 1, 12).alias("record_id"))


@query("""SELECT p.event_id, count(s.event_id) AS signals, round(CASE WHEN count(s.event_id) = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, sum(s.v))) END, 6) AS label FROM (SELECT * FROM events WHERE event_type = 'view') p LEFT JOIN (SELECT *, value / 100 AS v FROM events WHERE event_type = 'click') s
ON s.user_id = p.user_id AND s.ts > p.ts AND s.ts <= p.ts + INTERVAL 2 HOUR GROUP BY 1""")
def pending_outcomes(spark, sf):
    """Pending records with the signals that came within their time to live, and their final label."""
    from engramlake.operators import relational as R

    e = events(spark, sf)
    p = e.where("event_type = 'view'").select("event_id", "user_id", F.col("ts").alias("at"))
    s = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("later"), (F.col("value") / 100).alias("v"))
    got = R.within(p, s, ["user_id"], "at", "later", 2 * 3600).groupBy("event_id").agg(F.count("*").alias("signals"), F.sum("v").alias("v"))
    return p.select("event_id").join(got, "event_id", "left").select("event_id", F.coalesce("signals", F.lit(0)).alias("signals"), F.round(F.coalesce(S.clip(F.col("v"), 0.0, 1.0), F.lit(0.5)), 6).alias("label"))


@query("SELECT user_id, round(exp(-(user_id % 30) * 24 / greatest(48.0::DOUBLE, 2 * n)), 6) AS retention, exp(-(user_id % 30) * 24 / greatest(48.0::DOUBLE, 2 * n)) >= 0.1 AS active FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def prompt_retention(spark, sf):
    r = F.exp(-(F.col("user_id") % 30) * 24 / F.greatest(F.lit(48.0), 2.0 * F.col("n")))
    return events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.round(r, 6).alias("retention"), (r >= 0.1).alias("active"))


@query("SELECT user_id, CASE WHEN d > 0.1 THEN 'replace' WHEN d < -0.1 THEN 'keep' ELSE 'review' END AS action FROM (SELECT user_id, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') / 100 - avg(value) FILTER (ts < TIMESTAMP '2024-01-16') / 100 AS d FROM events GROUP BY 1)")
def prompt_evolution(spark, sf):
    side = lambda c: F.avg(F.when(c, F.col("value"))) / 100
    d = events(spark, sf).groupBy("user_id").agg((side(F.col("ts") >= "2024-01-16") - side(F.col("ts") < "2024-01-16")).alias("d"))
    return d.select("user_id", F.when(F.col("d") > 0.1, "replace").when(F.col("d") < -0.1, "keep").otherwise("review").alias("action"))


@query("""WITH p AS (SELECT user_id, event_type, count(*) * 40 AS tokens, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 5 END AS priority FROM events WHERE event_id % 10 = 0 GROUP BY 1, 2), c AS (SELECT *, sum(tokens) OVER (PARTITION BY user_id ORDER BY priority) AS used FROM p)
SELECT user_id, string_agg(event_type, ' ' ORDER BY priority) AS prompt FROM c WHERE used <= 500 GROUP BY 1""")
def prompt_assembly(spark, sf):
    """Templates in order of priority as far as 500 tokens go."""
    order = ("purchase", "signup", "click", "view", "error")
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("event_type"))
    p = events(spark, sf).where("event_id % 10 = 0").groupBy("user_id", "event_type").agg((F.count("*") * 40).alias("tokens")).withColumn("priority", rank)
    c = p.withColumn("used", F.sum("tokens").over(Window.partitionBy("user_id").orderBy("priority"))).where("used <= 500")
    return c.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", "event_type"))), lambda x: x["event_type"]), " ").alias("prompt"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(ts AS DATE) WHEN 1 THEN CAST(ts AS DATE) - 1 WHEN 2 THEN DATE '2024-01-01' END AS day FROM events WHERE event_id % 4 < 3")
def temporal_event_builder(spark, sf):
    """A day by precedence: from the text, from the session, from the fact; none makes no event."""
    k, day = F.col("event_id") % 4, F.to_date("ts")
    e = events(spark, sf).select("event_id", F.when(k == 1, F.date_add(day, -1)).alias("text"), F.when(k == 0, day).alias("session"), F.when(k == 2, F.lit("2024-01-01").cast("date")).alias("fact"))
    return e.select("event_id", F.coalesce("text", "session", "fact").alias("day")).where("day IS NOT NULL")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END NULLS LAST, o_totalprice, o_orderkey) AS place FROM orders")
def entity_timeline_order(spark, sf):
    when = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate"))
    return _rank(table(spark, sf, "orders"), ["o_custkey"], [when.asc_nulls_last(), "o_totalprice", "o_orderkey"], "place").select("o_custkey", "o_orderkey", "place")


@query("SELECT o_orderkey, o_orderstatus AS action FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def consolidation_history(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey", F.col("o_orderstatus").alias("action"))


@query("SELECT s.event_id, CAST(json_extract(s.props, '$.k') AS BIGINT) AS feature, l.l_returnflag AS outcome FROM events s LEFT JOIN lineitem l ON l.l_orderkey = s.event_id AND l.l_linenumber = 1 AND l.l_shipdate < TIMESTAMP '1998-06-01' WHERE s.event_type <> 'error' AND s.event_id % 2 = 0")
def training_examples(spark, sf):
    """Signals with their features, and the settled outcomes there are."""
    s = events(spark, sf).where("event_type <> 'error' AND event_id % 2 = 0").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("feature"))
    o = table(spark, sf, "lineitem").where("l_linenumber = 1 AND l_shipdate < TIMESTAMP'1998-06-01 00:00:00'").select(F.col("l_orderkey").alias("event_id"), F.col("l_returnflag").alias("outcome"))
    return s.join(o, "event_id", "left")


@query("SELECT user_id, event_type, substr(sha256(CAST(user_id AS VARCHAR) || ':' || event_type), 1, 16) AS id, round(1 - (1 - least(0.4::DOUBLE + (user_id % 5) / 10.0::DOUBLE, 0.7::DOUBLE)) * pow(0.85::DOUBLE, count(*) - 1), 6) AS confidence FROM events GROUP BY 1, 2")
def assertion_upsert(spark, sf):
    """A first sight counts .7 at most; each later one closes .15 of what lacks: a closed form of the fold."""
    n = events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    first = F.least(0.4 + (F.col("user_id") % 5) / 10.0, F.lit(0.7))
    return n.select("user_id", "event_type", F.substring(F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), "event_type"), 256), 1, 16).alias("id"), F.round(1 - (1 - first) * F.pow(F.lit(0.85), F.col("n") - 1), 6).alias("confidence"))


@query(f"WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), p AS (SELECT a.l_suppkey AS node, b.l_suppkey AS other, count(*) AS n FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2) SELECT node, other, n FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, other) AS k FROM p) WHERE k <= 5")
def co_retrieval_neighbours(spark, sf):
    lines = table(spark, sf, "lineitem")
    s = R.dealt(lines.select("l_orderkey", "l_suppkey").distinct(), lines.count(), "l_orderkey")
    p = s.withColumnRenamed("l_suppkey", "node").join(s.withColumnRenamed("l_suppkey", "other"), "l_orderkey").where("node <> other").groupBy("node", "other").agg(F.count("*").alias("n"))
    return _rank(p, ["node"], [F.desc("n"), "other"], "k").where("k <= 5").drop("k")


@query("SELECT event_id, CASE WHEN event_type = 'view' AND (user_id, CAST(hour(ts) AS BIGINT)) IN (SELECT (user_id, CAST(hour(ts) AS BIGINT)) FROM events WHERE event_type = 'click') THEN 'shown_clicked' ELSE event_type END AS signal_type FROM events")
def shown_flip(spark, sf):
    """Shown results whose query saw a click change their type."""
    e = events(spark, sf).withColumn("h", F.hour("ts"))
    hit = e.where("event_type = 'click'").select("user_id", "h").distinct().withColumn("hit", F.lit(True))
    return e.join(hit, ["user_id", "h"], "left").select("event_id", F.when((F.col("event_type") == "view") & F.col("hit"), "shown_clicked").otherwise(F.col("event_type")).alias("signal_type"))


@query(f"WITH {FACTS_SQL}, s AS (SELECT session_id, fact_id, trim(regexp_extract(content, '[^.!?]+[.!?]*', 0), ' ' || chr(10) || chr(13) || chr(9)) AS s, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, fact_id) AS k FROM facts) SELECT session_id, substr(string_agg(s, ' ' ORDER BY k), 1, 300) AS summary FROM s WHERE k <= 3 GROUP BY 1")
def heuristic_summary(spark, sf):
    """First sentences of a session's three foremost texts, 300 characters."""
    f = _rank(facts(spark, sf), ["session_id"], [F.desc("importance"), "fact_id"], "k").where("k <= 3")
    first = F.btrim(F.regexp_extract("content", r"[^.!?]+[.!?]*", 0), F.lit(" \n\r\t"))
    rows = F.array_sort(F.collect_list(F.struct("k", first.alias("s"))))
    return f.groupBy("session_id").agg(F.substring(F.array_join(F.transform(rows, lambda x: x["s"]), " "), 1, 300).alias("summary"))


@query(f"WITH {PART_EDGES_SQL}, n AS (SELECT p_partkey AS node, p_retailprice AS importance FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 60) SELECT src, dst, weight FROM edges WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n) ORDER BY weight DESC, src, dst LIMIT 200")
def knowledge_graph_view(spark, sf):
    """Edges among the sixty foremost nodes, the heaviest first."""
    n = F.broadcast(table(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(60).select(F.col("p_partkey").alias("node")))  # 60 rows
    e = part_edges(spark, sf).join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return e.select("src", "dst", "weight").orderBy(F.desc("weight"), "src", "dst").limit(200)


@query("SELECT fact_id, CASE WHEN pinned THEN 'active' ELSE zone END AS zone FROM (SELECT doc_id AS fact_id, doc_id % 25 = 0 AS pinned, CASE doc_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'warm' ELSE 'cold' END AS zone FROM documents)")
def pin_unpin(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("fact_id"))
    zone = F.when(F.col("fact_id") % 3 == 0, "active").when(F.col("fact_id") % 3 == 1, "warm").otherwise("cold")
    return d.select("fact_id", F.when(F.col("fact_id") % 25 == 0, "active").otherwise(zone).alias("zone"))


@query("SELECT event_id FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events) WHERE n IS NULL OR n - ts > INTERVAL 3 HOUR")
def watcher_debounce(spark, sf):
    return S.debounced(events(spark, sf).select("event_id", "user_id", "ts"), "user_id", "ts", "3 HOURS").select("event_id")


@query("""WITH q AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'bulk' ELSE 'interactive' END AS lane FROM events WHERE user_id < 5), k AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY event_id) AS k FROM q) SELECT event_id, lane, row_number() OVER (ORDER BY round(k / CASE lane WHEN 'bulk' THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END, 9), lane) AS place FROM k""")
def weighted_lanes(spark, sf):
    q = events(spark, sf).where("user_id < 5").select("event_id", F.when(F.col("event_id") % 3 == 0, "bulk").otherwise("interactive").alias("lane"))
    return S.fair_order(q, "lane", "event_id", {"interactive": 0.7, "bulk": 0.3})


@query("""WITH r AS (SELECT event_id, user_id, event_type, CAST(hour(ts) AS BIGINT) AS h, CAST(ts AS DATE) AS d FROM events) SELECT min(event_id) AS request, count(*) AS subscribers, CASE WHEN count(*) > 3 THEN 'dead' WHEN min(event_id) % 2 = 0 THEN 'claimed' ELSE 'queued' END AS state FROM r GROUP BY user_id, event_type, h, d""")
def request_queue(spark, sf):
    """Equal requests of an hour are one with subscribers; too many tries are dead letters."""
    r = events(spark, sf).groupBy("user_id", "event_type", F.hour("ts"), F.to_date("ts")).agg(F.min("event_id").alias("request"), F.count("*").alias("subscribers"))
    return r.select("request", "subscribers", F.when(F.col("subscribers") > 3, "dead").when(F.col("request") % 2 == 0, "claimed").otherwise("queued").alias("state"))


@query("SELECT user_id, event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last FROM events) WHERE ts > last - INTERVAL 1 HOUR")
def ttl_cache(spark, sf):
    """Entries of a key's last hour; older ones have expired."""
    last = F.max("ts").over(Window.partitionBy("user_id"))
    return events(spark, sf).withColumn("last", last).where(F.col("ts") > F.col("last") - F.expr("INTERVAL 1 HOUR")).select("user_id", "event_id")


@query()
def hmac_markers(spark, sf):
    """Results with the first eight digits of a keyed hash; tests compare with the standard library."""
    return table(spark, sf, "benchmark").select("item_id", F.substring(S.hmac_sha256(F.col("text"), "local-key"), 1, 8).alias("marker"))
