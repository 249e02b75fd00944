"""Routing, linking, merging and the learning cycle over the memory model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramlake.functions import vectors as V
from engramlake.operators import encoding as E
from engramlake.operators import graph as G
from engramlake.operators import store as S
from engramlake.plans.math_queries import COS, VEC_SQL
from engramlake.plans.registry import ORACLES, query
from engramlake.sources.scratch import written
from engramlake.sources.tables import FACTS_SQL, NOTES_SQL, PART_EDGES_SQL, events, facts, notes, part_edges, table, vectors


def _rank(df, by, order, name="rank"):
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


@query(f"""WITH {VEC_SQL}, t AS (SELECT fact_id % 4 AS kind, v FROM vec WHERE fact_id < 20), s AS (SELECT f.fact_id, kind, round(avg({COS}(f.v, t.v)), 9) AS s FROM vec f, t GROUP BY 1, 2)
SELECT fact_id, CASE kind WHEN 0 THEN 'semantic' WHEN 1 THEN 'episodic' WHEN 2 THEN 'opinion' ELSE 'temporal' END AS fact_type FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY s DESC, kind) AS k FROM s) WHERE k = 1""")
def embedding_type_router(spark, sf):
    """The kind whose five templates are nearest in the mean; twenty templates in all."""
    v = vectors(spark, sf).select("fact_id", "v")
    t = F.broadcast(v.where("fact_id < 20").select((F.col("fact_id") % 4).alias("kind"), F.col("v").alias("t")))  # twenty rows
    s = v.crossJoin(t).groupBy("fact_id", "kind").agg(F.round(F.avg(V.cosine(F.col("v"), F.col("t"))), 9).alias("s"))
    best = s.groupBy("fact_id").agg(F.max_by("kind", F.struct("s", -F.col("kind"))).alias("kind"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("semantic", "episodic", "opinion", "temporal")]), (F.col("kind") + 1).cast("int"))
    return best.select("fact_id", name.alias("fact_type"))


@query(f"WITH {FACTS_SQL} SELECT fact_id, CASE WHEN a <= 0.2 THEN 0.0::DOUBLE ELSE round(least(0.3::DOUBLE, 0.3::DOUBLE * a), 6) END AS boost FROM (SELECT fact_id, (fact_id % 11) / 10.0::DOUBLE AS a FROM facts)")
def emotion_boost(spark, sf):
    a = (F.col("fact_id") % 11) / 10.0
    return facts(spark, sf).select("fact_id", F.when(a <= 0.2, 0.0).otherwise(F.round(F.least(F.lit(0.3), 0.3 * a), 6)).alias("boost"))


#: Which words tell a category; the first that has one counts.
CATEGORIES = {"avoidance": ("no", "never", "failed"), "decision": ("planning", "moved"), "identity": ("works",), "tech": ("pytest", "schema", "config"), "style": ("please", "thanks,")}


@query(f"WITH {NOTES_SQL}, w AS (SELECT note_id, string_split(lower(content), ' ') AS w FROM notes) SELECT note_id, CASE {' '.join(f'WHEN list_has_any(w, {list(ws)}) THEN {k!r}' for k, ws in CATEGORIES.items())} ELSE 'custom' END AS category FROM w")
def text_categories(spark, sf):
    w = F.split(F.lower("content"), " ")
    out = F.lit("custom")
    for kind, words in reversed(CATEGORIES.items()):
        out = F.when(F.arrays_overlap(w, F.array(*[F.lit(x) for x in words])), kind).otherwise(out)
    return notes(spark, sf).select("note_id", out.alias("category"))


@query(f"WITH {PART_EDGES_SQL}, o AS (SELECT a.src AS a, b.src AS b, count(*) AS n FROM edges a JOIN edges b ON a.dst = b.dst AND a.src < b.src WHERE a.weight >= 2 AND b.weight >= 2 GROUP BY 1, 2) SELECT a, b, round(least(0.3::DOUBLE + 0.1::DOUBLE * n, 0.8::DOUBLE), 6) AS weight FROM o")
def neighbourhood_overlap(spark, sf):
    """Callers of common symbols, by how many they share."""
    e = part_edges(spark, sf).where("weight >= 2").select("src", "dst")
    o = e.withColumnRenamed("src", "a").join(e.withColumnRenamed("src", "b"), "dst").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return o.select("a", "b", F.round(F.least(0.3 + 0.1 * F.col("n"), F.lit(0.8)), 6).alias("weight"))


@query(f"WITH {FACTS_SQL} SELECT session_id AS entity, count(*) AS n FROM facts WHERE fact_id % 6 IN (1, 2) AND fact_id % 50 <> 0 GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, entity LIMIT 10")
def entity_clusters(spark, sf):
    n = facts(spark, sf).where("fact_id % 6 IN (1, 2) AND fact_id % 50 <> 0").groupBy(F.col("session_id").alias("entity")).agg(F.count("*").alias("n")).where("n >= 3")
    return n.orderBy(F.desc("n"), "entity").limit(10)


@query("SELECT o_custkey, o_orderkey, round(exp(-(d * d) / 1800.0::DOUBLE), 6) AS score FROM (SELECT o_custkey, o_orderkey, CAST(date_diff('day', DATE '1997-06-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS d FROM orders JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 50 IN (1, 2, 3)) ON c_custkey = o_custkey) WHERE abs(d) <= 365")
def entity_temporal_channel(spark, sf):
    """Dated facts of the query's first three names, by nearness of their dates."""
    names = table(spark, sf, "customer").where("c_custkey % 50 IN (1, 2, 3)").select(F.col("c_custkey").alias("o_custkey"))
    d = F.datediff(F.to_date("o_orderdate"), F.lit("1997-06-01").cast("date")).cast("double")
    o = table(spark, sf, "orders").join(names, "o_custkey", "left_semi").withColumn("d", d).where("abs(d) <= 365")
    return o.select("o_custkey", "o_orderkey", F.round(V.date_proximity(F.col("d")), 6).alias("score"))


_TYPED_SQL = f"{PART_EDGES_SQL}, typed AS (SELECT src, dst, CASE (src + dst) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS mu FROM edges WHERE weight >= 2), d0 AS (SELECT p_partkey AS node, 1.0::DOUBLE AS a FROM part WHERE p_partkey % 50 = 0)"


@query(f"WITH {_TYPED_SQL}" + "".join(f", d{k} AS (SELECT dst AS node, max(0.7::DOUBLE * mu * a) AS a FROM d{k - 1} JOIN typed ON src = node GROUP BY 1 HAVING max(0.7::DOUBLE * mu * a) >= 0.05)" for k in range(1, 5)) + " SELECT node, round(max(a), 6) AS activation FROM (" + " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(5)) + ") GROUP BY 1 ORDER BY activation DESC, node LIMIT 50")
def typed_spreading(spark, sf):
    """Activation that decays by the kind of edge, four steps, the strongest way, fifty nodes."""
    kind = (F.col("src") + F.col("dst")) % 3
    e = part_edges(spark, sf).where("weight >= 2").select("src", "dst", F.when(kind == 0, 1.0).when(kind == 1, 0.8).otherwise(0.5).alias("weight"))
    seeds = table(spark, sf, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("node"), F.lit(1.0).alias("activation"))
    return S.activate(seeds, e, 4).select("node", F.round("activation", 6).alias("activation")).orderBy(F.desc("activation"), "node").limit(50)


@query("WITH s AS (SELECT user_id, event_id, value / 100 AS b, (event_id % 13) / 13.0::DOUBLE AS m FROM events WHERE event_type = 'signup'), z AS (SELECT user_id, sum(exp(b)) AS zb, sum(exp(m)) AS zm FROM s GROUP BY 1) SELECT user_id, event_id, round(0.4 * exp(b) / zb + 0.6 * exp(m) / zm, 6) AS score FROM s JOIN z USING (user_id)")
def ensemble_rerank(spark, sf):
    """Softmax of the bandit's and of the model's scores, blended."""
    s = events(spark, sf).where("event_type = 'signup'").select("user_id", "event_id", F.exp(F.col("value") / 100).alias("b"), F.exp((F.col("event_id") % 13) / 13.0).alias("m"))
    z = s.groupBy("user_id").agg(F.sum("b").alias("zb"), F.sum("m").alias("zm"))
    return s.join(z, "user_id").select("user_id", "event_id", F.round(0.4 * F.col("b") / F.col("zb") + 0.6 * F.col("m") / F.col("zm"), 6).alias("score"))


@query(f"WITH pr AS ({ORACLES['pagerank']}), lp AS ({ORACLES['label_propagation']}), {PART_EDGES_SQL}, d AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) SELECT node, rank, label AS community, round(d / (count(*) OVER () - 1.0::DOUBLE), 4) AS degree FROM pr JOIN lp USING (node) JOIN d USING (node)")
def importance_table(spark, sf):
    """Rank, community and degree of every node, one row each."""
    e = written(part_edges(spark, sf), "edges")  # three operators read them
    rank = G.pagerank(e, rounds=8).select("node", F.round("rank", 6).alias("rank"))
    label = G.label_propagation(e, rounds=3).select("node", F.col("label").alias("community"))
    return rank.join(label, "node").join(G.degree_centrality(e).select("node", F.round("centrality", 4).alias("degree")), "node")


@query(f"WITH {VEC_SQL}, p AS (SELECT a.fact_id, b.fact_id AS other, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) + sqrt(list_sum(list_transform(b.v, lambda x: x * x)))) AS d FROM vec a JOIN vec b ON b.fact_id IN (a.fact_id + 1, a.fact_id + 2)) SELECT fact_id, other, round(d, 6) AS severity FROM p WHERE d > 0.7")
def contradiction_edges(spark, sf):
    """Neighbours whose vectors disagree, with the clipped severity as weight."""
    v = vectors(spark, sf).select("fact_id", "v")
    b = v.select(F.explode(F.array(F.col("fact_id") - 1, F.col("fact_id") - 2)).alias("fact_id"), F.col("fact_id").alias("other"), F.col("v").alias("w"))
    d = V.norm(F.zip_with("v", "w", lambda x, y: x - y)) / (V.norm(F.col("v")) + V.norm(F.col("w")))
    return v.join(b, "fact_id").withColumn("d", d).where("d > 0.7").select("fact_id", "other", F.round(S.clip(F.col("d"), 0.0, 1.0), 6).alias("severity"))


@query(f"WITH {NOTES_SQL}, s AS (SELECT user_id, trim(unnest(string_split(content, ','))) AS s, note_id FROM notes), d AS (SELECT user_id, s, min(note_id) AS n FROM s WHERE s <> '' GROUP BY 1, 2) SELECT user_id, substr(string_agg(s, '. ' ORDER BY n, s), 1, 2000) AS merged FROM d GROUP BY 1")
def extractive_merge(spark, sf):
    """The distinct clauses of a cluster in order of first sight, 2000 characters."""
    s = notes(spark, sf).select("user_id", "note_id", F.explode(F.split("content", ",")).alias("s")).withColumn("s", F.trim("s")).where("s <> ''")
    d = s.groupBy("user_id", "s").agg(F.min("note_id").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("n", "s")))
    return d.groupBy("user_id").agg(F.substring(F.array_join(F.transform(rows, lambda x: x["s"]), ". "), 1, 2000).alias("merged"))


@query(f"WITH {FACTS_SQL}, l AS (SELECT session_id, fact_id, CASE WHEN access_count >= 10 OR importance >= 0.8 THEN 1 WHEN access_count = 0 THEN 0 END AS label FROM facts), k AS (SELECT *, row_number() OVER (PARTITION BY session_id, label ORDER BY fact_id) AS k FROM l WHERE label IS NOT NULL) SELECT session_id, fact_id, label FROM k WHERE k <= 20")
def implicit_labels(spark, sf):
    """Labels from use and importance, twenty of a kind from each source."""
    label = F.when((F.col("access_count") >= 10) | (F.col("importance") >= 0.8), 1).when(F.col("access_count") == 0, 0)
    l = facts(spark, sf).select("session_id", "fact_id", label.alias("label")).where("label IS NOT NULL")
    return _rank(l, ["session_id", "label"], ["fact_id"], "k").where("k <= 20").drop("k")


@query("SELECT a.p_partkey AS target, b.p_partkey AS closest FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey <> b.p_partkey QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY CASE WHEN a.p_brand = b.p_brand THEN 0 WHEN a.p_type = b.p_type THEN 1 ELSE 2 END, b.p_partkey) = 1")
def closest_path(spark, sf):
    """Of the symbols of a name, the one least far in the tree of files."""
    p = table(spark, sf, "part")
    a = p.select(F.col("p_partkey").alias("target"), "p_name", "p_brand", "p_type")
    # the two smallest of a name, and of a name in a file or folder, hold the nearest: nothing else meets
    near = lambda far, keys: a.select("target", *keys).join(_rank(p.select("p_partkey", *keys).distinct(), keys, ["p_partkey"], "k").where("k <= 2"), keys).where("target <> p_partkey").select("target", F.lit(far).alias("far"), "p_partkey")
    j = near(0, ["p_name", "p_brand"]).unionByName(near(1, ["p_name", "p_type"])).unionByName(near(2, ["p_name"]))
    return j.groupBy("target").agg(F.min(F.struct("far", "p_partkey")).alias("m")).select("target", F.col("m.p_partkey").alias("closest"))


@query(f"WITH {PART_EDGES_SQL}, c AS (SELECT p_partkey AS node FROM part WHERE md5(p_name || p_brand) < '1') SELECT node, 'changed' AS why FROM c UNION ALL SELECT DISTINCT src, 'dependent' FROM edges JOIN c ON dst = node WHERE src NOT IN (SELECT node FROM c)")
def incremental_update(spark, sf):
    """What to parse again: symbols whose digest changed, and what depends on them."""
    c = table(spark, sf, "part").where(F.md5(F.concat("p_name", "p_brand")) < "1").select(F.col("p_partkey").alias("node"))
    more = part_edges(spark, sf).join(c, F.col("dst") == F.col("node"), "left_semi").select(F.col("src").alias("node")).distinct().join(c, "node", "left_anti")
    return c.withColumn("why", F.lit("changed")).unionByName(more.withColumn("why", F.lit("dependent")))


@query("""WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS w FROM documents), k AS (SELECT w, min(p_partkey) AS symbol FROM (SELECT unnest(['that', 'with', 'from', 'thing']) AS w, unnest([1, 2, 3, 4]) AS p_partkey) GROUP BY 1)
SELECT doc_id, symbol, 0.9::DOUBLE AS confidence FROM m JOIN k USING (w)""")
def mention_resolver(spark, sf):
    """Words of texts that are names of symbols, exact matches at .9."""
    m = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("w"))
    names = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in ("that", "with", "from", "thing")])).alias("p", "w")).select("w", (F.col("p") + 1).alias("symbol"))
    return m.join(names, "w").select("doc_id", "symbol", F.lit(0.9).alias("confidence"))


@query(f"WITH {VEC_SQL} SELECT community, count(*) AS n, CASE WHEN count(*) > 100000 THEN 'skip' WHEN count(*) > 10000 THEN 'prefilter' ELSE 'whole' END AS mode, count(*) FILTER (len(v) = 64) AS fit FROM vec GROUP BY 1")
def hopfield_gates(spark, sf):
    n = vectors(spark, sf).groupBy("community").agg(F.count("*").alias("n"), F.count_if(F.size("v") == 64).alias("fit"))
    return n.withColumn("mode", F.when(F.col("n") > 100_000, "skip").when(F.col("n") > 10_000, "prefilter").otherwise("whole"))


@query(f"WITH {VEC_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY fact_id DESC) AS k FROM vec WHERE len(v) = 64) SELECT fact_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))), 6) AS total FROM k WHERE k <= 5000")
def memory_matrix(spark, sf):
    """The newest 5000 vectors of the right length, of unit length."""
    v = vectors(spark, sf).where(F.size("v") == 64).orderBy(F.desc("fact_id")).limit(5000)
    return v.select("fact_id", F.round(F.aggregate(V.fisher_mean(F.col("v")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {FACTS_SQL}, a AS (SELECT fact_id, CASE WHEN fact_id % 25 = 0 THEN 'skip' WHEN access_count > 10 THEN 'up' WHEN access_count < 5 THEN 'down' ELSE 'keep' END AS action FROM facts) SELECT action, count(*) AS n FROM a GROUP BY 1")
def precision_scheduler(spark, sf):
    """How many facts go up and down in precision; core facts are left alone."""
    n = F.col("access_count")
    action = F.when(F.col("fact_id") % 25 == 0, "skip").when(n > 10, "up").when(n < 5, "down").otherwise("keep")
    return facts(spark, sf).groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, role AS name, min(turn) AS first, count(*) AS said FROM conversations GROUP BY 1, 2")
def speaker_entities(spark, sf):
    """Speakers become entities where they are first heard."""
    return table(spark, sf, "conversations").groupBy("conv_id", F.col("role").alias("name")).agg(F.min("turn").alias("first"), F.count("*").alias("said"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_name = 'small ring') AND l_orderkey < 2000")
def entity_erasure(spark, sf):
    """What is left of the bridge when an entity goes, by all its keys."""
    gone = table(spark, sf, "part").where("p_name = 'small ring'").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").where("l_orderkey < 2000").select("l_orderkey", "l_linenumber", "l_partkey").join(gone, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber")


@query(f"WITH {FACTS_SQL} SELECT profile_id, substr(content, 1, 100) AS prefix, count(*) AS n FROM facts WHERE importance < 0.99 AND content IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def merge_candidates(spark, sf):
    """Live facts with a common beginning, where there is no index of vectors."""
    f = facts(spark, sf).where("importance < 0.99 AND content IS NOT NULL")
    return f.groupBy("profile_id", F.substring("content", 1, 100).alias("prefix")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'a' WHEN '2-HIGH' THEN 'b' ELSE 'c' END AS mode, o_orderstatus <> 'P' AS deterministic, count(*) AS n FROM orders GROUP BY 1, 2")
def compliance_report(spark, sf):
    """Operations by mode and whether they are deterministic."""
    mode = F.when(F.col("o_orderpriority") == "1-URGENT", "a").when(F.col("o_orderpriority") == "2-HIGH", "b").otherwise("c")
    return table(spark, sf, "orders").groupBy(mode.alias("mode"), (F.col("o_orderstatus") != "P").alias("deterministic")).agg(F.count("*").alias("n"))


@query(f"WITH {FACTS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY profile_id, session_id ORDER BY importance DESC, confidence DESC, fact_id) AS k FROM facts), c AS (SELECT profile_id, string_agg(DISTINCT trim(regexp_extract(content, '[^.!?]+[.!?]*', 0), ' ' || chr(10) || chr(13) || chr(9)), ' ') AS x, count(*) AS n, round(avg(confidence), 6) AS confidence FROM k WHERE k <= 3 GROUP BY 1) SELECT profile_id AS entity, n, confidence FROM c")
def entity_compile(spark, sf):
    """How many first sentences (three a community) tell of an entity, and their mean confidence."""
    k = _rank(facts(spark, sf), ["profile_id", "session_id"], [F.desc("importance"), F.desc("confidence"), "fact_id"], "k").where("k <= 3")
    return k.groupBy(F.col("profile_id").alias("entity")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))
