"""Queries whose rules depend on order: the gate, scenes and the consolidation of fading facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.functions import language as L
from engramlake.operators import consolidate as C
from engramlake.operators import ordered as O
from engramlake.plans.index_queries import text_vectors
from engramlake.plans.registry import query
from engramlake.sources.tables import facts, table


def _with_vectors(spark, sf):
    f = facts(spark, sf)
    theme = text_vectors(f.select("fact_id", F.substring("content", 1, 200).alias("content"))).withColumnRenamed("v", "theme")
    return f.select("fact_id", "profile_id", "created_on", "content").join(text_vectors(f), "fact_id").join(theme, "fact_id")


@query()
def entropy_gate(spark, sf):
    """Both stages of the gate over all texts in order: rules, then likeness to the last fifty that passed; tested against a plain loop."""
    return O.similarity_gate(_with_vectors(spark, sf), L.informative(F.col("content")))


@query()
def scene_assignment(spark, sf):
    """Scenes of all texts in order, by the likeness to what began a scene; tested against a plain loop."""
    return O.scenes(_with_vectors(spark, sf)).select("fact_id", "scene", F.round("similarity", 6).alias("similarity"))


#: The day on which orders are looked at, and how slowly they fade.
NOW, FADE, DAYS = "1998-08-02", 1000.0, 120
CCQ_SQL = f"""f AS (SELECT o_orderkey AS fact_id, o_custkey AS profile_id, o_orderdate AS moment, o_totalprice AS importance, exp(-date_diff('day', o_orderdate, TIMESTAMP '{NOW}') / {FADE}::DOUBLE) AS retention, o_orderstatus || ' ' || o_orderpriority AS content FROM orders),
c AS (SELECT * FROM f WHERE retention < 0.5 AND retention > 0.2), ent AS (SELECT DISTINCT profile_id, fact_id, p_brand AS entity FROM c JOIN lineitem ON l_orderkey = fact_id JOIN part ON p_partkey = l_partkey),
link AS (SELECT a.fact_id AS a, b.fact_id AS b FROM ent a JOIN ent b ON a.profile_id = b.profile_id AND a.entity = b.entity AND a.fact_id <> b.fact_id GROUP BY 1, 2 HAVING count(*) >= 2),
reach AS (SELECT a AS node, a AS root FROM link UNION SELECT b, root FROM reach JOIN link ON a = node),
comp AS (SELECT node AS fact_id, min(root) AS component FROM reach GROUP BY 1),
gap AS (SELECT *, CASE WHEN moment - lag(moment) OVER (PARTITION BY component ORDER BY moment, fact_id) > INTERVAL {DAYS} DAY THEN 1 ELSE 0 END AS new FROM comp JOIN c USING (fact_id)),
sub AS (SELECT *, sum(new) OVER (PARTITION BY component ORDER BY moment, fact_id) AS sub FROM gap),
run AS (SELECT *, (row_number() OVER (PARTITION BY component, sub ORDER BY moment, fact_id) - 1) // 20 AS run FROM sub),
member AS (SELECT *, min(fact_id) OVER w AS cluster, count(*) OVER w AS n FROM run WINDOW w AS (PARTITION BY component, sub, run)),
kept AS (SELECT * FROM member WHERE n >= 3), freq AS (SELECT cluster, entity, count(*) AS k, max(n) AS n FROM kept JOIN ent USING (fact_id) GROUP BY 1, 2)"""


def _fading(spark, sf):
    r = F.exp(-F.datediff(F.lit(NOW).cast("date"), F.col("o_orderdate")) / F.lit(FADE))
    f = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("profile_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_totalprice").alias("importance"),
        F.lit(1.0).alias("confidence"), r.alias("retention"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("content"),
    ).where("retention < 0.5 AND retention > 0.2")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").alias("p_partkey"))
    brands = lines.join(table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("entity")), "p_partkey")
    return f, brands.join(f.select("fact_id", "profile_id"), "fact_id").select("profile_id", "fact_id", "entity").distinct()


@query(f"""WITH RECURSIVE {CCQ_SQL}, a AS (SELECT cluster, max(n) AS n, round(avg(retention), 6) AS avg_retention, arg_max(fact_id, (round(importance, 9), -fact_id)) AS representative, string_agg(fact_id, ',' ORDER BY fact_id) AS sources FROM kept GROUP BY 1),
t AS (SELECT cluster, string_agg(entity, ', ' ORDER BY k DESC, entity) AS top FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY k DESC, entity) AS place FROM freq) WHERE place <= 5 GROUP BY 1),
s AS (SELECT cluster, string_agg(entity, ', ' ORDER BY entity) AS shared FROM freq WHERE k = n GROUP BY 1)
SELECT cluster, n, avg_retention, representative, f.content || ' [Entities: ' || top || ']' AS gist, coalesce(shared, '') AS shared, sources FROM a JOIN f ON f.fact_id = representative JOIN t USING (cluster) LEFT JOIN s USING (cluster)""")
def consolidated_blocks(spark, sf):
    """Fading orders of a customer that share two brands and lie near in time, as blocks with their gist and sources."""
    f, e = _fading(spark, sf)
    g = C.gists(f, e, C.clusters(f, e, window_days=DAYS))
    return g.select("cluster", "n", F.round("avg_retention", 6).alias("avg_retention"), "representative", "gist", "shared", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))
