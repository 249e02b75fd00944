"""Consolidation of fading facts: clusters by shared entities and time, each with a gist.

Facts of a profile hang together if they share two entities, that is, a pair of
entities.  So each fact names its pairs, every pair links its facts to the
smallest of them, and clusters are the components of those links: no join of
facts with facts, and a pair that many facts have gives one link a fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.operators.graph import connected_components
from engramlake.sources.scratch import written


def overlap_links(entities: DataFrame) -> DataFrame:
    """(src, dst): links whose components are those of "share two entities or more";
    ``entities`` is (profile_id, fact_id, entity), a fact's pairs are as many as the
    square of its entities."""
    sets = entities.where("entity IS NOT NULL").groupBy("profile_id", "fact_id").agg(F.sort_array(F.collect_set("entity")).alias("e"))
    both = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = sets.where(F.size("e") > 1).select("profile_id", "fact_id", F.explode(both).alias("pair"))
    first = written(pairs.groupBy("profile_id", "pair").agg(F.min("fact_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "pairs")
    return pairs.join(first, ["profile_id", "pair"]).where("fact_id <> first").select(F.col("fact_id").alias("src"), F.col("first").alias("dst")).distinct()


def clusters(facts: DataFrame, entities: DataFrame, window_days: int = 7, least: int = 3, most: int = 20) -> DataFrame:
    """(fact_id, cluster): facts that hang together and lie no more than ``window_days``
    from the next before; larger ones are cut in runs of ``most`` by time, those of
    fewer than ``least`` left out.  A cluster is named after its smallest fact."""
    links = written(overlap_links(entities.join(facts.select("fact_id"), "fact_id", "left_semi")), "links")
    group = connected_components(links).withColumnRenamed("node", "fact_id")
    order = Window.partitionBy("component").orderBy("at", "fact_id")
    gap = F.col("at").cast("double") - F.lag(F.col("at").cast("double")).over(order)
    rows = facts.select("fact_id", "at").join(group, "fact_id").withColumn("new", (F.coalesce(gap, F.lit(0.0)) > window_days * 86400).cast("int"))
    rows = rows.withColumn("sub", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy("component", "sub").orderBy("at", "fact_id")
    rows = rows.withColumn("run", F.floor((F.row_number().over(inner) - 1) / most))
    named = rows.groupBy("component", "sub", "run").agg(F.min("fact_id").alias("cluster"), F.collect_list("fact_id").alias("facts"))  # ``most`` facts at most
    return named.where(F.size("facts") >= least).select(F.explode("facts").alias("fact_id"), "cluster")


def gists(facts: DataFrame, entities: DataFrame, members: DataFrame, chars: int = 500) -> DataFrame:
    """One row a cluster: n, avg_retention, centroid, representative (most importance
    times confidence), gist (its content and the five most frequent entities), shared
    (entities of all its facts) and sources (its facts)."""
    rows = members.join(facts, "fact_id")
    best = F.max_by(F.struct("fact_id", "content"), F.struct(F.round(F.col("importance") * F.col("confidence"), 9), -F.col("fact_id")))
    about = rows.groupBy("cluster").agg(
        F.count("*").alias("n"), F.avg("retention").alias("avg_retention"), F.avg(F.col("at").cast("double")).alias("centroid"), best.alias("best"), F.sort_array(F.collect_list("fact_id")).alias("sources")
    )
    seen = members.join(entities.select("fact_id", "entity").distinct(), "fact_id").groupBy("cluster", "entity").agg(F.count("*").alias("k"))
    listed = seen.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "entity"))).alias("e"))
    named = about.join(listed, "cluster", "left")
    top = F.array_join(F.transform(F.slice("e", 1, 5), lambda x: x["entity"].cast("string")), ", ")
    whole = F.concat(F.col("best.content"), F.lit(" [Entities: "), F.coalesce(top, F.lit("")), F.lit("]"))
    shared = F.array_join(F.transform(F.filter("e", lambda x: x["k"] == -F.col("n")), lambda x: x["entity"].cast("string")), ", ")
    return named.select(
        "cluster", "n", "avg_retention", "centroid", F.col("best.fact_id").alias("representative"),
        F.when(F.length(whole) > chars, F.concat(F.substring(whole, 1, chars - 3), F.lit("..."))).otherwise(whole).alias("gist"), F.coalesce(shared, F.lit("")).alias("shared"), "sources",
    )
