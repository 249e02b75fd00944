"""Graph operators over (src, dst, weight) edge tables: joins and aggregates only.

Iterations cut their lineage with ``checkpoint()`` in the folder of
``spark.checkpoint.dir``, so a lost executor costs one iteration at most.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.operators.relational import dealt
from engramlake.sources.scratch import written


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; a local session without one gets its own."""
    spark = df.sparkSession
    ready(spark)
    return df.checkpoint()


def ready(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
            found = tempfile.mkdtemp(prefix="engramlake-")
        spark.sparkContext.setCheckpointDir(found)


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality): in and out edges over n - 1."""
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst"))
    counts = ends.groupBy("node").agg(F.count("*").alias("degree"))
    n = counts.agg(F.count("*").alias("n"))  # one row
    return counts.crossJoin(F.broadcast(n)).select("node", "degree", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, cut_every: int = 1) -> DataFrame:
    """(node, rank): weighted PageRank; what nodes without out edges hold is dealt to all.

    Edges are read once and links written; ranks are written every ``cut_every`` rounds.  A round
    reads the ranks before it twice, so a plan of several rounds doubles with each.
    Links meet ranks, and nodes what they get, in partitions in proportion to the links.
    """
    edges = written(edges.select("src", "dst", "weight"), "edges")
    rows = edges.count()
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    links = written(dealt(edges, rows, "src").join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")), "links")
    base = written(nodes(edges).join(out.select(F.col("src").alias("node"), F.lit(False).alias("stuck")), "node", "left").select("node", F.coalesce("stuck", F.lit(True)).alias("stuck")), "nodes")
    n = base.count()
    rank = base.select("node", "stuck", F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(rounds):
        sent = dealt(links, rows, "src").join(rank.select(F.col("node").alias("src"), "rank"), "src").select(F.col("dst").alias("node"), (F.col("rank") * F.col("p")).alias("got"))
        sent = dealt(sent, rows, "node").groupBy("node").agg(F.sum("got").alias("got"))
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("stuck"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        rank = base.join(sent, "node", "left").crossJoin(F.broadcast(lost)).select("node", "stuck", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if (k + 1) % cut_every == 0:
            rank = written(rank, "ranks")
    return rank.select("node", "rank")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label): synchronous label propagation by summed weight; ties to the smallest label.

    Links meet labels, and nodes what they hear, in partitions in proportion to the links.
    """
    both = written(symmetric(edges).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "links")
    rows = both.count()
    labels = nodes(edges).withColumn("label", F.col("node"))
    for _ in range(rounds):
        told = dealt(both, rows, "dst").join(labels.select(F.col("node").alias("dst"), "label"), "dst").select(F.col("src").alias("node"), "label", "weight")
        heard = dealt(told, rows, "node").groupBy("node", "label").agg(F.sum("weight").alias("w"))
        best = heard.groupBy("node").agg(F.max_by("label", F.struct(F.round("w", 6), -F.col("label"))).alias("label"))
        labels = written(best, "labels")
    return labels


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable, by minimum labels with pointer jumping."""
    both = cut(symmetric(edges.select("src", "dst")).distinct())
    labels = cut(nodes(edges).withColumn("component", F.col("node")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("c").alias("c"))
        low = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("c", "component")).alias("component"), F.col("component").alias("old"))
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = cut(low.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component"), "old"))
        if step.where("component <> old").isEmpty():
            return step.select("node", "component")
        labels = step.select("node", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within ``depth`` steps of the seeds and the fewest steps."""
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def prune(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges whose ends are known, without loops, the heaviest of each (src, dst)."""
    ids = known.select("node").distinct()
    kept = edges.where("src <> dst").join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def collapse_chains(edges: DataFrame) -> DataFrame:
    """A -> B -> C becomes A -> C with the weight of A -> B, and B -> C goes; one level a run."""
    e2 = edges.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
    through = edges.select("src", F.col("dst").alias("mid"), "weight").join(e2, "mid")
    added = through.where("src <> far").groupBy("src", F.col("far").alias("dst")).agg(F.max("weight").alias("weight"))
    # an edge is the second of some chain if any edge leads to its source: the chains need not be listed again
    into = edges.select(F.col("dst").alias("src")).distinct()
    left = edges.where("dst IS NOT NULL").join(into, "src", "left_anti").unionByName(edges.where("dst IS NULL")).select("src", "dst", "weight")
    return left.unionByName(added).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def shared_entity_pairs(bridge: DataFrame, least: int) -> DataFrame:
    """(a, b, shared): facts with ``least`` shared entities or more, of distinct (fact_id, entity).

    From two on, facts meet by pairs of entities, a fact's being as many as the square of its
    entities: m shared ones are m (m - 1) / 2 shared pairs, and facts that share only one never meet.
    """
    if least > 1:
        sets = bridge.where("entity IS NOT NULL").groupBy("fact_id").agg(F.sort_array(F.collect_set("entity")).alias("e"))
        both = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
        met = sets.where(F.size("e") > 1).select("fact_id", F.explode(both).alias("p")).select("fact_id", "p.x", "p.y")
        pairs = met.withColumnRenamed("fact_id", "a").join(met.withColumnRenamed("fact_id", "b"), ["x", "y"]).where("a < b")
        shared = F.round((1 + F.sqrt(1 + 8 * F.count("*"))) / 2).cast("long")
        return pairs.groupBy("a", "b").agg(shared.alias("shared")).where(F.col("shared") >= least)
    pairs = bridge.select(F.col("fact_id").alias("a"), "entity").join(bridge.select(F.col("fact_id").alias("b"), "entity"), "entity").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def last_per_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Latest row of each key: an upsert's state from its log."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
