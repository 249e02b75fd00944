"""Retrieval channels, fusion and scoring as DataFrame plans.

A channel returns (query_id, fact_id, score).  Postings are joined, never
scanned per query; ranks break ties by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import text as T
from engramlake.functions import vectors as V
from engramlake.operators import pairwise as P
from engramlake.sources.scratch import written


def bm25(facts: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, delta: float = 1.0) -> DataFrame:
    """BM25+ over (fact_id, content) for (query_id, query): ln((N + 1) / df) times the
    saturated term frequency plus delta, for terms that occur.

    Texts are tokenised once: what is written is a row of each text, under an empty
    term, for the sizes, and its counts of words that some query has.
    """
    words = facts.select("fact_id", T.tokenize(F.col("content")).alias("_w")).withColumn("length", F.size("_w"))
    terms = queries.select("query_id", F.explode(F.array_distinct(T.tokenize(F.col("query")))).alias("term"))
    wanted = terms.select("term").unionByName(facts.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    each = words.select("fact_id", "length", F.explode(F.concat(F.array(F.lit("")), F.coalesce("_w", F.array().cast("array<string>")))).alias("term"))
    counted = written(each.join(wanted, "term", "left_semi").groupBy("fact_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length")), "bm25")
    sizes = counted.where("term = ''").agg(F.avg("length").alias("avg_len"), F.count("*").alias("docs"))  # one row
    hits = counted.join(terms, "term")
    df = hits.groupBy("term").agg(F.count_distinct("fact_id").alias("df"))
    scored = hits.join(df, "term").crossJoin(F.broadcast(sizes))
    tf, length = F.col("tf"), F.col("length")
    part = F.log((F.col("docs") + 1) / F.col("df")) * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("avg_len"))) + delta)
    return scored.groupBy("query_id", "fact_id").agg(F.sum(part).alias("score"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, fact_id, score, rank): the k vectors of largest cosine for each query.

    The stated queries meet all vectors in blocks; a task keeps its best k a query.
    """
    return top(P.candidates(P.products(queries, vectors, k)), k)


def scaled_nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``nearest`` with scores scaled so that each query's cosines with all vectors reach from 0 to 1."""
    found = written(P.products(queries, vectors, k), "products")
    ranked = top(P.candidates(found), k).join(P.sums(found), "query_id")
    return ranked.select("query_id", "fact_id", F.try_divide(F.col("score") - F.col("low"), F.col("high") - F.col("low")).alias("score"), "rank")


def semantic_blend(near: DataFrame, facts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, fact_id, score): cosine and Fisher similarity of candidates, the
    latter by a weight from .15 to 1 that grows with the fact's ``access_count``."""
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.15), F.col("access_count") / 10.0 * 1.2))
    rows = near.join(facts.select("fact_id", F.col("v").alias("x"), "access_count"), "fact_id").join(queries.select("query_id", F.col("v").alias("q")), "query_id")
    fisher = V.fisher_similarity(F.col("q"), F.col("x"), V.fisher_variance(F.col("x")))
    return rows.select("query_id", "fact_id", (w * fisher + (1 - w) * F.col("cosine")).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query; ties by fact_id."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("fact_id"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def weighted_rrf(channels: DataFrame, weights: dict[str, float], k: int = 15, absent: int = 1000) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, channel, fact_id, rank): sum of w / (k + rank);
    a channel without the fact adds w / (k + absent)."""
    w = F.lit(0.0)
    for name, x in weights.items():
        w = F.when(F.col("channel") == name, F.lit(x)).otherwise(w)
    floor = sum(weights.values()) / (k + absent)
    gain = w / (F.col("rank") + k) - w / (k + absent)
    return channels.groupBy("query_id", "fact_id").agg((F.sum(gain) + floor).alias("score"), F.count_distinct("channel").alias("channels"))


def cross_channel(fused: DataFrame) -> DataFrame:
    """Boosts what several channels found: three or more twice, two by half again."""
    boost = F.when(F.col("channels") >= 3, 2.0).when(F.col("channels") == 2, 1.5).otherwise(1.0)
    return fused.withColumn("score", F.col("score") * boost)


def hopfield(queries: DataFrame, vectors: DataFrame, beta: float, k: int) -> DataFrame:
    """(query_id, fact_id, score, rank): the k largest of the attention softmax(beta x.q) of each query over the stored vectors."""
    # shares of many vectors are small and tie at nine digits, so the best are known only after the sums
    known = written(P.sums(P.products(queries, vectors, 0, beta)), "sums")
    return top(P.candidates(P.products(queries, vectors, k, beta, known)), k)


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = 3, keep: float = 0.5, share: float = 0.8, top_n: int = 20) -> DataFrame:
    """Spreading activation: u = keep a + share sum(w / out-degree) a over edges both ways, the top n a round."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    degree = both.groupBy("src").agg(F.count("*").alias("degree"))
    both = both.join(degree, "src").select("src", "dst", (F.col("weight") / F.col("degree")).alias("w"))
    now = seeds.select("fact_id", "activation")
    for _ in range(rounds):
        out = now.join(both, now.fact_id == both.src).select(F.col("dst").alias("fact_id"), (share * F.col("w") * F.col("activation")).alias("activation"))
        now = now.select("fact_id", (keep * F.col("activation")).alias("activation")).unionByName(out).groupBy("fact_id").agg(F.sum("activation").alias("activation"))
        now = now.orderBy(F.round("activation", 9).desc(), "fact_id").limit(top_n)
    return now.select("fact_id", (1 / (1 + F.exp(-(F.col("activation") - 0.2)))).alias("activation"))


def final_score(fused: DataFrame, facts: DataFrame, trust: Column, age_days: Column) -> DataFrame:
    """Fused score times recency, length quality and trust (half plus trust)."""
    n = F.length("content")
    quality = F.when(n < 20, 0.3).when(n < 60, 0.7).otherwise(1.0)
    joined = fused.join(facts, "fact_id")
    return joined.withColumn("score", F.col("score") * V.recency_boost(age_days) * quality * (0.5 + trust))


def reciprocal_rank(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, mrr): 1 / rank of the first gold fact among the k first, else 0."""
    hit = ranked.where(F.col("rank") <= k).join(gold, ["query_id", "fact_id"]).groupBy("query_id").agg(F.min("rank").alias("r"))
    return gold.select("query_id").distinct().join(hit, "query_id", "left").select("query_id", F.coalesce(1.0 / F.col("r"), F.lit(0.0)).alias("mrr"))


def ndcg(graded: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) of (query_id, rank, grade), gains 2^grade - 1."""
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "rank"))
    rows = graded.withColumn("best", ideal)
    out = rows.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("best") <= k, gain(F.col("grade"), F.col("best"))).otherwise(0.0)).alias("idcg"))
    return out.select("query_id", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))
