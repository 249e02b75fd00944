"""Encoding: from turns to facts, entities and edges; and the code graph."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import text as T
from engramlake.operators import pairwise as P


def extract_facts(turns: DataFrame, least: float = 0.3, most: int = 10) -> DataFrame:
    """(conv_id, turn, place, content, fact_type, importance): sentences scored by
    length, entities and dates; the best ``most`` of a conversation."""
    s = turns.select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("place", "content"))
    found = F.size(T.entities(F.col("content")))
    score = 0.3 + 0.2 * F.least(found / 3.0, F.lit(1.0)) + 0.2 * (T.sentence_kind(F.col("content")) == "temporal").cast("int") + 0.3 * F.least(F.length("content") / 200.0, F.lit(1.0))
    rows = s.withColumn("importance", F.round(score, 6)).withColumn("fact_type", T.sentence_kind(F.col("content"))).where(F.col("importance") >= least)
    w = Window.partitionBy("conv_id").orderBy(F.col("importance").desc(), "turn", "place")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(mention, entity_id, how): exact name, then lower-case name, then alias, else none."""
    exact = entities.select(F.col("name").alias("mention"), F.col("entity_id").alias("by_name")).dropDuplicates(["mention"])
    low = entities.groupBy(F.lower("name").alias("_low")).agg(F.min("entity_id").alias("by_low"))
    named = aliases.groupBy(F.lower("alias").alias("_low")).agg(F.min("entity_id").alias("by_alias"))
    m = mentions.select("mention").distinct().withColumn("_low", F.lower("mention"))
    joined = m.join(exact, "mention", "left").join(low, "_low", "left").join(named, "_low", "left")
    how = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_low").isNotNull(), "case").when(F.col("by_alias").isNotNull(), "alias").otherwise("new")
    return joined.select("mention", F.coalesce("by_name", "by_low", "by_alias").alias("entity_id"), how.alias("how"))


def merge_entity(bridge: DataFrame, source: int, target: int) -> DataFrame:
    """Facts of an entity re-pointed to another, without doubles."""
    return bridge.withColumn("entity", F.when(F.col("entity") == source, target).otherwise(F.col("entity"))).distinct()


def consolidation(similarity: Column, same_kind: Column, contradicts: Column) -> Column:
    """noop, supersede, update or add for the best candidate of a new fact."""
    return F.when(contradicts & (similarity > 0.85), "supersede").when(similarity > 0.95, "noop").when((similarity > 0.85) & same_kind, "update").when(similarity > 0.85, "supersede").otherwise("add")


def semantic_edges(new: DataFrame, vectors: DataFrame, least: float = 0.7, most: int = 5) -> DataFrame:
    """(src, dst, weight): up to ``most`` neighbours of cosine ``least`` in the same community, for new facts."""
    found = P.nearest_within(new.withColumnRenamed("fact_id", "query_id"), vectors, most, least)
    return found.select(F.col("query_id").alias("src"), F.col("fact_id").alias("dst"), F.col("score").alias("weight"))


def entity_profiles(bridge: DataFrame, facts: DataFrame, last: int = 20) -> DataFrame:
    """(entity, facts, summary): an entity's last facts, joined."""
    rows = bridge.join(facts.select("fact_id", "content"), "fact_id")
    w = Window.partitionBy("entity").orderBy(F.col("fact_id").desc())
    kept = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    out = kept.groupBy("entity").agg(F.count("*").alias("facts"), F.sort_array(F.collect_list(F.struct("fact_id", F.col("content").alias("s")))).alias("_l"))
    return out.select("entity", "facts", F.array_join(F.transform("_l", lambda x: x["s"]), " | ").alias("summary"))


def gist(facts: DataFrame, cluster: str) -> DataFrame:
    """(cluster, gist, facts): the fact of most importance times confidence stands for its cluster."""
    return facts.groupBy(cluster).agg(F.max_by("fact_id", F.struct(F.round(F.col("importance") * F.col("confidence"), 9), -F.col("fact_id"))).alias("gist"), F.count("*").alias("facts"))


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name, line, calls) of the functions and classes of Python files (path, source)."""

    def run(batches):
        for b in batches:
            rows = []
            for path, source in zip(b["path"], b["source"]):
                try:
                    tree = ast.parse(source or "")
                except (SyntaxError, ValueError):
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        called = sorted({c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))})
                        rows.append((path, "class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno, called))
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "line", "calls"])

    return files.select("path", "source").mapInPandas(run, "path string, kind string, name string, line int, calls array<string>")


def call_edges(symbols: DataFrame) -> DataFrame:
    """(src, dst): calls resolved to the same file first, else to the only symbol of that name."""
    s = symbols.select("path", "name", F.concat_ws("::", "path", "name").alias("id"))
    calls = symbols.select("path", F.concat_ws("::", "path", "name").alias("src"), F.explode("calls").alias("name")).distinct()
    same = s.select("path", "name", F.col("id").alias("here")).distinct()
    only = s.groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("there")).where("n = 1").drop("n")
    out = calls.join(same, ["path", "name"], "left").join(only, "name", "left").select("src", F.coalesce("here", "there").alias("dst"))
    return out.where("dst IS NOT NULL AND src <> dst").distinct()


def coupling(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(a, b, n, level): edges between communities, low, med from 5, high from 10."""
    left = communities.select(F.col("node").alias("src"), F.col("community").alias("ca"))
    right = communities.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    cross = edges.join(left, "src").join(right, "dst").where("ca <> cb")
    n = cross.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").alias("n"))
    return n.withColumn("level", F.when(F.col("n") >= 10, "high").when(F.col("n") >= 5, "med").otherwise("low"))


def diff_hunks(lines: DataFrame) -> DataFrame:
    """(path, first, last) of the hunks of unified diffs given as (diff, n, line)."""
    w = Window.partitionBy("diff").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    path = F.last(F.nullif(F.regexp_extract("line", r"^\+\+\+ b/(.+)$", 1), F.lit("")), ignorenulls=True).over(w)
    hunks = lines.withColumn("path", path).where(F.col("line").rlike(r"^@@ "))
    first = F.regexp_extract("line", r"\+(\d+)", 1).cast("int")
    size = F.coalesce(F.nullif(F.regexp_extract("line", r"\+\d+,(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    return hunks.select("path", first.alias("first"), (first + F.greatest(size, F.lit(1)) - 1).alias("last"))
