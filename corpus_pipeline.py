"""A training-data pipeline of the llm operators, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows and whole texts that
its predecessor kept, and returns the columns of ``documents``; the last
returns token ids and digests.  ``run`` writes each stage's rows to the shared
folder and reads them again, so a lost executor costs one stage's tasks.

Rows without doc_id pass the deduplicating stages as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, toxicity
from engramlake.llm.shared import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what the toxicity operator predicts as toxic."""
    model = toxicity.fit_tables(spark, sf_dir, docs)
    scored = toxicity.score(docs, model, keep_text=True)
    return scored.where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that an earlier document has; a document of
    which nothing is left goes, and n_chars follows the text."""
    done = line_dedup.dedup_lines(docs)
    left = done.where((F.col("lines_removed") == 0) | (F.trim(F.translate("kept_text", "\n\t\r", "")) != ""))
    return left.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.col("kept_text")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates
    (five-word shingles, similarity of 0.8 or more)."""
    linked = materialize(jaccard_join.link(docs, size=5, percent=80).select("doc_id", "component_id"), "linked")
    kept = linked.where("doc_id = component_id").select("doc_id").distinct()
    out = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    if not linked.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        # of rows with one doc_id the first by text, then by the other columns: the same at any partitioning
        row = F.struct("text", *[c for c in docs.columns if c != "text"])
        out = out.groupBy("doc_id").agg(F.min(row).alias("r")).select("r.*")
    return out.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold benchmark items."""
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(F.size("leaks") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the bytes decoded from them."""
    import public_tokenizers as P

    coded = byte_bpe.encode(docs.select("doc_id", "text"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, decode=True)
    return coded.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("byte_bpe", encode),
]

#: Models, components and token ids have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
