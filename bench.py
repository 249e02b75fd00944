"""Times the headline queries: one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose the data and the threads."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from engramlake.plans.catalog import QUERIES

HEADLINE = (
    "recall_topk", "bm25_topk", "rrf_fusion", "cosine_topk", "hopfield_topk", "fisher_similarity", "retention_curves", "community_labels", "tokenize_stats", "pii_redact",
    "co_retrieval", "evidence_window", "as_of_recall", "tool_transitions", "event_rollup", "shared_entities", "pagerank", "label_propagation", "degree_centrality", "audit_chain",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # starts the JVM's threads
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
