"""What the training-data operators share: tables, durable cuts, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, a local session (tests) gets a temporary one; a cluster
    has no safe default, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.conf.get("spark.master", "local") or "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        found = "file://" + tempfile.mkdtemp(prefix="engramlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage
    that survives the loss of executors, and columns that can be pruned."""
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files that the written table replaces
    return spark.read.schema(df.schema).parquet(path), path


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Keys that hold a HOT-th of all rows or more are hot; there are at most HOT of them.
HOT = 2000


def hot_from(total: int) -> int:
    """So many of ``total`` rows make a key hot."""
    return max(1000, -(-total // HOT))


def join_counted(rows: DataFrame, known: DataFrame, keys: list[str], total: int, count: str = "n") -> DataFrame:
    """``rows`` joined with ``known``, which has one row a key and says how many of
    the ``total`` rows the key holds at most.

    The hot keys are few whatever the input, so they are broadcast; the others are
    dealt, and no task gets more than a HOT-th of the rows by one key.
    """
    least = hot_from(total)
    hot = F.broadcast(known.where(F.col(count) >= least))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(known.where(F.col(count) < least), keys)
    return rows.join(hot, keys).unionByName(rest)


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in small batches, with an allocator that gives memory back.

    Texts may be long: a batch of the default size can hold hundreds of MB.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))

    def lean(batches):
        import ctypes

        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        # workers live on between tasks: what they free goes back to the system
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD: smaller ones cost a page fault for every page of every array
            libc.mallopt(-1, 1 << 26)  # M_TRIM_THRESHOLD
        yield from run(batches)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return df.mapInArrow(lean, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """Connected components of an edge table: (node, component), smallest id first.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): every
    step is an aggregate (with map-side combine) and an equi-join whose hub nodes
    are broadcast, so neither a large component nor a hub node is gathered in one
    task, and nothing but two sums per round reaches the driver.  The folder of a
    round goes when the next is written.  Nodes without edges are not returned.
    """
    spark = edges.sparkSession
    cur, path = _written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc-edges")
    count, seen = cur.count(), None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # without a hub a plain join does; a step has no more rows of a node than the node has edges
        hub = (both.groupBy("u").count().agg(F.max("count")).first()[0] or 0) >= hot_from(2 * count)
        join = (lambda rows, known: join_counted(rows, known, ["u"], 2 * count)) if hub else (lambda rows, known: rows.join(known, "u"))
        star = join(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join(star, low).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        old = path
        cur, path = _written(small.where("u <> v").distinct(), "cc-edges")
        _remove(spark, old)
        count, total = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (count, total) == seen:
            break
        seen = count, total
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # every node now points at its component's smallest node
    return cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def bounded_sample(df: DataFrame, label: str, key: str, per_class: int | dict) -> DataFrame:
    """About ``per_class`` rows of each class (or as a dict says, by class), chosen by
    a hash of the key: the same rows at any partitioning.

    The class counts are one aggregate; the filter is narrow.  The number of
    classes must be small, as it is for labels.
    """
    counts = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 40)) / float(1 << 40)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == value, F.lit(min(1.0, (per_class if isinstance(per_class, int) else per_class.get(value, 0)) / n))).otherwise(share)
    return df.where(place < share)
