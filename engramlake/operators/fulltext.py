"""Full-text search over positional postings: phrases, prefixes and set algebra, as joins.

A text index is two written tables: postings (term, key, tf, positions) and
sizes (key, length).  A task writes the postings of the texts it reads, in order
of their terms, so that nothing is dealt, no term is hot and a scan for stated
terms skips most of every file.

Queries are a table of clauses, (query_id, clause, role, kind, words): role
``all``, ``any`` or ``none``, kind ``phrase`` (one word or several in a row) or
``prefix`` (its first word is the beginning of a term).  A text matches a query
if every ``all`` clause, some ``any`` clause (if there is one) and no ``none``
clause matches it; a query without ``all`` and ``any`` matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from engramlake.functions import text as T
from engramlake.functions.arrow import arrow_map
from engramlake.sources.scratch import new_path, written

#: Terms that an index may be asked to hold alone; it holds all if clauses have more.
ASKED = 1 << 14
CLAUSES = "query_id long, clause int, role string, kind string, words array<string>"


@dataclass
class TextIndex:
    postings: DataFrame
    sizes: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, key: str = "fact_id", text: str = "content", clauses: DataFrame | None = None) -> TextIndex:
        """Null texts have no words and count as texts.

        An index for stated ``clauses`` holds the postings of their terms and beginnings only, with
        those terms' places in the whole texts; all texts are read and all sizes kept.
        """
        spark = docs.sparkSession
        words = docs.select(F.col(key).alias("key"), F.coalesce(T.words(F.col(text)), F.array().cast("array<string>")).alias("w"))
        asked = None if clauses is None else _asked(clauses)
        schema = T_.StructType([T_.StructField("term", T_.StringType()), T_.StructField("key", words.schema["key"].dataType), T_.StructField("tf", T_.LongType()), T_.StructField("positions", T_.ArrayType(T_.IntegerType()))])
        if asked is None:
            sizes = written(words.select("key", F.size("w").alias("length")), "sizes")
            found = arrow_map(words, _own_postings, schema)
        else:
            terms, beginnings = asked

            def wanted(place: Column) -> Column:
                word = place["term"]
                of = [word.isin(terms)] if terms else []
                of += [F.substring(word, 1, n).isin([x for x in beginnings if len(x) == n]) for n in sorted({len(x) for x in beginnings})]
                return reduce(lambda x, y: x | y, of, F.lit(False))

            # one pass over the texts: sizes and, of the terms asked for, places
            kept = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("term"), i.cast("int").alias("at"))), wanted)
            rows = written(words.select("key", F.size("w").alias("length"), kept.alias("found")), "texts")
            sizes = rows.select("key", "length")
            found = arrow_map(rows.where(F.size("found") > 0).select("key", F.col("found.term").alias("w"), F.col("found.at").alias("at")), _own_postings, schema)
        path = new_path(spark, "postings")
        found.sortWithinPartitions("term", "key").write.parquet(path)
        return cls(spark.read.schema(schema).parquet(path), sizes)

    def occurrences(self, clauses: DataFrame) -> DataFrame:
        """(query_id, clause, role, key, tf): how often a clause occurs in a text."""
        return self._phrases(clauses.where("kind = 'phrase'")).unionByName(self._prefixes(clauses.where("kind = 'prefix'")))

    def _phrases(self, clauses: DataFrame) -> DataFrame:
        words = clauses.where(F.size("words") > 0).select("query_id", "clause", "role", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term"))
        hits = words.join(self.postings, "term")
        single = hits.where("n = 1").select("query_id", "clause", "role", "key", "tf")
        # positions are opened only in texts that have all the words of the phrase
        several = hits.where("n > 1")
        have = several.groupBy("query_id", "clause", "key", "n").agg(F.count("*").alias("seen")).where("seen = n").drop("seen", "n")
        starts = several.join(have, ["query_id", "clause", "key"]).select("query_id", "clause", "role", "key", "n", F.explode("positions").alias("p"), "offset")
        whole = starts.groupBy("query_id", "clause", "role", "key", "n", (F.col("p") - F.col("offset")).alias("start")).agg(F.count("*").alias("seen")).where("seen = n")
        return single.unionByName(whole.groupBy("query_id", "clause", "role", "key").agg(F.count("*").alias("tf")))

    def _prefixes(self, clauses: DataFrame) -> DataFrame:
        """Prefixes are equi-joined with the beginnings of the terms, of each length that some prefix has."""
        asked = clauses.select("query_id", "clause", "role", F.get("words", F.lit(0)).alias("beginning")).where(F.length("beginning") > 0)
        lengths = [r[0] for r in asked.select(F.length("beginning")).distinct().collect()]  # few: no longer than a word
        if not lengths:
            return asked.limit(0).select("query_id", "clause", "role", F.lit(None).cast(self.postings.schema["key"].dataType).alias("key"), F.lit(0).cast("long").alias("tf"))
        begun = self.postings.where(F.length("term") >= min(lengths)).select("key", "tf", F.explode(F.array(*[F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in sorted(lengths)])).alias("beginning"))
        found = begun.where("beginning IS NOT NULL").join(asked, "beginning")
        return found.groupBy("query_id", "clause", "role", "key").agg(F.sum("tf").alias("tf"))

    def search(self, clauses: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(query_id, key, score) of the texts that match; the score sums BM25 over the
        clauses that are wanted, a clause counted as one term."""
        clauses = written(clauses, "clauses")
        hits = written(self.occurrences(clauses), "hits")
        asked = clauses.groupBy("query_id").agg(F.count_if(F.col("role") == "all").alias("n_all"), F.count_if(F.col("role") == "any").alias("n_any"))
        seen = hits.groupBy("query_id", "key").agg(*[F.count_if(F.col("role") == r).alias(f"s_{r}") for r in ("all", "any", "none")])
        good = seen.join(asked, "query_id").where("s_all = n_all AND (n_any = 0 OR s_any > 0) AND s_none = 0").select("query_id", "key")
        wanted = hits.where("role <> 'none'")
        df = wanted.groupBy("query_id", "clause").agg(F.count("*").alias("df"))
        sizes = self.sizes.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))  # one row
        rows = wanted.join(good, ["query_id", "key"]).join(df, ["query_id", "clause"]).join(self.sizes, "key").crossJoin(F.broadcast(sizes))
        idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        return rows.groupBy("query_id", "key").agg(F.sum(part).alias("score"))


def _asked(clauses: DataFrame) -> tuple[list[str], list[str]] | None:
    """Terms of the phrases and beginnings of the prefixes of ``clauses``, or None if either are more than ASKED."""
    of = clauses.where("kind = 'phrase'").select(F.explode("words").alias("x"))
    begun = clauses.where("kind = 'prefix'").select(F.get("words", F.lit(0)).alias("x")).where(F.length("x") > 0)
    terms, beginnings = ([r[0] for r in df.where("x IS NOT NULL").distinct().limit(ASKED + 1).collect()] for df in (of, begun))
    return None if max(len(terms), len(beginnings)) > ASKED else (sorted(terms), sorted(beginnings))


def _own_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of each text from (key, words), or (key, words, their places)."""
    for batch in batches:
        words, sizes = batch.column(1), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(batch)), sizes)
        at = batch.column(2).flatten().to_numpy() if batch.num_columns > 2 else np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        coded = words.flatten().dictionary_encode(null_encoding="encode")
        name = coded.indices.to_numpy().astype(np.int64)
        # a text's places are in order, and stay so
        order = np.lexsort((name, row))
        row, name, at = row[order], name[order], at[order].astype(np.int32)
        head = np.flatnonzero(np.concatenate([row[:1] >= 0, (row[1:] != row[:-1]) | (name[1:] != name[:-1])]))
        ends = np.append(head, len(row))
        columns = [coded.dictionary.take(pa.array(name[head])), batch.column(0).take(pa.array(row[head])), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "key", "tf", "positions"])


def fused(channels: list[DataFrame], boost: Column, about: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, key, score): reciprocal ranks of (query_id, key, score) lists, a
    hundred of each, summed and then multiplied by ``boost``, a column of ``about`` (by key)."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "key")
    ranked = [c.withColumn("rank", F.row_number().over(order)).where("rank <= 100").select("query_id", "key", (1 / (k + F.col("rank"))).alias("gain")) for c in channels]
    total = ranked[0]
    for c in ranked[1:]:
        total = total.unionByName(c)
    return total.groupBy("query_id", "key").agg(F.sum("gain").alias("s")).join(about, "key").select("query_id", "key", (F.col("s") * boost).alias("score"))
