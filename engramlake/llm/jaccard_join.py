"""Operator 3: n-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct k-word shingles.  Sizes are dealt into
bands of equal size; two sets of similarity at least ``t`` that meet in a band
differ in at most K = (1 - t) / (1 + t) * (largest sum of sizes) shingles.  The
feature domain is cut into K // 2 + 1 partitions, so in one of them the sets
differ in one shingle at most; each is cut into three sub-partitions, and the
three subsets of two sub-partitions are enumerated: one of them is the same for
both sets, and its hash is a shared signature (Arasu, Ganti and Kaushik, 2006).

Scale.  Equal sets are one node (a pre-aggregated minimum) and send their
signatures once a task.  Signatures are two longs a row, dealt once by signature and read as a sorted stream that keeps
the bucket it is in, as far as it is small.  A small bucket gives its pairs, of
which those stay that a lower bound of the difference (from counts of the sets'
hashes in bins) allows.  A large one gives a row per member, never its pairs.
Similar sets have the same signature in more partitions than one (``spare`` more);
so a set with no more large buckets than it has partitions to spare meets all
its like in small ones, and leaves the large ones.  The sets that stay in one are tied to
the smallest of them.  Sets that can be similar are thus in
one cluster of tied sets.  A cluster is compared in cells of bounded size: a
small one whole, a larger one by size bands and salted blocks, each pair of
blocks that can hold links in a cell of its own.  In a cell, the pairs that
share a signature are met, once however many they share; pairs that links
already join are skipped, a lower bound of the difference (from counts of the
sets' hashes in 64 bins) drops most others, and the rest are verified exactly;
only a spanning forest of links leaves it.  No link between components is lost.

Defined results: null or wordless text is an empty set, linked with nothing,
its own component; fewer than k words are one shingle; equal rows are copies;
a row without doc_id gets a null component; rows with one doc_id are expected to
hold one text.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.llm import wordhash as W
from engramlake.llm.shared import arrow_map, components, join_counted, materialize, table

U = np.uint64
#: Ratio of a band's ends.
BAND = 1.4


def bands(low: int, high: int) -> list[int]:
    """Lower ends of the size bands, 1 first."""
    out = [1]
    while out[-1] <= high:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return out


_BANDS = np.array(bands(1, 1 << 40))


def signatures(u: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a sorted set of 64-bit hashes, for its own band and, where
    the next band holds sizes it can be similar to, for that one.

    Similar means 100 * intersection >= percent * union.
    """
    return _signatures(u, percent)[0]


def _signatures(u: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """``signatures``, and how many of them may be left out: whichever they are, each
    similar set shares another one."""
    n, room = len(u), 1 << 30
    if not n:
        return np.zeros(0, dtype=U), 0
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, dtype=U), np.cumsum(W.mix(u + U(0x632BE59BD9B4E019)))])
        own = int(np.searchsorted(_BANDS, n, side="right")) - 1
        out = []
        for band in (own, own + 1):
            if band > own and 100 * n < percent * int(_BANDS[band]):
                break  # no size of that band is near enough
            most = 2 * (int(_BANDS[band + 1]) - 1)
            apart = most * (100 - percent) // (100 + percent)
            # one partition at least has one difference at most; with ``spare`` more, so
            # many, and one besides, do
            spare = 1 + apart // 6 if apart else 0
            parts = apart // 2 + 1 + spare
            subs = 3 if apart else 1
            # sub-partition j holds hashes from j / (parts * subs) of the domain on
            ends = (np.arange(parts * subs + 1, dtype=U) * U((1 << 64) // (parts * subs) - 1))[1:-1]
            place = np.concatenate([[0], np.searchsorted(u, ends), [n]])
            sums = total[place]
            each, size = (sums[1:] - sums[:-1]).reshape(parts, subs), (place[1:] - place[:-1]).reshape(parts, subs)
            left, filled = each, size > 0
            if subs > 1:
                left, filled = each.sum(axis=1, keepdims=True) - each, size.sum(axis=1, keepdims=True) > size
            tag = np.arange(parts * subs, dtype=U).reshape(parts, subs) + U(band) * U(1 << 40)
            sigs = W.mix(left ^ W.mix(tag))
            # an empty subset says nothing; a set with few of them is found by others:
            # of the partitions that agree, one has no empty subset
            empty = int((~filled).any(axis=1).sum())
            few = empty <= spare
            out.append(sigs[filled] if few else sigs.ravel())
            room = min(room, spare - empty if few else spare)
        return np.concatenate(out), room


def _shingled(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(doc ids, sets) of runs of the rows of a batch of (doc_id, text)."""
    for row, data, at in W.runs(batch.column(1)):
        h, _, _, rows = W.words(data, at)
        sets = [W.shingles(h, a, b, size) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]
        yield batch.column(0).slice(row, len(sets)), sets


def _fingerprint(u: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(u.sum(dtype=U).view(np.int64)), int(W.mix(u ^ U(0x8EBC6AF09C88C6E3)).sum(dtype=U).view(np.int64))


#: Bins in which the hashes of a set are counted, for those up to LONG shingles and for larger ones.
BINS, LONG = (64, 512), 1000


def _counts(u: np.ndarray) -> bytes:
    """How many hashes of a set fall into each bin; a bin of 65,535 and more counts as that, which no bound exceeds."""
    shift = 64 - BINS[len(u) > LONG].bit_length() + 1
    return np.minimum(np.bincount((u >> U(shift)).astype(np.int64), minlength=BINS[len(u) > LONG]), 65_535).astype("<u2").tobytes()


def _may_be_similar(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """False only if sets of n and m shingles with counts x and y are not similar."""
    both = [np.frombuffer(k, dtype="<u2").astype(np.int64) for k in (x, y)]
    least = min(map(len, both))
    if any(len(k) > least and k.max() == 65_535 for k in both):
        return True
    # |difference| <= (100 - percent) / (100 + percent) * (sum of sizes) for links
    p, q = (k.reshape(least, -1).sum(axis=1) for k in both)
    return (100 + percent) * int(np.abs(p - q).sum()) <= (100 - percent) * (n + m)


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that the counts of their sets allow to be similar."""
    known = sets.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("n", "bins")).alias("x"))
    rows = pairs.join(known.select(F.col("doc_id").alias("a"), F.col("x").alias("x")), "a").join(known.select(F.col("doc_id").alias("b"), F.col("x").alias("y")), "b")
    sizes = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    rows = rows.where(sizes).select("a", "b", F.col("x.n").alias("n"), F.col("x.bins").alias("x"), F.col("y.n").alias("m"), F.col("y.bins").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, m, y = (batch.column(k).to_pylist() for k in range(2, 6))
            keep = [_may_be_similar(*row, percent) for row in zip(n, x, m, y)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return arrow_map(rows, run, "a long, b long")


def _sets(df: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """doc_id, n, f1, f2 (fingerprint), bins (counts) and room (signatures that may be left out) of the set of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets in _shingled(batch, size):
                prints = [_fingerprint(u) for u in sets]
                columns = [pa.array([len(u) for u in sets], pa.int64()), *(pa.array([f[k] for f in prints], pa.int64()) for k in (0, 1))]
                columns += [pa.array([_counts(u) for u in sets], pa.binary()), pa.array([_signatures(u, percent)[1] for u in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n", "f1", "f2", "bins", "room"])

    return arrow_map(df.select(F.col("doc_id").cast("long"), F.col(text).cast("binary").alias("t")), run, "doc_id long, n long, f1 long, f2 long, bins binary, room long")


#: Fingerprints a task remembers, to send the signatures of a set once.
SEEN = 200_000


def _signed(df: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """(sig, doc) for every signature of every set, of copies within a task the first one's only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for ids, sets in _shingled(batch, size):
                docs, sigs = [], []
                for doc, u in zip(ids.to_pylist(), sets):
                    if doc is None or not len(u) or (own := _fingerprint(u)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(own)
                    docs.append(doc)
                    sigs.append(signatures(u, percent))
                if docs:
                    ends = np.cumsum([0, *map(len, sigs)], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sigs).view(np.int64)))], names=["doc", "sigs"])

    made = arrow_map(df.select(F.col("doc_id").cast("long"), F.col(text).cast("binary").alias("t")), run, "doc long, sigs array<long>")
    return made.select(F.explode("sigs").alias("sig"), "doc")


#: Sets of a bucket up to which it is small.
SMALL = 8


def _ties(rows: DataFrame, parts: int) -> DataFrame:
    """Of rows (sig, doc): (null, a, b) for the pairs of small buckets and (sig, doc, null) for each doc of a large one."""
    small = SMALL

    def told(sigs: np.ndarray, docs: np.ndarray, large: np.int64 | None) -> pa.RecordBatch:
        """Of whole buckets, but for that of ``large``, of which members have been told."""
        head = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
        size = np.repeat(np.diff(np.append(head, len(sigs))), np.diff(np.append(head, len(sigs))))
        big = (size > small) | (sigs == large if large is not None else False)
        a, b = [], []
        for d in range(1, min(small, len(sigs))):
            at = np.flatnonzero((sigs[d:] == sigs[:-d]) & ~big[d:] & (docs[d:] != docs[:-d]))
            a.append(docs[at])
            b.append(docs[at + d])
        pairs = sum(map(len, a))
        nulls = pa.nulls(pairs, pa.int64()), pa.nulls(int(big.sum()), pa.int64())
        columns = [[nulls[0], pa.array(sigs[big])], [pa.array(np.concatenate([*a, docs[:0]])), pa.array(docs[big])], [pa.array(np.concatenate([*b, docs[:0]])), nulls[1]]]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["sig", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs = docs = np.zeros(0, dtype=np.int64)
        large = None
        for batch in batches:
            if not len(batch):
                continue
            sigs, docs = (np.concatenate([held, batch.column(k).to_numpy(zero_copy_only=False)]) for k, held in enumerate((sigs, docs)))
            # the last bucket may go on; of a large one nothing is held
            cut = int(np.searchsorted(sigs, sigs[-1]))
            if len(sigs) - cut > small or sigs[-1] == large:
                cut = len(sigs)
            if cut:
                yield told(sigs[:cut], docs[:cut], large)
                large = sigs[cut - 1] if cut == len(sigs) else None
            sigs, docs = sigs[cut:], docs[cut:]
        if len(sigs):
            yield told(sigs, docs, large)

    return arrow_map(rows.repartition(parts, "sig").sortWithinPartitions("sig", "doc").select("sig", "doc"), run, "sig long, a long, b long")


def _tied(signed: DataFrame, sets: DataFrame, parts: int, percent: int) -> DataFrame:
    """(a, b): docs tied by shared signatures, so that similar sets are in one cluster of them."""
    ties = materialize(_ties(signed, parts).distinct(), "ties")
    near = _near(ties.where("sig is null").select("a", "b"), sets, percent)
    held = ties.where("sig is not null").select("sig", F.col("a").alias("doc"))
    room = sets.where("n > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(F.min("room").alias("room"))
    stay = held.groupBy("doc").count().join(room, "doc").where("count > room").select("doc")
    held = held.join(stay, "doc")
    first = held.groupBy("sig").agg(F.min("doc").alias("a"), F.max("doc").alias("last"), F.count("*").alias("n")).where("a <> last").drop("last")
    return near.unionByName(join_counted(held, first, ["sig"], held.count()).where("a <> doc").select("a", F.col("doc").alias("b")))


#: Sets and shingles that a block of a cell holds at most, by its expected share.
BLOCK_SETS, BLOCK_SHINGLES = 8192, 2_000_000


def _cells(members: DataFrame, percent: int) -> DataFrame:
    """(doc, cell, side) of members (doc, n, cluster): the cells each is compared in.

    Bands of sizes have the ratio 100 / percent, so links stay within a band or
    join neighbours.  Side 0 meets its own cell mates; in a cell of two blocks
    side 0 meets side 1 only.
    """
    whole = members.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    small = (F.col("c") <= BLOCK_SETS) & (F.col("w") <= BLOCK_SHINGLES)
    one = members.join(whole.where(small).select("cluster"), "cluster").select("doc", F.xxhash64("cluster").alias("cell"), F.lit(0).alias("side"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)
    rest = members.join(whole.where(~small).select("cluster"), "cluster").withColumn("band", band)
    blocks = rest.groupBy("cluster", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    near = blocks.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    under = blocks.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    known = blocks.join(near, ["cluster", "band"], "left").join(under, ["cluster", "band"], "left")
    rest = rest.join(known, ["cluster", "band"]).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    name = lambda i, p, j, q: F.xxhash64("cluster", i, p, j, q)
    to = lambda n: F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(0)) - 1)
    some = lambda n, x: F.when(F.coalesce(n, F.lit(0)) > 0, x).otherwise(F.array().cast("array<struct<cell:bigint,side:int>>"))
    pair = lambda cell, side: F.struct(cell.alias("cell"), side.cast("int").alias("side"))
    b, own = F.col("band"), F.col("own")
    within = F.transform(to(F.col("blocks")), lambda q: pair(name(b, F.least(own, q), b, F.greatest(own, q)), F.when(own > q, F.lit(1)).otherwise(F.lit(0))))
    upward = some(F.col("above"), F.transform(to(F.col("above")), lambda q: pair(name(b, own, b + 1, q), F.lit(0))))
    downward = some(F.col("below"), F.transform(to(F.col("below")), lambda q: pair(name(b - 1, q, b, own), F.lit(1))))
    many = rest.select("doc", F.explode(F.concat(within, upward, downward)).alias("x")).select("doc", "x.cell", "x.side")
    return one.unionByName(many)


#: Sets of a bucket up to which its pairs are listed at once; pairs bounded at once.
FEW, PAIRS = 12, 1 << 16
#: A set whose large buckets hold more members than so many times the cell's sets meets all of the cell.
ALL = 64
#: Rows of a partition of cells; what they cost does not follow their bytes, so partitions are not merged.
CELL_ROWS = 500


def _buckets(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sets that share a signature: the distinct pairs (as two columns) of small
    buckets, and the members of each large one; buckets of the same sets count once.

    Signatures are held once and sorted by eighths of their domain.
    """
    held = []
    for k in range(0, len(sets), 500):
        signed = [signatures(u, percent) for u in sets[k : k + 500]]
        held.append((np.concatenate(signed), np.repeat(np.arange(k, k + len(signed), dtype=np.int32), [len(x) for x in signed])))
    pairs, large = [np.zeros(0, dtype=np.int64)], {}
    for part in range(8):
        here = [(sig >> U(61)) == U(part) for sig, _ in held]
        sig, own = (np.concatenate([x[k][at] for x, at in zip(held, here)] or [np.zeros(0)]) for k in (0, 1))
        if not len(sig):
            continue
        order = np.argsort(sig, kind="stable")
        sig, own = sig[order], own[order].astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(head, len(sig)))
        with np.errstate(over="ignore"):
            same, once = np.unique(np.add.reduceat(W.mix(own.astype(U) + U(1)), head), return_index=True)
        head, size = head[once], size[once]
        for d in range(1, FEW):
            for k in range(FEW - d):
                at = head[(size > k + d) & (size <= FEW)] + k
                pairs.append(own[at] * len(sets) + own[at + d])
        pairs = [np.unique(np.concatenate(pairs))]
        for k in np.flatnonzero(size > FEW).tolist():
            large.setdefault(int(same[k]), own[head[k] : head[k] + size[k]].astype(np.int32))
    return np.stack([pairs[0] // max(1, len(sets)), pairs[0] % max(1, len(sets))], axis=1), sorted(large.values(), key=len)


def _similar(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(v, u)
    at[at == len(v)] = 0
    both = int((v[at] == u).sum())
    return 100 * both >= percent * (len(u) + len(v) - both)


def _compare(ids: list, sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple]:
    """A spanning forest of the links between sets of a cell, as pairs of ids.

    Only sets that share a signature are compared, and of them only those that
    links do not join already.
    """
    sizes = np.array([len(u) for u in sets], dtype=np.int64)
    bins = np.zeros((len(sets), 64), dtype=np.int32 if sizes.max(initial=0) > 30_000 else np.int16)
    for k, u in enumerate(sets):
        bins[k] = np.bincount((u >> U(58)).astype(np.int64), minlength=64)
    comp = np.arange(len(sets))
    members = [[k] for k in range(len(sets))]
    two = sides.any()
    found = []

    def open_pairs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places of pairs not joined, across sides, whose difference may be small enough."""
        at = np.flatnonzero((comp[i] != comp[j]) & ((sides[i] != sides[j]) | (not two)))
        # |difference| <= (100 - percent) / (100 + percent) * (sum of sizes) for links
        apart = np.abs(bins[i[at]] - bins[j[at]]).sum(axis=1)
        return at[(100 + percent) * apart <= (100 - percent) * (sizes[i[at]] + sizes[j[at]])]

    def meet(i: int, j: int) -> None:
        if comp[i] == comp[j]:
            return
        if _similar(sets[i], sets[j], percent):
            found.append((ids[i], ids[j]))
            a, b = sorted((comp[i], comp[j]), key=lambda c: len(members[c]))
            comp[members[a]] = b
            members[b] += members[a]

    pairs, large = _buckets(sets, percent)
    for k in range(0, len(pairs), PAIRS):
        i, j = pairs[k : k + PAIRS].T
        for p in open_pairs(i, j).tolist():
            meet(int(i[p]), int(j[p]))
    # sets of like contents are in thousands of large buckets together: a pair of them is met once
    mine: list[list[np.ndarray]] = [[] for _ in sets]
    for bucket in large:
        for i in bucket.tolist():
            mine[i].append(bucket)
    for i, own in enumerate(mine):
        mates = np.ones(len(sets), dtype=bool) if sum(map(len, own)) > ALL * len(sets) else np.zeros(len(sets), dtype=bool)
        if not mates.all():
            for bucket in own:
                mates[bucket] = True
        rest = i + 1 + np.flatnonzero(mates[i + 1 :])
        for p in open_pairs(np.full(len(rest), i), rest).tolist():
            meet(i, int(rest[p]))
    return found


def _links(docs: DataFrame, cells: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """Links (a, b) found in the cells, enough to connect all that links connect."""
    own = docs.select(F.col("doc_id").alias("doc"), F.col(text).cast("binary").alias("t"))
    rows = cells.join(own, "doc").select("cell", "doc", "side", "t")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, sides = group.column("doc").to_pylist(), group.column("side").to_numpy()
        sets, order = [], []
        for chunk in group.column("t").chunks:
            for _, data, at in W.runs(chunk):
                h, _, _, ends = W.words(data, at)
                sets += [W.shingles(h, x, y, size) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
        order = sorted(range(len(ids)), key=lambda k: (len(sets[k]), ids[k]))
        found = _compare([ids[k] for k in order], [sets[k] for k in order], sides[order], percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells.count() // CELL_ROWS))
    return rows.repartition(parts, "cell").groupBy("cell").applyInArrow(run, "a long, b long")


def link(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    docs = docs.select("doc_id", text)
    sets = materialize(_sets(docs, text, size, percent), "sets")
    copies = materialize(
        sets.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")), "copies"
    )
    ties = materialize(_tied(_signed(docs, text, size, percent), sets, parts, percent).distinct(), "tied")
    # of copies, the smallest doc_id stands for the set
    named = sets.where("doc_id is not null").join(copies, ["n", "f1", "f2"]).select("doc_id", "rep").distinct()
    ties = ties.join(named.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), "a").join(named.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb")), "b")
    clusters = components(ties.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    members = clusters.select(F.col("node").alias("doc"), F.col("component").alias("cluster"))
    members = materialize(members.join(copies.select(F.col("rep").alias("doc"), "n"), "doc").dropDuplicates(["doc"]), "members")
    cells = materialize(_cells(members, percent), "cells")
    # rows that repeat a doc_id repeat its text
    found = materialize(_links(docs, cells, text, size, percent), "links")
    labels = components(found)
    known = copies.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = known.select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = sets.select("doc_id", "n", "f1", "f2").join(known, ["n", "f1", "f2"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), size=3, percent=90)
