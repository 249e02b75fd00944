"""Operator 4: benchmark decontamination by latent semantic retrieval.

Texts are words (runs of letters and digits, lower case).  Passages are
TF-IDF vectors over the words of the benchmark.
A randomised SVD gives the latent space: every task multiplies a sparse random
matrix S (one sign a passage, in one of BUCKETS rows; Clarkson and Woodruff,
2013) with its passages A, and the sums of all tasks give, in one pass over the
corpus, the sketch S A, whose right singular vectors are near those of A.  The
pass also counts document frequencies; as they scale columns, they are applied
to the sketch afterwards.  All sums are of whole numbers, thus the same in any
order.  The space is spanned by the TOPICS strongest directions and the
benchmark's own passages, so an item is in it as it is, and a window's cosine
with it is never less than that of the plain TF-IDF vectors.

A second pass slides windows of ``SPAN`` blocks of ``STEP`` words over whole
texts, projects them and keeps window and item pairs of cosine ``NEAR`` or
more.  Pairs of which the window's surroundings hold enough of the item's words
(an upper bound, so nothing is lost by it) are checked by the longest common subsequence of words within the
window and its surroundings; verbatim copies are looked up besides, by the word of the
item that is rarest in the corpus: it is a leak if the subsequence covers ``COPIED``
of the item; or ``PARAPHRASED`` of it, in a dense stretch or with the answer, the
uncommon words of the item's last sentence, mostly there.

The benchmark is read to the driver in parts of at most ``ITEMS`` items, one
pair of passes a part, as the space needs a dimension for each item; sketches are bounded by its vocabulary and summed by a
tree of groups of FAN.  Long texts are worked on in slices of SLICE blocks.  Defined results: null, empty or wordless texts and items
match nothing; equal items are each reported; repeated rows get equal results;
other columns are untouched, but one named ``leaks`` is replaced; an empty benchmark finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.llm import wordhash as W
from engramlake.llm.shared import arrow_map, table

STEP, SPAN, PASSAGE = 16, 3, 48
NEAR, COPIED, PARAPHRASED, DENSE = 0.3, 0.7, 0.5, 1.3
ITEMS, TOPICS, BUCKETS = 450, 32, 256
#: Bytes of text of a part of the benchmark, about; its vocabulary bounds what a task is sent.
PART_BYTES = 1 << 20
#: Sketches added up at once; blocks of words projected at once.
FAN, SLICE = 32, 1 << 15
#: Places of a table of windows and words that is filled at once.
TABLE = 1 << 22
#: Share of distinct items from which on a benchmark word is common, so that an answer does without it.
COMMON = 0.02
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def plain_words(text: bytes) -> list[bytes]:
    return [w.lower() for w in _WORD.findall(text)]


def _hashes(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    return W.words(data, np.array([0, len(data)]), W.MARKS)[0]


def _least(items: int) -> float:
    """In so many items a word is common."""
    return max(3, COMMON * items)


class Items:
    """Benchmark items: words, answers, and the vocabulary.

    ``common``: hashes of the words common in the whole benchmark; without it ``rows`` are the whole.
    """

    def __init__(self, rows: list[tuple[int, bytes]], common: set[int] | None = None):
        self.ids = [i for i, _ in rows]
        self.words = [plain_words(t) for _, t in rows]
        self.hashes = [_hashes(w) for w in self.words]
        self.counts = [dict(zip(*(x.tolist() for x in np.unique(h, return_counts=True)))) for h in self.hashes]
        # items of equal words count once
        seen: dict[int, int] = {}
        apart = {h.tobytes(): c for h, c in zip(self.hashes, self.counts) if c}
        for c in apart.values():
            for x in c:
                seen[x] = seen.get(x, 0) + 1
        if common is None:
            common = {x for x, n in seen.items() if n >= _least(len(apart))}
        rare = {x for x in seen if x not in common}
        # all words: items of common words only have copies too
        self.vocabulary = np.array(sorted(seen), dtype=np.uint64)
        self.quick = np.zeros(1 << 16, dtype=bool)
        self.quick[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        # distinct words of each item (vocabulary numbers), how often it has them, where they begin
        distinct = [len(c) for c in self.counts]
        self.begins = np.cumsum([0, *distinct])
        self.held = np.searchsorted(self.vocabulary, np.array([x for c in self.counts for x in c], dtype=np.uint64))
        self.often = np.array([n for c in self.counts for n in c.values()], dtype=np.int64)
        self.flat = np.concatenate([*self.hashes, np.zeros(0, dtype=np.uint64)])
        self.offsets = np.cumsum([0, *map(len, self.hashes)])
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.answers = []
        for (_, text), words in zip(rows, self.words):
            parts = [p for p in re.split(rb"(?<=[.!?])\s+", text.strip()) if plain_words(p)]
            last = plain_words(parts[-1]) if parts else []
            pick = [w for w, h in zip(last, _hashes(last).tolist()) if h in rare]
            self.answers.append(set(pick) or set(last))

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, vocabulary numbers) of the words of the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.quick[(h >> np.uint64(48)).astype(np.int64)])
        v = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
        hit = self.vocabulary[v] == h[at]
        return at[hit], v[hit]


def _spread(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) for every place of the ranges."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[which]


def _sums(rows: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of ``rows[at]`` of each), keys in order."""
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
    # pieces of up to 16 rows, whose k-th rows are added at once, then the sums of pieces
    head = np.flatnonzero(np.diff(keys, prepend=-1))
    sizes = np.diff(np.append(head, len(keys)))
    _, nth = _spread(np.zeros(len(head), dtype=np.int64), -(-sizes // 16))
    begins = np.repeat(head, -(-sizes // 16)) + nth * 16
    sizes = np.diff(np.append(begins, len(keys)))
    by = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[by], sizes[by]
    total = rows[at[begins]]
    for k in range(1, int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes, -k, side="left"))
        total[:n] += rows[at[begins[:n] + k]]
    back = np.empty_like(by)
    back[by] = np.arange(len(by))
    if len(begins) == len(head):
        return keys[head], total[back]
    return _sums(total, back, keys[np.sort(begins)])


class Sketch:
    """Sums over passages: their number, document frequencies and S A, by word."""

    def __init__(self, size: int):
        self.count, self.df, self.y = 0, np.zeros(size, dtype=np.int64), np.zeros((size, BUCKETS), dtype=np.int64)

    def add(self, passage: np.ndarray, v: np.ndarray, marks: np.ndarray) -> None:
        """Words ``v`` of the vocabulary, their passages' numbers, and a random number of each passage."""
        self.count += len(marks)
        if not len(v):
            return
        np.add.at(self.df, np.unique(passage * len(self.df) + v) % len(self.df), 1)
        own = marks[passage]
        bucket, sign = (own >> np.uint64(1)) % np.uint64(BUCKETS), (own & np.uint64(1)).astype(np.int64) * 2 - 1
        np.add.at(self.y.reshape(-1), v * BUCKETS + bucket.astype(np.int64), sign)


def _passages(rows: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """(first passage of each row, passages in all) for rows cut into runs of ``size`` words."""
    n = -(-np.diff(rows) // size)
    return np.cumsum(n) - n, int(n.sum())


def sketch(docs: DataFrame, text: str, items: Items) -> Sketch:
    """The sums over every passage of every text, added up by a tree of groups."""
    size = len(items.vocabulary)
    chunk = 128
    out = T.StructType.fromDDL("task int, chunk int, body binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, task = Sketch(size), TaskContext.get().partitionId()
        rng = np.random.default_rng([4, task])
        for batch in batches:
            for _, data, at in W.runs(batch.column(0)):
                h, _, _, rows = W.words(data, at, W.MARKS)
                first, n = _passages(rows, PASSAGE)
                place, v = items.lookup(h)
                row = np.searchsorted(rows, place, side="right") - 1
                own.add(first[row] + (place - rows[row]) // PASSAGE, v, rng.integers(0, 1 << 32, n, dtype=np.uint64))
        parts = [(-1, np.array([own.count], dtype=np.int64).tobytes())]
        for a in range(0, size, chunk):
            b = slice(a, a + chunk)
            if own.df[b].any():
                parts.append((a, np.hstack([own.df[b, None], own.y[b]]).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([task] * len(parts), pa.int32()), pa.array([a for a, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=out.names)

    def total(group: pa.Table) -> pa.Table:
        body = sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in group.column("body"))
        return pa.table({"task": group.column("task")[:1], "chunk": group.column("chunk")[:1], "body": pa.array([body.tobytes()], pa.binary())})

    texts = docs.select(F.col(text).cast("binary").alias("t"))
    tasks = texts.rdd.getNumPartitions()
    parts = arrow_map(texts, run, out)
    while tasks > 1:
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("task", "chunk").applyInArrow(total, out)
        tasks = -(-tasks // FAN)
    done = Sketch(size)
    for r in parts.toArrow().to_pylist():
        body = np.frombuffer(r["body"], dtype=np.int64)
        if r["chunk"] < 0:
            done.count = int(body[0])
        else:
            body = body.reshape(-1, 1 + BUCKETS)
            at = slice(r["chunk"], r["chunk"] + len(body))
            done.df[at], done.y[at] = body[:, 0], body[:, 1:]
    return done


def _directions(rows: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` right singular vectors of ``rows``, the strongest first, as columns."""
    if not rows.size:
        return np.zeros((rows.shape[1], 0))
    values, vectors = np.linalg.eigh(rows @ rows.T)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    good = values > 1e-10 * max(values.max(initial=0), 1e-300)
    return rows.T @ (vectors[:, good] / np.sqrt(values[good]))


class Space:
    """The latent space: word vectors scaled by inverse document frequency, and the items in it."""

    def __init__(self, items: Items, seen: Sketch):
        size = len(items.vocabulary)
        looked = [items.lookup(h)[1] for h in items.hashes]
        own = np.zeros((len(looked), size))
        for k, v in enumerate(looked):
            np.add.at(own[k], v, 1)
        idf = np.log((1 + seen.count + len(looked)) / (1 + seen.df + (own > 0).sum(axis=0))) + 1
        vectors = own * idf
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        topics = _directions((idf[:, None] * seen.y).T, TOPICS)
        rest = vectors - (vectors @ topics) @ topics.T
        rest[np.linalg.norm(rest, axis=1) < 1e-6] = 0
        left = np.hstack([topics, _directions(rest, len(rest))])
        self.word = (idf[:, None] * left).astype(np.float32)
        # verbatim copies are looked up by the word of an item that is rarest in the corpus
        by = sorted((int(v[seen.df[v].argmin()]), i) for i, v in enumerate(looked) if len(v))
        self.anchored = np.array([i for _, i in by], dtype=np.int64)
        self.anchors = np.searchsorted(np.array([v for v, _ in by], dtype=np.int64), np.arange(size + 1))
        self.ahead = np.array([int(np.flatnonzero(items.hashes[i] == items.vocabulary[v])[0]) for v, i in by], dtype=np.int64)
        self.items = (vectors @ left).astype(np.float32)


def common_subsequence(item: list[bytes], words: list[bytes], least: float = 0) -> tuple[int, int]:
    """(length of the longest common subsequence, words it spans in ``words``), by bit rows;
    a length under ``least`` has no span."""
    masks: dict[bytes, int] = {}
    for k, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1

    def lengths(seq: list[bytes], table: dict[bytes, int]) -> list[int]:
        row, out = full, []
        for w in seq:
            m = row & table.get(w, 0)
            row = (row + m | row - m) & full
            out.append(len(item) - row.bit_count())
        return out

    at = [k for k, w in enumerate(words) if w in masks]
    own = [words[k] for k in at]
    ahead = lengths(own, masks)
    if not ahead or not ahead[-1]:
        return 0, 0
    best = ahead[-1]
    if best < least:
        return best, 0
    end = ahead.index(best) + 1
    back: dict[bytes, int] = {}
    for k, w in enumerate(reversed(item)):
        back[w] = back.get(w, 0) | 1 << k
    return best, at[end - 1] - at[end - 1 - lengths(own[:end][::-1], back).index(best)] + 1


def leaks(item: list[bytes], answer: set[bytes], words: list[bytes]) -> float:
    """The share of the item that ``words`` hold in order, if that is a leak, else 0."""
    if not item:
        return 0.0
    n, span = common_subsequence(item, words, PARAPHRASED * len(item))
    share = n / len(item)
    if share >= COPIED and span <= 2 * len(item):
        return share
    if share >= PARAPHRASED and n >= 6:
        dense = span <= DENSE * n and n >= 10
        answered = len(answer & set(words)) * 2 > len(answer) and span <= 2 * len(item)
        if dense or answered:
            return share
    return 0.0


def _held(items: Items, place: np.ndarray, v: np.ndarray, i: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: np.ndarray) -> np.ndarray:
    """How many of item i's words are in the widest range lo..hi of its window's pairs; windows in order."""
    out = np.zeros(len(i), dtype=np.int64)
    if not len(i):
        return out
    head = np.flatnonzero(np.diff(window, prepend=-1))
    number = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(i))))
    a, z = np.searchsorted(place, np.minimum.reduceat(lo, head)), np.searchsorted(place, np.maximum.reduceat(hi, head))
    step = max(1, TABLE // len(items.vocabulary))
    there = np.zeros((min(step, len(head)), len(items.vocabulary)), dtype=bool)
    for k in range(0, len(head), step):
        which, at = _spread(a[k : k + step], z[k : k + step] - a[k : k + step])
        there[which, v[at]] = True
        pairs = slice(*np.searchsorted(number, [k, k + step]))
        own = i[pairs]
        pair, word = _spread(items.begins[own], items.begins[own + 1] - items.begins[own])
        found = there[number[pairs][pair] - k, items.held[word]]
        out[pairs] = np.bincount(pair, weights=found * items.often[word], minlength=len(own))
        there[which, v[at]] = False
    return out


def _verbatim(items: Items, space: Space, h: np.ndarray, rows: np.ndarray, row: np.ndarray, place: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, first word, number of the anchor's hit) of the items whose words stand there one after another."""
    hit, at = _spread(space.anchors[v], space.anchors[v + 1] - space.anchors[v])
    i = space.anchored[at]
    start = place[hit] - space.ahead[at]
    good = np.flatnonzero((start >= rows[row[hit]]) & (start + items.sizes[i] <= rows[row[hit] + 1]))
    for share in (0, 0.25, 0.5, 0.75, 1):  # a few words first
        k = ((items.sizes[i[good]] - 1) * share).astype(np.int64)
        good = good[h[start[good] + k] == items.flat[items.offsets[i[good]] + k]]
    for g in good.tolist():
        own = items.hashes[i[g]]
        if (h[start[g] : start[g] + len(own)] == own).all():
            yield int(row[hit[g]]), int(i[g]), int(start[g]), int(hit[g])


def _matches(items: Items, space: Space, data: np.ndarray, at: np.ndarray) -> list[dict[int, tuple[float, float]]]:
    """For each row: item -> (share, cosine) of its leaks."""
    h, starts, ends, rows = W.words(data, at, W.MARKS)
    found: list[dict[int, tuple[float, float]]] = [{} for _ in range(len(rows) - 1)]
    first, blocks = _passages(rows, STEP)
    place, v = items.lookup(h)
    if not len(place):
        return found
    row = np.searchsorted(rows, place, side="right") - 1
    block = first[row] + (place - rows[row]) // STEP
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(np.append(first, blocks)))
    words = lambda lo, hi: [data[x:y].tobytes().lower() for x, y in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
    for low in range(0, blocks, SLICE):
        part = slice(*np.searchsorted(block, [low, low + SLICE + SPAN - 1]))
        if part.start == part.stop:
            continue
        which, sums = _sums(space.word, v[part], block[part])
        dense = np.zeros((min(SLICE, blocks - low) + 2 * SPAN, space.word.shape[1]), dtype=np.float32)
        dense[which - low] = sums
        # windows that begin at a block with such words, or up to SPAN - 1 blocks before it
        begin = np.unique(np.concatenate([which - k for k in range(SPAN)]))
        begin = begin[(begin >= low) & (begin < low + SLICE)]
        total = dense[begin - low].copy()
        for k in range(1, SPAN):
            same = (begin + k < blocks) & (owner[np.minimum(begin + k, blocks - 1)] == owner[begin])
            total += dense[begin - low + k] * same[:, None]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        cosine = (total @ space.items.T) / np.maximum(norm, 1e-12)
        b, i = np.nonzero(cosine >= NEAR)
        r = owner[begin[b]]
        lo = rows[r] + (begin[b] - first[r]) * STEP
        lo, hi = np.maximum(rows[r], lo - items.sizes[i]), np.minimum(rows[r + 1], lo + STEP * SPAN + items.sizes[i])
        # no subsequence is longer than the item's words that are there at all
        enough = np.flatnonzero(_held(items, place, v, i, lo, hi, b) >= PARAPHRASED * items.sizes[i])
        for r, b, i, lo, hi in zip(*(x[enough].tolist() for x in (r, b, i, lo, hi))):
            held = found[r].get(i)
            if held and held[0] >= 1.0:
                continue
            there = items.counts[i].keys() & h[lo:hi].tolist()
            if sum(items.counts[i][w] for w in there) < PARAPHRASED * len(items.words[i]):
                continue
            share = leaks(items.words[i], items.answers[i], words(lo, hi))
            if share and (not held or share > held[0]):
                found[r][i] = (share, float(cosine[b, i]))
        part = slice(part.start, int(np.searchsorted(block, low + SLICE)))
        for r, i, lo, k in _verbatim(items, space, h, rows, row[part], place[part], v[part]):
            if i not in found[r] or found[r][i][0] < 1.0:
                if share := leaks(items.words[i], items.answers[i], words(lo, lo + len(items.words[i]))):
                    found[r][i] = (share, float(cosine[np.searchsorted(begin, block[part.start + k]), i]))
    return found


MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("cosine", T.DoubleType())]))


def common_words(items: DataFrame, count: int) -> set[int]:
    """Hashes of the words that are common among the ``count`` distinct texts ``t`` of items.

    They are few: at most 1 / COMMON times the words of an item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(_hashes(plain_words(t))).view(np.int64) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], names=["h"])

    seen = arrow_map(items.select("t").distinct(), run, "h long").groupBy("h").count().where(F.col("count") >= _least(count))
    return set(seen.select("h").toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64).tolist())


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """``docs`` with ``leaks``: array of struct<item_id, share, cosine> by item_id; empty for clean texts."""
    items = benchmark.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).cast("binary").alias("t")).where("i is not null and t is not null")
    count, size = items.agg(F.count("*"), F.sum(F.length("t"))).first()
    parts = max(1, -(-count // ITEMS), -(-(size or 0) // PART_BYTES))
    common = common_words(items, items.select("t").distinct().count()) if parts > 1 else None
    names = [c for c in docs.columns if c != "leaks"]
    spot = names.index(text)
    out = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part).orderBy("i", "t").toArrow()
        own = Items(list(zip(rows["i"].to_pylist(), rows["t"].to_pylist())), common)
        out = _marked(out, docs, own, text, f"c{spot}", f"leaks{part}")
    lists = [F.col(f"leaks{p}") for p in range(parts)]
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], F.array_sort(F.flatten(F.array(*lists))).alias("leaks"))


def _marked(df: DataFrame, docs: DataFrame, items: Items, text: str, own: str, name: str) -> DataFrame:
    size = len(items.vocabulary)
    if not size:
        return df.withColumn(name, F.array().cast(MATCHES))
    space = Space(items, sketch(docs, text, items))
    out = T.StructType([*df.schema.fields, T.StructField(name, MATCHES)])
    spot = df.columns.index(own)
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = []
            for _, data, at in W.runs(batch.column(spot)):
                for hits in _matches(items, space, data, at):
                    found.append([{"item_id": items.ids[i], "share": s, "cosine": c} for i, (s, c) in sorted(hits.items())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=out.names)

    return arrow_map(df, run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return done.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"),
        F.coalesce(F.round(F.array_max(F.transform("leaks", lambda x: x["share"])), 6), F.lit(0.0)).alias("best_share"),
    )
