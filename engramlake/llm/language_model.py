"""Operator 13: language-model scoring with a gated recurrent network.

A text is its words (A-Z in lower case) and one end.  The network reads symbols:
the ``HEAD`` most frequent words as they are, any other word as its ending, one
of the ``ENDINGS`` heaviest or "other".  Its output is factored by classes: a
softmax over frequency classes of head words and over endings, then within a
class of head words a softmax of its own, and within an ending the smoothed
share (c + 0.5) / (N_k + 0.5 (V_k + 1)) of the word's count over the whole
training corpus.  So a text's probability is that of its very words, one unseen
word a class included.  Scoring carries the state from window to window through
the whole text and starts anew at a text.

Plan.  (1) Words of all training texts are counted: each task counts what it
reads, then one shuffle of (word, count); the table is written.  (2) Words above
a count that at most ``KNOWN`` words reach go with the model to the tasks; the
endings' sums are an aggregate.  (3) The network's weights are fitted by
truncated backpropagation on every token of all training texts.  Texts are dealt
by hash to shards of about ``PIECE`` tokens, each a task of one of ``ROUNDS`` rounds, after
which the weights of its tasks are averaged; a corpus of ``SHARDS`` shards or fewer
takes all of them in every round.  (4) All texts are
scored in a narrow step; the words beyond those known are dealt by word to the
table of counts (a join that skew splitting applies to), and their sums of a
text come back, keyed by row.

Defined results: a null or empty text has one token, its end; rows without key
are not held out and not learnt from; equal texts get scores equal to about six
digits, as sums of a batch are in single precision; with nothing to learn from
both scores are 0; repeated rows count and come back each; other columns are
untouched, but those named as in ``ADDED`` are replaced.
"""

from __future__ import annotations

import copy
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.llm.byte_bpe import _slices
from engramlake.llm.shared import arrow_map, materialize, table

HEAD, ENDINGS, CLASSES, KNOWN = 2048, 96, 48, 1 << 16
HIDDEN, STEPS, LANES, MOST_LANES = 24, 32, 64, 256
#: Tokens of a shard, the fewest shards, rounds, and the fewest updates of a task in a round.
PIECE, SHARDS, ROUNDS, UPDATES = 1_000_000, 4, 4, 120
RATE, CLIP = 0.02, 1.0
#: Lanes and steps of scoring, and distinct words that a task counts before it hands them on.
WIDE, LONG, DISTINCT = 256, 64, 400_000
#: Buckets of a doubling of counts.
FINE = 32
ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
END = b""


def words(text: bytes) -> list[bytes]:
    """Words of a text: bytes.split() parts at the six ASCII blanks, bytes.lower() changes A-Z only."""
    return text.lower().split()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights and what is computed with them; symbols are head words, then endings."""

    def __init__(self, mass: np.ndarray, head: int, seed: int = 1):
        """``mass``: the count of each symbol over the training corpus, head words by falling count."""
        rng = np.random.default_rng(seed)
        self.head = head
        root = np.cumsum(np.sqrt(mass[:head] + 0.5))
        of = np.minimum((root / root[-1] * CLASSES).astype(int), CLASSES - 1) if head else np.zeros(0, int)
        _, of = np.unique(of, return_inverse=True)
        classes = int(of.max()) + 1 if head else 0
        self.starts = np.searchsorted(of, np.arange(classes + 1))
        self.of = np.concatenate([of, classes + np.arange(len(mass) - head)]).astype(np.int32)
        total = np.bincount(self.of, weights=mass + 0.5)
        size = len(mass)
        f = np.float32
        self.w = {
            "x": rng.normal(0, 0.3, (size, 3 * HIDDEN)).astype(f),
            "u": (rng.normal(0, 1, (HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(f),
            "c": rng.normal(0, 0.05, (HIDDEN, len(total))).astype(f),
            "cb": np.log(total / total.sum()).astype(f),
            "v": rng.normal(0, 0.05, (head, HIDDEN)).astype(f),
            "vb": np.log(mass[:head] + 0.5).astype(f),
        }

    def states(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, tape: list | None = None) -> np.ndarray:
        """The states after each step: (steps, lanes, HIDDEN); a step of keep 0 starts anew."""
        u, table = self.w["u"], self.w["x"]
        out = np.empty((*x.shape, HIDDEN), u.dtype)
        for t in range(len(x)):
            h = h * keep[t][:, None]
            g = table[x[t]]
            a = h @ u
            zr = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if tape is not None:
                tape.append((h, z, r, n, a[:, 2 * HIDDEN :]))
            out[t] = h = new
        return out

    def log_probability(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Natural log of the probability of symbols ``y`` after states ``h``.  With
        ``grads``, adds the gradients of minus its sum; those of the states are in "h"."""
        rows = np.arange(len(y))
        of = self.of[y]
        logit = h @ self.w["c"] + self.w["cb"]
        logit -= logit.max(axis=1, keepdims=True)
        own = logit[rows, of]
        np.exp(logit, out=logit)
        total = logit.sum(axis=1)
        out = own - np.log(total)
        if grads is not None:
            logit /= total[:, None]
            logit[rows, of] -= 1
            grads["c"] += h.T @ logit
            grads["cb"] += logit.sum(axis=0)
            grads["h"] = logit @ self.w["c"].T
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(len(self.starts)))
        for k in range(len(self.starts) - 1):
            at = order[bounds[k] : bounds[k + 1]]
            a, b = self.starts[k], self.starts[k + 1]
            if not len(at) or b - a == 1:
                continue
            s, p = h[at], y[at] - a
            inner = s @ self.w["v"][a:b].T + self.w["vb"][a:b]
            inner -= inner.max(axis=1, keepdims=True)
            mine = inner[np.arange(len(at)), p]
            np.exp(inner, out=inner)
            total = inner.sum(axis=1)
            out[at] += mine - np.log(total)
            if grads is not None:
                inner /= total[:, None]
                inner[np.arange(len(at)), p] -= 1
                grads["v"][a:b] += inner.T @ s
                grads["vb"][a:b] += inner.sum(axis=0)
                grads["h"][at] += inner @ self.w["v"][a:b]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Mean loss of a window, its gradients (cut at the window's start) and the last states."""
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        tape: list = []
        states = self.states(x, keep, h, tape)
        loss = -self.log_probability(states.reshape(-1, HIDDEN), y.reshape(-1), grads).mean()
        outer = grads.pop("h").reshape(states.shape)
        u, d = self.w["u"], np.zeros_like(h)
        at = np.empty((*x.shape, 3 * HIDDEN), u.dtype)
        for t in range(len(x) - 1, -1, -1):
            old, z, r, n, a = tape[t]
            d = d + outer[t]
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (old - n) * z * (1 - z)
            dr = dn * a * r * (1 - r)
            at[t] = np.hstack([dz, dr, dn])
            inner = np.hstack([dz, dr, dn * r])
            grads["u"] += old.T @ inner
            d = (d * z + inner @ u.T) * keep[t][:, None]
        flat, ids = at.reshape(-1, 3 * HIDDEN), x.reshape(-1)
        order = np.argsort(ids, kind="stable")
        seen, first = np.unique(ids[order], return_index=True)
        grads["x"][seen] = np.add.reduceat(flat[order], first)
        return float(loss), {k: g / y.size for k, g in grads.items()}, states[-1]

    def train(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, offset: int, updates: int, rate: float) -> float:
        """Adam over windows of a stream (steps, lanes) from a place on; the mean loss."""
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        h, total = np.zeros((x.shape[1], HIDDEN), np.float32), 0.0
        for i in range(1, updates + 1):
            at = (offset + (i - 1) * STEPS) % max(1, len(x) - STEPS + 1)
            window = slice(at, at + STEPS)
            loss, grads, h = self.gradients(x[window], y[window], keep[window], h)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            shrink = min(1.0, CLIP / (norm + 1e-9))
            for k, g in grads.items():
                g *= shrink
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.w[k] -= rate * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-6)
            total += loss
        return total / updates

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """The log10 probability of each text's symbols (its end is the last one).

        Texts are laid one behind another on lanes of like length; windows of
        ``LONG`` steps go over the lanes that still have symbols.
        """
        out = np.zeros(len(texts))
        if not texts:
            return out
        lanes: list[list[int]] = [[] for _ in range(min(WIDE, len(texts)))]
        free = [(0, k) for k in range(len(lanes))]
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
            used, k = heapq.heappop(free)
            lanes[k].append(i)
            heapq.heappush(free, (used + len(texts[i]), k))
        lanes.sort(key=lambda own: -sum(len(texts[i]) for i in own))
        y = [np.concatenate([texts[i] for i in own]) for own in lanes]
        of = [np.repeat(own, [len(texts[i]) for i in own]) for own in lanes]
        length = np.array([len(s) for s in y])
        end = texts[0][-1]
        h = np.zeros((len(lanes), HIDDEN), np.float32)
        last = np.full(len(lanes), end, np.int32)
        for at in range(0, length[0], LONG):
            live = int((length > at).sum())
            steps = int(min(LONG, length[0] - at))
            ys = np.full((steps, live), end, np.int32)
            text = np.full((steps, live), -1, np.int64)
            for k in range(live):
                own = y[k][at : at + steps]
                ys[: len(own), k] = own
                text[: len(own), k] = of[k][at : at + steps]
            xs = np.vstack([last[None, :live], ys[:-1]])
            keep = (xs != end).astype(np.float32)  # behind an end begins a text
            states = self.states(xs, keep, h[:live])
            h, last = states[-1], ys[-1]
            real = text.reshape(-1) >= 0
            p = self.log_probability(states.reshape(-1, HIDDEN)[real], ys.reshape(-1)[real])
            out += np.bincount(text.reshape(-1)[real], weights=p, minlength=len(texts))
        return out / np.log(10)


class Model:
    """What tasks need to score texts; its size is bounded by ``KNOWN`` and ``HEAD``."""

    def __init__(self, total: int, distinct: int, known: list[tuple[bytes, int]], endings: dict[bytes, tuple[int, int]], least: int):
        """``known``: words with a count in a bucket of ``least`` or more, and their
        counts; ``endings``: tokens and distinct words of each of the heaviest
        endings of all words, and under None of the others."""
        self.total, self.distinct, self.least = total, distinct, least
        known = sorted(known, key=lambda x: (-x[1], x[0]))
        head = [x for x in known if x[0] != END][: HEAD - 1]
        head = sorted([*head, *[x for x in known if x[0] == END]], key=lambda x: (-x[1], x[0]))
        mass = {e: list(x) for e, x in endings.items()}
        for w, c in head:  # head words are no part of their ending
            own = mass[w[-2:] if w[-2:] in mass else None]
            own[0], own[1] = own[0] - c, own[1] - 1
        order = [None, *sorted(e for e in mass if e is not None)]
        self.ending = {e: len(head) + k for k, e in enumerate(order)}
        self.other = self.ending.pop(None)
        symbol = {w: k for k, (w, _) in enumerate(head)}
        self.place = {w: k for k, (w, _) in enumerate(known)}
        self.symbol = np.array([symbol[w] if w in symbol else self.symbol_of(w) for w, _ in known] or [0], dtype=np.int32)
        self.share = np.log10(np.array([c for _, c in known] or [0]) + 0.5)
        self.end, self.known_end = symbol.get(END, 0), self.place.get(END, 0)
        # within an ending every word is divided by the same sum; head words have a softmax
        self.divisor = np.concatenate([np.zeros(len(head)), [np.log10(mass[e][0] + 0.5 * (mass[e][1] + 1)) for e in order]])
        self.base_divisor = float(np.log10(total + 0.5 * (distinct + 1)))
        self.tail = len(head)
        self.network = Network(np.array([c for _, c in head] + [mass[e][0] for e in order], dtype=float), len(head)) if total else None

    def symbol_of(self, word: bytes) -> int:
        return self.ending.get(word[-2:], self.other)

    def read(self, text: bytes) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
        """The places in ``known`` (-1: not there) and the symbols of a text's tokens, and how often each word not there occurs."""
        tokens = words(text)
        places = np.fromiter(map(self.place.get, tokens, [-1] * len(tokens)), np.int32, len(tokens))
        symbols = self.symbol[places]
        rare: dict[bytes, int] = {}
        if len(at := np.flatnonzero(places < 0)):
            own = [tokens[i] for i in at.tolist()]
            symbols[at] = [self.symbol_of(w) for w in own]
            rare = Counter(own)
        return np.append(places, np.int32(self.known_end)), np.append(symbols, np.int32(self.end)), rare


def learnt_from(key: str) -> Column:
    """Rows that the model may learn from: those whose key's hash is not in the held-out fold."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 5 != 1, F.lit(False))


def count_words(texts: DataFrame, text: str) -> DataFrame:
    """(word, c) of all texts, the end as an empty word.  A task hands on its own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            ws, ns = list(found), list(found.values())
            found.clear()
            for k in range(0, len(ws), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(ws[k : k + 20_000], pa.binary()), pa.array(ns[k : k + 20_000], pa.int64())], names=["word", "n"])

        for batch in batches:
            for _, rows in _slices(batch, "t"):
                for x in rows:
                    found.update(words(x))
                    found[END] += 1
                    if len(found) > DISTINCT:
                        yield from told()
        yield from told()

    counted = arrow_map(texts.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t")), run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("c"))


def _bucket() -> Column:
    return F.floor(F.log2(F.col("c")) * FINE).cast("int")


def _known(counts: DataFrame) -> tuple[int, list[tuple[bytes, int]]]:
    """The least bucket of counts that at most KNOWN words reach, the end apart, and those words."""
    sizes = sorted(((r.b, r.n) for r in counts.groupBy(_bucket().alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = sizes[0][0] + 1, 0
    for b, n in sizes:
        if (held := held + n) > KNOWN:
            break
        least = b
    rows = counts.where((_bucket() >= least) | (F.col("word") == F.lit(bytearray(END)))).collect()
    return least, [(bytes(r.word), r.c) for r in rows]


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[Model, DataFrame]:
    """A model from the rows of ``docs`` that may be learnt from, and the table (word, c) of their words."""
    train = docs.where(learnt_from(key))
    counts = materialize(count_words(train, text), "lm-counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    if not sums.v:
        return Model(0, 0, [], {None: (0, 0)}, 0), counts
    least, known = _known(counts)
    ending = F.expr("substring(word, -2, 2)")
    by_ending = counts.groupBy(ending.alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    endings = {bytes(r.e): (r.n, r.v) for r in by_ending.where(F.length("e") > 0).orderBy(F.desc("n"), "e").limit(ENDINGS).collect()}
    endings[None] = (sums.n - sum(n for n, _ in endings.values()), sums.v - sum(v for _, v in endings.values()))
    model = Model(sums.n, sums.v, known, endings, least)
    _train(model, train, text, key)
    return model, counts


def _shards(total: int) -> int:
    """Shards of ``total`` tokens: SHARDS that all rounds take, or more, each of one round."""
    return SHARDS if total <= SHARDS * PIECE else -(-total // (PIECE * ROUNDS)) * ROUNDS


def _train(model: Model, train: DataFrame, text: str, key: str) -> list[int]:
    """Fits the network on all tokens of ``train``, a task a shard, and averages the weights after each round; the tokens that rounds read."""
    shards = _shards(model.total)
    column = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    place = F.pmod(F.xxhash64(F.lit("lm"), F.col(f"`{key}`"), column), F.lit(1 << 40))
    dealt = train.select((place % shards).cast("int").alias("shard"), place.alias("place"), column.alias("t"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in _slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([model.read(x)[1].astype(np.uint16).tobytes() for x in rows], pa.binary())], names=["shard", "place", "symbols"])

    texts = materialize(arrow_map(dealt, encode, "shard int, place long, symbols binary"), "lm-symbols")
    names, end = sorted(model.network.w), model.end
    shapes = {k: model.network.w[k].shape for k in names}

    def round_of(begun: Network, k: int):
        def run(shard: pa.Table) -> pa.Table:
            network = copy.deepcopy(begun)  # a task may get two shards
            rows = sorted(zip(shard["place"].to_pylist(), shard["symbols"].to_pylist()))
            y = np.frombuffer(b"".join(s for _, s in rows), dtype=np.uint16).astype(np.int32)
            tokens = y.size
            lanes = max(1, min(MOST_LANES, max(LANES, tokens // (UPDATES * STEPS)), tokens // (2 * STEPS)))
            # whole windows, the last ones filled from the beginning: a pass reads every token
            windows = -(-tokens // (lanes * STEPS))
            y = np.resize(y, windows * STEPS * lanes).reshape(lanes, windows * STEPS).T
            x = np.vstack([np.full((1, lanes), end, np.int32), y[:-1]])
            keep = (x != end).astype(np.float32)
            offset = 0 if shards > SHARDS else k * UPDATES * STEPS
            network.train(x, y, keep, offset, max(UPDATES, windows), RATE / (1 + k))
            whole = np.concatenate([network.w[n].ravel() for n in names])
            return pa.table({"shard": shard["shard"][:1], "weights": [(whole.astype(float) * tokens).tobytes()], "tokens": pa.array([tokens], pa.int64())})

        return run

    def summed(part: pa.Table) -> pa.Table:
        part = part.sort_by("shard")
        total = sum(np.frombuffer(w.as_py()) for w in part["weights"])
        return pa.table({"weights": [total.tobytes()], "tokens": pa.array([sum(part["tokens"].to_pylist())], pa.int64())})

    read = []
    for k in range(ROUNDS):
        own = texts if shards <= SHARDS else texts.where(F.col("shard") % ROUNDS == k)
        tasks = shards if shards <= SHARDS else shards // ROUNDS
        done = own.repartition(4 * tasks, "shard").groupBy("shard").applyInArrow(round_of(model.network, k), "shard int, weights binary, tokens long")
        # weights are added up in as many parts as a part has shards, so neither a task nor the driver holds all
        parts = done.groupBy(F.pmod(F.xxhash64("shard"), F.lit(max(1, int(np.sqrt(tasks))))).alias("part"))
        rows = sorted((r.tokens, bytes(r.weights)) for r in parts.applyInArrow(summed, "weights binary, tokens long").collect())
        tokens = sum(n for n, _ in rows)
        read.append(tokens)
        if not tokens:
            continue
        mean = sum(np.frombuffer(w) for _, w in rows) / tokens
        cuts = np.cumsum([0, *[int(np.prod(shapes[n])) for n in names]])
        model.network.w = {n: mean[a:b].astype(np.float32).reshape(shapes[n]) for n, a, b in zip(names, cuts, cuts[1:])}
    return read


_LOCAL = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")],
        *[T.StructField(c, T.DoubleType()) for c in ("shares", "own")],
        T.StructField("rare", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())]))),
    ]
)


def score(df: DataFrame, model: Model, counts: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without the text and with n_tokens, n_known, train_tokens, base_score and score."""
    names = [c for c in df.columns if c != text and c not in ADDED]
    fields = [T.StructField(f"c{k}", df.schema[c].dataType) for k, c in enumerate(names)]
    schema = T.StructType([*fields, T.StructField("row", T.LongType()), *_LOCAL])
    pair = pa.struct([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in _slices(batch, "t"):
                read = [model.read(x) for x in rows]
                n = np.array([len(p) for p, _, _ in read])
                at = np.concatenate([[0], np.cumsum(n)[:-1]])
                places, symbols = np.concatenate([p for p, _, _ in read]), np.concatenate([s for _, s, _ in read])
                sums = lambda x, at=at: np.add.reduceat(x, at)
                if model.network is None:
                    known, shares, own = n * 0, n * 0.0, n * 0.0
                else:
                    share = np.where(places >= 0, model.share[places], 0.0)
                    known, shares = sums((places >= 0).astype(np.int64)), sums(share)
                    # what endings' words have besides the network: their share within the ending
                    inner = np.where(symbols >= model.tail, share - model.divisor[symbols], 0.0)
                    own = model.network.score([s for _, s, _ in read]) + sums(inner)
                rare = [[{"word": w, "n": k} for w, k in r.items()] for _, _, r in read]
                columns = [*[part.column(1 + k) for k in range(len(names) + 1)], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(shares), pa.array(own), pa.array(rare, pa.list_(pair))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    plain = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], F.monotonically_increasing_id().alias("row"))
    local = materialize(arrow_map(plain, run, schema), "lm-scores")
    rare = local.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    c = F.coalesce(F.col("c"), F.lit(0))
    found = rare.join(counts.where(_bucket() < model.least), "word", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10(c + 0.5)).alias("more"))
    all_rows = local.drop("rare").join(found, "row", "left")
    more = F.coalesce(F.col("more"), F.lit(0.0)) if model.total else F.lit(0.0)
    return all_rows.select(
        *[F.col(f"c{k}").alias(x) for k, x in enumerate(names)],
        "n_tokens",
        (F.col("n_known") + F.coalesce(F.col("more_known"), F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("shares") + more - F.col("n_tokens") * F.lit(model.base_divisor if model.total else 0.0)).alias("base_score"),
        (F.col("own") + more).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = fit(docs)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)).alias("held_out")
    return score(docs.select("doc_id", held_out, "text"), model, counts)
