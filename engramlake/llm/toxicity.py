"""Operator 6: toxicity by a subsequence string-kernel SVM with Nystrom landmarks.

The kernel compares words by their common subsequences of four characters (a
word's beginning counts as one), each step of which may pass over an inserted
character, at a decay per character passed over (Lodhi et al., 2002, with bounded gaps); it is normalised
by the weight of a word's own subsequences.  So ``idxiot`` and ``idiiot`` stay
near ``idiot``, and a word on the toxic side is read with each of its characters
passed over as well, for an inserted one.  Runs of single letters count as one word, and a word with marks
or spaces between letters is read without them besides, so ``i d i o t``,
``i.d.i.o.t`` and ``id*iot`` score as ``idiot``.  A text scores by its strongest
word and by its third strongest (distinct ones), as a stem that clean texts may
hold once is telling where it is met again and again.

Training is multiple-instance: labels are of texts, so the words of toxic
training texts whose letter n-grams are far more frequent there start as
positive, words of clean texts are negative, and a linear SVM (squared hinge,
Newton steps) over Nystrom features relabels the positive texts' words and is
fitted again.  Logistic fits of either strength against the text's label calibrate
scores, clean texts as a class weighing CLEAN times the toxic ones, and the
higher one counts.

In scoring, landmarks and coefficients fold into one weight per subsequence
feature, which is the same number; words are never Python objects.

Learning uses a sample of about ``SAMPLE`` labelled texts outside the held-out
fold, of each its distinct words; everything else covers all rows and
whole texts.  Defined results: null, empty or wordless texts get the score of
no evidence; rows without doc_id are not held out; repeated rows get equal
scores; labels other than 0 and 1 are not learnt from; without both labels to
learn from, every score is 0; columns named ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

import itertools
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm import wordhash as W
from engramlake.llm.language_id import held_out
from engramlake.llm.shared import arrow_map, bounded_sample, table

#: Labelled texts to learn from, about, by label.
SAMPLE = {0: 6000, 1: 1500}
LANDMARKS = 440
#: Weight of the clean class against the toxic one in the calibration.
CLEAN = 6.0
#: Log-likelihood ratio that an n-gram's words need to start as positive.
EVIDENCE = 16.0
#: Gapped copies of each of the hundred most frequent positive words.
GAPPED = 12
#: How many times likelier than chance its texts must be toxic.
ODDS = 6.0
#: Decay per character passed over, steps up to this long, bytes of a word; longer ones are read in pieces that share LAP bytes.
DECAY, STEP, WORD, LAP = 0.8, 2, 32, 16
ROUNDS, COST, HARD = 6, 3.0, 1200
#: Bytes of words scored at once.
PART = 1 << 20
_SYMBOLS = 40

_CODE = np.full(256, 28, dtype=np.int32)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[48:58] = 27
# bytes beyond ASCII: upper and lower case of Latin letters differ in one bit
_CODE[128:] = 29 + (np.arange(128, 256) | 0x20) % 11
#: All ASCII bytes but letters.
_MARKS = bytes(k for k in range(128) if not chr(k).isalpha())
_STEPS = list(itertools.product(range(1, STEP + 1), repeat=3))
_OWN = np.array([sum(max(0, n - sum(d)) * DECAY ** (2 * (sum(d) - 3)) for d in _STEPS) for n in range(WORD + 2)])
_NORM = np.sqrt(np.maximum(_OWN, 1e-12))


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words to score, and offsets of rows into them.

    Words end at white space; three or more words of one byte in a row are one;
    words beyond WORD bytes are cut into pieces that overlap.
    """
    _, starts, ends, rows = W.words(data, at)
    if not len(starts):
        return starts, ends, rows
    size = ends - starts
    row = np.repeat(np.arange(len(at) - 1), np.diff(rows))
    single = size == 1
    chained = np.zeros(len(starts), dtype=bool)
    chained[1:] = single[1:] & single[:-1] & (row[1:] == row[:-1])
    if chained.any():
        first = np.flatnonzero(~chained)
        count = np.diff(np.append(first, len(starts)))
        joins = np.repeat(count >= 3, count)
        head = ~(chained & joins)
        last = np.append(np.flatnonzero(head)[1:], len(starts)) - 1
        starts, ends, row = starts[head], ends[last], row[head]
        size = ends - starts
    pieces = np.maximum(1, -(-(size - LAP) // (WORD - LAP)))
    if (pieces > 1).any():
        which = np.repeat(np.arange(len(starts)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, row, ends = starts[which] + nth * (WORD - LAP), row[which], ends[which]
        ends = np.minimum(ends, starts + WORD)
    return starts, ends, np.searchsorted(row, np.arange(len(at)))


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols left to the end of the word, first places): each word with
    a symbol before it, 0 where it begins and a mark where a long word goes on."""
    size = ends - starts + 1
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(first, size).astype(np.int32)
    code = _CODE[data[np.maximum(within + np.repeat(starts - 1, size), 0)]]
    code[first] = np.where((starts == 0) | W._SPACE[data[np.maximum(starts - 1, 0)]], 0, 28)
    return code, np.repeat(size, size).astype(np.int32) - within, first


def features(code: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(places, feature ids, weight) of all subsequences within words, step by step."""
    for a, b, c in _STEPS:
        n = len(code) - a - b - c
        if n > 0:
            at = np.flatnonzero(left[:n] > a + b + c)
            ids = code[at]
            for d in (a, a + b, a + b + c):
                ids = ids * _SYMBOLS + code[at + d]
            yield at, ids, DECAY ** (a + b + c - 3)


def _scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    code, left, first = packed(data, starts, ends)
    total = np.zeros(len(code), dtype=np.float32)
    for at, ids, w in features(code, left):
        total[at] += weights[ids] * np.float32(w)
    return np.add.reduceat(total, first) / _NORM[ends - starts + 1].astype(np.float32)


def _parted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words have something other than letters between letters."""
    size = ends - starts
    first = np.cumsum(size) - size
    b = data[np.arange(int(size.sum())) - np.repeat(first - starts, size)]
    letter = ((b | 0x20) >= 97) & ((b | 0x20) <= 122) | (b >= 128)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    begins[first] = letter[first]
    return np.add.reduceat(begins, first, dtype=np.int64) > 1


def word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The kernel expansion of each word, folded into ``weights``."""
    out = np.zeros(len(starts), dtype=np.float32)
    size = np.cumsum(ends - starts)
    cuts = np.unique(np.searchsorted(size, np.arange(0, int(size[-1]) if len(size) else 0, PART)).tolist() + [len(starts)])
    for lo, hi in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
        if lo == hi:
            continue
        a, z = starts[lo:hi], ends[lo:hi]
        out[lo:hi] = _scores(data, a, z, weights)
        if len(parted := np.flatnonzero(_parted(data, a, z))):
            bare = [bytes(data[x:y]).translate(None, _MARKS) for x, y in zip(a[parted].tolist(), z[parted].tolist())]
            out[lo + parted] = np.maximum(out[lo + parted], _scores(*_joined(bare), weights))
    return out


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(w) + 1 for w in words])
    return np.frombuffer(b"".join(b" " + w for w in words), dtype=np.uint8), ends - [len(w) for w in words], ends


def sparse(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature, value) of the normalised features of words."""
    data, starts, ends = _joined(words)
    code, left, first = packed(data, starts, ends)
    parts = [(np.searchsorted(first, at, side="right") - 1, ids, np.full(len(at), w)) for at, ids, w in features(code, left)]
    word, ids, value = (np.concatenate([p[k] for p in parts]) for k in range(3))
    return word, ids, value / _NORM[ends - starts + 1][word]


def nystrom(words: list[bytes], known: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Normalised features of words times ``fold``, whose rows are the features ``known``; then a column of ones."""
    out = np.zeros((len(words), fold.shape[1] + 1))
    for k in range(0, len(words), 400):
        word, ids, value = sparse(words[k : k + 400])
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        hit = known[at] == ids
        order = np.argsort(word[hit], kind="stable")
        word, at, value = word[hit][order], at[hit][order], value[hit][order]
        if len(word):
            head = np.flatnonzero(np.diff(word, prepend=-1))
            out[k + word[head], :-1] = np.add.reduceat(fold[at] * value[:, None].astype(np.float32), head)
    out[:, -1] = 1
    return out


def _apart(bags: list[list[bytes]]) -> list[int]:
    """Indices without texts whose words are mostly those of an earlier one (by eight minima of hashes)."""
    held: dict[tuple[int, int], list[int]] = {}
    out = []
    for k, bag in enumerate(bags):
        if not bag:
            continue
        h = np.array([int.from_bytes(w[:8], "little") ^ len(w) << 56 ^ zlib.crc32(w) << 13 for w in bag], dtype=np.uint64)
        least = [int(W.mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))).min()) for i in range(8)]
        shared: dict[int, int] = {}
        for i, m in enumerate(least):
            for j in held.get((i, m), ()):
                shared[j] = shared.get(j, 0) + 1
        if max(shared.values(), default=0) < 4:
            out.append(k)
            for i, m in enumerate(least):
                held.setdefault((i, m), []).append(k)
    return out


def bag(text: bytes) -> list[bytes]:
    """Its distinct words as they are scored, in lower case."""
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends, _ = spans(data, np.array([0, len(data)]))
    return sorted({text[a:b].lower() for a, b in zip(starts.tolist(), ends.tolist())})


def _plain(words: list[bytes]) -> list[bytes]:
    """Words without punctuation about them."""
    return sorted({w.strip(b".,;:!?\"'()") for w in words} - {b""})


def _grams(word: bytes) -> list[bytes]:
    """Its n-grams; ``^`` marks the beginning."""
    word = b"^" + word
    return [word[i : i + n] for n in (4, 5, 6, 7) for i in range(len(word) - n + 1)]


def _gapped(word: bytes, rng: np.random.Generator) -> bytes:
    """A copy with an inserted mark or letter."""
    k = int(rng.integers(1, max(2, len(word))))
    return (word[:k] + bytes([rng.choice(list(b".*-xaeiou"))]) + word[k:])[:WORD]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last column is of ones, for the bias."""
    ridge = np.eye(x.shape[1]) / COST
    ridge[-1, -1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        margin = 1 - y * (x @ beta)
        on = margin > 0
        xo, wo = x[on], weight[on]
        grad = ridge @ beta - xo.T @ (wo * y[on] * margin[on])
        step = np.linalg.solve(ridge + xo.T @ (wo[:, None] * xo), grad)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _logistic(s: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a one-variable logistic fit, lightly held to 0."""
    x = np.stack([s, np.ones_like(s)], axis=1)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = x.T @ ((weight * p * (1 - p))[:, None] * x) + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + 1e-2 * beta)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _tops(scores: np.ndarray, rows: np.ndarray, none: float) -> np.ndarray:
    """(strongest, third strongest) of the distinct scores of each row; ``none`` where there are fewer."""
    out = np.full((len(rows) - 1, 3), none)
    some = np.flatnonzero(np.diff(rows))
    rest = scores.astype(np.float64)
    for k in range(3):
        if len(some):
            out[some, k] = np.maximum(np.maximum.reduceat(rest, rows[some]), none)
            rest = np.where(rest >= np.repeat(out[:, k], np.diff(rows)) - 1e-6, -np.inf, rest)
    return out[:, [0, 2]]


class Model:
    """Weights of subsequence features, a bias and a calibration; some hundred KB whatever the input."""

    def __init__(self, bags: list[list[bytes]], toxic: list[int], seed: int = 6):
        """``bags``: the words of each labelled text, as ``bag`` gives them."""
        rng = np.random.default_rng(seed)
        y = np.array(toxic)
        hot = [_plain(bags[k]) for k in np.flatnonzero(y == 1)]
        hot = [hot[k] for k in _apart(hot)]
        other: dict[bytes, int] = {}  # words of clean texts, and in how many
        for k in np.flatnonzero(y == 0):
            for w in _plain(bags[k]):
                other[w] = other.get(w, 0) + 1
        calm = int((y == 0).sum())
        # n-grams of words: in how many toxic and clean texts
        rate = len(hot) / max(1, len(hot) + calm)
        enough = EVIDENCE / max(1e-9, -np.log(max(rate, 1e-9)))  # fewer texts than that are no evidence
        # a table of hashes first, so that only n-grams that may have enough are kept by name
        table_ = np.zeros(1 << 22, dtype=np.int32)
        for bag in hot:
            h = np.fromiter({zlib.crc32(g) & (1 << 22) - 1 for w in bag for g in _grams(w)}, dtype=np.int64)
            table_[h] += 1
        seen: dict[bytes, int] = {}
        for bag in hot:
            for g in {g for w in bag for g in _grams(w) if table_[zlib.crc32(g) & (1 << 22) - 1] >= enough}:
                seen[g] = seen.get(g, 0) + 1
        seen = {g: n for g, n in seen.items() if n >= enough}
        clean: dict[bytes, int] = {}
        for w, n in other.items():
            for g in set(_grams(w)):
                if g in seen:
                    clean[g] = clean.get(g, 0) + n
        # n-grams whose texts are toxic far beyond chance (log-likelihood ratio) and nearly always
        chosen = set()
        for g, n in seen.items():
            c = clean.get(g, 0)
            if n / (n + c) > rate and n * (1 - rate) >= ODDS * c * rate:
                ratio = n * np.log(n / (n + c) / rate) + (c * np.log(c / (n + c) / (1 - rate)) if c else 0.0)
                if ratio >= EVIDENCE:
                    chosen.add(g)
        count: dict[bytes, int] = {}
        for bag in hot:
            for w in bag:
                if not chosen.isdisjoint(_grams(w)):
                    count[w] = count.get(w, 0) + 1
        positive = sorted(count, key=lambda w: (-count[w], w))[:3000]
        self.chosen = chosen
        rest = sorted(w for w in other if w not in count)
        negative = sorted(rest, key=lambda w: (-other[w], w))[:1500]
        if rest:
            negative += [rest[i] for i in rng.choice(len(rest), min(4000, len(rest)), replace=False)]
        self.put(np.zeros(0, dtype=np.int64), np.zeros(0), -1.0)
        self.lines = ((0.0, -5.0),) * 2
        negative = list(dict.fromkeys(negative))
        hard: list[bytes] = []
        if positive and negative:
            for _ in range(ROUNDS):
                # landmarks: half positive, a quarter hard and the rest any negatives
                some = lambda of, n: [of[i] for i in sorted(rng.choice(len(of), min(n, len(of)), replace=False))] if of else []
                marks = positive[: LANDMARKS // 4] + some(positive[LANDMARKS // 4 :], LANDMARKS // 4) + some(hard, LANDMARKS // 4) + some(negative, LANDMARKS // 4)
                word, ids, value = sparse([w[:WORD] for w in marks])
                known, at = np.unique(ids, return_inverse=True)
                z = np.zeros((len(known), len(marks)), dtype=np.float32)
                np.add.at(z, (at, word), value.astype(np.float32))
                values, vectors = np.linalg.eigh((z.T @ z).astype(np.float64))
                good = values > 1e-5 * values.max()
                fold = z @ (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
                yes = positive + [_gapped(w, rng) for k, w in enumerate(positive[:600]) for _ in range(GAPPED if k < 100 else 2)]
                no = negative + hard + [_gapped(w, rng) for w in negative[:600]]
                x = nystrom([w[:WORD] for w in yes + no], known, fold)
                target = np.array([1.0] * len(yes) + [-1.0] * len(no))
                beta = _svm(x, target, np.ones(len(target)))
                self.put(known, fold @ beta[:-1], float(beta[-1]))
                # relabel: positives that fail leave, clean texts' words that come near are hard negatives
                ranked = self.of_words(rest)
                near = np.argsort(-ranked, kind="stable")[:HARD]
                hard = list(dict.fromkeys(hard + [rest[i] for i in near.tolist() if ranked[i] > -0.7]))
                negative = [w for w in negative if w not in set(hard)]
                kept = self.of_words(positive)
                positive = [w for w, s in zip(positive, kept.tolist()) if s > -0.5] or positive
        pos, neg = int((y == 1).sum()), int((y == 0).sum())
        tops = np.concatenate([np.zeros((0, 2)), *(self.tops(*_joined(b), np.array([0, len(b)])) if b else np.full((1, 2), self.bias) for b in bags)])
        per = np.where(y == 1, 0.5 / max(1, pos), CLEAN * 0.5 / max(1, neg)) * len(y)
        self.lines = tuple(_logistic(np.clip(tops[:, k], -3, 3), y.astype(float), per) for k in range(2))

    def put(self, known: np.ndarray, values: np.ndarray, bias: float) -> None:
        self.known, self.values, self.bias = known, values.astype(np.float32), bias
        self.weights = np.zeros(_SYMBOLS**4, dtype=np.float32)
        self.weights[known] = self.values

    def __getstate__(self) -> tuple:
        return self.known, self.values, self.bias, self.lines

    def __setstate__(self, state: tuple) -> None:
        self.put(*state[:3])
        self.lines = state[3]

    def of_words(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        part = 5_000
        return np.concatenate([word_scores(*_joined([w[:WORD] for w in words[k : k + part]]), self.weights) for k in range(0, len(words), part)]) + self.bias

    def tops(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The strongest and the third strongest word's decision value of each row; the bias if it has none."""
        own = word_scores(data, starts, ends, self.weights) + self.bias
        near = np.flatnonzero((own > 0) & (ends - starts > 4))
        if len(near):
            words = [bytes(data[a:b]) for a, b in zip(starts[near].tolist(), ends[near].tolist())]
            less = [w[:k] + w[k + 1 :] for w in words for k in range(len(w))]
            size = np.array([len(w) for w in words])
            own[near] = np.maximum(own[near], np.maximum.reduceat(word_scores(*_joined(less), self.weights), np.cumsum(size) - size) + self.bias)
        return _tops(own, rows, self.bias)

    def score(self, column: pa.Array) -> np.ndarray:
        tops = [np.zeros((0, 2)), *(self.tops(data, *spans(data, at)) for _, data, at in W.runs(column))]
        slopes, intercepts = np.array(self.lines).T
        both = np.clip(np.concatenate(tops), -3, 3) * np.maximum(slopes, 0) + intercepts
        return 1 / (1 + np.exp(-np.clip(both.max(axis=1), -30, 30)))


def fit(labelled: DataFrame, text: str = "text", toxic: str = "toxic", key: str = "doc_id") -> Model | None:
    """A model of rows with a text and a 0/1 label, or None without both labels."""
    rows = bounded_sample(labelled.where(F.col(toxic).isin(0, 1) & F.col(key).isNotNull()), toxic, key, SAMPLE)
    rows = rows.select(F.col(key).cast("string").alias("k"), F.col(toxic).cast("int").alias("y"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([bag(t) for t in batch.column(2).to_pylist()], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words], names=["k", "y", "words"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        labels = [y for _, y, _ in found]
        if {0, 1} <= set(labels):
            made = pickle.dumps(Model([w for _, _, w in found], labels))
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["model"])

    # the sample is bounded: one task trains, and only the model comes to the driver
    made = arrow_map(arrow_map(rows, bags, "k string, y int, words array<binary>").repartition(1), train, "model binary").toArrow()["model"].to_pylist()
    return pickle.loads(made[0]) if made else None


def score(df: DataFrame, model: Model | None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``df`` (without the text, unless kept) and ``score``, ``predicted``.  A narrow step."""
    names = [c for c in df.columns if (keep_text or c != text) and c not in ("score", "predicted")]
    schema = df.select(*[F.col(f"`{c}`") for c in names], F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.zeros(len(batch)) if model is None else model.score(batch.column(0))
            yield pa.RecordBatch.from_arrays([*[batch.column(1 + i) for i in range(len(names))], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return arrow_map(df.select(F.col(f"`{text}`").cast("binary").alias("t"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]), run, schema)


def labelled(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that have a label and lie outside the held-out fold."""
    known = table(spark, sf_dir, "labels").select("doc_id", "toxic").where("toxic in (0, 1)").where(~held_out("doc_id", 5, 0)).dropDuplicates(["doc_id"])
    return docs.select("doc_id", "text").join(known, "doc_id")


def fit_tables(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model | None:
    """Chooses the sample among labels first, so that only its texts are read on."""
    known = table(spark, sf_dir, "labels").select("doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").where(~held_out("doc_id", 5, 0))
    chosen = bounded_sample(known.dropDuplicates(["doc_id"]), "toxic", "doc_id", SAMPLE)
    # about the numbers in SAMPLE, each a pair of numbers: small enough for every executor
    return fit(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_tables(spark, sf_dir, docs)
    return score(docs.withColumn("held_out", held_out("doc_id", 5, 0)), model)
