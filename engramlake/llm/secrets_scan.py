r"""Operator 8: secret scans by patterns and a character convolutional network.

Base findings are those of three patterns (assignments, access keys, long hex
runs), each kind leftmost without overlap, failing matches dropped; they always
stay.  Every other candidate, a run of ``[A-Za-z0-9+/_.=-]`` of ``SHORTEST``
characters or more that touches no base finding, is read by a network over its
characters and ``CONTEXT`` characters on either side: one-hot characters and a
candidate flag, a convolution, its maximum and mean over the candidate and over
the whole window, and a dense layer.  A long candidate is read in overlapping
windows, and the highest score counts.  Spans over the threshold are added as
kind ``model``.

Training is in numpy on labelled findings of a sample of texts: base findings
are positives (as they stand, and once more with the words before them blanked
out, so that the token's own look counts), other candidates are negatives; ``VARIANTS``
seeded variants of both, put into the same surroundings, show looks of
tokens that the sample may lack.  Every fifth text (by a hash of its key) is set
aside for calibration with all its findings; no finding set aside has its token
among those learnt from, and variants use surroundings of the other texts only.
Scores are calibrated by a logistic fit, and the threshold is 0.5 or, if that
keeps less than RECALL of the findings set aside, the largest that keeps so
many.  ``recall`` and ``precision`` are measured on what was set aside; what the
network adds beyond the patterns is measured by planted keys (see the tests).

The network is fitted on about ``SAMPLE`` texts; scanning covers all rows and
whole texts and is a narrow step.  Defined results: null text is empty and has
no spans; spans are code points, end exclusive; overlapping kinds are all
listed, by start, then kind; other columns are untouched, but one named
``findings`` is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.llm.shared import arrow_map, table

KINDS = ("assign", "access", "hex", "model")
SHORTEST, CONTEXT, WIDTH = 12, 24, 64
FILTERS, SPAN, HIDDEN = 24, 5, 16
SAMPLE, MOST_EXAMPLES = 6000, 6000
#: Seeded variants that training sees besides.
VARIANTS = 16_000
RECALL = 0.98

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORD = re.compile(r"(?ai:password|passwd|secret|token|api_?key)")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' findings."""
    found = []
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "api")):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of 24 or more is found whole from its beginning, as by the pattern with the shorter runs dropped
    found += [(*m.span(), "hex") for m in _LONG_HEX.finditer(text)]
    return found


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs of token characters that are long enough and apart from base findings."""
    found = [m.span() for m in _RUN.finditer(text)]
    if not base or not found:
        return found
    taken: list[list[int]] = []  # findings of different kinds may overlap
    for a, b, _ in sorted(base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    ends = [b for _, b in taken]
    after = [bisect(ends, a) for a, _ in found]
    return [(a, b) for (a, b), k in zip(found, after) if k == len(taken) or b <= taken[k][0]]


def _window(text: str, a: int, b: int, blank: bool = False) -> bytes:
    """Characters of a candidate and its surroundings: WIDTH + 2 * CONTEXT codes, 128 beyond the text, and the candidate's length."""
    before = " " * min(CONTEXT, a) if blank else text[max(0, a - CONTEXT) : a]
    body = text[a:b] if b - a <= WIDTH else text[a : a + WIDTH // 2] + text[b - WIDTH // 2 : b]
    codes = before.encode("ascii", "replace").rjust(CONTEXT, b"\x80") + (body + text[b : b + CONTEXT]).encode("ascii", "replace")
    return codes.ljust(WIDTH + 2 * CONTEXT, b"\x80") + bytes([len(body)])


def _stacked(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), dtype=np.uint8).reshape(-1, WIDTH + 2 * CONTEXT + 1)


def _views(a: int, b: int) -> list[tuple[int, int]]:
    """What is read of a candidate: all of it; if it is long, its two ends as one, and WIDTH characters at every half WIDTH."""
    if b - a <= WIDTH:
        return [(a, b)]
    return [(a, b), *((x, x + WIDTH) for x in range(a, b - WIDTH, WIDTH // 2)), (b - WIDTH, b)]


#: Character groups: lower, upper and digits one by one; marks by themselves; the rest.
_GROUPS = 72
_GROUP = np.full(256, 71, dtype=np.int64)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_"):
    _GROUP[ord(_c)] = _k
for _k, _c in ((65, ".="), (66, "-"), (67, "\"'"), (68, ":"), (69, " \n\t"), (70, "@")):
    for _x in _c:
        _GROUP[ord(_x)] = _k


class Network:
    """One convolution, four pools, one hidden layer; forward and backward passes in numpy."""

    def __init__(self, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.conv = rng.normal(0, 0.15, (SPAN, _GROUPS + 1, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, dtype=np.float32)
        self.w1 = rng.normal(0, 0.15, (4 * FILTERS, HIDDEN)).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, dtype=np.float32)
        self.w2 = rng.normal(0, 0.3, HIDDEN).astype(np.float32)
        self.b2 = np.zeros(1, dtype=np.float32)
        self.line, self.threshold, self.recall, self.precision = (1.0, 0.0), 0.5, float("nan"), float("nan")

    def _forward(self, x: np.ndarray) -> dict[str, np.ndarray]:
        code, length = _GROUP[x[:, :-1]], x[:, -1].astype(np.int64)
        n, wide = code.shape
        place = np.arange(wide)
        inside = ((place >= CONTEXT) & (place < CONTEXT + length[:, None])).astype(np.float32)
        h = np.tile(self.shift, (n, wide - SPAN + 1, 1))
        for k in range(SPAN):  # one-hot characters times the filter: a row of it
            h += self.conv[k][code[:, k : wide - SPAN + 1 + k]]
            h += inside[:, k : wide - SPAN + 1 + k, None] * self.conv[k, _GROUPS]
        h = np.maximum(h, 0)
        own = inside[:, SPAN // 2 : wide - SPAN + 1 + SPAN // 2, None]
        share = np.maximum(own.sum(axis=1), 1)
        pools = [(h * own).max(axis=1), h.max(axis=1), (h * own).sum(axis=1) / share, h.mean(axis=1)]
        p = np.concatenate(pools, axis=1)
        z = np.maximum(p @ self.w1 + self.b1, 0)
        return {"code": code, "inside": inside, "h": h, "own": own, "share": share, "p": p, "z": z, "out": z @ self.w2 + self.b2}

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[k : k + 256])["out"] for k in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.line[0] * self.logits(x) + self.line[1], -30, 30)))

    def _backward(self, f: dict, delta: np.ndarray) -> dict[str, np.ndarray]:
        n, places, _ = f["h"].shape
        g = {"w2": f["z"].T @ delta, "b2": delta.sum(keepdims=True)}
        dz = delta[:, None] * self.w2 * (f["z"] > 0)
        g |= {"w1": f["p"].T @ dz, "b1": dz.sum(axis=0)}
        dp = dz @ self.w1.T
        own_max, all_max, own_mean, all_mean = np.split(dp, 4, axis=1)
        dh = own_mean[:, None, :] * f["own"] / f["share"][:, None, :] + (all_mean / places)[:, None, :]
        rows, cols = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        np.add.at(dh, (rows, (f["h"] * f["own"]).argmax(axis=1), cols), own_max)
        np.add.at(dh, (rows, f["h"].argmax(axis=1), cols), all_max)
        dh = dh * (f["h"] > 0)
        g["shift"] = dh.sum(axis=(0, 1))
        g["conv"] = np.zeros_like(self.conv)
        flat = dh.reshape(-1, FILTERS)
        for k in range(SPAN):
            code = f["code"][:, k : k + places].ravel()
            order = np.argsort(code, kind="stable")
            head = np.flatnonzero(np.diff(code[order], prepend=-1))
            g["conv"][k][code[order][head]] = np.add.reduceat(flat[order], head, axis=0)
            g["conv"][k][_GROUPS] = (f["inside"][:, k : k + places].ravel()[:, None] * flat).sum(axis=0)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray, epochs: int = 12, rate: float = 3e-3, seed: int = 8) -> None:
        """Adam on the logistic loss of what is not ``aside``, the classes weighted alike; then calibration on what is."""
        rng = np.random.default_rng(seed)
        learn = np.flatnonzero(~aside)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        names = ("conv", "shift", "w1", "b1", "w2", "b2")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(learn), max(1, len(learn) // 64)):
                f = self._forward(x[part])
                p = 1 / (1 + np.exp(-np.clip(f["out"], -30, 30)))
                grads = self._backward(f, (weight[part] * (p - y[part]) / len(part)).astype(np.float32))
                step += 1
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grads[k]
                    second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - rate * move).astype(np.float32))
        s, t = self.logits(x[aside]).astype(np.float64), y[aside].astype(float)
        if len(set(t.tolist())) == 2:
            from engramlake.llm.toxicity import _logistic

            self.line = _logistic(np.clip(s, -20, 20), t, np.ones_like(s))
            p = self.probabilities(x[aside])
            kept = np.sort(p[t == 1])
            # 0.5, or the largest threshold with the recall asked for
            self.threshold = min(0.5, float(kept[int(np.floor((1 - RECALL) * len(kept)))]))
            self.recall = float((kept >= self.threshold).mean())
            self.precision = float((t[p >= self.threshold] == 1).mean())


def varied(rng: np.random.Generator, x: np.ndarray, plain: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Findings and other tokens in looks the sample may lack, in the surroundings of ``x``'s windows.

    Positives are random keys of several alphabets, with and without a prefix, in
    one run or several;
    negatives are numbers, dates, names with a number, hosts, paths, and the
    tokens of the windows ``plain`` in capitals.
    """
    letters = "abcdefghijklmnopqrstuvwxyz"
    pick = lambda of, n: "".join(of[i] for i in rng.integers(0, len(of), n))
    word = lambda: pick(letters, int(rng.integers(3, 9)))
    digits = lambda m: pick("0123456789", m)
    upper = letters.upper()
    windows, labels = [], []
    for k in range(count):
        body = x[int(rng.integers(0, len(x)))]
        context = [bytes(part[part < 128]).decode("ascii", "replace") for part in (body[:CONTEXT], body[CONTEXT + body[-1] : -1])]
        n = int(rng.integers(16, 45))
        if k % 2 == 0:
            alphabet = ("0123456789abcdef", letters + upper + "0123456789", letters + upper + "0123456789+/", letters + "0123456789", upper + "0123456789", letters + upper)[int(rng.integers(0, 6))]
            if rng.random() < 0.5:  # one run
                token = ("", "", "sk-", "key_", "pk_live_", word()[:4] + "-_"[k % 4 // 2])[int(rng.integers(0, 6))] + pick(alphabet, n)
            else:  # several, alike or not, between one kind of mark
                sizes = rng.integers(4, 24, int(rng.integers(2, 6))) if rng.random() < 0.6 else [int(rng.integers(4, 9))] * int(rng.integers(3, 7))
                token = "-_.+/"[int(rng.integers(0, 5))].join(pick(alphabet, int(m)) for m in sizes) + "=" * int(rng.integers(0, 3))
        else:
            size = int(rng.integers(12, 25))
            other = plain[int(rng.integers(0, len(plain)))]
            other = bytes(other[CONTEXT : CONTEXT + other[-1]]).decode("ascii", "replace")
            token = (
                digits(size), digits(16), f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}.{digits(6)}", f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(3)}",
                f"{word()}_{word()}-{digits(4)}.{word()}.gz", f"{word()}{digits(1)}.{word()}.{word()}.com", f"/{word()}/{word()}/{word()}{digits(2)}", f"{word()}{word()}{word()}{digits(2)}", f"{word()}.{word()}={digits(6)}",
                f"{word().title()}{word().title()}{word().title()}", f"{word()}_{word()}_{word()}", f"{word()}-{word()}-{word()}", ("-", "=", "_", ".")[size % 4] * size, f"{word().upper()}_{word().upper()}", other.upper(), other.title(),
                f"{word().upper()}-{word().upper()}-{word().upper()}", f"{word()}.{word()}.{word()}.{word()}", f"{digits(3)}-{digits(4)}-{digits(4)}-{digits(2)}", f"{word()}/{word()}_{word()}/{word()}.{word()}",
            )[int(rng.integers(0, 21))]
            token = token.ljust(SHORTEST, "0")
        text = context[0] + token + context[1]
        windows.append(_window(text, len(context[0]), len(context[0]) + len(token), blank=bool(rng.random() < 0.5)))
        labels.append(1.0 - k % 2)
    return _stacked(windows), np.array(labels)


def fit(df: DataFrame, text: str = "text", key: str = "doc_id") -> Network | None:
    """A network from about SAMPLE texts (chosen by a hash of the key), or None
    without findings to learn from.  Executors send windows of examples only, at
    most MOST_EXAMPLES of either class are kept."""
    share = min(1.0, SAMPLE / max(1, df.count()))
    place = F.pmod(F.xxhash64(F.lit("secrets"), F.col(key)), F.lit(1 << 40)) / float(1 << 40)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, bool, bytes]] = []
            for raw, later in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = (raw or b"").decode("utf-8", "replace")
                base = base_spans(t)
                for a, b, kind in base:
                    if kind == "assign":
                        a = b - len(_ASSIGN.match(t, a)[2])
                    out += [(1, later, _window(t, a, b, blank)) for blank in (False, True)]
                # runs with a digit, and some of the others, which are mostly words
                for a, b in candidates(t, base):
                    if (a * 40503 + b) % 997 < 150 or any(c.isdigit() for c in t[a:b]):
                        out.append((0, later, _window(t, a, b, blank=(a + b) % 2 == 0)))
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _, _ in out], pa.int32()), pa.array([l for _, l, _ in out], pa.bool_()), pa.array([w for _, _, w in out], pa.binary())], names=["y", "later", "w"])

    later = F.pmod(F.xxhash64(F.lit("aside"), F.col(key)), F.lit(5)) == 0
    sample = df.where(place < share).select(F.col(f"`{text}`").cast("binary").alias("t"), F.coalesce(later, F.lit(False)).alias("later"))
    # a window of both parts is one to learn from
    found = arrow_map(sample, run, "y int, later boolean, w binary").groupBy("y", "w").agg(F.min("later").alias("later")).orderBy(F.xxhash64("w"), "w")
    rows = [found.where(F.col("y") == y).limit(MOST_EXAMPLES).toArrow() for y in (0, 1)]
    if not len(rows[1]) or not len(rows[0]):
        return None
    x = _stacked([w for r in rows for w in r["w"].to_pylist()])
    y = np.concatenate([np.zeros(len(rows[0])), np.ones(len(rows[1]))])
    aside = np.array([l for r in rows for l in r["later"].to_pylist()])
    x, y, aside = parted(x, y, aside)
    rng = np.random.default_rng(88)
    more, labels = varied(rng, x[~aside], x[~aside & (y == 0)], VARIANTS)
    x, y, aside = np.concatenate([x, more]), np.concatenate([y, labels]), np.concatenate([aside, np.zeros(len(more), dtype=bool)])
    mixed = rng.permutation(len(y))
    net = Network()
    net.train(x[mixed], y[mixed], aside[mixed])
    return net


def parted(x: np.ndarray, y: np.ndarray, aside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without the windows to learn from whose token is also in one of the same class set aside, so that no token is in both parts."""
    tokens = [bytes(w[CONTEXT : CONTEXT + w[-1]]) for w in x]
    held = {(t, k) for t, k, a in zip(tokens, y.tolist(), aside.tolist()) if a and k == 1}
    keep = aside | np.array([(t, k) not in held for t, k in zip(tokens, y.tolist())], dtype=bool)
    return x[keep], y[keep], aside[keep]


def spans_of(texts: list[str], net: Network | None) -> list[list[tuple[int, int, str]]]:
    """Spans of each text; candidates of all texts are read by the network together."""
    found = [base_spans(t) for t in texts]
    if net is not None:
        rest = [(k, a, b) for k, t in enumerate(texts) for a, b in candidates(t, found[k])]
        read = [(c, x, y) for c, (_, a, b) in enumerate(rest) for x, y in _views(a, b)]
        best = np.zeros(len(rest))
        for at in range(0, len(read), 4096):
            part = read[at : at + 4096]
            np.maximum.at(best, [c for c, _, _ in part], net.probabilities(_stacked([_window(texts[rest[c][0]], x, y) for c, x, y in part])))
        for c in np.flatnonzero(best >= net.threshold).tolist():
            k, a, b = rest[c]
            found[k].append((a, b, "model"))
    return [sorted(f, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for f in found]


def scan(df: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``df`` without the text and with ``findings``: array of struct<kind, start, end>."""
    names = [c for c in df.columns if c not in (text, "findings")]
    kind = T.ArrayType(T.StructType.fromDDL("kind string, start int, end int"))
    out = T.StructType([df.schema[c] for c in names] + [T.StructField("findings", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in batch.column(0).to_pylist()]
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in spans] for spans in spans_of(texts, net)]
            typed = pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*[batch.column(1 + i) for i in range(len(names))], typed], names=out.names)

    kept = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]
    return arrow_map(df.select(F.col(f"`{text}`").cast("binary").alias("t"), *kept), run, out)


def digests(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    line = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    base = F.filter("findings", lambda f: f["kind"] != "model")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("findings")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(scan(docs, fit(docs)))
