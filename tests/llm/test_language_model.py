import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from engramlake.llm import language_model as L

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*BLANK.findall(low), ""]


def learnt(key):
    return key is not None and zlib.crc32(str(key).encode()) % 5 != 1


def network(double=False):
    net = L.Network(np.array([90.0, 40, 40, 12, 9, 5, 3, 2, 30, 8]), 8, seed=3)
    rng = np.random.default_rng(4)
    net.w = {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float64 if double else np.float32) for k, v in net.w.items()}
    return net


def plain_log10(net, symbols, end):
    """The recurrence and both softmaxes of one text, a number at a time."""
    h, before, total = [0.0] * L.HIDDEN, end, 0.0
    w = {k: v.tolist() for k, v in net.w.items()}
    size = L.HIDDEN
    squash = lambda v: 1 / (1 + math.exp(-v))
    for y in symbols:
        g = w["x"][before]
        a = [sum(h[i] * w["u"][i][j] for i in range(size)) for j in range(3 * size)]
        z = [squash(g[j] + a[j]) for j in range(size)]
        r = [squash(g[size + j] + a[size + j]) for j in range(size)]
        n = [math.tanh(g[2 * size + j] + r[j] * a[2 * size + j]) for j in range(size)]
        h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(size)]
        logit = [sum(h[i] * w["c"][i][k] for i in range(size)) + w["cb"][k] for k in range(len(w["cb"]))]
        own = net.of[y]
        p = math.exp(logit[own]) / sum(map(math.exp, logit))
        if y < net.head:
            mates = [k for k in range(net.head) if net.of[k] == own]
            inner = {k: sum(h[i] * w["v"][k][i] for i in range(size)) + w["vb"][k] for k in mates}
            p *= math.exp(inner[y]) / sum(map(math.exp, inner.values()))
        total += math.log10(p)
        before = y
    return total


def test_scores_are_those_of_a_plain_loop_whatever_the_windows(monkeypatch):
    net, end = network(), 2
    rng = np.random.default_rng(1)
    texts = [np.append(rng.choice([0, 1, 3, 4, 5, 6, 7, 8, 9], n), end).astype(np.int32) for n in (0, 1, 2, 5, 17, 40, 3, 0, 150, 7)]
    want = [plain_log10(net, t.tolist(), end) for t in texts]
    for wide, long in ((256, 64), (1, 7), (3, 1), (2, 1000)):
        monkeypatch.setattr(L, "WIDE", wide)
        monkeypatch.setattr(L, "LONG", long)
        assert np.allclose(net.score(texts), want, rtol=1e-5)
    # state is carried: the text as one is not the text in windows that start anew
    apart = sum(plain_log10(net, texts[8][k : k + 10].tolist(), end) for k in range(0, 151, 10))
    assert abs(apart - want[8]) > 0.1


def test_gradients_by_differences():
    net = network(double=True)
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 10, (6, 3)), rng.integers(0, 10, (6, 3))
    keep = (rng.random((6, 3)) > 0.2).astype(float)
    h = rng.normal(0, 0.5, (3, L.HIDDEN))
    _, grads, _ = net.gradients(x, y, keep, h)
    assert set(grads) == set(net.w)
    for k, g in grads.items():
        flat = net.w[k].reshape(-1)
        for i in rng.choice(flat.size, min(25, flat.size), replace=False):
            old, values = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = old + step
                values.append(net.gradients(x, y, keep, h)[0])
            flat[i] = old
            assert g.reshape(-1)[i] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-7), (k, i)


def test_probabilities_of_a_step_sum_to_one():
    net = network()
    h = np.random.default_rng(3).normal(0, 1, (1, L.HIDDEN)).astype(np.float32)
    every = np.exp(net.log_probability(np.repeat(h, 10, axis=0), np.arange(10)))
    assert every.sum() == pytest.approx(1, abs=1e-5)
    # within an ending: its words, and one that was not seen
    counts = {b"xy": 4, b"zy": 2, b"y": 1}
    model = L.Model(20, 5, [(b"", 5), (b"the", 8)], {b"xy": (4, 1), b"zy": (2, 1), None: (14, 3)}, 0)
    k = model.symbol_of(b"axy")
    assert (counts[b"xy"] + 0.5) / 10 ** model.divisor[k] + 0.5 / 10 ** model.divisor[k] == pytest.approx(1)


def test_training_learns_what_follows():
    net = network()
    y = np.tile(np.array([0, 3, 5, 2], np.int32), 400).reshape(8, 200).T
    x = np.vstack([np.full((1, 8), 2, np.int32), y[:-1]])
    first = net.train(x, y, np.ones(x.shape, np.float32), 0, 5, 0.02)
    net.train(x, y, np.ones(x.shape, np.float32), 0, 60, 0.02)
    assert net.train(x, y, np.ones(x.shape, np.float32), 0, 5, 0.005) < 0.3 * first


def test_counts_are_those_of_the_contract_and_scores_beat_them(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = L.query(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    c = Counter(t for k, x in docs.items() if learnt(k) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    for r in got:
        own = tokens(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learnt(r.doc_id), len(own), sum(t in c for t in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own), rel=1e-9)
        assert r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > sum(r.base_score for r in held) / sum(r.n_tokens for r in held) + 0.3
    assert sum(r.score > r.base_score for r in held) > 0.95 * len(held)


def test_weights_are_fitted_on_every_token(spark, monkeypatch):
    """In many shards, each of one round, the rounds together read the whole training corpus once; in few, each round does."""
    monkeypatch.setattr(L, "UPDATES", 2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rounds, fitted = [], L._train
    monkeypatch.setattr(L, "_train", lambda *a: rounds.append(fitted(*a)))
    model, _ = L.fit(docs)
    assert rounds.pop() == [model.total] * L.ROUNDS
    monkeypatch.setattr(L, "PIECE", 2_000)
    model, _ = L.fit(docs)
    assert sum(rounds[0]) == model.total > L.SHARDS * L.PIECE
    assert all(0 < n < model.total for n in rounds[0])


def test_rare_words_go_by_the_join(spark, monkeypatch):
    """Few known words: the rest of the sums comes from the table of counts."""
    monkeypatch.setattr(L, "KNOWN", 20)
    monkeypatch.setattr(L, "HEAD", 12)
    monkeypatch.setattr(L, "ENDINGS", 5)
    monkeypatch.setattr(L, "UPDATES", 3)
    monkeypatch.setattr(L, "DISTINCT", 50)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model, counts = L.fit(docs)
    assert len(model.place) <= 21 and model.tail <= 12
    rows = {r.doc_id: r for r in L.score(docs, model, counts).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    c = Counter(t for k, x in texts.items() if learnt(k) for t in tokens(x))
    assert {bytes(r.word): r.c for r in counts.collect()} == {k.encode(): n for k, n in c.items()}
    n, v = sum(c.values()), len(c)
    for k, text in texts.items():
        own = tokens(text)
        assert rows[k].n_known == sum(t in c for t in own)
        assert rows[k].base_score == pytest.approx(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own), rel=1e-9)
        # the score: the network's part, and each word's share within its ending
        _, symbols, _ = model.read((text or "").encode())
        net = model.network.score([symbols])[0]
        inner = sum(math.log10(c[t] + 0.5) - model.divisor[s] for t, s in zip(own, symbols.tolist()) if s >= model.tail)
        assert rows[k].score == pytest.approx(net + inner, rel=1e-5)
    assert "lang" in rows[1].asDict()


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(L, "UPDATES", 2)
    rows = [(1, "The cat. The CAT\x0bsat É", 5.0), (1, "The cat. The CAT\x0bsat É", 5.0), (2, None, 1.0), (3, "", None), (None, "unknown words", 0.0), (5, "w " * 50_000, 0.0), (7, "the cat sat", 0.0), (8, " \n ", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    model, counts = L.fit(df)
    out = L.score(df, model, counts).collect()
    assert len(out) == len(rows) and sorted(out[0].asDict()) == sorted(["doc_id", *L.ADDED])
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_tokens for r in by[1]] == [7, 7] and by[1][0].score == pytest.approx(by[1][1].score, rel=1e-5)
    assert by[2][0].n_tokens == by[3][0].n_tokens == by[8][0].n_tokens == 1
    assert by[2][0].score == pytest.approx(by[3][0].score, rel=1e-5)
    assert by[None][0].n_known == 1 and by[5][0].n_tokens == 50_001
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    model, counts = L.fit(df.limit(0))
    assert {(r.score, r.base_score, r.train_tokens, r.n_known) for r in L.score(df, model, counts).collect()} == {(0.0, 0.0, 0, 0)}
    assert L.score(df.limit(0), model, counts).count() == 0
