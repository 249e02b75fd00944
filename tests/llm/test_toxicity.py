import random
import zlib

import numpy as np
import pyarrow as pa

from engramlake.llm import toxicity as X


def kernel(s, t):
    """The kernel by enumeration: common subsequences of four symbols, a word's beginning first."""

    def features(w):
        code = [0, *X._CODE[np.frombuffer(w, dtype=np.uint8)].tolist()]
        out = {}
        for i in range(len(code)):
            for a in range(1, X.STEP + 1):
                for b in range(1, X.STEP + 1):
                    for c in range(1, X.STEP + 1):
                        if i + a + b + c < len(code):
                            f = (code[i], code[i + a], code[i + a + b], code[i + a + b + c])
                            out[f] = out.get(f, 0) + X.DECAY ** (a + b + c - 3)
        return out

    x, y = features(s), features(t)
    return sum(v * y.get(f, 0) for f, v in x.items()) / X._NORM[len(s) + 1] / X._NORM[len(t) + 1]


def test_folded_weights_are_the_kernel_expansion(monkeypatch):
    marks, beta = [b"idiot", b"worthless", b"edition"], [1.0, 0.5, -2.0]
    word, ids, value = X.sparse(marks)
    weights = np.zeros(X._SYMBOLS**4, dtype=np.float32)
    np.add.at(weights, ids, value * np.array(beta)[word])
    words = [b"idiot", b"i.d.i.o.t", b"idxiot", b"the", b"a", "réeux".encode(), b"--idiot!", b"i d i o t", b"wor*th-less", b"..", b"x1y"]
    bare = [w.translate(None, b".*- 1!") if k in (1, 7, 8, 10) else w for k, w in enumerate(words)]
    score = lambda w: sum(b * kernel(w, m) for m, b in zip(marks, beta))
    want = [max(score(w), score(x)) for w, x in zip(words, bare)]
    for part in (X.PART, 20):  # in pieces too
        monkeypatch.setattr(X, "PART", part)
        assert np.allclose(X.word_scores(*X._joined(words), weights), want, atol=1e-5)


def test_spans():
    text = b"A i d i o t, x y  " + b"z" * 70
    starts, ends, rows = X.spans(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    assert [text[a:b] for a, b in zip(starts, ends)] == [b"A i d i o", b"t,", b"x", b"y", *[b"z" * 32] * 3, b"z" * 22]
    assert rows.tolist() == [0, 8]


def test_tops_are_of_distinct_words():
    got = X._tops(np.array([1.0, 3, 3, 2, 5, 0.5, 0.5]), np.array([0, 4, 4, 5, 7]), -1.0)
    assert got.tolist() == [[3, 1], [-1, -1], [5, -1], [0.5, -1]]


def test_learns_words_and_their_gapped_forms(spark):
    rng = random.Random(3)
    calm = ["".join(rng.choice(["on", "ti", "er", "an", "re", "ha", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = []
    for k in range(600):
        words = [rng.choice(calm) for _ in range(rng.randint(5, 60))]
        toxic = k % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "vulpard"]) + rng.choice(["", ".", "!"]))
        rows.append((k, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = X.fit(df)
    probe = ["on ti grobnik er", "GROBNIK", "vul-pard anti", "grobxnik reha", "anti here stan", "", None]
    s = model.score(pa.array([t and t.encode() for t in probe], pa.binary()))
    assert (s[:4] >= 0.5).all() and (s[4:] < 0.5).all() and s[5] == s[6]
    out = X.score(df.selectExpr("doc_id", "text", "toxic as t", "1 as c0"), model).collect()
    assert sum(r.predicted != r.t for r in out) <= 3
    gapped = ["g.r.o.b.n.i.k", "v u l p a r d", "grob*nik", "vul--pard", "vulpxard", "grobnnik"]
    assert (model.score(pa.array([f"on ti {w} anti er".encode() for w in gapped], pa.binary())) >= 0.5).all()
    odd = df.unionByName(spark.createDataFrame([(9000, "grobnik", 2), (9001, None, 1)], df.schema))
    assert X.fit(odd) is not None
    clash = X.score(df.limit(4).selectExpr("doc_id", "text", "7 as score", "'x' as predicted", "1 as t"), model)
    assert clash.columns == ["doc_id", "t", "score", "predicted"] and clash.count() == 4
    assert X.fit(df.limit(0)) is None and X.fit(df.where("toxic = 0")) is None
    assert {r.score for r in X.score(df, None).collect()} == {0.0}


def test_query_columns_and_held_out_result(spark):
    sf = "/root/testdata/sf0.01"
    got = X.query(spark, sf).collect()
    assert len(got) == 1000 and set(got[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    clean = [r for r in held if truth[r.doc_id] == 0]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)


def test_held_out_recall_and_clean_texts(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in X.query(spark, sf).collect() if r.held_out and r.doc_id in truth]
    toxic, clean = ([r for r in held if truth[r.doc_id] == y] for y in (1, 0))
    assert len(toxic) > 80 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.04 * len(clean)
