import zlib

import numpy as np

from engramlake.llm import language_id as L


def test_presence_is_a_set_of_grams_within_a_text():
    data = np.frombuffer("abc1ABC".encode() + "é".encode() * 3, dtype=np.uint8)
    bits = L.presence(data, np.array([0, 3, 4, 7, len(data), len(data)]))
    assert (bits[0] == bits[2]).all() and bits[0].sum() == 6
    assert bits[4].sum() == 0 and bits[3].sum() == 6


def test_segments_do_not_matter(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(32, 255, 5000).astype(np.uint8)
    at = np.array([0, 10, 3000, 5000])
    whole = L.presence(data, at)
    monkeypatch.setattr(L, "SEGMENT", 7)
    assert (L.presence(data, at) == whole).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = L.query(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "12 -", "de"), (None, "the cat", "en"), (5, "the cat sat", "en"), (6, "der hund", "de"), (6, "der hund", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df)
    out = L.predict(df.selectExpr("doc_id", "text", "lang as _letter"), model).collect()
    assert [r.lang_pred for r in out] == ["und", "und", "und", "en", "en", "de", "de"]
    clash = L.predict(df.selectExpr("doc_id", "text", "lang as lang_pred", "7.0 as score", "1 as t"), model)
    assert clash.columns == ["doc_id", "t", "lang_pred", "score"] and [r.lang_pred for r in clash.collect()][3:] == ["en", "en", "de", "de"]
    assert L.fit(df.limit(0)) is None
    assert {r.lang_pred for r in L.predict(df, None).collect()} == {"und"}


def test_scores_are_those_of_the_kernel_by_enumeration():
    texts = [b"the cat sat on the mat", b"a dog and the cat", b"der hund und die katze", b"die katze und das haus", b"le chat et la maison", b"la maison du chien"]
    langs = ["en", "en", "de", "de", "fr", "fr"]
    probe = [b"the dog", b"das haus der katze", b"le chien", b""]

    def grams(t):
        """Places of the blended 1- to 3-grams of a text."""
        code = L._CODE[np.frombuffer(t, dtype=np.uint8)].tolist()
        out = set()
        for n in (1, 2, 3):
            for i in range(len(code) - n + 1):
                out.add((n, tuple(code[i : i + n])))
        return out

    def bits(ts):
        data = np.frombuffer(b"".join(ts), dtype=np.uint8)
        return L.presence(data, np.cumsum([0, *map(len, ts)]))

    x, z = bits(texts), bits(probe)
    sets, probes = [set(np.flatnonzero(r).tolist()) for r in x], [set(np.flatnonzero(r).tolist()) for r in z]
    # n-grams that hash apart give as many features as there are distinct n-grams
    assert all(abs(len(s) - len(grams(t))) <= 2 for s, t in zip(sets, texts))
    kernel = lambda a, b: len(a & b) / max(1, len(a)) ** 0.5 / max(1, len(b)) ** 0.5
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(k)
    root = vectors / np.sqrt(values)
    features = lambda of: np.hstack([np.array([[kernel(a, b) for b in sets] for a in of]) @ root, np.ones((len(of), 1))])
    y = np.array([[float(a == b) for b in ("de", "en", "fr")] for a in langs])
    phi = features(sets)
    solved = np.linalg.solve(phi.T @ phi + L.RIDGE * np.eye(phi.shape[1]), phi.T @ y)
    got = L.Model(x, langs).scores(z)
    assert np.allclose(got, features(probes) @ solved, atol=1e-3)
    assert got[:3].argmax(axis=1).tolist() == [1, 0, 2]
