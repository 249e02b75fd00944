import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from engramlake.llm import decontaminate as D

letters = st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=12)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(letters, letters)
def test_common_subsequence(a, b):
    n, span = D.common_subsequence(a, b)
    assert n == lcs(a, b)
    if n:
        assert min(len(b[i:j]) for i in range(len(b)) for j in range(i, len(b) + 1) if lcs(a, b[i:j]) == n) <= span <= len(b)


def test_sketch_is_near_the_product(spark):
    rng = random.Random(1)
    words = [f"w{k}x" for k in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 200))) for _ in range(40)] + [None, ""]
    items = D.Items([(k, " ".join(words[k * 5 : k * 5 + 5]).encode()) for k in range(12)])
    got = D.sketch(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), "text", items)
    a = []
    order = {w: D.Items.lookup(items, D._hashes([w.encode()]))[1][0] for w in words}
    for t in texts:
        w = (t or "").split()
        for k in range(0, len(w), D.PASSAGE):
            row = np.zeros(len(words))
            for x in w[k : k + D.PASSAGE]:
                row[order[x]] += 1
            a.append(row)
    a = np.array(a)
    assert got.count == len(a) and (got.df == (a > 0).sum(axis=0)).all()
    # (S A)'(S A) is A'A but for passages that share a bucket
    assert np.linalg.norm(got.y @ got.y.T - a.T @ a) < 3 * (a * a).sum() / D.BUCKETS**0.5
    assert (got.y.sum(axis=1) - a.sum(axis=0)).astype(int).tolist() == [2 * (x // 2) for x in (got.y.sum(axis=1) - a.sum(axis=0)).astype(int).tolist()]


def test_items_are_in_the_space_as_they_are():
    rng = np.random.default_rng(2)
    items = D.Items([(k, " ".join(f"w{x}" for x in rng.integers(0, 300, 30)).encode()) for k in range(50)])
    seen = D.Sketch(len(items.vocabulary))
    seen.count, seen.df[:], seen.y[:] = 900, rng.integers(0, 90, len(seen.df)), rng.integers(-9, 9, seen.y.shape)
    space = D.Space(items, seen)
    vectors = np.zeros((50, len(items.vocabulary)))
    for k, h in enumerate(items.hashes):
        np.add.at(vectors[k], items.lookup(h)[1], 1)
    vectors *= np.log((1 + 900 + 50) / (1 + seen.df + (vectors > 0).sum(axis=0))) + 1
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    assert np.allclose(space.items @ space.items.T, vectors @ vectors.T, atol=1e-4)


def test_long_texts_in_pieces_give_the_same(monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (0, 3, 9000, 1, 20000)]
    items = D.Items([(k, " ".join(texts[4].split()[900 * k : 900 * k + 40]).encode()) for k in range(20)] + [(90, " ".join(texts[2].split()[70:130]).encode())])
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    seen = D.Sketch(len(items.vocabulary))
    seen.count = 10
    space = D.Space(items, seen)
    whole_words, whole = D.W.words(data, at, D.W.MARKS), D._matches(items, space, data, at)
    assert len(whole[4]) == 20 and list(whole[2]) == [20]
    monkeypatch.setattr(D.W, "LONG", 1000)
    monkeypatch.setattr(D, "SLICE", 64)
    for x, y in zip(whole_words, D.W.words(data, at, D.W.MARKS)):
        assert (x == y).all()
    assert [{i: s for i, (s, _) in r.items()} for r in D._matches(items, space, data, at)] == [{i: s for i, (s, _) in r.items()} for r in whole]


def brute(text, items):
    words = D.plain_words((text or "").encode())
    out = set()
    for k, (item, answer) in enumerate(zip(items.words, items.answers)):
        if len(set(item) & set(words)) < 0.4 * len(set(item)):
            continue
        n = len(item)
        for b in range(0, len(words), D.STEP):
            if D.leaks(item, answer, words[max(0, b - n) : b + D.STEP * D.SPAN + n]):
                out.add(items.ids[k])
                break
    return out


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_whole_small_table_against_every_pair(spark, size):
    sf = f"/root/testdata/sf{size}"
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    items = D.Items([(r.item_id, r.text.encode()) for r in rows])
    got = {r.doc_id: set(r.item_ids) for r in D.query(spark, sf).collect()}
    found = wanted = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = brute(r.text, items)
        assert got[r.doc_id] <= want
        found, wanted = found + len(got[r.doc_id]), wanted + len(want)
    assert wanted > 0 and found >= 0.98 * wanted


def test_planted_copies_paraphrases_and_clean_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["on", "ti", "er", "an", "re", "ha", "st", "the"]) for _ in range(rng.randint(1, 4)))
    make = lambda n: [word() for _ in range(n)]
    bench = [(k, " ".join(make(rng.randint(12, 60))) + ". " + " ".join(make(6)) + ".") for k in range(30)]
    bench += [(100, None), (101, ""), (102, "...")]
    docs, want = [], {}
    for k in range(120):
        words = make(rng.randint(0, 400))
        if k % 3 == 0:
            item, text = bench[k // 4]
            w = text.split()
            if k % 2:  # every sixth word replaced
                w = [word() if n % 6 == 2 else x for n, x in enumerate(w)]
            at = rng.randint(0, len(words))
            words[at:at] = [x.upper() for x in w]
            want[k] = item
        docs.append((k, " ".join(words), 1))
    docs += [(200, None, 1), (201, "", 1), (201, "", 1), (None, bench[3][1], 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, leaks0 int").withColumn("leaks", F.lit(1))
    items = spark.createDataFrame(bench, "item_id long, text string")
    out = D.mark(df, items)
    assert out.columns == ["doc_id", "text", "leaks0", "leaks"]
    got = {(r.doc_id, r.text): [x.item_id for x in r.leaks] for r in out.collect()}
    for (d, _), found in got.items():
        assert found == ([3] if d is None else [want[d]] if d in want else []), d
    assert D.mark(df, items.limit(0)).where("size(leaks) > 0").count() == 0
    assert D.mark(df.limit(0), items).count() == 0


def test_parts_of_the_benchmark(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = {r.doc_id: r.item_ids for r in D.query(spark, sf).collect()}
    monkeypatch.setattr(D, "ITEMS", 15)
    parts = {r.doc_id: r.item_ids for r in D.query(spark, sf).collect()}
    assert whole == parts


def test_paraphrases_from_a_large_benchmark(spark):
    rng = random.Random(3)
    texts = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if r.text]
    bag = [w for t in texts for w in t]
    long = [t for t in texts if len(t) > 80]
    bench = []
    for k in range(2000):
        t, n = rng.choice(long), rng.randint(20, 59)
        at = rng.randrange(len(t) - n)
        bench.append((k, " ".join(t[at : at + n])))
    docs = []
    for k in range(300):  # two words of five replaced
        item = rng.choice(bench)[1].split()
        kept = set(rng.sample(range(len(item)), round(0.6 * len(item))))
        pad = [rng.choice(bag) for _ in range(150)]
        pad[70:70] = [w if n in kept else rng.choice(bag) for n, w in enumerate(item)]
        docs.append((k, " ".join(pad)))
    items = D.Items([(k, t.encode()) for k, t in bench])
    rest = [(1000 + k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r.doc_id: {x.item_id for x in r.leaks} for r in D.mark(spark.createDataFrame(docs + rest, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = {(d, i) for d, t in docs for i in brute(t, items)}
    found = sum(i in got[d] for d, i in want)
    assert len(want) > 150 and found >= 0.99 * len(want), (found, len(want))


def test_items_that_repeat_or_share_a_template(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["on", "ti", "er", "an", "re", "ha", "st", "the"]) for _ in range(rng.randint(2, 4)))
    make = lambda n: " ".join(word() for _ in range(n))
    texts = [make(30) for _ in range(8)]
    head = make(24)
    tables = [
        [(k, texts[k % 8]) for k in range(24)],  # a table three times
        [(k, texts[0] if k % 3 == 0 else make(30)) for k in range(60)],
        [(k, head + " " + make(3)) for k in range(40)] + [(90, head)],  # an item of a template's words only
    ]
    for bench in tables:
        docs = [(k, make(90) + " " + bench[k * 3 % len(bench)][1] + " " + make(70)) for k in range(12)] + [(50, make(80) + " " + bench[-1][1]), (51, make(200))]
        got = {r.doc_id: {x.item_id for x in r.leaks} for r in D.mark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
        for d, t in docs:
            assert got[d] >= {i for i, item in bench if f" {item} " in f" {t} "}, d
        assert not got[51]
