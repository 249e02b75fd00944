import itertools
import random
import re

import numpy as np
import pytest

from engramlake.llm import jaccard_join as J


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def brute(rows, size, percent):
    sets = [(d, shingles(t, size)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {d: (len(s), root(d)) for d, s in sets}


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(1500):
        n = int(rng.integers(1, 400))
        u = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        drop, add = int(rng.integers(0, n // 6 + 1)), int(rng.integers(0, n // 6 + 1))
        v = np.concatenate([u[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)])
        u, v = np.unique(u), np.unique(v)
        both = len(np.intersect1d(u, v))
        if 100 * both >= percent * (len(u) + len(v) - both):
            assert np.intersect1d(J.signatures(u, percent), J.signatures(v, percent)).size


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 90, 256), (5, 80, 3)])
def test_against_brute_force(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(J, "BLOCK_SETS", block)
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    rows = [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "one"), (906, "É x"), (907, "é x")]
    shared = [word() for _ in range(60)]
    n = 0
    for k in range(25):
        base = [word() for _ in range(rng.randint(5, 120))]
        if k % 5 == 0:
            base = shared + base[: rng.randint(2, 25)]
        for _ in range(rng.choice([1, 2, 4, 12])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n long".replace("n long", "sig string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link(df, size=size, percent=percent).collect()}
    assert got == brute(rows, size, percent)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "A B\tC")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in J.link(df, size=3, percent=90).collect())
    assert got == [(-1, 1, None), (1, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert J.link(df.limit(0)).count() == 0


def test_whole_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(rows, 3, 90)


@pytest.mark.parametrize("few", [2, 12])
def test_cells_join_what_links_join(monkeypatch, few):
    monkeypatch.setattr(J, "FEW", few)
    rng = np.random.default_rng(few)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 90)), dtype=np.uint64)
        for _ in range(int(rng.integers(1, 20))):
            some = np.concatenate([base[rng.random(len(base)) > 0.06], rng.integers(0, 1 << 63, int(rng.integers(0, 4)), dtype=np.uint64)])
            sets.append(np.unique(some))
    sets = sorted((u for u in sets if len(u)), key=len)
    for sides in (np.zeros(len(sets), dtype=int), rng.integers(0, 2, len(sets))):
        links = [
            (i, j) for i, j in itertools.combinations(range(len(sets)), 2)
            if (not sides.any() or sides[i] != sides[j]) and 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - n)
        ]

        def joined(pairs):
            up = list(range(len(sets)))
            root = lambda x: x if up[x] == x else root(up[x])
            for a, b in pairs:
                up[max(root(a), root(b))] = min(root(a), root(b))
            return [root(x) for x in range(len(sets))]

        got = J._compare(list(range(len(sets))), sets, sides, 80)
        assert set(got) <= set(links) and joined(got) == joined(links) and len(got) == len(sets) - len(set(joined(links)))


@pytest.mark.parametrize("small", [1, 2, 8])
def test_a_shared_passage_makes_no_large_cluster(spark, monkeypatch, small):
    monkeypatch.setattr(J, "SMALL", small)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(14))
    rows = []
    for k in range(60):
        own = [word() for _ in range(rng.randint(250, 330))]
        rows.append((2 * k, " ".join([*own, passage])))
        if k % 6 == 0:
            rows.append((2 * k + 1, " ".join([*own[:-4], passage])))
    found, cells = [], J._cells
    monkeypatch.setattr(J, "_cells", lambda members, percent: found.extend(r["count"] for r in members.groupBy("cluster").count().collect()) or cells(members, percent))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 5, 80)
    assert small < 8 or max(found) == 2


def test_what_may_be_left_out_loses_no_pair():
    rng = np.random.default_rng(11)
    seen = 0
    for _ in range(1500):
        u = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 600)), dtype=np.uint64) * np.uint64(2))
        v = np.unique(np.concatenate([u[rng.random(len(u)) > rng.random() * 0.2], rng.integers(0, 1 << 63, int(rng.integers(0, len(u) // 8 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(u, v))
        if not len(v) or 100 * both < 80 * (len(u) + len(v) - both):
            continue
        assert J._may_be_similar(len(u), J._counts(u), len(v), J._counts(v), 80)
        shared = len(np.intersect1d(J.signatures(u, 80), J.signatures(v, 80)))
        for x in (u, v):
            room = J._signatures(x, 80)[1]
            assert shared > room
            seen += room > 0
    assert seen > 300


def test_bounds_of_counts_of_two_widths():
    rng = np.random.default_rng(3)
    u = np.unique(rng.integers(0, 1 << 63, 1080, dtype=np.uint64) * np.uint64(2))
    w = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2))
    v = u[rng.permutation(len(u))[:980]]
    assert len(J._counts(u)) == 1024 and len(J._counts(v)) == 128
    assert J._may_be_similar(len(u), J._counts(u), len(v), J._counts(v), 80)
    assert not J._may_be_similar(len(u), J._counts(u), len(w), J._counts(w), 80)


def test_a_pair_in_many_large_buckets_is_met_once(monkeypatch):
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    common = draw(3000)
    sets = [np.unique(np.concatenate([common, draw(900)])) for _ in range(40)]
    sets.append(np.unique(np.concatenate([sets[7][:-5], draw(5)])))
    met = []
    similar = J._similar
    monkeypatch.setattr(J, "_similar", lambda u, v, percent: met.append((id(u), id(v))) or similar(u, v, percent))
    _, large = J._buckets(sets, 80)
    found = J._compare(list(range(41)), sets, np.zeros(41, dtype=np.int32), 80)
    assert sum(map(len, large)) > 1000 and [set(x) for x in found] == [{7, 40}]
    assert len(met) <= 2 * 41 * 40 // 2
