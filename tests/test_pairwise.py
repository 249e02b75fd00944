import math

import numpy as np

from engramlake.operators import pairwise as P
from engramlake.operators import retrieval as Q


def _cosine(a, b):
    if b is None or None in b or len(a) != len(b):
        return 0.0
    na, nb = (math.sqrt(sum(x * x for x in v)) for v in (a, b))
    return 0.0 if na < 1e-6 or nb < 1e-6 else sum(x * y for x, y in zip(a, b)) / (na * nb)


def _rows():
    rng = np.random.default_rng(5)
    facts = {i: rng.normal(size=8).tolist() for i in range(700)}
    facts |= {i: facts[i % 40] for i in range(700, 800)}  # copies tie
    facts |= {801: [0.0] * 8, 802: None, 803: [1.0, 2.0], 804: [1.0] * 7 + [None], 805: [-x for x in facts[3]]}
    return facts, {i: facts[i] for i in (3, 7, 11, 700, 801)}


def _frames(spark, facts, asked):
    return spark.createDataFrame(list(asked.items()), "query_id long, v array<double>"), spark.createDataFrame(list(facts.items()), "fact_id long, v array<double>").repartition(3)


def test_nearest_by_blocks_agrees_with_every_pair(spark, monkeypatch):
    monkeypatch.setattr(P, "PAIRS", 500)  # several cells
    monkeypatch.setattr(P, "FIRST", 16)
    monkeypatch.setattr(P, "COLUMNS", 33)
    facts, asked = _rows()
    q, v = _frames(spark, facts, asked)
    plan = Q.nearest(q, v, 12)
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString() and "NestedLoop" not in plan._jdf.queryExecution().toString()
    got = {(r.query_id, r.rank): (r.fact_id, round(r.score, 9)) for r in plan.collect()}
    scaled = {(r.query_id, r.fact_id): r.score for r in Q.scaled_nearest(q, v, 3).collect()}
    for i, a in asked.items():
        every = sorted((-round(_cosine(a, b), 9) + 0.0, f) for f, b in facts.items())
        assert [got[i, k + 1] for k in range(12)] == [(f, -s + 0.0) for s, f in every[:12]]
        low, high = -every[-1][0], -every[0][0]
        for s, f in every[:3]:
            assert scaled[i, f] is None if low == high else abs(scaled[i, f] - (-s - low) / (high - low)) < 1e-6


def test_attention_ties_at_nine_digits_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(P, "PAIRS", 2000)
    monkeypatch.setattr(P, "COLUMNS", 64)
    # 6000 vectors of nearly one share: those that differ by less than a digit rank by id
    facts = {i: [1.0 + (i * 7919 % 6000) * 1e-9, 0.5] for i in range(6000)}
    q, v = _frames(spark, facts, {0: [1.0, 1.0]})
    got = [(r.fact_id, r.rank) for r in Q.hopfield(q, v, 0.5, 5).orderBy("rank").collect()]
    z = {i: 0.5 * sum(x) for i, x in facts.items()}
    top = max(z.values())
    total = sum(math.exp(x - top) for x in z.values())
    want = sorted(z, key=lambda i: (-round(math.exp(z[i] - top) / total, 9), i))[:5]
    assert got == [(i, k + 1) for k, i in enumerate(want)]


def test_neighbours_within_a_community_by_blocks(spark, monkeypatch):
    from engramlake.operators import encoding as E

    monkeypatch.setattr(P, "PAIRS", 300)  # several parts of a community
    monkeypatch.setattr(P, "COLUMNS", 33)
    facts, _ = _rows()
    of = {i: None if i == 9 else i % 3 for i in facts}
    v = spark.createDataFrame([(i, of[i], x) for i, x in facts.items()], "fact_id long, community int, v array<double>")
    new = v.where("fact_id % 20 = 0 OR fact_id > 800")
    df = P.nearest_within(new.withColumnRenamed("fact_id", "query_id"), v, 4, earlier=True)
    assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().toString()
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.fact_id, round(r.score, 9) + 0.0))
    near = {(r.src, r.dst): round(r.weight, 9) for r in E.semantic_edges(new, v, 0.5, 3).collect()}
    want = set()
    for i in facts:
        if i % 20 and i <= 800:
            continue
        every = sorted((-round(_cosine(facts[i], facts[j]) if facts[i] and None not in facts[i] else 0.0, 9) + 0.0, j) for j in facts if j != i and of[i] is not None and of[j] == of[i])
        before = [(n + 1, j, -s + 0.0) for n, (s, j) in enumerate([x for x in every if x[1] < i][:4])]
        assert sorted(got.get(i, [])) == before
        want |= {(i, j, -s) for s, j in [x for x in every if x[0] <= -0.5][:3]}
    assert {(a, b, w) for (a, b), w in near.items()} == want
    assert P.nearest_within(new.withColumnRenamed("fact_id", "query_id").limit(0), v, 4).count() == 0
