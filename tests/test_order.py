import datetime as dt
import random

import numpy as np
import oracle
from pyspark.sql import functions as F

from engramlake.operators import consolidate as C
from engramlake.operators import graph as G
from engramlake.operators import ordered as O
from engramlake.plans.catalog import ORACLES, QUERIES
from engramlake.plans.order_queries import _with_vectors

SF = "/root/testdata/sf0.001"


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / n) if n else 0.0


def plain_gate(rows, threshold, window):
    recent, out = {}, {}
    for r in rows:
        held = recent.setdefault(r["profile_id"], [])
        if not r["ok"]:
            out[r["fact_id"]] = "rule"
        elif r["v"] is not None and any(cosine(r["v"], h) > threshold for h in held):
            out[r["fact_id"]] = "similar"
        else:
            out[r["fact_id"]] = "pass"
            if r["v"] is not None:
                held.append(r["v"])
                del held[:-window]
    return out


def plain_scenes(rows, threshold):
    scenes, out = {}, {}
    for r in rows:
        known = scenes.setdefault(r["profile_id"], [])
        best = max(((round(cosine(r["v"], t), 9), -k) for k, (_, t) in enumerate(known)), default=(-2, 0)) if r["v"] is not None else (-2, 0)
        if best[0] >= threshold:
            out[r["fact_id"]] = known[-best[1]][0]
        else:
            out[r["fact_id"]] = r["fact_id"]
            if r["theme"] is not None:
                known.append((r["fact_id"], r["theme"]))
    return out


def made(spark):
    rng = random.Random(2)
    seeds = np.random.default_rng(3).normal(size=(12, 6))
    rows = []
    for k in range(400):
        v = None if k % 41 == 0 else (seeds[rng.randrange(12)] + np.random.default_rng(k).normal(size=6) * rng.choice([0.01, 0.6])).tolist()
        rows.append((k, rng.choice(["a", "b", None, "c"]), dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(30)), [0.0] * 6 if k % 53 == 0 else v, v if v is None else seeds[k % 12].tolist(), k % 17 != 0))
    return spark.createDataFrame(rows, "fact_id long, profile_id string, created_on date, v array<double>, theme array<double>, ok boolean")


def in_order(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["created_on"], r["fact_id"]))


def test_gate_is_a_plain_loop(spark):
    df = made(spark)
    for window in (1, 7, 50):
        got = {r.fact_id: r.verdict for r in O.similarity_gate(df, F.col("ok"), 0.95, window).collect()}
        assert got == plain_gate(in_order(df), 0.95, window)
    assert set(got.values()) == {"pass", "rule", "similar"}
    assert O.similarity_gate(df.limit(0), F.col("ok")).count() == 0


def test_the_ring_is_bounded():
    ring = O.Ring(5, 0.99)
    for v in np.random.default_rng(1).normal(size=(200, 8)):
        ring(v / np.linalg.norm(v))
    assert ring.held.shape == (5, 8)


def test_scenes_are_a_plain_loop(spark):
    df = made(spark)
    got = {r.fact_id: r.scene for r in O.scenes(df.repartition(5), 0.6).collect()}
    assert got == plain_scenes(in_order(df), 0.6)
    assert 20 < len(set(got.values())) < 400


def test_scenes_are_the_same_in_blocks(spark):
    df = made(spark)
    for block in (7, 50):
        got = {r.fact_id: r.scene for r in O.scenes(df, 0.6, block).collect()}
        assert got == plain_scenes(in_order(df), 0.6)
    assert O.scenes(df.limit(0)).count() == 0


def test_a_likeness_at_the_threshold_counts(spark):
    # 0.6 to nine digits, whatever the order of a sum; copies of a text go to the earliest scene
    rows = [(k, "a", dt.date(2024, 1, 1), v, v) for k, v in enumerate(([1.0, 0.0], [3.0, 4.0], [0.0, 1.0], [3.0, 4.0], [0.3 * 3, 0.3 * 4]))]
    df = spark.createDataFrame(rows, "fact_id long, profile_id string, created_on date, v array<double>, theme array<double>")
    for block in (1, 2, 9):
        assert {r.fact_id: r.scene for r in O.scenes(df, 0.6, block).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2}


def test_over_texts(spark):
    f = _with_vectors(spark, SF)
    rows = in_order(f)
    got = {r.fact_id: r.scene for r in QUERIES["scene_assignment"](spark, SF).collect()}
    assert got == plain_scenes(rows, 0.6)
    gate = {r.fact_id: r.verdict for r in QUERIES["entropy_gate"](spark, SF).collect()}
    assert gate == plain_gate([r | {"ok": len((r["content"] or "").strip()) >= 10} for r in rows], 0.95, 50)
    assert "similar" in gate.values()


def test_links_are_those_of_every_pair(spark):
    rng = random.Random(4)
    sets = {k: {rng.randrange(40) for _ in range(rng.randrange(5))} for k in range(120)} | {200 + k: {98, 99} for k in range(100)}
    rows = [(k % 2, k, f"e{e}") for k, es in sets.items() for e in es]
    links = C.overlap_links(spark.createDataFrame([*rows, rows[0], (0, 1, None)], "profile_id long, fact_id long, entity string"))
    got = {r.node: r.component for r in G.connected_components(links).collect()}
    of = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and a % 2 == b % 2 and len(sets[a] & sets[b]) >= 2 and of[a] != of[b]:
                old, new = max(of[a], of[b]), min(of[a], of[b])
                of = {k: new if c == old else c for k, c in of.items()}
    alone = {k for k in of if list(of.values()).count(of[k]) == 1}
    assert got == {k: c for k, c in of.items() if k not in alone}
    # a pair that a hundred facts have gives a link a fact, not one for every two
    assert links.where("src >= 200").count() == 98


def test_blocks(spark):
    sf = "/root/testdata/sf0.01"
    df = QUERIES["consolidated_blocks"](spark, sf)
    assert df.count() > 10
    assert oracle.differences(df, ORACLES["consolidated_blocks"], sf) is None


def test_large_clusters_are_cut(spark):
    t = dt.datetime(2024, 1, 1)
    facts = spark.createDataFrame([(k, t + dt.timedelta(hours=k), 1.0, 1.0, 0.4, f"fact {k} " + "x" * 600) for k in range(45)] + [(99, t + dt.timedelta(days=30), 1.0, 1.0, 0.4, "far")], "fact_id long, at timestamp, importance double, confidence double, retention double, content string")
    entities = spark.createDataFrame([(1, k, e) for k in [*range(45), 99] for e in ("A", "B")], "profile_id long, fact_id long, entity string")
    members = C.clusters(facts, entities)
    sizes = {r.cluster: r["count"] for r in members.groupBy("cluster").count().collect()}
    assert sizes == {0: 20, 20: 20, 40: 5}
    g = {r.cluster: r for r in C.gists(facts, entities, members).collect()}
    assert len(g[0].gist) == 500 and g[0].gist.endswith("...") and g[0].representative == 0 and g[0].shared == "A, B" and g[40].sources == [40, 41, 42, 43, 44]


def test_closest_path_is_found_for_every_symbol(spark):
    sf = "/root/testdata/sf0.01"
    df = QUERIES["closest_path"](spark, sf)
    parts = spark.read.parquet(f"{sf}/part.parquet")
    shared = parts.groupBy("p_name").count().where("count > 1")
    assert df.count() == parts.join(shared, "p_name").count() > parts.count() // 2
    assert oracle.differences(df, ORACLES["closest_path"], sf) is None
