import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from engramlake.operators import centrality as C
from engramlake.operators import communities as M
from engramlake.operators import graph as G
from engramlake.plans.catalog import QUERIES


def brandes(edges, sources, nodes, weighted=True):
    """Dependencies of each source by a queue of distances."""
    out = defaultdict(dict)
    for a, b, w in edges:
        if a != b:
            out[a][b] = max(out[a].get(b, 0), w) if weighted else 1
    total = dict.fromkeys(nodes, 0.0)
    for s in sources:
        done, dist, paths, before, queue = [], {}, defaultdict(float), defaultdict(list), [(0, s)]
        best, paths[s] = {s: 0}, 1.0
        while queue:
            d, v = heapq.heappop(queue)
            if v in dist:
                continue
            dist[v] = d
            done.append(v)
            for x, w in out[v].items():
                if x not in dist and (x not in best or d + w < best[x]):
                    best[x], paths[x], before[x] = d + w, 0.0, []
                    heapq.heappush(queue, (d + w, x))
                if x not in dist and d + w == best[x]:
                    paths[x] += paths[v]
                    before[x].append(v)
        dep = defaultdict(float)
        for v in reversed(done):
            for u in before[v]:
                dep[u] += paths[u] / paths[v] * (1 + dep[v])
            if v != s:
                total[v] += dep[v]
    n = len(nodes)
    return {v: x * n / len(sources) / ((n - 1) * (n - 2)) for v, x in total.items()}


@pytest.mark.parametrize("weighted", [True, False])
def test_betweenness_is_brandes(spark, weighted):
    """From all nodes by weights, from every tenth by steps."""
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200), float(rng.randrange(1, 4))) for _ in range(900)] + [(0, k, 1.0) for k in range(1, 60)] + [(500, 501, 1.0), (3, 3, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    nodes = {x for e in edges for x in e[:2]} | {900}
    lone = spark.createDataFrame([(900,)], "node long")
    some = sorted(n for n in nodes if weighted or n % 10 == 0)
    sources = None if weighted else spark.createDataFrame([(n,) for n in some], "node long")
    got = {r.node: r.betweenness for r in C.betweenness(df, sources, lone, weighted).collect()}
    assert got == pytest.approx(brandes(edges, some, nodes, weighted))


def test_small_graphs(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    assert {r.node: r.betweenness for r in C.betweenness(df).collect()} == {1: 0.0, 2: 0.5, 3: 0.0}
    assert {r.betweenness for r in C.betweenness(df.limit(1)).collect()} == {0.0}
    assert C.betweenness(df.limit(0)).count() == 0


def plain_modularity(edges, of):
    w = {}
    for a, b, x in edges:
        if a != b:
            w[min(a, b), max(a, b)] = max(x, w.get((min(a, b), max(a, b)), 0))
    two_m = 2 * sum(w.values())
    k = defaultdict(float)
    for (a, b), x in w.items():
        k[of[a]] += x
        k[of[b]] += x
    return sum(2 * x for (a, b), x in w.items() if of[a] == of[b]) / two_m - sum(v * v for v in k.values()) / two_m**2


def hangs_together(edges, of):
    near = defaultdict(set)
    for a, b, _ in edges:
        if a != b and of[a] == of[b]:
            near[a].add(b)
            near[b].add(a)
    for c in set(of.values()):
        own = {n for n, x in of.items() if x == c}
        seen, todo = set(), [min(own)]
        while todo:
            if (v := todo.pop()) not in seen:
                seen.add(v)
                todo += near[v]
        if seen != own or min(own) != c:
            return False
    return True


def test_planted_communities(spark):
    rng = random.Random(5)
    edges = [(20 * c + rng.randrange(20), 20 * c + rng.randrange(20), 1.0) for c in range(6) for _ in range(90)] + [(rng.randrange(120), rng.randrange(120), 1.0) for _ in range(40)]
    edges += [(200, 201, 2.0), (201, 200, 3.0), (300, 300, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    found = {}
    for parts in (1, 9):
        of = {r.node: r.community for r in M.communities(df.repartition(parts)).collect()}
        found.setdefault("of", of)
        assert of == found["of"]
    assert set(of) == {x for a, b, _ in edges if a != b for x in (a, b)} and hangs_together(edges, of)
    by_label = {r.node: r.label for r in G.label_propagation(df.where("src <> dst")).collect()}
    assert plain_modularity(edges, of) >= max(plain_modularity(edges, by_label), 0.6)
    assert of[200] == of[201] == 200
    links = M.undirected(df)
    nodes = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).join(spark.createDataFrame(list(of.items()), "node long, c long"), "node")
    assert M.modularity(links, nodes) == pytest.approx(plain_modularity(edges, of))
    # finer at a higher resolution
    few = df.where("src < 40 AND dst < 40")
    fine = {r.node: r.community for r in M.communities(few, resolution=6.0).collect()}
    assert len(set(fine.values())) > 4 and hangs_together([e for e in edges if max(e[:2]) < 40], fine)
    assert M.communities(df.limit(0)).count() == 0


def test_communities_of_parts(spark):
    sf = "/root/testdata/sf0.001"
    from engramlake.sources.tables import part_edges

    edges = [(r.src, r.dst, r.weight) for r in part_edges(spark, sf).collect()]
    of = {r.node: r.community for r in QUERIES["modular_communities"](spark, sf).collect()}
    by_label = {r.node: r.label for r in G.label_propagation(part_edges(spark, sf)).collect()}
    assert hangs_together(edges, of)
    assert plain_modularity(edges, of) >= plain_modularity(edges, by_label)


def test_batches_of_sources_keep_their_tables_no_longer_than_they_run(spark, monkeypatch):
    import os

    pairs = [(0, 1), (1, 2), (0, 3), (3, 2), (2, 4), (4, 0)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")
    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    monkeypatch.setattr(C, "ROWS", 15)
    left = []
    taken = C._through
    monkeypatch.setattr(C, "_through", lambda *a: left.append(sum(len(os.listdir(f"{at}/{p}")) for p in os.listdir(at) if p.startswith("paths-"))) or taken(*a))
    got = {r.node: r.betweenness for r in C.betweenness(edges, weighted=False).collect()}
    assert len(left) == 2 and not any(left)
    want = brandes([(a, b, 1.0) for a, b in pairs], range(5), range(5), False)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in range(5))


def test_second_edges_of_chains_go(spark):
    rng = random.Random(6)
    rows = {(rng.randrange(30), rng.randrange(30)): float(rng.randint(1, 9)) for _ in range(60)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "src long, dst long, weight double")
    df = G.collapse_chains(edges)
    chains = [(a, c, w) for (a, b), w in rows.items() for (d, c) in rows if b == d]
    want = {e: w for e, w in rows.items() if not any(d == e[0] for _, d in rows)}
    for a, c, w in chains:
        if a != c:
            want[a, c] = max(w, want.get((a, c), 0))
    assert {(r.src, r.dst): r.weight for r in df.collect()} == want
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # the chains are listed once; three joins before


def test_label_propagation_deals_in_proportion_to_the_links(spark, monkeypatch):
    edges = spark.createDataFrame([(a, b, float(1 + (a + b) % 3)) for a in range(40) for b in range(a + 1, 40) if (a * b) % 3 == 1], "src long, dst long, weight double")
    want = {r.node: r.label for r in G.label_propagation(edges).collect()}
    asked, deal = [], G.dealt
    monkeypatch.setattr(G, "dealt", lambda df, rows, *keys: asked.append((rows, *keys)) or deal(df, rows * 2000, *keys))
    assert {r.node: r.label for r in G.label_propagation(edges, rounds=5).collect()} == want
    n = 2 * edges.count()
    assert asked == [(n, "dst"), (n, "node")] * 5


def test_tables_of_many_nodes_are_not_broadcast(spark):
    links = M.undirected(spark.createDataFrame([(a, (a * 7 + 1) % 30, 1.0) for a in range(30)], "src long, dst long, weight double"))
    nodes = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumn("c", F.col("node") % 3)
    plan = lambda n: M._gains(links, nodes, "c", 60.0, 1.0, n)
    assert "Broadcast" not in plan(M.FEW + 1)._jdf.queryExecution().executedPlan().toString()  # whatever was small was broadcast before
    assert sorted(map(tuple, plan(M.FEW + 1).collect())) == sorted(map(tuple, plan(1).collect()))
