import random

import oracle
import pytest

from engramlake.operators import merge as M
from engramlake.plans.catalog import ORACLES, QUERIES


def one_by_one(pairs):
    lost, out = set(), []
    for at, r, n, w, l in sorted(pairs):
        if w not in lost and l not in lost:
            lost.add(l)
            out.append((w, l))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_is_the_pass_in_order(spark, seed):
    rng = random.Random(seed)
    pairs = []
    for r in range(60):
        for k in range(rng.randrange(5)):
            other = rng.randrange(60)
            if other != r:
                pairs.append((rng.randrange(9), r, k, min(r, other), max(r, other)))
    pairs += [(0, 900 + k, 0, 5000, 900 + k) for k in range(200)]  # one fact that wins them all
    pairs += [(k, k, 9, 500 + k, 501 + k) for k in range(6)] + [(9 - k, k, 8, 600 + k, 601 + k) for k in range(6)]  # chains both ways
    df = spark.createDataFrame([*pairs, (0, 7, 99, 7, 7)], "at int, r int, rank int, canonical int, loser int")
    got = M.greedy(df, ["at", "r", "rank"])
    assert sorted((x.canonical, x.loser) for x in got.collect()) == one_by_one(pairs)
    assert M.greedy(df.limit(0), ["at", "r", "rank"]).count() == 0


def test_merges_of_facts(spark):
    sf = "/root/testdata/sf0.01"
    for name in ("near_duplicate_pairs", "auto_links", "semantic_channel", "index_nearest"):
        assert oracle.differences(QUERIES[name](spark, sf), ORACLES[name], sf) is None
    pairs = QUERIES["near_duplicate_pairs"](spark, sf).collect()
    assert len(pairs) > 20
    merged = QUERIES["near_duplicate_merge"](spark, sf).collect()
    day = lambda i: i % 365
    want = one_by_one([((day(p.r), p.r, p["rank"]), 0, 0, p.canonical, p.loser) for p in pairs])
    assert sorted((m.winner, m.loser) for m in merged) == want
    assert len({m.loser for m in merged}) == len(merged)
