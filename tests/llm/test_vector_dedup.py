import math

import numpy as np
import pytest

from engramlake.llm import vector_dedup as V


def brute(rows, cosine):
    sound = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            sound[k] = x / np.linalg.norm(x)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    keys = sorted(sound, key=lambda k: rows[k][0])
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if len(sound[a]) == len(sound[b]) and (sound[a] * sound[b]).sum() >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)), key=lambda k: rows[k][0])
                up[y] = x
    return sorted((i if i is not None else -99, links[k], rows[root(k)][0] if k in sound else i) for k, (i, _) in enumerate(rows))


def result(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cell int")
    out = V.near_duplicates(df, **kw).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)
    return sorted((r.vec_id if r.vec_id is not None else -99, r.n_links, r.component_id) for r in out)


@pytest.mark.parametrize("piece", [1500, 7])
def test_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(V, "PIECE", piece)
    monkeypatch.setattr(V, "CELL", 20)
    rng = np.random.default_rng(piece)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 25))):
            rows.append((len(rows) * 3 % 1009, (centre + rng.normal(size=24) * rng.choice([0.0, 0.2, 0.33, 0.4])).tolist()))
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] + [1.0] * 23), (5004, [float("inf")] * 24), (5005, [None] + [1.0] * 23)]
    rows += [(None, rows[0][1]), (6000, [1e200] * 24), (6001, [1e-200] * 24), (6002, [3.0, 4.0]), (6003, [3.0, 4.1]), (6004, [-0.0, 1.0]), (6005, [0.0, 1.0]), (6005, [0.0, 1.0])]
    want = brute([r for r in rows if not (r[0] or 0) >= 6000 or r[0] >= 6002], 0.9)
    got = result(spark, rows)
    assert [r for r in got if r[0] not in (6000, 6001)] == want
    assert [r for r in got if r[0] in (6000, 6001)] == [(6000, 1, 6000), (6001, 1, 6000)]


def test_whole_small_table(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    out = V.query(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == brute(rows, 0.9)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert V.near_duplicates(df).count() == 0


def test_cells_of_pivots_too_near_to_tell_apart():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    blocks = V.Blocks(x, len(x), 0.9)
    turned = x @ blocks.turn
    for k, (a, b) in enumerate(blocks.cuts):
        p = turned[0, a:b]
        blocks.pivots[k] = np.stack([p, p + 1e-12])
    for _, row, cell, home in blocks.cells(turned):
        first = set(row[home & (cell == 0)].tolist())
        assert first and set(row[~home & (cell == 1)].tolist()) == first
