import numpy as np
import pytest

from engramlake.functions import quantize as Z
from engramlake.operators import quantized_store as S
from engramlake.plans.catalog import QUERIES


def units(n, dims, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize(("bits", "most"), [(8, 0.005), (4, 0.02), (2, 0.5)])
def test_error_bounds(bits, most):
    x = units(300, 64)
    turn = Z.rotation(64)
    radius, codes = Z.encode(x, bits, turn)
    assert ((Z.decode(radius, codes, bits, turn) - x) ** 2).sum(axis=1).mean() < most
    assert (Z.unpack(Z.pack(codes, bits), bits, 64) == codes).all()


def test_polar_codes_round_trip():
    x = units(200, 16) * np.linspace(0.1, 9, 200)[:, None]
    x[0] = 0
    turn = Z.rotation(16)
    errors = []
    for bits in (2, 4, 8):
        radius, codes = Z.polar_encode(x, bits, turn)
        assert np.allclose(radius, np.linalg.norm(x, axis=1)) and codes.shape == (200, 15) and codes.max() < 1 << bits
        errors.append(((Z.polar_decode(radius, codes, bits, turn) - x) ** 2).sum(axis=1)[1:].mean() / (x * x).sum(axis=1)[1:].mean())
    assert errors[0] > errors[1] > errors[2] and errors[2] < 0.001


@pytest.mark.parametrize(("bits", "dims"), [(2, 64), (4, 64), (8, 64), (4, 13), (2, 13)])
def test_looked_up_is_decoded(bits, dims):
    x, q = units(50, dims) * 3, units(1, dims, 2)[0] * 2
    turn = Z.rotation(dims)
    block = S._block(bits, np.arange(50), x, turn).to_pylist()[0]
    radius, codes = Z.encode(x, bits, turn)
    back = Z.decode(radius, codes, bits, turn)
    want = back @ q / np.linalg.norm(q) / np.linalg.norm(back, axis=1)
    assert np.allclose(S.similarities(q, block, turn, sketched=False), want, atol=1e-6)
    assert (S.similarities(q * 0, block, turn) == 0).all()


def test_sketch_brings_cosines_nearer():
    x, q = units(2000, 64), units(40, 64, 3)
    turn = Z.rotation(64)
    block = S._block(2, np.arange(2000), x, turn).to_pylist()[0]
    off = {s: np.mean([np.square(S.similarities(v, block, turn, s) - x @ v).mean() for v in q]) for s in (True, False)}
    assert off[True] < off[False]


@pytest.mark.parametrize(("bits", "least"), [(8, 0.99), (4, 0.95)])
def test_recall_against_exact_search(spark, bits, least):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS fact_id", "embedding AS v")
    rows = v.collect()
    ids, x = np.array([r.fact_id for r in rows]), np.array([r.v for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    store = S.write_store(v.withColumn("bits", S.F.lit(bits)))
    got = S.search(store, v.where("fact_id % 20 = 0").selectExpr("fact_id AS query_id", "v"), v, 10).collect()
    right = {(int(ids[i]), int(ids[j])) for i in range(len(ids)) if ids[i] % 20 == 0 for j in np.lexsort((ids, -np.round(x @ x[i], 9)))[:10]}
    assert len(right & {(r.query_id, r.fact_id) for r in got}) / len(right) >= least


def test_widths_and_odd_rows(spark):
    x = units(8, 6)
    rows = [(k, x[k].tolist(), (32, 8, 4, 2, 0, 32, 8, 4)[k]) for k in range(8)] + [(9, None, 8), (10, [0.0] * 6, 4), (11, [0.0] * 6, 32)]
    facts = spark.createDataFrame(rows, "fact_id long, v array<double>, bits int")
    store = S.write_store(facts)
    assert sorted(i for r in store.collect() for i in r.ids) == [0, 1, 2, 3, 5, 6, 7, 10, 11]
    asked = facts.where("fact_id IN (0, 1, 9)").selectExpr("fact_id AS query_id", "v")
    got = {(r.query_id, r["rank"]): (r.fact_id, r.score) for r in S.search(store, asked, facts, 3).collect()}
    assert got[0, 1] == (0, 1.0) and got[1, 1] == (1, 1.0) and len(got) == 6
    assert S.search(S.write_store(facts.limit(0)), asked, facts, 3).count() == 0


def test_queries(spark):
    sf = "/root/testdata/sf0.01"
    widths = {r.bits: r for r in QUERIES["mixed_precision"](spark, sf).collect()}
    assert set(widths) <= {2, 4, 8, 32} and len(widths) > 1
    assert all(r.mean_error < {2: 0.5, 4: 0.02, 8: 0.005, 32: 1e-9}[b] for b, r in widths.items())
    assert all(r.bytes == r.facts * 64 * b // 8 for b, r in widths.items())
    assert QUERIES["quantised_search"](spark, sf).count() == 250


@pytest.mark.parametrize("bits", [2, 4, 8, 32])
def test_blocks_of_queries_score_as_one_query_does(bits):
    rng = np.random.default_rng(3)
    x, q, turn = rng.normal(size=(40, 12)), rng.normal(size=(5, 12)), S.Z.rotation(12)
    block = S._block(bits, np.arange(40), x, turn).to_pylist()[0]
    got = S.block_similarities(q, block, turn)
    assert np.allclose(got, [S.similarities(v, block, turn) for v in q], atol=1e-12)
