import oracle
import pytest

from engramlake.operators import fulltext as X
from engramlake.plans.catalog import ORACLES, QUERIES

TEXTS = {
    1: "The quick brown fox, the quick red fox",
    2: "quick quick brown",
    3: "Brown quick",
    4: None,
    5: "",
    6: "fox-brown Quickly brownish",
    7: "a b a b a",
}


@pytest.fixture(scope="module")
def index(spark):
    return X.TextIndex.build(spark.createDataFrame(list(TEXTS.items()), "fact_id long, content string"))


def tf(spark, index, kind, *words):
    rows = index.occurrences(spark.createDataFrame([(1, 1, "all", kind, list(words))], X.CLAUSES)).collect()
    return {r.key: r.tf for r in rows}


def test_postings(index):
    rows = {(r.term, r.key): (r.tf, r.positions) for r in index.postings.collect()}
    assert rows["quick", 1] == (2, [1, 5]) and rows["a", 7] == (3, [0, 2, 4])
    assert {r.key: r.length for r in index.sizes.collect()} == {1: 8, 2: 3, 3: 2, 4: 0, 5: 0, 6: 4, 7: 5}


def test_phrases_and_prefixes(spark, index):
    assert tf(spark, index, "phrase", "quick", "brown") == {1: 1, 2: 1}
    assert tf(spark, index, "phrase", "the", "quick") == {1: 2}
    assert tf(spark, index, "phrase", "a", "b", "a") == {7: 2}
    assert tf(spark, index, "phrase", "quick", "quick") == {2: 1}
    assert tf(spark, index, "phrase", "fox", "brown") == {6: 1}
    assert tf(spark, index, "phrase", "fox") == {1: 2, 6: 1}
    assert tf(spark, index, "phrase") == {} and tf(spark, index, "phrase", "none") == {}
    assert tf(spark, index, "prefix", "quick") == {1: 2, 2: 2, 3: 1, 6: 1}
    assert tf(spark, index, "prefix", "brownishly") == {} and tf(spark, index, "prefix", "") == {}


def test_set_algebra(spark, index):
    def keys(*clauses):
        df = spark.createDataFrame([(1, n, *c) for n, c in enumerate(clauses)], X.CLAUSES)
        return {r.key for r in index.search(df).collect()}

    brown, fox, quick = ("phrase", ["brown"]), ("phrase", ["fox"]), ("prefix", ["quick"])
    assert keys(("all", *brown), ("all", *fox)) == {1, 6}
    assert keys(("all", *brown), ("none", *fox)) == {2, 3}
    assert keys(("any", *fox), ("any", "phrase", ["b"])) == {1, 6, 7}
    assert keys(("all", *quick), ("any", "phrase", ["the"]), ("any", "phrase", ["brownish"])) == {1, 6}
    assert keys(("none", *fox)) == set() and keys(("all", "phrase", ["zzz"]), ("any", *fox)) == set()


@pytest.mark.parametrize("name", ["phrase_search", "boolean_search", "hybrid_search"])
def test_against_a_scan(spark, name):
    sf = "/root/testdata/sf0.01"
    df = QUERIES[name](spark, sf)
    assert df.count() > 10
    assert oracle.differences(df, ORACLES[name], sf) is None


def test_an_index_for_stated_clauses_holds_their_postings_only(spark, index, monkeypatch):
    docs = spark.createDataFrame(list(TEXTS.items()), "fact_id long, content string")
    clauses = spark.createDataFrame([(1, 1, "all", "phrase", ["quick", "brown"]), (1, 2, "any", "prefix", ["fo"]), (2, 1, "all", "phrase", ["a", "b", "a"]), (2, 2, "any", "prefix", []), (2, 3, "none", "phrase", [])], X.CLAUSES)
    few = X.TextIndex.build(docs, clauses=clauses)
    held = lambda i: {(r.term, r.key): (r.tf, list(r.positions)) for r in i.postings.collect()}
    assert held(few) == {k: v for k, v in held(index).items() if k[0] in ("quick", "brown", "a", "b") or k[0].startswith("fo")}
    assert sorted(map(tuple, few.sizes.collect())) == sorted(map(tuple, index.sizes.collect()))
    rows = lambda i: sorted(map(tuple, i.search(clauses).collect()))
    assert rows(few) == rows(index) and rows(few)
    monkeypatch.setattr(X, "ASKED", 2)  # more terms than that: the whole index
    assert held(X.TextIndex.build(docs, clauses=clauses)) == held(index)


@pytest.mark.parametrize("name", ["boolean_search", "hybrid_search"])
def test_every_item_of_the_benchmark_is_asked(spark, name):
    sf = "/root/testdata/sf0.01"
    asked = {r.query_id for r in QUERIES[name](spark, sf).select("query_id").distinct().collect()}
    items = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    assert len(asked) > items // 2 and any(q % 20 for q in asked)
