import hashlib

import corpus_pipeline as P
import public_tokenizers
import tiktoken
from test_decontaminate import brute as leaks
from test_jaccard_join import brute as groups
from test_line_dedup import brute as lines

from engramlake.llm import byte_bpe, decontaminate, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    by = {name: f for name, f in P.STAGES}
    rows = {r.doc_id: r.text for r in docs.collect()}

    one = by["toxicity"](spark, docs, SF)
    assert one.columns == columns
    scores = {r.doc_id: r.predicted for r in toxicity.query(spark, SF).collect()}
    rows = {d: t for d, t in rows.items() if not scores[d]}
    assert {r.doc_id: r.text for r in one.collect()} == rows

    two = by["line_dedup"](spark, one, SF)
    assert two.columns == columns
    kept = lines(list(rows.items()))
    rows = {d: kept[d] for d, t in rows.items() if kept[d] == t or kept[d].strip()}
    got = two.collect()
    assert {r.doc_id: r.text for r in got} == rows and all(r.n_chars == len(r.text) for r in got)

    three = by["jaccard_join"](spark, two, SF)
    assert three.columns == columns
    comp = groups(list(rows.items()), 5, 80)
    rows = {d: t for d, t in rows.items() if comp[d][1] == d}
    assert {r.doc_id: r.text for r in three.collect()} == rows

    four = by["decontaminate"](spark, three, SF)
    assert four.columns == columns
    items = decontaminate.Items([(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    leaked = {d for d, t in rows.items() if leaks(t, items)}
    left = {r.doc_id for r in four.collect()}
    assert left >= set(rows) - leaked and len(left & leaked) <= 0.02 * len(leaked)
    rows = {d: rows[d] for d in left}

    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {d: hashlib.sha256(",".join(map(str, tik.encode_ordinary(t))).encode()).hexdigest() for d, t in rows.items()}
    assert {r.doc_id: r.ids_sha256 for r in by["byte_bpe"](spark, four, SF).collect()} == want
    assert {r.doc_id: r.ids_sha256 for r in P.run(spark, SF).collect()} == want


def test_nulls_repeats_and_empty_tables(spark):
    text = "\n".join(f"line {k} of a short note" for k in range(8))
    rows = [(1, text, "en", "a", 3), (1, text, "en", "a", 3), (None, text, None, None, None), (2, None, "en", "b", 0), (3, "", "en", "b", 0), (4, text, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    rest = lines([(d, t) for d, t, *_ in rows if d in (1, 4)])[4]
    for some, want in ((docs, [None, 1, 2, 3] + [4] * bool(rest.strip())), (docs.limit(0), [])):
        out = some
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == docs.columns
        assert sorted((r.doc_id for r in out.collect()), key=lambda d: (d is not None, d)) == want
        assert P.STAGES[-1][1](spark, out, SF).count() == len(want)
