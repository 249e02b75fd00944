import hashlib
import re

import numpy as np
import pytest
import sql_twin
from pyspark.sql import functions as F

from engramlake.llm import fill_in_middle as M

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["", " ", "a", " a", "a ", "a b", "é ü\t\n x\x0b\x0cy \r", "  \n ", "日本 語\n" * 50, "x" * 300, " \x1c \x85 ", "a\x00 b"]


def plain(text, key, percent=50, spm=80):
    """The contract, word by word."""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [1, 2, 3, 7, 4096])
def test_every_rank_at_every_chunk_size(size):
    raw = [t.encode() for t in TEXTS]
    at = np.cumsum([0, *map(len, raw)])
    chunks = M.Chunks(np.frombuffer(b"".join(raw), dtype=np.uint8), at, size)
    for k, t in enumerate(TEXTS):
        tokens = TOKEN.findall(t)
        assert chunks.n[k] == len(tokens)
        for rank in range(len(tokens) + 1):
            head = "".join(tokens[:rank])
            assert chunks.place(k, rank) == (len(head.encode()), len(head))


def test_against_sql(spark):
    sql_twin.same(M.query(spark, "/root/testdata/sf0.001"), M.ORACLE, "/root/testdata/sf0.001")


def test_against_the_contract_and_round_trip(spark):
    texts = [*TEXTS, None, "has <P> in it", "ends in <", "<S", "S> x <M", "word " * 20000, "ü" * 100000 + " end"]
    rows = [(k, t, "was here", 7) for k in range(12) for t in texts] + [(None, "no key at all", "x", 0), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, h0 int")
    got = M.transform(df, percent=80, spm_percent=50).withColumn("back", M.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.back == (r.text or "")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.text or "", r.doc_id, 80, 50)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert {r.h0 for r in got} == {7, 0, None}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert M.transform(df).count() == 0
    assert M.transform(df).columns == ["doc_id", "text", *M.ADDED]
