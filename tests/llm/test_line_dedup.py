import hashlib
import random

import sql_twin

from engramlake.llm import line_dedup as L


def chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    out, cur = [], []
    for i, x in enumerate(lines):
        cur.append(x)
        r = (h[i] + L.BASE * (h[i - 1] if i else 0)) % L.MODULUS
        if r % L.DIVISOR == 0 or i == len(lines) - 1:
            out.append("\n".join(cur))
            cur = []
    return out


def brute(rows):
    seen, out = set(), {}
    for d, t in sorted((d, t) for d, t in rows if t is not None):
        kept = []
        for c in chunks(t):
            if "\n" in c and c.translate({10: None, 9: None, 13: None}).strip(" "):
                if c in seen:
                    continue
                seen.add(c)
            kept.append(c)
        out[d] = "\n".join(kept)
    return out


def test_against_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        sql_twin.same(L.query(spark, f"/root/testdata/{sf}"), L.ORACLE, f"/root/testdata/{sf}")


def test_against_brute_force_and_edges(spark):
    rng = random.Random(1)
    pool = [f"line {k} é" for k in range(40)] + ["", " ", "\t"]
    passage = [f"shared passage line {k}" for k in range(14)]
    rows = [(500, None), (501, ""), (502, "\n\n\n"), (503, "\n\n\n"), (504, "a" * 200_000 + "\nb")]
    for d in range(120):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 30))]
        if d % 4 == 0:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = passage
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, h int, content string")
    out = L.dedup_lines(df).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        assert (r.kept_text, r.h, r.content) == (want.get(r.doc_id), 1, "x")
        assert r.lines_removed == (0 if r.text is None else r.n_lines - sum(c.count("\n") + 1 for c in chunks(r.text)) + r.lines_removed)
    later = [r for r in out if r.doc_id is not None and 0 < r.doc_id < 120 and r.doc_id % 4 == 0]
    assert sum("line 6\nshared passage line 7" in r.kept_text for r in later) < len(later) / 2
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_repeated_and_keyless_rows(spark):
    text = "\n".join(f"some line {k}" for k in range(12))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    out = sorted((r.doc_id or -1, r.kept_text == text, r.lines_removed > 0) for r in L.dedup_lines(df).collect())
    assert out == [(-1, True, False), (1, True, False), (1, True, False), (2, False, True)]


def test_rows_of_one_id_and_clashing_names(spark):
    head, tail = (chr(10).join(f"{x} line {k}" for k in range(12)) for x in ("first", "second"))
    rows = [(1, head, 7), (1, head + chr(10) + tail, 8), (1, tail, 9), (2, tail, 9), (3, None, 9)]
    names = ["_lines", "_h", "_chunks", "_gone", "_k", "_d", "_t", "_r", "pos", "salt", "n_lines", "kept_text", "c0"]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int").selectExpr("doc_id", "text", "x", *[f"x as {n}" for n in names])
    out = L.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "x", *[n for n in names if n not in L.ADDED], *L.ADDED]
    got = out.collect()
    assert len(got) == 5 and all(r["_lines"] == r.x and r.c0 == r.x for r in got)
    # each chunk of two lines or more stays once
    for text in (head, tail):
        for c in {c for c in chunks(text) if chr(10) in c}:
            assert sum(c in chunks(r.kept_text or "") for r in got) == 1
    assert not [c for r in got if r.doc_id == 2 for c in chunks(r.kept_text) if chr(10) in c]
    assert out.select("x").collect() and L.dedup_lines(df).orderBy("doc_id", "x").select("kept_text").collect() == out.orderBy("doc_id", "x").select("kept_text").collect()


def test_hot_chunks_in_parts(spark, monkeypatch):
    from engramlake.llm import shared

    rng = random.Random(4)
    hot = chr(10).join(f"every one holds this {k}" for k in range(9))
    rows = [(d, chr(10).join(f"own {d} {rng.random()}" for _ in range(3)) + chr(10) + hot) for d in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(L, "SALT", 40)
    monkeypatch.setattr(shared, "HOT", 2)
    assert {r.doc_id: r.kept_text for r in L.dedup_lines(df).collect()} == brute(rows)


def test_only_native_nodes(spark):
    plan = L.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
