import random

from hypothesis import given, settings
from hypothesis import strategies as st

from engramlake.llm import license_scan as L

words = st.lists(st.sampled_from("abcdefg"), max_size=14)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_alignment_is_a_common_subsequence(a, b):
    got = L.align(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert len(got) <= lcs(a, b)
    if a == b:
        assert len(got) == len(a)


@settings(max_examples=200, deadline=None)
@given(st.permutations(range(9)))
def test_increasing_is_longest(p):
    got = [p[k] for k in L.increasing(list(p))]
    assert got == sorted(set(got)) and len(got) == lcs(list(p), sorted(p))


def test_templates_are_found_in_noise():
    rng = random.Random(2)
    noise = lambda n: " ".join(rng.choice("the of and to software copy license in with or any under code version".split()) for _ in range(n))
    for name, template in L.TEMPLATES.items():
        # few words of a short notice may change; of long ones every tenth does
        changed = template.split()
        if len(changed) > 12:
            for k in range(4, len(changed), 12):
                changed[k] = "zzz"
        text = noise(300) + "\n" + " ".join(changed).upper() + "\n" + noise(500)
        got = L.findings(text)
        assert any(f[0].split("-")[0] == name.split("-")[0] for f in got), (name, got)
        a = 0 if not got else min(abs(f[2] - text.index(changed[0].upper())) for f in got)
        assert a < 400
    assert L.findings(noise(3000)) == [] or all(f[1] < 1 for f in L.findings(noise(3000)))


def test_several_findings_and_edges(spark):
    text = "é Released under the MIT License. Some words here. Licensed under the Apache License, Version 2.0. end"
    got = L.findings(text)
    assert [(f[0], text[f[2] : f[3]]) for f in got] == [("MIT-notice", "Released under the MIT License"), ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0")]
    rows = [(1, None), (2, ""), (3, " . "), (4, text), (4, text), (None, text)]
    df = spark.createDataFrame(rows, "licenses long, text string")
    out = L.scan(df.withColumnRenamed("licenses", "t")).collect()
    assert sorted(len(r.licenses) for r in out) == [0, 0, 0, 2, 2, 2]
    assert L.scan(df.limit(0)).count() == 0


def test_filter_loses_nothing_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.spans for r in L.query(spark, sf).collect()}
    hits = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ws = [w.lower() for w in L._WORD.findall(r.text or "")]
        if len(ws) > 1500:
            continue
        for name, t in L._PLAIN.items():
            m = L.best_match(t, ws)
            if m and m[0] >= L.COVERAGE:
                hits += 1
                assert got[r.doc_id], (r.doc_id, name)
    assert hits > 0


def test_copies_close_together():
    notice = "All rights reserved."
    text = "some words before " * 4 + f"{notice} {notice} " + "and many other words after that " * 6
    found = [text[a:b] for _, _, a, b in L.findings(text)]
    assert [f.lower().rstrip(".") for f in found] == ["all rights reserved"] * 2


def test_long_texts_in_blocks():
    rng = random.Random(6)
    noise = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    # repeated notices, and whole licenses wherever blocks end
    assert len(L.findings("All rights reserved. " * 3000)) == 3000
    reach = max(len(t) for t in L._PLAIN.values()) * 3 // 2 + 10
    for before in range(L.BLOCKS * reach - 320, L.BLOCKS * reach + 30, 35):
        text = noise(before) + " " + L.TEMPLATES["MIT"] + " " + noise(200) + " " + L.TEMPLATES["MIT-notice"] + " " + noise(3 * reach)
        assert [f[0] for f in L.findings(text)] == ["MIT", "MIT-notice"], before
