import itertools
import random
import re

import sql_twin
from pyspark.sql import functions as F

from engramlake.llm import structure_repair as S

GRAMMAR = re.compile(r"(s?(ua)+)?")


def brute(signature):
    """Least (cost, edits) by trying every string of edits, inserts included."""
    best = None
    n = len(signature)
    options = [""] + ["".join(x) for k in (1, 2, 3) for x in itertools.product("ua", repeat=k)]
    for own in itertools.product(("K", "Ru", "Ra", "D"), repeat=n):
        if any(c == "x" and o != "D" for c, o in zip(signature, own)):
            continue
        for gaps in itertools.product(options, repeat=n + 1):
            if sum(map(len, gaps)) > n + 2:
                continue
            roles, edits, cost = "", "", 0
            for k in range(n + 1):
                roles, edits, cost = roles + gaps[k], edits + "I" * len(gaps[k]), cost + 2 * len(gaps[k])
                if k == n:
                    break
                c, o = signature[k], own[k]
                edits += o[0]
                cost += {"K": 0, "R": 2, "D": 3}[o[0]]
                if o != "D":
                    roles += c.lower() if o == "K" else o[1]
                    cost += c.isupper()
            if GRAMMAR.fullmatch(roles) and (best is None or (cost, edits) < best):
                best = cost, edits
    return best


def answer(signature):
    trie = S.Trie()
    trie.insert([signature])
    cost, steps = trie.answers[signature]
    return cost, "".join(steps)


def test_every_short_signature_against_every_edit():
    for n in range(3):
        for signature in map("".join, itertools.product("xsuaoSUAO", repeat=n)):
            assert answer(signature) == brute(signature), signature
    rng = random.Random(5)
    for _ in range(6):
        signature = "".join(rng.choice("xsuaoUA") for _ in range(3))
        assert answer(signature) == brute(signature), signature


def by_strings(signature):
    """The same programme with whole strings and single edits, closed under inserts."""
    layer = {S.NONE: (0, "")}

    def close(layer):
        for _ in range(4):
            for q, (c, e) in list(layer.items()):
                to = S.NEXT[q][S._followed(q)]
                layer[to] = min(layer.get(to, (10**9, "")), (c + 2, e + "I"))
        return layer

    for letter in signature:
        new = {}
        for q, (c, e) in close(layer).items():
            moves = [(q, 3, "D")]
            if letter != "x":
                late = int(letter.isupper())
                moves.append((S.NEXT[q][S._followed(q)], 2 + late, "R"))
                if letter.lower() in S.NEXT[q]:
                    moves.append((S.NEXT[q][letter.lower()], late, "K"))
            for to, more, edit in moves:
                new[to] = min(new.get(to, (10**9, "")), (c + more, e + edit))
        layer = new
    closed = close(layer)
    return min(closed[q] for q in S.FINAL if q in closed)


def test_long_signatures_and_shared_prefixes():
    rng = random.Random(7)
    every = sorted({"".join(rng.choice("xsuaoSUAO") for _ in range(rng.randrange(40))) for _ in range(400)} | {"ua" * 3000, "ua" * 3000 + "s"})
    trie = S.Trie()
    trie.insert(every)
    trie.insert(every[10:20])
    for s in every:
        cost, steps = trie.answers[s]
        assert len(steps) == len(s) + 1
        assert (cost, "".join(steps)) == by_strings(s)
    # a layer for each distinct prefix, none twice
    assert len(trie.layers) == len({s[:k] for s in every for k in range(len(s) + 1)})


def test_against_sql(spark):
    for sf in ("sf0.001", "sf0.1"):
        sql_twin.same(S.query(spark, f"/root/testdata/{sf}"), S.ORACLE, f"/root/testdata/{sf}")


def test_damage_is_that_of_the_hash(spark):
    import zlib

    rows = [(c, t, "user", "a. b!") for c in (1, None) for t in [*range(60), None]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in df.withColumn("d", S.damaged()).collect():
        fault = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        own = [(x.turn, x.role, x.text) for x in r.d]
        assert own == {0: [], 1: [(r.turn, "user", "")], 2: [(r.turn, "user", "a b")], 3: [(r.turn, "user", "a. b!")] * 2}.get(fault, [(r.turn, "user", "a. b!")])


def test_edges(spark, monkeypatch):
    rows = [
        (1, 0, "system", "Be kind.", 1),
        (1, 2, "user", "Hi?", 1),
        (1, 2, "user", "Hi?", 1),
        (1, 5, "assistant", "cut off", 1),
        (2, None, None, None, 1),
        (2, 3, "user", " \n", 1),
        (3, 1, "assistant", "é" * 200000 + ".", 1),
        (None, 4, "tool", "x.", 1),
        (None, None, "user", "y.", 1),
        (5, 1, "user", "q?", 1),
        (5, 1, "assistant", "a!", 1),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, cost int")
    monkeypatch.setattr(S, "NODES", 1)
    out = {r.conv_id: r for r in S.repair(df).collect()}
    get = lambda k: (out[k].gaps, out[k].blank, out[k].duplicate, out[k].truncated, out[k].illegal, out[k].cost, out[k].audit)
    assert get(1) == (3, 0, 1, 1, 1, 4, "KKDK")
    assert [tuple(r) for r in out[1].repaired] == [("system", "Be kind."), ("user", "Hi?"), ("assistant", "cut off")]
    assert get(2) == (0, 2, 0, 0, 1, 6, "DD") and out[2].repaired == []
    assert get(3) == (0, 0, 0, 0, 0, 2, "IK") and out[3].repaired[0] == ("user", "") and len(out[3].repaired[1].text) == 200001
    assert get(None) == (0, 0, 0, 0, 1, 2, "KR")
    assert [tuple(r) for r in out[None].repaired] == [("user", "y."), ("assistant", "x.")]
    # ties of a turn go by role, then text: assistant before user
    assert get(5)[4:] == (0, 4, "IKKI")
    assert S.repair(df.limit(0)).count() == 0
    none = S.repair(df.limit(1), rows=F.array().cast(f"array<{S.ROW}>")).first()
    assert (none.gaps, none.cost, none.audit, none.repaired) == (0, 0, "", [])
