"""Operator 12: conversation structure repair by dynamic programming over a trie.

A conversation is repaired when the initials of its roles read
``(s?(ua)+)?``.  Each row is kept (0), given another role (2), or deleted (3);
rows of a user or assistant without text are inserted (2); blank and duplicate
rows must go, and a truncated row that stays adds 1.  The cheapest edits are
wanted, and of those the ASCII-least string of their initials K, R, D, I.

What matters of a row is its role's initial and its fault, one letter of a
signature.  The conversations of a batch are inserted into a prefix trie in
order of their signatures.  A trie node holds one layer of the programme: for
each of four states (nothing yet, after s, after u, after a) the least cost, the
rank of the least edit string among the states', and a pointer to the layer
above.  So a prefix that conversations share is computed once, and an answer is
read off at the node where a signature ends.  Ranks suffice to compare edit
strings: all of a layer's end in an edit of its row, so none begins another.

One shuffle, on the conversation key.  A worker keeps its trie between batches,
up to ``NODES`` nodes.  A conversation is one row, as its repaired form is one
value, so it must fit in memory by definition.

Defined results: a null role or text is one space (so a row without text is
blank); rows are ordered by turn (nulls first), then role and text, so ties and
repeated rows have one result; a null key is a conversation of its own; roles
count by their first letter; a conversation without rows needs no edit; an empty
table gives no conversations; columns beside those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.llm.shared import arrow_map, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: the initials that may follow, and where each leads.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FINAL = (NONE, ASSISTANT)
NODES = 200_000
_BLANK = " \t\n\x0b\x0c\r"
ROW = "struct<turn:long,role:string,text:string>"
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def _followed(state: int) -> str:
    """The only one of u and a that may follow a state."""
    return "a" if state == USER else "u"


def _steps() -> dict[str, list[tuple[int, int, int, str]]]:
    """For each letter of a signature: (state before, state after, cost, edits).

    A row is dealt with by inserts, as many as help, and one edit of its own;
    deleting first and inserting later is never worse.
    """
    out = {}
    for letter in "xsuaoSUAO":
        late = TRUNCATED if letter.isupper() else 0
        found = [(q, q, DELETE, "D") for q in range(4)]
        for q in range(4) if letter != "x" else ():
            state, cost, edits = q, 0, ""
            for _ in range(3):
                if (to := NEXT[state].get(letter.lower())) is not None:
                    found.append((q, to, cost + KEEP + late, edits + "K"))
                found.append((q, NEXT[state][_followed(state)], cost + REROLE + late, edits + "R"))
                state, cost, edits = NEXT[state][_followed(state)], cost + INSERT, edits + "I"
        out[letter] = found
    return out


STEPS = _steps()
#: For each state: cost and inserts that complete it.
CLOSING = {NONE: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


class Trie:
    """Layers of the programme, one for each distinct prefix of the signatures seen."""

    def __init__(self):
        # a layer: for each state None or (cost, rank, state above, edits of the row)
        self.layers: list[list] = [[(0, 0, 0, ""), None, None, None]]
        self.above, self.children, self.answers = [0], [{}], {}

    def _layer(self, above: list, letter: str) -> list:
        best: list = [None] * 4
        for q, to, cost, edits in STEPS[letter]:
            if (p := above[q]) is not None:
                found = (p[0] + cost, p[1], edits, q)
                if best[to] is None or found < best[to]:
                    best[to] = found
        order = sorted((b[1], b[2], k) for k, b in enumerate(best) if b is not None)
        rank = {k: r for r, (_, _, k) in enumerate(order)}
        return [b and (b[0], rank[k], b[3], b[2]) for k, b in enumerate(best)]

    def insert(self, signatures: list[str]) -> None:
        """Inserts signatures that are sorted; what a signature shares with the one before isn't walked again."""
        path, last = [0], ""
        for signature in signatures:
            k, most = 0, min(len(last), len(signature))
            while k < most and last[k] == signature[k]:
                k += 1
            del path[k + 1 :]
            for letter in signature[k:]:
                node = path[-1]
                if (child := self.children[node].get(letter)) is None:
                    child = self.children[node][letter] = len(self.layers)
                    self.layers.append(self._layer(self.layers[node], letter))
                    self.above.append(node)
                    self.children.append({})
                path.append(child)
            last = signature
            if signature not in self.answers:
                self.answers[signature] = self._answer(path[-1])

    def _answer(self, node: int) -> tuple[int, list[str]]:
        """The least cost, and the edits of each row with those behind the last."""
        layer = self.layers[node]
        cost, _, ending, state = min((s[0] + CLOSING[q][0], s[1], CLOSING[q][1], q) for q, s in enumerate(layer) if s is not None)
        steps = [ending]
        while node:
            _, _, q, edits = self.layers[node][state]
            steps.append(edits)
            node, state = self.above[node], q
        return cost, steps[::-1]


def faults(rows: list[tuple[str, str]]) -> tuple[str, int, int, int]:
    """Signature, and how many rows are blank, duplicate and truncated, of (role, text) in order."""
    seen, letters, blank, duplicate, truncated = set(), [], 0, 0, 0
    for role, text in rows:
        bare = text.strip(_BLANK)
        again = (role, text) in seen
        seen.add((role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not bare:
            blank += 1
            letters.append("x")
        elif again:
            duplicate += 1
            letters.append("x")
        elif bare[-1] not in ".!?":
            truncated += 1
            letters.append(initial.upper())
        else:
            letters.append(initial)
    return "".join(letters), blank, duplicate, truncated


def apply(rows: list[tuple[str, str]], steps: list[str]) -> list[tuple[str, str]]:
    """The repaired rows."""
    out, state = [], NONE
    names = {"u": "user", "a": "assistant"}
    for k, edits in enumerate(steps):
        for e in edits:
            if e == "D":
                continue
            role, text = rows[k] if k < len(rows) else ("", "")
            if e == "I":
                role, text = names[_followed(state)], ""
            elif e == "R":
                role = names[_followed(state)]
            state = NEXT[state][role[:1]]
            out.append((role, text))
    return out


def gather(df: DataFrame, rows: Column, conv: str = "conv_id") -> DataFrame:
    """(conv_id, rows) in order; ``rows`` is an array of ``ROW`` of each row of ``df``,
    so that a row may stand for none or for several."""
    return df.groupBy(F.col(f"`{conv}`").alias("conv_id")).agg(F.sort_array(F.flatten(F.collect_list(rows.cast(f"array<{ROW}>")))).alias("rows"))


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rows: Column | None = None) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost,
    audit and ``repaired`` (array of struct<role, text>)."""
    filled = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(" "))
    own = F.array(F.struct(F.col(f"`{turn}`").alias("turn"), filled(role).alias("role"), filled(text).alias("text"))) if rows is None else rows
    grouped = gather(df, own, conv)
    turns = F.array_distinct(F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull()))
    gaps = F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(turns), F.lit(0)).cast("long")
    schema = T.StructType(
        [grouped.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], T.StructField("audit", T.StringType()), T.StructField("repaired", TURNS)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows = [list(zip(a, b)) for a, b in zip(roles, texts)]
            found = [faults(x) for x in rows]
            if len(trie.layers) > NODES:
                trie = Trie()
            trie.insert(sorted({f[0] for f in found}))
            answers = [trie.answers[f[0]] for f in found]
            illegal = [sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(x, x[1:])) for x in rows]
            done = [[{"role": a, "text": b} for a, b in apply(x, s)] for x, (_, s) in zip(rows, answers)]
            numbers = [[f[1] for f in found], [f[2] for f in found], [f[3] for f in found], illegal, [c for c, _ in answers]]
            columns = [batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in numbers], pa.array(["".join(s) for _, s in answers], pa.string())]
            columns.append(pa.array(done, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return arrow_map(grouped.select("conv_id", gaps.alias("gaps"), F.transform("rows", lambda r: r["role"]).alias("roles"), F.transform("rows", lambda r: r["text"]).alias("texts")), run, schema)


def damaged() -> Column:
    """The rows that a row of ``conversations`` becomes by the hash of its key and turn: array of ``ROW``."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(filled("role"))
    row = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return F.when(fault == 0, F.array().cast(f"array<{ROW}>")).when(fault == 3, F.array(row, row)).otherwise(F.array(row))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repair(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), rows=damaged())
    joined = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return done.withColumn("repaired_sha256", F.sha2(joined, 256)).drop("repaired")


# The SQL has the hash by its table, and the programme as a string for each state: the cost in nine digits, a space, the edits.
_AT = {NONE: "q0", SYSTEM: "q1", USER: "q2", ASSISTANT: "q3"}


def _sql_state(to: int) -> str:
    parts = []
    for letter in "xsuaoSUAO":
        # COALESCE so that an unreachable state, written ~, stays one
        options = [f"CASE WHEN {_AT[q]} = '~' THEN '~' ELSE printf('%09d', CAST({_AT[q]}[1:9] AS INTEGER) + {cost}) || {_AT[q]}[10:] || '{edits}' END" for q, t, cost, edits in STEPS[letter] if t == to]
        parts.append(f"WHEN '{letter}' THEN " + (f"least({', '.join(options)})" if options else "'~'"))
    return f"CASE signature[i + 1] {' '.join(parts)} END"


ORACLE = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)
), plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations
), keyed AS (
  SELECT plain.*, xor(4294967295, list_reduce(list_transform(range(1, octet_length(k) + 1), lambda j: CAST(ascii(decode(k)[j]) AS BIGINT)),
    lambda c, b: xor(t[CAST(xor(c, b) % 256 AS BIGINT) + 1], c // 256), 4294967295)) % 20 AS fault FROM plain, crc_table
), rows_after AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, (SELECT unnest([1, 2]) AS copy) WHERE fault <> 0 AND (copy = 1 OR fault = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows_after
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), lettered AS (
  SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS own,
    CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS what
  FROM marked
), convs AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (what = 'blank') AS blank,
    count(*) FILTER (what = 'duplicate') AS duplicate, count(*) FILTER (what = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    string_agg(CASE WHEN what IN ('blank', 'duplicate') THEN 'x' WHEN what = 'truncated' THEN upper(own) ELSE own END, '' ORDER BY i) AS signature,
    list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts
  FROM lettered GROUP BY conv_id
), dp AS (
  SELECT DISTINCT signature, 0 AS i, '000000000 ' AS q0, '~' AS q1, '~' AS q2, '~' AS q3 FROM convs
  UNION ALL
  SELECT signature, i + 1, {_sql_state(0)}, {_sql_state(1)}, {_sql_state(2)}, {_sql_state(3)} FROM dp WHERE i < length(signature)
), ended AS (
  SELECT signature, least(q0, q3,
    CASE WHEN q1 = '~' THEN '~' ELSE printf('%09d', CAST(q1[1:9] AS INTEGER) + 4) || q1[10:] || 'II' END,
    CASE WHEN q2 = '~' THEN '~' ELSE printf('%09d', CAST(q2[1:9] AS INTEGER) + 2) || q2[10:] || 'I' END) AS best
  FROM dp WHERE i = length(signature)
), answered AS (
  SELECT convs.*, CAST(best[1:9] AS BIGINT) AS cost, best[11:] AS audit FROM convs JOIN ended USING (signature)
), built AS (
  SELECT conv_id, audit, roles, texts, 0 AS j, 0 AS r, '' AS state, CAST([] AS VARCHAR[]) AS made FROM answered
  UNION ALL
  SELECT conv_id, audit, roles, texts, j + 1, CASE WHEN audit[j + 1] = 'I' THEN r ELSE r + 1 END,
    CASE audit[j + 1] WHEN 'D' THEN state WHEN 'K' THEN roles[r + 1][1:1] ELSE CASE state WHEN 'u' THEN 'a' ELSE 'u' END END,
    CASE WHEN audit[j + 1] = 'D' THEN made ELSE list_append(made,
      CASE WHEN audit[j + 1] = 'K' THEN roles[r + 1] WHEN state = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN audit[j + 1] = 'I' THEN '' ELSE texts[r + 1] END) END
  FROM built WHERE j < length(audit)
), repaired AS (
  SELECT conv_id, array_to_string(made, chr(10)) AS whole FROM built WHERE j = length(audit)
), every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM every LEFT JOIN answered ON every.conv_id IS NOT DISTINCT FROM answered.conv_id LEFT JOIN repaired ON every.conv_id IS NOT DISTINCT FROM repaired.conv_id
"""
