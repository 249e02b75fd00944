"""Scans, predicates and text functions over documents, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.functions import text as T
from engramlake.operators import relational as R
from engramlake.plans.registry import query
from engramlake.sources.tables import FACTS_SQL, events, facts, table, validity

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
TOKENS_ALL_SQL = f"regexp_extract_all(lower(text), '{T.TOKEN}')"
POSITIVE, NEGATIVE = ("heat", "then", "reed"), ("thing", "rest", "ent")


@query(f"WITH {FACTS_SQL} SELECT fact_id, profile_id, scope FROM facts WHERE (scope = 'personal' AND profile_id = 'en') OR scope IN ('global', 'shared')")
def scope_filter(spark, sf):
    return facts(spark, sf).where(R.visible("en")).select("fact_id", "profile_id", "scope")


@query(f"WITH {FACTS_SQL} SELECT fact_id, session_id, confidence FROM facts WHERE fact_type = 'opinion' AND scope = 'personal' AND profile_id = 'fr'")
def type_scan(spark, sf):
    return facts(spark, sf).where((F.col("fact_type") == "opinion") & R.visible("fr", False, False)).select("fact_id", "session_id", "confidence")


@query(f"WITH {FACTS_SQL} SELECT fact_id, access_count FROM facts WHERE fact_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def id_list_lookup(spark, sf):
    ids = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("fact_id"))
    return R.lookup(facts(spark, sf).select("fact_id", "access_count"), ids, "fact_id")


@query(f"WITH {FACTS_SQL} SELECT fact_id, created_on FROM facts WHERE created_on BETWEEN DATE '2024-02-01' AND DATE '2024-03-15'")
def date_range_scan(spark, sf):
    return facts(spark, sf).where("created_on BETWEEN DATE'2024-02-01' AND DATE'2024-03-15'").select("fact_id", "created_on")


VALID_SQL = """validity AS (SELECT o_orderkey AS fact_id, o_orderdate AS valid_from, u AS valid_until
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS u FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


@query(f"WITH {VALID_SQL} SELECT fact_id FROM validity WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '1997-06-01') AND (valid_until IS NULL OR TIMESTAMP '1997-06-01' < valid_until)")
def valid_at(spark, sf):
    return R.valid_at(validity(spark, sf), "1997-06-01 00:00:00").select("fact_id")


@query("SELECT event_id, user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.value >= 100 AND d.event_type = 'error' AND d.user_id = e.user_id AND d.event_type = e.event_type)")
def deny_policies(spark, sf):
    e = events(spark, sf)
    return R.denied(e.select("event_id", "user_id", "event_type"), e.where("value >= 100 AND event_type = 'error'"), ["user_id", "event_type"])


@query(f"""WITH {FACTS_SQL}, z AS (SELECT fact_id, confidence AS score, CASE WHEN fact_id % 6 = 5 THEN NULL WHEN fact_id % 6 = 0 THEN 'active' WHEN fact_id % 6 = 1 THEN 'warm' WHEN fact_id % 6 = 2 THEN 'cold' ELSE 'archive' END AS zone FROM facts)
SELECT fact_id, round(score * CASE zone WHEN 'warm' THEN 0.7::DOUBLE WHEN 'cold' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM z WHERE zone IS NULL OR zone <> 'archive'""")
def forgetting_filter(spark, sf):
    f = facts(spark, sf)
    m = F.col("fact_id") % 6
    zones = f.where(m != 5).select("fact_id", F.when(m == 0, "active").when(m == 1, "warm").when(m == 2, "cold").otherwise("archive").alias("zone"))
    out = R.forget_filter(f.select("fact_id", F.col("confidence").alias("score")), zones, {"active": 1.0, "warm": 0.7, "cold": 0.3})
    return out.select("fact_id", F.round("score", 6).alias("score"))


@query(f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_filter(t, lambda x: x NOT IN ({STOP}))) AS BIGINT) AS n_tokens
FROM (SELECT doc_id, {WORDS_SQL} AS w, {TOKENS_ALL_SQL} AS t FROM documents)""")
def tokenize_stats(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"), F.size(T.tokenize(F.col("text"))).cast("long").alias("n_tokens"))


@query(r"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS longest FROM (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x, ' ' || chr(10) || chr(13) || chr(9))), lambda x: length(x) >= 8) AS s FROM documents)""")
def sentence_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"))


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(text), '{T.TEMPORAL_CUES}') THEN 'temporal' WHEN regexp_matches(lower(text), '{T.OPINION_CUES}') THEN 'opinion'
  WHEN regexp_matches(lower(text), '{T.EPISODIC_CUES}') THEN 'episodic' ELSE 'semantic' END AS kind FROM conversations WHERE text IS NOT NULL) GROUP BY kind""")
def sentence_kinds(spark, sf):
    c = table(spark, sf, "conversations").where("text IS NOT NULL")
    return c.groupBy(T.sentence_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query(r"""SELECT item_id, CASE WHEN regexp_matches(l, '\b(and|both|between)\b.*\b(and|with)\b') THEN 'multi_hop' WHEN regexp_matches(l, '\b(when|before|after|ago|date)\b') THEN 'temporal'
  WHEN regexp_matches(l, '\b(how many|count|all|every|list)\b') THEN 'aggregation' WHEN regexp_matches(l, '\b(think|opinion|feel|prefer)\b') THEN 'opinion' WHEN regexp_matches(l, '\b(who|whom|whose)\b') THEN 'entity'
  WHEN regexp_matches(l, '\b(what|which|where)\b') THEN 'factual' WHEN length(l) < 20 THEN 'vague' ELSE 'general' END AS kind FROM (SELECT item_id, lower(text) AS l FROM benchmark)""")
def query_strategy(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.query_kind(F.col("text")).alias("kind"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[a-z,;] ([A-Z][a-z]{2,})', 1))), ',') AS entities FROM documents""")
def entity_extract(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.entities(F.col("text")), ",").alias("entities"))


@query(rf"""WITH w AS (SELECT item_id, unnest({WORDS_SQL}) AS w FROM benchmark), g AS (SELECT item_id, substr(w, CAST(i AS INTEGER), 3) AS g FROM w, range(1, 60) r(i) WHERE i <= length(w) - 2)
SELECT b.item_id, count(DISTINCT g) AS n, coalesce(min(g), '') AS first FROM benchmark b LEFT JOIN g USING (item_id) GROUP BY b.item_id""")
def trigram_index(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", T.trigrams(F.col("text")).alias("g"))
    return b.select("item_id", F.size("g").cast("long").alias("n"), F.coalesce(F.get("g", F.lit(0)), F.lit("")).alias("first"))


def _redacted(c: str) -> str:
    for kind, pattern in T.PII:
        c = f"regexp_replace({c}, '{pattern}', '[REDACTED:{kind}]', 'g')"
    return c


@query(f"SELECT doc_id, md5({_redacted('text')}) AS redacted, array_to_string(list_filter([{', '.join(f'''CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END''' for k, p in T.PII)}], lambda x: x IS NOT NULL), ',') AS kinds FROM documents")
def pii_redact(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.redact_pii(F.col("text"))).alias("redacted"), F.array_join(T.pii_kinds(F.col("text")), ",").alias("kinds"))


@query(rf"""SELECT doc_id, md5(regexp_replace(text, '{T.SECRET}', '\1\2[SECRET]', 'g')) AS redacted FROM documents""")
def secret_redact(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.redact_secrets(F.col("text"))).alias("redacted"))


@query("""WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS c, length(text) AS n FROM benchmark), p AS (SELECT item_id, c, count(*) / CAST(max(n) AS DOUBLE) AS p FROM c GROUP BY item_id, c)
SELECT item_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY item_id""")
def shannon_entropy(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.round(T.entropy(F.col("text")), 6).alias("entropy"))


@query(f"""SELECT item_id, substr(sha256(array_to_string(list_sort(list_distinct(list_filter({TOKENS_ALL_SQL}, lambda x: x NOT IN ({STOP}) AND length(x) >= 5))), ' ')), 1, 16) AS signature FROM benchmark""")
def topic_signature(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.topic_signature(F.col("text")).alias("signature"))


@query("SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS answer FROM benchmark")
def answer_normaliser(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.normalise_answer(F.col("text")).alias("answer"))


@query(f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, CAST(len(list_filter(w, lambda x: x IN {POSITIVE})) AS DOUBLE) AS p, CAST(len(list_filter(w, lambda x: x IN {NEGATIVE})) AS DOUBLE) AS m FROM w)
SELECT doc_id, round(CASE WHEN p + m > 0 THEN (p - m) / (p + m) ELSE 0.0 END, 6) AS valence, round(CASE WHEN n > 0 THEN least(1.0, 2.0 * (p + m) / n) ELSE 0.0 END, 6) AS arousal FROM c""")
def emotion_tags(spark, sf):
    v, a = T.emotion(F.col("text"), POSITIVE, NEGATIVE)
    return table(spark, sf, "documents").select("doc_id", F.round(v, 6).alias("valence"), F.round(a, 6).alias("arousal"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) AS similarity FROM part a JOIN part b ON a.p_partkey < b.p_partkey
WHERE a.p_partkey % 20 = 0 AND jaro_winkler_similarity(a.p_name, b.p_name) >= 0.85""")
def fuzzy_names(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    left = p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"))
    right = p.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))
    # names repeat: the distinct names of the stated parts meet each distinct name once
    names = right.select("y").distinct().crossJoin(left.select("x").distinct())
    near = names.withColumn("similarity", T.jaro_winkler_udf()(F.col("x"), F.col("y"))).where("similarity >= 0.85").select("x", "y", F.round("similarity", 6).alias("similarity"))
    return left.join(near, "x").join(right, "y").where("a < b").select("a", "b", "similarity")


@query("""SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, string_agg(coalesce(role, ''), '>' ORDER BY turn) AS path FROM conversations GROUP BY conv_id""")
def session_paths(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role")))).alias("t"))
    return c.select("conv_id", F.size("t").cast("long").alias("turns"), F.array_join(F.transform("t", lambda x: x["role"]), ">").alias("path"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS BIGINT) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def page_links(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("SELECT event_type, CAST(max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS most, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50) AS high FROM events GROUP BY event_type")
def json_payloads(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf).groupBy("event_type").agg(F.max(k).alias("most"), F.count_if(k >= 50).alias("high"))
