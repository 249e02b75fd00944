"""Rules over notes: what kind of text it is, what it says of dates, what is kept of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.functions import language as L
from engramlake.plans.registry import query
from engramlake.sources.tables import NOTE_DAY, NOTES, NOTES_SQL, notes

_MATCH = "regexp_matches(content, '(?i)\\b(?:{})\\b')"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _first(kinds, default):
    return "CASE " + " ".join(f"WHEN {_MATCH.format(_quoted(w))} THEN '{k}'" for k, w in kinds.items()) + f" ELSE '{default}' END"


@query(f"WITH {NOTES_SQL} SELECT note_id, {_first(L.TYPES, 'semantic')} AS fact_type FROM notes")
def keyword_type_router(spark, sf):
    return notes(spark, sf).select("note_id", L.first_kind(F.col("content"), L.TYPES, "semantic").alias("fact_type"))


@query(f"WITH {NOTES_SQL} SELECT note_id, {_first(L.SIGNALS, 'factual')} AS signal FROM notes")
def signal_inference(spark, sf):
    return notes(spark, sf).select("note_id", L.first_kind(F.col("content"), L.SIGNALS, "factual").alias("signal"))


_COUNT = "least(1.0::DOUBLE, len(regexp_extract_all(content, '(?i)\\b(?:{})\\b')) / 5.0::DOUBLE)"


@query(f"WITH {NOTES_SQL}, s AS (SELECT note_id, {', '.join(f'{_COUNT.format(w)} AS {k}' for k, w in L.SIGNALS.items())} FROM notes) SELECT *, round(1 - greatest({', '.join(L.SIGNALS)}), 6) AS factual FROM s")
def signal_scores(spark, sf):
    n = notes(spark, sf).select("note_id", *[L.signal_score(F.col("content"), k).alias(k) for k in L.SIGNALS])
    return n.withColumn("factual", F.round(1 - F.greatest(*L.SIGNALS), 6))


@query(f"WITH {NOTES_SQL} SELECT note_id, coalesce({', '.join(f'''nullif(regexp_extract(content, '(?i){_quoted(p)}', 0), '')''' for p in L.FORESIGHT)}) AS pattern FROM notes WHERE pattern IS NOT NULL")
def foresight_detector(spark, sf):
    return notes(spark, sf).select("note_id", L.foresight(F.col("content")).alias("pattern")).where("pattern is not null")


@query(f"WITH {NOTES_SQL} SELECT note_id FROM notes WHERE length(trim(content)) >= {L.SHORTEST_NOTE} AND trim(lower(trim(content)), '.,!?;:') NOT IN ({', '.join(repr(w) for w in L.LOW_INFO)})")
def entropy_gate_rules(spark, sf):
    return notes(spark, sf).where(L.informative(F.col("content"))).select("note_id")


@query(f"WITH {NOTES_SQL} SELECT note_id, {' OR '.join(f'''starts_with(lower(trim(content)), '{w}')''' for w in L.FILLERS)} AS filler FROM notes")
def filler_filter(spark, sf):
    return notes(spark, sf).select("note_id", L.filler(F.col("content")).alias("filler"))


_APART = " OR ".join(f"(contains(lower(a.content), '{w}') <> contains(lower(b.content), '{w}'))" for w in L.NEGATIONS)


@query(f"WITH {NOTES_SQL} SELECT a.note_id, b.note_id AS other_id FROM notes a JOIN notes b ON a.user_id = b.user_id AND b.note_id = a.note_id + 16 WHERE {_APART.replace('b.content', 'b.other')}".replace("JOIN notes b", "JOIN (SELECT note_id, user_id, content, CASE WHEN note_id % 3 = 0 THEN content || ' no more' ELSE content END AS other FROM notes) b"))
def contradiction_heuristic(spark, sf):
    """A note against the user's note of 16 ids later, which repeats it, at times negated."""
    n = notes(spark, sf).select("note_id", "user_id", "content")
    b = n.select((F.col("note_id") - 16).alias("note_id"), "user_id", F.col("note_id").alias("other_id"), F.when(F.col("note_id") % 3 == 0, F.concat("content", F.lit(" no more"))).otherwise(F.col("content")).alias("other"))
    return n.join(b, ["note_id", "user_id"]).where(L.negated_apart(F.col("content"), F.col("other"))).select("note_id", "other_id")


_NAME = "CASE event_id % 8 WHEN 0 THEN 'Acme Inc' WHEN 1 THEN 'Oak Street' WHEN 2 THEN 'Data Summit' WHEN 3 THEN 'core:plan' WHEN 4 THEN 'Ann Lee' WHEN 5 THEN 'v1.2' WHEN 6 THEN 'NASA' ELSE 'a build agent' END"


@query(f"""WITH n AS (SELECT event_id, {_NAME} AS name FROM events) SELECT event_id, CASE WHEN length(name) <= 2 OR regexp_matches(name, '^[\\d.v/-]+$') THEN 'concept'
  WHEN regexp_matches(name, '{"|".join(L.ORGANISATIONS)}') THEN 'organization' WHEN regexp_matches(name, '{"|".join(L.PLACES)}') THEN 'place' WHEN regexp_matches(name, '{"|".join(L.OCCASIONS)}') THEN 'event'
  WHEN regexp_matches(name, '^[\\w-]+:[\\w-]+$') OR regexp_matches(name, '(?i)\\b(?:skill|command|agent|plugin|hook|mcp)\\b') THEN 'skill' WHEN regexp_matches(name, '^[A-Z][a-z]+ [A-Z][a-z]+( [A-Z][a-z]+)?$') THEN 'person' ELSE 'concept' END AS kind FROM n""")
def entity_type_guess(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.expr(_NAME).alias("name"))
    return e.select("event_id", L.entity_type(F.col("name")).alias("kind"))


_HITS = {k: " + ".join(f"CAST(regexp_matches(content, '(?i)\\b(?:{w})\\b') AS INTEGER)" for w in words) for k, words in L.ACTIVITIES.items()}


@query(f"WITH {NOTES_SQL}, h AS (SELECT note_id, {', '.join(f'{h} AS {k}' for k, h in _HITS.items())} FROM notes), b AS (SELECT *, greatest({', '.join(L.ACTIVITIES)}) AS best FROM h) SELECT note_id, CASE WHEN best = 0 THEN 'unknown' {' '.join(f'''WHEN {k} = best THEN '{k}' ''' for k in L.ACTIVITIES)} END AS activity FROM b")
def activity_classifier(spark, sf):
    return notes(spark, sf).select("note_id", L.activity(F.col("content")).alias("activity"))


_KEYS = "content"
for _kind, _pattern in L.KEYS:
    _KEYS = f"regexp_replace({_KEYS}, '{_pattern}', '[REDACTED:{_kind}:\\1]', 'g')"


@query(f"WITH {NOTES_SQL} SELECT note_id, {_KEYS} AS redacted FROM notes")
def key_redaction(spark, sf):
    return notes(spark, sf).select("note_id", L.redact_keys(F.col("content")).alias("redacted"))


@query(f"""WITH {NOTES_SQL}, n AS (SELECT note_id, CASE WHEN note_id % 2 = 0 THEN 'Ann' END AS name, content FROM notes)
SELECT note_id, CASE WHEN name IS NULL THEN content ELSE regexp_replace(regexp_replace(regexp_replace(content, '\\bI\\b', name, 'g'), '\\bmy\\b', name || '''s', 'g'), '\\bme\\b', name, 'g') END AS content FROM n""")
def first_person_rewrite(spark, sf):
    said = F.when(F.col("note_id") % 2 == 0, F.concat(F.lit("[Ann]: "), "content")).otherwise(F.col("content"))
    return notes(spark, sf).select("note_id", L.in_first_person(said).alias("content"))


_MONTHS = "{" + ", ".join(f"'{m}': '{k + 1:02d}'" for k, m in enumerate(L.MONTHS)) + "}"


@query(f"""WITH {NOTES_SQL}, d AS (SELECT note_id, unnest(list_transform(regexp_extract_all(content, '{L.ISO_DATE}'), lambda x: TRY_CAST(x AS DATE))) AS day FROM notes
  UNION SELECT note_id, TRY_CAST(concat_ws('-', regexp_extract(content, '{L.DAY_MONTH}', 3), CASE lower(regexp_extract(content, '{L.DAY_MONTH}', 2)) {' '.join(f"WHEN '{m}' THEN '{k + 1:02d}'" for k, m in enumerate(L.MONTHS))} END, lpad(regexp_extract(content, '{L.DAY_MONTH}', 1), 2, '0')) AS DATE) FROM notes)
SELECT note_id, day FROM d WHERE day IS NOT NULL""")
def date_extraction(spark, sf):
    return notes(spark, sf).select("note_id", F.explode(L.dates(F.col("content"))).alias("day"))


@query(f"""WITH {NOTES_SQL}, i AS (SELECT note_id, regexp_extract(content, '(?i)\\b(?:from|between) ([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}) (?:to|and) ([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\\b', ['a', 'b']) AS x FROM notes)
SELECT note_id, TRY_CAST(x.a AS DATE) AS first, TRY_CAST(x.b AS DATE) AS last FROM i WHERE x.a <> ''""")
def interval_extraction(spark, sf):
    return notes(spark, sf).select("note_id", L.interval(F.col("content")).alias("i")).where("i is not null").select("note_id", "i.*")


@query(f"""WITH {NOTES_SQL} SELECT note_id, CASE WHEN regexp_matches(content, '(?i)\\byesterday\\b') THEN DATE '{NOTE_DAY}' - 1 WHEN regexp_matches(content, '(?i)\\btomorrow\\b') THEN DATE '{NOTE_DAY}' + 1
  WHEN regexp_matches(content, '(?i)\\b3 weeks ago\\b') THEN DATE '{NOTE_DAY}' - 21 WHEN regexp_matches(content, '(?i)\\bin 2 days\\b') THEN DATE '{NOTE_DAY}' + 2 WHEN regexp_matches(content, '(?i)\\bnext month\\b') THEN CAST(DATE '{NOTE_DAY}' + INTERVAL 1 MONTH AS DATE) END AS day FROM notes""")
def relative_dates(spark, sf):
    return notes(spark, sf).select("note_id", L.relative_day(F.col("content"), F.lit(NOTE_DAY).cast("date")).alias("day"))


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_orderdate + to_days(CAST(o_custkey % 9 AS INTEGER)) WHEN 1 THEN o_orderdate + to_days(CAST(7 * (o_custkey % 9) AS INTEGER)) WHEN 2 THEN o_orderdate + to_months(CAST(o_custkey % 9 AS INTEGER)) ELSE o_orderdate + to_months(CAST(12 * (o_custkey % 9) AS INTEGER)) END AS DATE) AS day FROM orders""")
def unit_delta(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("day", "week", "month", "year")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", L.unit_shift(F.to_date("o_orderdate"), (F.col("o_custkey") % 9).cast("int"), unit).alias("day"))


_FORMATS = ("%Y-%m-%d", "%d %B, %Y", "%B %d, %Y", "%I:%M %p on %d %B, %Y")
_WRITTEN = ["strftime(o_orderdate, '%Y-%m-%d')", "strftime(o_orderdate, '%d %B, %Y')", "strftime(o_orderdate, '%B %d, %Y')", "'1:56 pm on ' || strftime(o_orderdate, '%d %B, %Y')"]


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 3 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 13 HOUR + INTERVAL 56 MINUTE ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS at FROM orders""")
def session_date_parse(spark, sf):
    day = F.col("o_orderdate")
    forms = [F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd MMMM, yyyy"), F.date_format(day, "MMMM dd, yyyy"), F.concat(F.lit("1:56 pm on "), F.date_format(day, "dd MMMM, yyyy")), F.lit("soon")]
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("raw"))
    return o.select("o_orderkey", L.session_date(F.col("raw")).cast("timestamp_ntz").alias("at"))


@query(f"""WITH {NOTES_SQL} SELECT user_id, count(*) AS n, min(note_id) AS first FROM notes WHERE regexp_matches(content, '(?i)\\b(?:{L.CAUSAL})\\b') GROUP BY user_id""")
def causal_cues(spark, sf):
    return notes(spark, sf).where(F.col("content").rlike(L.whole(L.CAUSAL))).groupBy("user_id").agg(F.count("*").alias("n"), F.min("note_id").alias("first"))


@query(f"""WITH {NOTES_SQL}, c AS (SELECT note_id, user_id FROM notes WHERE regexp_matches(content, '(?i)\\b(?:{L.CAUSAL})\\b')),
p AS (SELECT c.note_id AS dst, n.note_id AS src, row_number() OVER (PARTITION BY c.note_id ORDER BY n.note_id DESC) AS k FROM c JOIN notes n ON n.user_id = c.user_id AND n.note_id < c.note_id AND n.note_id >= c.note_id - 200)
SELECT src, dst, 0.8::DOUBLE AS weight FROM p WHERE k <= 20""")
def causal_edges(spark, sf):
    """From the twenty notes of the same user before a note with a causal cue (within 200 ids) to it."""
    from engramlake.operators import store as S

    n = notes(spark, sf).select("note_id", "user_id", F.col("content").rlike(L.whole(L.CAUSAL)).alias("cue"))
    return S.causal_edges(n, "user_id", "note_id", "cue", reach=200, most=20)


@query(f"WITH {NOTES_SQL} SELECT note_id, CAST(user_id AS BIGINT) AS key, CAST(length(content) + 16 AS BIGINT) AS n FROM notes")
def zero_width_watermark(spark, sf):
    n = notes(spark, sf).select("note_id", L.watermark(F.col("content"), F.col("user_id")).alias("w"))
    return n.select("note_id", L.read_watermark(F.col("w")).alias("key"), F.length("w").cast("long").alias("n"))


@query("""SELECT item_id, array_to_string(list_transform(regexp_extract_all(substr(text, 1, 500), '[A-Za-z0-9_]+'), lambda w: '"' || w || '"'), ' ') AS q FROM benchmark""")
def fts_sanitiser(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", L.fts_query(F.col("text")).alias("q"))


@query("""SELECT event_id, CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(ts) BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS bucket FROM events""")
def bandit_hours(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", L.part_of_day(F.hour("ts")).alias("bucket"))


@query("""SELECT event_id, concat_ws('|', CASE event_id % 5 WHEN 0 THEN 'single_hop' WHEN 1 THEN 'multi_hop' WHEN 2 THEN 'temporal' ELSE 'open_domain' END, CASE WHEN user_id % 5 = 0 THEN '0' WHEN user_id % 5 <= 2 THEN '1-2' ELSE '3+' END,
  CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(ts) BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END) AS stratum FROM events""")
def bandit_strata(spark, sf):
    kind = F.when(F.col("event_id") % 5 == 0, "single_hop").when(F.col("event_id") % 5 == 1, "multi_hop").when(F.col("event_id") % 5 == 2, "temporal").when(F.col("event_id") % 5 == 3, "odd")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", L.stratum(kind, F.col("user_id") % 5, F.hour("ts")).alias("stratum"))


@query("SELECT doc_id, substr(sha256(text), 1, 32) AS content_hash, count(*) OVER (PARTITION BY sha256(text)) > 1 AS repeated FROM documents WHERE text IS NOT NULL")
def content_hashes(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select("doc_id", F.substring(F.sha2("text", 256), 1, 32).alias("content_hash"))
    n = d.groupBy("content_hash").agg((F.count("*") > 1).alias("repeated"))
    return d.join(n, "content_hash").select("doc_id", "content_hash", "repeated")
