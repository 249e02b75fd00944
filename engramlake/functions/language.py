"""Rules over short English notes: kinds, signals, gates, dates.  Column in, Column out.

Patterns are those that RE2 and Java read alike.  Null texts give null, unless
said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramlake.functions.text import java

# Results are only comparable with these very words and numbers.
SIGNALS = {
    "request": r"please|could you|would you|can you|help|need|want|looking for|searching|find|tell me|show me|remind me|remember",
    "social": r"friend|family|colleague|partner|boss|team|relationship|together|married|dating|met with|call|message|email|chat",
    "temporal": r"when|date|time|schedule|deadline|tomorrow|yesterday|last week|next month|ago|soon|later|earlier|january|february|march|april|may|june|july|august|september|october|november|december|monday|tuesday|wednesday|thursday|friday|saturday|sunday",
    "emotional": r"happy|sad|angry|frustrated|excited|worried|anxious|love|hate|afraid|grateful|disappointed|thrilled|upset|feeling|emotion|mood",
    "opinion": r"think|believe|prefer|opinion|recommend|suggest|should|better|worse|best|worst|favorite|in my view|personally|i feel|i guess",
}
TYPES = {
    "opinion": r"think|believe|feel|prefer|like|love|hate|dislike|enjoy|opinion|seems?|probably|maybe|might|could be|i guess|personally|in my view|i'd say",
    "temporal": r"scheduled|deadline|appointment|planned|tomorrow|next week|next month|upcoming|due date|starts?|ends?|will happen|going to|plan to",
    "episodic": r"went|visited|traveled|attended|met|saw|did|happened|occurred|took place|experienced",
}
FORESIGHT = (
    r"\bplan(?:ning|s|ned)?\s+to\b", r"\bgoing\s+to\b", r"\b(?:will|shall)\s+\w+", r"\bschedul(?:e|ed|ing)\b", r"\b(?:appointment|reservation|booking)\b", r"\b(?:remind(?:er)?|don't forget)\b",
    r"\b(?:taking|starting|beginning)\s+\w+\s+(?:next|tomorrow|soon)\b", r"\b(?:deadline|due date|due by)\b", r"\bnext\s+(?:week|month|year|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
)
CAUSAL = r"because of|as a result|resulted in|in order to|so that|caused by|due to|led to|therefore|consequently|because"
LOW_INFO = ("ok", "okay", "yes", "no", "yeah", "sure", "thanks", "thank you", "got it", "right", "hmm", "hm", "ah", "i see", "alright", "fine", "cool", "nice", "great")
SHORTEST_NOTE = 10
FILLERS = ("good to see", "nice to", "hello", "hi ", "hey ", "how are you", "thanks", "thank you", "bye", "goodbye", "see you", "take care", "sure thing", "no problem", "okay")
NEGATIONS = ("not", "no longer", "never", "stopped", "quit", "left", "changed", "moved", "divorced", "fired", "resigned", "broke up", "ended", "cancelled", "dropped", "switched", "former", "ex-", "previously", "used to", "no more")
VALENCE_GAP = 1.2
ORGANISATIONS = ("Inc", "Corp", "LLC", "Ltd", "University", "Hospital", "Bank", "Foundation", "Institute", "Company", "Group", "Agency")
PLACES = ("City", "State", "County", "Island", "River", "Mountain", "Lake", "Park", "Street", "Avenue", "Road", "District")
OCCASIONS = ("Festival", "Conference", "Summit", "Workshop", "Meeting", "Election", "War", "Match", "Game", "Concert", "Wedding")
ACTIVITIES = {
    "docs": ("documentation", "readme", "wiki", "spec", "prd", "design doc", "changelog", "api doc"),
    "architecture": ("architecture", "diagram", "system design", "schema", "api design", "data model", "erd"),
    "code": ("implement", "function", "class", "module", "refactor", "code", "feature", "component"),
    "test": ("test", "pytest", "jest", "coverage", "assertion", "mock", "spec", "unit test"),
    "debug": ("bug", "fix", "error", "stack trace", "debug", "issue", "exception", "traceback"),
    "deploy": ("deploy", "docker", "ci/cd", "pipeline", "release", "production", "staging", "build"),
    "config": ("config", "env", "settings", "setup", "install", "dependency", "package", "requirements"),
}
FEEDBACK = {"recall_hit": 0.7, "recall_miss": 0.0, "user_positive": 1.0, "user_negative": 0.0, "user_correction": 0.2, "access_pattern": 0.6}
KEYS = (
    ("ANTHROPIC", r"sk-ant-[A-Za-z0-9_-]{16,}([A-Za-z0-9_-]{4})"), ("OPENAI", r"sk-[A-Za-z0-9_-]{16,}([A-Za-z0-9_-]{4})"), ("GITHUB", r"ghp_[A-Za-z0-9]{26,}([A-Za-z0-9]{4})"),
    ("AWS", r"AKIA[A-Z0-9]{12}([A-Z0-9]{4})"), ("SLACK", r"xoxb-[A-Za-z0-9-]{6,}([A-Za-z0-9-]{4})"),
)
# End of the fixed values.

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ISO_DATE = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
DAY_MONTH = r"(?i)\b([0-9]{1,2}) (" + "|".join(MONTHS) + r"),? ([0-9]{4})\b"


def whole(words: str) -> str:
    """A pattern of whole words, any case."""
    return java(rf"(?i)\b(?:{words})\b")


def first_kind(text: Column, kinds: dict[str, str], default: str) -> Column:
    """The first kind whose words occur."""
    found = F.lit(default)
    for kind, words in reversed(kinds.items()):
        found = F.when(text.rlike(whole(words)), kind).otherwise(found)
    return F.when(text.isNotNull(), found)


def signal_score(text: Column, kind: str) -> Column:
    """A fifth for each occurrence, 1 at most."""
    return F.least(F.lit(1.0), F.regexp_count(text, F.lit(whole(SIGNALS[kind]))) / 5.0)


def foresight(text: Column) -> Column:
    """The words that tell of the future by the first pattern that does, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, java("(?i)" + p), 0), F.lit("")) for p in FORESIGHT])


def informative(text: Column) -> Column:
    """Whether a note is long enough and more than a set phrase."""
    bare = F.btrim(F.lower(F.trim(text)), F.lit(".,!?;:"))
    return (F.length(F.trim(text)) >= SHORTEST_NOTE) & ~bare.isin(*LOW_INFO)


def filler(text: Column) -> Column:
    low = F.lower(F.trim(text))
    out = F.lit(False)
    for prefix in FILLERS:
        out = out | low.startswith(prefix)
    return out


def negated_apart(a: Column, b: Column) -> Column:
    """Whether some negation is in exactly one of the texts."""
    out = F.lit(False)
    for marker in NEGATIONS:
        out = out | (F.lower(a).contains(marker) != F.lower(b).contains(marker))
    return out


def entity_type(name: Column) -> Column:
    """organization, place, event, skill, person or concept by marks of the name."""
    has = lambda marks: name.rlike("|".join(marks))
    return (
        F.when((F.length(name) <= 2) | (F.length(name) > 100) | name.rlike(r"^[\d.v/-]+$"), "concept")
        .when(has(ORGANISATIONS), "organization").when(has(PLACES), "place").when(has(OCCASIONS), "event")
        .when(name.rlike(r"^[\w-]+:[\w-]+$") | name.rlike(whole("skill|command|agent|plugin|hook|mcp")), "skill")
        .when(name.rlike(r"^[A-Z][a-z]+ [A-Z][a-z]+( [A-Z][a-z]+)?$"), "person")
        .otherwise("concept")
    )


def activity(text: Column) -> Column:
    """The activity most of whose words occur; the first of equals, unknown without any."""
    hits = [sum((text.rlike(whole(w)).cast("int") for w in words), F.lit(0)) for words in ACTIVITIES.values()]
    best = F.greatest(*hits)
    out = F.lit("unknown")
    for kind, n in reversed(list(zip(ACTIVITIES, hits))):
        out = F.when((n == best) & (best > 0), kind).otherwise(out)
    return out


def redact_keys(text: Column) -> Column:
    """Keys of known makers as ``[REDACTED:kind:last four]``."""
    for kind, pattern in KEYS:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{kind}:$1]")
    return text


def in_first_person(text: Column) -> Column:
    """``[Name]: I like my job`` as ``Name likes``'s plain form: the name for I, my and me."""
    name = F.regexp_extract(text, r"^\[([A-Za-z ]+)\]: ", 1)
    rest = F.regexp_replace(text, r"^\[[A-Za-z ]+\]: ", "")
    for word, put in (("I", F.lit("")), ("my", F.lit("'s")), ("me", F.lit(""))):
        rest = F.regexp_replace(rest, F.lit(java(rf"\b{word}\b")), F.concat(name, put))
    return F.when(name == "", text).otherwise(rest)


def dates(text: Column) -> Column:
    """Dates written as 2024-03-05 or 8 May, 2023; in order, distinct."""
    iso = F.transform(F.regexp_extract_all(text, F.lit(java(ISO_DATE)), F.lit(0)), lambda d: F.try_to_date(d, "yyyy-MM-dd"))
    month = lambda m: F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.lower(m)).cast("int")
    parts = [F.regexp_extract_all(text, F.lit(java(DAY_MONTH)), F.lit(k)) for k in (1, 2, 3)]
    written = F.transform(F.arrays_zip(*parts), lambda z: F.try_to_date(F.concat_ws("-", z["2"], F.lpad(month(z["1"]).cast("string"), 2, "0"), F.lpad(z["0"], 2, "0")), "yyyy-MM-dd"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(iso, written), lambda d: d.isNotNull())))


def interval(text: Column) -> Column:
    """struct<first, last> of ``from X to Y`` or ``between X and Y`` in ISO dates, else null."""
    pattern = java(r"(?i)\b(?:from|between) ([0-9]{4}-[0-9]{2}-[0-9]{2}) (?:to|and) ([0-9]{4}-[0-9]{2}-[0-9]{2})\b")
    ends = [F.try_to_date(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")), "yyyy-MM-dd") for k in (1, 2)]
    return F.when(ends[0].isNotNull() & ends[1].isNotNull(), F.struct(ends[0].alias("first"), ends[1].alias("last")))


def unit_shift(day: Column, count: Column, unit: Column) -> Column:
    """A day moved by days, weeks, months or years; calendar months, clipped to their ends."""
    return F.when(unit == "day", F.date_add(day, count)).when(unit == "week", F.date_add(day, count * 7)).when(unit == "month", F.add_months(day, count)).when(unit == "year", F.add_months(day, count * 12))


def relative_day(text: Column, day: Column) -> Column:
    """What ``yesterday``, ``today``, ``tomorrow``, ``next month``, ``3 weeks ago`` and the like mean on ``day``, else null."""
    low = F.lower(text)
    ago = [F.nullif(F.regexp_extract(low, java(r"\b([0-9]+) (day|week|month|year)s? ago\b"), k), F.lit("")) for k in (1, 2)]
    ahead = [F.nullif(F.regexp_extract(low, java(r"\bin ([0-9]+) (day|week|month|year)s?\b"), k), F.lit("")) for k in (1, 2)]
    turn = [F.nullif(F.regexp_extract(low, java(r"\b(last|next) (week|month|year)\b"), k), F.lit("")) for k in (1, 2)]
    return F.coalesce(
        F.when(low.rlike(java(r"\byesterday\b")), F.date_add(day, -1)).when(low.rlike(java(r"\btomorrow\b")), F.date_add(day, 1)).when(low.rlike(java(r"\btoday\b")), day),
        unit_shift(day, -ago[0].cast("int"), ago[1]),
        unit_shift(day, ahead[0].cast("int"), ahead[1]),
        unit_shift(day, F.when(turn[0] == "last", -1).otherwise(1), turn[1]),
    )


def part_of_day(hour: Column, starts: tuple[int, int, int] = (5, 12, 17), night: int = 21) -> Column:
    """morning, afternoon, evening or night."""
    return F.when((hour >= starts[0]) & (hour < starts[1]), "morning").when((hour >= starts[1]) & (hour < starts[2]), "afternoon").when((hour >= starts[2]) & (hour < night), "evening").otherwise("night")


#: Zero-width marks: of the bits of small keys, of the hex digits of others (variation selectors), and of no key.
BIT_MARKS, DIGIT_MARKS, NO_KEY = "\u200b\u200c", "".join(map(chr, range(0xFE00, 0xFE10))), "\u2060"


def watermark(text: Column, key: Column) -> Column:
    """``text`` with a key as 16 zero-width characters behind its first character: the bits
    of a key below 2^16, the hex digits of any other, marks of its own for a null."""
    bits = F.translate(F.lpad(F.bin(key), 16, "0"), "01", BIT_MARKS)
    digits = F.translate(F.lpad(F.hex(key), 16, "0"), "0123456789ABCDEF", DIGIT_MARKS)
    marks = F.when(key.between(0, (1 << 16) - 1), bits).when(key.isNotNull(), digits).otherwise(NO_KEY * 16)
    return F.concat(F.substring(text, 1, 1), marks, F.substr(text, F.lit(2)))


def read_watermark(text: Column) -> Column:
    """The key that ``watermark`` put in, else null."""
    marks = F.regexp_extract(text, f"[{BIT_MARKS}]{{16}}|[{DIGIT_MARKS}]{{16}}|{NO_KEY}{{16}}", 0)
    bits, digits = F.translate(marks, BIT_MARKS, "01"), F.translate(marks, DIGIT_MARKS, "0123456789ABCDEF")
    return F.when(bits.rlike("^[01]{16}$"), F.conv(bits, 2, 10)).when(digits.rlike("^[0-9A-F]{16}$"), F.conv(digits, 16, -10)).cast("long")


def fts_query(text: Column, most: int = 500) -> Column:
    """A full-text query without operators: each word quoted, ``most`` characters read."""
    words = F.regexp_extract_all(F.substring(text, 1, most), F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ")


#: Ways a session's date is written, tried in order.
DATE_FORMS = ("yyyy-MM-dd", "d MMMM, yyyy", "MMMM d, yyyy", "h:mm a 'on' d MMMM, yyyy", "yyyy-MM-dd HH:mm:ss")
#: Question types of strata; others count as the last.
QUESTION_TYPES = ("single_hop", "multi_hop", "temporal", "open_domain")


def session_date(raw: Column) -> Column:
    """The time that ``raw`` writes in one of DATE_FORMS, else null."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)\bpm\b", "PM"), r"(?i)\bam\b", "AM")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(form)) for form in DATE_FORMS])


def stratum(kind: Column, entities: Column, hour: Column) -> Column:
    """Question type, bin of the number of entities and part of the day, by bars."""
    bins = F.when(F.coalesce(entities, F.lit(0)) <= 0, "0").when(entities <= 2, "1-2").otherwise("3+")
    return F.concat_ws("|", F.when(kind.isin(*QUESTION_TYPES), kind).otherwise(QUESTION_TYPES[-1]), bins, part_of_day(hour))
