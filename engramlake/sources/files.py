"""File sources and sinks: transcripts, exports, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.operators.graph import last_per_group

CUE = r"(\d{2}:\d{2}:\d{2})[,.]\d{3} --> "


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Utterances of SRT and VTT files: (path, content_hash, place, at, speaker, text).

    Blocks are separated by blank lines; a leading ``Name:`` or ``<v Name>`` is
    the speaker.  A file is a row until it is exploded, so it must fit in memory.
    """
    files = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r", "").alias("value"))
    blocks = files.select("path", F.substring(F.sha2("value", 256), 1, 32).alias("content_hash"), F.posexplode(F.split("value", r"\n\s*\n")).alias("place", "block"))
    cues = blocks.where(F.col("block").rlike(CUE)).withColumn("body", F.btrim(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n", "")))
    who = F.coalesce(F.nullif(F.regexp_extract("body", r"^<v ([^>]+)>", 1), F.lit("")), F.nullif(F.regexp_extract("body", r"^([A-Z][\w ]{0,30}):", 1), F.lit("")), F.lit(""))
    said = F.regexp_replace(F.regexp_replace("body", r"^<v [^>]+>", ""), r"^[A-Z][\w ]{0,30}:", "")
    said = F.btrim(F.regexp_replace(F.regexp_replace(said, r"</?[a-z][^>]*>", ""), r"\s+", " "))
    return cues.select("path", "content_hash", "place", F.regexp_extract("block", CUE, 1).alias("at"), who.alias("speaker"), said.alias("text"))


def by_suffix(spark: SparkSession, folder: str) -> DataFrame:
    """Utterances of whatever a folder holds: SRT and VTT cues, other text files a line each."""
    cues = [transcripts(spark, f"{folder}/*.{kind}") for kind in ("srt", "vtt") if _any(spark, f"{folder}/*.{kind}")]
    out = cues[0].unionByName(cues[1]) if len(cues) == 2 else cues[0] if cues else None
    if _any(spark, f"{folder}/*.txt"):
        files = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r", "").alias("value"))
        lines = files.select("path", F.substring(F.sha2("value", 256), 1, 32).alias("content_hash"), F.posexplode(F.split("value", "\n")).alias("place", "text")).where(F.trim("text") != "")
        plain = lines.select("path", "content_hash", "place", F.lit("").alias("at"), F.lit("").alias("speaker"), F.btrim("text").alias("text"))
        out = plain if out is None else out.unionByName(plain)
    if out is None:
        raise FileNotFoundError(folder)
    return out


def _any(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def new_files(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of files whose content was not taken in before, one file a content."""
    first = found.groupBy("content_hash").agg(F.min("path").alias("path"))
    return found.join(first, ["content_hash", "path"]).join(seen.select("content_hash").distinct(), "content_hash", "left_anti")


def mailbox(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of mbox files: (path, place, sender, subject, sent, body).

    Messages begin at ``From `` lines; a header's folded lines are joined; a body's
    ``>From `` is ``From `` again.  A file is a row until it is exploded.
    """
    files = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r", "").alias("value"))
    mails = files.select("path", F.posexplode(F.filter(F.split("value", r"(?m)^From [^\n]*\n"), lambda m: F.trim(m) != "")).alias("place", "mail"))
    split = mails.withColumn("head", F.regexp_replace(F.substring_index("mail", "\n\n", 1), r"\n[ \t]+", " "))
    field = lambda name: F.btrim(F.regexp_extract("head", rf"(?im)^{name}: *([^\n]*)$", 1))
    body = F.btrim(F.regexp_replace(F.substr("mail", F.length(F.substring_index("mail", "\n\n", 1)) + 3), r"(?m)^>From ", "From "), F.lit("\n "))
    return split.select("path", "place", field("From").alias("sender"), field("Subject").alias("subject"), field("Date").alias("sent"), body.alias("body"))


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Events of ICS files: (path, uid, summary, location, starts, ends); starts and ends are UTC, days are midnights."""
    files = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace(F.regexp_replace("value", "\r", ""), r"\n[ \t]", "").alias("value"))
    found = files.select("path", F.explode(F.regexp_extract_all("value", F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1))).alias("e"))
    field = lambda name: F.btrim(F.regexp_extract("e", rf"(?m)^{name}(?:;[^:\n]*)?:([^\n]*)$", 1))
    plain = lambda name: F.replace(F.replace(field(name), F.lit("\\,"), F.lit(",")), F.lit("\\n"), F.lit("\n"))
    at = lambda name: F.coalesce(F.try_to_timestamp(F.rtrim(field(name), F.lit("Z")), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(field(name), F.lit("yyyyMMdd")))
    return found.select("path", field("UID").alias("uid"), plain("SUMMARY").alias("summary"), plain("LOCATION").alias("location"), at("DTSTART").alias("starts"), at("DTEND").alias("ends"))


def log_events(df: DataFrame, folder: str, kinds: tuple[str, ...]) -> None:
    """Appends events of known kinds to a log; others are an error, as the log has one schema."""
    odd = df.where(~F.col("event_type").isin(*kinds)).select("event_type").limit(1).collect()
    if odd:
        raise ValueError(f"unknown event type {odd[0][0]!r}")
    df.write.mode("append").json(folder)


def update(current: DataFrame, key: str, changes: dict[str, object], ids: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """``current`` with columns set for the ids; lists and dicts are kept as JSON.  Only allowed columns may change."""
    import json

    if not changes or set(changes) - set(allowed):
        raise ValueError(f"nothing to change, or not among {allowed}: {sorted(changes)}")
    marked = current.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    for name, value in changes.items():
        put = json.dumps(value) if isinstance(value, (list, dict)) else value
        marked = marked.withColumn(name, F.when(F.col("_hit"), F.lit(put)).otherwise(F.col(name)))
    return marked.select(*current.columns)


def export_json(df: DataFrame, folder: str) -> None:
    df.write.mode("errorifexists").json(folder)


def import_json(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; unknown fields are dropped, bad records null."""
    return spark.read.schema(schema).json(folder)


def export_profile(tables: dict[str, DataFrame], profile: str, folder: str) -> dict[str, int]:
    """All rows of a profile, a folder of JSON a table; the counts written."""
    counts = {}
    for name, df in tables.items():
        own = df.where(F.col("profile_id") == profile)
        own.write.mode("errorifexists").json(f"{folder}/{name}")
        counts[name] = own.count()
    return counts


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key of a table and its changes; write it to a new folder and swap."""
    return last_per_group(current.unionByName(changes), keys, [F.col(version).desc()])


def erase(tables: dict[str, DataFrame], profile: str) -> dict[str, DataFrame]:
    """The tables without a profile's rows, for overwriting."""
    return {name: df.where(~F.col("profile_id").eqNullSafe(profile)) for name, df in tables.items()}
