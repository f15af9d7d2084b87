"""Operator 10: licence scans by canonical digest lookup.

A text is brought to a canonical form: copyright lines out, lower case,
equivalent spellings unified, every run of other characters than letters and digits made one
blank.  The digest of the whole text is hash-joined to the digests of known
licence texts; so is the digest of each whole line, which finds documents
that state a licence in a line of their own.

Whole files are also looked up in a wider form: line ends unified, and every line
out that begins with a copyright word and names a holder.  The default table holds the
common licences whole, under their usual titles (`licence_full`).

Defined results: null, empty or punctuation-only texts have the digest of the empty text and no
licence.  One row per input row.  The table of known texts is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titrant.llm.licence_full import whole_texts
from titrant.llm.licence_texts import KNOWN, SPELLINGS

#: A line that only names the holder of a copyright.
HOLDER_LINE = r"(^|\n)[ \t#*/;%-]*((copyright|\(c\)|©) *(\(c\)|©|copyright|[0-9]{4}|<year>|\[year\]|\[yyyy\])[^\n]*|all rights reserved\.?[ \t]*)(?=\n|$)"
#: For engines without look-ahead: the same pattern, on text whose line ends are doubled.
HOLDER_LINE_DOUBLED = HOLDER_LINE.replace(r"(?=\n|$)", r"(\n|$)")
#: Words behind "copyright" in the texts of licences, where a wrapped line may begin with it.
BODY_WORDS = "holders?|owners?|ownership|notices?|laws?|licen[cs]es?|interests?|statements?|treaty|doctrines|disclaimer|permission|and|or|of|on|if|in|is|are|the software|the library"
#: The wider form of HOLDER_LINE: "Copyright Joyent, Inc.", "(c) The Authors", "All rights reserved." with what follows in the line.
WIDE_HOLDER_LINE = rf"(^|\n)[ \t#*/;%-]*(copyrights?(?![ \t]+({BODY_WORDS})\b)(?![\w])[^\n]*|(\(c\)|©)[^\n]*|all rights reserved\.?[ \t*/]*)(?=\n|$)"
OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form: words of the text with single blanks between, and around."""
    return _words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), HOLDER_LINE, "\n"))


def wide_canonical(text: Column) -> Column:
    """The canonical form without all lines of holders, whatever the line ends."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    return _words(F.regexp_replace(t, WIDE_HOLDER_LINE, "\n"))


def _words(t: Column) -> Column:
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, OTHER, " ")), F.lit(" "))
    for other, usual in SPELLINGS:
        t = F.replace(t, F.lit(f" {other} "), F.lit(f" {usual} "))
    return t


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def wide_digest(text: Column, narrow: Column) -> Column:
    """The digest of the wide form.  Texts without carriage returns and copyright
    words have no lines that either form drops: theirs is the narrow digest."""
    return F.when(F.lower(text).rlike(r"\r|copyright|\(c\)|©|all rights reserved"), F.sha2(wide_canonical(text), 256)).otherwise(narrow)


def whole_digests(spark: SparkSession) -> DataFrame:
    """(whole_digest, whole_licence) of the licence files shipped: a fixed, small table."""
    rows = spark.createDataFrame(whole_texts() + sorted(KNOWN.items()), "licence string, text string")
    return rows.select(F.sha2(wide_canonical(F.col("text")), 256).alias("whole_digest"), "licence").groupBy("whole_digest").agg(F.min("licence").alias("whole_licence"))


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """(known_digest, licence) of the known texts: a small dimension."""
    rows = spark.createDataFrame(sorted((known or KNOWN).items()), "licence string, text string")
    return rows.select(digest(F.col("text")).alias("known_digest"), "licence").groupBy("known_digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_digest, licence (of the whole text), line_licences (names
    of the licences whose text is a whole line, sorted, with commas)."""
    if known is None:
        known, files = known_digests(docs.sparkSession), F.broadcast(whole_digests(docs.sparkSession))  # bounded: fixed values
    else:
        files = known.select(F.col("known_digest").alias("whole_digest"), F.col("licence").alias("whole_licence"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = rows.select("doc_id", F.md5("text").alias("row_key"), "text", digest(F.col("text")).alias("text_digest"))
    whole = whole.select("doc_id", "row_key", "text_digest", wide_digest(F.col("text"), F.col("text_digest")).alias("wide_digest"))
    whole = whole.join(known, F.col("text_digest") == F.col("known_digest"), "left").drop("known_digest")
    whole = whole.join(files, F.col("wide_digest") == F.col("whole_digest"), "left").withColumn("licence", F.coalesce("licence", "whole_licence"))
    lines = rows.select("doc_id", F.md5("text").alias("row_key"), F.explode(F.split("text", "\n")).alias("line")).where("length(line) > 0")
    stated = lines.select("doc_id", "row_key", digest(F.col("line")).alias("line_digest")).join(known, F.col("line_digest") == F.col("known_digest"))
    stated = stated.groupBy(F.col("doc_id").alias("own"), F.col("row_key").alias("own_key")).agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("line_licences"))
    found = whole.join(stated, whole["doc_id"].eqNullSafe(stated["own"]) & (whole["row_key"] == stated["own_key"]), "left")
    return found.select("doc_id", "text_digest", "licence", "line_licences")


def _sql_canonical(text: str) -> str:
    t = f"regexp_replace(replace(lower(coalesce({text}, '')), chr(10), chr(10) || chr(10)), '{HOLDER_LINE_DOUBLED}', chr(10), 'g')"
    t = f"' ' || trim(regexp_replace({t}, '{OTHER}', ' ', 'g')) || ' '"
    for other, usual in SPELLINGS:
        t = f"replace({t}, ' {other} ', ' {usual} ')"
    return t


def sql() -> str:
    """The same result in DuckDB."""
    quoted = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in sorted(KNOWN.items()))
    return f"""
WITH texts AS (SELECT * FROM (VALUES {quoted}) AS v(licence, text)),
known AS (SELECT sha256({_sql_canonical('text')}) AS digest, min(licence) AS licence FROM texts GROUP BY 1),
lines AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
stated AS (SELECT l.doc_id, l.text, string_agg(DISTINCT k.licence, ',' ORDER BY k.licence) AS line_licences
           FROM (SELECT doc_id, text, sha256({_sql_canonical('line')}) AS digest FROM lines WHERE length(line) > 0) l JOIN known k USING (digest) GROUP BY 1, 2)
SELECT d.doc_id, d.digest AS text_digest, k.licence, s.line_licences
FROM (SELECT doc_id, text, sha256({_sql_canonical('text')}) AS digest FROM documents) d
LEFT JOIN known k ON k.digest = d.digest LEFT JOIN stated s ON s.doc_id IS NOT DISTINCT FROM d.doc_id AND s.text IS NOT DISTINCT FROM d.text
"""
