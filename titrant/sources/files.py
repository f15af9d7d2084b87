"""Readers of rule, priority and safety files in JSON.

A file is read whole, so the place of an entry is its file and its position
there, however Spark splits the files: "later wins" is exact.  A file holds one
JSON array, one JSON object, or one JSON object per line.  What cannot be read is
reported in `broken` and not lost: whole files of another form, and single
lines.  Files are read by tasks; only lexicons that become part of an
expression come to the driver, behind a stated limit (`words`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from titrant.sources import dims

PLACE = ["file", "pos"]
MAX_WORDS = 20_000


@dataclass
class Scan:
    entries: DataFrame   # file, pos and the fields of the schema
    broken: DataFrame    # file, pos (null: the whole file), text


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("text"))


def scan(spark: SparkSession, path: str, schema: str) -> Scan:
    """Entries of all files under a path with their place, and what could not be read.

    An array gives its elements; any other text is read line by line.  Empty files
    and lines give nothing; an element that is no object is skipped.
    """
    kind = T.StructType.fromDDL(schema)
    texts = _texts(spark, path)
    listed = texts.filter(F.col("text").startswith("["))
    # elements first as text, so that one odd element does not empty the array
    elements = listed.withColumn("raw", F.from_json("text", "array<string>"))
    whole = elements.filter("raw is null").select("file", F.lit(None).cast("int").alias("pos"), "text")
    lines = (texts.filter(~F.col("text").startswith("[")).select("file", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw"))
             .withColumn("raw", F.trim("raw")).filter("raw <> ''"))
    items = elements.filter("raw is not null").select("file", F.posexplode("raw").alias("pos", "raw")).unionByName(lines)
    with_bad = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    parsed = items.filter("raw is not null").withColumn("e", F.from_json("raw", with_bad, {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("e").isNull() | F.col("e._bad").isNotNull() | ~F.col("raw").startswith("{")
    entries = parsed.filter(~bad).select(*PLACE, *[F.col(f"e.{f.name}") for f in kind.fields])
    return Scan(entries, whole.unionByName(parsed.filter(bad).select(*PLACE, F.col("raw").alias("text"))))


def latest(entries: DataFrame, key: str) -> DataFrame:
    """Of the entries of a key the one of the last file and position; entries without a key are out."""
    fields = [c for c in entries.columns if c not in PLACE]
    return (entries.filter(F.coalesce(key, F.lit("")) != "").groupBy(key)
            .agg(F.max_by(F.struct(*[c for c in fields if c != key]), F.struct(*PLACE)).alias("_e")).select(key, "_e.*").select(*fields))


def numeric_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rules as dims.numeric_rules gives them, one per code, and what was broken."""
    found = scan(spark, path, dims.RULE_SCHEMA)
    return latest(found.entries, "loinc_code"), found.broken


QUALITATIVE_FILE = (
    "tests map<string,struct<test_name:string,category:string,positive_direction:string,negative_direction:string,"
    "severity_when_positive:string,actionability_when_positive:string,severity_when_abnormal:string,actionability_when_abnormal:string,"
    "titer_positive_threshold:double,normal_values:array<string>,grade_severity:map<string,string>,actionability_threshold:string,"
    "normal_status:string,abnormal_status:string,explanation_context:string>>, value_aliases map<string,string>")


def _object(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Files that hold one JSON object each, printed over any number of lines."""
    kind = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_bad", T.StringType())])
    read = _texts(spark, path).filter("text <> ''").withColumn("o", F.from_json("text", kind, {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("o").isNull() | F.col("o._bad").isNotNull() | ~F.col("text").startswith("{")
    return read.filter(~bad).select("file", "o.*").drop("_bad"), read.filter(bad).select("file", F.lit(None).cast("int").alias("pos"), "text")


def qualitative_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assay rules as dims.qualitative_rules gives them (with the same defaults
    of missing fields), value spellings (spelling, value), and broken files.
    Of equal codes or spellings the one in the last file holds."""
    objects, broken = _object(spark, path, QUALITATIVE_FILE)
    t = objects.select("file", F.lit(0).alias("pos"), F.explode("tests").alias("loinc_code", "r")).filter("r is not null")
    r = lambda field, default=None: F.coalesce(F.col(f"r.{field}"), F.lit(default)) if default is not None else F.col(f"r.{field}")
    positive = F.coalesce(F.col("r.category") == "expected_positive", F.lit(False))
    rules = t.select(
        *PLACE, "loinc_code", F.lower("r.test_name").alias("qual_name"), r("category").alias("category"),
        F.coalesce("r.positive_direction", F.when(positive, "in-range").otherwise("high")).alias("positive_direction"),
        F.coalesce("r.negative_direction", F.when(positive, "high").otherwise("in-range")).alias("negative_direction"),
        r("severity_when_positive", "moderate").alias("severity_positive"), r("actionability_when_positive", "follow-up").alias("action_positive"),
        r("severity_when_abnormal", "mild").alias("severity_abnormal"), r("actionability_when_abnormal", "follow-up").alias("action_abnormal"),
        r("titer_positive_threshold").alias("threshold"), F.coalesce("r.normal_values", F.array(F.lit("negative"))).alias("normal_values"),
        F.coalesce("r.grade_severity", F.create_map().cast("map<string,string>")).alias("grades"), r("actionability_threshold", "1+").alias("action_grade"),
        r("normal_status", "normal").alias("normal_status"), r("abnormal_status", "abnormal").alias("abnormal_status"), r("explanation_context", "").alias("context"))
    spelled = objects.select("file", F.lit(0).alias("pos"), F.explode("value_aliases").alias("spelling", "value")).filter("value is not null")
    return latest(rules, "loinc_code"), latest(spelled, "spelling"), broken


def priority(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Low-priority name parts (token), severity caps (token, cap), and broken
    files.  Tokens are lower-cased, caps of an unknown severity dropped;
    `ord` numbers both in file order, the first place of a repeated token."""
    objects, broken = _object(spark, path, "exclude_from_summary array<string>, severity_cap map<string,string>")
    tokens = objects.select("file", F.posexplode("exclude_from_summary").alias("pos", "token"))
    caps = objects.select("file", F.posexplode(F.map_entries("severity_cap")).alias("pos", "e")).select(
        *PLACE, F.col("e.key").alias("token"), F.lower("e.value").alias("cap")).filter(F.col("cap").isin("normal", "mild", "moderate", "critical"))
    by_place = Window.orderBy("file", "pos")  # at most MAX_WORDS entries, one per distinct token

    def numbered(df, *more):
        first = df.filter("token is not null").withColumn("token", F.lower("token")).groupBy("token").agg(
            F.min(F.struct(*PLACE)).alias("p"), *[F.max_by(c, F.struct(*PLACE)).alias(c) for c in more])
        return first.select("token", *more, "p.*").withColumn("ord", F.row_number().over(by_place) - 1).drop(*PLACE)
    return numbered(tokens), numbered(caps, "cap"), broken


def safety(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Drug names (word), acute symptoms (lang, word), the phrases that send to a
    doctor (lang, word), and broken files.  A file may hold `drugs`,
    `doctor_phrases`, and a list of phrases per language under any other key."""
    objects, broken = _object(spark, path, "drugs array<string>, doctor_phrases map<string,string>")
    drugs = objects.select(F.explode("drugs").alias("word")).filter("word is not null").select(F.lower("word").alias("word")).distinct()
    doctor = latest(objects.select("file", F.lit(0).alias("pos"), F.explode("doctor_phrases").alias("lang", "word")).filter("word is not null"), "lang")
    keyed = _texts(spark, path).select("file", F.explode(F.from_json("text", "map<string,string>")).alias("lang", "raw")).filter("lang not in ('drugs', 'doctor_phrases')")
    symptoms = (keyed.select("file", "lang", F.posexplode(F.from_json("raw", "array<string>")).alias("pos", "word")).filter("word is not null")
                .select("lang", F.lower("word").alias("word")).distinct())
    return drugs, symptoms, doctor, broken


def words(table: DataFrame, *columns: str, order: str | None = None, limit: int = MAX_WORDS) -> list:
    """A lexicon for an expression: values of one column, or tuples of several.

    Raises where the table has more than `limit` rows: a larger one belongs in a join.
    """
    rows = table.select(*columns, *([order] if order and order not in columns else [])).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a lexicon of more than {limit} entries cannot be part of an expression")
    rows = sorted(rows, key=lambda r: r[order]) if order else sorted(rows, key=lambda r: tuple(map(str, r)))
    return [r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns) for r in rows]
