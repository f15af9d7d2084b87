"""Parsing of model-written JSON texts kept in string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from titrant.functions import text as tx

ROW_JSON = ("struct<test_name:string,value:string,unit:string,reference_range_low:string,reference_range_high:string,"
            "reference_range_text:string,flag:string>")
PAGE_JSON = f"struct<source_language:string,lab_name:string,report_date:string,patient_id:string,values:array<{ROW_JSON}>>"
ANSWER_JSON = ("struct<answer:string,citations:array<struct<test_name:string,value:string,unit:string,health_topic:string>>,"
               "follow_ups:array<string>,doctor_routing:boolean,refused:boolean,refusal_reason:string>")
VERDICTS_JSON = "struct<verdicts:array<struct<index:int,verdict:string,reason:string>>>"
SCREENING_JSON = ("struct<test_type:string,result_status:string,signal_origin:string,organs_screened:array<string>,"
                  "limitations:string,followup_recommendation:string,raw_summary:string>")
EXPLANATIONS_JSON = ("array<struct<test_name:string,summary:string,what_it_means:string,next_steps:string,sources:array<string>>>")


def unfenced(raw: Column) -> Column:
    """Text without its markdown code fence: the first line goes when it opens a
    fence, and everything from the last fence on."""
    s = tx.strip(raw)
    body = F.regexp_replace(F.regexp_replace(s, r"^```[^\n]*\n", ""), r"(?s)```(?!.*```).*$", "")
    return F.when(F.startswith(s, F.lit("```")) & F.contains(s, F.lit("\n")), tx.strip(body)).otherwise(s)


def is_json(s: Column, schema: str) -> Column:
    """True when the text is complete JSON of the schema's outer kind."""
    opening, closing = ("[", "]") if schema.startswith("array") else ("{", "}")
    return F.startswith(s, F.lit(opening)) & F.endswith(s, F.lit(closing)) & F.get_json_object(s, "$").isNotNull()


def parse_object(raw: Column, schema: str) -> Column:
    """Strip the fence and parse; null on failure."""
    s = unfenced(raw)
    return F.when(is_json(s, schema), F.from_json(s, schema))


def parse_object_tolerant(raw: Column, schema: str) -> Column:
    """Like parse_object, then retry on the widest `{...}` piece of the text."""
    s = unfenced(F.coalesce(raw, F.lit("")))
    piece = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.coalesce(F.when(is_json(s, schema), F.from_json(s, schema)),
                      F.when(is_json(piece, schema), F.from_json(piece, schema)))


def parse_headline(raw: Column) -> Column:
    """The `headline` field, from JSON or by pattern when the JSON is broken."""
    s = unfenced(F.coalesce(raw, F.lit("")))
    field = tx.strip(F.get_json_object(s, "$.headline"))
    quoted = tx.strip(F.nullif(F.regexp_extract(s, r'"headline"\s*:\s*"([^"]+)"', 1), F.lit("")))
    return F.when(is_json(s, "struct<>"), F.nullif(field, F.lit(""))).otherwise(quoted)


def parse_explanations(rows: DataFrame, raw: str, language: str) -> DataFrame:
    """Explanation rows of an array text; texts that do not parse give none."""
    items = parse_object(F.col(raw), EXPLANATIONS_JSON)
    blank = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit(""))
    keep = [c for c in rows.columns if c != raw]
    return rows.withColumn("e", F.explode(items)).select(
        *keep, F.coalesce("e.test_name", F.lit("Unknown")).alias("test_name"), blank("summary").alias("summary"),
        blank("what_it_means").alias("what_it_means"), blank("next_steps").alias("next_steps"),
        F.coalesce("e.sources", F.array().cast("array<string>")).alias("sources"),
        F.col(language).alias("explanation_language"), F.lit(False).alias("is_fallback"))


def parse_screening(raw: Column) -> Column:
    """Screening result struct with the status normalised; confidence 0.85."""
    p = parse_object(raw, SCREENING_JSON)
    s = F.lower(F.coalesce(p.result_status, F.lit("indeterminate")))
    status = F.when(s == "detected", "detected").when(s.isin("not_detected", "not detected"), "not_detected").otherwise("indeterminate")
    return F.when(p.isNotNull(), F.struct(
        F.coalesce(p.test_type, F.lit("Unknown")).alias("test_type"), status.alias("result_status"),
        p.signal_origin.alias("signal_origin"),
        F.coalesce(p.organs_screened, F.array().cast("array<string>")).alias("organs_screened"),
        p.limitations.alias("limitations"), p.followup_recommendation.alias("followup_recommendation"),
        p.raw_summary.alias("raw_text"), F.lit(0.85).alias("confidence")))


def parse_verdicts(rows: DataFrame, raw: str, expected: str) -> DataFrame:
    """One verdict per expected index.  Missing indices and unknown words count
    as downgrade; of a repeated index the last entry holds."""
    p = parse_object(F.col(raw), VERDICTS_JSON)
    a = rows.withColumn("_p", p).withColumn("_i", F.explode(F.when(
        F.col(expected) > 0, F.sequence(F.lit(0), F.col(expected) - 1)).otherwise(F.array().cast("array<int>"))))
    mine = F.filter(F.col("_p.verdicts"), lambda v: v.index == F.col("_i"))
    a = a.withColumn("_v", F.try_element_at(mine, F.lit(-1)))
    word = F.lower(F.coalesce(F.nullif(F.col("_v.verdict"), F.lit("")), F.lit("downgrade")))
    known = word.isin("accept", "downgrade", "mark_indeterminate", "retry")
    keep = [c for c in rows.columns if c not in (raw, expected)]
    return a.select(
        *keep, F.col("_i").alias("index"),
        F.when(F.col("_v").isNotNull() & known, word).otherwise("downgrade").alias("verdict"),
        F.when(F.col("_p").isNull(), "Unparseable model response")
        .when(F.col("_v").isNull(), F.format_string("Model did not return verdict for index %d", "_i"))
        .otherwise(F.coalesce("_v.reason", F.lit(""))).alias("reason"),
        F.when(F.col("_v").isNotNull() & (word == "accept"), "medium").otherwise("low").alias("adjusted_conf"))


def page_rows(pages: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Extracted pages (report_id, page_num, raw text) to header and raw rows."""
    p = pages.withColumn("_p", parse_object(F.col(raw), PAGE_JSON)).filter(F.col("_p").isNotNull())
    return p.select("report_id", "page_num", "_p.source_language", "_p.lab_name", "_p.report_date", "_p.patient_id",
                    F.posexplode_outer("_p.values").alias("row_idx", "v")).select(
        "report_id", "page_num", "source_language", "lab_name", "report_date", "patient_id",
        F.col("row_idx").cast("long").alias("row_idx"), "v.test_name", F.col("v.value").alias("value_raw"), "v.unit",
        F.col("v.reference_range_low").alias("low_raw"), F.col("v.reference_range_high").alias("high_raw"),
        F.col("v.reference_range_text").alias("ref_text"), "v.flag")
