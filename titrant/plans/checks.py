"""Composed checks: model answers against reports, and outputs against ground truth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from titrant.functions import text as tx
from titrant.operators import evaluate as ev, grounding as gr
from titrant.session import saved
from titrant.sources import io, parse

COMPACT = ["report_id", "page_num", "row_idx", "name", "value_num", "ref_low", "ref_high", "is_panic", "severity"]


def ground_check(asked: DataFrame, compact: DataFrame, summaries: DataFrame) -> DataFrame:
    """From raw model text to the final answer of each question.

    `asked`: report_id, answer_id, text (the question), language, raw (what the
    model wrote, or null).  `compact`: the report rows COMPACT.  `summaries`: report_id, headline,
    top_findings.  Questions are trimmed, redacted and clipped; text that holds no answer
    object is answered from the summary; the others pass the guardrails.  One row
    per question, in its final shape.  The questions are parsed once and kept
    as a table, as are the report rows, cut to what the checks read.
    """
    read = gr.clean_questions(asked).withColumn("parsed", parse.parse_object_tolerant(F.col("raw"), parse.ANSWER_JSON))
    read = saved(read.select("report_id", "answer_id", "question", "language", "parsed"), "asked")
    facts = saved(compact.select(*COMPACT).join(read.select("report_id").distinct().hint("merge"), "report_id", "left_semi"), "facts")
    checked = gr.validate_answers(read.filter("parsed is not null"), facts)
    serious = facts.groupBy("report_id").agg(F.bool_or(F.col("is_panic") | F.col("severity").isin("moderate", "critical")).alias("report_serious"))
    plain = gr.deterministic_answers(read.filter("parsed is null").drop("parsed"), summaries.join(serious.hint("merge"), "report_id", "left"))
    plain = plain.withColumn("refusal_reason", F.lit(None).cast("string")).select(*checked.columns)
    return gr.coerce_answers(checked.unionByName(plain))


# ---- documents against ground truth ---------------------------------------

@dataclass
class Evaluation:
    scores: DataFrame        # one row per truth document, screening and blocks included
    matches: DataFrame       # aligned pairs and their field marks
    regressions: DataFrame   # against the golden outputs; empty without them
    broken: DataFrame        # documents that could not be read: side, source_file, text
    unpaired: DataFrame      # documents of one side alone: side, doc_id


def _values(documents: DataFrame, column: str) -> DataFrame:
    """Rows doc_id, pos and the fields that alignment reads."""
    v = documents.select("doc_id", F.posexplode(column).alias("pos", "v"))
    number = tx.plain_number(F.col("v.value"))
    return v.select("doc_id", "pos", "v.test_name", number.alias("value_num"), F.when(number.isNull(), F.col("v.value")).alias("value_text"), "v.unit",
                    F.col("v.reference_range_low").alias("ref_low"), F.col("v.reference_range_high").alias("ref_high"), "v.flag", "v.section_type")


def _items(documents: DataFrame, column: str) -> DataFrame:
    return documents.select("doc_id", F.posexplode(column).alias("pos", "v")).select("doc_id", "pos", "v.*")


def evaluate_documents(truth: DataFrame, output: DataFrame, golden: DataFrame | None = None) -> Evaluation:
    """Score output documents against truth documents of the same doc_id.

    `truth` and `golden` / `output` come from io.read_documents with the schemas
    io.EXTRACTION_TRUTH and io.EXTRACTION_OUTPUT.  Documents without an
    output score zero; broken ones are reported, not lost.
    """
    sides = {"truth": truth, "output": output} | ({"golden": golden} if golden is not None else {})
    sides = {k: saved(d, k) for k, d in sides.items()}  # each document is parsed once
    sound = {k: d.filter("broken is null") for k, d in sides.items()}
    broken = None
    for side, d in sides.items():
        rows = d.filter("broken is not null").select(F.lit(side).alias("side"), "source_file", F.col("broken").alias("text"))
        broken = rows if broken is None else broken.unionByName(rows)
    t, o = sound["truth"], sound["output"]
    expected, extracted = _values(t, "expected_values"), _values(o, "values")
    matches = saved(ev.field_matches(ev.align(expected, extracted)), "matches")
    scores = t.select("doc_id", "archetype").join(ev.document_scores(expected, extracted, matches), "doc_id", "left")
    scores = scores.join(ev.screening_matches(_items(t, "expected_screening"), _items(o, "screening_results")), "doc_id", "left")
    blocks = ev.block_category_matches(_items(t, "expected_hplc"), _items(o.select("doc_id", F.col("audit.hplc_blocks").alias("b")), "b"))
    scores = scores.join(blocks, "doc_id", "left").fillna(0)
    old = _values(sound["golden"], "values") if golden is not None else extracted.limit(0)
    # a golden document without a current output says nothing about values
    regressions = ev.regressions(old.join(o.select("doc_id"), "doc_id", "left_semi"), extracted)
    ids = {"truth": t.select("doc_id"), "output": o.select("doc_id")}
    unpaired = (ids["truth"].join(ids["output"], "doc_id", "left_anti").select(F.lit("truth").alias("side"), "doc_id")
                .unionByName(ids["output"].join(ids["truth"], "doc_id", "left_anti").select(F.lit("output").alias("side"), "doc_id")))
    return Evaluation(scores, matches, regressions, broken, unpaired)


def evaluate_folders(spark: SparkSession, truth: str, output: str, golden: str | None = None, one_per_file: bool = True) -> Evaluation:
    """evaluate_documents over folders of JSON documents; of files, the name without its ending is the doc_id."""
    def read(path, schema):
        return io.read_documents(spark, path, schema, one_per_file)
    return evaluate_documents(read(truth, io.EXTRACTION_TRUTH), read(output, io.EXTRACTION_OUTPUT), read(golden, io.EXTRACTION_OUTPUT) if golden else None)
