"""Queries of the rollup, explanation and sink operators."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from titrant.catalog import chain as ch
from titrant.catalog.labview import POSITIONS_PER_PAGE
from titrant.catalog.registry import columns, query
from titrant.catalog.text_queries import screening_table
from titrant.fixed import analytes as fa, lexicons as lx
from titrant.functions import text as tx
from titrant.functions.ranks import STATUS, label
from titrant.operators import explain, interpret as it, rollup, screening as sc, sections, verify
from titrant.plans import payload, reports
from titrant.session import ensure_checkpoint_dir, saved
from titrant.sources import dims, io

KEY, K = "report_id, page_num, row_idx", ["report_id", "page_num", "row_idx"]


@columns("canonical_analytes", "marked", f"{KEY}, is_canonical")
def canonical_analytes(s):
    return rollup.mark_canonical(s.interpreted).select(*K, "is_canonical")


@query("alternate_analytes", "SELECT report_id, count(*) AS alternates FROM marked WHERE NOT is_canonical GROUP BY 1")
def alternate_analytes(s):
    return rollup.alternate_rows(s.marked).groupBy("report_id").agg(F.count(F.lit(1)).alias("alternates"))


@query("report_counters", """SELECT report_id, count(*) AS total_parsed, count(*) FILTER (WHERE direction IN ('high', 'low')) AS total_abnormal,
  count(*) || '/' || count(*) || ' analytes parsed, ' || (count(*) FILTER (WHERE direction IN ('high', 'low'))) || ' abnormal detected' AS coverage_score FROM itp GROUP BY 1""")
def report_counters(s):
    return rollup.report_counters(s.interpreted)


@query("row_states", f"SELECT {KEY}, st = 'classified' AS classified, st = 'classified' AND (severity IN ('moderate', 'critical') OR is_panic) AS attention, abn, unclear, abn AND low_prio AS minor, low_prio FROM canon")
def row_states(s):
    return s.canonical.select(*K, rollup.is_classified().alias("classified"), rollup.needs_attention().alias("attention"), rollup.is_abnormal().alias("abn"),
                              rollup.is_unclear().alias("unclear"), rollup.is_minor().alias("minor"), it.low_priority(F.col("test_name")).alias("low_prio"))


@query("summary_attention", "SELECT report_id, count(*) FILTER (WHERE is_panic OR severity IN ('moderate', 'critical')) AS attention, count(*) FILTER (WHERE unclear) AS unclear FROM canon GROUP BY 1")
def summary_attention(s):
    return s.canonical.groupBy("report_id").agg(F.count_if(rollup.serious()).alias("attention"), F.count_if(rollup.is_unclear()).alias("unclear"))


@query("display_severity", f"SELECT {KEY}, CASE WHEN severity_raw IN ('moderate', 'critical') AND {ch.LOW_PRIORITY('test_name')} THEN 'mild' ELSE severity_raw END AS shown FROM itp")
def display_severity(s):
    return s.interpreted.select(*K, it.display_severity(F.col("test_name"), F.col("severity_raw")).alias("shown"))


@query("report_status", "SELECT report_id, overall_status, indeterminate_count FROM rstat")
def report_status(s):
    return rollup.report_status(s.canonical)


_PLACE = "CASE topic " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(fa.TOPICS)) + " ELSE 99 END"


_TOPIC_GROUPS = f"""SELECT report_id, topic, abnormal_count, indeterminate_count, minor_count, total_count, {ch.STATUS.format('sr')} AS status,
  CASE WHEN abnormal_count + indeterminate_count + minor_count = 0 THEN 'All normal (' || total_count || ')' ELSE concat_ws(' · ', CASE WHEN abnormal_count > 0 THEN abnormal_count || ' of ' || total_count || ' worth follow-up' END,
    CASE WHEN minor_count > 0 THEN minor_count || ' minor' END, CASE WHEN indeterminate_count > 0 THEN indeterminate_count || ' unclear' END) END AS summary,
  row_number() OVER (PARTITION BY report_id ORDER BY sr DESC, abnormal_count DESC, {_PLACE}, topic) AS topic_rank FROM topics"""


@query("topic_groups", _TOPIC_GROUPS)
def topic_groups(s):
    return rollup.topic_groups(s.canonical)


_WDEV = "coalesce(CASE WHEN rng_high > rng_low THEN CASE WHEN value_num < rng_low THEN (rng_low - value_num) / (rng_high - rng_low) WHEN value_num > rng_high THEN (value_num - rng_high) / (rng_high - rng_low) END END, 0)"


@query("topic_row_order", f"""SELECT {KEY}, health_topic AS topic, row_number() OVER (PARTITION BY report_id, health_topic ORDER BY CASE WHEN abn THEN 0 WHEN unclear THEN 1 ELSE 2 END, is_panic DESC,
  {ch.SEV.format('severity')} DESC, {_WDEV} DESC, lower(test_name) COLLATE "C", page_num, row_idx) AS rank_in_topic FROM canon""".replace(' COLLATE "C"', ""))
def topic_row_order(s):
    return rollup.rank_within_topics(s.canonical).select(*K, "topic", "rank_in_topic")


@query("top_findings", f"SELECT {KEY}, finding_rank, test_name FROM fnd")
def top_findings(s):
    return rollup.top_findings(s.canonical).select(*K, "finding_rank", "test_name")


@query("finding_fields", f"""SELECT {KEY}, CASE WHEN direction IN ('high', 'low') THEN direction ELSE 'indeterminate' END AS finding_direction, CASE WHEN severity IN ('mild', 'moderate', 'critical') THEN severity ELSE 'mild' END AS finding_severity,
  CASE direction WHEN 'high' THEN 'direction.high' WHEN 'low' THEN 'direction.low' ELSE 'direction.needs_review' END AS plain_language_key, nullif(unit, '') AS finding_unit FROM itp""")
def finding_fields(s):
    return s.interpreted.withColumns(rollup.finding_fields()).select(*K, "finding_direction", "finding_severity", "plain_language_key", "finding_unit")


ch.cte("fnames", r"""SELECT report_id, list(test_name ORDER BY finding_rank) AS names,
  list(regexp_replace(trim(split_part(trim(regexp_replace(trim(test_name), '\s*\([^)]*\)', '', 'g')), ',', 1)), '\s+', ' ', 'g') ORDER BY finding_rank) AS short FROM fnd GROUP BY 1""")
_JOIN = "CASE len(short) WHEN 1 THEN short[1] WHEN 2 THEN short[1] || ' and ' || short[2] ELSE short[1] || ', ' || short[2] || ', and ' || short[3] END"
_HEAD = ch.case_map("overall_status", lx.HEADLINES.items())
ch.cte("rsum", f"""SELECT r.report_id, r.overall_status, r.indeterminate_count, {_HEAD} AS headline, coalesce(f.names, []) AS names, CASE WHEN r.indeterminate_count > 0 THEN 'summary.indeterminate.note' END AS uncertainty_note_key,
  CASE WHEN overall_status = 'green' OR f.names IS NULL THEN NULL WHEN overall_status = 'red' THEN 'Talk to a doctor about ' || {_JOIN} || '.' ELSE 'At your next routine visit, ask about ' || {_JOIN} || '.' END AS next_step_detailed
  FROM rstat r LEFT JOIN fnames f USING (report_id)""")


@query("report_summary", "SELECT report_id, overall_status, indeterminate_count, headline, names, uncertainty_note_key, next_step_detailed FROM rsum")
def report_summary(s):
    return rollup.report_summary(s.canonical).select("report_id", "overall_status", "indeterminate_count", "headline",
                                                     F.transform("top_findings", lambda x: x.test_name).alias("names"), "uncertainty_note_key", "next_step_detailed")


@query("next_steps", "SELECT report_id, overall_status, next_step_detailed FROM rsum WHERE next_step_detailed IS NOT NULL")
def next_steps(s):
    return rollup.report_summary(s.canonical).filter("next_step_detailed is not null").select("report_id", "overall_status", "next_step_detailed")


@query("fallback_headlines", "SELECT overall_status, headline, count(*) AS n_reports FROM rsum GROUP BY ALL")
def fallback_headlines(s):
    return rollup.report_status(s.canonical).groupBy("overall_status").agg(F.count(F.lit(1)).alias("n_reports")).withColumn(
        "headline", rollup.fallback_headline(F.col("overall_status")))


@query("name_lists", f"SELECT report_id, {_JOIN} AS listed FROM fnames")
def name_lists(s):
    f = rollup.top_findings(s.canonical).groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("finding_rank", "test_name"))).alias("l"))
    return f.select("report_id", tx.join_with_and(F.transform("l", lambda x: tx.short_name(x["test_name"]))).alias("listed"))


@query("distribution", "SELECT facet, value, count(*) AS n FROM (SELECT unnest(['direction', 'severity', 'section_type', 'verification_verdict']) AS facet, unnest([direction, severity, section_type, verification_verdict]) AS value FROM itp) GROUP BY ALL")
def distribution(s):
    return rollup.distribution(s.interpreted)


@query("serious_reports", "SELECT report_id, bool_or(is_panic OR severity IN ('moderate', 'critical')) AS serious FROM itp GROUP BY 1")
def serious_reports(s):
    return s.interpreted.groupBy("report_id").agg(F.bool_or(rollup.serious()).alias("serious"))


@query("inferred_topics", "SELECT report_id, count(*) AS tagged, count(*) FILTER (WHERE topic_inferred) AS inferred FROM itp GROUP BY 1")
def inferred_topics(s):
    return rollup.inferred_topics(s.interpreted)


_PANEL_ROWS = """SELECT report_id, panel_name, expected, list_sort(list_intersect(expected, have)) AS present, list_sort(list_filter(expected, lambda x: NOT list_contains(have, x))) AS missing
  FROM (SELECT report_id, list(DISTINCT loinc_code) FILTER (WHERE loinc_code IS NOT NULL) AS have FROM itp GROUP BY 1), panels WHERE len(list_intersect(expected, have)) >= 2"""


@query("panel_completeness", _PANEL_ROWS)
def panel_completeness(s):
    return rollup.panel_completeness(s.interpreted, s.know.panels)


# the shipped bands leave no gaps, so every band is moved up by three to make some
@query("band_gaps", """SELECT g.loinc_code, g.band, g.next_band, coalesce(n, 0) AS n_rows FROM (SELECT loinc_code, b.band, b.high, lead(b.low + 3) OVER w AS next_low, lead(b.band) OVER w AS next_band
  FROM (SELECT loinc_code, unnest(bands) AS b FROM rules) WINDOW w AS (PARTITION BY loinc_code ORDER BY b.low, b.high, b.band)) g
  LEFT JOIN (SELECT loinc_code, count(*) AS n FROM itp GROUP BY 1) i ON i.loinc_code = g.loinc_code WHERE g.next_low > g.high + 1""")
def band_gaps(s):
    moved = dims.numeric_rules(s.spark)
    moved = moved.withColumn("severity_bands", F.transform("severity_bands", lambda b: b.withField("low", b["low"] + 3)))
    counts = s.interpreted.groupBy("loinc_code").agg(F.count(F.lit(1)).alias("n"))
    return rollup.band_gaps(moved).join(counts, "loinc_code", "left").select("loinc_code", "band", "next_band", F.coalesce("n", F.lit(0).cast("long")).alias("n_rows"))


# ---- explanations --------------------------------------------------------

_VAL = "coalesce(value_num::VARCHAR, value_text)"


@query("explain_candidates", f"SELECT {KEY}, direction FROM itp WHERE direction NOT IN ('in-range', 'indeterminate')")
def explain_candidates(s):
    return explain.candidates(s.interpreted).select(*K, "direction")


@query("row_explanations", f"SELECT {KEY}, test_name, test_name || ' is ' || direction || ' (value: ' || {_VAL} || ' ' || coalesce(unit, 'None') || ')' AS summary, 'Please consult your healthcare provider.' AS next_steps FROM itp WHERE direction NOT IN ('in-range', 'indeterminate')")
def row_explanations(s):
    return explain.row_templates(s.interpreted).select(*K, "test_name", "summary", "next_steps")


@query("block_explanations", "SELECT report_id, page_num, block_id, 'HbA1c result: ' || diabetes_category AS summary FROM hblocks")
def block_explanations(s):
    return explain.block_templates(s.blocks).select("report_id", "page_num", "block_id", "summary")


@query("explanation_quality", "SELECT report_id, count(*) AS total, count(*) FILTER (WHERE row_idx % 3 <> 0) AS llm_generated, count(*) FILTER (WHERE row_idx % 3 = 0) AS fallback_used FROM itp WHERE direction NOT IN ('in-range', 'indeterminate') GROUP BY 1")
def explanation_quality(s):
    e = explain.row_templates(s.interpreted).withColumn("is_fallback", F.col("row_idx") % 3 == 0)
    return explain.explanation_quality(e)


ch.cte("expl", f"""SELECT report_id, test_name, arg_min(summary, {{'p': page_num, 'r': row_idx}}) AS summary FROM (SELECT *, test_name || ' is ' || direction || ' (value: ' || {_VAL} || ' ' || coalesce(unit, 'None') || ')' AS summary
  FROM itp WHERE direction NOT IN ('in-range', 'indeterminate')) GROUP BY 1, 2""")


@query("explanation_lookup", f"SELECT i.report_id, i.page_num, i.row_idx, e.summary FROM itp i LEFT JOIN expl e USING (report_id, test_name)")
def explanation_lookup(s):
    return explain.with_explanations(s.interpreted, explain.row_templates(s.interpreted)).select(*K, F.col("explanation.summary").alias("summary"))


@query("compact_report", "SELECT i.report_id, i.page_num, i.row_idx, i.test_name AS name, i.value_num, i.unit, i.rng_low AS ref_low, i.rng_high AS ref_high, i.direction, i.severity, i.is_panic, i.health_topic, e.summary FROM canon i LEFT JOIN expl e USING (report_id, test_name)")
def compact_report(s):
    return explain.compact_rows(s.canonical, explain.row_templates(s.interpreted)).select(
        *K, "name", "value_num", "unit", "ref_low", "ref_high", "direction", "severity", "is_panic", "health_topic", F.col("explanation.summary").alias("summary"))


_RANKED = f"""(SELECT *, row_number() OVER (PARTITION BY report_id, health_topic ORDER BY CASE WHEN abn THEN 0 WHEN unclear THEN 1 ELSE 2 END, is_panic DESC,
  {ch.SEV.format('severity')} DESC, {_WDEV} DESC, lower(test_name), page_num, row_idx) AS rank_in_topic FROM canon)"""


@query("explanation_inputs", f"""SELECT report_id, health_topic AS topic, rank_in_topic, test_name, direction, value_num, health_topic AS related, '- ' || norm_key AS snippets
  FROM {_RANKED} JOIN (SELECT test_name, norm_key FROM names) USING (test_name) WHERE direction NOT IN ('in-range', 'indeterminate')""")
def explanation_inputs(s):
    """The written payloads, read back as rows."""
    ctx = s.names.select("test_name", F.array("health_topic").alias("related"), F.array().cast("array<string>").alias("conditions"),
                         F.array().cast("array<string>").alias("follow_ups"), F.array("norm_key").alias("snippets"))
    made = explain.explanation_inputs(rollup.rank_within_topics(s.canonical), ctx)
    items = made.select("report_id", "topic", F.explode(F.from_json("payload", "array<struct<rank_in_topic:bigint,evidence:string,context:struct<related:array<string>>,snippets:string>>")).alias("i"))
    e = F.from_json("i.evidence", "test_name string, direction string, value_num double")
    return items.withColumn("e", e).select("report_id", "topic", "i.rank_in_topic", "e.test_name", "e.direction", "e.value_num", F.col("i.context.related")[0].alias("related"), "i.snippets")


# ---- exports -------------------------------------------------------------

_EXPORT = f"report_id, test_name, {_VAL} AS value, unit, direction, severity, {{0}}is_panic, actionability, confidence, rng_low AS reference_range_low, rng_high AS reference_range_high, range_source, range_trust"


@query("export_frame", f"SELECT {_EXPORT.format('classification_state, ')} FROM canon")
def export_frame(s):
    return io.export_frame(s.canonical)


@query("audit_frame", f"SELECT {_EXPORT.format('')}, loinc_code, section_type, verification_verdict, unit_conf AS unit_confidence FROM canon")
def audit_frame(s):
    return io.export_frame(s.canonical, tuple(lx.AUDIT_COLUMNS))


@query("csv_round_trip", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE direction = 'high') AS n_high FROM canon")
def csv_round_trip(s):
    path = f"{ensure_checkpoint_dir(s.spark)}/csv-{uuid.uuid4().hex}"
    io.write_csv(s.canonical, path)
    back = s.spark.read.csv(path, header=True)
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("direction") == "high").alias("n_high"))


@query("report_payload", f"""SELECT report_id, health_topic AS topic, rank_in_topic, test_name, value_num, unit, direction, severity, confidence FROM {_RANKED}
  UNION ALL SELECT report_id, '', -1, r.headline, r.indeterminate_count, NULL, r.overall_status, NULL, NULL FROM rsum r""")
def report_payload(s):
    """The written payloads, read back as rows; a report's head record has no topic."""
    made = reports.payload_parts(s.rolled)
    item = "rank_in_topic bigint, test_name string, value_num double, unit string, direction string, severity string, confidence string"
    rows = made.filter("part >= 0").select("report_id", "topic", F.inline(F.from_json("payload", f"array<struct<{item.replace(' ', ':').replace(',:', ',')}>>")))
    head = F.from_json("payload", "headline string, indeterminate_count double, overall_status string")
    top = made.filter("part < 0").select("report_id", "topic", head.alias("h")).select(
        "report_id", "topic", F.lit(-1).cast("long").alias("rank_in_topic"), F.col("h.headline").alias("test_name"), F.col("h.indeterminate_count").alias("value_num"),
        F.lit(None).cast("string").alias("unit"), F.col("h.overall_status").alias("direction"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("confidence"))
    return rows.unionByName(top)


def _result(s):
    """The result over the lab view, with the screening results of the text queries."""
    merged = sc.canonicalise(sc.merge_results(screening_table(s)))
    told = explain.all_explanations(s.interpreted, s.blocks, merged)
    return payload.Result(s.interpreted, s.rolled, s.blocks, merged, told, s.cleaned.counts, payload.page_counts(s.lab))


#: of each part: fields of its items, and what the columns name, t1, t2, n1, n2 compare
_PARTS = {
    "summary": ("headline string, overall_status string, next_step_detailed string, indeterminate_count double, top_findings array<struct<test_name:string>>",
                ["headline", "overall_status", "next_step_detailed", "indeterminate_count", "size(top_findings)"]),
    "coverage": ("coverage_score string, total_parsed double, total_abnormal double", ["coverage_score", "null", "null", "total_parsed", "total_abnormal"]),
    "explanation_quality": ("total double, llm_generated double, fallback_used double", ["null", "null", "null", "total", "fallback_used"]),
    "extraction_diagnostics": ("raw_extracted_count double, filtered_noise_count double, page_count string",
                               ["page_count", "null", "null", "raw_extracted_count", "filtered_noise_count"]),
    "language": ("language string, disclaimer string", ["disclaimer", "language", "null", "null", "null"]),
    "topic_groups": ("topic_rank double, topic string, status string, summary string, total_count double", ["summary", "status", "topic", "topic_rank", "total_count"]),
    "values": ("rank_in_topic double, test_name string, direction string, confidence string, value_num double",
               ["test_name", "direction", "confidence", "rank_in_topic", "value_num"]),
    "screening_results": ("test_type string, result_status string, organs_screened array<string>, confidence double",
                          ["test_type", "result_status", "array_join(organs_screened, '|')", "confidence", "null"]),
    "explanations": ("test_name string, summary string, next_steps string", ["test_name", "summary", "next_steps", "null", "null"]),
    "panels": ("panel_name string, present array<string>, missing array<string>", ["panel_name", "array_join(present, '|')", "array_join(missing, '|')", "null", "null"]),
    "audit.hplc_blocks": ("ngsp_value double, eag_value double, diabetes_category string, cross_check_passed string, consistency_flags array<string>",
                          ["diabetes_category", "array_join(consistency_flags, '|')", "cross_check_passed", "ngsp_value", "eag_value"]),
    "audit.verification_verdicts": ("page_num double, row_idx double, test_name string, verdict string, provenance string",
                                    ["test_name", "verdict", "provenance", "page_num", "row_idx"]),
    "audit.deduped_alternates": ("page_num double, row_idx double, test_name string, direction string, section_type string",
                                 ["test_name", "direction", "section_type", "page_num", "row_idx"])}


def _read_part(made, part):
    fields, compared = _PARTS[part]
    kinds = ["string"] * 3 + ["double"] * 2
    return payload.read_part(made, part, fields).selectExpr(
        "report_id", f"'{part}' AS part", "record_topic", *[f"CAST({e} AS {k}) AS {n}" for e, k, n in zip(compared, kinds, ["name", "t1", "t2", "n1", "n2"])])


ch.cte("reps", "SELECT report_id, count(DISTINCT page_num) AS pages FROM lab GROUP BY 1")
ch.cte("scrm", """SELECT report_id, test_type, arg_min(result_status, {'c': -confidence, 'p': page_num}) AS result_status, max(confidence) AS confidence FROM scr GROUP BY 1, 2""")
ch.cte("scro", """SELECT report_id, test_type, string_agg(o, '|' ORDER BY pos) AS organs FROM (SELECT report_id, test_type, arg_min(o, pos) AS o, min(pos) AS pos FROM (
    SELECT report_id, test_type, trim(unnest(organs)) AS o, {'p': page_num, 'i': unnest([1, 2, 3])} AS pos FROM scr) WHERE lower(o) <> 'screening' AND length(o) >= 2
    GROUP BY report_id, test_type, lower(o)) GROUP BY 1, 2""")
ch.cte("told", f"""SELECT report_id, '1-values' AS kind, test_name, test_name || ' is ' || direction || ' (value: ' || {_VAL} || ' ' || coalesce(unit, 'None') || ')' AS summary,
    'Please consult your healthcare provider.' AS next_steps FROM itp WHERE direction NOT IN ('in-range', 'indeterminate')
  UNION ALL SELECT report_id, '2-blocks', 'HbA1c', 'HbA1c result: ' || diabetes_category, 'Follow up with your doctor for guidance.' FROM hblocks
  UNION ALL SELECT report_id, '3-screening', test_type, test_type || ' screening: ' || replace(result_status, '_', ' '), 'Continue routine screening as recommended.' FROM scrm""")
_PART_SQL = [f"""SELECT report_id, 'summary' AS part, '' AS record_topic, coalesce(headline, '{lx.HEADLINES["green"]}') AS name, coalesce(overall_status, 'green') AS t1, next_step_detailed AS t2,
    coalesce(indeterminate_count, 0)::DOUBLE AS n1, coalesce(len(names), 0)::DOUBLE AS n2 FROM reps LEFT JOIN rsum USING (report_id)""",
             """SELECT report_id, 'coverage', '', n || '/' || n || ' analytes parsed, ' || b || ' abnormal detected', NULL, NULL, n, b FROM (SELECT report_id, count(direction) AS n,
    count(*) FILTER (WHERE direction IN ('high', 'low')) AS b FROM reps LEFT JOIN itp USING (report_id) GROUP BY 1)""",
             "SELECT report_id, 'explanation_quality', '', NULL, NULL, NULL, count(kind), count(kind) FROM reps LEFT JOIN told USING (report_id) GROUP BY 1",
             """SELECT report_id, 'extraction_diagnostics', '', any_value(pages)::VARCHAR, NULL, NULL, count(is_noise), count(*) FILTER (WHERE is_noise) FROM reps LEFT JOIN noised USING (report_id) GROUP BY 1""",
             f"SELECT report_id, 'language', '', '{lx.DISCLAIMERS['en']}', 'en', NULL, NULL, NULL FROM reps",
             f"SELECT report_id, 'topic_groups', '', summary, status, topic, topic_rank, total_count FROM ({_TOPIC_GROUPS})",
             f"SELECT report_id, 'values', health_topic, test_name, direction, confidence, rank_in_topic, value_num FROM {_RANKED}",
             "SELECT report_id, 'screening_results', '', test_type, result_status, coalesce(organs, ''), confidence, NULL FROM scrm LEFT JOIN scro USING (report_id, test_type)",
             "SELECT report_id, 'explanations', kind, test_name, summary, next_steps, NULL, NULL FROM told",
             f"SELECT report_id, 'panels', '', panel_name, array_to_string(present, '|'), array_to_string(missing, '|'), NULL, NULL FROM ({_PANEL_ROWS})",
             """SELECT report_id, 'audit.hplc_blocks', '', diabetes_category, array_to_string(consistency_flags, '|'), cross_check_passed::VARCHAR, ngsp.value, eag.value FROM hblocks""",
             "SELECT report_id, 'audit.verification_verdicts', '', test_name, verdict3, 'deterministic', page_num, row_idx FROM itp",
             "SELECT report_id, 'audit.deduped_alternates', '', test_name, direction, section_type, page_num, row_idx FROM marked WHERE NOT is_canonical"]


@query("report_payload_parts", " UNION ALL ".join(_PART_SQL))
def report_payload_parts(s):
    """Every part of the written records, read back as rows."""
    made = saved(payload.records(payload.whole_items(_result(s))), "payload")
    return reduce(DataFrame.unionByName, [_read_part(made, part) for part in _PARTS])


@query("compact_report_parts", """SELECT report_id, 'values' AS part, test_name AS name, direction AS t1, summary AS t2 FROM canon LEFT JOIN (SELECT report_id, test_name, arg_min(summary, kind) AS summary
    FROM (SELECT report_id, test_name, summary, '1' AS kind FROM expl UNION ALL SELECT report_id, 'HbA1c', arg_min('HbA1c result: ' || diabetes_category, {'p': page_num, 'b': block_id}), '2' FROM hblocks GROUP BY 1
    UNION ALL SELECT report_id, test_name, summary, '3' FROM told WHERE kind = '3-screening') GROUP BY 1, 2) USING (report_id, test_name)
  UNION ALL SELECT report_id, 'summary', headline, overall_status, next_step_detailed FROM (SELECT report_id, coalesce(headline, '""" + lx.HEADLINES["green"] + """') AS headline,
    coalesce(overall_status, 'green') AS overall_status, next_step_detailed FROM reps LEFT JOIN rsum USING (report_id))
  UNION ALL SELECT report_id, 'screening_results', test_type, result_status, NULL FROM scrm
  UNION ALL SELECT report_id, 'panels', panel_name, array_to_string(present, '|'), NULL FROM (""" + _PANEL_ROWS + """)
  UNION ALL SELECT report_id, 'hplc', diabetes_category, cross_check_passed::VARCHAR, NULL FROM hblocks""")
def compact_report_parts(s):
    made = saved(payload.records(payload.compact_items(_result(s))), "compact")
    parts = [("values", "name string, direction string, explanation struct<summary:string>", "direction", "explanation.summary"),
             ("summary", "headline string, overall_status string, next_step_detailed string", "overall_status", "next_step_detailed"),
             ("screening_results", "test_type string, result_status string, followup string", "result_status", "followup"),
             ("panels", "panel_name string, present array<string>", "array_join(present, '|')", "cast(null as string)"),
             ("hplc", "diabetes_category string, cross_check_passed string", "cross_check_passed", "cast(null as string)")]
    return reduce(DataFrame.unionByName, [payload.read_part(made, part, fields).selectExpr(
        "report_id", f"'{part}' AS part", f"{fields.split()[0]} AS name", f"{a} AS t1", f"{b} AS t2") for part, fields, a, b in parts])


@query("full_analysis", f"""SELECT r.report_id, r.overall_status, r.indeterminate_count, r.headline, c.total_parsed, c.total_abnormal FROM rsum r
  JOIN (SELECT report_id, count(*) AS total_parsed, count(*) FILTER (WHERE direction IN ('high', 'low')) AS total_abnormal FROM itp GROUP BY 1) c USING (report_id)""")
def full_analysis(s):
    rolled = reports.analyse(s.lab, s.know, rows_per_chunk=POSITIONS_PER_PAGE)[2]
    return rolled.summary.join(rolled.counters, "report_id").select("report_id", "overall_status", "indeterminate_count", "headline", "total_parsed", "total_abnormal")


@query("status_of_reports", f"SELECT report_id, overall_status, indeterminate_count FROM rstat")
def status_of_reports(s):
    return s.rolled.summary.select("report_id", "overall_status", "indeterminate_count")
