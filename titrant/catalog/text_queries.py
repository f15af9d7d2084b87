"""Queries of the text, grounding, parsing and screening operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from titrant.catalog import chain as ch
from titrant.catalog.registry import query
from titrant.fixed import lexicons as lx, safety as fs
from titrant.functions import text as tx
from titrant.operators import explain, grounding as gr, rollup, screening as sc, sections
from titrant.plans import checks
from titrant.sources import dims, parse

# Words of the driver corpus that stand in for the real keywords.
SCREEN_WORDS, APPENDIX_WORDS = ["que", "pour", "und", "that"], ["elle", "avec", "der", "this", "with"]
DRUG_WORDS = ["tion", "der", "queque", "heron"]
SYMPTOMS = {"en": ["the", "was whe"], "vn": ["der"], "fr": ["que", "pour"], "ar": ["und"]}
LANG = "CASE conv_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'vn' ELSE 'de' END"

# DuckDB patterns know ASCII letters only: other letters are folded to `_`,
# which is a word character to both, and compared in that form.
def fold_ascii(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '[^\x00-\x7F]', '_', 'g'), '_+', '_', 'g')"


def folded(c):
    return F.regexp_replace(F.regexp_replace(c, r"[^\x00-\x7F]", "_"), "_+", "_")


def _redact(c: str, patterns) -> str:
    for p, tag in patterns:
        c = f"regexp_replace({c}, '{p}', '{tag}', 'g')"
    return c


@query("report_text_redaction", f"SELECT doc_id, {_redact(fold_ascii('text'), lx.REPORT_PII)} AS redacted FROM documents", False)
def report_text_redaction(s):
    return s.table("documents").select("doc_id", folded(tx.redact_report_text(F.col("text"))).alias("redacted"))


@query("question_redaction", f"SELECT conv_id, turn, {_redact(fold_ascii('trim(text)'), lx.QUESTION_PII)} AS question FROM conversations", False)
def question_redaction(s):
    return gr.clean_questions(s.table("conversations"), clip=1_000_000).select("conv_id", "turn", folded(F.col("question")).alias("question"))


def _found(t: str, ws) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({t}, '\\b{ch.esc(w)}\\b') THEN '{w}' END" for w in sorted(ws)) + "], lambda x: x IS NOT NULL)"


@query("page_classes", f"""SELECT doc_id, CASE WHEN len(s) >= 2 THEN 'screening_attachment' WHEN len(a) >= 3 THEN 'appendix_text' END AS section,
  CASE WHEN len(s) >= 2 THEN least(0.9 + 0.02 * len(s), 0.98) WHEN len(a) >= 3 THEN least(0.85 + 0.02 * len(a), 0.95) END AS confidence,
  CASE WHEN len(s) >= 2 THEN s WHEN len(a) >= 3 THEN a ELSE [] END AS keywords
  FROM (SELECT doc_id, {_found("t", SCREEN_WORDS)} AS s, {_found("t", APPENDIX_WORDS)} AS a FROM (SELECT doc_id, {fold_ascii("lower(text)")} AS t FROM documents))""", False)
def page_classes(s):
    c = sections.page_class(F.col("text"), SCREEN_WORDS, APPENDIX_WORDS)
    return s.table("documents").withColumn("c", c).select("doc_id", "c.section", "c.confidence", "c.keywords")


@query("screening_types", "SELECT doc_id, CASE WHEN contains(lower(text), 'queque') THEN 'A' WHEN contains(lower(text), 'pour') OR contains(lower(text), 'und') THEN 'B' ELSE 'Unknown' END AS test_type FROM documents", False)
def screening_types(s):
    return s.table("documents").select("doc_id", sc.test_type(F.col("text"), [("A", ["queque"]), ("B", ["pour", "und"])]).alias("test_type"))


@query("screening_status", "SELECT doc_id, CASE WHEN contains(lower(text), 'queque') OR contains(lower(text), 'avec') THEN 'not_detected' WHEN contains(lower(text), 'que') THEN 'detected' ELSE 'indeterminate' END AS result_status FROM documents", False)
def screening_status(s):
    return s.table("documents").select("doc_id", sc.keyword_status(F.col("text"), ["queque", "avec"], ["que"]).alias("result_status"))


_TYPES = [("A", ["hba1c"]), ("B", ["hemoglobin", "queque"])]


@query("screening_from_rows", """SELECT d.report_id, d.page_num, CASE WHEN contains(t, 'hba1c') THEN 'A' WHEN contains(t, 'hemoglobin') OR contains(t, 'queque') THEN 'B' ELSE 'Unknown' END AS test_type,
  CASE WHEN contains(v, 'negative') THEN 'not_detected' WHEN contains(v, 'reactive') THEN 'detected' ELSE 'indeterminate' END AS result_status FROM (
  SELECT d.report_id, d.page_num, lower(d.text) || ' ' || coalesce(string_agg(lower(test_name || ' ' || coalesce(ref_text, '')), ' '), '') AS t,
    lower(d.text) || ' ' || coalesce(string_agg(lower(test_name || ' ' || coalesce(value_text, value_num::VARCHAR)), ' '), '') AS v
  FROM (SELECT doc_id AS report_id, 1 AS page_num, text FROM documents) d LEFT JOIN kept k ON k.report_id = d.report_id AND k.page_num = d.page_num GROUP BY d.report_id, d.page_num, d.text) d""")
def screening_from_rows(s):
    pages = s.table("documents").select(F.col("doc_id").alias("report_id"), F.lit(1).alias("page_num"), F.col("text").alias("raw_text"))
    out = sc.from_keywords(pages, s.rows, _TYPES, ["negative"], ["reactive"])
    return out.select("report_id", "page_num", "test_type", "result_status")


ch.cte("scr", """SELECT doc_id // 7 AS report_id, doc_id % 7 AS page_num, CASE doc_id % 2 WHEN 0 THEN 'SPOT-MAS' ELSE 'Galleri' END AS test_type, lang AS result_status,
  [source, lang, CASE doc_id % 3 WHEN 0 THEN 'screening' ELSE ' Lung' END] AS organs, CASE WHEN doc_id % 4 > 0 THEN source END AS limitations, CASE doc_id % 5 WHEN 1 THEN 0.85 ELSE 0.5 END AS confidence FROM documents""")


def screening_table(s):
    d = F.col("doc_id")
    return s.table("documents").select(
        F.floor(d / 7).alias("report_id"), (d % 7).alias("page_num"), F.when(d % 2 == 0, "SPOT-MAS").otherwise("Galleri").alias("test_type"),
        F.col("lang").alias("result_status"), F.lit(None).cast("string").alias("signal_origin"),
        F.array("source", "lang", F.when(d % 3 == 0, "screening").otherwise(" Lung")).alias("organs_screened"),
        F.when(d % 4 > 0, F.col("source")).alias("limitations"), F.lit(None).cast("string").alias("followup_recommendation"),
        F.lit(None).cast("string").alias("raw_text"), F.when(d % 5 == 1, 0.85).otherwise(0.5).alias("confidence"))


@query("screening_merge", """SELECT report_id, test_type, arg_min(result_status, {'c': -confidence, 'p': page_num}) AS result_status, max(confidence) AS confidence,
  coalesce(max(length(limitations)), 0) AS limitations_length FROM scr GROUP BY 1, 2""")
def screening_merge(s):
    return sc.merge_results(screening_table(s)).select("report_id", "test_type", "result_status", "confidence",
                                                       F.coalesce(F.length("limitations"), F.lit(0)).alias("limitations_length"))


@query("screening_organs", """SELECT report_id, test_type, list(organ ORDER BY pos) AS organs FROM (SELECT report_id, test_type, organ, min({'p': page_num, 'i': i}) AS pos
  FROM (SELECT report_id, test_type, page_num, unnest(organs) AS organ, unnest([1, 2, 3]) AS i FROM scr) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def screening_organs(s):
    return sc.merge_results(screening_table(s)).select("report_id", "test_type", F.col("organs_screened").alias("organs"))


@query("screening_canonical", "SELECT doc_id, list_filter([source, lang, trim(CASE doc_id % 3 WHEN 0 THEN 'screening' ELSE ' Lung' END)], lambda x: lower(x) <> 'screening' AND length(x) >= 2) AS organs FROM documents", False)
def screening_canonical(s):
    d = s.table("documents").withColumn("o", F.array("source", "lang", F.when(F.col("doc_id") % 3 == 0, "screening").otherwise(" Lung"), F.upper("source")))
    return d.select("doc_id", sc.canonical_organs(F.col("o")).alias("organs"))


@query("screening_followups", """SELECT doc_id, '1. ' || source || chr(10) || '2. ' || lang AS followup FROM documents""", False)
def screening_followups(s):
    raw = F.concat(F.lit("3. "), "source", F.lit("\n 7.  "), "lang", F.lit(" "))
    return s.table("documents").select("doc_id", sc.canonical_followup(raw).alias("followup"))


@query("screening_explanations", "SELECT report_id, test_type || ' screening: ' || replace(result_status, '_', ' ') AS summary FROM (SELECT doc_id AS report_id, 'SPOT-MAS' AS test_type, CASE WHEN lang = 'en' THEN 'not_detected' ELSE 'detected' END AS result_status FROM documents)", False)
def screening_explanations(s):
    d = s.table("documents").select(F.col("doc_id").alias("report_id"), F.lit("SPOT-MAS").alias("test_type"),
                                    F.when(F.col("lang") == "en", "not_detected").otherwise("detected").alias("result_status"))
    return explain.screening_templates(d).select("report_id", "summary")


# ---- denied wording ------------------------------------------------------

@query("denied_wording", r"SELECT doc_id, regexp_matches(t, '(?i)\b(?:que la|the of|der und)\b') AS denied FROM (SELECT doc_id, %s AS t FROM documents)" % fold_ascii("text"), False)
def denied_wording(s):
    return s.table("documents").select("doc_id", gr.denied_wording(F.col("text"), [r"\bque la\b", r"\bthe of\b", r"\bder und\b"]).alias("denied"))


_DRUGS = "(" + ", ".join(f"'{d}'" for d in DRUG_WORDS) + ")"


@query("drug_or_dose", rf"""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-zA-Z]+'), lambda w: w IN {_DRUGS})) > 0
  OR regexp_matches({fold_ascii('text')}, '(?i)\b\d+\s*(mg|mcg|ug|g|ml|iu|units?)(?:$|[^/\w])') AS hit FROM documents""", False)
def drug_or_dose(s):
    return s.table("documents").select("doc_id", gr.drug_or_dose(F.col("text"), DRUG_WORDS).alias("hit"))


@query("drug_mentions", f"SELECT word, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z]+')) AS word FROM documents) WHERE word IN {ch.words(fs.DRUG_NAMES + DRUG_WORDS)} GROUP BY 1", False)
def drug_mentions(s):
    names = fs.DRUG_NAMES + DRUG_WORDS
    words = s.table("documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-zA-Z]+"), F.lit(0)))).alias("word"))
    return words.filter(F.col("word").isin(*names)).groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))


@query("comparative_ratios", r"SELECT event_id, regexp_matches(t, '(?i)\b\d+(?:\.\d+)?\s*(?:×|x|times)\s*(?:normal|the (?:upper|lower) (?:limit|range|bound))') AS hit FROM (SELECT event_id, 'at ' || (event_id % 9) || CASE event_id % 3 WHEN 0 THEN 'x normal' WHEN 1 THEN ' times the upper limit' ELSE ' x high' END AS t FROM events)", False)
def comparative_ratios(s):
    e = F.col("event_id")
    t = F.concat(F.lit("at "), (e % 9).cast("string"), F.when(e % 3 == 0, "x normal").when(e % 3 == 1, " times the upper limit").otherwise(" x high"))
    return s.table("events").select("event_id", gr.comparative_ratio(t).alias("hit"))


def _symptom(q: str, lang: str) -> str:
    pat = lambda ws: "(?:^|\\W)(?:" + "|".join(ws) + ")(?:\\W|$)"
    return f"CASE {lang} " + " ".join(f"WHEN '{k}' THEN regexp_matches({q}, '{pat(v)}')" for k, v in SYMPTOMS.items() if k != "en") + f" ELSE regexp_matches({q}, '{pat(SYMPTOMS['en'])}') END"


@query("acute_symptoms", f"SELECT conv_id, turn, {_symptom(fold_ascii('lower(text)'), LANG)} AS hit FROM conversations", False)
def acute_symptoms(s):
    return s.table("conversations").select("conv_id", "turn", gr.acute_symptom(F.col("text"), F.expr(LANG), SYMPTOMS).alias("hit"))


@query("doctor_routing", f"""SELECT c.conv_id, c.turn, coalesce(r.serious, false) OR {_symptom(fold_ascii('lower(c.text)'), LANG)} AS routed, {ch.case_map(LANG.replace('conv_id', 'c.conv_id').join(['(', ')']), fs.DOCTOR_PHRASES.items(), ch._sql(fs.DOCTOR_PHRASES['en']))} AS phrase
  FROM conversations c LEFT JOIN (SELECT report_id, bool_or(is_panic OR severity IN ('moderate', 'critical')) AS serious FROM itp GROUP BY 1) r ON r.report_id = c.conv_id""")
def doctor_routing(s):
    r = s.interpreted.groupBy(F.col("report_id").alias("conv_id")).agg(F.bool_or(rollup.serious()).alias("serious"))
    j = s.table("conversations").join(r, "conv_id", "left")
    lang = F.expr(LANG)
    return j.select("conv_id", "turn", (F.coalesce("serious", F.lit(False)) | gr.acute_symptom(F.col("text"), lang, SYMPTOMS)).alias("routed"), gr.doctor_phrase(lang).alias("phrase"))


_REASON = "CASE event_id % 5 WHEN 0 THEN 'invented_number:' || event_id WHEN 1 THEN 'denied_verb' WHEN 2 THEN 'invalid_cite:x' WHEN 3 THEN 'schema_invalid' ELSE 'drug_or_dose' END"
_ELANG = "CASE user_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'vn' WHEN 2 THEN 'fr' WHEN 3 THEN 'ar' ELSE 'de' END"


def _refusal(lang, reason):
    pick = lambda m: ch.case_map(f"({lang})", m.items(), ch._sql(m["en"]))
    return f"CASE WHEN split_part({reason}, ':', 1) IN {ch.words(lx.VALIDATOR_REASONS)} THEN {pick(lx.VALIDATOR_FAIL)} ELSE {pick(lx.OUT_OF_SCOPE)} END"


@query("refusals", f"SELECT event_id, {_refusal(_ELANG, _REASON)} AS answer, {_REASON} AS refusal_reason, true AS refused FROM events", False)
def refusals(s):
    e = s.table("events").withColumn("r", gr.refusal(F.expr(_ELANG), F.expr(_REASON)))
    return e.select("event_id", "r.answer", "r.refusal_reason", "r.refused")


# ---- headlines -----------------------------------------------------------
# pieces of a headline per event, so that every rule is met by some event
_HEADLINE = """CASE event_id % 12 WHEN 0 THEN 'Most results look fine and a few deserve a review soon' WHEN 1 THEN 'Too short' WHEN 2 THEN 'Line one has words' || chr(10) || 'line two has words too'
  WHEN 3 THEN 'This means you have a condition worth a review with your clinician' WHEN 4 THEN 'A few results are urgent and worth a review with your clinician' WHEN 5 THEN 'Please consider aspirin and review these results with your own clinician'
  WHEN 6 THEN 'Please consider 500 mg daily and review these results with your clinician' WHEN 7 THEN 'Nothing here uses the words that this status needs to have' WHEN 8 THEN 'Your LDL result is worth a review at your next visit'
  WHEN 9 THEN 'Your TSH result is worth a review at your next visit' WHEN 10 THEN '  ' ELSE 'Discuss these results and monitor them at your next routine visit please' END"""
_STATUS = "CASE user_id % 3 WHEN 0 THEN 'yellow' WHEN 1 THEN 'orange' ELSE 'red' END"


def _headline_sql():
    st = {k: "|".join(v) for k, v in lx.STATUS_WORDS.items() if v}
    first = lambda ps, c, pre: " ".join(f"WHEN regexp_matches({c}, '(?i){p}') THEN '{pre}{p}'" for p in ps)
    drugs = " ".join(f"WHEN regexp_matches(lower(h), '(?:^|[^a-z]){d}(?:[^a-z]|$)') THEN 'drug:{d}'" for d in lx.HEADLINE_DRUGS)
    off = " ".join(f"WHEN contains(fh, '{a}') AND NOT contains('ldlcholesterol', '{a}') THEN 'off_list_analyte:{a}'" for a in lx.HEADLINE_ANALYTES)
    miss = " ".join(f"WHEN '{k}' THEN NOT regexp_matches(lower(h), '\\b(?:{v})\\b')" for k, v in st.items())
    return f"""SELECT event_id, CASE WHEN h = '' THEN 'empty' WHEN contains(h, chr(10)) THEN 'multiline' WHEN len(regexp_extract_all(h, '\\S+')) NOT BETWEEN 6 AND 25 THEN 'word_count=' || len(regexp_extract_all(h, '\\S+'))
      {first(lx.HEADLINE_DENIED, 'h', 'denied_verb:')} {first(lx.HEADLINE_ALARMIST, 'h', 'alarmist:')} {drugs} WHEN regexp_matches(h, '(?i)\\b\\d+\\s*(mg|mcg|g|ml|iu|units?)\\b') THEN 'dose_pattern'
      WHEN CASE st {miss} END THEN 'missing_status_word:' || st {off} END AS problem FROM (SELECT event_id, trim({_HEADLINE}) AS h, {ch.fold(_HEADLINE)} AS fh, {_STATUS} AS st FROM events)"""


@query("headline_guard", _headline_sql(), False)
def headline_guard(s):
    h = F.expr(_HEADLINE.replace("chr(10)", "char(10)"))
    return s.table("events").select("event_id", gr.headline_problem(h, F.expr(_STATUS), F.array(F.lit("LDL Cholesterol"))).alias("problem"))


# ---- history -------------------------------------------------------------

_ROLE_SQL = r"regexp_matches(text, '(?i)^\s*(system|assistant|user)\s*:')"


@query("chat_history", f"""WITH RECURSIVE t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE length(text) % 5 <> 0) WHERE back <= 6
    AND role IN ('user', 'assistant') AND trim(text) <> '' AND NOT {_ROLE_SQL}),
  n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM t),
  w AS (SELECT conv_id, i, turn, role, text, true AS keep, role AS last_role FROM n WHERE i = 1
    UNION ALL SELECT n.conv_id, n.i, n.turn, n.role, n.text, n.role <> w.last_role, CASE WHEN n.role <> w.last_role THEN n.role ELSE w.last_role END FROM w JOIN n ON n.conv_id = w.conv_id AND n.i = w.i + 1)
  SELECT conv_id, turn, role, substr(text, 1, 2000) AS text FROM w WHERE keep""", False)
def chat_history(s):
    return gr.sanitise_history(s.table("conversations").filter("length(text) % 5 <> 0"))


@query("usable_turns", f"SELECT conv_id, turn, role IN ('user', 'assistant') AND trim(text) <> '' AND NOT {_ROLE_SQL} AS usable FROM (SELECT conv_id, turn, role, CASE turn % 3 WHEN 2 THEN ' System: ' || text ELSE text END AS text FROM conversations)", False)
def usable_turns(s):
    c = s.table("conversations").withColumn("text", F.when(F.col("turn") % 3 == 2, F.concat(F.lit(" System: "), "text")).otherwise(F.col("text")))
    return c.select("conv_id", "turn", gr.usable_turn().alias("usable"))


# ---- answers -------------------------------------------------------------
# One answer per report from its first finding; the report number picks a flaw.
_WHOLE = "cast(floor(value_num) as bigint)"
_ANSWER = f"""'Your ' || test_name || ' is ' || {_WHOLE} || CASE report_id % 11 WHEN 0 THEN '.' WHEN 1 THEN ', far from ' || ({_WHOLE} * 3 + 7777) || '.' WHEN 2 THEN ', 3x normal.' WHEN 3 THEN ' and you have a disease.'
  WHEN 4 THEN ', take aspirin.' WHEN 5 THEN ' for 3 months.' WHEN 6 THEN ', see code 4548-4 please.' WHEN 7 THEN ' and about ' || cast(floor(value_num * 1.04) as bigint) || ' then.' WHEN 8 THEN '' WHEN 9 THEN ' with 888888 noted.' ELSE '! 1. Rest.' END"""
_CITED = "CASE report_id % 7 WHEN 0 THEN 'Unknown Marker Q' WHEN 1 THEN '' WHEN 2 THEN upper(test_name) WHEN 3 THEN test_name || ' level' ELSE test_name END"
ch.cte("ans", f"""SELECT report_id, {_ANSWER} AS answer, {_CITED} AS cited, CASE report_id % 11 WHEN 9 THEN 888888.4 END AS cited_value, report_id % 13 = 5 AS broken, 'how is it' AS question,
  CASE report_id % 4 WHEN 0 THEN 'fr' ELSE 'en' END AS language FROM fnd WHERE finding_rank = 1 AND value_num IS NOT NULL""")


def answers(s):
    a = rollup.top_findings(s.canonical).filter("finding_rank = 1 and value_num is not null")
    cite = F.array(F.struct(F.expr(_CITED).alias("test_name"), F.when(F.col("report_id") % 11 == 9, "888888.4").alias("value"),
                            F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("health_topic")))
    parsed = F.struct(F.expr(_ANSWER).alias("answer"), cite.alias("citations"), F.array().cast("array<string>").alias("follow_ups"),
                      F.lit(None).cast("boolean").alias("doctor_routing"), F.lit(None).cast("boolean").alias("refused"), F.lit(None).cast("string").alias("refusal_reason"))
    return a.select("report_id", F.col("report_id").alias("answer_id"), F.lit("how is it").alias("question"),
                    F.when(F.col("report_id") % 4 == 0, "fr").otherwise("en").alias("language"),
                    F.when(F.col("report_id") % 13 != 5, parsed).alias("parsed"))


def compact(s):
    return s.canonical.select("report_id", "page_num", "row_idx", F.col("test_name").alias("name"), "value_num", F.col("rng_low").alias("ref_low"),
                              F.col("rng_high").alias("ref_high"), "is_panic", "severity")


@query("report_numbers", "SELECT DISTINCT report_id, number FROM (SELECT report_id, unnest([value_num, rng_low, rng_high]) AS number FROM canon) WHERE number IS NOT NULL")
def report_numbers(s):
    return gr.report_numbers(compact(s))


@query("number_texts", r"SELECT report_id, page_num, row_idx, regexp_replace(format('{:.4f}', value_num), '\.?0+$', '') AS shown FROM itp WHERE value_num IS NOT NULL")
def number_texts(s):
    return s.interpreted.filter("value_num is not null").select("report_id", "page_num", "row_idx", tx.number_text("value_num").alias("shown"))


def _strip_names(t: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({t}, '(?i)\b\d+\s*(?:weeks?|months?|days?|years?)\b', '', 'g'), '(?i)\bage\s*\d+\b', '', 'g'), '(?i)25-OH Vitamin D|HbA1c \(NGSP\)|HbA1c \(IFCC\)|HbA1c IFCC|Hemoglobin A1c|Hb A1c|HbA1c|Free T4|FT4', 'TESTNAME', 'g')"


# numbers of an answer without look-around: bullets and digits glued to letters
# are blanked first, then every number is taken
ch.cte("ansnum", rf"""SELECT report_id, answer, cited, cited_value, broken, language, list_transform(regexp_extract_all(
   regexp_replace(regexp_replace(regexp_replace({_strip_names('answer')}, '\b\d{{1,6}}-\d{{1,3}}\b', 'CODE', 'g'), '(^|[ \n\t])\d{{1,2}}[.)] ', '\1 ', 'g'), '[A-Za-z]+\d[\d.]*|\d+(?:\.\d+)?[A-Za-z]+', ' ', 'g'), '\d+(?:\.\d+)?'), lambda x: x::DOUBLE) AS numbers FROM ans""")


@query("answer_numbers", "SELECT report_id, numbers FROM ansnum WHERE NOT broken")
def answer_numbers(s):
    a = answers(s).filter("parsed is not null").select("report_id", "answer_id", F.col("parsed.answer").alias("answer"))
    names = compact(s).groupBy("report_id", "name").agg(F.min(F.struct("page_num", "row_idx")).alias("position"))
    return gr.answer_numbers(a, names).select("report_id", "numbers")


_CLOSE = "abs(a.n - c.number) <= 0.5 OR (c.number <> 0 AND abs(a.n - c.number) / abs(c.number) <= 0.05)"
ch.cte("repnum", "SELECT DISTINCT report_id, number FROM (SELECT report_id, unnest([value_num, rng_low, rng_high]) AS number FROM canon) WHERE number IS NOT NULL")
ch.cte("ansn", "SELECT report_id, unnest(numbers) AS n, unnest(range(len(numbers))) AS i, cited_value FROM ansnum WHERE NOT broken")
ch.cte("badnum", f"""SELECT a.report_id, a.n, a.i FROM ansn a WHERE NOT EXISTS (SELECT 1 FROM repnum c WHERE c.report_id = a.report_id AND ({_CLOSE}))
   AND NOT coalesce(abs(a.n - a.cited_value) <= 0.5 OR abs(a.n - a.cited_value) / a.cited_value <= 0.05, false)""")


@query("number_grounding", f"SELECT a.report_id, a.i AS num_pos, a.n AS number FROM ansn a WHERE NOT EXISTS (SELECT 1 FROM repnum c WHERE c.report_id = a.report_id AND ({_CLOSE}))")
def number_grounding(s):
    a = answers(s).filter("parsed is not null").select("report_id", "answer_id", F.col("parsed.answer").alias("answer"))
    names = compact(s).groupBy("report_id", "name").agg(F.min(F.struct("page_num", "row_idx")).alias("position"))
    stated = gr.answer_numbers(a, names).select("report_id", "answer_id", F.posexplode("numbers").alias("num_pos", "number"))
    return gr.ungrounded_numbers(stated, gr.report_numbers(compact(s))).select("report_id", "num_pos", "number")


ch.cte("foldn", f"SELECT DISTINCT report_id, {ch.fold('test_name')} AS fn FROM canon WHERE {ch.fold('test_name')} <> ''")
ch.cte("badcite", f"""SELECT report_id, cited FROM (SELECT *, {ch.fold('cited')} AS fc FROM ans WHERE NOT broken) a WHERE fc = '' OR NOT EXISTS (
   SELECT 1 FROM foldn f WHERE f.report_id = a.report_id AND (contains(f.fn, fc) OR contains(fc, f.fn)))""")


@query("citation_resolution", "SELECT report_id, cited AS cited_name FROM badcite")
def citation_resolution(s):
    cited = answers(s).filter("parsed is not null").select("report_id", "answer_id", F.lit(0).alias("cite_pos"), F.col("parsed.citations")[0].test_name.alias("cited_name"))
    return gr.unresolved_citations(cited, compact(s).select("report_id", "name").distinct()).select("report_id", "cited_name")


ch.cte("checked", rf"""SELECT a.report_id, a.answer, a.language, coalesce(r.serious, false) AS routed, CASE WHEN a.broken THEN 'schema_invalid' WHEN c.report_id IS NOT NULL THEN CASE WHEN c.cited = '' THEN 'citation_empty' ELSE 'invalid_cite:' || c.cited END
    WHEN regexp_matches(a.answer, '(?i)\b\d+(?:\.\d+)?\s*(?:×|x|times)\s*(?:normal|the (?:upper|lower) (?:limit|range|bound))') THEN 'comparative_ratio'
    WHEN b.n IS NOT NULL THEN 'invented_number:' || regexp_replace(format('{{:.4f}}', b.n), '\.?0+$', '') WHEN regexp_matches(a.answer, '(?i)\byou have\b') THEN 'denied_verb' WHEN regexp_matches(a.answer, '(?i)\baspirin\b') THEN 'drug_or_dose' END AS reason
  FROM ans a LEFT JOIN badcite c USING (report_id) LEFT JOIN (SELECT report_id, arg_min(n, i) AS n FROM badnum GROUP BY 1) b USING (report_id)
  LEFT JOIN (SELECT report_id, bool_or(is_panic OR severity IN ('moderate', 'critical')) AS serious FROM canon GROUP BY 1) r USING (report_id)""")
_DOC = ch.case_map("language", fs.DOCTOR_PHRASES.items(), ch._sql(fs.DOCTOR_PHRASES["en"]))


@query("answer_validation", f"""SELECT report_id, reason AS refusal_reason, reason IS NOT NULL AS refused, CASE WHEN reason IS NULL THEN routed ELSE false END AS doctor_routing,
  CASE WHEN reason IS NOT NULL THEN {_refusal('language', 'reason')} WHEN routed THEN answer || ' ' || {_DOC} ELSE answer END AS answer FROM checked""")
def answer_validation(s):
    return gr.validate_answers(answers(s), compact(s)).select("report_id", "refusal_reason", "refused", "doctor_routing", "answer")


# What the model wrote for each report: a bare object, a fenced one, one inside
# prose, or no object at all; then the whole way to the final answer.
ch.cte("plainans", f"""SELECT a.report_id, CASE a.language WHEN 'en' THEN CASE WHEN len(s.names) > 0 THEN s.headline || ' Items to discuss: ' || array_to_string(s.names[1:3], ', ') || '.' ELSE s.headline END ELSE {ch._sql(lx.OUT_OF_SCOPE['fr'])} END AS answer,
  least(len(s.names), 3) AS n_citations FROM ans a JOIN rsum s USING (report_id) WHERE a.broken""")


@query("ground_check", f"""SELECT c.report_id, coalesce(p.answer, CASE WHEN reason IS NOT NULL THEN {_refusal('c.language', 'reason')} WHEN routed THEN c.answer || ' ' || {_DOC.replace('language', 'c.language')} ELSE c.answer END) AS answer,
  CASE WHEN p.report_id IS NULL THEN reason END AS refusal_reason, p.report_id IS NULL AND reason IS NOT NULL AS refused, CASE WHEN p.report_id IS NULL AND reason IS NOT NULL THEN false ELSE routed END AS doctor_routing,
  coalesce(p.n_citations, CASE WHEN reason IS NULL THEN 1 ELSE 0 END) AS n_citations FROM checked c LEFT JOIN plainans p USING (report_id)""")
def ground_check(s):
    k, body = F.col("report_id"), F.to_json("parsed")
    raw = (F.when(F.col("parsed").isNull(), F.when(k % 2 == 0, F.lit("I cannot answer {that")))
           .when(k % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 3 == 1, F.concat(F.lit("Sure: "), body, F.lit(" hope it helps"))).otherwise(body))
    asked = answers(s).withColumn("raw", raw).select("report_id", "answer_id", F.concat(F.lit("  how is it, write to a"), k.cast("string"), F.lit("@b.org ")).alias("text"), "language", "raw")
    out = checks.ground_check(asked, compact(s), rollup.report_summary(s.canonical).select("report_id", "headline", "top_findings"))
    return out.select("report_id", "answer", "refusal_reason", "refused", "doctor_routing", F.size("citations").alias("n_citations"))


@query("answer_shapes", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'Sorry, I couldn''t generate an answer.' ELSE event_type END AS answer, least(event_id % 9, 5) AS n_follow_ups, least(length(repeat(event_type, 60)), 200) AS cite_length FROM events", False)
def answer_shapes(s):
    e = F.col("event_id")
    a = s.table("events").select("event_id", F.when(e % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type")).alias("answer"),
                                 F.array(F.struct(F.repeat("event_type", F.lit(60)).alias("test_name"))).alias("citations"),
                                 F.array_repeat(F.lit("q"), (e % 9).cast("int")).alias("follow_ups"))
    return gr.coerce_answers(a).select("event_id", "answer", F.size("follow_ups").alias("n_follow_ups"), F.length(F.col("citations")[0].test_name).alias("cite_length"))


@query("deterministic_answers", f"""SELECT s.report_id, CASE WHEN s.report_id % 3 = 0 THEN {ch._sql(lx.OUT_OF_SCOPE['fr'])} WHEN len(names) > 0 THEN headline || ' Items to discuss: ' || array_to_string(names, ', ') || '.' ELSE headline END AS answer, coalesce(r.serious, false) AS doctor_routing, c.citations
  FROM rsum s LEFT JOIN (SELECT report_id, string_agg(test_name || '=' || coalesce(value_num::VARCHAR, value_text, '') || '@' || health_topic, '; ' ORDER BY finding_rank) AS citations FROM fnd GROUP BY 1) c USING (report_id) LEFT JOIN (SELECT report_id, bool_or(is_panic OR severity IN ('moderate', 'critical')) AS serious FROM canon GROUP BY 1) r USING (report_id)""")
def deterministic_answers(s):
    q = s.canonical.select("report_id").distinct().select("report_id", F.col("report_id").alias("answer_id"), F.lit("how").alias("question"),
                                                          F.when(F.col("report_id") % 3 == 0, "fr").otherwise("en").alias("language"))
    serious = s.canonical.groupBy("report_id").agg(F.bool_or(rollup.serious()).alias("report_serious"))
    return gr.deterministic_answers(q, rollup.report_summary(s.canonical).join(serious, "report_id")).select(
        "report_id", "answer", "doctor_routing", F.nullif(F.array_join(F.transform("citations", lambda c: F.concat(
            c.test_name, F.lit("="), F.coalesce(c.value, F.lit("")), F.lit("@"), c.health_topic)), "; "), F.lit("")).alias("citations"))


# ---- parsing -------------------------------------------------------------

@query("fenced_json", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract(props, '$.k')::INTEGER END AS k FROM events", False)
def fenced_json(s):
    e = F.col("event_id")
    raw = (F.when(e % 4 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(e % 4 == 1, F.concat(F.lit("  "), "props"))
           .when(e % 4 == 2, F.concat(F.lit("```\n"), "props", F.lit("\n``` done"))).otherwise(F.concat(F.lit("Result: "), "props")))
    return s.table("events").select("event_id", parse.parse_object(raw, "struct<k:int>").k.alias("k"))


@query("tolerant_json", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract(props, '$.k')::INTEGER END AS k FROM events", False)
def tolerant_json(s):
    e = F.col("event_id")
    raw = (F.when(e % 4 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(e % 4 == 1, F.concat(F.lit("Sure: "), "props", F.lit(" hope it helps")))
           .when(e % 4 == 2, F.col("props")).otherwise(F.lit("no object here")))
    return s.table("events").select("event_id", parse.parse_object_tolerant(raw, "struct<k:int>").k.alias("k"))


@query("headline_json", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE p_name END AS headline FROM part", False)
def headline_json(s):
    k, body = F.col("p_partkey"), F.concat(F.lit('{"headline": "'), "p_name", F.lit('"'))
    raw = (F.when(k % 5 == 0, F.concat(body, F.lit("}"))).when(k % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("}\n```")))
           .when(k % 5 == 2, F.concat(body, F.lit(", "))).when(k % 5 == 3, F.concat(F.lit("x "), body)).otherwise(F.col("p_name")))
    return s.table("part").select("p_partkey", parse.parse_headline(raw).alias("headline"))


@query("explanation_json", "SELECT p_partkey, unnest(['Unknown', p_name]) AS test_name, unnest([p_brand, '']) AS summary, unnest([0, 1]) AS n_sources FROM part WHERE p_partkey % 3 <> 2", False)
def explanation_json(s):
    raw = F.concat(F.when(F.col("p_partkey") % 3 == 2, "oops ").otherwise(""), F.lit('[{"summary": "'), "p_brand", F.lit('"}, {"test_name": "'), "p_name", F.lit('", "sources": ["a"]}]'))
    p = s.table("part").select("p_partkey", raw.alias("raw"), F.lit("en").alias("language"))
    return parse.parse_explanations(p, "raw", "language").select("p_partkey", "test_name", "summary", F.size("sources").alias("n_sources"))


@query("screening_json", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'detected' WHEN 1 THEN 'not_detected' ELSE 'indeterminate' END AS result_status, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Unknown' END AS test_type FROM supplier", False)
def screening_json(s):
    k = F.col("s_suppkey")
    status = F.when(k % 4 == 0, '"Detected"').when(k % 4 == 1, '"not detected"').when(k % 4 == 2, '"maybe"').otherwise("null")
    raw = F.concat(F.lit('{"result_status": '), status, F.when(k % 2 == 0, F.concat(F.lit(', "test_type": "'), "s_name", F.lit('"'))).otherwise(""), F.lit("}"))
    return s.table("supplier").withColumn("p", parse.parse_screening(raw)).select("s_suppkey", "p.result_status", "p.test_type")


@query("verdict_json", """SELECT o_orderkey, i AS index, CASE WHEN o_orderkey % 5 = 4 OR i > 1 THEN 'downgrade' WHEN i = 0 THEN 'accept' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'retry' ELSE 'downgrade' END END AS verdict,
  CASE WHEN o_orderkey % 5 <> 4 AND i = 0 THEN 'medium' ELSE 'low' END AS adjusted_conf FROM (SELECT o_orderkey, unnest(range(o_orderkey % 4)) AS i FROM orders)""", False)
def verdict_json(s):
    k = F.col("o_orderkey")
    second = F.when(k % 2 == 0, "RETRY").otherwise("whatever")
    body = F.concat(F.lit('{"verdicts": [{"index": 0, "verdict": "retry"}, {"index": 1, "verdict": "'), second, F.lit('", "reason": "r"}, {"index": 0, "verdict": "Accept"}]}'))
    raw = F.when(k % 5 == 4, F.concat(F.lit("broken "), body)).otherwise(body)
    o = s.table("orders").select("o_orderkey", raw.alias("raw"), (k % 4).cast("int").alias("n"))
    return parse.parse_verdicts(o, "raw", "n").select("o_orderkey", "index", "verdict", "adjusted_conf")


@query("page_json", "SELECT report_id, page_num, count(*) AS n_rows, count(value_raw) AS n_values FROM lab GROUP BY 1, 2")
def page_json(s):
    # the printed rows of a page as the JSON an extractor writes, read back
    row = F.struct("test_name", F.col("value_raw").alias("value"), "unit")
    pages = s.lab.groupBy("report_id", "page_num").agg(F.to_json(F.struct(F.lit("en").alias("source_language"), F.collect_list(row).alias("values"))).alias("raw_text"))
    got = parse.page_rows(pages)
    return got.groupBy("report_id", "page_num").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value_raw").alias("n_values"))
