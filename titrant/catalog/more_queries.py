"""Queries of the evaluation, retrieval, source, sink and state operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from titrant.catalog import chain as ch
from titrant.catalog.registry import query
from titrant.operators import evaluate as ev, hplc, names as nm, retrieve as rt
from titrant.plans import checks
from titrant.session import ensure_checkpoint_dir, saved
from titrant.sources import io
from titrant.streaming import limits, rows as sr

# ---- evaluation ----------------------------------------------------------
# Expected rows are the cleaned rows of a report; the extracted ones lose every
# seventh row and have some values, units and flags changed.
_VALUE = "CASE row_idx % 5 WHEN 0 THEN value_num * 1.03 WHEN 1 THEN value_num * 1.2 ELSE value_num END"
_UNIT, _FLAG = "CASE row_idx % 6 WHEN 0 THEN upper(unit) WHEN 1 THEN NULL ELSE unit END", "CASE row_idx % 4 WHEN 0 THEN NULL ELSE flag END"
_POS = "page_num * 100000000000000 + row_idx"
_KEYED = f"{ch.bare_name('test_name', '*#†‡')} AS key, report_id AS doc_id, {_POS} AS pos"
ch.cte("expd", f"SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS k FROM (SELECT *, {_KEYED} FROM kept)")
ch.cte("extd", f"""SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS k FROM (SELECT * REPLACE ({_VALUE} AS value_num, {_UNIT} AS unit, {_FLAG} AS flag), {_KEYED}
  FROM kept WHERE row_idx % 7 <> 3)""")
_NEAR = "CASE WHEN e.{0} = 0 THEN x.{0} = 0 ELSE abs(e.{0} - x.{0}) / abs(e.{0}) <= 0.05 END"
ch.cte("fmatch", f"""SELECT e.doc_id, e.key, e.k, e.pos AS expected_pos, x.pos AS extracted_pos, true AS name_match,
  CASE WHEN e.value_num IS NOT NULL AND x.value_num IS NOT NULL THEN {_NEAR.format('value_num')} ELSE lower(trim(coalesce(e.value_text, e.value_num::VARCHAR, 'none'))) = lower(trim(coalesce(x.value_text, x.value_num::VARCHAR, 'none'))) END AS value_match,
  lower(trim(coalesce(e.unit, ''))) = lower(trim(coalesce(x.unit, ''))) AS unit_match, coalesce({_NEAR.format('ref_low')}, true) AND coalesce({_NEAR.format('ref_high')}, true) AS range_match,
  upper(coalesce(e.flag, '')) = upper(coalesce(x.flag, '')) AS flag_match, e.section_type = x.section_type AS section_match FROM expd e JOIN extd x USING (doc_id, key, k)""")


def truth_pair(s) -> tuple[DataFrame, DataFrame]:
    e = s.rows.withColumns({"doc_id": F.col("report_id"), "pos": F.expr(_POS)})
    x = e.filter("row_idx % 7 <> 3").withColumns({"value_num": F.expr(_VALUE), "unit": F.expr(_UNIT), "flag": F.expr(_FLAG)})
    return e, x


@query("truth_alignment", "SELECT doc_id, key, k, expected_pos, extracted_pos FROM fmatch")
def truth_alignment(s):
    return ev.align(*truth_pair(s)).select("doc_id", "key", "k", F.col("e.pos").alias("expected_pos"), F.col("x.pos").alias("extracted_pos"))


@query("field_matches", "SELECT doc_id, key, k, expected_pos, extracted_pos, name_match, value_match, unit_match, range_match, flag_match, section_match FROM fmatch")
def field_matches(s):
    return ev.field_matches(ev.align(*truth_pair(s)))


@query("document_scores", """SELECT e.doc_id, e.n AS total_expected, coalesce(x.n, 0) AS total_extracted, coalesce(m.matched, 0) AS matched, coalesce(m.matched / e.n, 0) AS recall, coalesce(m.matched / x.n, 0) AS precision,
  coalesce(m.sec, 0) AS section_accuracy, coalesce(m.val, 0) AS value_accuracy, coalesce(m.uni, 0) AS unit_accuracy FROM (SELECT doc_id, count(*) AS n FROM expd GROUP BY 1) e LEFT JOIN (SELECT doc_id, count(*) AS n FROM extd GROUP BY 1) x USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS matched, avg(section_match::INTEGER) AS sec, avg(value_match::INTEGER) AS val, avg(unit_match::INTEGER) AS uni FROM fmatch GROUP BY 1) m USING (doc_id)""")
def document_scores(s):
    e, x = truth_pair(s)
    return ev.document_scores(e, x, ev.field_matches(ev.align(e, x)))


@query("value_regressions", """SELECT g.doc_id, g.key, CASE WHEN c.key IS NULL THEN 'missing' ELSE 'value_change' END AS kind FROM (SELECT doc_id, key, arg_max({'n': value_num, 't': value_text}, pos) AS v FROM expd GROUP BY 1, 2) g
  LEFT JOIN (SELECT doc_id, key, arg_max({'n': value_num, 't': value_text}, pos) AS v FROM extd GROUP BY 1, 2) c USING (doc_id, key) WHERE c.key IS NULL OR g.v IS DISTINCT FROM c.v""")
def value_regressions(s):
    e, x = truth_pair(s)
    return ev.regressions(e, x).select("doc_id", "key", "kind")


@query("screening_matches", "SELECT report_id AS doc_id, count(*) AS screening_expected, count(*) FILTER (WHERE doc_id % 3 <> 0) AS screening_matched FROM (SELECT *, doc_id // 5 AS report_id FROM documents) GROUP BY 1", False)
def screening_matches(s):
    d = F.col("doc_id")
    e = s.table("documents").select(F.floor(d / 5).alias("doc_id"), F.concat(F.lit("T"), d.cast("string")).alias("test_type"), F.col("lang").alias("result_status"), d.alias("pos"))
    x = e.withColumns({"test_type": F.lower("test_type"), "result_status": F.when(F.col("pos") % 3 != 0, F.col("result_status")).otherwise("other")})
    return ev.screening_matches(e, x)


@query("block_category_matches", """SELECT doc_id, count(*) AS hplc_expected, count(*) FILTER (WHERE got = diabetes_category) AS hplc_category_matched FROM (
  SELECT a.doc_id, a.diabetes_category, b.diabetes_category AS got FROM hb a LEFT JOIN hb b ON a.doc_id = b.doc_id AND a.pos = b.pos + 1) GROUP BY 1""")
def block_category_matches(s):
    e = s.blocks.select(F.col("report_id").alias("doc_id"), (F.col("page_num") * 1000 + F.col("block_id")).alias("pos"), "diabetes_category")
    return ev.block_category_matches(e, e.withColumn("pos", F.col("pos") + 1))


ch.cte("hb", "SELECT report_id AS doc_id, page_num * 1000 + block_id AS pos, diabetes_category FROM hblocks")

# Interpretation truth: what interpretation gave, with some rows altered.
_TD, _TS = "CASE row_idx % 11 WHEN 0 THEN 'high' ELSE direction END", "CASE row_idx % 9 WHEN 0 THEN 'mild' ELSE severity END"
_PV = "CASE row_idx % 13 WHEN 0 THEN 'other' ELSE coalesce(value_num::VARCHAR, value_text) END"
ch.cte("flags", f"""SELECT report_id, page_num, row_idx, test_name, row_idx % 13 <> 0 AS extraction_correct, row_idx % 17 <> 0 OR loinc_code IS NULL AS mapping_correct, direction = {_TD} AS direction_correct,
  severity = {_TS} AS severity_correct, NOT (row_idx % 3 = 0) OR confidence <> 'high' AS confidence_reasonable, {_TD} AS t_direction, row_idx % 3 = 0 AS t_downgrade, confidence AS p_confidence FROM itp""")


def flagged(s):
    value = F.coalesce(F.col("value_num").cast("string"), F.col("value_text"))
    pairs = s.interpreted.select(
        "report_id", "page_num", "row_idx", "test_name", F.when(F.col("row_idx") % 13 == 0, "other").otherwise(value).alias("p_value"), value.alias("t_value"),
        F.col("unit").alias("p_unit"), F.upper("unit").alias("t_unit"), F.when(F.col("row_idx") % 17 != 0, F.col("loinc_code")).alias("p_loinc"), F.col("loinc_code").alias("t_loinc"),
        F.col("direction").alias("p_direction"), F.expr(_TD).alias("t_direction"), F.col("severity").alias("p_severity"), F.expr(_TS).alias("t_severity"),
        F.col("confidence").alias("p_confidence"), (F.col("row_idx") % 3 == 0).alias("t_downgrade"))
    return ev.analyte_flags(pairs)


_FL = "report_id, page_num, row_idx, extraction_correct, mapping_correct, direction_correct, severity_correct, confidence_reasonable"


@query("evaluation_flags", f"SELECT {_FL} FROM flags")
def evaluation_flags(s):
    return flagged(s).select(*_FL.split(", "))


_ACC = """SELECT report_id, count(*) AS total_analytes, avg(extraction_correct::INTEGER) AS extraction_accuracy, avg(mapping_correct::INTEGER) AS mapping_accuracy, avg(direction_correct::INTEGER) AS direction_accuracy,
  avg(severity_correct::INTEGER) AS severity_accuracy, avg(confidence_reasonable::INTEGER) AS confidence_calibration FROM flags GROUP BY 1"""


@query("evaluation_accuracies", _ACC)
def evaluation_accuracies(s):
    return ev.accuracies(flagged(s), ["report_id"])


@query("scenario_status", f"SELECT report_id, CASE WHEN direction_accuracy >= 0.9 AND severity_accuracy >= 0.85 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({_ACC})")
def scenario_status(s):
    return ev.scenario_status(ev.accuracies(flagged(s), ["report_id"])).select("report_id", "status")


@query("safety_gates", """SELECT report_id, gate, n = 0 AS passed, n AS failures FROM (SELECT report_id, unnest(['extraction_safety', 'interpretation_safety', 'explanation_safety', 'graceful_degradation']) AS gate,
  unnest([count(*) FILTER (WHERE NOT extraction_correct AND t_direction <> 'in-range'), count(*) FILTER (WHERE NOT direction_correct), 0, count(*) FILTER (WHERE t_downgrade AND p_confidence = 'high')]) AS n FROM flags GROUP BY report_id)""")
def safety_gates(s):
    return ev.gate_results(flagged(s), ["report_id"])


@query("label_accuracy", "SELECT lang, count(*) AS n, avg((quality = (n_chars > 1500)::INTEGER)::INTEGER) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1", False)
def label_accuracy(s):
    j = s.table("documents").join(s.table("labels"), "doc_id")
    ok = (F.col("quality") == (F.col("n_chars") > 1500).cast("int")).cast("double")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(ok).alias("accuracy"))


# ---- retrieval -----------------------------------------------------------

def graph(s):
    e = s.table("embeddings")
    kind = F.when(F.col("vec_id") % 3 == 0, "CORRELATES_WITH").when(F.col("vec_id") % 3 == 1, "INDICATES").otherwise("FOLLOW_UP")
    edges = e.select(F.col("vec_id").alias("src"), kind.alias("label"), (F.col("label") + 1_000_000).cast("long").alias("dst"))
    ids = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    return ids.select("node_id", F.concat(F.lit("n"), F.col("node_id").cast("string")).alias("name"), F.lit("").alias("description")), edges


ch.cte("nbr", """SELECT vec_id AS node_id, CASE vec_id % 3 WHEN 0 THEN 'related' WHEN 1 THEN 'condition' ELSE 'follow_up' END AS relation, label + 1000000 AS neighbour_id FROM embeddings
  UNION ALL SELECT label + 1000000, 'related', vec_id FROM embeddings WHERE vec_id % 3 = 0""")


@query("graph_neighbours", "SELECT node_id, relation, neighbour_id, 'n' || neighbour_id AS name FROM nbr")
def graph_neighbours(s):
    return rt.neighbours(*graph(s)).select("node_id", "relation", "neighbour_id", "name")


@query("neighbour_lists", "SELECT node_id, relation, list(neighbour_id ORDER BY neighbour_id) AS ids FROM nbr GROUP BY 1, 2")
def neighbour_lists(s):
    return rt.neighbour_lists(rt.neighbours(*graph(s))).select("node_id", "relation", F.transform("neighbours", lambda x: x.neighbour_id).alias("ids"))


def centroids(s):
    """Mean vector per label, as queries."""
    e = s.table("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v.x).alias("vector"))


ch.cte("cen", "SELECT label AS query_id, list(x ORDER BY i) AS q FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1")
ch.cte("knn", """SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT query_id, vec_id, round(list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i] * embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(q, lambda x: x * x))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 9) AS score FROM cen, embeddings)""")


@query("nearest_snippets", "SELECT query_id, vec_id, round(score, 6) AS score, rank FROM knn WHERE rank <= 5")
def nearest_snippets(s):
    corpus = s.table("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return rt.nearest(centroids(s), corpus, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("retrieval_queries", """SELECT DISTINCT test_name, section_type, CASE section_type WHEN 'hplc_diabetes_block' THEN 'HbA1c diabetes monitoring hemoglobin A1c patient education blood sugar management'
  WHEN 'screening_attachment' THEN 'ctDNA liquid biopsy cancer screening results meaning limitations false negative' ELSE 'What does ' || test_name || ' lab test result mean for patients?' END AS query FROM kept""")
def retrieval_queries(s):
    return s.rows.select("test_name", "section_type").distinct().withColumn("query", rt.retrieval_query(F.col("test_name"), F.col("section_type")))


@query("test_contexts", """SELECT t.vec_id, coalesce((SELECT list('n' || neighbour_id ORDER BY neighbour_id) FROM nbr n WHERE n.node_id = t.vec_id AND relation = 'related'), []) AS related,
  coalesce((SELECT list('s' || vec_id ORDER BY rank) FROM knn k WHERE k.query_id = t.label AND rank <= 3 AND t.vec_id % 2 = 0), []) AS snippets FROM embeddings t""")
def test_contexts(s):
    tests = s.table("embeddings").select(F.col("vec_id").alias("loinc_code"), F.when(F.col("vec_id") % 2 == 0, F.col("label")).otherwise(-1).alias("test_name"))
    near = nearest_snippets(s).filter("rank <= 3").select("query_id", "rank", F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("text"))
    g = rt.graph_context(rt.neighbour_lists(rt.neighbours(*graph(s))))
    return rt.assemble(tests, g, near).select(F.col("loinc_code").alias("vec_id"), "related", "snippets")


# ---- sources and sinks ---------------------------------------------------

_PART = """SELECT p_partkey::VARCHAR AS loinc_code, p_name AS component, p_brand AS long_common_name, p_type AS class_field FROM part WHERE p_size % 4 <> 0 AND p_size % 3 = 1
  AND ((p_partkey % 5 = 0) OR p_type IN ('ECONOMY', 'STANDARD'))"""


@query("loinc_tests", _PART.replace("p_type IN ('ECONOMY', 'STANDARD')", "p_brand IN ('CHEM', 'UA')"), False)
def loinc_tests(s):
    p = s.table("part")
    table = p.select(F.col("p_partkey").cast("string").alias("LOINC_NUM"), F.col("p_name").alias("COMPONENT"), F.col("p_brand").alias("LONG_COMMON_NAME"), F.lit("").alias("SHORTNAME"),
                     F.lit("").alias("PROPERTY"), F.lit("").alias("SYSTEM"), F.lit("").alias("SCALE_TYP"), F.col("p_type").alias("CLASS"), F.lit(None).cast("string").alias("CONSUMER_NAME"),
                     F.when(F.col("p_size") % 4 != 0, "ACTIVE").otherwise("DEPRECATED").alias("STATUS"), (F.col("p_size") % 3).alias("CLASSTYPE"))
    codes = p.filter("p_partkey % 5 = 0").select(F.col("p_partkey").cast("string").alias("loinc_code"))
    return io.select_lab_tests(table, codes).select("loinc_code", "component", "long_common_name", "class_field")


@query("education_documents", r"""SELECT 'medlineplus-' || (doc_id % 50) || '-' || lang || '-' || doc_id AS id, substr(trim(title || chr(10) || summary, ' ' || chr(9) || chr(10) || chr(13)), 1, 4000) AS text FROM (
  SELECT doc_id, lang, CASE WHEN doc_id % 9 = 0 THEN '' ELSE source END AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS summary FROM documents) WHERE trim(title || summary, ' ' || chr(9) || chr(10) || chr(13)) <> ''""", False)
def education_documents(s):
    d = F.col("doc_id")
    e = s.table("documents").select((d % 50).cast("string").alias("loinc_code"), F.col("lang").alias("language"), F.lit("original").alias("provenance"), d.alias("i"),
                                    F.when(d % 9 != 0, F.col("source")).alias("title"), F.when(d % 3 != 0, F.col("text")).alias("summary"), F.lit(None).cast("string").alias("url"))
    return io.education_fields(e).select("id", "text")


@query("truth_documents", "SELECT report_id AS archetype, count(*) AS n_values FROM kept GROUP BY 1")
def truth_documents(s):
    path = f"{ensure_checkpoint_dir(s.spark)}/truth-{uuid.uuid4().hex}"
    row = F.struct("test_name", F.coalesce(F.col("value_text"), F.col("value_num").cast("string")).alias("value"), "unit", "flag", "section_type")
    s.rows.groupBy(F.col("report_id").cast("string").alias("archetype")).agg(F.collect_list(row).alias("expected_values")).write.json(path)
    got = io.read_truth(s.spark, path, io.EXTRACTION_TRUTH, one_per_file=False)
    return got.select(F.col("archetype").cast("long").alias("archetype"), F.size("expected_values").alias("n_values"))


# The truth rows as documents, written and read again, their altered copies as
# outputs; every 50th output is no JSON, every 41st is not there.
ch.cte("docsok", "SELECT DISTINCT report_id AS doc_id FROM kept WHERE report_id % 50 <> 7 AND report_id % 41 <> 5")


@query("evaluate_documents", """SELECT 'score' AS kind, e.doc_id::VARCHAR AS doc_id, e.n AS n, coalesce(x.n, 0) AS extracted, coalesce(m.matched, 0) AS matched, coalesce(m.val, 0) AS value_matches FROM (SELECT doc_id, count(*) AS n FROM expd GROUP BY 1) e
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM extd SEMI JOIN docsok USING (doc_id) GROUP BY 1) x USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS matched, count(*) FILTER (WHERE value_match) AS val FROM fmatch SEMI JOIN docsok USING (doc_id) GROUP BY 1) m USING (doc_id)
  UNION ALL SELECT 'broken', NULL, count(DISTINCT report_id), 0, 0, 0 FROM kept WHERE report_id % 50 = 7 AND report_id % 41 <> 5
  UNION ALL SELECT 'unpaired', report_id::VARCHAR, 1, 0, 0, 0 FROM (SELECT DISTINCT report_id FROM kept WHERE report_id % 50 = 7 OR report_id % 41 = 5)""")
def evaluate_documents(s):
    e, x = truth_pair(s)
    base = f"{ensure_checkpoint_dir(s.spark)}/documents-{uuid.uuid4().hex}"

    def write(rows, column, path):
        value = F.coalesce("value_text", F.format_string("%.17g", "value_num"))
        row = F.struct("pos", "test_name", value.alias("value"), "unit", F.col("ref_low").alias("reference_range_low"), F.col("ref_high").alias("reference_range_high"), "flag", "section_type")
        d = rows.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(row)).alias(column))
        text = F.to_json(F.struct("doc_id", *([F.lit("lab").alias("archetype")] if column == "expected_values" else []), column))
        if column == "values":
            d = d.filter("doc_id % 41 <> 5")
            text = F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit("{broken "), "doc_id")).otherwise(text)
        d.select(text.alias("value")).write.text(f"{base}/{path}")
    write(e, "expected_values", "truth")
    write(x, "values", "output")
    got = checks.evaluate_folders(s.spark, f"{base}/truth", f"{base}/output", one_per_file=False)
    values = got.matches.groupBy("doc_id").agg(F.count_if("value_match").alias("value_matches"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("extracted", "matched", "value_matches")]
    scores = got.scores.join(values, "doc_id", "left").select(
        F.lit("score").alias("kind"), "doc_id", F.col("total_expected").alias("n"), F.col("total_extracted").alias("extracted"), "matched", F.coalesce("value_matches", F.lit(0)).alias("value_matches"))
    broken = got.broken.filter("side = 'output'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("broken").alias("kind"), F.lit(None).cast("string").alias("doc_id"), "n", *zero)
    lone = got.unpaired.select(F.lit("unpaired").alias("kind"), "doc_id", F.lit(1).cast("long").alias("n"), *zero)
    return scores.unionByName(broken).unionByName(lone)


@query("node_upsert", "SELECT p_partkey AS node, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE p_name END AS name FROM part", False)
def node_upsert(s):
    old = s.table("part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"))
    changed = old.filter("node % 4 = 0")
    new = changed.withColumn("name", F.lit("older")).unionByName(changed.withColumn("name", F.lit("new")))
    return io.upsert(old, new, "node", F.when(F.col("name") == "new", 1).otherwise(0))


@query("vector_batches", "SELECT vec_id, label, embedding[1]::DOUBLE AS first_value, len(embedding) AS n_values, true AS small_batch FROM embeddings", False)
def vector_batches(s):
    path = f"{ensure_checkpoint_dir(s.spark)}/vectors-{uuid.uuid4().hex}"
    io.write_vectors(s.table("embeddings"), path)
    back = s.spark.read.parquet(path)
    sizes = back.groupBy("batch").agg((F.count(F.lit(1)) <= 50).alias("small_batch"))
    return back.join(sizes, "batch").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("first_value"), F.size("embedding").alias("n_values"), "small_batch")


# ---- keyed state ---------------------------------------------------------

LIMIT, SPAN = 5, 12 * 3600
_T = "epoch_us(ts) / 1000000.0"


def requests(s):
    return s.table("events").select(F.col("user_id").alias("job_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


def _fold_sql(span: int, job: str = "user_id", t: str = _T) -> str:
    return f"""WITH u AS (SELECT {job} AS job_id, list({{'t': {t}, 'taken': []::DOUBLE[], 'ok': []::BOOLEAN[]}} ORDER BY {t}, event_id) AS l, list(event_id ORDER BY {t}, event_id) AS ids FROM events GROUP BY 1),
  f AS (SELECT job_id, ids, list_reduce(l, lambda a, x: {{'t': x.t, 'taken': CASE WHEN len(list_filter(a.taken, lambda y: y >= x.t - {span})) < {LIMIT} THEN list_append(list_filter(a.taken, lambda y: y >= x.t - {span}), x.t) ELSE list_filter(a.taken, lambda y: y >= x.t - {span}) END,
    'ok': list_append(a.ok, len(list_filter(a.taken, lambda y: y >= x.t - {span})) < {LIMIT})}}, {{'t': 0.0::DOUBLE, 'taken': []::DOUBLE[], 'ok': []::BOOLEAN[]}}).ok AS ok FROM u)
  SELECT job_id, unnest(ids) AS event_id, unnest(ok) AS accepted FROM f"""


_FOLD = _fold_sql(SPAN)


@query("request_limit", _FOLD, False)
def request_limit(s):
    return limits.limit_requests(requests(s), LIMIT, SPAN).select("job_id", "event_id", "accepted")


@query("request_limit_sliced", _fold_sql(2 * 3600, "nullif(user_id % 3, 0)", f"floor({_T} / 3600) * 3600"), False)
def request_limit_sliced(s):
    """Hot keys, one of them missing, with many requests at one time."""
    hot = requests(s).withColumns({"job_id": F.nullif(F.col("job_id") % 3, F.lit(0)), "t": F.floor(F.col("t") / 3600) * 3600.0})
    return limits.limit_requests(hot, LIMIT, 2 * 3600).select("job_id", "event_id", "accepted")


@query("recent_requests", f"SELECT user_id AS job_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {24 * 3600} SECOND PRECEDING AND CURRENT ROW) AS recent FROM events", False)
def recent_requests(s):
    r = s.table("events").select(F.col("user_id").alias("job_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    from titrant.functions.ordering import trailing_count
    return trailing_count(r, "job_id", F.col("us"), "event_id", 24 * 3600 * 1_000_000, "recent", 60_000_000).select("job_id", "event_id", "recent")


_LIFE = f"""WITH e AS (SELECT user_id AS job_id, {_T} AS t, {_T} + CASE event_type WHEN 'signup' THEN 60 ELSE 240 END * 60 AS e, event_type = 'signup' AS c FROM events),
  m AS (SELECT *, max(e) OVER (PARTITION BY job_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM e),
  g AS (SELECT *, sum(CASE WHEN u IS NULL OR t >= u THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY t) AS span FROM m)
  SELECT job_id, floor(min(t)) AS created, floor(max(e)) AS expires, count(*) FILTER (WHERE c) AS creates, count(*) FILTER (WHERE NOT c) AS touches FROM g GROUP BY job_id, span"""


def job_events(s):
    return requests(s).join(s.table("events").select("event_id", F.when(F.col("event_type") == "signup", "create").otherwise("touch").alias("kind")), "event_id")


@query("job_lifetimes", _LIFE, False)
def job_lifetimes(s):
    return limits.lifetimes(job_events(s)).select("job_id", F.floor("created").cast("double").alias("created"), F.floor("expires").cast("double").alias("expires"), "creates", "touches")


def _drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its output table."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = (df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def _stream(s, df: DataFrame, label: str) -> DataFrame:
    path = saved(df, label)
    return s.spark.readStream.schema(df.schema).parquet(path.inputFiles()[0].rsplit("/", 1)[0])


@query("interpretation_stream", "SELECT report_id, page_num, row_idx, direction, severity, confidence, range_source, verification_verdict FROM itp")
def interpretation_stream(s):
    """All cleaned rows as one stream, the categories of their blocks as another."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("report_id") % 3600)
    names = nm.name_dimension(s.rows, s.know.aliases, s.know.categories, s.know.qualitative)
    found = hplc.category_by_name(s.blocks).withColumn("ts", at + F.expr("INTERVAL 20 MINUTES"))
    out = sr.interpret_stream(_stream(s, s.rows.withColumn("ts", at), "in"), names, s.know.analytes, _stream(s, found, "in"))
    return _drain(out.select("report_id", "page_num", "row_idx", "direction", "severity", "confidence", "range_source", "verification_verdict"))


@query("deduplication_stream", "SELECT DISTINCT report_id, test_name, value_num, value_text, unit FROM noised WHERE NOT is_noise")
def deduplication_stream(s):
    from titrant.catalog.row_queries import all_rows
    from titrant.operators import clean
    rows = clean.drop_noise(all_rows(s)).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_num")))
    return _drain(sr.deduplicate_stream(_stream(s, rows, "in")).select("report_id", "test_name", "value_num", "value_text", "unit"))


@query("request_limit_stream", _FOLD, False)
def request_limit_stream(s):
    s.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = s.table("events").select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return _drain(limits.limit_stream(_stream(s, e, "in"), LIMIT, SPAN)).select("job_id", "event_id", "accepted")


@query("job_lifetime_stream", f"""SELECT * FROM ({_LIFE}) WHERE expires <= (SELECT max({_T}) FROM events) - 4 * 3600""", False)
def job_lifetime_stream(s):
    """Sessions that the watermark has closed."""
    e = s.table("events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "signup", "create").otherwise("touch").alias("kind"))
    out = _drain(limits.lifetime_stream(_stream(s, e, "in")))
    return out.withColumns({c: F.floor(F.unix_micros(c) / 1e6).cast("double") for c in ("created", "expires")})
