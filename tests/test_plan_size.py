"""What the shared steps of the lab queries move and keep."""

from pyspark.sql import functions as F

from titrant.functions.grams import contained_pairs
from titrant.operators import grounding as gr, names as nm, rollup, sections
from titrant.plans import reports
from titrant.session import METHOD_LIMIT, saved


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_checks_of_answers_broadcast_no_rows(spark):
    cited = spark.createDataFrame([(1, 1, 0, "LDL-C"), (1, 1, 1, "Nothing"), (2, 2, 0, "")], "report_id long, answer_id long, cite_pos int, cited_name string")
    names = spark.createDataFrame([(1, "LDL-C Direct"), (2, "TSH")], "report_id long, name string")
    bad = gr.unresolved_citations(cited, names)
    assert sorted((r.report_id, r.cite_pos) for r in bad.collect()) == [(1, 1), (2, 0)]
    stated = spark.createDataFrame([(1, 5.0), (1, 900.0)], "report_id long, number double")
    reported = spark.createDataFrame([(1, 5.2)], "report_id long, number double")
    odd = gr.ungrounded_numbers(stated, reported)
    assert [r.number for r in odd.collect()] == [900.0]
    pairs = contained_pairs(names.withColumnRenamed("name", "s"), names.withColumnRenamed("name", "l"), ["report_id"], "s", "l")
    for df in (bad, odd, pairs):
        assert "Broadcast" not in plan(df)


def _interpreted(spark):
    rows = [(1, 1, 1, "LDL", "a", "high", "mg/dL", "lab-provided-validated", "high", "standard_lab_table"),
            (1, 1, 2, "LDL*", "a", "low", "", "no-range", "high", "standard_lab_table"),
            (1, 1, 3, "HbA1c", "b", "low", "", "no-range", "high", "hplc_diabetes_block"),
            (2, 1, 1, "LDL", None, "low", None, "no-range", None, None)]
    return spark.createDataFrame(rows, "report_id long, page_num int, row_idx long, test_name string, loinc_code string, confidence string, unit string, "
                                       "range_source string, unit_conf string, section_type string")


def test_canonical_positions_are_joined_by_merge_and_kept_narrow(spark):
    rows = _interpreted(spark)
    marked = rollup.mark_canonical(rows)
    assert "Broadcast" not in plan(marked)
    kept = reports.kept_marks(rows)
    for df in (marked, kept):
        assert sorted((r.report_id, r.row_idx, r.is_canonical) for r in df.collect()) == [(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, True)]
    assert rollup.canonical_positions(rows).columns == ["report_id", "page_num", "row_idx"]


def test_names_are_matched_from_a_table_of_distinct_names(spark):
    know = reports.knowledge(spark)
    rows = spark.createDataFrame([("Glucose",)] * 3 + [("Unheard of",), (None,)], "test_name string")
    kept = []
    original = nm.saved
    nm.saved = lambda df, label="stage": kept.append((label, df.count())) or original(df, label)
    try:
        found = {r.test_name: r.match_step for r in nm.name_dimension(rows, know.aliases, know.categories, know.qualitative).collect()}
    finally:
        nm.saved = original
    assert kept[0] == ("distinct_names", 3)
    assert found["Glucose"] == "exact" and found["Unheard of"] == "none"


def test_interpretation_is_kept_without_the_evidence_that_repeats_it(spark):
    raw = spark.createDataFrame([(1, 1, 1, "Glucose", "120", "mg/dL", "70", "100", None, "H")],
                                "report_id long, page_num int, row_idx long, test_name string, value_raw string, unit string, low_raw string, "
                                "high_raw string, ref_text string, flag string")
    know = reports.knowledge(spark)
    enriched = reports.enrich_rows(reports.clean_rows(raw).rows, know)
    kept = reports.kept_interpretation(enriched, know)
    assert "evidence" not in spark.read.parquet(*kept.inputFiles()).columns
    whole = reports.interpret_rows(enriched, know)
    assert kept.columns == whole.columns
    assert [r.asDict(True) for r in kept.collect()] == [r.asDict(True) for r in whole.collect()]


def test_long_generated_methods_are_split(spark):
    before = spark.conf.get(METHOD_LIMIT)
    try:
        for own, left in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(METHOD_LIMIT, own)
            saved(spark.range(1))
            assert spark.conf.get(METHOD_LIMIT) == left
    finally:
        spark.conf.set(METHOD_LIMIT, before)


def test_rows_of_short_pages_are_not_moved_again_after_sectioning(spark):
    rows = spark.createDataFrame([(r, p, i, n, "%", None) for r in range(3) for p in (1, 2) for i, n in enumerate(["HbA1c", "HbA1c", "TSH", "Glucose", "Sodium"])],
                                 "report_id long, page_num int, row_idx long, test_name string, unit string, ref_text string")
    short, long = sections.assign_blocks(rows), sections.assign_blocks(rows, 2)
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan
    assert sorted(map(tuple, short.fillna("").collect())) == sorted(map(tuple, long.fillna("").collect()))
    assert {(r.row_idx, r.section_type, r.block_id) for r in short.collect()} == {
        (0, sections.HPLC, 0), (1, sections.HPLC, 0), (2, sections.HPLC, 0), (3, sections.STANDARD, 1), (4, sections.STANDARD, 1)}


def test_rows_without_a_position_leave_their_page_as_it_is(spark):
    kind = "report_id long, page_num int, row_idx long, test_name string, unit string, ref_text string"
    rows = [(1, 1, 0, "TSH", None, None), (1, 1, 1, "Glucose", None, None)]
    got = sections.assign_blocks(spark.createDataFrame([*rows, (1, 1, None, "Sodium", None, None), (None, 1, 1, "Sodium", None, None)], kind))
    assert sorted((r.row_idx, r.section_type, r.block_id) for r in got.collect()) == [(0, sections.HORMONE, 0), (1, sections.HORMONE, 0)]
