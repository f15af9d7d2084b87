"""Composed checks on small documents and answers."""

import json

from titrant.plans import checks


def put(folder, **documents):
    folder.mkdir()
    for name, d in documents.items():
        (folder / f"{name}.json").write_text(d if isinstance(d, str) else json.dumps(d, indent=1))
    return str(folder)


def value(name, v, **more):
    return {"test_name": name, "value": v, "unit": "mg/dL", "section_type": "standard_lab_table"} | more


def test_evaluate_folders(spark, tmp_path):
    truth = put(tmp_path / "truth",
                one={"archetype": "plain", "expected_values": [value("Glucose", "100"), value("Glucose", "90"), value("LDL", "3"), value("Rh", "Positive")],
                     "expected_screening": [{"test_type": "CtDNA", "result_status": "negative"}, {"test_type": "other", "result_status": "x"}],
                     "expected_hplc": [{"diabetes_category": "normal"}, {"diabetes_category": "diabetic"}]},
                two={"archetype": "lost", "expected_values": [value("Glucose", "1")]}, three={"archetype": "alone", "expected_values": []}, four="{ not json")
    output = put(tmp_path / "output",
                 one={"values": [value("glucose", "104"), value("Glucose", "90", unit="g/L"), value("Rh", "positive"), value("New", "1")],
                      "screening_results": [{"test_type": "ctdna", "result_status": "positive"}, {"test_type": "ctDNA", "result_status": "negative"}],
                      "audit": {"hplc_blocks": [{"diabetes_category": "normal"}]}},
                 two='{"values": [', five={"values": [value("Glucose", "1")]})
    golden = put(tmp_path / "golden", one={"values": [value("glucose", "104"), value("LDL", "2"), value("New", "2")]}, two={"values": [value("Gone", "2")]})
    got = checks.evaluate_folders(spark, truth, output, golden)
    scores = {r.doc_id: r for r in got.scores.collect()}
    assert set(scores) == {"one", "two", "three"}
    one = scores["one"]
    assert (one.archetype, one.total_expected, one.total_extracted, one.matched, one.recall, one.precision) == ("plain", 4, 4, 3, 0.75, 0.75)
    assert (one.value_accuracy, one.unit_accuracy, one.screening_expected, one.screening_matched, one.hplc_expected, one.hplc_category_matched) == (1.0, 2 / 3, 2, 1, 2, 1)
    assert scores["two"].recall == 0 and scores["two"].total_expected == 1 and scores["three"].total_expected == 0
    assert {(r.side, r.source_file.rsplit("/", 1)[1]) for r in got.broken.collect()} == {("truth", "four.json"), ("output", "two.json")}
    assert {tuple(r) for r in got.unpaired.collect()} == {("truth", "two"), ("truth", "three"), ("output", "five")}
    assert {(r.doc_id, r.key, r.kind) for r in got.regressions.collect()} == {("one", "ldl", "missing"), ("one", "new", "value_change"), ("one", "glucose", "value_change")}


def test_ground_check(spark):
    answer = {"answer": "Your LDL is 3.", "citations": [{"test_name": "LDL"}], "follow_ups": ["a"] * 9}
    raws = [None, "nothing", json.dumps(answer), "```json\n" + json.dumps(answer) + "\n```", json.dumps(answer | {"answer": "Your LDL is 77."}), json.dumps(answer | {"citations": [{"test_name": "Zinc"}]}), json.dumps({"answer": "  "})]
    asked = spark.createDataFrame([(1, k, "how?", "en", r) for k, r in enumerate(raws)] + [(2, 50, "how?", "en", json.dumps(answer))], "report_id long, answer_id long, text string, language string, raw string")
    compact = spark.createDataFrame([(1, 1, 1, "LDL", 3.0, 1.0, 4.0, False, "moderate")], "report_id long, page_num int, row_idx int, name string, value_num double, ref_low double, ref_high double, is_panic boolean, severity string")
    summaries = spark.sql("SELECT 1L AS report_id, 'One result.' AS headline, array(named_struct('test_name', 'LDL', 'value_num', 3D, 'value_text', CAST(NULL AS STRING), 'finding_unit', 'g', 'finding_topic', 'heart')) AS top_findings")
    got = {r.answer_id: r for r in checks.ground_check(asked, compact, summaries).collect()}
    assert len(got) == 8
    assert got[0].answer == got[1].answer == "One result. Items to discuss: LDL." and got[0].doctor_routing and not got[0].refused and got[0].citations[0].test_name == "LDL"
    for k in (2, 3):
        assert got[k].answer.startswith("Your LDL is 3.") and got[k].doctor_routing and got[k].refusal_reason is None and len(got[k].follow_ups) == 5
    assert [got[k].refusal_reason for k in (4, 5, 6, 50)] == ["invented_number:77", "invalid_cite:Zinc", "schema_invalid", "invalid_cite:LDL"]
    assert all(got[k].refused and not got[k].doctor_routing and not got[k].citations for k in (4, 5, 6, 50))
