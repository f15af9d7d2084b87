"""Readers of rule, priority and safety files against plain loading."""

import json

import pytest

from titrant.fixed import analytes as fa, qualitative as fq, safety as fs
from titrant.fixed.numeric_rules import NUMERIC_RULES
from titrant.plans import reports
from titrant.sources import dims, files


def put(folder, **texts):
    folder.mkdir()
    for name, t in texts.items():
        (folder / f"{name}.json").write_text(t if isinstance(t, str) else json.dumps(t, indent=1, ensure_ascii=False))
    return str(folder)


def rule(code, name, unit="u"):
    return {"loinc_code": code, "test_name": name, "unit": unit, "severity_bands": [{"band": "normal", "low": 1, "high": 2}]}


def test_numeric_rules_later_wins(spark, tmp_path):
    path = put(tmp_path / "rules", a=[rule("1", "first"), rule("2", "kept"), rule("1", "second"), rule(None, "no code"), rule("", "no code")],
               b=json.dumps(rule("3", "line one")) + "\n\n" + json.dumps(rule("3", "line two")) + "\n{ broken\n", c={"not": "a list of rules"},
               d="[{\"loinc_code\": ", e="", f=[rule("4", "late"), 7, "x"], z=[rule("2", "last")])
    rules, broken = files.numeric_rules(spark, path)
    got = {r.loinc_code: r for r in rules.collect()}
    assert {k: r.test_name for k, r in got.items()} == {"1": "second", "2": "last", "3": "line two", "4": "late"}
    assert rules.columns == dims.numeric_rules(spark).columns and got["1"].severity_bands[0].high == 2.0
    bad = {(r.file, r.pos) for r in broken.collect()}
    assert {("b.json", 3), ("f.json", 1), ("f.json", 2)} <= bad and "d.json" in {f for f, _ in bad}
    empty = files.scan(spark, put(tmp_path / "none", a=[]), dims.RULE_SCHEMA)
    assert empty.entries.count() == 0 and empty.broken.count() == 0


def test_qualitative_rules_equal_the_defaults(spark, tmp_path):
    path = put(tmp_path / "qual", a={"tests": fq.QUALITATIVE_RULES, "value_aliases": fq.VALUE_ALIASES})
    rules, spelled, broken = files.qualitative_rules(spark, path)
    row = lambda r: json.dumps(r.asDict(recursive=True), sort_keys=True)
    assert sorted(map(row, rules.collect())) == sorted(map(row, dims.qualitative_rules(spark).collect()))
    assert dict(files.words(spelled, "spelling", "value")) == fq.VALUE_ALIASES and broken.count() == 0
    both = put(tmp_path / "two", a={"tests": {"9-9": {"test_name": "Old"}}, "value_aliases": {"pos": "old"}}, b={"tests": {"9-9": {"test_name": "New", "category": "expected_positive"}},
               "value_aliases": {"pos": "positive"}}, c="[1]", d="{ no")
    rules, spelled, broken = files.qualitative_rules(spark, both)
    assert [(r.qual_name, r.positive_direction) for r in rules.collect()] == [("new", "in-range")]
    assert files.words(spelled, "spelling", "value") == [("pos", "positive")] and {r.file for r in broken.collect()} == {"c.json", "d.json"}


def test_priority_and_safety(spark, tmp_path):
    path = put(tmp_path / "prio", a={"exclude_from_summary": ["RDW", "MPV", "rdw", None], "severity_cap": {"RDW": "Mild", "X": "odd"}}, b={"exclude_from_summary": ["PDW"], "severity_cap": {"rdw": "moderate"}})
    tokens, caps, broken = files.priority(spark, path)
    assert files.words(tokens, "token", order="ord") == ["rdw", "mpv", "pdw"] and broken.count() == 0
    assert files.words(caps, "token", "cap", order="ord") == [("rdw", "moderate")]
    path = put(tmp_path / "safe", drugs={"drugs": [d.upper() for d in fs.DRUG_NAMES]}, symptoms=fs.ACUTE_SYMPTOMS | {"doctor_phrases": fs.DOCTOR_PHRASES})
    drugs, symptoms, doctor, broken = files.safety(spark, path)
    assert set(files.words(drugs, "word")) == set(fs.DRUG_NAMES) and dict(files.words(doctor, "lang", "word")) == fs.DOCTOR_PHRASES
    assert set(files.words(symptoms, "lang", "word")) == {(k, w.lower()) for k, l in fs.ACUTE_SYMPTOMS.items() for w in l} and broken.count() == 0
    with pytest.raises(ValueError):
        files.words(drugs, "word", limit=3)


def test_knowledge_of_files_decides(spark, tmp_path):
    rules = put(tmp_path / "r", a=[{"loinc_code": c, "test_name": n, "unit": u, "reference_ranges": [{"sex": s, "low": lo, "high": hi, "source": src} for s, lo, hi in ranges],
                                    "severity_bands": [{"band": b, "low": v[0], "high": v[1]} for b, v in bands.items()]} for c, n, u, ranges, bands, src in NUMERIC_RULES])
    quals = put(tmp_path / "q", a={"tests": fq.QUALITATIVE_RULES, "value_aliases": {"amber": "negative"}})
    know = reports.Knowledge.from_files(spark, rules, quals, put(tmp_path / "p", a={"severity_cap": {}}))
    assert know.caps == () and know.spellings == {"amber": "negative"}
    plain = lambda r: json.dumps(r.asDict(recursive=True), sort_keys=True)
    assert sorted(map(plain, know.analytes.collect())) == sorted(map(plain, dims.analytes(spark).collect()))
    raw = spark.createDataFrame([(1, 1, 0, "HBsAg", "amber", None, None, None, None, None), (1, 1, 1, "HBsAg", "reactive", None, None, None, None, None)],
                                "report_id long, page_num int, row_idx long, test_name string, value_raw string, unit string, low_raw string, high_raw string, ref_text string, flag string")
    enriched = reports.enrich_rows(reports.clean_rows(raw).rows, know)
    said = lambda rows: {r.value_text: (r.direction, r.classification_state) for r in rows.collect()}
    assert said(reports.interpret_rows(enriched, know)) == {"amber": ("in-range", "classified"), "reactive": ("high", "classified")}
    assert said(reports.interpret_rows(enriched))["amber"] == ("indeterminate", "could_not_classify")  # no spelling of the default table
    with pytest.raises(ValueError):
        reports.Knowledge.from_files(spark, put(tmp_path / "bad", a="[{"), quals)
