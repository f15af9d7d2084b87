"""What joins and windows of answers and payloads move."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from titrant.functions.grams import all_grams, contained_pairs
from titrant.operators import conform, interpret as it, rollup
from titrant.plans import reports
from titrant.session import saved


def _nodes(df, name):
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == name:
            found.append(p)
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_only_texts_that_can_match_are_cut_and_only_as_long_as_needed(spark):
    short = spark.createDataFrame([(1, "ab"), (1, "zz"), (2, "abcd"), (3, ""), (4, "é"), (None, "ab")], "k long, s string")
    long = spark.createDataFrame([(1, "xaby"), (1, "xab"), (2, "xabcd"), (2, "abc"), (3, "abc"), (4, "café"), (5, "abcdefghij"), (None, "ab"), (2, None)], "k long, l string")
    pairs = contained_pairs(short, long, ["k"], "s", "l")
    assert sorted(map(tuple, pairs.select("k", "s", "l").collect())) == [(1, "ab", "xab"), (1, "ab", "xaby"), (2, "abcd", "xabcd"), (4, "é", "café")]
    cut = _nodes(pairs, "Generate")
    assert len(cut) == 1
    # what is cut: the texts of keys with short ones, and of key 2 no piece but those of three characters
    pieces = long.join(spark.createDataFrame([(1, [2]), (2, [3])], "k long, n array<int>"), "k").select("l", F.explode(all_grams(F.col("l"), F.col("n"))).alias("g"))
    assert sorted(map(tuple, pieces.collect())) == [("abc", "abc"), ("xab", "ab"), ("xab", "xa"), ("xabcd", "abc"), ("xabcd", "bcd"), ("xabcd", "xab"), ("xaby", "ab"), ("xaby", "by"), ("xaby", "xa")]
    assert "_needs" in cut[0].toString() and _nodes(pairs, "Join")


def _rows(spark):
    raw = spark.createDataFrame([(r, 1, i, n, v, "mg/dL", "70", "100", None, None) for r in (1, 2) for i, (n, v) in enumerate(
        [("Glucose", "120"), ("Glucose*", "121"), ("Creatinine", "1.0"), ("HBsAg", "Reactive")])],
        "report_id long, page_num int, row_idx long, test_name string, value_raw string, unit string, low_raw string, high_raw string, ref_text string, flag string")
    know = reports.knowledge(spark)
    return know, reports.kept_interpretation(reports.enrich_rows(reports.clean_rows(raw).rows, know), know)


def test_evidence_is_put_together_after_joins_and_windows(spark):
    know, interpreted = _rows(spark)
    rolled = reports.roll_up(interpreted, know)
    ranked = rollup.rank_within_topics(rolled.canonical)
    plain = {(r.report_id, r.page_num, r.row_idx): r.evidence for r in interpreted.collect()}
    got = {(r.report_id, r.page_num, r.row_idx): r.evidence for r in ranked.collect()}
    assert got and all(plain[k] == v for k, v in got.items())
    for kind in ("Join", "Window"):
        nodes = _nodes(ranked, kind)
        assert nodes
        for n in nodes:
            assert "evidence" not in [n.output().apply(i).name() for i in range(n.output().size())]
    # rows with an evidence of another make keep it
    own = spark.createDataFrame([(1, "a")], "report_id long, evidence string")
    assert it.evidence_after(own, lambda a: a.withColumn("x", F.lit(1))).collect()[0].evidence == "a"


def test_payload_items_hold_the_evidence_of_their_row(spark):
    know, interpreted = _rows(spark)
    parts = reports.payload_parts(reports.roll_up(interpreted, know))
    below = [p.children().apply(0).output() for p in _nodes(parts, "Aggregate")]
    names = [[o.apply(i).name() for i in range(o.size())] for o in below]
    assert any("rank_in_topic" in n for n in names) and not any("evidence" in n for n in names)
    rows = {(r.report_id, r.test_name): json.loads(r.e) for r in interpreted.select("report_id", "test_name", F.to_json("evidence").alias("e")).collect()}
    items = [(r.report_id, i) for r in parts.filter("part >= 0").collect() for i in json.loads(r.payload)]
    assert items and all(i["evidence"] == rows[k, i["test_name"]] and list(i)[-1] == "evidence" for k, i in items)


def test_stages_are_packed(spark):
    df = saved(spark.range(10))
    files = [Path(f.removeprefix("file:")) for f in df.inputFiles()]
    assert all(".zstd." in f.name for f in files) and df.count() == 10


def test_dimensions_end_with_the_step_that_reads_them(spark):
    raw = spark.createDataFrame([(1, 1, 0, "Glucose", "120", "mg/dL", "70", "100", None, None), (1, 1, 1, "HBsAg", "Reactive", None, None, None, None, "H")],
        "report_id long, page_num int, row_idx long, test_name string, value_raw string, unit string, low_raw string, high_raw string, ref_text string, flag string")
    know = reports.knowledge(spark)
    enriched = reports.enrich_rows(reports.clean_rows(raw).rows, know)
    assert not set(conform.CONFORM_ONLY) & set(enriched.columns)
    out = it.interpret(enriched)
    assert not {"rule", "qual", "name_qual", *conform.CONFORM_ONLY} & set(out.columns)
    assert {r.test_name: (r.direction, r.range_source) for r in out.collect()} == {
        "Glucose": ("high", "lab-provided-validated"), "HBsAg": ("high", "qualitative-rule")}
