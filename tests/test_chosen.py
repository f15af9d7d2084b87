"""Rows chosen by late columns: their conditions stay above the chain that decides them."""

import pytest
from pyspark.sql import functions as F

from titrant.catalog import row_queries as rq
from titrant.catalog.stages import Stages
from titrant.functions.chosen import chosen

NAMES = ("composite_confidence direction_by_text expected_results graded_results hplc_results keyword_results no_range_fallback panic_thresholds "
         "severity_and_action qualitative_dispatch uncertainty_gate severity_bands titer_results range_selection curated_guards trust_override "
         "threshold_gate source_expansion").split()


@pytest.fixture(scope="module")
def stage(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("lines")
    lines = [(o, p, o + p, n, 1.0 + 7 * n, 10.0 * p, 0.01, 0.0, "NRA"[p % 3], "OF"[o % 2]) for o in (1, 3, 4, 6, 11, 13) for n, p in enumerate(range(0, 21, 2), 1)]
    rows = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                        "l_discount double, l_tax double, l_returnflag string, l_linestatus string")
    rows.withColumn("l_shipdate", F.expr("timestamp'2020-01-01 00:00:00'")).write.parquet(f"{at}/lineitem.parquet")
    return Stages(spark, str(at))


def test_chosen_rows_and_columns(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "x int, y string").withColumn("s", F.struct(F.col("y").alias("z")))
    out = chosen(rows, "x > 0", "x", "s.z", F.upper("y").alias("u"))
    assert out.columns == ["x", "z", "u"]
    assert sorted(map(tuple, out.collect())) == [(1, "a", "A"), (2, None, None)]
    long = spark.range(4).withColumn("x", F.col("id"))
    for _ in range(12):
        long = long.withColumn("x", F.when(F.col("x") % 2 == 0, F.col("x") + 1).otherwise(F.col("x") - 1))
    kept = chosen(long, "x = 3", "id", "x")
    assert len(kept._jdf.queryExecution().optimizedPlan().toString()) < 10_000 < len(long.filter("x = 3")._jdf.queryExecution().optimizedPlan().toString())
    assert [tuple(r) for r in kept.collect()] == [(3, 3)]


@pytest.mark.parametrize("name", NAMES)
def test_no_filter_above_the_chain(stage, name):
    df = getattr(rq, name)(stage)
    node = df._jdf.queryExecution().analyzed()
    while node.children().size() == 1:
        assert node.nodeName() != "Filter"
        node = node.children().apply(0)
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 300_000


def test_chosen_rows_are_those_of_the_condition(stage):
    key = lambda r: (r.report_id, r.page_num, r.row_idx)
    rows = rq.it.choose_ranges(rq.qualified(stage)).select(*rq.K, "q", "value_num", "hplc_category", "rng").collect()
    plain = {key(r) for r in rows if r.q is None and r.hplc_category is None}
    open_range = {key(r) for r in rows if r.value_num is not None and r.rng.low is None}
    found = {n: {key(r) for r in getattr(rq, n)(stage).collect()} for n in ("composite_confidence", "qualitative_dispatch", "direction_by_text", "no_range_fallback", "keyword_results")}
    assert found["composite_confidence"] == plain and plain
    assert found["qualitative_dispatch"] == {key(r) for r in rows if r.q is not None}
    assert found["keyword_results"] == {key(r) for r in rows if r.q is not None and r.q.range_source == "no-range"}
    assert found["direction_by_text"] == open_range and found["no_range_fallback"] == open_range & plain
    assert found["no_range_fallback"]
