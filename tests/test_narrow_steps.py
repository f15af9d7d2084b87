"""Steps of many projections copy a row in few pieces; reasons stay in generated code."""

from pyspark.sql import functions as F

from titrant.functions import keywords, text
from titrant.functions.beside import beside
from titrant.operators import interpret, verify

def test_beside_keeps_columns_values_and_order(spark):
    rows = spark.createDataFrame([(1, None, "a"), (None, 2, None)], "x int, y int, z string")
    out = beside(rows, "y w", lambda a: a.withColumns({"y": F.coalesce("y", F.lit(0)), "w": F.lit("n")}))
    assert out.columns == ["x", "y", "z", "w"]
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 0, "a", "n"), (None, 2, None, "n")]
    assert beside(rows, "x y", lambda a: a.drop("y")).columns == ["x", "z"]


def test_reasons_are_outside_higher_order_functions(spark):
    rows = spark.createDataFrame([("a", None, None, None, None, None, "H"), (None, 3.0, None, "%", 1.0, 5.0, "H")],
                                 "test_name string, value_num double, value_text string, unit string, ref_low double, ref_high double, flag string")
    out = verify.verify(rows)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.reasons for r in out.orderBy(F.col("test_name").desc_nulls_last()).select("verification.reasons").collect()] == [
        ["Missing value"], ["Missing test_name", "[audit] Flag=H but value within range"]]


def _widths(df, column):
    """Columns of the projections that make the column."""
    made, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "Project" and f" AS {column}#" in p.toString().split("\n")[0]:
            made.append(p.output().size())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return made


def test_second_check_and_withdrawal_carry_other_columns_in_one_piece(spark):
    others = [f"x{i}" for i in range(30)]
    rows = spark.createDataFrame([("a", "%", "accepted", "ocr-flag-fallback", "high", "low", *others)], ", ".join(
        ["test_name string, unit string, verification_verdict string, range_source string, direction string, confidence string", *[f"{c} string" for c in others]]))
    none = lambda kind, *names: {n: F.lit(None).cast(kind) for n in names}
    rows = rows.withColumns({**none("double", "value_num", "ref_low", "ref_high", "rng_low", "rng_high"), **none("string", "value_text", "flag", "range_source_pre", "source_flag"),
                             "unit_conf": F.lit("high"), "section_type": F.lit("standard_lab_table"), "severity": F.lit("mild"), "actionability": F.lit("monitor"),
                             "is_panic": F.lit(False), "classification_state": F.lit("classified")}).drop("verification")
    rows = rows.withColumn("verification", F.struct(F.lit("accept").alias("verdict"), F.array(F.lit("r")).alias("reasons"), F.lit(2).alias("passed"),
                                                    F.lit(0).alias("failed"), F.lit("high").alias("adjusted_conf")))
    again = verify.reverify(rows)
    assert again.columns == rows.columns and max(_widths(again, "_c")) < 20 < len(rows.columns)
    out = interpret.enforce_direction_consistency(rows)
    assert out.columns == rows.columns
    r = out.first()
    assert [r[c] for c in others] == others and (r.direction, r.source_flag, r.severity, r.confidence) == ("indeterminate", "H", "normal", "low")


def test_patterns_are_gated_and_find_the_same(spark):
    texts = [None, "", "hba1c", "xhba1c", "free t3 level", "tsh", "tshx", "3 - 5", "3–5 mg", "< 5,5", "≥ 7", "5,25", "1,234", "no 5"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    words = ["hba1c", "tsh", "free t3"]
    found = rows.select("t", keywords.has_any_word(c, words).alias("hit"), text.range_bounds(c, anchored=False)[1].alias("high"), text.upper_bound(c, anchored=False).alias("below"),
                        text.lower_bound(c).alias("above"), text.lab_number(c).alias("number"), text.decimal_comma(c).alias("fixed"))
    plain = rows.select("t", c.rlike(r"(?U)\b(?:hba1c|tsh|free t3)\b").alias("hit"), F.nullif(F.regexp_extract(c, r"([\d.]+)\s*[-–—]\s*([\d.]+)", 2), F.lit("")).try_cast("double").alias("high"),
                        F.nullif(F.regexp_extract(c, r"[<≤]\s*=?\s*([\d.]+)", 1), F.lit("")).try_cast("double").alias("below"),
                        F.nullif(F.regexp_extract(c, r"^\s*[>≥]\s*=?\s*([\d.]+)\s*$", 1), F.lit("")).try_cast("double").alias("above"),
                        F.when(c.rlike(r"^\d+,\d+$"), F.replace(c, F.lit(","), F.lit(".")).try_cast("double")).alias("number"),
                        F.regexp_replace(c, r"(\d),(\d{1,2})(?!\d)", "$1.$2").alias("fixed"))
    key = lambda r: (r.t is not None, r.t)
    assert sorted(found.collect(), key=key) == sorted(plain.collect(), key=key)
    for column in ("hit", "high", "below", "above", "fixed"):
        assert "Contains" in found.select(column)._jdf.queryExecution().optimizedPlan().prettyJson()
