"""Row operators on small hand-worked tables."""

import pytest
from pyspark.sql import functions as F

from titrant.functions import text as tx
from titrant.functions.numbers import exact_round_sql
from titrant.operators import clean, names, sections
from titrant.sources import dims

RAW = "report_id long, page_num int, row_idx long, test_name string, value_raw string, unit string, low_raw string, high_raw string, ref_text string, flag string"


def one(spark, value, low=None, high=None, text=None, name="Glucose"):
    df = spark.createDataFrame([(1, 1, 0, name, value, "mg/dL", low, high, text, None)], RAW)
    return clean.repair_numbers(df).first()


@pytest.mark.parametrize("value,low,high,text,expected", [
    ("5.6", "3.2 - 7.4", None, None, (5.6, 3.2, 7.4)),
    ("0,1697", "0,3500", "4,9400", None, (0.1697, 0.35, 4.94)),
    ("180", "< 200", None, None, (180.0, None, 200.0)),
    ("75", None, "> 60", None, (75.0, 60.0, None)),
    ("300", None, None, "220 - 450", (300.0, 220.0, 450.0)),
    ("5", "Normal: 3,2 - 7,4", None, None, (5.0, 3.2, 7.4)),
    ("5", "see note", None, None, (5.0, None, None)),
])
def test_range_repair(spark, value, low, high, text, expected):
    r = one(spark, value, low, high, text)
    assert (r.value_num, r.ref_low, r.ref_high) == expected


@pytest.mark.parametrize("name,expected", [
    ("Testosterone [Serum]*", "testosterone"), ("Uric Acid / Blood", "uric acid"), ("HDL-C", "hdl cholesterol"),
    ("Neutrophils (NEU) %", "neutrophils"), ("25-OH Vitamin D", "vitamin d"), ("Hb A1c", "hba1c")])
def test_normal_name(spark, name, expected):
    assert spark.range(1).select(tx.normal_name(F.lit(name)).alias("x")).first().x == expected


@pytest.mark.parametrize("x,digits,expected", [("28.7D * 5.5D - 46.7D", 1, 111.1), ("10.93D * 5.0D - 23.5D", 1, 31.1), ("0.125D", 2, 0.12), ("2.675D", 2, 2.67)])
def test_exact_round_agrees_with_correct_rounding(spark, x, digits, expected):
    assert spark.sql(f"select {exact_round_sql(x, digits)} as r").first().r == expected


def test_name_cascade(spark):
    df = spark.createDataFrame([("Glucose",), ("Glycémie",), ("Creatinine [Serum]*",), ("Platlets",), ("Zorblax",)], "test_name string")
    got = {r.test_name: (r.loinc_code, r.match_conf) for r in names.match_names(df, dims.name_table(spark)).collect()}
    assert got == {"Glucose": ("2345-7", "high"), "Glycémie": ("2345-7", "medium"), "Creatinine [Serum]*": ("2160-0", "medium"),
                   "Platlets": ("777-3", "low"), "Zorblax": (None, "low")}


def greedy(types):
    """Sections and block numbers by the row-by-row rule."""
    cur, block, out = types[0], 0, []
    for i, t in enumerate(types):
        if i and t != cur and i + 1 < len(types) and types[i + 1] == t:
            cur, block = t, block + 1
        out.append((cur, block))
    return out


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_sectioning_is_the_same_for_any_chunk(spark, chunk):
    import random
    rng = random.Random(7)
    name = {"standard_lab_table": "Glucose", "hplc_diabetes_block": "HbA1c", "hormone_immunology_block": "TSH"}
    rows, want = [], {}
    for page in range(30):
        types = [rng.choice(list(name)) for _ in range(rng.randint(1, 25))]
        for i, (t, w) in enumerate(zip(types, greedy(types))):
            rows.append((1, page, i, name[t], "1", None, None, None, None, None))
            want[(page, i)] = w
    got = {(r.page_num, r.row_idx): (r.section_type, r.block_id)
           for r in sections.assign_blocks(spark.createDataFrame(rows, RAW), chunk).collect()}
    assert got == want


@pytest.mark.parametrize("chunk", [3, 1000])
def test_rows_that_come_twice_are_sectioned_in_order(spark, chunk):
    names = ["Glucose", "HbA1c", "HbA1c", "TSH", "Sodium", "TSH"]
    rows = [(1, 1, i, n, "1", None, None, None, None, None) for i, n in enumerate(names) for _ in (1, 2)]
    kind = {"Glucose": "standard_lab_table", "Sodium": "standard_lab_table", "HbA1c": "hplc_diabetes_block", "TSH": "hormone_immunology_block"}
    want = sorted((r[2], *w) for r, w in zip(rows, greedy([kind[r[3]] for r in rows])))
    got = sections.assign_blocks(spark.createDataFrame(rows, RAW), chunk).collect()
    assert sorted((r.row_idx, r.section_type, r.block_id) for r in got) == want
