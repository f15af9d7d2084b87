"""Glycated haemoglobin blocks: pivot, repair, derive, cross-check, categorise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from titrant.fixed import units as fx
from titrant.functions import text as tx
from titrant.functions.numbers import exact_round_sql

SLOTS = ["ngsp", "ifcc", "eag"]
BLOCK = ["report_id", "page_num", "block_id"]


def slot() -> Column:
    """Which analyte a row is; null when a bare HbA1c name has no telling unit."""
    name = F.lower(F.coalesce(F.col("test_name"), F.lit("")))
    unit = tx.strip(F.lower(F.coalesce(F.col("unit"), F.lit(""))))
    has = lambda w: F.contains(name, F.lit(w))
    return (F.when(has("ifcc") | (unit == "mmol/mol"), "ifcc")
            .when(has("a1c") & (unit == "%"), "ngsp")
            .when(has("eag") | has("estimated average glucose"), "eag"))


def _analyte(name, value, unit, source) -> Column:
    return F.struct(
        F.lit(name).alias("test_name"), value.alias("value"), F.lit(unit).alias("unit"),
        F.lit(None).cast("double").alias("ref_low"), F.lit(None).cast("double").alias("ref_high"),
        F.lit(source).alias("source"))


def pivot_blocks(rows: DataFrame, keys: list[str] = BLOCK) -> DataFrame:
    """One row per block with a struct per analyte; the last row per slot wins."""
    unit = F.nullif(tx.strip(F.coalesce(F.col("unit"), F.lit(""))), F.lit(""))
    item = F.struct(
        F.col("test_name").alias("test_name"), F.col("value_num").alias("value"),
        F.when(F.col("_slot") == "eag", tx.strip(F.coalesce(F.nullif(F.col("unit"), F.lit("")), F.lit("mg/dL"))))
        .otherwise(unit).alias("unit"),
        F.col("ref_low"), F.col("ref_high"), F.lit("ocr").alias("source"))
    marked = rows.withColumn("_slot", slot()).withColumn("_item", item)
    return marked.groupBy(*keys).agg(
        F.min("row_idx").alias("first_row"),
        *[F.max_by(F.when(F.col("_slot") == s, F.col("_item")),
                   F.when(F.col("_slot") == s, F.col("row_idx"))).alias(s) for s in SLOTS])


def fix_misread(blocks: DataFrame) -> DataFrame:
    """Move values that sit in the wrong slot, and fix an eAG printed in mmol/L."""
    lo_n, hi_n = fx.NGSP_SPAN
    lo_i, hi_i = fx.IFCC_SPAN
    ifcc_is_ngsp = (F.col("ifcc.value") < lo_i) & F.col("ngsp").isNull() & F.col("ifcc.value").between(lo_n, hi_n)
    a = blocks.withColumn("_move", F.coalesce(ifcc_is_ngsp, F.lit(False))).withColumns({
        "ngsp": F.when(F.col("_move"), _analyte("HbA1c (NGSP)", F.col("ifcc.value"), "%", "plausibility-reclassified"))
        .otherwise(F.col("ngsp")),
        "ifcc": F.when(~F.col("_move"), F.col("ifcc"))})
    ngsp_is_ifcc = (F.col("ngsp.value") > hi_n) & F.col("ifcc").isNull() & F.col("ngsp.value").between(lo_i, hi_i)
    b = a.withColumn("_move", F.coalesce(ngsp_is_ifcc, F.lit(False))).withColumns({
        "ifcc": F.when(F.col("_move"), _analyte("HbA1c (IFCC)", F.col("ngsp.value"), "mmol/mol", "plausibility-reclassified"))
        .otherwise(F.col("ifcc")),
        "ngsp": F.when(~F.col("_move"), F.col("ngsp"))})
    molar = ((F.lower("eag.unit") != "mmol/l") & (F.col("eag.value") < fx.EAG_MGDL_SPAN[0])
             & F.col("eag.value").between(*fx.EAG_MMOL_SPAN))
    return b.withColumn("eag", F.when(F.coalesce(molar, F.lit(False)), F.col("eag").withField("unit", F.lit("mmol/L")))
                        .otherwise(F.col("eag"))).drop("_move")


def derive_missing(blocks: DataFrame) -> DataFrame:
    """Fill missing analytes from present ones, in a fixed order, each only when
    the derived value is plausible."""
    expected_eag = f"(ngsp.value * {fx.EAG_SLOPE}D + {fx.EAG_INTERCEPT}D)"
    ngsp_from_eag = f"((_eag - {fx.EAG_INTERCEPT}D) / {fx.EAG_SLOPE}D)"
    ngsp_from_ifcc = f"((_ifcc - {fx.IFCC_INTERCEPT}D) / {fx.IFCC_SLOPE}D)"
    expected_ifcc = f"(ngsp.value * {fx.IFCC_SLOPE}D + {fx.IFCC_INTERCEPT}D)"

    def fill(df, column, when, value, name, unit, source, span):
        ok = f"coalesce({when} and {value} between {span[0]} and {span[1]}, false)"
        made = _analyte(name, F.expr(exact_round_sql(value, 1)), unit, source)
        return df.withColumn(column, F.when(F.expr(ok), made).otherwise(F.col(column)))

    df = blocks.withColumns({
        "_eag": F.expr(f"if(lower(eag.unit) = 'mmol/l', eag.value * {fx.MMOL_TO_MGDL}D, eag.value)"),
        "_ifcc": F.col("ifcc.value"), "_had_eag": F.col("eag.value").isNotNull()})
    disagrees = (f"ngsp.source = 'plausibility-reclassified' and abs(_eag - {expected_eag}) > {fx.EAG_MGDL_TOLERANCE}D")
    ngsp = ("HbA1c (NGSP)", "%")
    df = fill(df, "ngsp", disagrees, ngsp_from_eag, *ngsp, "derived-from-eag", fx.NGSP_SPAN)
    df = fill(df, "ngsp", "ngsp.value is null", ngsp_from_ifcc, *ngsp, "derived-from-ifcc", fx.NGSP_SPAN)
    df = fill(df, "ngsp", "ngsp.value is null", ngsp_from_eag, *ngsp, "derived-from-eag", fx.NGSP_SPAN)
    df = fill(df, "ifcc", "_ifcc is null", expected_ifcc, "HbA1c (IFCC)", "mmol/mol", "derived-from-ngsp", fx.IFCC_SPAN)
    df = fill(df, "eag", "not _had_eag", expected_eag,
              "Estimated Average Glucose (eAG)", "mg/dL", "derived-from-ngsp", fx.EAG_MGDL_SPAN)
    return df.drop("_eag", "_ifcc", "_had_eag")


def cross_check(blocks: DataFrame) -> DataFrame:
    """Completeness, consistency flags, pass mark and diabetes category."""
    n, i, e = F.col("ngsp.value"), F.col("ifcc.value"), F.col("eag.value")
    expected_ifcc = n * fx.IFCC_SLOPE + fx.IFCC_INTERCEPT
    molar = F.lower("eag.unit") == "mmol/l"
    mgdl = n * fx.EAG_SLOPE + fx.EAG_INTERCEPT
    expected = F.when(molar, mgdl / fx.MMOL_TO_MGDL).otherwise(mgdl)
    tolerance = F.when(molar, fx.EAG_MMOL_TOLERANCE).otherwise(fx.EAG_MGDL_TOLERANCE)
    df = blocks.withColumns({
        "completeness": sum([F.col(f"{s}.value").isNotNull().cast("int") for s in SLOTS], F.lit(0)),
        "consistency_flags": F.array_compact(F.array(
            F.when(F.abs(i - expected_ifcc) > fx.IFCC_TOLERANCE, "NGSP-IFCC mismatch"),
            F.when(F.abs(e - expected) > tolerance, "NGSP-eAG mismatch")))})
    df = df.withColumn("cross_check_passed", F.size("consistency_flags") == 0)
    return df.withColumn("diabetes_category", (
        F.when(n.isNull() | (~F.col("cross_check_passed") & (F.col("completeness") >= 2)), "indeterminate")
        .when(n < fx.ADA_NORMAL, "normal").when(n < fx.ADA_PREDIABETES, "prediabetes").otherwise("diabetes")))


def parse_blocks(rows: DataFrame, keys: list[str] = BLOCK) -> DataFrame:
    """Rows of glycated haemoglobin sections to one checked row per block."""
    return cross_check(derive_missing(fix_misread(pivot_blocks(rows, keys))))


def choose_extraction(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Per block keep the first extraction unless it is incomplete and a second
    one is strictly more complete; analytes taken from the second are marked."""
    cols = [*SLOTS, "completeness", "consistency_flags", "cross_check_passed", "diabetes_category"]
    b = second.select(*keys, F.struct(*cols).alias("_b"))
    better = (F.col("completeness") < 2) & (F.col("_b.completeness") > F.col("completeness"))
    joined = first.join(b, keys, "left").withColumn("_take", F.coalesce(better, F.lit(False)))
    marked = {s: F.when(F.col("_take"), F.when(F.col(f"_b.{s}").isNotNull(), F.col(f"_b.{s}").withField("source", F.lit("re-extracted"))))
              .otherwise(F.col(s)) for s in SLOTS}
    rest = {c: F.when(F.col("_take"), F.col(f"_b.{c}")).otherwise(F.col(c)) for c in cols if c not in SLOTS}
    return joined.withColumns({**marked, **rest}).drop("_b", "_take")


def emit_rows(blocks: DataFrame) -> DataFrame:
    """Blocks back to result rows: one per analyte with a value."""
    items = F.array(*[F.when(F.col(f"{s}.value").isNotNull(), F.col(s)) for s in SLOTS])
    return (blocks.select("report_id", "page_num", "first_row", F.posexplode(items).alias("slot", "a"))
            .filter(F.col("a").isNotNull())
            .select("report_id", "page_num", F.col("first_row").alias("row_idx"), "slot",
                    "a.test_name", F.col("a.value").alias("value_num"), F.lit(None).cast("string").alias("value_text"),
                    "a.unit", "a.ref_low", "a.ref_high", F.lit(None).cast("string").alias("ref_text"),
                    F.lit(None).cast("string").alias("flag"), F.lit("hplc_diabetes_block").alias("section_type")))


def category_by_name(blocks: DataFrame) -> DataFrame:
    """Diabetes category per report and analyte name; the latest block wins."""
    cat = F.when(F.col("cross_check_passed"), F.col("diabetes_category")).otherwise("indeterminate")
    names = blocks.select("report_id", "page_num", "first_row", cat.alias("hplc_category"),
                          F.explode(F.array(*[F.col(f"{s}.test_name") for s in SLOTS])).alias("name"))
    keyed = names.withColumn("hplc_key", tx.raw_key(F.col("name"))).filter(F.col("hplc_key") != "")
    return keyed.groupBy("report_id", "hplc_key").agg(
        F.max_by("hplc_category", F.struct("page_num", "first_row")).alias("hplc_category"))
