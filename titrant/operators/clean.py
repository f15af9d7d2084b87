"""Cleaning of extracted rows: number and range repair, noise filter, dedup.

Input rows carry text as printed (`value_raw`, `low_raw`, `high_raw`); output
rows carry `value_num` / `value_text` (one of them set) and numeric bounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from titrant.fixed import lexicons as lx
from titrant.functions import text as tx


def _first_form(s: Column):
    """(is hit, low, high) of the first structural range form found in a text."""
    pair_lo, pair_hi = tx.range_bounds(s)
    below, above = tx.upper_bound(s), tx.lower_bound(s)
    in_lo, in_hi = tx.range_bounds(s, anchored=False)
    return F.struct(
        F.coalesce(pair_lo, below, above, in_lo).isNotNull().alias("hit"),
        F.when(pair_lo.isNotNull(), pair_lo).when(below.isNotNull(), None)
        .when(above.isNotNull(), above).otherwise(in_lo).alias("low"),
        F.when(pair_lo.isNotNull(), pair_hi).when(below.isNotNull(), below)
        .when(above.isNotNull(), None).otherwise(in_hi).alias("high"),
    )


def repair_numbers(rows: DataFrame) -> DataFrame:
    """Split the printed value into number or text and rebuild the bounds from
    whatever the range fields hold: numbers, `a - b`, `< x`, `> x` or prose."""
    numeric = rows.withColumns({
        "value_num": tx.lab_number(F.col("value_raw")),
        "_low": tx.lab_number(F.col("low_raw")),
        "_high": tx.lab_number(F.col("high_raw")),
    })
    prose = numeric.withColumns({
        "value_text": F.when(F.col("value_num").isNull(), F.col("value_raw")),
        "_low_s": F.when(F.col("_low").isNull(), tx.decimal_comma(tx.strip(F.col("low_raw")))),
        "_high_s": F.when(F.col("_high").isNull(), tx.decimal_comma(tx.strip(F.col("high_raw")))),
    })
    forms = prose.withColumns({
        "_lf": F.when(F.col("_low_s").isNotNull(), _first_form(F.col("_low_s"))),
        "_hf": F.when(F.col("_high_s").isNotNull(), _first_form(F.col("_high_s"))),
    })
    low_hit = F.coalesce(F.col("_lf.hit"), F.lit(False))
    high_hit = F.coalesce(F.col("_hf.hit"), F.lit(False)) & ~low_hit
    text_after_low = (
        F.when(low_hit, F.coalesce(F.nullif(F.col("ref_text"), F.lit("")), F.col("_low_s")))
        .otherwise(F.coalesce(F.col("_low_s"), F.col("ref_text"))))
    text = (
        F.when(low_hit, text_after_low)
        .when(high_hit, F.coalesce(F.nullif(text_after_low, F.lit("")), F.col("_high_s")))
        .otherwise(F.coalesce(F.col("_high_s"), text_after_low)))
    fixed = forms.withColumns({
        "ref_low": F.when(low_hit, F.col("_lf.low")).when(high_hit, F.col("_hf.low")).otherwise(F.col("_low")),
        "ref_high": F.when(low_hit, F.col("_lf.high")).when(high_hit, F.col("_hf.high")).otherwise(F.col("_high")),
        "ref_text": text,
        "_lift": ~(low_hit | high_hit),
    })
    lift_lo, lift_hi = tx.range_bounds(tx.decimal_comma(tx.strip(F.col("ref_text"))))
    lift = F.col("_lift") & F.col("ref_low").isNull() & F.col("ref_high").isNull()
    lifted = fixed.withColumns({
        "ref_low": F.when(lift, lift_lo).otherwise(F.col("ref_low")),
        "ref_high": F.when(lift, lift_hi).otherwise(F.col("ref_high")),
    })
    return lifted.drop("value_raw", "low_raw", "high_raw", "_low", "_high", "_low_s", "_high_s", "_lf", "_hf", "_lift")


def implausible_range() -> Column:
    """True where the printed bounds cannot belong to the printed value."""
    low, high, value = F.col("ref_low"), F.col("ref_high"), F.col("value_num")
    mid = (low + high) / 2
    ratio = value / mid
    row_swap = value.isNotNull() & (mid > 0) & ((ratio > 10) | (ratio < 0.02))
    threshold_style = tx.any_of(F.lower(F.col("ref_text")), lx.THRESHOLD_WORDS)
    return (low.isNotNull() & high.isNotNull()) & (
        (low >= high)
        | (F.col("value_text").isNull() & F.coalesce(row_swap | threshold_style, row_swap, threshold_style, F.lit(False))))


def clear_bounds(rows: DataFrame, bad: Column) -> DataFrame:
    """Null both bounds where the condition holds."""
    flagged = rows.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    return flagged.withColumns({
        c: F.when(~F.col("_bad"), F.col(c)) for c in ("ref_low", "ref_high")}).drop("_bad")


def clear_implausible_ranges(rows: DataFrame) -> DataFrame:
    return clear_bounds(rows, implausible_range())


def scrambled_hplc_range() -> Column:
    """True where a glycated haemoglobin or eAG row carries a neighbour's range."""
    name = F.lower(F.coalesce(F.col("test_name"), F.lit("")))
    unit = F.lower(tx.strip(F.coalesce(F.col("unit"), F.lit(""))))
    mid = (F.col("ref_low") + F.col("ref_high")) / 2
    a1c, ifcc = F.contains(name, F.lit("hba1c")), F.contains(name, F.lit("ifcc"))
    eag = F.contains(name, F.lit("estimated average glucose"))

    def off(lo, hi):
        return F.coalesce((mid < lo * 0.5) | (mid > hi * 2), F.lit(False))

    def wrong_unit(*units):
        return (unit != "") & ~unit.isin(*units)

    return (
        F.when(a1c & ~ifcc, wrong_unit("%") | off(3.0, 15.0))
        .when(a1c & ifcc, wrong_unit("mmol/mol") | off(10.0, 150.0))
        .when(eag, wrong_unit("mmol/l", "mg/dl")
              | ((unit == "mmol/l") & off(3.0, 20.0)) | ((unit == "mg/dl") & off(50.0, 400.0)))
        .otherwise(F.lit(False)))


def clear_scrambled_hplc_ranges(rows: DataFrame) -> DataFrame:
    return clear_bounds(rows, scrambled_hplc_range())


def noise() -> Column:
    """True for rows that are not a measurement: labels, dates, long prose."""
    name = tx.strip(F.col("test_name"))
    text = F.lower(tx.strip(F.col("value_text")))
    valid = F.col("value_num").isNotNull() | text.isin(*lx.QUALITATIVE_WORDS)
    return (
        (F.length(name) < 2)
        | reduce(lambda a, b: a | b, [name.rlike(p) for p in lx.METADATA_NAME_PATTERNS])
        | ~F.coalesce(valid, F.lit(False))
        | F.coalesce(tx.strip(F.col("value_text")).rlike(lx.DATE_VALUE_PATTERN), F.lit(False))
        | (F.coalesce(F.length("value_text"), F.lit(0)) > 50)
        | ((F.length(name) > 80) & (F.coalesce(F.col("unit"), F.lit("")) == "")))


def drop_noise(rows: DataFrame) -> DataFrame:
    return rows.filter(~noise())


def noise_counts(rows: DataFrame) -> DataFrame:
    """Raw and filtered row counts per report."""
    return rows.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("raw_extracted_count"),
        F.count_if(noise()).alias("filtered_noise_count"))


def value_key() -> Column:
    return F.coalesce(F.col("value_num").cast("string"), F.col("value_text"))


def drop_exact_duplicates(rows: DataFrame) -> DataFrame:
    """Keep the first row per report, name, value and unit.  The rank filter is
    applied before the shuffle too, so a heavily repeated row stays small."""
    w = (Window.partitionBy("report_id", "test_name", F.coalesce(value_key(), F.lit("\0")),
                            F.coalesce(F.col("unit"), F.lit("\0"))).orderBy("page_num", "row_idx"))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def extraction_warnings(rows: DataFrame) -> DataFrame:
    """Missing value and unit warnings per row."""
    return rows.withColumn("warnings", F.array_compact(F.array(
        F.when(F.col("value_num").isNull() & F.col("value_text").isNull(),
               F.format_string("%s: missing value", "test_name")),
        F.when(F.col("unit").isNull(), F.format_string("%s: missing unit", "test_name")))))


def inverted_range() -> Column:
    """Bounds in the wrong order or below zero."""
    low, high = F.col("ref_low"), F.col("ref_high")
    return low.isNotNull() & high.isNotNull() & ((low >= high) | (low < 0) | (high < 0))


def plausibility_warnings(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Human-bounds and range-order warnings per row; bad ranges are cleared.
    `bounds` holds loinc_code, human_low, human_high."""
    value = F.col("value_num")
    joined = rows.join(bounds, "loinc_code", "left")
    impossible = value.isNotNull() & ~value.between(F.col("human_low"), F.col("human_high"))
    warned = joined.withColumn("warnings", F.array_compact(F.array(
        F.when(impossible, F.concat(F.lit("Plausibility fail: "), F.col("test_name"))),
        F.when(F.col("ref_low") >= F.col("ref_high"), F.concat(F.lit("Invalid ref range for "), F.col("test_name")))
        .when(inverted_range(), F.concat(F.lit("Negative ref range for "), F.col("test_name"))))))
    return clear_bounds(warned, inverted_range()).drop("human_low", "human_high")


def suspicious_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row groups that look badly extracted: too few rows, or most rows without
    unit or without any bound."""
    n = F.count(F.lit(1))
    no_unit = F.count_if(F.coalesce(F.col("unit"), F.lit("")) == "")
    no_range = F.count_if(F.col("ref_low").isNull() & F.col("ref_high").isNull())
    return rows.groupBy(*keys).agg(
        n.alias("n_rows"), no_unit.alias("missing_units"), no_range.alias("missing_ranges"),
    ).withColumn("suspicious", (F.col("n_rows") < 3)
                 | (F.col("missing_units") / F.col("n_rows") > 0.5)
                 | (F.col("missing_ranges") / F.col("n_rows") > 0.5))


def merge_second_extraction(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Patch incomplete rows of a first extraction from a second one.

    A row is complete with a unit and at least one bound.  Per `keys` and match
    key the first complete, unit-compatible row of the second extraction
    replaces an incomplete one; complete rows under unseen keys are added.
    `patched` marks replaced and added rows.
    """
    complete = (F.coalesce(F.col("unit"), F.lit("")) != "") & (
        F.col("ref_low").isNotNull() | F.col("ref_high").isNotNull())
    unit_key = F.lower(tx.strip(F.coalesce(F.col("unit"), F.lit(""))))
    payload = ["test_name", "value_num", "value_text", "unit", "ref_low", "ref_high", "ref_text", "flag"]
    a = first.withColumns({"_k": tx.bare_name(F.col("test_name")), "_ok": complete, "_u": unit_key})
    b = (second.withColumns({"_k": tx.bare_name(F.col("test_name")), "_u": unit_key})
         .filter(complete & (F.col("_k") != "")))

    # one candidate per unit, and one for rows without a unit of their own
    pick = F.struct(F.col("page_num"), F.col("row_idx"), *payload)
    by_unit = b.filter("_u <> ''").groupBy(*keys, "_k", "_u").agg(F.min(pick).alias("cand"))
    any_unit = by_unit.groupBy(*keys, "_k").agg(F.min("cand").alias("cand")).withColumn("_u", F.lit(""))
    offers = by_unit.unionByName(any_unit)

    need = a.withColumn("_want", F.when(~F.col("_ok"), F.col("_k"))).join(
        offers.withColumnsRenamed({"_k": "_want"}), [*keys, "_want", "_u"], "left")
    found = F.col("cand").isNotNull()
    kept = need.select(
        *keys, "page_num", "row_idx",
        *[F.when(found, F.col(f"cand.{c}")).otherwise(F.col(c)).alias(c) for c in payload],
        found.alias("patched"))
    known = a.select(*keys, "_k").distinct()
    added = b.join(known, [*keys, "_k"], "left_anti").select(
        *keys, "page_num", "row_idx", *payload, F.lit(True).alias("patched"))
    return kept.unionByName(added)


def report_headers(pages: DataFrame) -> DataFrame:
    """Header of each report: taken from its first page that names a language."""
    head = F.struct("source_language", "lab_name", "report_date", "patient_id")
    named = F.coalesce(F.col("source_language"), F.lit("")) != ""
    return (pages.groupBy("report_id")
            .agg(F.min_by(F.when(named, head), F.when(named, F.col("page_num"))).alias("h"))
            .select("report_id", F.coalesce("h.source_language", F.lit("en")).alias("source_language"),
                    "h.lab_name", "h.report_date", "h.patient_id"))


def without_identifiers(reports: DataFrame) -> DataFrame:
    """Null the identifying columns before a report is shared."""
    return reports.withColumns({c: F.lit(None).cast("string")
                                for c in ("patient_id", "raw_text") if c in reports.columns})


def empty_report_status(counts: DataFrame, reports: DataFrame) -> DataFrame:
    """Failure reason of reports left with no rows; zero-row reports survive."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return reports.join(counts, "report_id", "left").select(
        "report_id", n("raw_extracted_count").alias("raw_extracted_count"),
        n("filtered_noise_count").alias("filtered_noise_count"),
        F.when(n("raw_extracted_count") > n("filtered_noise_count"), "ok")
        .when(n("raw_extracted_count") > 0, "extraction_unusable")
        .otherwise("extraction_empty").alias("extraction_status"))
