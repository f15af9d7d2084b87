"""Conforming: unit conversion and rescue, range trust, analyte flags.

Rows here carry the joined dimension structs `rule`, `conv`, `human`,
`families`, `category` next to their matched `loinc_code`.  Where a code is
cleared the structs stay but are read through `coded(...)`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from titrant.fixed import analytes as fa, families as ff
from titrant.functions import text as tx
from titrant.functions.beside import beside
from titrant.functions.numbers import exact_round_sql
from titrant.functions.units import normal_unit, possible_in_unit


def coded(name: str) -> Column:
    """A dimension column, visible only while the row still has its code."""
    return F.when(F.col("loinc_code").isNotNull(), F.col(name))


def attach_dimensions(rows: DataFrame, names: DataFrame, analytes: DataFrame) -> DataFrame:
    """Join the name dimension and the code dimension to the rows."""
    named = rows.drop("loinc_code").join(
        names.select("test_name", "loinc_code", "match_conf", "health_topic", "topic_inferred", "name_qual"), "test_name", "left")
    return named.join(analytes, "loinc_code", "left")


def mark_row(rows: DataFrame) -> DataFrame:
    """Facts fixed before conversion: printed range present, unit present."""
    return rows.withColumns({
        "has_lab_range": F.col("ref_low").isNotNull() & F.col("ref_high").isNotNull(),
        "unit_text": tx.strip(F.coalesce(F.col("unit"), F.lit(""))),
    }).withColumn("unit_present", F.col("unit_text") != "")


def convert_units(rows: DataFrame) -> DataFrame:
    """Convert value and unit of rows without a printed range to the canonical
    unit; a conversion that lands on an impossible value is reverted."""
    applies = F.col("value_num").isNotNull() & F.col("unit_present") & ~F.col("has_lab_range")
    # the spelling and the factor are looked up only where a conversion applies
    a = rows.withColumns({"_on": applies, "_u": F.when(applies, normal_unit(F.col("unit_text")))})
    native = F.col("conv").isNull() | (F.col("_u") == F.col("conv.canonical_unit"))
    a = a.withColumn("_hit", F.when(F.col("_on") & ~F.coalesce(native, F.lit(False)), F.try_element_at(F.filter(
        F.col("conv.factors"), lambda f: F.lower(f.from_unit) == F.lower(F.col("_u"))), F.lit(1))))
    a = a.withColumns({
        "_converted": ~native & F.col("_hit").isNotNull(),
        "_value": F.when(~native & F.col("_hit").isNotNull(), F.expr(exact_round_sql("value_num * _hit.factor", 4)))
        .otherwise(F.col("value_num")),
        "_unit": F.when(native, F.coalesce(F.col("conv.canonical_unit"), F.col("_u")))
        .when(F.col("_hit").isNotNull(), F.col("conv.canonical_unit")).otherwise(F.col("_u"))})
    fits = possible_in_unit(F.col("_value"), F.col("_unit")) & F.coalesce(
        F.col("_value").between(F.col("human.human_low"), F.col("human.human_high")), F.lit(True))
    b = a.withColumns({
        "_misfit": F.col("_converted") & ~fits,
        "_was_fine": possible_in_unit(F.col("value_num"), F.col("unit_text"))})
    revert = F.col("_misfit") & F.col("_was_fine")
    conf = F.when(F.col("_misfit"), "low").when(F.col("_converted") | native, "high").otherwise("low")
    converted = F.col("_converted") & ~revert
    lost = F.col("_on") & (conf == "low") & ~converted
    return b.withColumns({
        "value_num": F.when(F.col("_on"), F.when(revert, F.col("value_num")).otherwise(F.col("_value"))).otherwise(F.col("value_num")),
        "unit": F.when(F.col("_on"), F.when(revert, F.col("unit_text")).otherwise(F.col("_unit"))).otherwise(F.col("unit")),
        "unit_conf": F.when(F.col("_on"), conf).otherwise(F.col("unit_conf")),
        "converted": F.col("_on") & converted,
        "loinc_code": F.when(~lost, F.col("loinc_code")),
    }).drop("_on", "_u", "_hit", "_converted", "_value", "_unit", "_misfit", "_was_fine")


def rescue_misreported_units(rows: DataFrame) -> DataFrame:
    """Values far outside the curated range whose unit was misprinted: take the
    first conversion that brings them near it."""
    low, high = coded("rule.first_low"), coded("rule.first_high")
    value = F.col("value_num")
    far = ((low > 0) & (value < low / 5)) | ((high > 0) & (value > high * 5))
    floor = F.when(low > 0, low * 0.5).otherwise(F.lit(float("-inf")))
    near = F.try_element_at(F.filter(
        F.expr(f"transform(conv.factors, f -> {exact_round_sql('value_num * f.factor', 4)})"),
        lambda v: v.between(floor, high * 2)), F.lit(1))
    a = rows.withColumn("_far", F.coalesce(F.col("unit_present") & far, F.lit(False)))
    a = a.withColumn("_near", F.when(F.col("_far"), near))
    fixed = F.col("_near").isNotNull()
    return a.withColumns({
        "value_num": F.coalesce("_near", "value_num"),
        "unit": F.when(fixed, F.col("conv.canonical_unit")).otherwise(F.col("unit")),
        "unit_conf": F.when(fixed, "medium").when(F.col("_far") & F.col("conv").isNull(), "low").otherwise(F.col("unit_conf")),
        "ref_low": F.when(~fixed, F.col("ref_low")), "ref_high": F.when(~fixed, F.col("ref_high")),
        "range_source_pre": F.when(fixed, "unit-corrected"),
    }).drop("_far", "_near")


def clear_unitless_codes(rows: DataFrame) -> DataFrame:
    """Without unit and printed range the unit system is unknown: drop the code."""
    return rows.withColumn("loinc_code", F.when(F.col("unit_present") | F.col("has_lab_range"), F.col("loinc_code")))


def range_trust() -> Column:
    """Plausibility of the printed range: against the curated range, else the
    analyte's families, else the value itself."""
    low, high, value = F.col("ref_low"), F.col("ref_high"), F.col("value_num")
    mid = (low + high) / 2
    cur_mid = (coded("rule.first_low") + coded("rule.first_high")) / 2
    off = F.greatest(mid / cur_mid, cur_mid / mid) > 5.0

    def fits(f):
        fam_mid = (f.range_low + f.range_high) / 2
        span = (f.value_low + f.value_high) / 2
        scaled = F.when(span > 0, value / span).otherwise(F.lit(1.0))
        return (F.when((fam_mid > 0) & (mid > 0),
                       (mid / fam_mid).between(0.2, 5.0) & scaled.between(0.01, 100.0))
                .otherwise((f.range_high > 0) & (low >= f.range_low * 0.1) & (high <= f.range_high * 10)))

    generic = (F.when(mid <= 0, "medium")
               .when((value / mid > 10) | (value / mid < 0.1), "low").otherwise("high"))
    fams = coded("families")
    return (
        F.when(value.isNull() | ~F.col("has_lab_range") | low.isNull() | high.isNull(), "high")
        .when((mid > 0) & (cur_mid > 0), F.when(off, F.when(value.between(low, high), "medium").otherwise("low")).otherwise("high"))
        .when(fams.isNotNull(), F.when(F.exists(fams, fits), "high").otherwise("low"))
        .otherwise(generic))


def clear_cross_unit_ranges(rows: DataFrame) -> DataFrame:
    """Value and range in different unit systems: drop the range, trust low."""
    mid = (F.col("ref_low") + F.col("ref_high")) / 2
    ratio = F.col("value_num") / mid
    bad = F.coalesce(F.col("has_lab_range") & (mid > 0) & ((ratio > 20) | (ratio < 0.05)), F.lit(False))
    flagged = rows.withColumn("_bad", bad)
    return flagged.withColumns({
        "ref_low": F.when(~F.col("_bad"), F.col("ref_low")), "ref_high": F.when(~F.col("_bad"), F.col("ref_high")),
        "range_trust": F.when(F.col("_bad"), "low").otherwise(F.col("range_trust")),
    }).drop("_bad")


def named_glycated(name: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(name), F.lit(w)) for w in fa.GLYCATED_NAMES])


def analyte_flags(rows: DataFrame) -> DataFrame:
    """Category, decision-threshold and restricted-flag marks."""
    category = coded("category")
    return rows.withColumns({
        "analyte_category": category,
        "is_decision_threshold": F.coalesce(F.col("loinc_code").isin(*ff.DECISION_THRESHOLD_CODES), F.lit(False))
        | F.coalesce(named_glycated(F.col("test_name")), F.lit(False))
        | F.coalesce(F.col("section_type") == "hplc_diabetes_block", F.lit(False)),
        "restricted_flag": F.coalesce(category.isin(*ff.RESTRICTED_FLAG_CATEGORIES), F.lit(False))})


def add_hplc_category(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Diabetes category of the row's block.  Only rows of such sections are
    joined; the others, nearly all, are not moved."""
    block = F.coalesce(F.col("section_type") == "hplc_diabetes_block", F.lit(False))
    inside = rows.filter(block).withColumn("hplc_key", tx.raw_key(F.col("test_name"))).join(categories, ["report_id", "hplc_key"], "left")
    outside = rows.filter(~block).withColumn("hplc_category", F.lit(None).cast("string"))
    return outside.unionByName(inside.drop("hplc_key"))


def conform(rows: DataFrame) -> DataFrame:
    """The conversion, rescue, trust and flag steps in order."""
    return beside(rows, CONFORM_READS, _conform)


CONFORM_READS = ("test_name value_num unit ref_low ref_high unit_conf loinc_code section_type rule conv human families category "
                 "has_lab_range unit_text unit_present converted range_source_pre range_trust "
                 "analyte_category is_decision_threshold restricted_flag")


#: Read by these steps alone: rows that go on without them are copied faster.
CONFORM_ONLY = "conv human families category has_lab_range unit_text unit_present converted".split()


def _conform(rows: DataFrame) -> DataFrame:
    df = clear_unitless_codes(rescue_misreported_units(convert_units(mark_row(rows))))
    df = clear_cross_unit_ranges(df.withColumn("range_trust", range_trust()))
    return analyte_flags(df)
