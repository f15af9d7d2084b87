"""Interpretation of non-numeric results and of titers on qualitative assays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from titrant.fixed import lexicons as lx
from titrant.fixed.qualitative import SEMI_QUANT_CANONICAL, VALUE_ALIASES
from titrant.functions import text as tx
from titrant.functions.beside import beside
from titrant.operators.conform import coded

RESULT = "direction severity actionability is_panic confidence classification_state note".split()


def canonical_value(text: Column, aliases: dict = VALUE_ALIASES, grades: dict = SEMI_QUANT_CANONICAL) -> Column:
    """Lower-case value word mapped through the spellings and the grades."""
    v = F.lower(tx.strip(text))
    v = F.coalesce(F.element_at(tx.literal_map(aliases.items()), v), v) if aliases else v
    return F.coalesce(F.element_at(tx.literal_map(grades.items()), v), v)


def _result(direction, confidence, severity, actionability, note, state="classified") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(direction).alias("direction"), lit(confidence).alias("confidence"), lit(severity).alias("severity"),
        lit(actionability).alias("actionability"), lit(note).alias("note"), F.lit(state).alias("classification_state"))


def _unknown(text: str, val: Column) -> Column:
    return _result("indeterminate", "low", "normal", "routine", F.concat(F.lit(text), val), "could_not_classify")


def expected_negative(rule: Column, val: Column) -> Column:
    return (F.when(val.isin(*lx.NORMAL_WORDS), _result(rule.negative_direction, "high", "normal", "routine", "Expected negative result"))
            .when(val.isin(*lx.ABNORMAL_WORDS), _result(rule.positive_direction, "high", rule.severity_positive,
                                                        rule.action_positive, "Abnormal positive result"))
            .otherwise(_unknown("Unknown qualitative value: ", val)))


def expected_positive(rule: Column, val: Column) -> Column:
    return (F.when(val.isin(*lx.ABNORMAL_WORDS), _result(rule.positive_direction, "high", "normal", "routine",
                                                         F.concat(F.lit("Expected positive result ("), rule.normal_status, F.lit(")"))))
            .when(val.isin(*lx.NORMAL_WORDS), _result(rule.negative_direction, "high", rule.severity_abnormal, rule.action_abnormal,
                                                      F.concat(F.lit("Abnormal negative result ("), rule.abnormal_status, F.lit(")"))))
            .otherwise(_unknown("Unknown value for expected-positive test: ", val)))


def semi_quantitative(rule: Column, val: Column) -> Column:
    order = F.array(*[F.lit(g) for g in lx.GRADE_ORDER])
    at, need = F.array_position(order, val), F.array_position(order, rule.action_grade)
    acts = F.when((at > 0) & (need > 0) & (at >= need), "follow-up").otherwise("routine")
    grade = F.element_at(rule.grades, val)
    severity = F.coalesce(grade, F.lit("mild"))
    return (F.when(F.array_contains(rule.normal_values, val),
                   _result("in-range", "high", F.coalesce(grade, F.lit("normal")), "routine",
                           F.concat(F.lit("Normal for this analyte ("), val, F.lit(")"))))
            .otherwise(_result("high", "high", severity, F.when(severity == "critical", "urgent").otherwise(acts),
                               F.concat(F.lit("Abnormal grade: "), val, F.lit(" (severity: "), severity, F.lit(")")))))


def categorical(val: Column) -> Column:
    return _result("in-range", "high", "normal", "routine", F.concat(F.lit("Categorical result: "), val))


def keyword_fallback(val: Column, flag: Column) -> Column:
    up = F.upper(F.coalesce(flag, F.lit("")))
    note = "Qualitative interpretation (keyword fallback)"
    return (F.when(val.isin(*lx.NORMAL_WORDS), _result("in-range", "medium", "normal", "routine", note))
            .when(val.isin(*lx.ABNORMAL_WORDS), _result("high", "medium", "mild", "routine", note))
            .when(val.isin(*lx.GRADE_ORDER), _result("high", "low", "normal", "routine", "Semi-quantitative (keyword fallback)"))
            .when(up.isin("H", "A"), _result("high", "low", "normal", "routine", "Flag-based fallback"))
            .when(up == "L", _result("low", "low", "normal", "routine", "Flag-based fallback"))
            .otherwise(_unknown("Unknown qualitative value: ", val)))


def by_rule(rule: Column, val: Column) -> Column:
    return (F.when(rule.category == "categorical", categorical(val))
            .when(rule.category == "semi_quantitative", semi_quantitative(rule, val))
            .when(rule.category == "expected_positive", expected_positive(rule, val))
            .otherwise(expected_negative(rule, val)))


def interpret_qualitative(rows: DataFrame, spellings: dict = VALUE_ALIASES) -> DataFrame:
    """Add struct `q` (null for plain numeric rows) with the qualitative result.

    Text values and titers of assays with a titer threshold are decided here;
    the assay rule comes from the code, else from the printed name.
    """
    return beside(rows, "loinc_code qual name_qual value_num value_text flag q", lambda a: _qualitative(a, spellings))


def _qualitative(rows: DataFrame, spellings: dict) -> DataFrame:
    a = rows.withColumns({"_code_rule": coded("qual")})
    a = a.withColumn("_rule", F.coalesce("_code_rule", "name_qual"))
    numeric = F.col("value_num").isNotNull()
    titer = numeric & F.col("_rule.threshold").isNotNull()
    a = a.withColumns({
        "_titer": F.coalesce(titer, F.lit(False)),
        "_val": F.when(numeric, F.when(F.col("value_num") >= F.col("_rule.threshold"), "positive").otherwise("negative"))
        .otherwise(canonical_value(F.coalesce("value_text", F.lit("")), spellings))})
    a = a.withColumn("_q", F.when(~numeric | F.col("_titer"), F.when(
        F.col("_rule").isNotNull(), by_rule(F.col("_rule"), F.col("_val")))
        .otherwise(keyword_fallback(F.col("_val"), F.col("flag")))))
    by_code = F.col("_code_rule").isNotNull()
    method = (F.when(F.col("_titer"), F.when(by_code, "qualitative-loinc-titer").otherwise("qualitative-name-titer"))
              .when(by_code, "qualitative-loinc").when(F.col("_rule").isNotNull(), "qualitative-name-fallback")
              .otherwise("qualitative-fallback"))
    classified = F.col("_q.classification_state") == "classified"
    hint = F.when(F.col("_rule").isNotNull() & classified, F.col("_rule.context")).otherwise("")
    panics = (F.col("_q.severity") == "critical") & (F.col("_q.direction") != "in-range") & (
        (F.col("_rule.category") == "expected_negative") | (F.col("_rule.category") == "semi_quantitative"))
    q = F.struct(
        "_q.direction", "_q.severity", "_q.actionability", F.coalesce(panics, F.lit(False)).alias("is_panic"),
        "_q.confidence", "_q.classification_state", "_q.note", method.alias("method"), hint.alias("hint"),
        F.when(F.col("_rule").isNotNull(), "qualitative-rule").otherwise("no-range").alias("range_source"))
    return a.withColumn("q", F.when(F.col("_q").isNotNull(), q)).drop("_code_rule", "_rule", "_titer", "_val", "_q")


def in_range_note(method: Column, direction: Column, hint: Column) -> Column:
    """Static note on in-range qualitative rows: immunity, or information only."""
    low = F.lower(hint)
    return F.when(method.startswith("qualitative") & (direction == "in-range") & (hint != ""), F.when(
        F.contains(low, F.lit("immunity")) | F.contains(low, F.lit("immune")),
        "This result indicates protection/immunity — this is expected and reassuring.")
        .when(F.contains(low, F.lit("informational")), hint))
