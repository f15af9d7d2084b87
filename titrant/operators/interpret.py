"""Interpretation: range choice, direction, severity, actionability, confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from titrant.fixed import analytes as fa
from titrant.functions import text as tx
from titrant.functions.beside import beside
from titrant.functions.ranks import CONFIDENCE, SEVERITY, confidence_rank, label, severity_rank
from titrant.operators.conform import coded
from titrant.fixed.qualitative import VALUE_ALIASES
from titrant.operators.qualitative import in_range_note, interpret_qualitative

ACTION = {"normal": "routine", "mild": "monitor", "moderate": "consult", "critical": "urgent"}


def clean_flag(flag: Column) -> Column:
    f = F.upper(tx.strip(flag))
    return F.when(f.isin("H", "L", "A"), f)


def action_for(severity: Column) -> Column:
    return F.element_at(tx.literal_map(ACTION.items()), severity)


def _range(low, high, source) -> Column:
    return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"), F.lit(source).alias("source"))


NO_RANGE = lambda: _range(F.lit(None), F.lit(None), "no-range")


def select_range(rule: Column) -> Column:
    """The printed range, unless it calls abnormal what the curated one calls
    normal; without one the curated range; else none."""
    low, high, v = F.col("ref_low"), F.col("ref_high"), F.col("value_num")
    swapped = ((v < low) | (v > high)) & v.between(rule.first_low, rule.first_high)
    curated_low = F.when(rule.normal_low.isNotNull() & rule.normal_high.isNotNull(), rule.normal_low).otherwise(rule.first_low)
    curated_high = F.when(rule.normal_low.isNotNull() & rule.normal_high.isNotNull(), rule.normal_high).otherwise(rule.first_high)
    return (F.when(low.isNotNull() & high.isNotNull(), F.when(
        F.coalesce(swapped, F.lit(False)), _range(rule.first_low, rule.first_high, "curated-fallback"))
        .otherwise(_range(low, high, "lab-provided")))
        .when(rule.isNotNull() & curated_low.isNotNull(), _range(curated_low, curated_high, "curated-fallback"))
        .otherwise(NO_RANGE()))


def guard_curated(rng: Column, rule: Column) -> Column:
    """A curated range needs a known unit that agrees with the rule's."""
    unit = F.lower(tx.strip(F.coalesce(F.col("unit"), F.lit(""))))
    unsafe = (F.coalesce(F.col("unit_conf"), F.lit("high")) == "low") | (unit == "") | (
        (rule.unit != "") & (rule.unit != unit))
    return F.when((rng.source == "curated-fallback") & F.coalesce(unsafe, F.lit(False)), NO_RANGE()).otherwise(rng)


def direction_in(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, "low").when(value > high, "high").otherwise("in-range")


def text_bounds(text: Column) -> tuple[Column, Column]:
    """Bounds of a printed `a - b` text with a < b."""
    low, high = tx.range_bounds(tx.strip(text))
    return F.when(low < high, low), F.when(low < high, high)


def direction_from_text(value: Column, text: Column) -> Column:
    """Direction against `< x`, else `> x`, else `a - b` in a reference text."""
    s = tx.strip(text)
    below, above = tx.upper_bound(s, anchored=False), tx.lower_bound(s, anchored=False)
    low, high = text_bounds(s)
    return (F.when(below.isNotNull(), F.when(value > below, "high").otherwise("in-range"))
            .when(above.isNotNull(), F.when(value < above, "low").otherwise("in-range"))
            .when(low.isNotNull(), direction_in(value, low, high)))


def heuristic_severity(value: Column, low: Column, high: Column) -> Column:
    """Severity from the deviation in range widths."""
    deviation = F.when(value < low, low - value).otherwise(value - high) / (high - low)
    return F.when(high - low <= 0, "mild").when(deviation <= 0.1, "mild").otherwise("moderate")


def band_severity(value: Column, rule: Column) -> Column:
    """Tier of the most severe closed band that holds the value; a value in a
    gap between bands but outside `normal` is moderate."""
    hit = F.try_element_at(F.filter(rule.bands, lambda b: value.between(b.low, b.high)), F.lit(1))
    return (F.when(~rule.has_bands, "normal").when(hit.isNotNull(), hit.tier)
            .when(~value.between(rule.normal_low, rule.normal_high), "moderate").otherwise("normal"))


def panic(value: Column, rule: Column) -> Column:
    return F.coalesce(value <= rule.panic_low, F.lit(False)) | F.coalesce(value >= rule.panic_high, F.lit(False))


def severity_cap(name: Column, caps=tuple(fa.SEVERITY_CAPS)) -> Column:
    """Cap of the first listed name part found in the test name."""
    low = F.lower(F.coalesce(name, F.lit("")))
    expr = None if caps else F.lit(None).cast("string")
    for token, cap in caps:
        hit = F.contains(low, F.lit(token))
        expr = F.when(hit, cap) if expr is None else expr.when(hit, cap)
    return expr


def display_severity(name: Column, severity: Column) -> Column:
    cap = severity_cap(name)
    return F.when(cap.isNotNull() & (severity_rank(severity) > severity_rank(cap)), cap).otherwise(severity)


def low_priority(name: Column, tokens=tuple(fa.LOW_PRIORITY)) -> Column:
    return tx.any_of(F.lower(F.coalesce(name, F.lit(""))), tokens)


RANGE_CONFIDENCE = {"lab-provided": 2, "lab-provided-validated": 2, "curated-fallback": 1}


def composite_confidence(match_conf: Column, source: Column, unit_conf: Column) -> Column:
    """The weakest of match, range and unit confidence; a validated printed
    range lifts a weak match to medium."""
    match = confidence_rank(F.coalesce(match_conf, F.lit("low")))
    match = F.when(source.isin("lab-provided", "lab-provided-validated"), F.greatest(match, F.lit(1))).otherwise(match)
    rng = F.when(source.isin("lab-provided", "lab-provided-validated"), 2).when(source == "curated-fallback", 1).otherwise(0)
    return label(F.least(match, rng, confidence_rank(F.coalesce(unit_conf, F.lit("high")))), CONFIDENCE)


def choose_ranges(rows: DataFrame) -> DataFrame:
    """Columns for the range decision of numeric rows: `rng`, `degraded` (to be
    left indeterminate), and the expanded range source."""
    rule = coded("rule")
    a = rows.withColumn("_r", rule)
    rule = F.col("_r")
    a = a.withColumn("rng", guard_curated(select_range(rule), rule))
    unit = F.lower(tx.strip(F.coalesce(F.col("unit"), F.lit(""))))
    doubtful = (F.col("rng.source") == "lab-provided") & (F.col("range_trust") == "low") & rule.first_low.isNotNull()
    same_unit = (rule.unit != "") & (rule.unit == unit)
    a = a.withColumns({"_doubtful": F.coalesce(doubtful, F.lit(False)), "_same_unit": F.coalesce(same_unit, F.lit(False))})
    a = a.withColumn("rng", F.when(F.col("_doubtful") & F.col("_same_unit"), _range(rule.first_low, rule.first_high, "curated-fallback"))
                     .otherwise(F.col("rng")))
    unchecked = F.col("is_decision_threshold") & (
        rule.first_low.isNull() | ((F.col("range_trust") == "low") & (F.col("rng.source") != "curated-fallback")))
    a = a.withColumn("degraded", (F.col("_doubtful") & ~F.col("_same_unit")) | unchecked)
    suspicious = F.col("range_trust").isin("low", "medium")
    return a.withColumn("rng", F.col("rng").withField("source", F.when(
        F.col("rng.source") == "lab-provided",
        F.when(suspicious, "lab-provided-suspicious").otherwise("lab-provided-validated")).otherwise(F.col("rng.source"))))


def grade(rows: DataFrame, value: Column, low: Column, high: Column, source: Column, caps=tuple(fa.SEVERITY_CAPS)) -> DataFrame:
    """Severity, panic, actionability and state of a row with bounds and `dir`.

    Adds severity, severity_raw, is_panic, actionability, gated."""
    rule = F.col("_r")
    out = F.col("dir").isin("low", "high")
    first = (F.when(F.col("range_trust") == "low", "mild")
             .when(rule.isNotNull() & (source == "curated-fallback"), band_severity(value, rule))
             .when(rule.isNotNull() & source.startswith("lab-provided"), heuristic_severity(value, low, high))
             .otherwise("normal"))
    a = rows.withColumns({
        "_s": F.when(out, first), "_heuristic": heuristic_severity(value, low, high),
        "_panic": F.when(out & (source == "curated-fallback"), panic(value, rule)).otherwise(False),
        "_cap": severity_cap(F.col("test_name"), caps)})
    s = F.when(F.col("_s") == "normal", F.col("_heuristic")).when(
        (F.col("_s") == "critical") & (source != "curated-fallback"), "moderate").otherwise(F.col("_s"))
    a = a.withColumn("_s", s)
    gated = F.coalesce((F.col("_s") != "normal") & ~F.coalesce(rule.has_bands, F.lit(False)), F.lit(False))
    a = a.withColumns({
        "_gated": gated,
        "severity_raw": F.when(gated, "normal").otherwise(F.coalesce("_s", F.lit("normal"))),
        "is_panic": F.col("_panic") & ~gated})
    capped = F.coalesce((severity_rank(F.col("severity_raw")) > severity_rank(F.col("_cap"))) & F.col("_cap").isNotNull(), F.lit(False))
    severity = F.when(capped, F.col("_cap")).otherwise(F.col("severity_raw"))
    return a.withColumns({
        "severity": severity,
        "actionability": F.when(F.col("is_panic") & ~capped, "urgent").otherwise(action_for(severity))}).drop("_s", "_heuristic", "_panic", "_cap")


GRADE_READS = ("test_name value_num range_trust dir lo hi _source _r _s _heuristic _panic _cap _gated "
               "severity severity_raw is_panic actionability")
RANGE_READS = "ref_low ref_high value_num unit unit_conf range_trust is_decision_threshold loinc_code rule _r rng degraded _doubtful _same_unit"


def interpret_numeric(rows: DataFrame, caps=tuple(fa.SEVERITY_CAPS)) -> DataFrame:
    """Direction, severity, confidence and provenance of numeric rows."""
    return beside(rows, NUMERIC_READS, lambda a: _numeric(a, caps))


NUMERIC_READS = ("test_name value_num unit ref_low ref_high ref_text flag unit_conf match_conf loinc_code rule range_trust "
                 "is_decision_threshold restricted_flag severity severity_raw is_panic actionability "
                 "range_source confidence classification_state")


def _numeric(rows: DataFrame, caps) -> DataFrame:
    value = F.col("value_num")
    a = beside(rows, RANGE_READS, choose_ranges).drop("rule")
    ranged = F.col("rng.low").isNotNull() & F.col("rng.high").isNotNull()
    text_lo, text_hi = text_bounds(F.col("ref_text"))
    unit = tx.strip(F.coalesce(F.col("unit"), F.lit("")))
    flag = F.upper(F.coalesce(F.col("flag"), F.lit("")))
    fraction = F.col("loinc_code").isin(*fa.LEUKOCYTE_FRACTIONS) & (unit == "%") & F.col("_r").isNull()
    flag_usable = (unit != "") & ~F.col("restricted_flag") & ~F.col("is_decision_threshold") & ~F.coalesce(fraction, F.lit(False))
    flag_dir = F.when(flag_usable, F.when(flag.isin("H", "A"), "high").when(flag == "L", "low"))
    a = a.withColumns({
        "ranged": ranged,
        "_tdir": F.when(~ranged, direction_from_text(value, F.nullif(F.col("ref_text"), F.lit("")))),
        "_tlo": F.when(~ranged, text_lo), "_thi": F.when(~ranged, text_hi),
        "_fdir": F.when(~ranged, flag_dir)})  # read only where _tdir is null
    shown = (F.when(F.col("degraded"), "indeterminate")
             .when(F.col("ranged"), direction_in(value, F.col("rng.low"), F.col("rng.high")))
             .otherwise(F.coalesce("_tdir", "_fdir", F.lit("indeterminate"))))
    bounded = ~F.col("degraded") & (F.col("ranged") | F.col("_tlo").isNotNull() & F.col("_tdir").isNotNull())
    a = a.withColumns({
        "_shown": shown, "_bounded": bounded,
        # rows without bounds are not graded: their direction is hidden from grade()
        "dir": F.when(bounded, shown).otherwise("in-range"),
        "lo": F.when(~F.col("degraded"), F.coalesce("rng.low", F.when(F.col("_tdir").isNotNull(), F.col("_tlo")))),
        "hi": F.when(~F.col("degraded"), F.coalesce("rng.high", F.when(F.col("_tdir").isNotNull(), F.col("_thi")))),
        "_source": F.when(F.col("ranged"), F.col("rng.source")).otherwise("lab-provided-validated")})
    a = beside(a, GRADE_READS, lambda b: grade(b, value, F.col("lo"), F.col("hi"), F.col("_source"), caps))
    return a.withColumns({
        "dir": F.col("_shown"),
        "range_source": F.when(F.col("degraded"), "no-range").when(F.col("ranged"), F.col("rng.source"))
        .when(F.col("_tdir").isNotNull(), "range-text").when(F.col("_fdir").isNotNull(), "ocr-flag-fallback").otherwise("no-range"),
        "confidence": F.when(F.col("_bounded"), composite_confidence(F.col("match_conf"), F.col("_source"), F.col("unit_conf")))
        .otherwise("low"),
        "classification_state": F.when(F.col("_shown") == "indeterminate", "could_not_classify")
        .when(F.col("_gated"), "low_confidence").otherwise("classified"),
    }).drop("ranged", "_tdir", "_tlo", "_thi", "_fdir", "_bounded", "_source", "_shown", "_gated", "degraded", "rng", "_doubtful", "_same_unit")


HPLC_RESULT = {  # category -> direction, severity, actionability
    "normal": ("in-range", "normal", "routine"), "prediabetes": ("high", "mild", "monitor"),
    "diabetes": ("high", "moderate", "consult"), "indeterminate": ("indeterminate", "normal", "routine"),
}


def hplc_result(category: Column, part: int) -> Column:
    return F.element_at(tx.literal_map((k, v[part]) for k, v in HPLC_RESULT.items()), category)


def interpret(rows: DataFrame, spellings: dict = VALUE_ALIASES, caps=tuple(fa.SEVERITY_CAPS)) -> DataFrame:
    """Full decision order per row: titer or text rule, block category, range."""
    # each step's dimensions end with it: later projections would copy them with every row
    a = interpret_numeric(interpret_qualitative(rows, spellings).drop("qual", "name_qual"), caps)
    is_q, cat = F.col("q").isNotNull(), F.col("hplc_category")
    is_h = ~is_q & cat.isNotNull()

    def pick(q, h, n):
        return F.when(is_q, q).when(is_h, h).otherwise(n)

    none = F.lit(None).cast("double")
    a = a.withColumns({
        "direction": pick(F.col("q.direction"), hplc_result(cat, 0), F.col("dir")),
        "severity": pick(F.col("q.severity"), hplc_result(cat, 1), F.col("severity")),
        "severity_raw": pick(F.col("q.severity"), hplc_result(cat, 1), F.col("severity_raw")),
        "actionability": pick(F.col("q.actionability"), hplc_result(cat, 2), F.col("actionability")),
        "is_panic": pick(F.col("q.is_panic"), F.lit(False), F.col("is_panic")),
        "confidence": pick(F.col("q.confidence"), F.when(cat == "indeterminate", "low").otherwise("high"), F.col("confidence")),
        "range_source": pick(F.col("q.range_source"), F.lit("hplc-cross-check"), F.col("range_source")),
        "classification_state": pick(F.col("q.classification_state"), F.lit("classified"), F.col("classification_state")),
        "rng_low": pick(none, none, F.col("lo")), "rng_high": pick(none, none, F.col("hi")),
        "range_trust": pick(F.lit("high"), F.lit("high"), F.col("range_trust")),
        "source_flag": clean_flag(F.col("flag")),
        "unit_conf": F.coalesce("unit_conf", F.lit("high")),
        "method": F.col("q.method"), "hint": F.col("q.hint"), "note": F.col("q.note"),
        "rule_source": F.when(~is_q, F.col("_r.source")),
    })
    return a.drop("q", "dir", "lo", "hi", "_r")


def enforce_direction_consistency(rows: DataFrame) -> DataFrame:
    """A direction that rests on the printed flag alone is withdrawn; the flag
    stays as provenance.  Applying it twice changes nothing."""
    return beside(rows, "range_source rng_low rng_high direction source_flag confidence classification_state severity actionability is_panic",
                  _flag_only_withdrawn)


def _flag_only_withdrawn(rows: DataFrame) -> DataFrame:
    weak = ((F.col("range_source") == "ocr-flag-fallback") & F.col("rng_low").isNull() & F.col("rng_high").isNull()
            & F.col("direction").isin("high", "low"))
    w = F.coalesce(weak, F.lit(False))

    def put(value, column):
        return F.when(w, value).otherwise(F.col(column))

    return rows.withColumns({
        "source_flag": put(F.upper(F.substring("direction", 1, 1)), "source_flag"),
        "direction": put("indeterminate", "direction"), "confidence": put("low", "confidence"),
        "classification_state": put("low_confidence", "classification_state"), "severity": put("normal", "severity"),
        "actionability": put("routine", "actionability"), "is_panic": F.when(w, False).otherwise(F.col("is_panic")),
    })


def evidence(r=F.col) -> Column:
    """Provenance struct of an interpreted row, of which `r` gives the columns."""
    return F.struct(
        r("test_name").alias("test_name"), r("loinc_code").alias("loinc_code"), r("value_num").alias("value_num"), r("value_text").alias("value_text"),
        r("unit").alias("unit"), r("range_source").alias("range_source"),
        F.struct(r("rng_low").alias("low"), r("rng_high").alias("high")).alias("reference_range"),
        r("match_conf").alias("match_confidence"), r("direction").alias("direction"), r("severity").alias("severity"),
        r("severity_raw").alias("severity_raw"), r("is_panic").alias("is_panic"),
        r("actionability").alias("actionability"), r("confidence").alias("composite_confidence"), r("rule_source").alias("rule_source_note"),
        r("hplc_category").alias("hplc_diabetes_category"), r("method").alias("interpretation_method"),
        r("hint").alias("explanation_hint"), r("note").alias("note"), r("source_flag").alias("source_flag"),
        in_range_note(F.coalesce(r("method"), F.lit("")), r("direction"), F.coalesce(r("hint"), F.lit(""))).alias("qualitative_note"))


EVIDENCE_READS = ("test_name loinc_code value_num value_text unit range_source rng_low rng_high match_conf direction severity severity_raw "
                  "is_panic actionability confidence rule_source hplc_category method hint note source_flag").split()


def add_evidence(rows: DataFrame) -> DataFrame:
    """Provenance struct of an interpreted row; the raw flag moves into it."""
    return rows.withColumn("evidence", evidence())


def evidence_after(rows: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step(rows), which moves the rows: the evidence repeats other columns, so
    it stays behind and is put together again afterwards."""
    if not {"evidence", *EVIDENCE_READS} <= set(rows.columns):
        return step(rows)
    return add_evidence(step(rows.drop("evidence")))
