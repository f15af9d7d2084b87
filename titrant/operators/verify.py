"""Rule checks of a row, verdicts, and their merge with a second opinion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from titrant.functions import text as tx
from titrant.functions.beside import beside
from titrant.functions.ranks import confidence_rank
from titrant.functions.units import possible_in_unit

WEAK_SOURCES = ["no-range", "ocr-flag-fallback"]
CAUTION_SOURCES = ["range-text", "lab-provided-suspicious"]


def _told(*reasons: Column) -> Column:
    """The reasons that are not null.  array_compact would have Spark evaluate
    them by its interpreter, outside generated code."""
    none = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.coalesce(F.when(r.isNotNull(), F.array(r)), none) for r in reasons]))


def checks(unit_conf: Column, range_source: Column, confidence: Column, section: Column) -> Column:
    """struct(passed, failed, warned, reasons) of the eight checks on a row."""
    value, text = F.col("value_num"), F.col("value_text")
    low, high = F.col("ref_low"), F.col("ref_high")
    has_name = F.coalesce(F.col("test_name"), F.lit("")) != ""
    has_value = value.isNotNull() | text.isNotNull()
    unit_checked = value.isNotNull() & (F.coalesce(F.col("unit"), F.lit("")) != "")
    unit_ok = possible_in_unit(value, F.col("unit"))
    flag = F.upper(F.coalesce(F.col("flag"), F.lit("")))
    flag_checked = (flag != "") & value.isNotNull() & low.isNotNull() & high.isNotNull()
    flag_high_odd = flag.isin("H", "A") & value.between(low, high)
    flag_low_odd = (flag == "L") & (value >= low)
    uc = F.lower(F.coalesce(unit_conf, F.lit("high")))
    src = F.lower(F.coalesce(range_source, F.lit("")))
    conf = F.lower(F.coalesce(confidence, F.lit("high")))
    weak, caution = src.isin(*WEAK_SOURCES), src.isin(*CAUTION_SOURCES)
    both_low, lone_low = (conf == "low") & (uc == "low"), (conf == "low") & (uc != "low")

    def count(*conditions):
        return sum([F.when(c, 1).otherwise(0) for c in conditions], F.lit(0))

    passed = count(has_name, has_value, unit_checked & unit_ok, flag_checked & ~flag_high_odd & ~flag_low_odd,
                   section == "hplc_diabetes_block", uc != "low", (src != "") & ~weak & ~caution)
    failed = count(~has_name, ~has_value, unit_checked & ~unit_ok, uc == "low", weak, both_low)
    warned = count(caution, lone_low)
    insufficient = (failed == 0) & (passed < 2)
    reasons = _told(
        F.when(~has_name, "Missing test_name"),
        F.when(~has_value, "Missing value"),
        F.when(unit_checked & ~unit_ok, F.concat(F.lit("Value implausible for unit "), F.col("unit"))),
        F.when(flag_checked & flag_high_odd, F.concat(F.lit("[audit] Flag="), flag, F.lit(" but value within range")))
        .when(flag_checked & flag_low_odd, "[audit] Flag=L but value at or above range_low"),
        F.when(uc == "low", F.concat(F.lit("unit_confidence=low for "), F.coalesce("test_name", F.lit("?")))),
        F.when(weak, F.concat(F.lit("range_source="), src)).when(caution, F.concat(F.lit("[warn] range_source="), src)),
        F.when(both_low, "Both unit_confidence and confidence are low")
        .when(lone_low, F.concat(F.lit("[warn] confidence=low for "), F.coalesce("test_name", F.lit("?")))),
        F.when(insufficient, "Insufficient verification coverage"))
    return F.struct(passed.alias("passed"), failed.alias("failed"), warned.alias("warned"), reasons.alias("reasons"))


def verdict(c: Column) -> Column:
    """Verdict name from a checks struct."""
    return (F.when((c.failed == 0) & (c.passed >= 2) & (c.warned == 0), "accept")
            .when((c.failed == 0) & (c.passed >= 2), "accept_with_warning")
            .when(c.failed == 0, "downgrade")
            .when((c.failed == 1) & (c.passed >= 2), "downgrade")
            .when(c.failed >= 2, "retry")
            .otherwise("accept"))


def verdict_confidence(v: Column, c: Column) -> Column:
    return (F.when(v == "retry", "low").when(v.isin("downgrade", "accept_with_warning"), "medium").otherwise("high"))


def verify(rows: DataFrame, null_metadata: bool = True) -> DataFrame:
    """First verification, before any quality metadata exists: adds the
    `verification` struct, the row label and the starting unit confidence."""
    none = F.lit(None).cast("string")
    a = rows.withColumn("_c", checks(none, none, none, none))
    a = a.withColumn("_v", verdict(F.col("_c")))  # apart: it is read many times
    v = F.col("_v")
    return a.withColumns({
        "verification": F.struct(v.alias("verdict"), F.col("_c.reasons").alias("reasons"),
                                 F.col("_c.passed").alias("passed"), F.col("_c.failed").alias("failed"),
                                 verdict_confidence(v, F.col("_c")).alias("adjusted_conf")),
        "verification_verdict": (F.when(v == "downgrade", "downgraded")
                                 .when(v == "retry", "retry_exhausted")
                                 .when(v == "accept_with_warning", "accepted_with_warning")
                                 .when(v == "mark_indeterminate", "indeterminate")
                                 .otherwise("accepted")),
        "unit_conf": F.when(v == "downgrade", "medium").when(v.isin("retry", "mark_indeterminate"), "low"),
    }).drop("_c", "_v")


def reverify(rows: DataFrame) -> DataFrame:
    """Second check with unit confidence, range source and section known; it
    only lowers rows that were accepted."""
    return beside(rows, REVERIFY_READS, _reverify)


REVERIFY_READS = ("test_name value_num value_text unit ref_low ref_high flag unit_conf range_source_pre section_type "
                  "verification verification_verdict")


def _reverify(rows: DataFrame) -> DataFrame:
    a = rows.withColumn("_c", checks(F.col("unit_conf"), F.col("range_source_pre"), F.lit(None).cast("string"),
                                     F.col("section_type")))
    a = a.withColumn("_v", verdict(F.col("_c")))  # apart: it is read many times
    v = F.col("_v")
    bad = v.isin("downgrade", "retry")
    accepted = F.col("verification_verdict").isin("accepted", "accepted_with_warning")
    old = F.col("verification")
    return a.withColumns({
        "verification_verdict": F.when(bad & accepted, "downgraded").otherwise(F.col("verification_verdict")),
        "verification": F.when(bad, F.struct(
            F.when(accepted, "downgrade").otherwise(old.verdict).alias("verdict"),
            F.concat(old.reasons, F.col("_c.reasons")).alias("reasons"),
            F.col("_c.passed").alias("passed"), F.col("_c.failed").alias("failed"),
            old.adjusted_conf.alias("adjusted_conf"))).otherwise(old),
    }).drop("_c", "_v")


def refine_verdicts(rows: DataFrame) -> DataFrame:
    """After interpretation: accepted rows resting on a weak range or on low
    confidence carry a warning."""
    return beside(rows, "range_source confidence verification verification_verdict", _refined)


def _refined(rows: DataFrame) -> DataFrame:
    caution = F.col("range_source").isin(*CAUTION_SOURCES)
    low = F.col("confidence") == "low"
    hit = (F.col("verification_verdict") == "accepted") & (caution | low)
    old = F.col("verification")
    extra = _told(
        F.when(caution, F.concat(F.lit("[warn] range_source="), F.col("range_source"))),
        F.when(low, F.lit("[warn] confidence=low")))
    return rows.withColumn("_hit", hit).withColumns({
        "verification_verdict": F.when(F.col("_hit"), "accepted_with_warning").otherwise(F.col("verification_verdict")),
        "verification": F.when(F.col("_hit") & (old.verdict == "accept"),
                               old.withField("verdict", F.lit("accept_with_warning"))
                               .withField("reasons", F.concat(old.reasons, extra))).otherwise(old),
    }).drop("_hit")


def merge_verdicts(first: Column, second: Column) -> Column:
    """A rule verdict and a second verdict: the second holds unless it accepts
    what the rules failed; the confidence is the worse of the two."""
    overruled = (first.failed > 0) & (second.verdict == "accept")
    worse = confidence_rank(first.adjusted_conf) <= confidence_rank(second.adjusted_conf)
    return F.struct(
        F.when(overruled, "downgrade").otherwise(second.verdict).alias("verdict"),
        F.concat(first.reasons, second.reasons, F.when(
            overruled, F.array(F.lit("Model accepted but deterministic checks failed"))).otherwise(F.array().cast("array<string>"))).alias("reasons"),
        first.passed.alias("passed"), first.failed.alias("failed"),
        F.when(worse, first.adjusted_conf).otherwise(second.adjusted_conf).alias("adjusted_conf"))


def verdict_counts(rows: DataFrame) -> DataFrame:
    v = F.col("verification.verdict")
    return rows.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("verified"), F.count_if(v == "accept").alias("accepted"),
        F.count_if(v == "accept_with_warning").alias("warned"), F.count_if(v == "downgrade").alias("downgraded"),
        F.count_if(v == "mark_indeterminate").alias("indeterminate"))
