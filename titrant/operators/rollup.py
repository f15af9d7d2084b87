"""Report rollups: duplicate analytes, topics, findings, panels, summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from titrant.fixed import lexicons as lx
from titrant.fixed.analytes import TOPICS
from titrant.functions import text as tx
from titrant.functions.ordering import split_row_number
from titrant.functions.ranks import STATUS, confidence_rank, label, rank, severity_rank
from titrant.operators.interpret import display_severity, evidence_after, low_priority

SOURCE_TRUST = ["no-range", "range-text", "lab-provided-suspicious", "unit-corrected", "curated-fallback", "lab-provided-validated"]


# ---- row predicates ------------------------------------------------------

def is_classified() -> Column:
    return F.col("classification_state") == "classified"


def needs_attention() -> Column:
    return is_classified() & (F.col("severity").isin("moderate", "critical") | F.col("is_panic"))


def is_abnormal() -> Column:
    return needs_attention() | (is_classified() & (F.col("severity") == "mild"))


def is_unclear() -> Column:
    return (F.col("classification_state").isin("could_not_classify", "low_confidence")
            | (F.col("direction") == "indeterminate"))


def is_minor() -> Column:
    return is_abnormal() & low_priority(F.col("test_name"))


def serious() -> Column:
    """Panic, or moderate or critical severity, whatever the state."""
    return F.col("is_panic") | F.col("severity").isin("moderate", "critical")


def status_rank() -> Column:
    return F.when(F.col("is_panic"), 3).otherwise(severity_rank(F.col("severity")))


def width_deviation() -> Column:
    """Distance outside the range in range widths (topic order)."""
    v, lo, hi = F.col("value_num"), F.col("rng_low"), F.col("rng_high")
    w = hi - lo
    return F.coalesce(F.when(w > 0, F.when(v < lo, (lo - v) / w).when(v > hi, (v - hi) / w)), F.lit(0.0))


def bound_deviation() -> Column:
    """Distance outside the range relative to the bound (finding order)."""
    v, lo, hi = F.col("value_num"), F.col("rng_low"), F.col("rng_high")
    unit = lambda b: F.abs(F.when(b == 0, F.lit(1.0)).otherwise(b))
    return F.coalesce(F.when(F.col("direction") != "indeterminate",
                             F.when(v > hi, F.abs(v - hi) / unit(hi)).when(v < lo, F.abs(lo - v) / unit(lo))), F.lit(0.0))


# ---- duplicate analytes --------------------------------------------------

def _grouped() -> Column:
    return F.coalesce(F.col("section_type"), F.lit("")) != "hplc_diabetes_block"


def canonical_positions(rows: DataFrame) -> DataFrame:
    """Positions of the most trustworthy rows of those naming the same analyte.

    Groups are (report, analyte key), split by code when a key has several.
    The best row per (report, key, code) is an aggregate, so repeated names
    shrink before the shuffle; the decision joins back on the row's own
    position, which no group can skew.
    """
    best = F.struct(
        confidence_rank(F.col("confidence")).alias("a"),
        F.when(tx.strip(F.coalesce(F.col("unit"), F.lit(""))) != "", 1).otherwise(0).alias("b"),
        rank(F.col("range_source"), SOURCE_TRUST).alias("c"),
        confidence_rank(F.col("unit_conf")).alias("d"),
        (-F.col("page_num")).alias("p"), (-F.col("row_idx")).alias("r"))
    per_code = (rows.filter(_grouped())
                .groupBy("report_id", tx.analyte_key(F.col("test_name")).alias("_k"), "loinc_code")
                .agg(F.max(best).alias("best")))
    over = Window.partitionBy("report_id", "_k")
    ranked = per_code.withColumns({"_codes": F.count("loinc_code").over(over), "_top": F.max("best").over(over)})
    return ranked.filter((F.col("_codes") > 1) | (F.col("best") == F.col("_top"))).select(
        "report_id", (-F.col("best.p")).alias("page_num"), (-F.col("best.r")).alias("row_idx"))


def mark_canonical(rows: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Add is_canonical: the row's position is among the canonical ones, or its
    block is not deduplicated.  `positions` may be a kept table of them."""
    won = canonical_positions(rows) if positions is None else positions
    # one position per analyte of a report: never small enough to send to every task
    joined = evidence_after(rows, lambda a: a.join(won.withColumn("_won", F.lit(True)).hint("merge"), ["report_id", "page_num", "row_idx"], "left"))
    return joined.withColumn("is_canonical", F.coalesce("_won", F.lit(False)) | ~_grouped()).drop("_won")


def canonical_rows(marked: DataFrame) -> DataFrame:
    return marked.filter("is_canonical")


def alternate_rows(marked: DataFrame) -> DataFrame:
    return marked.filter("not is_canonical")


# ---- topics --------------------------------------------------------------

def _topic() -> Column:
    return F.coalesce(F.col("health_topic"), F.lit("other"))


def topic_summary(abnormal: Column, unclear: Column, minor: Column, total: Column) -> Column:
    parts = F.concat_ws(
        " · ",
        F.when(abnormal > 0, F.concat(abnormal.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" worth follow-up"))),
        F.when(minor > 0, F.concat(minor.cast("string"), F.lit(" minor"))),
        F.when(unclear > 0, F.concat(unclear.cast("string"), F.lit(" unclear"))))
    return F.when(abnormal + unclear + minor == 0, F.concat(F.lit("All normal ("), total.cast("string"), F.lit(")"))).otherwise(parts)


def topic_groups(rows: DataFrame) -> DataFrame:
    """One row per report and topic: counts, worst status, summary, display order."""
    g = rows.groupBy("report_id", _topic().alias("topic")).agg(
        F.count_if(is_abnormal() & ~is_minor()).alias("abnormal_count"),
        F.count_if(is_unclear() & ~is_abnormal()).alias("indeterminate_count"),
        F.count_if(is_minor()).alias("minor_count"),
        F.count(F.lit(1)).alias("total_count"), F.max(status_rank()).alias("_s"))
    order = F.array_position(F.array(*[F.lit(t) for t in TOPICS]), F.col("topic"))
    place = F.when(order == 0, len(TOPICS) + 1).otherwise(order)
    # a report has at most one row per topic here
    w = Window.partitionBy("report_id").orderBy(F.desc("_s"), F.desc("abnormal_count"), place, "topic")
    return g.withColumns({
        "status": label(F.col("_s"), STATUS),
        "summary": topic_summary(F.col("abnormal_count"), F.col("indeterminate_count"), F.col("minor_count"), F.col("total_count")),
        "topic_rank": F.row_number().over(w)}).drop("_s")


def rank_within_topics(rows: DataFrame) -> DataFrame:
    """Position of each row in its topic: abnormal, unclear, normal; then panic,
    severity, deviation, name, and the order on the report."""
    dev, name = width_deviation(), F.lower(F.coalesce(F.col("test_name"), F.lit("")))
    a = rows.withColumns({"topic": _topic(), "_dev": dev, "_name": name,
                          "is_minor": is_minor(), "display_severity": display_severity(F.col("test_name"), F.col("severity"))})
    flat = F.col("_dev") == 0
    prefix = {
        "_b1": F.when(is_abnormal(), 0).when(is_unclear(), 1).otherwise(2),
        "_b2": F.when(F.col("is_panic"), 0).otherwise(1),
        "_b3": 3 - severity_rank(F.col("severity")),
        # rows on their range sort last; the others by slices of deviation
        "_b4": F.when(flat, F.lit(1)).otherwise(-F.least(F.floor(F.col("_dev") * 64), F.lit(1_000_000))),
        "_b5": F.when(flat, F.substring("_name", 1, 2)).otherwise("")}
    order = [F.desc("_dev"), F.asc("_name"), F.asc("page_num"), F.asc("row_idx")]
    return evidence_after(a, lambda b: split_row_number(b, ["report_id", "topic"], prefix, order, "rank_in_topic")).drop("_dev", "_name")


# ---- findings and summary ------------------------------------------------

def top_findings(rows: DataFrame, k: int = 3) -> DataFrame:
    """The k leading abnormal rows per report; low-priority analytes count only
    where nothing else is abnormal.

    Both kinds are cut to k per report before the shuffle, so the final choice
    sees at most 2k rows per report.
    """
    hit = F.col("severity").isin("mild", "moderate", "critical") | F.col("is_panic")
    a = rows.filter(hit).withColumns({"_low": low_priority(F.col("test_name")), "_sev": severity_rank(F.col("severity")),
                                      "_dev": bound_deviation()})
    order = [F.desc("_sev"), F.desc("is_panic"), F.desc("_dev"), F.asc("page_num"), F.asc("row_idx")]
    cut = a.withColumn("finding_rank", F.row_number().over(Window.partitionBy("report_id", "_low").orderBy(*order))).filter(F.col("finding_rank") <= k)
    kept = cut.withColumn("_any", F.min(F.col("_low").cast("int")).over(Window.partitionBy("report_id"))).filter(
        F.col("_low").cast("int") == F.col("_any"))
    return kept.drop("_low", "_sev", "_dev", "_any")


def finding_fields() -> dict[str, Column]:
    """Display projection of a finding with its value domains clamped."""
    d = F.col("direction")
    return {
        "finding_direction": F.when(d.isin("high", "low", "indeterminate"), d).otherwise("indeterminate"),
        "finding_severity": F.when(F.col("severity").isin("mild", "moderate", "critical"), F.col("severity")).otherwise("mild"),
        "plain_language_key": F.when(d == "high", "direction.high").when(d == "low", "direction.low").otherwise("direction.needs_review"),
        "finding_topic": _topic(), "finding_unit": F.nullif(F.col("unit"), F.lit(""))}


def fallback_headline(status: Column) -> Column:
    return F.element_at(tx.literal_map(lx.HEADLINES.items()), status)


def next_step(status: Column, names: Column) -> Column:
    """Sentence naming the leading findings; null on green or without findings."""
    listed = tx.join_with_and(F.transform(F.slice(names, 1, 3), lambda n: tx.short_name(n)))
    return F.when((status != "green") & (F.size(names) > 0) & (listed != ""), F.when(
        status == "red", F.concat(F.lit("Talk to a doctor about "), listed, F.lit(".")))
        .otherwise(F.concat(F.lit("At your next routine visit, ask about "), listed, F.lit("."))))


def report_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("report_id").agg(F.max(status_rank()).alias("_s"), F.count_if(is_unclear()).alias("indeterminate_count")).select(
        "report_id", label(F.col("_s"), STATUS).alias("overall_status"), "indeterminate_count")


def report_summary(rows: DataFrame) -> DataFrame:
    """Status, headline, leading findings, unclear count and next step per report."""
    f = top_findings(rows).withColumns(finding_fields())
    item = F.struct("finding_rank", "test_name", "value_num", "value_text", "finding_unit", "finding_direction",
                    "finding_severity", "is_panic", "finding_topic", "plain_language_key")
    listed = f.groupBy("report_id").agg(F.array_sort(F.collect_list(item)).alias("top_findings"))
    joined = report_status(rows).join(listed.hint("merge"), "report_id", "left")  # findings of every report
    findings = F.coalesce("top_findings", F.array().cast(listed.schema["top_findings"].dataType))
    status = F.col("overall_status")
    return joined.withColumns({
        "top_findings": findings, "headline": fallback_headline(status), "next_steps_key": status,
        "uncertainty_note_key": F.when(F.col("indeterminate_count") > 0, "summary.indeterminate.note"),
        "next_step_detailed": next_step(status, F.transform(findings, lambda x: x.test_name))})


# ---- counters and panels -------------------------------------------------

def coverage_score() -> Column:
    return F.format_string("%d/%d analytes parsed, %d abnormal detected", "total_parsed", "total_parsed", "total_abnormal")


def report_counters(rows: DataFrame) -> DataFrame:
    n, bad = F.count(F.lit(1)), F.count_if(F.col("direction").isin("high", "low"))
    return rows.groupBy("report_id").agg(n.alias("total_parsed"), bad.alias("total_abnormal")).withColumn("coverage_score", coverage_score())


def inferred_topics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("report_id").agg(F.count(F.lit(1)).alias("tagged"), F.count_if("topic_inferred").alias("inferred"))


def distribution(rows: DataFrame) -> DataFrame:
    """Row counts by direction, by severity, by section and by verdict."""
    cols = ["direction", "severity", "section_type", "verification_verdict"]
    sets = rows.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols])
    ids = [F.grouping(c).alias(f"_g{i}") for i, c in enumerate(cols)]
    out = sets.agg(F.count(F.lit(1)).alias("n"), *ids)
    return out.select(
        reduce(lambda a, b: a.when(b[0], b[1]), [(F.col(f"_g{i}") == 0, c) for i, c in enumerate(cols)], F).alias("facet"),
        F.coalesce(*[F.when(F.col(f"_g{i}") == 0, F.col(c)) for i, c in enumerate(cols)]).alias("value"), "n")


def panel_completeness(rows: DataFrame, panels: DataFrame) -> DataFrame:
    """Panels of which a report has at least two members: present and missing."""
    members = panels.select("panel_name", "expected", F.explode("expected").alias("loinc_code"))
    have = rows.select("report_id", "loinc_code").join(members, "loinc_code")
    # a set of panel members, at most the size of the panel
    got = have.groupBy("report_id", "panel_name", "expected").agg(F.array_sort(F.collect_set("loinc_code")).alias("present"))
    return got.filter(F.size("present") >= 2).withColumn("missing", F.array_sort(F.array_except("expected", "present")))


def band_gaps(rules: DataFrame) -> DataFrame:
    """Consecutive severity bands with a gap of more than one unit between them."""
    bands = rules.select("loinc_code", F.explode("severity_bands").alias("b")).select("loinc_code", "b.*")
    w = Window.partitionBy("loinc_code").orderBy("low", "high", "band")
    nxt = bands.withColumns({"next_low": F.lead("low").over(w), "next_band": F.lead("band").over(w)})
    return nxt.filter(F.col("next_low") > F.col("high") + 1.0)
