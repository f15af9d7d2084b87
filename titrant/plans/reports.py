"""Composite plans over a table of report rows: clean, enrich, interpret, roll up."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from titrant.operators import clean, conform, hplc, interpret as it, names as nm, rollup, sections, verify
from titrant.functions import text as tx
from titrant.session import saved
from titrant.fixed import analytes as fa
from titrant.fixed.qualitative import VALUE_ALIASES
from titrant.sources import dims, files

ROW_COLUMNS = ["report_id", "page_num", "row_idx", "test_name", "value_num", "value_text", "unit",
               "ref_low", "ref_high", "ref_text", "flag", "section_type"]


@dataclass
class Knowledge:
    """The dimension tables of an analysis; any of them can be the caller's own."""
    aliases: DataFrame
    families: DataFrame
    qualitative: DataFrame
    analytes: DataFrame
    panels: DataFrame
    spellings: dict = field(default_factory=lambda: VALUE_ALIASES)         # value words of text results
    caps: tuple = tuple(fa.SEVERITY_CAPS)                                  # (name part, highest severity)

    @classmethod
    def default(cls, spark: SparkSession) -> "Knowledge":
        return cls(dims.name_table(spark), dims.families(spark), dims.qualitative_rules(spark),
                   saved(dims.analytes(spark), "analytes"), dims.panels(spark))

    @classmethod
    def from_files(cls, spark: SparkSession, rules: str, qualitative: str, priority: str | None = None) -> "Knowledge":
        """The default knowledge with rules, assay rules, spellings and severity caps of the caller's files.
        Broken files raise here; files.scan and its callers report them as rows."""
        numeric, bad = files.numeric_rules(spark, rules)
        quals, spelled, odd = files.qualitative_rules(spark, qualitative)
        caps, wrong = (None, None) if priority is None else files.priority(spark, priority)[1:]
        for b in (bad, odd, wrong):
            first = None if b is None else b.first()
            if first is not None:
                raise ValueError(f"cannot read {first.file}, entry {first.pos}")
        quals = saved(quals, "qualitative")
        base = cls.default(spark)
        return replace(base, qualitative=quals, analytes=saved(dims.analytes(spark, rules=numeric, qualitative=quals), "analytes"),
                       spellings=dict(files.words(spelled, "spelling", "value")),
                       caps=base.caps if caps is None else tuple(files.words(caps, "token", "cap", order="ord")))

    @property
    def categories(self) -> DataFrame:
        return self.analytes.select("loinc_code", "category").filter("category is not null")


def knowledge(spark: SparkSession) -> Knowledge:
    """The default knowledge of a session, built once per session."""
    held = getattr(spark, "_titrant_knowledge", None)
    if held is None:
        held = Knowledge.default(spark)
        spark._titrant_knowledge = held
    return held


@dataclass
class Cleaned:
    rows: DataFrame
    blocks: DataFrame          # checked glycated haemoglobin blocks
    counts: DataFrame          # raw and filtered rows per report
    screening: DataFrame       # rows of screening attachments


def _with_second_rows(usual: DataFrame, second: DataFrame) -> DataFrame:
    """Patch badly extracted blocks of at least three rows from the second rows of their page."""
    block = ["report_id", "block_page", "block_id", "section_type"]
    first = saved(usual.withColumn("block_page", F.col("page_num")), "first")  # repaired once, read by three branches
    flagged = clean.suspicious_blocks(first, block).filter("suspicious and n_rows >= 3").select(*block)
    offers = second.join(flagged.withColumn("page_num", F.col("block_page")), ["report_id", "page_num"])
    merged = clean.merge_second_extraction(first.join(flagged, block, "left_semi"), offers.withColumn("row_idx", F.col("row_idx") * 4 + 3), block)
    columns = [c for c in merged.columns if c not in ("block_page", "block_id", "patched")]
    return first.join(flagged, block, "left_anti").select(*columns).unionByName(merged.select(*columns))


def _with_second_blocks(blocks: DataFrame, second: DataFrame) -> DataFrame:
    page = ["report_id", "page_num"]
    again = second.join(blocks.select(*page).distinct(), page, "left_semi")
    return hplc.choose_extraction(blocks, hplc.parse_blocks(again, page), page)


def clean_rows(raw: DataFrame, page_text: DataFrame | None = None, rows_per_chunk: int = sections.ROWS_PER_CHUNK,
               second: DataFrame | None = None, split: DataFrame | None = None) -> Cleaned:
    """Section the printed rows, parse glycated haemoglobin blocks, repair and
    filter the rest, and drop exact repeats.

    The typed rows are written once, and again with a page class; all four
    results read that table.  `split` may hold the rows as assign_blocks gives
    them, if they are at hand.  The blocks are written once too: their rows go
    into the cleaned rows and the counts.
    Rows without a name or value are dropped as unreadable.  Positions are
    spread by four so that emitted block rows find room in page order.

    `second` holds printed rows of a second extraction of some pages, in the
    shape of `raw`.  They patch suspicious blocks of three or more rows, and
    replace a glycated haemoglobin block that they complete; rows that they
    add get the free fourth position.
    """
    if split is None:
        split = sections.assign_blocks(raw, rows_per_chunk)
    if page_text is not None:
        split = sections.apply_page_class(split, page_text)
        split = saved(split, "split")  # rows, blocks, counts and screening all start here
    split = sections.drop_appendix(split)
    screening = split.filter(F.col("section_type") == sections.SCREENING)
    is_block = F.col("section_type") == sections.HPLC

    block_rows = split.filter(is_block).withColumns({
        "value_num": tx.plain_number(F.col("value_raw")),
        "ref_low": tx.plain_number(F.col("low_raw")), "ref_high": tx.plain_number(F.col("high_raw"))})
    blocks = hplc.parse_blocks(block_rows)
    if second is not None:
        blocks = _with_second_blocks(blocks, second.withColumns({
            "value_num": tx.plain_number(F.col("value_raw")),
            "ref_low": tx.plain_number(F.col("low_raw")), "ref_high": tx.plain_number(F.col("high_raw"))}))
    blocks = saved(blocks, "blocks")
    emitted = hplc.emit_rows(blocks).withColumn("row_idx", F.col("row_idx") * 4 + F.col("slot")).select(*ROW_COLUMNS)

    usual = split.filter(F.col("section_type").isin(sections.STANDARD, sections.HORMONE))
    usual = usual.filter(F.col("test_name").isNotNull() & F.col("value_raw").isNotNull())
    usual = clean.repair_numbers(usual).withColumn("row_idx", F.col("row_idx") * 4)
    if second is not None:
        again = second.filter(F.col("test_name").isNotNull() & F.col("value_raw").isNotNull())
        usual = _with_second_rows(usual, clean.repair_numbers(again))
    usual = clean.clear_scrambled_hplc_ranges(clean.clear_implausible_ranges(usual)).select(*ROW_COLUMNS)

    everything = usual.unionByName(emitted)
    kept = clean.drop_exact_duplicates(clean.drop_noise(everything))
    return Cleaned(kept, blocks, clean.noise_counts(everything), screening)


def enrich_rows(rows: DataFrame, know: Knowledge, blocks: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Verify, match, convert and mark the rows.  `names` may be a name table
    kept from an earlier run; otherwise the distinct names are matched first."""
    if names is None:
        names = nm.name_dimension(rows, know.aliases, know.categories, know.qualitative)
    if blocks is not None:
        rows = conform.add_hplc_category(rows, hplc.category_by_name(blocks))
    else:
        rows = rows.withColumn("hplc_category", F.lit(None).cast("string"))
    # the category comes first, while rows are narrow
    a = conform.conform(conform.attach_dimensions(verify.verify(rows), names, know.analytes))
    return verify.reverify(a.drop(*conform.CONFORM_ONLY))


DIMENSION_COLUMNS = ["rule", "qual", "name_qual", *conform.CONFORM_ONLY, "range_source_pre"]


def _decided(enriched: DataFrame, know: Knowledge | None) -> DataFrame:
    lexicons = {} if know is None else {"spellings": know.spellings, "caps": know.caps}
    a = it.enforce_direction_consistency(it.interpret(enriched, **lexicons))
    return verify.refine_verdicts(a).drop(*DIMENSION_COLUMNS)


def interpret_rows(enriched: DataFrame, know: Knowledge | None = None) -> DataFrame:
    """Interpret, withdraw flag-only directions, refine verdicts, add evidence."""
    return it.add_evidence(_decided(enriched, know))


def kept_interpretation(enriched: DataFrame, know: Knowledge | None = None) -> DataFrame:
    """interpret_rows, kept as a table.  The evidence repeats other columns, so
    it is put together where it is read."""
    return it.add_evidence(saved(_decided(enriched, know), "interpreted"))


def kept_marks(interpreted: DataFrame) -> DataFrame:
    """The rows with is_canonical.  Only the positions are kept as a table: what
    reads the rows joins the columns that it needs."""
    return rollup.mark_canonical(interpreted, saved(rollup.canonical_positions(interpreted), "canonical"))


@dataclass
class RolledUp:
    canonical: DataFrame
    alternates: DataFrame
    counters: DataFrame
    panels: DataFrame
    topics: DataFrame
    summary: DataFrame


def roll_up(interpreted: DataFrame, know: Knowledge, marked: DataFrame | None = None) -> RolledUp:
    """Counters and panels before deduplication, topics and summary after it.
    `marked` may hold the rows with is_canonical, as kept_marks gives them."""
    if marked is None:
        marked = kept_marks(interpreted)
    rows = rollup.canonical_rows(marked)
    return RolledUp(rows, rollup.alternate_rows(marked), rollup.report_counters(interpreted),
                    rollup.panel_completeness(interpreted, know.panels), rollup.topic_groups(rows), rollup.report_summary(rows))


def analyse(raw: DataFrame, know: Knowledge, page_text: DataFrame | None = None,
            rows_per_chunk: int = sections.ROWS_PER_CHUNK, second: DataFrame | None = None) -> tuple[Cleaned, DataFrame, RolledUp]:
    """The whole batch analysis of printed rows.  Each stage that is read more
    than once is kept as a table in the shared folder."""
    cleaned = clean_rows(raw, page_text, rows_per_chunk, second)
    cleaned = replace(cleaned, rows=saved(cleaned.rows, "rows"))
    interpreted = kept_interpretation(enrich_rows(cleaned.rows, know, cleaned.blocks), know)
    return cleaned, interpreted, roll_up(interpreted, know)


def payload_parts(rolled: RolledUp, slice_rows: int = 500) -> DataFrame:
    """JSON payload per report in records of bounded size: one head record, and
    the ordered rows of each topic in numbered slices."""
    rows = rollup.rank_within_topics(rolled.canonical)
    fields = ["rank_in_topic", "test_name", "value_num", "value_text", "unit", "direction", "severity", "display_severity",
              "is_minor", "is_panic", "actionability", "confidence", "rng_low", "rng_high", "range_source", "range_trust",
              "classification_state", "health_topic", "verification_verdict"]
    part = F.floor((F.col("rank_in_topic") - 1) / slice_rows)
    # the evidence is put together in the listed rows
    sources = [c for c in it.EVIDENCE_READS if c not in fields]
    listed = rows.groupBy("report_id", "topic", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(*fields, *sources))).alias("_rows"))
    item = lambda x: F.struct(*[x[c].alias(c) for c in fields], it.evidence(lambda c: x[c]).alias("evidence"))
    body = listed.select("report_id", "topic", "part", F.to_json(F.transform("_rows", item)).alias("payload"))
    topics = rolled.topics.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct(
        "topic_rank", "topic", "status", "summary", "abnormal_count", "indeterminate_count", "minor_count", "total_count"))).alias("topic_groups"))
    panels = rolled.panels.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct(
        "panel_name", "expected", "present", "missing"))).alias("panels"))
    head = (rolled.summary.join(rolled.counters, "report_id", "left").join(topics, "report_id", "left").join(panels, "report_id", "left"))
    columns = [c for c in head.columns if c != "report_id"]
    top = head.select("report_id", F.lit("").alias("topic"), F.lit(-1).cast("long").alias("part"), F.to_json(F.struct(*columns)).alias("payload"))
    return top.unionByName(body)
