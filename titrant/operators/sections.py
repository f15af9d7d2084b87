"""Page sectioning: page class from raw text, row blocks from row keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from titrant.fixed import lexicons as lx
from titrant.functions.beside import beside
from titrant.functions.keywords import has_any_word, words_found
from titrant.session import saved

STANDARD = "standard_lab_table"
HPLC = "hplc_diabetes_block"
HORMONE = "hormone_immunology_block"
SCREENING = "screening_attachment"
APPENDIX = "appendix_text"

# Row positions per sectioning unit of work.  A page longer than this is split
# and the open block is carried over the split.
ROWS_PER_CHUNK = 10_000


def page_class(text: Column, screening=tuple(lx.SCREENING_KEYWORDS), appendix=tuple(lx.APPENDIX_KEYWORDS)) -> Column:
    """Page-level section from distinct keywords: struct(section, confidence,
    keywords); section is null for ordinary pages."""
    low = F.lower(text)
    s, a = words_found(low, screening), words_found(low, appendix)
    ns, na = F.size(s), F.size(a)
    return F.struct(
        F.when(ns >= 2, SCREENING).when(na >= 3, APPENDIX).alias("section"),
        F.when(ns >= 2, F.least(F.lit(0.90) + ns * 0.02, F.lit(0.98)))
        .when(na >= 3, F.least(F.lit(0.85) + na * 0.02, F.lit(0.95))).alias("confidence"),
        F.when(ns >= 2, s).when(na >= 3, a).otherwise(F.array().cast("array<string>")).alias("keywords"))


def row_text() -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("test_name", "unit", "ref_text")]))


def row_type(text: Column) -> Column:
    return (F.when(has_any_word(text, lx.SCREENING_KEYWORDS), SCREENING)
            .when(has_any_word(text, lx.HPLC_KEYWORDS), HPLC)
            .when(has_any_word(text, lx.HORMONE_KEYWORDS), HORMONE)
            .otherwise(STANDARD))


def row_keywords(text: Column, kind: Column) -> Column:
    return (F.when(kind == SCREENING, words_found(text, lx.SCREENING_KEYWORDS))
            .when(kind == HPLC, words_found(text, lx.HPLC_KEYWORDS))
            .when(kind == HORMONE, words_found(text, lx.HORMONE_KEYWORDS))
            .otherwise(F.array().cast("array<string>")))


def assign_blocks(rows: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add row_type, section_type and block_id per (report_id, page_num).

    A new type opens a block only when the next row has it too; a single odd
    row stays in the running block.  Pages are cut into chunks of row positions
    so that no page, however long, is one task.  One shuffle by chunk finds
    each row's type and block count within its chunk, and its result is written
    once.  Only pages of several chunks need more: their chunks' last rows
    carry the open type and the block count from chunk to chunk.  That table
    has one row per chunk of such a page, and is empty when none is so long.
    """
    page = ["report_id", "page_num"]
    chunk = [*page, "_chunk"]
    placed = rows.filter(" and ".join(f"{c} is not null" for c in [*page, "row_idx"]))  # others belong to no page
    typed = placed.withColumns({
        "row_type": row_type(row_text()),
        "_chunk": F.floor(F.col("row_idx") / rows_per_chunk)})
    # kept as a table: the last rows and all rows both start from it, and the patterns run once
    seen = saved(beside(typed, "report_id page_num row_idx row_type _chunk", _within_chunks).select(
        *rows.columns, "row_type", "_chunk", "_first", "_opened", "_turns", "_here", "_last"), "typed")

    along = Window.partitionBy(*page).orderBy("_chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    summary = seen.filter("_last").select(
        *chunk, F.col("_first").alias("first_type"), F.col("row_type").alias("last_type"), F.col("_opened").alias("first_anchor"),
        F.col("_here").alias("last_anchor"), F.col("_turns").alias("turns"), F.count(F.lit(1)).over(Window.partitionBy(*page)).alias("_chunks"))
    summary = summary.filter("_chunks > 1")
    # the last row of a chunk is a start when the next chunk opens with its type
    summary = summary.withColumn("edge_anchor", F.when(
        F.lead("first_type").over(along) == F.col("last_type"), F.col("last_type")))
    summary = summary.withColumns({
        "opening": F.coalesce(F.col("first_anchor"), F.col("edge_anchor")),
        "closing": F.coalesce(F.col("edge_anchor"), F.col("last_anchor")),
        "turns": F.col("turns") + F.when(
            F.col("last_anchor").isNotNull() & (F.col("edge_anchor") != F.col("last_anchor")), 1).otherwise(0)})
    summary = summary.withColumn("carried", F.coalesce(
        F.last("closing", ignorenulls=True).over(earlier), F.first("first_type").over(along)))
    summary = summary.withColumn("turns", F.col("turns") + F.when(
        F.col("opening").isNotNull() & (F.col("opening") != F.col("carried")), 1).otherwise(0))
    summary = saved(summary.withColumn("block_base", F.coalesce(F.sum("turns").over(earlier), F.lit(0))).select(
        *chunk, "edge_anchor", "carried", "block_base"), "long_pages")

    joined = seen.join(summary, chunk, "left")
    carried = F.coalesce("carried", "_first")  # a chunk without others opens with its first row's type
    edge = F.when(F.col("_last"), F.col("edge_anchor"))
    running = F.coalesce(F.col("_here"), carried)
    return joined.select(
        *rows.columns, "row_type", F.coalesce(edge, running).alias("section_type"),
        (F.coalesce("block_base", F.lit(0)) + F.col("_turns") + F.when(F.col("_opened") != carried, 1).otherwise(0)
         + F.when(edge != running, 1).otherwise(0)).alias("block_id"))


def _within_chunks(typed: DataFrame) -> DataFrame:
    """First and running types and the count of blocks within each chunk."""
    inside = Window.partitionBy("report_id", "page_num", "_chunk").orderBy("row_idx")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # a row starts a sustained run when its successor has the same type
    seen = typed.withColumns({"_next": F.lead("row_type").over(inside), "_first": F.first("row_type").over(upto)})
    seen = seen.withColumn("_anchor", F.when(F.col("_next") == F.col("row_type"), F.col("row_type")))
    seen = seen.withColumns({
        "_prev_anchor": F.last("_anchor", ignorenulls=True).over(before),
        "_opened": F.first("_anchor", ignorenulls=True).over(upto)})
    turn = F.when(F.col("_anchor") != F.col("_prev_anchor"), 1).otherwise(0)
    return seen.withColumns({
        "_turns": F.sum(turn).over(upto), "_here": F.coalesce("_anchor", "_prev_anchor"), "_last": F.col("_next").isNull()}).drop("_next", "_anchor", "_prev_anchor")


def block_summary(rows: DataFrame) -> DataFrame:
    """One row per block: type, size, distinct keywords, confidence."""
    own = F.when(F.col("row_type") == F.col("section_type"), row_keywords(row_text(), F.col("row_type")))
    exploded = rows.withColumn("_kw", own)
    n = F.size("trigger_keywords")
    # the keyword vocabulary is fixed, so the collected set is bounded by it
    return (exploded.groupBy("report_id", "page_num", "block_id", "section_type")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("_kw")))).alias("trigger_keywords"))
            .withColumn("confidence", F.when((F.col("section_type") == STANDARD) | (n == 0), 1.0)
                        .when(n >= 3, 0.95).when(n == 2, 0.80).otherwise(0.60)))


def drop_appendix(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("section_type") != APPENDIX)


def apply_page_class(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Override the row blocks of pages whose raw text decides the section."""
    decided = (pages.select("report_id", "page_num", page_class(F.col("raw_text")).section.alias("_page_section"))
               .filter(F.col("_page_section").isNotNull()))
    joined = rows.join(decided, ["report_id", "page_num"], "left")
    return joined.withColumns({
        "section_type": F.coalesce("_page_section", "section_type"),
        "block_id": F.when(F.col("_page_section").isNotNull(), 0).otherwise(F.col("block_id")),
    }).drop("_page_section")
