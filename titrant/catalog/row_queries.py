"""Queries of the row operators over the lab view."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from titrant.catalog import chain as ch
from titrant.catalog.labview import POSITIONS_PER_PAGE
from titrant.catalog.registry import columns, query
from titrant.fixed import analytes as fa, lexicons as lx
from titrant.functions import text as tx
from titrant.functions.chosen import chosen
from titrant.functions.units import normal_unit, possible_in_unit
from titrant.operators import clean, conform, explain, hplc, interpret as it, names as nm, qualitative as ql, rollup, sections, verify
from titrant.sources import dims

KEY = "report_id, page_num, row_idx"
K = ["report_id", "page_num", "row_idx"]


# ---- dimensions against the rows ----------------------------------------

_BY_CODE = "(SELECT n.loinc_code, count(*) AS n FROM kept k JOIN names n USING (test_name) GROUP BY 1)"


def rows_per_code(s):
    return s.rows.join(s.names.select("test_name", "loinc_code"), "test_name").groupBy("loinc_code").agg(F.count(F.lit(1)).alias("n"))


def counted(dimension, counts, on, *cols):
    """Every row of a dimension with the number of lab rows that hit it."""
    return dimension.join(counts, on, "left").select(*cols, F.coalesce("n", F.lit(0).cast("long")).alias("n_rows"))


@query("rule_bands", f"""SELECT r.loinc_code, b.band, b.low, b.high, r.r0_low AS first_low, r.r0_high AS first_high, coalesce(n, 0) AS n_rows
  FROM (SELECT loinc_code, r0_low, r0_high, unnest(bands) AS b FROM rules) r LEFT JOIN {_BY_CODE} c ON c.loinc_code = r.loinc_code""")
def rule_bands(s):
    bands = dims.rule_struct(dims.numeric_rules(s.spark)).select("loinc_code", "rule.first_low", "rule.first_high", F.explode("rule.bands").alias("b"))
    return counted(bands, rows_per_code(s), "loinc_code", "loinc_code", "b.band", "b.low", "b.high", "first_low", "first_high")


@query("qualitative_rules", f"SELECT q.loinc_code, q.category, q.threshold, coalesce(n, 0) AS n_rows FROM qual q LEFT JOIN {_BY_CODE} c ON c.loinc_code = q.loinc_code")
def qualitative_rules(s):
    return counted(dims.qualitative_rules(s.spark), rows_per_code(s), "loinc_code", "loinc_code", "category", "threshold")


@query("alias_keys", """SELECT w.kind, w.key, w.loinc, coalesce(n, 0) AS n_rows FROM (SELECT kind, key, arg_max(loinc, ord) AS loinc FROM words GROUP BY 1, 2) w
  LEFT JOIN (SELECT trim(lower(test_name)) AS key, count(*) AS n FROM kept GROUP BY 1) c ON c.key = w.key""")
def alias_keys(s):
    counts = s.rows.groupBy(tx.raw_key(F.col("test_name")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counted(nm.dictionary(s.know.aliases), counts, "key", "kind", "key", "loinc")


@query("unit_factors", """SELECT c.loinc_code, c.unit, c.canonical_unit, c.factor, coalesce(n, 0) AS n_rows
  FROM (SELECT loinc_code, canonical AS canonical_unit, f.f AS unit, f.x AS factor FROM (SELECT loinc_code, canonical, unnest(factors) AS f FROM conv)) c
  LEFT JOIN (SELECT n.loinc_code, lower(k.unit) AS u, count(*) AS n FROM kept k JOIN names n USING (test_name) GROUP BY 1, 2) r ON r.loinc_code = c.loinc_code AND r.u = lower(c.unit)""")
def unit_factors(s):
    counts = s.rows.join(s.names.select("test_name", "loinc_code"), "test_name").groupBy("loinc_code", F.lower("unit").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    factors = dims.unit_conversions(s.spark).select("loinc_code", "canonical_unit", F.explode("factors").alias("f"))
    factors = factors.select("loinc_code", "canonical_unit", F.col("f.from_unit").alias("unit"), F.col("f.factor").alias("factor"), F.lower("f.from_unit").alias("u"))
    return counted(factors, counts, ["loinc_code", "u"], "loinc_code", "unit", "canonical_unit", "factor")


@query("code_categories", f"SELECT f.loinc_code, f.category, coalesce(n, 0) AS n_rows FROM famc f LEFT JOIN {_BY_CODE} c ON c.loinc_code = f.loinc_code")
def code_categories(s):
    return counted(dims.last_category(s.know.families), rows_per_code(s), "loinc_code", "loinc_code", "category")


@query("priority_tokens", f"SELECT t.token, t.cap, count(k.test_name) AS n_rows FROM (VALUES {', '.join(f'({ch._sql(t)}, {ch._sql(c)})' for t, c in fa.SEVERITY_CAPS)}) t(token, cap) LEFT JOIN kept k ON contains(lower(k.test_name), t.token) GROUP BY ALL")
def priority_tokens(s):
    tokens = s.spark.createDataFrame([tuple(x) for x in fa.SEVERITY_CAPS], "token string, cap string")
    pairs = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(c).alias("cap")) for t, c in fa.SEVERITY_CAPS])
    hits = F.filter(pairs, lambda p: F.contains(F.lower("test_name"), p.token))
    counts = s.rows.select(F.explode(hits).alias("p")).groupBy("p.token", "p.cap").agg(F.count(F.lit(1)).alias("n"))
    return counted(tokens, counts, ["token", "cap"], "token", "cap")


# ---- cleaning ------------------------------------------------------------

@query("decimal_comma_fix", f"SELECT {KEY}, {ch.comma_fixed('value_raw')} AS value_fixed, {ch.comma_fixed('low_raw')} AS low_fixed FROM lab")
def decimal_comma_fix(s):
    return s.lab.select(*K, tx.decimal_comma(F.col("value_raw")).alias("value_fixed"), tx.decimal_comma(F.col("low_raw")).alias("low_fixed"))


@query("numeric_coercion", f"SELECT {KEY}, {ch.lab_number('value_raw')} AS value_num, {ch.lab_number('high_raw')} AS high_num FROM lab")
def numeric_coercion(s):
    return s.lab.select(*K, tx.lab_number(F.col("value_raw")).alias("value_num"), tx.lab_number(F.col("high_raw")).alias("high_num"))


@columns("range_field_repair", "rep4", f"{KEY}, value_num, value_text, ref_low, ref_high, ref_text")
def range_field_repair(s):
    return clean.repair_numbers(s.sect).select(*K, "value_num", "value_text", "ref_low", "ref_high", "ref_text")


@columns("implausible_range_clear", "rep5", f"{KEY}, ref_low, ref_high, bad", alias={"bad": "coalesce(bad, false)"})
def implausible_range_clear(s):
    a = clean.repair_numbers(s.sect).withColumn("bad", F.coalesce(clean.implausible_range(), F.lit(False)))
    return clean.clear_implausible_ranges(a).select(*K, "ref_low", "ref_high", "bad")


@columns("hplc_range_clear", "rep6", f"{KEY}, ref_low, ref_high")
def hplc_range_clear(s):
    a = clean.clear_implausible_ranges(clean.repair_numbers(s.sect))
    return clean.clear_scrambled_hplc_ranges(a).select(*K, "ref_low", "ref_high")


@query("normal_names", f"SELECT test_name, {ch.abbreviated('nk')} AS norm_key, count(*) AS n_rows FROM (SELECT test_name, {ch.normal_name('test_name')} AS nk FROM lab) GROUP BY ALL")
def normal_names(s):
    return s.lab.groupBy("test_name").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("norm_key", tx.normal_name(F.col("test_name")))


@query("name_keys", f"""SELECT test_name, {ch.bare_name('test_name', '*#†‡')} AS scoring, {ch.bare_name('test_name')} AS merging, {ch.analyte_key('test_name')} AS dedup,
  {ch.fold('test_name')} AS folded, count(*) AS n_rows FROM lab GROUP BY ALL""")
def name_keys(s):
    n = F.col("test_name")
    return s.lab.groupBy("test_name").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "test_name", tx.scoring_key(n).alias("scoring"), tx.bare_name(n).alias("merging"), tx.analyte_key(n).alias("dedup"), tx.fold_key(n).alias("folded"), "n_rows")


@query("normal_units", f"SELECT unit, {ch.unit_norm('unit')} AS unit_norm, count(*) AS n_rows FROM lab WHERE unit IS NOT NULL GROUP BY ALL")
def normal_units(s):
    return s.lab.filter("unit is not null").groupBy("unit").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("unit_norm", normal_unit(F.col("unit")))


@query("flag_allowlist", f"SELECT {KEY}, CASE WHEN upper(trim(flag)) IN ('H', 'L', 'A') THEN upper(trim(flag)) END AS flag_clean FROM lab")
def flag_allowlist(s):
    return s.lab.select(*K, it.clean_flag(F.col("flag")).alias("flag_clean"))


@query("short_names", r"SELECT test_name, regexp_replace(trim(split_part(trim(regexp_replace(trim(test_name), '\s*\([^)]*\)', '', 'g')), ',', 1)), '\s+', ' ', 'g') AS short, count(*) AS n_rows FROM lab GROUP BY ALL")
def short_names(s):
    return s.lab.groupBy("test_name").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("short", tx.short_name(F.col("test_name")))


@query("canonical_values", f"SELECT value_raw, {ch.canonical_value('value_raw')} AS canonical, count(*) AS n_rows FROM lab WHERE {ch.lab_number('value_raw')} IS NULL GROUP BY ALL")
def canonical_values(s):
    v = F.col("value_raw")
    return s.lab.filter(tx.lab_number(v).isNull()).groupBy("value_raw").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("canonical", ql.canonical_value(v))


@query("numeric_promotion", f"SELECT {KEY}, {ch.number('value_raw')} AS value_num FROM lab")
def numeric_promotion(s):
    return s.lab.select(*K, tx.plain_number(F.col("value_raw")).alias("value_num"))


@query("noise_filter", f"SELECT {KEY}, test_name, value_text, is_noise FROM noised")
def noise_filter(s):
    return all_rows(s).select(*K, "test_name", "value_text", clean.noise().alias("is_noise"))


def all_rows(s):
    """Repaired rows before the noise filter, block rows included."""
    usual = s.sect.filter(F.col("section_type").isin(sections.STANDARD, sections.HORMONE))
    fixed = clean.clear_scrambled_hplc_ranges(clean.clear_implausible_ranges(clean.repair_numbers(usual)))
    emitted = hplc.emit_rows(s.blocks).withColumn("row_idx", F.col("row_idx") * 4 + F.col("slot"))
    cols = ch.COLS.split(", ")
    return fixed.withColumn("row_idx", F.col("row_idx") * 4).select(*cols).unionByName(emitted.select(*cols))


@query("noise_counters", "SELECT report_id, count(*) AS raw_extracted_count, count(*) FILTER (WHERE is_noise) AS filtered_noise_count FROM noised GROUP BY 1")
def noise_counters(s):
    return clean.noise_counts(all_rows(s))


@columns("cleaned_rows", "kept", ch.COLS)
def cleaned_rows(s):
    return s.cleaned.rows


@query("exact_duplicates", f"SELECT report_id, test_name, value_num, value_text, unit, count(*) - 1 AS dropped FROM noised WHERE NOT is_noise GROUP BY ALL HAVING count(*) > 1")
def exact_duplicates(s):
    before = clean.drop_noise(all_rows(s))
    key = ["report_id", "test_name", "value_num", "value_text", "unit"]
    a = before.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    b = clean.drop_exact_duplicates(before).groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    return a.alias("a").join(b.alias("b"), cond).filter("n > m").select(*[f"a.{c}" for c in key], (F.col("n") - F.col("m")).alias("dropped"))


@query("extraction_warnings", f"""SELECT {KEY}, list_filter([CASE WHEN value_raw IS NULL THEN test_name || ': missing value' END,
  CASE WHEN unit IS NULL THEN test_name || ': missing unit' END], lambda x: x IS NOT NULL) AS warnings FROM sect""")
def extraction_warnings(s):
    return clean.extraction_warnings(clean.repair_numbers(s.sect)).select(*K, "warnings")


@query("plausibility_warnings", f"""SELECT {KEY}, list_filter([CASE WHEN value_num NOT BETWEEN h_low AND h_high THEN 'Plausibility fail: ' || test_name END,
    CASE WHEN ref_low >= ref_high THEN 'Invalid ref range for ' || test_name WHEN ref_low IS NOT NULL AND ref_high IS NOT NULL AND (ref_low < 0 OR ref_high < 0) THEN 'Negative ref range for ' || test_name END],
    lambda x: x IS NOT NULL) AS warnings, CASE WHEN ref_low >= ref_high THEN NULL ELSE ref_low END AS ref_low
  FROM (SELECT r.*, n.loinc_code FROM rep4 r LEFT JOIN names n USING (test_name)) LEFT JOIN human USING (loinc_code)""")
def plausibility_warnings(s):
    rows = clean.repair_numbers(s.sect).join(s.names.select("test_name", "loinc_code"), "test_name", "left")
    return clean.plausibility_warnings(rows, dims.human_bounds(s.spark)).select(*K, "warnings", "ref_low")


@query("unit_bound_checks", f"SELECT k.report_id, k.page_num, k.row_idx, u_low IS NULL OR value_num BETWEEN u_low AND u_high AS possible FROM kept k LEFT JOIN ubounds u ON lower(trim(k.unit)) = u.unit WHERE value_num IS NOT NULL")
def unit_bound_checks(s):
    return s.rows.filter("value_num is not null").select(*K, possible_in_unit(F.col("value_num"), F.col("unit")).alias("possible"))


@query("human_bound_checks", f"SELECT a.report_id, a.page_num, a.row_idx, h_low IS NULL OR value_num BETWEEN h_low AND h_high AS possible FROM att a LEFT JOIN human h ON a.m_code = h.loinc_code WHERE value_num IS NOT NULL")
def human_bound_checks(s):
    j = conform.attach_dimensions(s.rows, s.names, s.know.analytes).filter("value_num is not null")
    ok = F.col("value_num").between(F.col("human.human_low"), F.col("human.human_high"))
    return j.select(*K, F.coalesce(ok, F.lit(True)).alias("possible"))


@query("inverted_ranges", f"SELECT {KEY}, ref_low IS NOT NULL AND ref_high IS NOT NULL AND (ref_low >= ref_high OR ref_low < 0 OR ref_high < 0) AS inverted FROM rep4")
def inverted_ranges(s):
    return clean.repair_numbers(s.sect).select(*K, clean.inverted_range().alias("inverted"))


@query("suspicious_blocks", """SELECT *, n_rows < 3 OR missing_units / n_rows > 0.5 OR missing_ranges / n_rows > 0.5 AS suspicious FROM (
  SELECT report_id, page_num, block_id, count(*) AS n_rows, count(*) FILTER (WHERE coalesce(unit, '') = '') AS missing_units,
    count(*) FILTER (WHERE ref_low IS NULL AND ref_high IS NULL) AS missing_ranges FROM rep4 GROUP BY 1, 2, 3)""")
def suspicious_blocks(s):
    return clean.suspicious_blocks(clean.repair_numbers(s.sect), ["report_id", "page_num", "block_id"])


@query("second_extraction_merge", f"""
SELECT report_id, page_num, row_idx, test_name, unit, ref_low, ref_high, patched FROM (
  SELECT f.report_id, f.page_num, f.row_idx, coalesce(c.c.test_name, f.test_name) AS test_name, CASE WHEN c.c IS NULL THEN f.unit ELSE c.c.unit END AS unit,
    CASE WHEN c.c IS NULL THEN f.ref_low ELSE c.c.ref_low END AS ref_low, CASE WHEN c.c IS NULL THEN f.ref_high ELSE c.c.ref_high END AS ref_high, c.c IS NOT NULL AS patched
  FROM first_x f LEFT JOIN (SELECT f.page_num, f.row_idx, f.report_id, arg_min({{'test_name': s.test_name, 'unit': s.unit, 'ref_low': s.ref_low, 'ref_high': s.ref_high}}, {{'p': s.page_num, 'r': s.row_idx}}) AS c
    FROM first_x f JOIN second_x s ON f.report_id = s.report_id AND f.k = s.k AND NOT f.ok AND s.ok AND (f.u = '' OR f.u = s.u) GROUP BY 1, 2, 3) c
    ON f.report_id = c.report_id AND f.page_num = c.page_num AND f.row_idx = c.row_idx)
UNION ALL SELECT report_id, page_num, row_idx, test_name, unit, ref_low, ref_high, true FROM second_x s WHERE ok AND k <> ''
  AND NOT EXISTS (SELECT 1 FROM first_x f WHERE f.report_id = s.report_id AND f.k = s.k)""")
def second_extraction_merge(s):
    first = s.rows.filter("row_idx % 5 <> 4").withColumn("unit", F.when(F.col("row_idx") % 3 != 0, F.col("unit")))
    second = s.rows.filter("row_idx % 2 = 0")
    out = clean.merge_second_extraction(first, second, ["report_id"])
    return out.select(*K, "test_name", "unit", "ref_low", "ref_high", "patched")


_COMPLETE = "coalesce(unit, '') <> '' AND (ref_low IS NOT NULL OR ref_high IS NOT NULL) AS ok, lower(trim(coalesce(unit, ''))) AS u"
ch.cte("first_x", f"SELECT *, {ch.bare_name('test_name')} AS k, {_COMPLETE} FROM (SELECT * REPLACE (CASE WHEN row_idx % 3 <> 0 THEN unit END AS unit) FROM kept WHERE row_idx % 5 <> 4)")
ch.cte("second_x", f"SELECT *, {ch.bare_name('test_name')} AS k, {_COMPLETE} FROM kept WHERE row_idx % 2 = 0")


@query("empty_report_status", """SELECT r.report_id, coalesce(c.n, 0) AS raw_extracted_count, coalesce(c.f, 0) AS filtered_noise_count,
  CASE WHEN coalesce(c.n, 0) > coalesce(c.f, 0) THEN 'ok' WHEN coalesce(c.n, 0) > 0 THEN 'extraction_unusable' ELSE 'extraction_empty' END AS extraction_status
  FROM (SELECT o_orderkey AS report_id FROM orders) r LEFT JOIN (SELECT report_id, count(*) AS n, count(*) FILTER (WHERE is_noise) AS f FROM noised GROUP BY 1) c USING (report_id)""")
def empty_report_status(s):
    # order numbers beyond the last report have no rows and must survive
    reports = s.table("orders").select(F.col("o_orderkey").alias("report_id"))
    return clean.empty_report_status(clean.noise_counts(all_rows(s)), reports)


@query("report_headers", """SELECT o_custkey AS report_id, coalesce(arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0), 'en') AS source_language,
  arg_min(o_orderstatus, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) AS lab_name FROM orders GROUP BY 1""")
def report_headers(s):
    pages = s.table("orders").select(
        F.col("o_custkey").alias("report_id"), F.col("o_orderkey").alias("page_num"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("source_language"), F.col("o_orderstatus").alias("lab_name"),
        F.col("o_orderdate").cast("string").alias("report_date"), F.col("o_custkey").cast("string").alias("patient_id"))
    return clean.report_headers(pages).select("report_id", "source_language", "lab_name")


@query("identifier_drop", "SELECT o_orderkey AS report_id, NULL::VARCHAR AS patient_id, NULL::VARCHAR AS raw_text, o_orderpriority AS lab_name FROM orders")
def identifier_drop(s):
    r = s.table("orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").cast("string").alias("patient_id"),
                                 F.col("o_orderstatus").alias("raw_text"), F.col("o_orderpriority").alias("lab_name"))
    return clean.without_identifiers(r)


# ---- sections and blocks -------------------------------------------------

@columns("row_sections", "sect", f"{KEY}, row_type, section_type, block_id")
def row_sections(s):
    return sections.assign_blocks(s.lab, POSITIONS_PER_PAGE).select(*K, "row_type", "section_type", "block_id")


KEYWORDS = sorted(set(lx.SCREENING_KEYWORDS + lx.HPLC_KEYWORDS + lx.HORMONE_KEYWORDS))
_KW = "[" + ", ".join(f"CASE WHEN regexp_matches(t, '\\b{ch.esc(k)}\\b') THEN {ch._sql(k)} END" for k in KEYWORDS) + "]"


@query("section_blocks", f"""SELECT report_id, page_num, block_id, section_type, n_rows, kws AS trigger_keywords, CASE WHEN section_type = 'standard_lab_table' OR len(kws) = 0 THEN 1.0
    WHEN len(kws) >= 3 THEN 0.95 WHEN len(kws) = 2 THEN 0.8 ELSE 0.6 END AS confidence FROM (
  SELECT report_id, page_num, block_id, section_type, count(*) AS n_rows, list_sort(list_distinct(flatten(coalesce(list(kw) FILTER (WHERE row_type = section_type AND row_type <> 'standard_lab_table'), [[]])))) AS kws
  FROM (SELECT *, list_filter(CASE row_type WHEN 'hplc_diabetes_block' THEN list_filter({_KW}, lambda x: x IN {ch.words(lx.HPLC_KEYWORDS)})
     WHEN 'hormone_immunology_block' THEN list_filter({_KW}, lambda x: x IN {ch.words(lx.HORMONE_KEYWORDS)}) ELSE list_filter({_KW}, lambda x: x IN {ch.words(lx.SCREENING_KEYWORDS)}) END, lambda x: x IS NOT NULL) AS kw FROM sect)
  GROUP BY 1, 2, 3, 4)""")
def section_blocks(s):
    return sections.block_summary(s.sect)


@query("appendix_drop", "SELECT section_type, count(*) AS n_rows FROM sect WHERE section_type <> 'appendix_text' GROUP BY 1")
def appendix_drop(s):
    return sections.drop_appendix(s.sect).groupBy("section_type").agg(F.count(F.lit(1)).alias("n_rows"))


def hplc_rows(s):
    plain = {"value_num": "value_raw", "ref_low": "low_raw", "ref_high": "high_raw"}
    return s.sect.filter(F.col("section_type") == sections.HPLC).withColumns({a: tx.plain_number(F.col(b)) for a, b in plain.items()})


@columns("hplc_pivot", "h0", "report_id, page_num, block_id, first_row, ngsp, ifcc, eag")
def hplc_pivot(s):
    return hplc.pivot_blocks(hplc_rows(s))


@columns("hplc_misread_fix", "h3", "report_id, page_num, block_id, ngsp, ifcc, eag")
def hplc_misread_fix(s):
    return hplc.fix_misread(hplc.pivot_blocks(hplc_rows(s))).select("report_id", "page_num", "block_id", "ngsp", "ifcc", "eag")


@columns("hplc_derived", "h8", "report_id, page_num, block_id, ngsp, ifcc, eag")
def hplc_derived(s):
    return hplc.derive_missing(hplc.fix_misread(hplc.pivot_blocks(hplc_rows(s)))).select("report_id", "page_num", "block_id", "ngsp", "ifcc", "eag")


@columns("hplc_cross_check", "hblocks", "report_id, page_num, block_id, completeness, consistency_flags, cross_check_passed")
def hplc_cross_check(s):
    return hplc.parse_blocks(hplc_rows(s)).select("report_id", "page_num", "block_id", "completeness", "consistency_flags", "cross_check_passed")


@columns("hplc_categories", "hblocks", "report_id, page_num, block_id, diabetes_category")
def hplc_categories(s):
    return hplc.parse_blocks(hplc_rows(s)).select("report_id", "page_num", "block_id", "diabetes_category")


@query("hplc_second_choice", """SELECT a.report_id, a.page_num, a.block_id, CASE WHEN t THEN b.completeness ELSE a.completeness END AS completeness,
  CASE WHEN t THEN b.diabetes_category ELSE a.diabetes_category END AS diabetes_category, CASE WHEN t THEN CASE WHEN b.ngsp IS NOT NULL THEN 're-extracted' END ELSE a.ngsp.source END AS ngsp_source
  FROM (SELECT a.*, coalesce(a.completeness < 2 AND b.completeness > a.completeness, false) AS t FROM (SELECT *, lead(block_id) OVER (PARTITION BY report_id, page_num ORDER BY block_id) AS nxt FROM hblocks) a
    LEFT JOIN hblocks b ON a.report_id = b.report_id AND a.page_num = b.page_num AND a.nxt = b.block_id) a
  LEFT JOIN hblocks b ON a.report_id = b.report_id AND a.page_num = b.page_num AND a.nxt = b.block_id""")
def hplc_second_choice(s):
    # the following block of the page stands in for a second extraction
    w = Window.partitionBy("report_id", "page_num").orderBy("block_id")
    second = s.blocks.withColumn("block_id", F.lag("block_id").over(w)).filter("block_id is not null")
    out = hplc.choose_extraction(s.blocks, second, ["report_id", "page_num", "block_id"])
    return out.select("report_id", "page_num", "block_id", "completeness", "diabetes_category", F.col("ngsp.source").alias("ngsp_source"))


@query("hplc_name_categories", "SELECT report_id, hplc_key, hplc_category FROM hcat")
def hplc_name_categories(s):
    return hplc.category_by_name(s.blocks)


@columns("row_union", "allrows", ch.COLS)
def row_union(s):
    return all_rows(s)


# ---- names and topics ----------------------------------------------------

@query("name_lookup", """SELECT DISTINCT n.test_name, e.loinc AS loinc_code, CASE e.kind WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END AS match_conf FROM nm0 n LEFT JOIN exactk e ON n.raw_key = e.key""")
def name_lookup(s):
    keys = nm.exact_keys(nm.dictionary(s.know.aliases))
    n = s.rows.select("test_name").distinct().withColumn("raw_key", tx.raw_key(F.col("test_name")))
    return n.join(keys, "raw_key", "left").select("test_name", F.col("exact_loinc").alias("loinc_code"),
                                                  F.when(F.col("exact_loinc").isNotNull(), F.col("exact_conf")).alias("match_conf"))


@query("normalised_lookup", "SELECT n.test_name, k.loinc AS loinc_code FROM nm0 n LEFT JOIN normk k ON n.norm_key = k.norm")
def normalised_lookup(s):
    keys = nm.normal_keys(nm.dictionary(s.know.aliases))
    n = s.rows.select("test_name").distinct().withColumn("norm_key", tx.normal_name(F.col("test_name")))
    return n.join(keys, "norm_key", "left").select("test_name", F.col("norm_loinc").alias("loinc_code"))


@query("closest_names_edit", """SELECT norm_key, arg_min(loinc, {'s': -score, 'o': ord}) AS loinc_code, round(max(score), 6) AS score FROM (
  SELECT m.norm_key, w.loinc, w.ord, 1 - levenshtein(m.norm_key, w.norm) / greatest(length(m.norm_key), length(w.norm)) AS score
  FROM (SELECT DISTINCT norm_key FROM nm0) m, wordn w) WHERE score >= 0.8 GROUP BY 1""")
def closest_names_edit(s):
    n = s.rows.select("test_name").distinct().select(tx.normal_name(F.col("test_name")).alias("norm_key")).distinct()
    got = nm.closest_names(n, nm.dictionary(s.know.aliases), nm.levenshtein_ratio)
    return got.select("norm_key", F.col("near_loinc").alias("loinc_code"), F.round("near_score", 6).alias("score"))


@query("closest_names")
def closest_names(s):
    n = s.rows.select("test_name").distinct().select(tx.normal_name(F.col("test_name")).alias("norm_key")).distinct()
    return nm.closest_names(n, nm.dictionary(s.know.aliases))


@columns("name_cascade", "names", "test_name, norm_key, loinc_code, match_conf, match_step")
def name_cascade(s):
    return nm.match_names(s.rows.select("test_name").distinct(), s.know.aliases).select("test_name", "norm_key", "loinc_code", "match_conf", "match_step")


@columns("health_topics", "names", "test_name, loinc_code, health_topic, topic_inferred")
def health_topics(s):
    k = s.know
    m = nm.match_names(s.rows.select("test_name").distinct(), k.aliases)
    return nm.add_topics(m, k.aliases, k.categories).select("test_name", "loinc_code", "health_topic", "topic_inferred")


# ---- verification, conversion, trust ------------------------------------

@columns("first_verdicts", "ver", f"{KEY}, verdict, label, passed, failed", alias={"verdict": "verdict1", "label": "label1", "passed": "p", "failed": "f"})
def first_verdicts(s):
    return verify.verify(s.rows).select(*K, "verification.verdict", F.col("verification_verdict").alias("label"),
                                        F.col("verification.passed").alias("passed"), F.col("verification.failed").alias("failed"))


@columns("verdict_labels", "ver", f"{KEY}, label, unit_conf", alias={"label": "label1", "unit_conf": "uc1"})
def verdict_labels(s):
    return verify.verify(s.rows).select(*K, F.col("verification_verdict").alias("label"), "unit_conf")


@columns("rechecked_verdicts", "enr", f"{KEY}, label, verdict", alias={"label": "label2", "verdict": "verdict2"})
def rechecked_verdicts(s):
    return s.enriched.select(*K, F.col("verification_verdict").alias("label"), "verification.verdict")


@columns("refined_verdicts", "itp", f"{KEY}, verification_verdict, verdict", alias={"verdict": "verdict3"})
def refined_verdicts(s):
    return s.interpreted.select(*K, "verification_verdict", "verification.verdict")


_SECOND = "CASE row_idx % 5 WHEN 0 THEN 'accept' WHEN 1 THEN 'downgrade' WHEN 2 THEN 'retry' ELSE 'accept' END"


@query("merged_verdicts", f"""SELECT {KEY}, CASE WHEN f > 0 AND m = 'accept' THEN 'downgrade' ELSE m END AS verdict, CASE WHEN verdict1 = 'retry' OR m <> 'accept' THEN 'low' ELSE 'medium' END AS adjusted_conf,
  len(m) > 0 AS merged FROM (SELECT *, {_SECOND} AS m FROM ver)""")
def merged_verdicts(s):
    second = F.expr(_SECOND)
    b = F.struct(second.alias("verdict"), F.array(F.lit("second opinion")).alias("reasons"),
                 F.when(second == "accept", "medium").otherwise("low").alias("adjusted_conf"))
    m = verify.verify(s.rows).withColumn("b", b).withColumn("m", verify.merge_verdicts(F.col("verification"), F.col("b")))
    return m.select(*K, "m.verdict", "m.adjusted_conf", (F.size("m.reasons") > 0).alias("merged"))


@query("verdict_counts", """SELECT report_id, count(*) AS verified, count(*) FILTER (WHERE verdict3 = 'accept') AS accepted, count(*) FILTER (WHERE verdict3 = 'accept_with_warning') AS warned,
  count(*) FILTER (WHERE verdict3 = 'downgrade') AS downgraded, count(*) FILTER (WHERE verdict3 = 'mark_indeterminate') AS indeterminate FROM itp GROUP BY 1""")
def verdict_counts(s):
    return verify.verdict_counts(s.interpreted)


def attached(s):
    return conform.mark_row(conform.attach_dimensions(verify.verify(s.rows), s.names, s.know.analytes))


@query("rule_join", "SELECT a.report_id, a.page_num, a.row_idx, a.m_code AS loinc_code, r.rule_name, r.rule_unit FROM att a LEFT JOIN rules r ON a.m_code = r.loinc_code")
def rule_join(s):
    return attached(s).select(*K, "loinc_code", F.col("rule.test_name").alias("rule_name"), F.col("rule.unit").alias("_u")).join(
        dims.numeric_rules(s.spark).select("loinc_code", F.col("unit").alias("rule_unit")), "loinc_code", "left").select(*K, "loinc_code", "rule_name", "rule_unit")


@columns("unit_conversion", "cv4", f"{KEY}, value_num, unit, converted")
def unit_conversion(s):
    return conform.convert_units(attached(s)).select(*K, "value_num", "unit", "converted")


@columns("conversion_guard", "cv4", f"{KEY}, value_num, unit, unit_conf, loinc_code", alias={"unit_conf": "uc2", "loinc_code": "code2"})
def conversion_guard(s):
    return conform.convert_units(attached(s)).select(*K, "value_num", "unit", "unit_conf", "loinc_code")


@columns("unit_rescue", "mr2", f"{KEY}, value_num, unit, unit_conf, ref_low, ref_high, range_source_pre")
def unit_rescue(s):
    return conform.rescue_misreported_units(conform.convert_units(attached(s))).select(
        *K, "value_num", "unit", "unit_conf", "ref_low", "ref_high", "range_source_pre")


@columns("code_clearing", "mr2", f"{KEY}, loinc_code")
def code_clearing(s):
    return conform.clear_unitless_codes(conform.rescue_misreported_units(conform.convert_units(attached(s)))).select(*K, "loinc_code")


@columns("range_trust", "tr1", f"{KEY}, range_trust", alias={"range_trust": "trust0"})
def range_trust(s):
    a = conform.clear_unitless_codes(conform.rescue_misreported_units(conform.convert_units(attached(s))))
    return a.withColumn("range_trust", conform.range_trust()).select(*K, "range_trust")


@columns("cross_unit_clear", "conf0", f"{KEY}, ref_low, ref_high, range_trust")
def cross_unit_clear(s):
    return s.enriched.select(*K, "ref_low", "ref_high", "range_trust")


@columns("analyte_flags", "conf0", f"{KEY}, analyte_category, is_decision_threshold, restricted_flag")
def analyte_flags(s):
    return conform.conform(conform.attach_dimensions(verify.verify(s.rows), s.names, s.know.analytes)).select(
        *K, "analyte_category", "is_decision_threshold", "restricted_flag")


@query("glycated_names", f"SELECT test_name, {ch.contains_any('lower(test_name)', fa.GLYCATED_NAMES)} AS glycated, count(*) AS n_rows FROM lab GROUP BY ALL")
def glycated_names(s):
    return s.lab.groupBy("test_name").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("glycated", conform.named_glycated(F.col("test_name")))


@columns("hplc_category_join", "conf1", f"{KEY}, hplc_category")
def hplc_category_join(s):
    return conform.add_hplc_category(s.rows, hplc.category_by_name(s.blocks)).select(*K, "hplc_category")


@columns("enriched_rows", "enr", f"{KEY}, loinc_code, match_conf, health_topic, value_num, unit, ref_low, ref_high, unit_conf, range_trust, hplc_category")
def enriched_rows(s):
    return s.enriched.select(*K, "loinc_code", "match_conf", "health_topic", "value_num", "unit", "ref_low", "ref_high", "unit_conf", "range_trust", "hplc_category")


# ---- interpretation ------------------------------------------------------

def qualified(s):
    return ql.interpret_qualitative(s.enriched)


def ranged(s, *columns, where="value_num is not null"):
    """Columns of the numeric rows with their chosen range."""
    return chosen(it.choose_ranges(qualified(s)), where, *K, *columns)


@query("range_selection", f"""SELECT {KEY}, CASE pick WHEN 'lab' THEN ref_low WHEN 'swap' THEN r0_low WHEN 'cur' THEN n_low END AS low, CASE pick WHEN 'lab' THEN ref_high WHEN 'swap' THEN r0_high WHEN 'cur' THEN n_high END AS high,
  CASE pick WHEN 'lab' THEN 'lab-provided' WHEN 'none' THEN 'no-range' ELSE 'curated-fallback' END AS source FROM i0 WHERE value_num IS NOT NULL""")
def range_selection(s):
    a = s.enriched.withColumn("_r", conform.coded("rule"))
    return chosen(a.withColumn("x", it.select_range(F.col("_r"))), "value_num is not null", *K, "x.low", "x.high", "x.source")


@query("curated_guards", f"SELECT {KEY}, CASE pick1 WHEN 'lab' THEN 'lab-provided' WHEN 'none' THEN 'no-range' ELSE 'curated-fallback' END AS source FROM i1 WHERE value_num IS NOT NULL")
def curated_guards(s):
    a = s.enriched.withColumn("_r", conform.coded("rule"))
    return chosen(a.withColumn("x", it.guard_curated(it.select_range(F.col("_r")), F.col("_r"))), "value_num is not null", *K, "x.source")


@query("trust_override", f"SELECT {KEY}, sl AS low, sh AS high FROM i4 WHERE value_num IS NOT NULL")
def trust_override(s):
    return ranged(s, "rng.low", "rng.high")


@query("threshold_gate", f"SELECT {KEY}, degraded FROM i4 WHERE value_num IS NOT NULL")
def threshold_gate(s):
    return ranged(s, "degraded")


@query("source_expansion", f"SELECT {KEY}, src AS source FROM i4 WHERE value_num IS NOT NULL")
def source_expansion(s):
    return ranged(s, "rng.source")


@query("direction_by_bounds", f"SELECT {KEY}, CASE WHEN value_num < ref_low THEN 'low' WHEN value_num > ref_high THEN 'high' ELSE 'in-range' END AS direction FROM kept WHERE value_num IS NOT NULL AND ref_low IS NOT NULL AND ref_high IS NOT NULL")
def direction_by_bounds(s):
    return s.rows.filter("value_num is not null and ref_low is not null and ref_high is not null").select(
        *K, it.direction_in(F.col("value_num"), F.col("ref_low"), F.col("ref_high")).alias("direction"))


@query("direction_by_text", f"SELECT {KEY}, tdir AS direction FROM i6 WHERE value_num IS NOT NULL AND sl IS NULL")
def direction_by_text(s):
    a = ranged(s, "value_num", "ref_text", where="value_num is not null and rng.low is null")
    return a.select(*K, it.direction_from_text(F.col("value_num"), F.nullif(F.col("ref_text"), F.lit(""))).alias("direction"))


@query("no_range_fallback", f"SELECT {KEY}, nd AS direction, nsrc AS range_source FROM i8 WHERE NOT is_q AND hplc_category IS NULL AND sl IS NULL")
def no_range_fallback(s):
    a = ranged(s, *_numeric_columns(s), where=f"value_num is not null and rng.low is null and {_PLAIN}")
    return it.interpret_numeric(a).select(*K, F.col("dir").alias("direction"), "range_source")


@query("heuristic_severity", f"SELECT {KEY}, {ch.HEUR.replace('gh', 'ref_high').replace('gl', 'ref_low')} AS severity FROM kept WHERE value_num IS NOT NULL AND ref_low IS NOT NULL AND ref_high IS NOT NULL AND value_num NOT BETWEEN ref_low AND ref_high")
def heuristic_severity(s):
    v, lo, hi = F.col("value_num"), F.col("ref_low"), F.col("ref_high")
    return s.rows.filter(lo.isNotNull() & hi.isNotNull() & ~v.between(lo, hi)).select(*K, it.heuristic_severity(v, lo, hi).alias("severity"))


@query("severity_bands", f"""SELECT {KEY}, coalesce(list_filter(bands, lambda b: value_num BETWEEN b.low AND b.high)[1].tier, CASE WHEN value_num NOT BETWEEN n_low AND n_high THEN 'moderate' ELSE 'normal' END) AS severity
  FROM i4 WHERE value_num IS NOT NULL AND bands IS NOT NULL""")
def severity_bands(s):
    a = chosen(s.enriched.withColumn("_r", conform.coded("rule")), "value_num is not null and _r is not null", *K, "value_num", "_r")
    return a.select(*K, it.band_severity(F.col("value_num"), F.col("_r")).alias("severity"))


@query("severity_and_action", f"SELECT {KEY}, ns AS severity, {ch.ACT('ns')} AS actionability FROM i11 WHERE NOT is_q AND hplc_category IS NULL")
def severity_and_action(s):
    return numeric(s).select(*K, "severity", "actionability")


_PLAIN = "q is null and hplc_category is null"


def _numeric_columns(s):
    return [c for c in s.enriched.columns if c in it.NUMERIC_READS.split()]


def numeric(s):
    return it.interpret_numeric(chosen(qualified(s), _PLAIN, *K, *_numeric_columns(s)))


@query("panic_thresholds", f"SELECT {KEY}, value_num <= r0_low / 4 OR value_num >= r0_high * 3 AS panic FROM i4 WHERE value_num IS NOT NULL AND bands IS NOT NULL")
def panic_thresholds(s):
    r = F.col("_r").withField("panic_low", F.col("_r.first_low") / 4).withField("panic_high", F.col("_r.first_high") * 3)
    a = chosen(s.enriched.withColumn("_r", conform.coded("rule")), "value_num is not null and _r is not null", *K, "value_num", "_r")
    return a.select(*K, it.panic(F.col("value_num"), r).alias("panic"))


@query("uncertainty_gate", f"SELECT {KEY}, gated, nraw AS severity_raw FROM i10 WHERE NOT is_q AND hplc_category IS NULL")
def uncertainty_gate(s):
    return numeric(s).select(*K, F.col("classification_state").eqNullSafe("low_confidence").alias("gated"), "severity_raw")


@query("severity_cap", f"SELECT {KEY}, severity_raw, severity, severity_raw <> severity AS capped FROM itp0")
def severity_cap(s):
    return it.interpret(s.enriched).select(*K, "severity_raw", "severity", (F.col("severity_raw") != F.col("severity")).alias("capped"))


@query("composite_confidence", f"SELECT {KEY}, CASE ncr WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM i11 WHERE NOT is_q AND hplc_category IS NULL")
def composite_confidence(s):
    return numeric(s).select(*K, "confidence")


@query("hplc_results", f"SELECT {KEY}, direction, severity, actionability, confidence FROM itp0 WHERE range_source = 'hplc-cross-check'")
def hplc_results(s):
    return chosen(it.interpret(s.enriched), "range_source = 'hplc-cross-check'", *K, "direction", "severity", "actionability", "confidence")


_Q = f"{KEY}, qd AS direction, qs AS severity, qa AS actionability, qp AS is_panic, qc AS confidence, qst AS classification_state"


def _q(s, where):
    return chosen(qualified(s), where, *K, *[f"q.{c}" for c in ("direction", "severity", "actionability", "is_panic", "confidence", "classification_state")])


@query("titer_results", f"SELECT {_Q} FROM q4 WHERE is_titer")
def titer_results(s):
    return _q(s, "value_num is not null and q is not null")


@query("qualitative_dispatch", f"SELECT {KEY}, qm AS method, CASE WHEN has_rule THEN 'qualitative-rule' ELSE 'no-range' END AS range_source, qh AS hint FROM q4 WHERE is_q")
def qualitative_dispatch(s):
    return chosen(qualified(s), "q is not null", *K, "q.method", "q.range_source", "q.hint")


@query("expected_results", f"SELECT {_Q} FROM q4 WHERE is_q AND has_rule AND q_category <> 'semi_quantitative'")
def expected_results(s):
    return _q(s, "q is not null and q.range_source = 'qualitative-rule' and coalesce(case when loinc_code is not null then qual.category end, name_qual.category) <> 'semi_quantitative'")


@query("graded_results", f"SELECT {_Q} FROM q4 WHERE is_q AND q_category = 'semi_quantitative'")
def graded_results(s):
    return _q(s, "q is not null and coalesce(case when loinc_code is not null then qual.category end, name_qual.category) = 'semi_quantitative'")


@query("keyword_results", f"SELECT {_Q} FROM q4 WHERE is_q AND NOT has_rule")
def keyword_results(s):
    return _q(s, "q is not null and q.range_source = 'no-range'")


@query("direction_consistency", f"SELECT {KEY}, direction, severity, confidence, classification_state, source_flag FROM itp1")
def direction_consistency(s):
    return it.enforce_direction_consistency(it.interpret(s.enriched)).select(*K, "direction", "severity", "confidence", "classification_state", "source_flag")


_NOTE = """CASE WHEN starts_with(method, 'qualitative') AND direction = 'in-range' AND hint <> '' THEN CASE WHEN contains(lower(hint), 'immunity') OR contains(lower(hint), 'immune')
  THEN 'This result indicates protection/immunity — this is expected and reassuring.' WHEN contains(lower(hint), 'informational') THEN hint END END"""


@query("qualitative_notes", f"SELECT {KEY}, {_NOTE} AS qualitative_note FROM itp WHERE method IS NOT NULL")
def qualitative_notes(s):
    return s.interpreted.filter("method is not null").select(*K, "evidence.qualitative_note")


@query("evidence_trace", f"""SELECT {KEY}, test_name, loinc_code, value_num, value_text, unit, range_source, rng_low AS low, rng_high AS high, match_conf AS match_confidence, direction, severity,
  is_panic, actionability, confidence AS composite_confidence, source_flag FROM itp""")
def evidence_trace(s):
    e = F.from_json(F.to_json("evidence"), s.interpreted.schema["evidence"].dataType)  # as it is written out
    rows = s.interpreted.select(*K, e.alias("e"))
    return rows.select(*K, *[f"e.{c}" for c in ("test_name", "loinc_code", "value_num", "value_text", "unit", "range_source", "match_confidence", "direction", "severity", "is_panic",
                                                "actionability", "composite_confidence", "source_flag")], "e.reference_range.low", "e.reference_range.high")


@query("source_flag_move", f"SELECT {KEY}, direction, source_flag AS trace_flag FROM itp")
def source_flag_move(s):
    return s.interpreted.select(*K, "direction", F.col("evidence.source_flag").alias("trace_flag"))


@columns("interpreted_rows", "itp", f"{KEY}, loinc_code, direction, severity, actionability, is_panic, confidence, range_source, classification_state, rng_low, rng_high, range_trust, verification_verdict")
def interpreted_rows(s):
    return s.interpreted.select(*K, "loinc_code", "direction", "severity", "actionability", "is_panic", "confidence", "range_source",
                                "classification_state", "rng_low", "rng_high", "range_trust", "verification_verdict")
