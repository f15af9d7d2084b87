"""Printed lab rows derived from `lineitem`, in Spark and in SQL.

Every row of lineitem becomes one printed row.  The catalogue below gives the
analytes; the line's own numbers pick the spelling, unit, value, range form and
flag.  The derivation is row-local, so it scales with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# kind, names (three spellings), unit, other unit, factor from the other unit,
# low and high bound in 1/10000, words printed instead of numbers
CATALOGUE = [
    (0, ["Glucose", "Glucose / Plasma", "Fasting Glucose"], "mg/dL", "mmol/L", 18.0182, 700000, 1000000, []),
    (1, ["Creatinine", "Creatinine [Serum]*", "Serum Creatinine"], "mg/dL", "µmol/L", 0.0113, 7000, 13000, []),
    (2, ["Hemoglobin", "Hemoglobin (Hgb)", "Hb"], "g/dL", "g/L", 0.1, 135000, 175000, []),
    (3, ["HDL Cholesterol", "HDL-C", "HDL Cholesterl"], "mg/dL", "mmol/L", 38.67, 400000, 600000, []),
    (4, ["Calcium", "Calcium (Ca)", "Total Calcium"], "mg/dL", "mmol/L", 4.0078, 85000, 105000, []),
    (5, ["Platelets", "PLT", "Platlets"], "K/uL", "x10^9/L", 1.0, 1500000, 4000000, []),
    (6, ["HBsAg", "Hepatitis B Surface Antigen", "HBsAg [Serum]"], None, None, None, 0, 0, ["Negative", "Reactive", "not detected", "Borderline"]),
    (7, ["Urine Protein", "Protein (Urine)", "Urine Protein*"], None, None, None, 0, 0, ["Negative", "trace", "+", "++", "3+", "++++"]),
    (8, ["HBsAb", "Anti-HBs", "HBsAb"], "mIU/mL", None, None, 0, 200000, []),
    (9, ["Basophils", "Basophils %", "Baso"], "%", None, None, 0, 20000, []),
    (10, ["RDW", "RDW (CV)", "RDW #"], "%", None, None, 115000, 145000, []),
    (11, ["Blood Type", "ABO Blood Group", "Rh Type"], None, None, None, 0, 0, ["Positive", "Normal", "A", "O"]),
    (12, ["Lymphocytes", "Lymph", "Lymphocytes %"], "%", None, None, 200000, 400000, []),
    (13, ["Ferritin", "Serum Ferritin", "Ferritin [Serum]"], "ng/mL", None, None, 200000, 2500000, []),
    (14, ["Sample type:", "Interpretation", "12-05-2024 draw"], None, None, None, 0, 0, ["Serum", "12/05/24", "Normal",
        "see the attached comment of the laboratory for details of this result"]),
    (15, ["Zorblax Factor", "Quuxin Index", "Frobnitz"], "AU", None, None, 100000, 300000, []),
    (16, ["Vitamin D", "25-OH Vitamin D", "Vit D"], "ng/mL", "nmol/L", 0.4006, 300000, 1000000, []),
    (17, ["Sodium", "Na", "Sodium / Serum"], "mmol/L", "mEq/L", 1.0, 1360000, 1450000, []),
    (18, ["LDL Cholesterol", "LDL-C", "LDL Cholesterol*"], "mg/dL", "mmol/L", 38.67, 500000, 1300000, []),
    (19, ["Uric Acid", "Uric Acid / Blood", "Urate"], "mg/dL", "umol/L", 0.01681, 35000, 72000, []),
    (20, ["HbA1c (NGSP)", "HbA1c", "Hb A1c"], "%", None, None, 40000, 57000, []),
    (21, ["HbA1c (IFCC)", "HbA1c IFCC", "HbA1c (IFCC)"], "mmol/mol", "%", 10.0, 200000, 400000, []),
    (22, ["Estimated Average Glucose (eAG)", "eAG", "Estimated Average Glucose"], "mg/dL", "mmol/L", 18.015, 700000, 1200000, []),
    (23, ["HbA1c", "HbA1c (NGSP)", "Hemoglobin A1c"], "%", None, None, 40000, 57000, []),
    (24, ["Testosterone", "Testosterone [Serum]*", "Total Testosterone"], "ng/dL", None, None, 3000000, 10000000, []),
    (25, ["TSH", "TSH [Serum]", "Thyroid Stimulating Hormone"], "mIU/L", "uIU/mL", 1.0, 4000, 40000, []),
    (26, ["Free T4", "FT4", "Free Thyroxine"], "ng/dL", "pmol/L", 0.0777, 8000, 18000, []),
    (27, ["Prolactin", "Cortisol", "Estradiol"], "ng/mL", None, None, 40000, 200000, []),
]
POSITIONS_PER_ORDER = 2 ** 40
POSITIONS_PER_PAGE = 4 * POSITIONS_PER_ORDER  # a report has the lines of four order numbers


def lab_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed rows: report_id, page_num, row_idx, test_name, value_raw, unit,
    low_raw, high_raw, ref_text, flag."""
    cat = spark.createDataFrame(
        [(k, n, u, a, f, lo, hi, w) for k, n, u, a, f, lo, hi, w in CATALOGUE],
        "kind int, names array<string>, canon string, other string, factor double, lo long, hi long, words array<string>")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    c = F.col
    whole = lambda x: F.round(c(x) * 100).cast("long")
    ident = F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", whole("l_quantity"), whole("l_extendedprice"),
                              whole("l_discount"), whole("l_tax"), "l_returnflag", "l_linestatus", c("l_shipdate").cast("date").cast("string")).cast("binary"))
    base = li.select(
        F.floor(c("l_orderkey") / 4).cast("long").alias("report_id"),
        (F.floor((c("l_linenumber") - 1) / 4) + 1).cast("int").alias("page_num"),
        ((c("l_orderkey") % 4) * POSITIONS_PER_ORDER + F.conv(F.substring(ident, 1, 10), 16, 10).cast("long")).alias("row_idx"),
        F.when(c("l_orderkey") % 8 == 3, 20 + c("l_partkey") % 4).when(c("l_orderkey") % 8 == 6, 24 + c("l_partkey") % 4)
        .otherwise(c("l_partkey") % 20).cast("int").alias("kind"),
        c("l_suppkey").alias("s"), c("l_quantity").cast("long").alias("q"), c("l_returnflag").alias("rf"),
        c("l_linestatus").alias("ls"), whole("l_discount").alias("d"))
    j = base.join(F.broadcast(cat), "kind")
    other = c("other").isNotNull() & (c("s") % 7 == 1)
    rescale = lambda x, on: F.when(on, F.floor(x / c("factor") + 0.5).cast("long")).otherwise(x)
    v = F.greatest(F.lit(0), c("lo") + F.expr("(hi - lo) * (q - 10) div 20"))
    j = j.withColumns({
        "alt": F.coalesce(other, F.lit(False)),
        "v": rescale(v, c("other").isNotNull() & ((c("s") % 7 == 1) | (c("s") % 29 == 5))),
        "lo": rescale(c("lo"), other), "hi": rescale(c("hi"), other)})

    def shown(x, point="."):
        return F.concat(F.expr(f"cast({x} div 10000 as string)"), F.lit(point), F.lpad((c(x) % 10000).cast("string"), 4, "0"))

    comma = c("s") % 5 == 1
    lo, hi = shown("lo"), shown("hi")
    lo_c, hi_c = F.when(comma, shown("lo", ",")).otherwise(lo), F.when(comma, shown("hi", ",")).otherwise(hi)
    far = c("s") % 19 == 4
    j = j.withColumns({"lo50": c("lo") * 50, "hi50": c("hi") * 50})
    pair = F.concat(lo, F.lit(" - "), hi)
    numeric = F.size("words") == 0
    n, r, a = c("rf") == "N", c("rf") == "R", c("rf") == "A"
    m17 = c("s") % 17
    return j.select(
        "report_id", "page_num", "row_idx",
        F.element_at("names", (c("s") % 3 + 1).cast("int")).alias("test_name"),
        F.when(~numeric, F.element_at("words", (c("q") % F.greatest(F.size("words"), F.lit(1)) + 1).cast("int")))
        .when(c("s") % 11 == 3, shown("v", ",")).otherwise(shown("v")).alias("value_raw"),
        F.when(c("s") % 7 == 0, None).when(c("alt"), c("other")).otherwise(c("canon")).alias("unit"),
        F.when(numeric, F.when(n, F.when(c("s") % 13 == 2, hi_c).when(far, shown("lo50")).otherwise(lo_c))
               .when(r & (c("s") % 2 == 0), pair)
               .when(a & (m17 == 3), F.concat(F.lit("< "), hi)).when(a & (m17 == 6), "see note")
               .when(a & (m17 == 8), F.concat(F.lit("Normal: "), pair))).alias("low_raw"),
        F.when(numeric, F.when(n, F.when(c("s") % 13 == 2, lo_c).when(far, shown("hi50")).otherwise(hi_c))
               .when(a & (m17 == 4), F.concat(F.lit(">="), lo))).alias("high_raw"),
        F.when(numeric, F.when(r & (c("s") % 2 == 1), F.when(c("s") % 3 == 1, F.concat(lo, F.lit("–"), hi)).otherwise(pair))
               .when(a & (m17 == 5), F.concat(F.lit("Desirable: < "), hi)).when(a & (m17 == 7), F.concat(F.lit("< "), hi))).alias("ref_text"),
        F.when(c("d") == 5, "UNIT").when((c("ls") == "F") & numeric, F.when(c("q") > 30, "H").when(c("q") < 10, "L").when(c("q") < 13, "a ")).alias("flag"))


def _sql(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, list):
        return "[" + ", ".join(_sql(y) for y in x) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def lab_sql() -> str:
    """The same rows as DuckDB common table expressions ending in `lab`."""
    values = ",\n".join("(" + ", ".join([
        str(k), _sql(n), _sql(u) + "::VARCHAR", _sql(a) + "::VARCHAR", f"{_sql(f)}::DOUBLE", f"{lo}::BIGINT", f"{hi}::BIGINT",
        _sql(w) + "::VARCHAR[]"]) + ")" for k, n, u, a, f, lo, hi, w in CATALOGUE)
    shown = lambda x, p=".": f"(({x} // 10000)::VARCHAR || '{p}' || lpad(({x} % 10000)::VARCHAR, 4, '0'))"
    lo, hi = shown("lo"), shown("hi")
    return f"""
cat(kind, names, canon, other, factor, lo0, hi0, words) AS (VALUES {values}),
lab_base AS (
  SELECT l_orderkey // 4 AS report_id, ((l_linenumber - 1) // 4 + 1)::INTEGER AS page_num,
    (l_orderkey % 4) * {POSITIONS_PER_ORDER} + ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
      round(l_quantity * 100)::BIGINT, round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT,
      l_returnflag, l_linestatus, l_shipdate::DATE::VARCHAR)), 1, 10))::BIGINT AS row_idx,
    CASE WHEN l_orderkey % 8 = 3 THEN 20 + l_partkey % 4 WHEN l_orderkey % 8 = 6 THEN 24 + l_partkey % 4 ELSE l_partkey % 20 END AS kind,
    l_suppkey AS s, l_quantity::BIGINT AS q, l_returnflag AS rf, l_linestatus AS ls, round(l_discount * 100)::BIGINT AS d
  FROM lineitem),
lab_scaled AS (
  SELECT *, other IS NOT NULL AND s % 7 = 1 AS alt,
    CASE WHEN other IS NOT NULL AND (s % 7 = 1 OR s % 29 = 5) THEN floor(v0 / factor + 0.5)::BIGINT ELSE v0 END AS v,
    CASE WHEN other IS NOT NULL AND s % 7 = 1 THEN floor(lo0 / factor + 0.5)::BIGINT ELSE lo0 END AS lo,
    CASE WHEN other IS NOT NULL AND s % 7 = 1 THEN floor(hi0 / factor + 0.5)::BIGINT ELSE hi0 END AS hi
  FROM (SELECT *, greatest(0, lo0 + ((hi0 - lo0) * (q - 10)) // 20)::BIGINT AS v0 FROM lab_base JOIN cat USING (kind))),
lab AS (
  SELECT report_id, page_num, row_idx, names[s % 3 + 1] AS test_name,
    CASE WHEN len(words) > 0 THEN words[q % greatest(len(words), 1) + 1]
         WHEN s % 11 = 3 THEN {shown('v', ',')} ELSE {shown('v')} END AS value_raw,
    CASE WHEN s % 7 = 0 THEN NULL WHEN alt THEN other ELSE canon END AS unit,
    CASE WHEN len(words) > 0 THEN NULL
         WHEN rf = 'N' THEN CASE WHEN s % 13 = 2 THEN CASE WHEN s % 5 = 1 THEN {shown('hi', ',')} ELSE {hi} END
                                 WHEN s % 19 = 4 THEN {shown('(lo * 50)')}
                                 ELSE CASE WHEN s % 5 = 1 THEN {shown('lo', ',')} ELSE {lo} END END
         WHEN rf = 'R' AND s % 2 = 0 THEN {lo} || ' - ' || {hi}
         WHEN rf = 'A' AND s % 17 = 3 THEN '< ' || {hi}
         WHEN rf = 'A' AND s % 17 = 6 THEN 'see note'
         WHEN rf = 'A' AND s % 17 = 8 THEN 'Normal: ' || {lo} || ' - ' || {hi} END AS low_raw,
    CASE WHEN len(words) > 0 THEN NULL
         WHEN rf = 'N' THEN CASE WHEN s % 13 = 2 THEN CASE WHEN s % 5 = 1 THEN {shown('lo', ',')} ELSE {lo} END
                                 WHEN s % 19 = 4 THEN {shown('(hi * 50)')}
                                 ELSE CASE WHEN s % 5 = 1 THEN {shown('hi', ',')} ELSE {hi} END END
         WHEN rf = 'A' AND s % 17 = 4 THEN '>=' || {lo} END AS high_raw,
    CASE WHEN len(words) > 0 THEN NULL
         WHEN rf = 'R' AND s % 2 = 1 THEN CASE WHEN s % 3 = 1 THEN {lo} || '–' || {hi} ELSE {lo} || ' - ' || {hi} END
         WHEN rf = 'A' AND s % 17 = 5 THEN 'Desirable: < ' || {hi}
         WHEN rf = 'A' AND s % 17 = 7 THEN '< ' || {hi} END AS ref_text,
    CASE WHEN d = 5 THEN 'UNIT'
         WHEN ls = 'F' AND len(words) = 0 THEN CASE WHEN q > 30 THEN 'H' WHEN q < 10 THEN 'L' WHEN q < 13 THEN 'a ' END END AS flag
  FROM lab_scaled)"""
