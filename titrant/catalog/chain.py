"""SQL counterpart of the row pipeline, as DuckDB common table expressions.

Written from the operator definitions for checking; it shares the fixed tables
with the Spark code but none of its logic.  `with_for(sql)` puts the fragments a
query refers to in front of it.
"""

from __future__ import annotations

import re

from titrant.catalog.labview import _sql, lab_sql
from titrant.fixed import analytes as fa, families as ff, lexicons as lx, units as fu
from titrant.fixed import names as fn
from titrant.fixed.numeric_rules import NUMERIC_RULES
from titrant.fixed.qualitative import QUALITATIVE_RULES, SEMI_QUANT_CANONICAL, VALUE_ALIASES


def words(ws) -> str:
    return "(" + ", ".join(_sql(w) for w in ws) + ")"


def esc(w: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in w).replace("'", "''")


def word_re(ws) -> str:
    return r"'\b(?:" + "|".join(esc(w) for w in ws) + r")\b'"


def number(s: str) -> str:
    return rf"CASE WHEN regexp_matches(trim({s}), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN try_cast(trim({s}) AS DOUBLE) END"


def lab_number(s: str) -> str:
    return rf"coalesce({number(s)}, CASE WHEN regexp_matches(trim({s}), '^\d+,\d+$') THEN try_cast(replace(trim({s}), ',', '.') AS DOUBLE) END)"


def grab(s: str, pattern: str, group: int = 1) -> str:
    return f"try_cast(nullif(regexp_extract({s}, '{pattern}', {group}), '') AS DOUBLE)"


PAIR = r"([\d.]+)\s*[-–—]\s*([\d.]+)"
PAIR_ALL, BELOW, ABOVE = rf"^\s*{PAIR}\s*$", r"[<≤]\s*=?\s*([\d.]+)", r"[>≥]\s*=?\s*([\d.]+)"


def comma_fixed(s: str) -> str:
    return rf"regexp_replace({s}, '(\d),(\d{{1,2}})($|[^\d])', '\1.\2\3', 'g')"


def normal_name(s: str) -> str:
    spec = "|".join(fa.SPECIMENS)
    loose = spec.replace(" ", r"\s+")
    x = f"trim(lower({s}))"
    for pat, to in [(rf"(?i)\s*[\[(]\s*(?:{spec})\s*[\])]", ""), (rf"(?i)\s*/\s*(?:{loose})\s*$", ""), (r"\s*%\s*$", ""),
                    (r"\s*\([A-Za-z\s]{1,10}\)\s*", " "), (r"[\s*#†‡§]+$", ""), (r"\s+", " ")]:
        x = f"regexp_replace({x}, '{pat}', '{to}', 'g')"
    return f"trim({x})"


def abbreviated(s: str) -> str:
    cases = " ".join(f"WHEN {s} = {_sql(a)} OR starts_with({s}, {_sql(a + ' ')}) THEN {_sql(b)}" for a, b in fa.ABBREVIATIONS)
    return f"CASE {cases} ELSE {s} END"


def bare_name(s: str, marks: str = "*#†") -> str:
    x = rf"regexp_replace(regexp_replace(lower(trim({s})), '\s*\[.*?\]', '', 'g'), '\s*\(.*?\)', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({x}, '[{marks}]', '', 'g'), '\s+', ' ', 'g'))"


def analyte_key(s: str) -> str:
    x = rf"regexp_replace(regexp_replace(replace(lower(trim({s})), 'µ', 'μ'), '\s*\[.*?\]', '', 'g'), '\s*\(.*?\)', '', 'g')"
    return f"trim(regexp_replace({x}, '[*#]', '', 'g'))"


def fold(s: str) -> str:
    return f"regexp_replace(lower(coalesce({s}, '')), '[^a-z0-9]+', '', 'g')"


def contains_any(s: str, ws) -> str:
    return "(" + " OR ".join(f"contains({s}, {_sql(w)})" for w in ws) + ")"


def case_map(s: str, pairs, other="NULL") -> str:
    return "CASE " + s + " " + " ".join(f"WHEN {_sql(k)} THEN {_sql(v)}" for k, v in pairs) + f" ELSE {other} END"


SEV = "CASE {0} WHEN 'critical' THEN 3 WHEN 'moderate' THEN 2 WHEN 'mild' THEN 1 ELSE 0 END"
CONF = "CASE {0} WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
LOW_PRIORITY = lambda s: contains_any(f"lower({s})", fa.LOW_PRIORITY)


def _f(x) -> str:
    return "NULL::DOUBLE" if x is None else f"{float(x)!r}::DOUBLE"


# ---- dimension values ----------------------------------------------------

def rules_values() -> str:
    out = []
    for code, name, unit, ranges, bands, src in NUMERIC_RULES:
        order = ["critical_low", "critical_high", "moderate_low", "moderate_high", "mild_low", "mild_high", "normal"]
        bs = "[" + ", ".join(f"{{'prio': {order.index(b) + 1}, 'band': '{b}', 'tier': '{b.split('_')[0]}', 'low': {_f(v[0])}, 'high': {_f(v[1])}}}"
                             for b, v in sorted(bands.items(), key=lambda kv: order.index(kv[0]))) + "]"
        nb = bands["normal"]
        out.append(f"('{code}', {_sql(name)}, '{unit}', {_f(ranges[0][1])}, {_f(ranges[0][2])}, {_f(nb[0])}, {_f(nb[1])}, {bs}, {_sql(src)})")
    return ",\n".join(out)


def dictionary_rows():
    """(kind, ord, key, loinc) in dictionary order."""
    rows, seen = [], {}
    n = 0
    for code, canonical, _ in fa.ANALYTES:
        rows.append((0, n, canonical.lower(), code)); n += 1
    for code, _, _ in fa.ANALYTES:
        for words in fn.names_of(code).values():
            for w in words:
                rows.append((1, n, w.lower().strip(), code)); n += 1
    return rows


def topic_rows():
    """(kind, place, name, topic): the smallest (kind, place) of a key holds."""
    rows = [(0, -i, c, t) for i, (_, c, t) in enumerate(fa.ANALYTES)]
    n = 0
    for code, _, t in fa.ANALYTES:
        for words in fn.names_of(code).values():
            for w in words:
                rows.append((1, n, w, t)); n += 1
    return rows


def qual_values() -> str:
    out = []
    for code, r in QUALITATIVE_RULES.items():
        pos = r["category"] == "expected_positive"
        grades = "MAP {" + ", ".join(f"{_sql(k)}: {_sql(v)}" for k, v in r.get("grade_severity", {}).items()) + "}" if r.get("grade_severity") else "MAP([]::VARCHAR[], []::VARCHAR[])"
        out.append("(" + ", ".join([
            _sql(code), _sql(r["test_name"].lower()), _sql(r["category"]), _sql(r.get("positive_direction", "in-range" if pos else "high")),
            _sql(r.get("negative_direction", "high" if pos else "in-range")), _sql(r.get("severity_when_positive", "moderate")),
            _sql(r.get("actionability_when_positive", "follow-up")), _sql(r.get("severity_when_abnormal", "mild")),
            _sql(r.get("actionability_when_abnormal", "follow-up")), _f(r.get("titer_positive_threshold")),
            _sql(r.get("normal_values", ["negative"])), grades, _sql(r.get("actionability_threshold", "1+")),
            _sql(r.get("normal_status", "normal")), _sql(r.get("abnormal_status", "abnormal")), _sql(r.get("explanation_context", ""))]) + ")")
    return ",\n".join(out)


CTES: list[tuple[str, str]] = []


def cte(name: str, sql: str) -> None:
    CTES.append((name, sql))


def with_for(sql: str) -> str:
    """The query with the WITH clause of every fragment it needs, in order."""
    at = {n.split("(")[0]: i for i, (n, _) in enumerate(CTES)}
    used = lambda body, limit: [m for m in set(re.findall(r"[a-z_0-9]+", body)) if m in at and at[m] < limit]
    need, todo = set(), used(sql, len(CTES))
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += used(CTES[at[n]][1], at[n])
    # materialised, so that a fragment used several times is computed once
    parts = [f"{n} AS {'' if b.startswith('VALUES') else 'MATERIALIZED '}({b})" for n, b in CTES if n.split("(")[0] in need and n != "lab"]
    head = [lab_sql().strip()] if "lab" in need else []
    return "WITH " + ",\n".join(head + parts) + "\n" + sql if head or parts else sql


cte("lab", "")
cte("rules(loinc_code, rule_name, rule_unit, r0_low, r0_high, n_low, n_high, bands, rule_src)", f"VALUES {rules_values()}")
cte("words(kind, ord, key, loinc)", "VALUES " + ", ".join(f"({k}, {n}, {_sql(w)}, '{c}')" for k, n, w, c in dictionary_rows()))
cte("topicw(kind, place, name, topic)", "VALUES " + ", ".join(f"({k}, {n}, {_sql(w)}, '{c}')" for k, n, w, c in topic_rows()))
cte("codetopic(loinc_code, topic)", "VALUES " + ", ".join(f"('{c}', '{t}')" for c, _, t in fa.ANALYTES))
cte("conv(loinc_code, canonical, factors)", "VALUES " + ", ".join(
    f"('{c}', {_sql(u)}, [" + ", ".join(f"{{'f': {_sql(f)}, 'x': {_f(x)}}}" for f, x in fs) + "])" for c, u, fs in fu.UNIT_CONVERSIONS))
cte("human(loinc_code, h_low, h_high)", "VALUES " + ", ".join(f"('{c}', {_f(a)}, {_f(b)})" for c, (a, b) in fu.HUMAN_BOUNDS.items()))
cte("fam(n, family, loinc_code, category, v_low, v_high, r_low, r_high)", "VALUES " + ", ".join(
    f"({i}, '{n}', '{c}', '{cat}', {_f(v[0])}, {_f(v[1])}, {_f(r[0])}, {_f(r[1])})"
    for i, (n, codes, v, r, cat) in enumerate(ff.FAMILIES) for c in codes))
cte("famc", "SELECT loinc_code, arg_max(category, n) AS category, list(struct_pack(vl := v_low, vh := v_high, rl := r_low, rh := r_high)) AS fams FROM fam GROUP BY 1")
cte("qual(loinc_code, qual_name, category, pos_dir, neg_dir, sev_pos, act_pos, sev_abn, act_abn, threshold, normal_values, grades, act_grade, normal_status, abnormal_status, context)",
    f"VALUES {qual_values()}")
cte("ubounds(unit, u_low, u_high)", "VALUES " + ", ".join(f"({_sql(u)}, {_f(a)}, {_f(b)})" for u, (a, b) in fu.UNIT_BOUNDS.items()))
cte("panels(panel_name, expected)", "VALUES " + ", ".join(f"({_sql(n)}, {_sql(sorted(c))})" for n, c in fa.PANELS))

# ---- sections ------------------------------------------------------------
cte("typed", f"""SELECT *, CASE WHEN regexp_matches(t, {word_re(lx.SCREENING_KEYWORDS)}) THEN 'screening_attachment'
    WHEN regexp_matches(t, {word_re(lx.HPLC_KEYWORDS)}) THEN 'hplc_diabetes_block'
    WHEN regexp_matches(t, {word_re(lx.HORMONE_KEYWORDS)}) THEN 'hormone_immunology_block' ELSE 'standard_lab_table' END AS row_type
  FROM (SELECT *, lower(coalesce(test_name, '') || ' ' || coalesce(unit, '') || ' ' || coalesce(ref_text, '')) AS t FROM lab)""")
cte("anchored", """SELECT *, CASE WHEN lag(row_idx) OVER p IS NULL OR lead(row_type) OVER p = row_type THEN row_type END AS anchor
  FROM typed WINDOW p AS (PARTITION BY report_id, page_num ORDER BY row_idx)""")
cte("opened", """SELECT *, last_value(anchor IGNORE NULLS) OVER (PARTITION BY report_id, page_num ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS section_type FROM anchored""")
cte("sect", """SELECT *, sum(CASE WHEN prev <> section_type THEN 1 ELSE 0 END) OVER (PARTITION BY report_id, page_num ORDER BY row_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS block_id
  FROM (SELECT *, lag(section_type) OVER (PARTITION BY report_id, page_num ORDER BY row_idx) AS prev FROM opened)""")

# ---- glycated haemoglobin blocks ----------------------------------------


def A(name, value, unit, source):
    return (f"{{'test_name': {_sql(name)}, 'value': {value}, 'unit': {_sql(unit)}, 'ref_low': NULL::DOUBLE, 'ref_high': NULL::DOUBLE, 'source': {_sql(source)}}}")


# correctly rounded to one digit, where round() would scale first
ROUND1 = "format('{{:.1f}}', {0})::DOUBLE"

cte("hrows", f"""SELECT *, CASE WHEN contains(nm, 'ifcc') OR un = 'mmol/mol' THEN 'ifcc' WHEN contains(nm, 'a1c') AND un = '%' THEN 'ngsp'
      WHEN contains(nm, 'eag') OR contains(nm, 'estimated average glucose') THEN 'eag' END AS slot,
    {number('value_raw')} AS value, {number('low_raw')} AS rl, {number('high_raw')} AS rh
  FROM (SELECT *, lower(test_name) AS nm, trim(lower(coalesce(unit, ''))) AS un FROM sect WHERE section_type = 'hplc_diabetes_block')""")
cte("hitems", """SELECT report_id, page_num, block_id, row_idx, slot, {'test_name': test_name, 'value': value,
      'unit': CASE WHEN slot = 'eag' THEN trim(coalesce(nullif(unit, ''), 'mg/dL')) ELSE nullif(trim(coalesce(unit, '')), '') END,
      'ref_low': rl, 'ref_high': rh, 'source': 'ocr'} AS item FROM hrows""")
cte("h0", """SELECT report_id, page_num, block_id, min(row_idx) AS first_row, arg_max(item, row_idx) FILTER (WHERE slot = 'ngsp') AS ngsp,
    arg_max(item, row_idx) FILTER (WHERE slot = 'ifcc') AS ifcc, arg_max(item, row_idx) FILTER (WHERE slot = 'eag') AS eag
  FROM hitems GROUP BY 1, 2, 3""")
cte("h1", f"""SELECT * REPLACE (CASE WHEN m THEN {A('HbA1c (NGSP)', 'ifcc.value', '%', 'plausibility-reclassified')} ELSE ngsp END AS ngsp,
    CASE WHEN m THEN NULL ELSE ifcc END AS ifcc) FROM (SELECT *, coalesce(ifcc.value < 10 AND ngsp IS NULL AND ifcc.value BETWEEN 3 AND 20, false) AS m FROM h0)""")
cte("h2", f"""SELECT * REPLACE (CASE WHEN m2 THEN {A('HbA1c (IFCC)', 'ngsp.value', 'mmol/mol', 'plausibility-reclassified')} ELSE ifcc END AS ifcc,
    CASE WHEN m2 THEN NULL ELSE ngsp END AS ngsp) FROM (SELECT *, coalesce(ngsp.value > 20 AND ifcc IS NULL AND ngsp.value BETWEEN 10 AND 195, false) AS m2 FROM h1)""")
cte("h3", """SELECT * REPLACE (CASE WHEN lower(eag.unit) <> 'mmol/l' AND eag.value < 50 AND eag.value BETWEEN 2.5 AND 28
    THEN {'test_name': eag.test_name, 'value': eag.value, 'unit': 'mmol/L', 'ref_low': eag.ref_low, 'ref_high': eag.ref_high, 'source': eag.source} ELSE eag END AS eag) FROM h2""")
cte("h4", """SELECT *, CASE WHEN lower(eag.unit) = 'mmol/l' THEN eag.value * 18.015 ELSE eag.value END AS e_mg, ifcc.value AS i0, eag.value AS e0 FROM h3""")
cte("h5", f"""SELECT * REPLACE (CASE WHEN ngsp.source = 'plausibility-reclassified' AND abs(e_mg - (28.7 * ngsp.value - 46.7)) > 5 AND (e_mg + 46.7) / 28.7 BETWEEN 3 AND 20
    THEN {A('HbA1c (NGSP)', ROUND1.format('(e_mg + 46.7) / 28.7'), '%', 'derived-from-eag')} ELSE ngsp END AS ngsp) FROM h4""")
cte("h6", f"""SELECT * REPLACE (CASE WHEN ngsp.value IS NULL AND (i0 + 23.5) / 10.93 BETWEEN 3 AND 20
    THEN {A('HbA1c (NGSP)', ROUND1.format('(i0 + 23.5) / 10.93'), '%', 'derived-from-ifcc')} ELSE ngsp END AS ngsp) FROM h5""")
cte("h7", f"""SELECT * REPLACE (CASE WHEN ngsp.value IS NULL AND (e_mg + 46.7) / 28.7 BETWEEN 3 AND 20
    THEN {A('HbA1c (NGSP)', ROUND1.format('(e_mg + 46.7) / 28.7'), '%', 'derived-from-eag')} ELSE ngsp END AS ngsp) FROM h6""")
cte("h8", f"""SELECT * REPLACE (CASE WHEN i0 IS NULL AND 10.93 * ngsp.value - 23.5 BETWEEN 10 AND 195
      THEN {A('HbA1c (IFCC)', ROUND1.format('10.93 * ngsp.value - 23.5'), 'mmol/mol', 'derived-from-ngsp')} ELSE ifcc END AS ifcc,
    CASE WHEN e0 IS NULL AND 28.7 * ngsp.value - 46.7 BETWEEN 50 AND 500
      THEN {A('Estimated Average Glucose (eAG)', ROUND1.format('28.7 * ngsp.value - 46.7'), 'mg/dL', 'derived-from-ngsp')} ELSE eag END AS eag) FROM h7""")
cte("h9", """SELECT *, (ngsp.value IS NOT NULL)::INTEGER + (ifcc.value IS NOT NULL)::INTEGER + (eag.value IS NOT NULL)::INTEGER AS completeness,
    list_filter([CASE WHEN abs(ifcc.value - (10.93 * ngsp.value - 23.5)) > 2 THEN 'NGSP-IFCC mismatch' END,
      CASE WHEN CASE WHEN lower(eag.unit) = 'mmol/l' THEN abs(eag.value - (28.7 * ngsp.value - 46.7) / 18.015) > 0.3 ELSE abs(eag.value - (28.7 * ngsp.value - 46.7)) > 5 END
        THEN 'NGSP-eAG mismatch' END], lambda x: x IS NOT NULL) AS consistency_flags FROM h8""")
cte("hblocks", """SELECT report_id, page_num, block_id, first_row, ngsp, ifcc, eag, completeness, consistency_flags, len(consistency_flags) = 0 AS cross_check_passed,
    CASE WHEN ngsp.value IS NULL OR (len(consistency_flags) > 0 AND completeness >= 2) THEN 'indeterminate' WHEN ngsp.value < 5.7 THEN 'normal'
      WHEN ngsp.value < 6.5 THEN 'prediabetes' ELSE 'diabetes' END AS diabetes_category FROM h9""")
cte("hemit", """SELECT report_id, page_num, first_row * 4 + slot AS row_idx, a.test_name AS test_name, a.value AS value_num, NULL::VARCHAR AS value_text, a.unit AS unit,
    a.ref_low AS ref_low, a.ref_high AS ref_high, NULL::VARCHAR AS ref_text, NULL::VARCHAR AS flag, 'hplc_diabetes_block' AS section_type
  FROM (SELECT report_id, page_num, first_row, 0 AS slot, ngsp AS a FROM hblocks UNION ALL SELECT report_id, page_num, first_row, 1, ifcc FROM hblocks
    UNION ALL SELECT report_id, page_num, first_row, 2, eag FROM hblocks) WHERE a.value IS NOT NULL""")
cte("hcat", """SELECT report_id, k AS hplc_key, arg_max(cat, pos) AS hplc_category FROM (
    SELECT report_id, trim(lower(nm)) AS k, {'p': page_num, 'r': first_row} AS pos, CASE WHEN cross_check_passed THEN diabetes_category ELSE 'indeterminate' END AS cat
    FROM (SELECT *, unnest([ngsp.test_name, ifcc.test_name, eag.test_name]) AS nm FROM hblocks)) WHERE k <> '' GROUP BY 1, 2""")

# ---- number and range repair --------------------------------------------
cte("rep0", f"""SELECT *, {lab_number('value_raw')} AS value_num, {lab_number('low_raw')} AS low0, {lab_number('high_raw')} AS high0 FROM sect""")
cte("rep1", f"""SELECT *, CASE WHEN value_num IS NULL THEN value_raw END AS value_text,
    CASE WHEN low0 IS NULL THEN {comma_fixed('trim(low_raw)')} END AS ls, CASE WHEN high0 IS NULL THEN {comma_fixed('trim(high_raw)')} END AS hs FROM rep0""")


def form(s: str) -> str:
    al, ah = grab(s, PAIR_ALL, 1), grab(s, PAIR_ALL, 2)
    b, a = grab(s, rf"^\s*{BELOW}\s*$"), grab(s, rf"^\s*{ABOVE}\s*$")
    il, ih = grab(s, PAIR, 1), grab(s, PAIR, 2)
    return (f"CASE WHEN {al} IS NOT NULL THEN {{'lo': {al}, 'hi': {ah}}} WHEN {b} IS NOT NULL THEN {{'lo': NULL::DOUBLE, 'hi': {b}}} "
            f"WHEN {a} IS NOT NULL THEN {{'lo': {a}, 'hi': NULL::DOUBLE}} WHEN {il} IS NOT NULL THEN {{'lo': {il}, 'hi': {ih}}} END")


cte("rep2", f"SELECT *, {form('ls')} AS lf, {form('hs')} AS hf FROM rep1")
cte("rep3", """SELECT * EXCLUDE (ref_text),
    CASE WHEN lf IS NOT NULL THEN lf.lo WHEN hf IS NOT NULL THEN hf.lo ELSE low0 END AS rl, CASE WHEN lf IS NOT NULL THEN lf.hi WHEN hf IS NOT NULL THEN hf.hi ELSE high0 END AS rh,
    CASE WHEN lf IS NOT NULL THEN coalesce(nullif(ref_text, ''), ls)
         WHEN hf IS NOT NULL THEN coalesce(nullif(coalesce(ls, ref_text), ''), hs) ELSE coalesce(hs, ls, ref_text) END AS ref_text FROM rep2""")
cte("rep4", f"""SELECT * EXCLUDE (rl, rh), CASE WHEN lift THEN {grab(comma_fixed('trim(ref_text)'), PAIR_ALL, 1)} ELSE rl END AS ref_low,
    CASE WHEN lift THEN {grab(comma_fixed('trim(ref_text)'), PAIR_ALL, 2)} ELSE rh END AS ref_high
  FROM (SELECT *, lf IS NULL AND hf IS NULL AND rl IS NULL AND rh IS NULL AS lift FROM rep3)""")
THRESH = contains_any("lower(coalesce(ref_text, ''))", lx.THRESHOLD_WORDS)
cte("rep5", f"""SELECT * REPLACE (CASE WHEN bad THEN NULL ELSE ref_low END AS ref_low, CASE WHEN bad THEN NULL ELSE ref_high END AS ref_high)
  FROM (SELECT *, ref_low IS NOT NULL AND ref_high IS NOT NULL AND (ref_low >= ref_high OR (value_text IS NULL AND (
      (ref_low + ref_high > 0 AND (value_num / ((ref_low + ref_high) / 2) > 10 OR value_num / ((ref_low + ref_high) / 2) < 0.02)) OR {THRESH}))) AS bad FROM rep4)""")
cte("rep6", """SELECT * REPLACE (CASE WHEN bad2 THEN NULL ELSE ref_low END AS ref_low, CASE WHEN bad2 THEN NULL ELSE ref_high END AS ref_high) FROM (
    SELECT *, coalesce(CASE WHEN contains(nm, 'hba1c') AND NOT contains(nm, 'ifcc') THEN (un <> '' AND un <> '%') OR mid < 1.5 OR mid > 30
      WHEN contains(nm, 'hba1c') THEN (un <> '' AND un <> 'mmol/mol') OR mid < 5 OR mid > 300
      WHEN contains(nm, 'estimated average glucose') THEN (un NOT IN ('', 'mmol/l', 'mg/dl')) OR (un = 'mmol/l' AND (mid < 1.5 OR mid > 40)) OR (un = 'mg/dl' AND (mid < 25 OR mid > 800))
      ELSE false END, false) AS bad2
    FROM (SELECT *, lower(test_name) AS nm, trim(lower(coalesce(unit, ''))) AS un, (ref_low + ref_high) / 2 AS mid FROM rep5))""")
COLS = "report_id, page_num, row_idx, test_name, value_num, value_text, unit, ref_low, ref_high, ref_text, flag, section_type"
cte("allrows", f"""SELECT {COLS.replace('row_idx', 'row_idx * 4 AS row_idx')} FROM rep6 WHERE section_type IN ('standard_lab_table', 'hormone_immunology_block')
    AND test_name IS NOT NULL AND value_raw IS NOT NULL UNION ALL SELECT {COLS} FROM hemit""")
NOISE = rf"""(length(trim(test_name)) < 2 OR regexp_matches(trim(test_name), ':\s*$') OR regexp_matches(trim(test_name), '(?i)exact name as printed')
   OR regexp_matches(trim(test_name), '^\d{{2}}[-/]\d{{2}}[-/]\d{{4}}') OR regexp_matches(trim(test_name), '(?i)^interpretation$')
   OR NOT (value_num IS NOT NULL OR coalesce(lower(trim(value_text)) IN {words(lx.QUALITATIVE_WORDS)}, false))
   OR coalesce(regexp_matches(trim(value_text), '^\d{{2}}[-/]\d{{2}}[-/]\d{{2,4}}$'), false) OR coalesce(length(value_text), 0) > 50
   OR (length(trim(test_name)) > 80 AND coalesce(unit, '') = ''))"""
cte("noised", f"SELECT *, {NOISE} AS is_noise FROM allrows")
cte("kept", f"""SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY report_id, test_name, value_num, value_text, unit ORDER BY page_num, row_idx) AS rn
    FROM noised WHERE NOT is_noise) WHERE rn = 1""")

# ---- names ---------------------------------------------------------------
cte("wordn", f"SELECT kind, ord, key, loinc, {abbreviated('nk')} AS norm FROM (SELECT *, {normal_name('key')} AS nk FROM words)")
cte("exactk", "SELECT key, arg_min(loinc, kind) AS loinc, min(kind) AS kind FROM (SELECT kind, key, arg_max(loinc, ord) AS loinc FROM words GROUP BY 1, 2) GROUP BY 1")
cte("normk", "SELECT norm, arg_min(loinc, ord) AS loinc FROM wordn GROUP BY 1")
cte("topick", f"""SELECT key, arg_min(topic, place) AS topic FROM (SELECT {{'k': kind, 'p': place}} AS place, topic, unnest([trim(lower(name)), {abbreviated(normal_name('name'))}]) AS key FROM topicw)
    WHERE key <> '' GROUP BY 1""")
cte("nm0", f"SELECT test_name, trim(lower(test_name)) AS raw_key, {abbreviated('nk')} AS norm_key FROM (SELECT DISTINCT test_name, {normal_name('test_name')} AS nk FROM kept)")
cte("nearest_names", """SELECT norm_key, arg_min(loinc, {'s': -score, 'o': ord}) AS loinc FROM (
    SELECT m.norm_key, w.loinc, w.ord, 1 - levenshtein(m.norm_key, w.norm) / greatest(length(m.norm_key), length(w.norm)) AS score
    FROM (SELECT DISTINCT norm_key FROM nm0 WHERE raw_key NOT IN (SELECT key FROM exactk) AND norm_key NOT IN (SELECT norm FROM normk)) m, wordn w) WHERE score >= 0.8 GROUP BY 1""")
cte("nm1", """SELECT n.*, coalesce(e.loinc, k.loinc, z.loinc) AS loinc_code,
    CASE WHEN e.loinc IS NOT NULL THEN CASE e.kind WHEN 0 THEN 'high' ELSE 'medium' END WHEN k.loinc IS NOT NULL THEN 'medium' ELSE 'low' END AS match_conf,
    CASE WHEN e.loinc IS NOT NULL THEN CASE e.kind WHEN 0 THEN 'exact' ELSE 'alias' END WHEN k.loinc IS NOT NULL THEN 'normalised' WHEN z.loinc IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS match_step
  FROM nm0 n LEFT JOIN exactk e ON n.raw_key = e.key LEFT JOIN normk k ON n.norm_key = k.norm LEFT JOIN nearest_names z ON n.norm_key = z.norm_key""")
cte("names", f"""SELECT n.*, coalesce(c.topic, a.topic, b.topic, {case_map('f.category', fa.CATEGORY_TOPICS.items())}, 'other') AS health_topic,
    coalesce(c.topic, a.topic, b.topic) IS NULL AS topic_inferred
  FROM nm1 n LEFT JOIN codetopic c USING (loinc_code) LEFT JOIN topick a ON n.raw_key = a.key LEFT JOIN topick b ON n.norm_key = b.key LEFT JOIN famc f USING (loinc_code)""")

# ---- verification --------------------------------------------------------


def checks(uc: str, src: str, section: str) -> str:
    """SELECT list for p, f, w (passed, failed, warned) given the SQL of unit
    confidence, range source and section."""
    ok = "(ub.u_low IS NULL OR value_num BETWEEN ub.u_low AND ub.u_high)"
    fl = "upper(coalesce(flag, ''))"
    unit_seen = "value_num IS NOT NULL AND coalesce(r.unit, '') <> ''"
    odd = f"(({fl} IN ('H', 'A') AND value_num BETWEEN ref_low AND ref_high) OR ({fl} = 'L' AND value_num >= ref_low))"
    weak, caution = f"{src} IN ('no-range', 'ocr-flag-fallback')", f"{src} IN ('range-text', 'lab-provided-suspicious')"
    named, valued = "coalesce(test_name, '') <> ''", "value_num IS NOT NULL OR value_text IS NOT NULL"
    passed = [named, valued, f"{unit_seen} AND {ok}",
              f"{fl} <> '' AND value_num IS NOT NULL AND ref_low IS NOT NULL AND ref_high IS NOT NULL AND NOT {odd}",
              f"{section} = 'hplc_diabetes_block'", f"{uc} <> 'low'", f"{src} <> '' AND NOT {weak} AND NOT {caution}"]
    failed = [f"NOT ({named})", f"NOT ({valued})", f"{unit_seen} AND NOT {ok}", f"{uc} = 'low'", weak]
    total = lambda cs: " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in cs)
    return f"{total(passed)} AS p, {total(failed)} AS f, {total([caution])} AS w"


VERDICT = ("CASE WHEN f = 0 AND p >= 2 AND w = 0 THEN 'accept' WHEN f = 0 AND p >= 2 THEN 'accept_with_warning' WHEN f = 0 THEN 'downgrade' "
           "WHEN f = 1 AND p >= 2 THEN 'downgrade' WHEN f >= 2 THEN 'retry' ELSE 'accept' END")
UB = "LEFT JOIN ubounds ub ON lower(trim(r.unit)) = ub.unit"
cte("ver0", f"SELECT r.*, {checks("'high'", "''", "''")} FROM kept r {UB}")
cte("ver", f"""SELECT * EXCLUDE (v), v AS verdict1, CASE v WHEN 'downgrade' THEN 'downgraded' WHEN 'retry' THEN 'retry_exhausted' WHEN 'accept_with_warning' THEN 'accepted_with_warning' ELSE 'accepted' END AS label1,
    CASE v WHEN 'downgrade' THEN 'medium' WHEN 'retry' THEN 'low' END AS uc1 FROM (SELECT *, {VERDICT} AS v FROM ver0)""")

# ---- conversion and trust ------------------------------------------------
UNIT_LOWER = {k.lower(): v for k, v in fu.UNIT_ALIASES.items()}


def unit_norm(s: str) -> str:
    u = f"translate({s}, 'μ²³', 'µ23')"
    return f"coalesce({case_map(u, fu.UNIT_ALIASES.items())}, {case_map(f'lower(trim({u}))', UNIT_LOWER.items())}, {u})"


cte("att", """SELECT v.* EXCLUDE (p, f, w), n.loinc_code AS m_code, n.match_conf, n.health_topic, n.topic_inferred,
    v.ref_low IS NOT NULL AND v.ref_high IS NOT NULL AS has_lab, trim(coalesce(v.unit, '')) AS ut FROM ver v JOIN names n USING (test_name)""")
cte("cv0", f"""SELECT a.*, c.canonical, c.factors, {unit_norm('ut')} AS nu, hb.h_low, hb.h_high, value_num IS NOT NULL AND ut <> '' AND NOT has_lab AS conv_on
  FROM att a LEFT JOIN conv c ON a.m_code = c.loinc_code LEFT JOIN human hb ON a.m_code = hb.loinc_code""")
cte("cv1", """SELECT *, list_filter(factors, lambda x: lower(x.f) = lower(nu))[1].x AS hit, canonical IS NULL OR nu = canonical AS native FROM cv0""")
cte("cv2", """SELECT *, NOT native AND hit IS NOT NULL AS cd, CASE WHEN NOT native AND hit IS NOT NULL THEN format('{:.4f}', value_num * hit)::DOUBLE ELSE value_num END AS cval,
    CASE WHEN native THEN coalesce(canonical, nu) WHEN hit IS NOT NULL THEN canonical ELSE nu END AS cunit FROM cv1""")
cte("cv3", """SELECT r.*, cd AND NOT ((b1.u_low IS NULL OR cval BETWEEN b1.u_low AND b1.u_high) AND (h_low IS NULL OR cval BETWEEN h_low AND h_high)) AS misfit,
    (b2.u_low IS NULL OR value_num BETWEEN b2.u_low AND b2.u_high) AS fine
  FROM cv2 r LEFT JOIN ubounds b1 ON lower(trim(r.cunit)) = b1.unit LEFT JOIN ubounds b2 ON lower(trim(r.ut)) = b2.unit""")
cte("cv4", """SELECT * EXCLUDE (value_num, unit), CASE WHEN conv_on THEN CASE WHEN misfit AND fine THEN value_num ELSE cval END ELSE value_num END AS value_num,
    CASE WHEN conv_on THEN CASE WHEN misfit AND fine THEN ut ELSE cunit END ELSE unit END AS unit,
    CASE WHEN conv_on THEN CASE WHEN misfit THEN 'low' WHEN cd OR native THEN 'high' ELSE 'low' END ELSE uc1 END AS uc2,
    conv_on AND cd AND NOT (misfit AND fine) AS converted,
    CASE WHEN conv_on AND (CASE WHEN misfit THEN 'low' WHEN cd OR native THEN 'high' ELSE 'low' END) = 'low' AND NOT (cd AND NOT (misfit AND fine)) THEN NULL ELSE m_code END AS code2 FROM cv3""")
cte("mr0", """SELECT r.*, u.rule_unit, u.r0_low, u.r0_high, coalesce(ut <> '' AND ((u.r0_low > 0 AND value_num < u.r0_low / 5) OR (u.r0_high > 0 AND value_num > u.r0_high * 5)), false) AS far
  FROM cv4 r LEFT JOIN rules u ON r.code2 = u.loinc_code""")
cte("mr1", """SELECT *, CASE WHEN far THEN list_filter(list_transform(factors, lambda x: format('{:.4f}', value_num * x.x)::DOUBLE),
      lambda y: y >= CASE WHEN r0_low > 0 THEN r0_low * 0.5 ELSE -1e308 END AND y <= r0_high * 2)[1] END AS near FROM mr0""")
cte("mr2", """SELECT * EXCLUDE (value_num, unit, ref_low, ref_high, uc2, rule_unit, r0_low, r0_high, code2),
    coalesce(near, value_num) AS value_num, CASE WHEN near IS NOT NULL THEN canonical ELSE unit END AS unit,
    CASE WHEN near IS NOT NULL THEN NULL ELSE ref_low END AS ref_low, CASE WHEN near IS NOT NULL THEN NULL ELSE ref_high END AS ref_high,
    CASE WHEN near IS NOT NULL THEN 'medium' WHEN far AND canonical IS NULL THEN 'low' ELSE uc2 END AS unit_conf,
    CASE WHEN near IS NOT NULL THEN 'unit-corrected' END AS range_source_pre,
    CASE WHEN ut = '' AND NOT has_lab THEN NULL ELSE code2 END AS loinc_code FROM mr1""")
cte("tr0", """SELECT r.*, u.rule_unit, u.r0_low, u.r0_high, u.n_low, u.n_high, u.bands, u.rule_src, fc.category AS analyte_category, fc.fams,
    (r.ref_low + r.ref_high) / 2 AS mid, (u.r0_low + u.r0_high) / 2 AS cmid
  FROM mr2 r LEFT JOIN rules u USING (loinc_code) LEFT JOIN famc fc USING (loinc_code)""")
cte("tr1", """SELECT *, CASE WHEN value_num IS NULL OR NOT has_lab OR mid IS NULL THEN 'high'
    WHEN mid > 0 AND cmid > 0 THEN CASE WHEN greatest(mid / cmid, cmid / mid) > 5 THEN CASE WHEN value_num BETWEEN ref_low AND ref_high THEN 'medium' ELSE 'low' END ELSE 'high' END
    WHEN fams IS NOT NULL THEN CASE WHEN len(list_filter(fams, lambda x: CASE WHEN x.rl + x.rh > 0 AND mid > 0
        THEN mid / ((x.rl + x.rh) / 2) BETWEEN 0.2 AND 5 AND CASE WHEN x.vl + x.vh > 0 THEN value_num / ((x.vl + x.vh) / 2) ELSE 1 END BETWEEN 0.01 AND 100
        ELSE x.rh > 0 AND ref_low >= x.rl * 0.1 AND ref_high <= x.rh * 10 END)) > 0 THEN 'high' ELSE 'low' END
    WHEN mid <= 0 THEN 'medium' WHEN value_num / mid > 10 OR value_num / mid < 0.1 THEN 'low' ELSE 'high' END AS trust0 FROM tr0""")
cte("conf0", f"""SELECT * REPLACE (CASE WHEN xu THEN NULL ELSE ref_low END AS ref_low, CASE WHEN xu THEN NULL ELSE ref_high END AS ref_high),
    CASE WHEN xu THEN 'low' ELSE trust0 END AS range_trust,
    coalesce(loinc_code IN {words(ff.DECISION_THRESHOLD_CODES)}, false) OR {contains_any('lower(test_name)', fa.GLYCATED_NAMES)} OR section_type = 'hplc_diabetes_block' AS is_decision_threshold,
    coalesce(analyte_category IN {words(ff.RESTRICTED_FLAG_CATEGORIES)}, false) AS restricted_flag
  FROM (SELECT *, coalesce(has_lab AND mid > 0 AND (value_num / mid > 20 OR value_num / mid < 0.05), false) AS xu FROM tr1)""")
cte("conf1", """SELECT r.*, h.hplc_category FROM conf0 r LEFT JOIN hcat h ON r.report_id = h.report_id AND r.section_type = 'hplc_diabetes_block' AND trim(lower(r.test_name)) = h.hplc_key""")
cte("rev0", f"SELECT r.*, {checks("coalesce(unit_conf, 'high')", "coalesce(range_source_pre, '')", "section_type")} FROM conf1 r {UB}")
cte("enr", f"""SELECT * EXCLUDE (v), CASE WHEN v IN ('downgrade', 'retry') AND label1 IN ('accepted', 'accepted_with_warning') THEN 'downgraded' ELSE label1 END AS label2,
    CASE WHEN v IN ('downgrade', 'retry') AND label1 IN ('accepted', 'accepted_with_warning') THEN 'downgrade' ELSE verdict1 END AS verdict2
  FROM (SELECT *, {VERDICT} AS v FROM rev0)""")

# ---- qualitative ---------------------------------------------------------
NORMAL, ABNORMAL, GRADES = words(lx.NORMAL_WORDS), words(lx.ABNORMAL_WORDS), words(lx.GRADE_ORDER)


def canonical_value(s: str) -> str:
    v = f"lower(trim({s}))"
    a = f"coalesce({case_map(v, VALUE_ALIASES.items())}, {v})"
    return f"coalesce({case_map(a, SEMI_QUANT_CANONICAL.items())}, {a})"


QCOLS = "category, pos_dir, neg_dir, sev_pos, act_pos, sev_abn, act_abn, threshold, normal_values, grades, act_grade, context"
cte("q0", f"""SELECT e.*, q.loinc_code IS NOT NULL AS by_code, coalesce(q.loinc_code, qn.loinc_code) IS NOT NULL AS has_rule,
    {", ".join(f"CASE WHEN q.loinc_code IS NOT NULL THEN q.{c} ELSE qn.{c} END AS q_{c}" for c in QCOLS.split(", "))}
  FROM enr e LEFT JOIN qual q USING (loinc_code) LEFT JOIN qual qn ON trim(lower(e.test_name)) = qn.qual_name""")
cte("q1", f"""SELECT *, value_num IS NOT NULL AND q_threshold IS NOT NULL AS is_titer,
    CASE WHEN value_num IS NOT NULL THEN CASE WHEN value_num >= q_threshold THEN 'positive' ELSE 'negative' END ELSE {canonical_value("coalesce(value_text, '')")} END AS val FROM q0""")
cte("q2", f"""SELECT *, value_num IS NULL OR is_titer AS is_q,
    CASE WHEN NOT has_rule THEN CASE WHEN val IN {NORMAL} THEN 'fn' WHEN val IN {ABNORMAL} THEN 'fa' WHEN val IN {GRADES} THEN 'fg'
           WHEN upper(coalesce(flag, '')) IN ('H', 'A') THEN 'fh' WHEN upper(coalesce(flag, '')) = 'L' THEN 'fl' ELSE 'u' END
      WHEN q_category = 'categorical' THEN 'c'
      WHEN q_category = 'semi_quantitative' THEN CASE WHEN list_contains(q_normal_values, val) THEN 'sn' ELSE 'sa' END
      WHEN q_category = 'expected_positive' THEN CASE WHEN val IN {ABNORMAL} THEN 'pp' WHEN val IN {NORMAL} THEN 'pn' ELSE 'u' END
      ELSE CASE WHEN val IN {NORMAL} THEN 'nn' WHEN val IN {ABNORMAL} THEN 'np' ELSE 'u' END END AS leaf FROM q1""")
GPOS = lambda s: f"coalesce(list_position({_sql(lx.GRADE_ORDER)}, {s}), 0)"
cte("q3", f"""SELECT *, CASE leaf WHEN 'fn' THEN 'in-range' WHEN 'fa' THEN 'high' WHEN 'fg' THEN 'high' WHEN 'fh' THEN 'high' WHEN 'fl' THEN 'low' WHEN 'c' THEN 'in-range'
      WHEN 'sn' THEN 'in-range' WHEN 'sa' THEN 'high' WHEN 'pp' THEN q_pos_dir WHEN 'pn' THEN q_neg_dir WHEN 'nn' THEN q_neg_dir WHEN 'np' THEN q_pos_dir ELSE 'indeterminate' END AS qd,
    CASE leaf WHEN 'fa' THEN 'mild' WHEN 'sn' THEN coalesce(q_grades[val], 'normal') WHEN 'sa' THEN coalesce(q_grades[val], 'mild') WHEN 'pn' THEN q_sev_abn WHEN 'np' THEN q_sev_pos ELSE 'normal' END AS qs,
    CASE WHEN leaf IN ('fn', 'fa') THEN 'medium' WHEN leaf IN ('fg', 'fh', 'fl', 'u') THEN 'low' ELSE 'high' END AS qc FROM q2""")
cte("q4", f"""SELECT *, CASE leaf WHEN 'pn' THEN q_act_abn WHEN 'np' THEN q_act_pos WHEN 'sa' THEN CASE WHEN qs = 'critical' THEN 'urgent'
      WHEN {GPOS('val')} > 0 AND {GPOS('q_act_grade')} > 0 AND {GPOS('val')} >= {GPOS('q_act_grade')} THEN 'follow-up' ELSE 'routine' END ELSE 'routine' END AS qa,
    leaf IN ('np', 'sa') AND qs = 'critical' AS qp, CASE WHEN leaf = 'u' THEN 'could_not_classify' ELSE 'classified' END AS qst,
    CASE WHEN has_rule AND leaf <> 'u' THEN q_context ELSE '' END AS qh,
    CASE WHEN is_titer THEN CASE WHEN by_code THEN 'qualitative-loinc-titer' ELSE 'qualitative-name-titer' END WHEN by_code THEN 'qualitative-loinc'
      WHEN has_rule THEN 'qualitative-name-fallback' ELSE 'qualitative-fallback' END AS qm FROM q3""")

# ---- numeric interpretation ---------------------------------------------
cte("i0", """SELECT *, lower(trim(coalesce(unit, ''))) AS ul, lower(rule_unit) AS rul, coalesce(unit_conf, 'high') AS ucf,
    CASE WHEN ref_low IS NOT NULL AND ref_high IS NOT NULL THEN
      CASE WHEN coalesce((value_num < ref_low OR value_num > ref_high) AND value_num BETWEEN r0_low AND r0_high, false) THEN 'swap' ELSE 'lab' END
      WHEN r0_low IS NOT NULL THEN 'cur' ELSE 'none' END AS pick FROM q4""")
cte("i1", """SELECT *, CASE WHEN pick IN ('swap', 'cur') AND (ucf = 'low' OR ul = '' OR (rul <> '' AND rul <> ul)) THEN 'none' ELSE pick END AS pick1 FROM i0""")
cte("i2", """SELECT *, pick1 = 'lab' AND range_trust = 'low' AND r0_low IS NOT NULL AS doubt, rul <> '' AND rul = ul AS same FROM i1""")
cte("i3", """SELECT *, CASE WHEN doubt AND same THEN 'swap' ELSE pick1 END AS pick2 FROM i2""")
cte("i4", """SELECT *, (doubt AND NOT same) OR (is_decision_threshold AND (r0_low IS NULL OR (range_trust = 'low' AND pick2 NOT IN ('swap', 'cur')))) AS degraded,
    CASE pick2 WHEN 'lab' THEN ref_low WHEN 'swap' THEN r0_low WHEN 'cur' THEN n_low END AS sl, CASE pick2 WHEN 'lab' THEN ref_high WHEN 'swap' THEN r0_high WHEN 'cur' THEN n_high END AS sh,
    CASE pick2 WHEN 'lab' THEN CASE WHEN range_trust IN ('low', 'medium') THEN 'lab-provided-suspicious' ELSE 'lab-provided-validated' END WHEN 'none' THEN 'no-range' ELSE 'curated-fallback' END AS src FROM i3""")
cte("i5", f"""SELECT *, {grab('trim(ref_text)', BELOW)} AS tb, {grab('trim(ref_text)', ABOVE)} AS ta, {grab('trim(ref_text)', PAIR_ALL, 1)} AS p1, {grab('trim(ref_text)', PAIR_ALL, 2)} AS p2 FROM i4""")
cte("i6", """SELECT *, CASE WHEN sl IS NULL AND coalesce(ref_text, '') <> '' THEN CASE WHEN tb IS NOT NULL THEN CASE WHEN value_num > tb THEN 'high' ELSE 'in-range' END
      WHEN ta IS NOT NULL THEN CASE WHEN value_num < ta THEN 'low' ELSE 'in-range' END
      WHEN p1 < p2 THEN CASE WHEN value_num < p1 THEN 'low' WHEN value_num > p2 THEN 'high' ELSE 'in-range' END END END AS tdir FROM i5""")
cte("i7", f"""SELECT *, CASE WHEN sl IS NULL AND tdir IS NULL AND ul <> '' AND NOT restricted_flag AND NOT is_decision_threshold
      AND NOT (coalesce(loinc_code IN {words(fa.LEUKOCYTE_FRACTIONS)}, false) AND ul = '%' AND r0_low IS NULL)
      THEN CASE WHEN upper(coalesce(flag, '')) IN ('H', 'A') THEN 'high' WHEN upper(coalesce(flag, '')) = 'L' THEN 'low' END END AS fdir,
    CASE WHEN sl IS NOT NULL THEN sl WHEN tdir IS NOT NULL AND p1 < p2 THEN p1 END AS gl, CASE WHEN sl IS NOT NULL THEN sh WHEN tdir IS NOT NULL AND p1 < p2 THEN p2 END AS gh FROM i6""")
cte("i8", """SELECT *, CASE WHEN degraded THEN 'indeterminate' WHEN sl IS NOT NULL THEN CASE WHEN value_num < sl THEN 'low' WHEN value_num > sh THEN 'high' ELSE 'in-range' END
      ELSE coalesce(tdir, fdir, 'indeterminate') END AS nd,
    NOT degraded AND gl IS NOT NULL AS graded, CASE WHEN sl IS NOT NULL THEN src ELSE 'lab-provided-validated' END AS gsrc,
    CASE WHEN degraded THEN 'no-range' WHEN sl IS NOT NULL THEN src WHEN tdir IS NOT NULL THEN 'range-text' WHEN fdir IS NOT NULL THEN 'ocr-flag-fallback' ELSE 'no-range' END AS nsrc FROM i7""")
HEUR = "CASE WHEN gh - gl <= 0 THEN 'mild' WHEN CASE WHEN value_num < gl THEN gl - value_num ELSE value_num - gh END / (gh - gl) <= 0.1 THEN 'mild' ELSE 'moderate' END"
cte("i9", f"""SELECT *, CASE WHEN graded AND nd IN ('low', 'high') THEN CASE WHEN range_trust = 'low' THEN 'mild'
      WHEN r0_low IS NOT NULL AND gsrc = 'curated-fallback' THEN coalesce(list_filter(bands, lambda b: value_num BETWEEN b.low AND b.high)[1].tier,
        CASE WHEN value_num NOT BETWEEN n_low AND n_high THEN 'moderate' ELSE 'normal' END)
      WHEN r0_low IS NOT NULL THEN {HEUR} ELSE 'normal' END END AS s0, {HEUR} AS heur FROM i8""")
cte("i10", f"""SELECT *, coalesce(s1 <> 'normal' AND bands IS NULL, false) AS gated, CASE WHEN s1 <> 'normal' AND bands IS NULL THEN 'normal' ELSE coalesce(s1, 'normal') END AS nraw
  FROM (SELECT *, CASE WHEN s0 = 'normal' THEN heur ELSE s0 END AS s1 FROM i9)""")
cte("i11", f"""SELECT *, CASE WHEN nraw IN ('moderate', 'critical') AND {LOW_PRIORITY('test_name')} THEN 'mild' ELSE nraw END AS ns,
    CASE WHEN graded THEN least(CASE WHEN gsrc = 'lab-provided-validated' THEN greatest({CONF.format('match_conf')}, 1) ELSE {CONF.format('match_conf')} END,
      CASE gsrc WHEN 'lab-provided-validated' THEN 2 WHEN 'curated-fallback' THEN 1 ELSE 0 END, {CONF.format('ucf')}) ELSE 0 END AS ncr FROM i10""")
HP = lambda n, p, d, i: f"CASE hplc_category WHEN 'normal' THEN '{n}' WHEN 'prediabetes' THEN '{p}' WHEN 'diabetes' THEN '{d}' ELSE '{i}' END"
PICK = lambda q, h, n: f"CASE WHEN is_q THEN {q} WHEN hplc_category IS NOT NULL THEN {h} ELSE {n} END"
ACT = lambda s: f"CASE {s} WHEN 'critical' THEN 'urgent' WHEN 'moderate' THEN 'consult' WHEN 'mild' THEN 'monitor' ELSE 'routine' END"
cte("itp0", f"""SELECT report_id, page_num, row_idx, test_name, value_num, value_text, unit, flag, section_type, loinc_code, match_conf, health_topic, topic_inferred, label2, verdict2,
    ref_text, hplc_category, analyte_category, is_decision_threshold, restricted_flag, converted, ucf AS unit_conf,
    {PICK('qd', HP('in-range', 'high', 'high', 'indeterminate'), 'nd')} AS direction, {PICK('qs', HP('normal', 'mild', 'moderate', 'normal'), 'ns')} AS severity,
    {PICK('qs', HP('normal', 'mild', 'moderate', 'normal'), 'nraw')} AS severity_raw, {PICK('qa', HP('routine', 'monitor', 'consult', 'routine'), ACT('ns'))} AS actionability,
    {PICK('qp', 'false', 'false')} AS is_panic, {PICK('qc', HP('high', 'high', 'high', 'low'), "CASE ncr WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END")} AS confidence,
    {PICK("CASE WHEN has_rule THEN 'qualitative-rule' ELSE 'no-range' END", "'hplc-cross-check'", 'nsrc')} AS range_source,
    {PICK('qst', "'classified'", "CASE WHEN nd = 'indeterminate' THEN 'could_not_classify' WHEN gated THEN 'low_confidence' ELSE 'classified' END")} AS classification_state,
    {PICK('NULL', 'NULL', 'CASE WHEN degraded THEN NULL ELSE gl END')} AS rng_low, {PICK('NULL', 'NULL', 'CASE WHEN degraded THEN NULL ELSE gh END')} AS rng_high,
    {PICK("'high'", "'high'", 'range_trust')} AS range_trust, CASE WHEN upper(trim(flag)) IN ('H', 'L', 'A') THEN upper(trim(flag)) END AS sflag0,
    CASE WHEN is_q THEN qm END AS method, CASE WHEN is_q THEN qh END AS hint, CASE WHEN NOT is_q THEN rule_src END AS rule_source FROM i11""")
WEAK = "range_source = 'ocr-flag-fallback' AND rng_low IS NULL AND rng_high IS NULL AND direction IN ('high', 'low')"
cte("itp1", f"""SELECT * REPLACE (CASE WHEN wk THEN 'indeterminate' ELSE direction END AS direction, CASE WHEN wk THEN 'low' ELSE confidence END AS confidence,
    CASE WHEN wk THEN 'low_confidence' ELSE classification_state END AS classification_state, CASE WHEN wk THEN 'normal' ELSE severity END AS severity,
    CASE WHEN wk THEN 'routine' ELSE actionability END AS actionability, CASE WHEN wk THEN false ELSE is_panic END AS is_panic),
    CASE WHEN wk THEN upper(direction[1]) ELSE sflag0 END AS source_flag FROM (SELECT *, {WEAK} AS wk FROM itp0)""")
cte("itp", """SELECT *, CASE WHEN label2 = 'accepted' AND (range_source IN ('range-text', 'lab-provided-suspicious') OR confidence = 'low') THEN 'accepted_with_warning' ELSE label2 END AS verification_verdict,
    CASE WHEN label2 = 'accepted' AND verdict2 = 'accept' AND (range_source IN ('range-text', 'lab-provided-suspicious') OR confidence = 'low') THEN 'accept_with_warning' ELSE verdict2 END AS verdict3 FROM itp1""")

# ---- rollup --------------------------------------------------------------
TRUST = "CASE range_source WHEN 'lab-provided-validated' THEN 5 WHEN 'curated-fallback' THEN 4 WHEN 'unit-corrected' THEN 3 WHEN 'lab-provided-suspicious' THEN 2 WHEN 'range-text' THEN 1 ELSE 0 END"
cte("dk", f"SELECT *, {analyte_key('test_name')} AS dkey, section_type = 'hplc_diabetes_block' AS exempt FROM itp")
cte("dg", """SELECT d.*, CASE WHEN g.codes > 1 THEN coalesce(loinc_code, '') ELSE '' END AS part FROM dk d
  LEFT JOIN (SELECT report_id, dkey, count(DISTINCT loinc_code) AS codes FROM dk WHERE NOT exempt GROUP BY 1, 2) g USING (report_id, dkey)""")
cte("marked", f"""SELECT * EXCLUDE (rk), exempt OR rk = 1 AS is_canonical FROM (SELECT *, row_number() OVER (PARTITION BY exempt, report_id, dkey, part
    ORDER BY {CONF.format('confidence')} DESC, (trim(coalesce(unit, '')) <> '') DESC, {TRUST} DESC, {CONF.format('unit_conf')} DESC, page_num, row_idx) AS rk FROM dg)""")
cte("canon", f"""SELECT *, st = 'classified' AND (severity IN ('mild', 'moderate', 'critical') OR is_panic) AS abn, st <> 'classified' OR direction = 'indeterminate' AS unclear, {LOW_PRIORITY('test_name')} AS low_prio,
    CASE WHEN is_panic THEN 3 ELSE {SEV.format('severity')} END AS srank FROM (SELECT *, classification_state AS st FROM marked WHERE is_canonical)""")
STATUS = "CASE {0} WHEN 3 THEN 'red' WHEN 2 THEN 'orange' WHEN 1 THEN 'yellow' ELSE 'green' END"
cte("topics", f"""SELECT report_id, health_topic AS topic, count(*) FILTER (WHERE abn AND NOT low_prio) AS abnormal_count, count(*) FILTER (WHERE unclear AND NOT abn) AS indeterminate_count,
    count(*) FILTER (WHERE abn AND low_prio) AS minor_count, count(*) AS total_count, max(srank) AS sr FROM canon GROUP BY 1, 2""")
cte("rstat", f"SELECT report_id, {STATUS.format('max(srank)')} AS overall_status, count(*) FILTER (WHERE unclear) AS indeterminate_count FROM canon GROUP BY 1")
cte("fnd0", f"""SELECT *, coalesce(CASE WHEN direction <> 'indeterminate' THEN CASE WHEN value_num > rng_high THEN abs(value_num - rng_high) / abs(CASE WHEN rng_high = 0 THEN 1 ELSE rng_high END)
      WHEN value_num < rng_low THEN abs(rng_low - value_num) / abs(CASE WHEN rng_low = 0 THEN 1 ELSE rng_low END) END END, 0) AS bdev,
    bool_or(NOT low_prio) OVER (PARTITION BY report_id) AS any_main FROM canon WHERE severity IN ('mild', 'moderate', 'critical') OR is_panic""")
cte("fnd", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY {SEV.format('severity')} DESC, is_panic DESC, bdev DESC, page_num, row_idx) AS finding_rank
    FROM fnd0 WHERE NOT (low_prio AND any_main)) WHERE finding_rank <= 3""")
