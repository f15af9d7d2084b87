"""Text expressions: number repair, match keys, display names, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from titrant.fixed import lexicons as lx
from titrant.fixed.analytes import ABBREVIATIONS, SPECIMENS
from titrant.functions.numbers import exact_round_sql

BLANKS = " \t\r\n\f\u000b "
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_DASHES = "-–—"
_RANGE_DASH = f"[{_DASHES}]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def literal_map(pairs) -> Column:
    """A constant string map column."""
    flat = [F.lit(x) for kv in pairs for x in kv]
    return F.create_map(*flat)


def any_of(c: Column, words) -> Column:
    """True when the text contains any of the words as a substring."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words], F.lit(False))


def has_any(c: Column, marks: str) -> Column:
    """True when the text contains any of the characters.  It spares texts that
    cannot match a pattern, which costs many times as much."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(m)) for m in marks])


def escape(word: str) -> str:
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|/#&~" else ch for ch in word)


# ---- numbers -------------------------------------------------------------

def decimal_comma(c: Column) -> Column:
    """A comma before one or two digits becomes a decimal point."""
    return F.when(has_any(c, ","), F.regexp_replace(c, r"(\d),(\d{1,2})(?!\d)", "$1.$2")).otherwise(c)


def plain_number(c: Column) -> Column:
    """Double value of a plain numeric text, else null."""
    s = strip(c)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def lab_number(c: Column) -> Column:
    """Like plain_number, and a lone `digits,digits` reads as a decimal."""
    s = strip(c)
    return F.coalesce(
        F.when(s.rlike(NUMBER), s.try_cast("double")),
        F.when(has_any(s, ",") & s.rlike(r"^\d+,\d+$"), F.replace(s, F.lit(","), F.lit(".")).try_cast("double")),
    )


def range_bounds(c: Column, anchored: bool = True) -> tuple[Column, Column]:
    """Both numbers of an `a - b` text; nulls when the text is not one."""
    pat = rf"([\d.]+)\s*{_RANGE_DASH}\s*([\d.]+)"
    if anchored:
        pat = rf"^\s*{pat}\s*$"
    return tuple(
        F.when(has_any(c, _DASHES), F.nullif(F.regexp_extract(c, pat, i), F.lit("")).try_cast("double")) for i in (1, 2))


def upper_bound(c: Column, anchored: bool = True) -> Column:
    pat = r"[<≤]\s*=?\s*([\d.]+)"
    pat = rf"^\s*{pat}\s*$" if anchored else pat
    return F.when(has_any(c, "<≤"), F.nullif(F.regexp_extract(c, pat, 1), F.lit("")).try_cast("double"))


def lower_bound(c: Column, anchored: bool = True) -> Column:
    pat = r"[>≥]\s*=?\s*([\d.]+)"
    pat = rf"^\s*{pat}\s*$" if anchored else pat
    return F.when(has_any(c, ">≥"), F.nullif(F.regexp_extract(c, pat, 1), F.lit("")).try_cast("double"))


def number_text(name: str) -> Column:
    """Stable text of a numeric column: four decimals, trailing zeros cut."""
    rounded = F.expr(exact_round_sql(name, 4))
    return F.regexp_replace(rounded.cast("decimal(38,4)").cast("string"), r"\.?0+$", "")


# ---- names ---------------------------------------------------------------

_SPECIMEN = "|".join(SPECIMENS)
_SPECIMEN_LOOSE = _SPECIMEN.replace(" ", r"\s+")
_ABBREVIATION_HEAD = "^(" + "|".join(escape(a) for a, _ in ABBREVIATIONS) + ")(?= |$)"


def normal_name(c: Column) -> Column:
    """Name reduced to its matching form: specimen words, short brackets and
    footnote marks go, then the first known abbreviation stands for the name."""
    s = F.lower(strip(c))
    for pat, to in [
        (rf"(?iU)\s*[\[(]\s*(?:{_SPECIMEN})\s*[\])]", ""),
        (rf"(?iU)\s*/\s*(?:{_SPECIMEN_LOOSE})\s*$", ""),
        (r"\s*%\s*$", ""),
        (r"\s*\([A-Za-z\s]{1,10}\)\s*", " "),
        (r"[\s*#†‡§]+$", ""),
        (r"\s+", " "),
    ]:
        s = F.regexp_replace(s, pat, to)
    s = strip(s)
    known = literal_map(ABBREVIATIONS)
    return F.coalesce(F.element_at(known, F.regexp_extract(s, _ABBREVIATION_HEAD, 1)), s)


def raw_key(c: Column) -> Column:
    return F.lower(strip(c))


def bare_name(c: Column, marks: str = "*#†", squeeze: bool = True) -> Column:
    """Match key for scoring and merging: qualifiers and footnote marks dropped."""
    s = F.lower(strip(c))
    s = F.regexp_replace(s, r"\s*\[.*?\]", "")
    s = F.regexp_replace(s, r"\s*\(.*?\)", "")
    s = F.regexp_replace(s, f"[{marks}]", "")
    return strip(F.regexp_replace(s, r"\s+", " ")) if squeeze else strip(s)


def scoring_key(c: Column) -> Column:
    return bare_name(c, marks="*#†‡")


def analyte_key(c: Column) -> Column:
    """Deduplication key: micro signs folded, qualifiers dropped, spaces kept."""
    return bare_name(F.translate(c, "µ", "μ"), marks="*#", squeeze=False)


def fold_key(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "")


def short_name(c: Column) -> Column:
    s = strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\s*\([^)]*\)", ""))
    return F.regexp_replace(strip(F.substring_index(s, ",", 1)), r"\s+", " ")


def join_with_and(items: Column) -> Column:
    """English list of the non-empty items of an array."""
    kept = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    n = F.size(kept)
    last = F.try_element_at(kept, F.lit(-1))
    head = F.array_join(F.slice(kept, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return (F.when(n == 0, "").when(n == 1, last)
            .when(n == 2, F.concat(head, F.lit(" and "), last))
            .otherwise(F.concat(head, F.lit(", and "), last)))


# ---- redaction -----------------------------------------------------------

_UNICODE = "(?U)"  # letters and digits of every script count as word characters

def redact_report_text(c: Column) -> Column:
    for pat, tag in lx.REPORT_PII:
        c = F.regexp_replace(c, _UNICODE + pat, tag)
    return c


def redact_question(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for pat, tag in lx.QUESTION_PII:
        c = F.regexp_replace(c, _UNICODE + pat, tag)
    return c
