"""Whole-word keyword tests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from titrant.functions.text import any_of, escape


def has_any_word(c: Column, words) -> Column:
    """One alternation test for any of the words as a whole word, for texts that
    contain one at all."""
    return any_of(c, words) & c.rlike(r"(?U)\b(?:" + "|".join(escape(w) for w in words) + r")\b")


def words_found(c: Column, words) -> Column:
    """Sorted array of the words present.  The cheap alternation test gates the
    word-by-word one, which only rows with some hit pay for."""
    hits = F.array_compact(F.array(*[
        F.when(c.rlike(r"(?U)\b" + escape(w) + r"\b"), F.lit(w)) for w in sorted(words)]))
    return F.when(has_any_word(c, words), hits).otherwise(F.array().cast("array<string>"))
