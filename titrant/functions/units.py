"""Unit expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from titrant.fixed.units import UNIT_ALIASES, UNIT_BOUNDS
from titrant.functions import text as tx


def normal_unit(unit: Column, aliases: dict[str, str] = UNIT_ALIASES) -> Column:
    """Canonical spelling: micro sign and superscripts folded, then the exact
    alias, the case-insensitive alias, or the unit as printed."""
    u = F.translate(unit, "μ²³", "µ23")
    folded = {k.lower(): v for k, v in aliases.items()}
    return F.coalesce(F.element_at(tx.literal_map(aliases.items()), u),
                      F.element_at(tx.literal_map(folded.items()), F.lower(tx.strip(u))), u)


def unit_span(unit: Column, bounds: dict = UNIT_BOUNDS) -> Column:
    """array(low, high) physically possible in a unit; null for unknown units."""
    flat = [x for k, (lo, hi) in bounds.items() for x in (F.lit(k), F.array(F.lit(float(lo)), F.lit(float(hi))))]
    return F.element_at(F.create_map(*flat), F.lower(tx.strip(unit)))


def possible_in_unit(value: Column, unit: Column, bounds: dict = UNIT_BOUNDS) -> Column:
    span = unit_span(unit, bounds)
    return F.coalesce(value.between(span[0], span[1]), F.lit(True))
