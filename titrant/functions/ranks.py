"""Ordinal domains as integer ranks, and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEVERITY = ["normal", "mild", "moderate", "critical"]
STATUS = ["green", "yellow", "orange", "red"]
CONFIDENCE = ["low", "medium", "high"]


def rank(c: Column, domain: list[str], default: int = 0) -> Column:
    """Position of the value in its domain."""
    expr = F.when(c == domain[0], 0)
    for i, name in enumerate(domain[1:], 1):
        expr = expr.when(c == name, i)
    return expr.otherwise(default)


def label(c: Column, domain: list[str]) -> Column:
    expr = F.when(c <= 0, domain[0])
    for i, name in enumerate(domain[1:], 1):
        expr = expr.when(c == i, name)
    return expr


def severity_rank(c: Column) -> Column:
    return rank(c, SEVERITY)


def confidence_rank(c: Column) -> Column:
    return rank(c, CONFIDENCE, default=0)
