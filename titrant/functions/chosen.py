"""Choice of rows by columns that long chains of projections decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def chosen(rows: DataFrame, condition: Column | str, *columns) -> DataFrame:
    """The columns of the rows for which the condition holds.

    The optimizer moves a filter below the projections of a chain and writes
    their expressions out for each mention of a column: the plan of a filter on
    a late column outgrows the driver.  What a generator gives is decided where it stands.
    """
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return rows.select(F.inline(F.when(condition, F.array(F.struct(*columns)))))
