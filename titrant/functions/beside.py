"""Steps of many projections over wide rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def beside(rows: DataFrame, reads: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step(rows), with the columns that it does not read packed into one struct.

    Every projection of a step copies its rows; a struct is copied in one
    piece, single columns one by one.  `reads` names all columns that the step
    reads or replaces.  The other columns keep their place before the new ones.
    """
    own = [c for c in rows.columns if c in reads.split()]
    rest = [c for c in rows.columns if c not in own]
    if not rest:
        return step(rows)
    made = step(rows.select(*own, F.struct(*rest).alias("_beside")))
    before = [F.col("_beside").getField(c).alias(c) if c in rest else c for c in rows.columns if c in rest or c in made.columns]
    return made.select(*before, *[c for c in made.columns if c not in own and c != "_beside"])
