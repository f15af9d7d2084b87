"""Keys of rows, for stages that decide row by row whatever the ids are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(docs: DataFrame) -> Column:
    """A 64-bit hash of doc_id and text, either of which may be null."""
    return F.xxhash64(docs["doc_id"], docs["text"])
