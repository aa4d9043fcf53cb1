"""A key for each row of documents, for operators that may not take an id for a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_key(id_col: str, text_col: str) -> Column:
    """64-bit hash of id and text, never null: rows share it only if both agree, and ids that are null do agree."""
    return F.xxhash64(F.col(id_col), F.col(text_col))
