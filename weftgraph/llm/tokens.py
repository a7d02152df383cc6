"""Sizes in tokens of the public word-and-punctuation split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters and digits, or any single other character that is not white space.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\p{IsWhite_Space}]"


def token_count(text: Column) -> Column:
    """Tokens of a text; 0 for null and blank ones."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))
