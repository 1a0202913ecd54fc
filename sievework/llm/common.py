"""Column helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_key(name: str | Column) -> Column:
    """A label trimmed (any white space) and lower-cased."""
    c = F.col(name) if isinstance(name, str) else name
    return F.lower(F.regexp_replace(c, r"^[\s\u00a0\u3000]+|[\s\u00a0\u3000]+$", ""))


def base_language(name: str | Column) -> Column:
    """en-US, EN_gb and en become en."""
    return F.regexp_extract(clean_key(name), r"^([a-z]+)", 1)
