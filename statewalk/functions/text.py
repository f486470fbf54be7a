"""Token lists in text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_tokens(text: Column, sep: str | None = " ") -> Column:
    """Tokens of a text; none for an empty text; `sep=None` gives characters."""
    pattern = "" if sep is None else re.escape(sep)
    empty = F.array().cast("array<string>")
    return F.when(text == "", empty).otherwise(F.split(text, pattern, -1))


def join_tokens(tokens: Column, sep: str = " ") -> Column:
    """Joined tokens without the NULL and empty ones; NULL when none is left."""
    kept = F.filter(tokens, lambda t: t != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, sep))
