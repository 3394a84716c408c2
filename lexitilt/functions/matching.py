"""Regular-expression and string helpers with one meaning on every JVM.

``(?U)`` makes ``\\b``, ``\\s``, ``\\d`` and ``\\w`` follow Unicode, ``(?d)`` makes
``.`` stop only at a newline.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexitilt.functions import fixed_values as fv


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """True where the pattern is found; missing text counts as empty."""
    flags = "(?iUd)" if ignore_case else "(?Ud)"
    return F.coalesce(text, F.lit("")).rlike(flags + pattern)


def strip(text: Column) -> Column:
    """Surrounding Unicode whitespace off; looks at the ends only."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(fv.WS_CHARACTERS))


def normal_key(text: Column) -> Column:
    """Missing to empty, surrounding whitespace off, lower case."""
    return F.lower(strip(text))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, NULL where the key is absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)
