"""Scalar rules for symbols, text and calendars."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class SymbolError(ValueError):
    """A symbol that no exchange rule reads."""


def canonical_symbol(raw: Column) -> Column:
    """SH600519 of six digits with or without an exchange before or behind; null where no rule fits."""
    number = F.regexp_extract(F.upper(F.trim(raw)), r"([0-9]{6})", 1)
    first = F.substring(number, 1, 1)
    return F.when(first.isin("6", "9"), F.concat(F.lit("SH"), number)).when(first.isin("0", "2", "3"), F.concat(F.lit("SZ"), number))


def canonical_symbol_of(raw: str) -> str:
    """The same for one string; raises SymbolError, and also where a named exchange contradicts the digits."""
    m = re.fullmatch(r"(?:(SH|SZ)\.?)?([0-9]{6})(?:\.?(SH|SZ|SS|CH|CG|CS))?", raw.strip().upper())
    if not m or m[2][0] not in "69023":
        raise SymbolError(raw)
    exchange = "SH" if m[2][0] in "69" else "SZ"
    named = {"SS": "SH", "CG": "SH", "CS": "SZ", "CH": exchange}.get(m[3] or "", m[3]) or m[1]
    if named and named != exchange:
        raise SymbolError(raw)
    return exchange + m[2]
