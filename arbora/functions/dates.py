"""Dates of explicit precision, as canonical text.

A date is written `2016`, `2016-02`, `2016-02-07`, then `_hh`, `:mm`, `:ss`, every part
zero-padded. On canonical texts plain string order is the strict order (a missing part
sorts before all values of it, and a missing hour differs from midnight), and comparing
both texts cut to the shorter one is the loose order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = re.compile(r"^\s*(\d{4})(?:[-/.](\d{1,2})(?:[-/.](\d{1,2})(?:[_ T](\d{1,2})(?::(\d{1,2})(?::(\d{1,2}))?)?)?)?)?\s*$")
_COMPACT = re.compile(r"^\s*(\d{4})(\d{2})(\d{2})\s*$")
FIRST_YEAR, LAST_YEAR = 1900, 2053
#: Length of the canonical text at each precision.
LENGTH = {"y": 4, "m": 7, "d": 10, "h": 13, "n": 16, "s": 19}


def canonical(text: str) -> str:
    """The canonical text; ValueError where it is no date."""
    m = _PARTS.match(text) or _COMPACT.match(text)
    if not m:
        raise ValueError(f"not a date: {text!r}")
    y, *rest = [int(x) for x in m.groups() if x is not None]
    limits = ((1, 12), (1, 31), (0, 24), (0, 60), (0, 60))
    if not FIRST_YEAR <= y <= LAST_YEAR or any(not lo <= x <= hi for x, (lo, hi) in zip(rest, limits)):
        raise ValueError(f"not a date: {text!r}")
    return f"{y:04d}" + "".join(sep + f"{x:02d}" for sep, x in zip("--_::", rest))


def start_of(text: str) -> str:
    """The first instant of a canonical date, as a timestamp text."""
    full = text + "0000-01-01_00:00:00"[len(text) :]
    return full.replace("_", " ")


def of_timestamp(col: Column) -> Column:
    """A timestamp as a canonical date of full precision."""
    return F.date_format(col, "yyyy-MM-dd'_'HH:mm:ss")


def loose(a: Column, b: Column) -> tuple[Column, Column]:
    """Both dates cut to the lower precision."""
    n = F.least(F.length(a), F.length(b))
    return a.substr(F.lit(1), n), b.substr(F.lit(1), n)


def _stamp(col: Column, unit: str) -> Column:
    """The timestamp of a date truncated at a unit; null if the date lacks it."""
    n = LENGTH[unit]
    cut = F.replace(col.substr(1, n), F.lit("_"), F.lit(" "))
    pad = "0000-01-01 00:00:00"[n:]
    return F.when(F.length(col) >= n, F.to_timestamp_ntz(F.concat(cut, F.lit(pad)), F.lit("yyyy-MM-dd HH:mm:ss")))


def datediff(unit: str, a: Column, b: Column) -> Column:
    """b - a in whole units, lower parts cut first; null if either lacks the precision."""
    name = {"y": "YEAR", "m": "MONTH", "d": "DAY", "w": "WEEK", "h": "HOUR", "n": "MINUTE", "s": "SECOND"}[unit[0].lower() if unit.lower() not in ("minute", "minutes", "min") else "n"]
    key = "d" if name == "WEEK" else {v: k for k, v in {"y": "YEAR", "m": "MONTH", "d": "DAY", "h": "HOUR", "n": "MINUTE", "s": "SECOND"}.items()}[name]
    return F.timestamp_diff(name, _stamp(a, key), _stamp(b, key))
