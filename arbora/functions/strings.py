"""Text and number helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def wildcard_at(text: Column, pattern: str) -> Column:
    """1 + the place where a pattern with * and ? fits first, without case; 0 if nowhere."""
    inner = pattern.strip("*")
    regex = "(?is)" + "".join(".*?" if c == "*" else "." if c == "?" else re.escape(c) for c in inner)
    found = F.regexp_substr(text, F.lit(regex))
    whole = F.regexp_extract(text, "(?is)^(.*?)" + regex[len("(?is)"):], 1)
    at = F.when(found.isNull(), 0).otherwise(F.length(whole) + 1)
    if not pattern.startswith("*"):
        at = F.when(text.rlike("(?is)^" + regex[len("(?is)"):]), 1).otherwise(0)
    if not pattern.endswith("*"):
        at = F.when(text.rlike(regex + "$"), at).otherwise(0)
    return F.when(text.isNotNull(), at)


def regex_at(text: Column, pattern: str) -> Column:
    """1 + the place of the first match of a regular expression, without case; 0 if none."""
    return F.when(~text.rlike("(?i)" + pattern), 0).otherwise(F.length(F.regexp_extract(text, f"(?is)^(.*?)(?:{pattern})", 1)) + 1)


def quote(text: Column) -> Column:
    """In double quotes, with quotes and backslashes protected by a backslash."""
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\\\])', r"\\$1"), F.lit('"'))


def unquote(text: Column) -> Column:
    """Without surrounding quotes and protecting backslashes."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), '^"', ""), '(?<!\\\\)"$', "")
    return F.regexp_replace(bare, r"\\(.)", "$1")


def strict_int(text: Column) -> Column:
    """The whole number that a text is, to the last character; else null."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))


def strict_double(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def leading_digit(x: Column) -> Column:
    """Rounded to its first digit: 0.0234 to 0.02, 987 to 1000."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x / power) * power)


def round_up(x: Column) -> Column:
    """The least of 1, 2, 5 times a power of ten that is no less than x > 0."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    part = x / power
    return F.when(x <= 0, None).otherwise(F.when(part <= 1, 1.0).when(part <= 2, 2.0).when(part <= 5, 5.0).otherwise(10.0) * power)


def to_byte(x: Column, unit: float = 1.0) -> Column:
    """A count as one byte, exact up to 16 and by sixteenths of octaves beyond."""
    v = x / unit
    coarse = F.round(16 + 16 * (F.log2(F.greatest(v, F.lit(1.0))) - 4))
    return F.when(v <= 16, F.round(v)).otherwise(F.least(coarse, F.lit(255.0))).cast("int")


def from_byte(b: Column, unit: float = 1.0) -> Column:
    return F.when(b <= 16, b * F.lit(unit)).otherwise(F.pow(F.lit(2.0), (b - 16) / 16.0 + 4) * unit)
