"""Natural order of names: text without case, runs of digits by value, and on equality the
run with more leading zeros first (Bond007 < Bond07 < Bond7 < Bond68)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(col: Column, fold: bool = True) -> Column:
    """A sortable array: each run of digits as its length and value, other runs as they
    are, then the leading zeros."""
    text = col.cast("string")
    text = F.lower(text) if fold else text
    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def key(run: Column) -> Column:
        bare = F.regexp_replace(run, r"^0+(?=[0-9])", "")
        return F.when(run.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(bare).cast("string"), 4, "0"), bare)).otherwise(run)

    zeros = F.lpad((F.lit(9999) - F.length(text)).cast("string"), 4, "0")
    # the end mark sorts before every run, so that a prefix comes first
    return F.when(col.isNotNull(), F.concat(F.transform(runs, key), F.array(F.lit(""), zeros)))


def natural_less(a: Column, b: Column) -> Column:
    return natural_key(a) < natural_key(b)


def order_columns(col: Column, kind: str, desc: bool = False, nulls_first: bool = False) -> Column:
    """An ordering of a column: natural for texts, by value for others. The default has
    null last, and first where the order is turned round."""
    key = natural_key(col) if kind == "string" else col
    if desc:
        return key.desc_nulls_last() if nulls_first else key.desc_nulls_first()
    return key.asc_nulls_first() if nulls_first else key.asc_nulls_last()
