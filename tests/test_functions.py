import datetime
import functools
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arbora.functions import dates, dna
from arbora.functions.natural import natural_key

NAME = st.text(alphabet="aB019", min_size=0, max_size=6)


def natural_compare(a, b):
    """Plain natural order: runs of digits by value, texts without case, then more zeros."""
    runs = lambda s: re.findall(r"[0-9]+|[^0-9]+", s.lower())
    for x, y in zip(runs(a), runs(b)):
        if x[0].isdigit() and y[0].isdigit():
            if int(x) != int(y):
                return -1 if int(x) < int(y) else 1
        elif x != y:
            return -1 if ("0" if x[0].isdigit() else x) < ("0" if y[0].isdigit() else y) else 1
    n = len(runs(a)) - len(runs(b))
    return n if n else len(b) - len(a)


@settings(max_examples=5, deadline=None)
@given(st.lists(NAME, min_size=30, max_size=30))
def test_natural_order(spark, names):
    names = sorted(set(names))
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n"))).collect()]
    for x, y in zip(got, got[1:]):
        assert natural_compare(x, y) <= 0, (x, y)
    assert functools.reduce(lambda a, b: a + b, [1 for _ in got], 0) == len(names)


def test_known_natural_order(spark):
    got = [r[0] for r in spark.createDataFrame([(n,) for n in ("Bond68", "bond7", "Bond007", "BOND07", "Bon", None)], "n string").orderBy(natural_key(F.col("n")).asc_nulls_last()).collect()]
    assert got == ["Bon", "Bond007", "BOND07", "bond7", "Bond68", None]


def test_dates():
    assert dates.canonical("20160321") == "2016-03-21" and dates.canonical("2016-1-7_3:7") == "2016-01-07_03:07"
    assert dates.start_of("2016-02") == "2016-02-01 00:00:00"
    assert "2016" < "2016-02" < "2016-02-01" < "2016-02-01_00"
    for bad in ("2016-13", "1800", "abc", "2016-02-40"):
        try:
            dates.canonical(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_datediff(spark):
    row = spark.range(1).select(
        dates.datediff("d", F.lit("2016-02-28"), F.lit("2016-03-01")).alias("d"),
        dates.datediff("m", F.lit("2015-12-31"), F.lit("2016-01")).alias("m"),
        dates.datediff("h", F.lit("2016-01-01"), F.lit("2016-01-02")).alias("h"),
    ).first()
    assert (row["d"], row["m"], row["h"]) == (2, 1, None)
    assert datetime.date(2016, 3, 1) - datetime.date(2016, 2, 28) == datetime.timedelta(2)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="acgtn", max_size=20), min_size=10, max_size=10))
def test_reverse_complement_twice(spark, seqs):
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    for r in df.select("s", dna.reverse_complement(dna.reverse_complement(F.col("s"))).alias("b")).collect():
        assert r["s"] == r["b"]


def test_sequences(spark):
    r = spark.range(1).select(
        dna.translate(F.lit("atggcctaa")).alias("p"), dna.translate(F.lit("ttc t")).alias("x"), dna.fragment(F.lit("acgtt"), F.lit(4), F.lit(99)).alias("f"),
        dna.gc_percent(F.lit("ggcat")).alias("gc"), dna.melting_point(F.lit("acgt")).alias("tm"), F.round(dna.peptide_weight(F.lit("GG")), 2).alias("w"), dna.entropy(F.lit("acacac")).alias("h"),
    ).first()
    assert (r["p"], r["x"], r["f"], r["gc"], r["tm"], r["w"]) == ("MA*", "FX", "tt", 60.0, 12.0, 132.12)
    assert 0.9 < r["h"] < 1
