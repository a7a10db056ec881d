"""Robust statistics, tests, histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def medians(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by, median) from the counts of distinct values and running sums over them: no buffer
    holds a group's values."""
    from .ordered import dealt, running

    by = list(by)
    per = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    ranked = running(dealt(per, by, ["_v"]), by, ["_v"], "_k", "_upto")
    n = per.groupBy(*by).agg(F.sum("_k").alias("_n"))
    a, b = ranked.alias("a"), F.broadcast(n).alias("b") if not by else n.alias("b")
    on = F.lit(True)
    for k in by:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    j = (a.join(b, on) if by else a.crossJoin(b)).select("a.*", "b._n")
    before = F.col("_upto") - F.col("_k")
    # the middle value, or the two in the middle
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    at = lambda i: F.max(F.when((before <= i) & (i < F.col("_upto")), F.col("_v")))
    return j.groupBy(*by).agg(((at(low) + at(high)) / 2.0).alias("median"))


def robust(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """n, mean, median, population deviation, least and greatest."""
    by = list(by)
    v = F.col(value)
    plain = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sigma"), F.min(v).alias("low"), F.max(v).alias("high")).alias("a")
    mid = medians(df, value, by).alias("b")
    on = F.lit(True)
    for k in by:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    out = plain.join(mid, on, "left")
    return out.select(*[F.col(f"a.{k}") for k in by], "n", "mean", "median", "sigma", "low", "high")


def regression(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Slope, intercept, correlation and its Fisher z."""
    out = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.count("*").alias("n"))
    return out.withColumn("z", F.atanh("r") * F.sqrt(F.col("n") - 3.0))


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of a 2x2 table of counts."""
    n = a + b + c + d
    return F.try_divide(n * (a * d - b * c) * (a * d - b * c), (a + b) * (c + d) * (a + c) * (b + d))


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """n1, n2, U of the group 1 against 0, and the area under the curve; ties count half.
    Ranks come from the counts of each distinct value and prefix sums over them."""
    per = df.where(F.col(value).isNotNull() & F.col(group).isin(0, 1)).groupBy(value).agg(F.sum((F.col(group) == 1).cast("long")).alias("k1"), F.sum((F.col(group) == 0).cast("long")).alias("k0"))
    bucketed = prefix_sum(per, value, "k0", "below")
    u = F.sum(F.col("k1") * (F.col("below") + F.col("k0") / 2.0))
    out = bucketed.agg(F.sum("k1").alias("n1"), F.sum("k0").alias("n2"), u.alias("u"))
    return out.withColumn("auc", F.try_divide(F.col("u"), F.col("n1") * F.col("n2")))


def prefix_sum(df: DataFrame, order: str, amount: str, out: str, by: list[str] = ()) -> DataFrame:
    """Running sum of `amount` before each row. Without groups the rows are dealt by range
    and each range starts from the totals of those before it, so that no task sees all."""
    if by:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(amount).over(w), F.lit(0)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, order).withColumn("_p", F.spark_partition_id())
    from .graph import _cut

    dealt = _cut(dealt)
    totals = dealt.groupBy("_p").agg(F.sum(amount).alias("_t"))
    start = totals.select("_p", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    w = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(start), "_p").withColumn(out, F.coalesce(F.sum(amount).over(w), F.lit(0)) + F.col("_s")).drop("_p", "_s")


def two_populations(df: DataFrame, value: str) -> DataFrame:
    """The cut that leaves the least variance within the two parts: cut (greatest value of
    the lower part), n_low, n_high, mean_low, mean_high. Prefix sums over distinct values."""
    v = F.col(value).cast("double")
    per = df.where(v.isNotNull()).groupBy(v.alias("x")).agg(F.count("*").alias("k"))
    per = per.withColumn("kx", F.col("k") * F.col("x"))
    a = prefix_sum(per, "x", "k", "n0").withColumn("n_low", F.col("n0") + F.col("k"))
    b = prefix_sum(a, "x", "kx", "s0").withColumn("s_low", F.col("s0") + F.col("kx"))
    n, s = b.agg(F.sum("k"), F.sum("kx")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "cut double, n_low long, n_high long, mean_low double, mean_high double")
    c = b.withColumn("n_high", F.lit(n) - F.col("n_low")).withColumn("mean_low", F.col("s_low") / F.col("n_low")).withColumn("mean_high", F.try_divide(F.lit(s) - F.col("s_low"), F.col("n_high")))
    between = F.col("n_low") * F.col("n_high") * (F.col("mean_low") - F.col("mean_high")) * (F.col("mean_low") - F.col("mean_high"))
    best = c.where("n_high > 0").select(F.col("x").alias("cut"), "n_low", "n_high", "mean_low", "mean_high", between.alias("b"))
    return best.orderBy(F.desc("b"), "cut").limit(1).drop("b")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: list[str] = ()) -> DataFrame:
    """(bin from 0, n) of equal bins; values outside are put into the first or last one."""
    width = (high - low) / bins
    k = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / width))).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*by, k.alias("bin")).agg(F.count("*").alias("n"))


def table_histograms(df: DataFrame, columns: list[str], low: float, high: float, bins: int) -> DataFrame:
    """Histograms of several numeric columns at once: (column, bin, n)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    return histogram(long, "v", low, high, bins, ["column"])


def smoothed_ratio(df: DataFrame, hits: str, total: str, bins: int = 20) -> DataFrame:
    """A histogram of ratios in which each row spreads its weight over the bins by the beta
    density of its hits and misses: (bin, weight)."""
    a, b = F.col(hits) + 1.0, F.col(total) - F.col(hits) + 1.0
    mid = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: (i + 0.5) / bins)
    logs = F.transform(mid, lambda p: (a - 1) * F.log(p) + (b - 1) * F.log(1 - p))
    top = F.array_max(logs)
    dens = F.transform(logs, lambda x: F.exp(x - top))
    sums = F.aggregate(dens, F.lit(0.0), lambda acc, x: acc + x)
    rows = df.where(F.col(total) > 0).select(F.posexplode(F.transform(dens, lambda d: d / sums)).alias("bin", "w"))
    return rows.groupBy("bin").agg(F.sum("w").alias("weight"))


def log_factorial(n: Column) -> Column:
    """Exact sums up to 30, Stirling's series beyond."""
    exact = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(30)).cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < 0, None).when(n <= 30, exact).otherwise(series)
