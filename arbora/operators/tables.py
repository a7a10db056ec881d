"""Table operations whose multiset rules differ from SQL's, and set families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(a: DataFrame, b: DataFrame):
    cond = None
    for c in a.columns:
        one = a[c].eqNullSafe(b[c])
        cond = one if cond is None else cond & one
    return cond


def table_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of a, then the rows of b that are not in a; repeats stay on both sides."""
    b = b.toDF(*a.columns)
    return a.unionByName(b.join(a, _same(b, a), "left_anti"))


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that are not in b, with their repeats."""
    b = b.toDF(*a.columns)
    return a.join(b, _same(a, b), "left_anti")


def table_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that are in b, with their repeats."""
    b = b.toDF(*a.columns)
    return a.join(b, _same(a, b), "left_semi")


def partition_sets(members: DataFrame, element: str, set_id: str) -> DataFrame:
    """A family of sets split into disjoint atoms: (signature, size, least)."""
    sig = members.groupBy(element).agg(F.array_join(F.sort_array(F.collect_set(F.col(set_id).cast("string"))), ",").alias("signature"))
    return sig.groupBy("signature").agg(F.count("*").alias("size"), F.min(element).alias("least"))


def repeated(df: DataFrame, element: str, times: int) -> DataFrame:
    """Elements that occur at least so many times."""
    return df.groupBy(element).agg(F.count("*").alias("n")).where(F.col("n") >= times)


def force_single(df: DataFrame, keys: list[str], constant: str, value: str) -> DataFrame:
    """Regroup numeric columns with one key replaced by a constant."""
    rest = [k for k in keys if k != constant]
    numbers = [c for c in df.columns if c not in keys]
    return df.groupBy(*rest).agg(*[F.sum(c).alias(c) for c in numbers]).withColumn(constant, F.lit(value))


def merge_records(df: DataFrame, keys: list[str], texts: list[str], order: str) -> DataFrame:
    """Sum numbers and keep the last text of each key."""
    numbers = [c for c in df.columns if c not in [*keys, *texts, order]]
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numbers], *[F.max_by(c, order).alias(c) for c in texts])


def pivot_records(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A row for each sample and a column for each of the given tags."""
    return df.groupBy(row).pivot(column, columns).agg(F.sum(value))


def percent_of_first(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column after the first as a per cent of the first, named `_P_column`."""
    return df.select("*", *[F.try_divide(100.0 * F.col(c), F.col(columns[0])).alias(f"_P_{c}") for c in columns[1:]])


def usage_share(df: DataFrame, whole: str, part: str) -> DataFrame:
    """(whole, part, n, usage): rows of each pair and their share of the whole, in per cent."""
    g = df.groupBy(whole, part).agg(F.count("*").alias("n"))
    total = g.groupBy(whole).agg(F.sum("n").alias("_t"))
    return g.join(total, whole).select(whole, part, "n", (100.0 * F.col("n") / F.col("_t")).alias("usage"))


def ratio_to_controls(df: DataFrame, key: str, value: str, control: Column) -> DataFrame:
    """df with `ratio`: each value over the median of the control rows of its key."""
    from .statistics import medians

    mid = medians(df.where(control), value, [key]).withColumnRenamed("median", "_m")
    return df.join(mid, key).withColumn("ratio", F.try_divide(F.col(value), F.col("_m"))).drop("_m")
