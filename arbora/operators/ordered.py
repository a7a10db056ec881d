"""Neighbours and running sums in order within keys, without a task that holds a whole key.

Rows are dealt by ranges of (keys, order), so a key of very many rows is spread over as many
tasks as its rows fill. Each task works on its own range; what crosses the borders is one
row for each task (neighbours) or one total for each key and task (running sums)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import _cut


def dealt(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df in ranges of (by, order), the range as column _p."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _cut(df.repartitionByRange(n, *by, *order).withColumn("_p", F.spark_partition_id()))


def _same(by: list[str], other: Column) -> Column:
    out = F.lit(True)
    for k in by:
        out = out & F.col(k).eqNullSafe(other[k])
    return out


def neighbour(df: DataFrame, by: list[str], order: list[str], columns: dict[str, str], ahead: bool) -> DataFrame:
    """df (from dealt) with columns of the row before (or after) in its key: {column: name}."""
    row = F.struct(*by, *columns)
    w = Window.partitionBy("_p").orderBy(*by, *order)
    pick = F.min_by if ahead else F.max_by
    edge = df.groupBy("_p").agg(pick(row, F.struct(*by, *order)).alias("_e"))  # one row a task
    over = Window.orderBy("_p")
    edge = edge.select("_p", (F.lead("_e") if ahead else F.lag("_e")).over(over).alias("_e"))
    near = (F.lead(row) if ahead else F.lag(row)).over(w)
    out = df.withColumn("_n", near).join(F.broadcast(edge), "_p", "left").withColumn("_n", F.coalesce("_n", "_e"))
    same = F.col("_n").isNotNull() & _same(by, F.col("_n"))
    return out.select(*df.columns, *[F.when(same, F.col("_n")[c]).alias(name) for c, name in columns.items()])


def running(df: DataFrame, by: list[str], order: list[str], amount: str, out: str) -> DataFrame:
    """df (from dealt) with the sum of `amount` over the rows of its key up to this one."""
    w = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    per = df.groupBy(*by, "_p").agg(F.sum(amount).alias("_t"))
    over = (Window.partitionBy(*by) if by else Window).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = per.select(*by, "_p", F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_s"))
    a, b = df.withColumn(out, F.sum(amount).over(w)).alias("a"), start.alias("b")
    on = F.col("a._p") == F.col("b._p")
    for k in by:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, on).select(*[F.col(f"a.{c}") for c in df.columns], (F.col(f"a.{out}") + F.col("b._s")).alias(out))
