"""Edits of classes as new DataFrames: kill, rename, fuse, name, shift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kill(rows: DataFrame, key: str, victims: DataFrame, references: dict[str, str] | None = None) -> DataFrame:
    """Rows without the victims (first column); columns that refer to them become null."""
    v = victims.select(F.col(victims.columns[0]).alias("_v")).distinct()
    out = rows.join(v, rows[key] == v["_v"], "left_anti")
    for column in references or {}:
        gone = v.withColumnRenamed("_v", f"_{column}")
        out = out.join(gone, out[column] == gone[f"_{column}"], "left").withColumn(column, F.when(F.col(f"_{column}").isNull(), F.col(column))).drop(f"_{column}")
    return out


def kill_edges(edges: DataFrame, victims: DataFrame) -> DataFrame:
    v = victims.select(F.col(victims.columns[0]).alias("_v")).distinct()
    return edges.join(v, edges["src"] == v["_v"], "left_anti").join(v, F.col("dst") == v["_v"], "left_anti")


def rename(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Replace names by a map (old, new), wherever they stand in a column."""
    m = names.select(F.col(names.columns[0]).alias("_old"), F.col(names.columns[1]).alias("_new"))
    return rows.join(m, rows[column] == m["_old"], "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def fuse(rows: DataFrame, key: str, names: DataFrame, order: str) -> DataFrame:
    """Rename, then one row for each name: arrays are joined without repeats, of other
    columns the last value that is not null stays."""
    renamed = rename(rows, key, names)
    aggs = []
    for f in renamed.schema.fields:
        if f.name != key:
            many = f.dataType.typeName() == "array"
            aggs.append((F.array_distinct(F.flatten(F.collect_list(f.name))) if many else F.max_by(f.name, F.when(F.col(f.name).isNotNull(), F.col(order)))).alias(f.name))
    return renamed.groupBy(key).agg(*aggs)


def new_names(rows: DataFrame, pattern: str, taken: DataFrame, column: str, order: list[str]) -> DataFrame:
    """A fresh name for each row from a pattern such as `ya%dx.y`, counted on from the
    greatest number in use."""
    from .statistics import prefix_sum

    head, _, tail = pattern.partition("%d")
    digits = F.regexp_extract(F.col(taken.columns[0]), rf"^{head}(\d+){tail.replace('.', chr(92) + '.')}$", 1).try_cast("long")
    start = taken.agg(F.coalesce(F.max(digits), F.lit(0))).first()[0]
    numbered = prefix_sum(rows.withColumn("_one", F.lit(1)).withColumn("_o", F.struct(*order)), "_o", "_one", "_k")
    return numbered.withColumn(column, F.concat(F.lit(head), (F.col("_k") + 1 + start).cast("string"), F.lit(tail))).drop("_one", "_o", "_k")


def shift(rows: DataFrame, columns: list[str], after, by: int) -> DataFrame:
    """Move coordinates that lie beyond a position."""
    return rows.withColumns({c: F.when(F.col(c) > after, F.col(c) + by).otherwise(F.col(c)) for c in columns})
