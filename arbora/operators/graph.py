"""Graphs over edge tables (src, dst): closure, neighbours, roll-up, components."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder; a folder of this machine is taken
    only where all runs on it, as in tests."""
    sc = df.sparkSession.sparkContext
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not base and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="arbora-"))
    return df.checkpoint()


def closure(edges: DataFrame, starts: DataFrame, seeded: bool = False, every: int = 4, hops: int = 3) -> DataFrame:
    """(start, node): all nodes reached from each start by one or more edges, or (seeded)
    also the start. Rounds expand only the frontier and end when nothing is new, so that
    cycles end too; a start that is reached again is not its own result."""
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    seen = _cut(starts.select(F.col(starts.columns[0]).alias("start")).distinct().withColumn("node", F.col("start")))
    frontier, k = seen, 0
    while True:
        step, fresh = frontier, None
        for _ in range(hops):  # some edges further in one round: fewer rounds, each cut once
            step = step.join(edges, step["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
            fresh = step if fresh is None else fresh.union(step)
        fresh = _cut(fresh.distinct().join(seen, ["start", "node"], "left_anti"))
        if fresh.isEmpty():
            break
        seen, frontier, k = seen.union(fresh), fresh, k + 1
        if k % every == 0:
            seen = _cut(seen)
    return seen if seeded else seen.where("node <> start")


def neighbours(edges: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Distinct objects that a set refers to by any tag."""
    k = keys.select(F.col(key).alias("src")).distinct()
    return edges.join(k, "src", "left_semi").select(F.col("dst").alias(key)).where(F.col(key).isNotNull()).distinct()


def roll_up(edges: DataFrame, amounts: DataFrame, node: str, amount: str) -> DataFrame:
    """(node, total): every node's amounts with those of all nodes below it. edges: (src,
    dst) from child to parent."""
    above = closure(edges, amounts.select(node).distinct(), seeded=True)
    per = amounts.groupBy(F.col(node).alias("start")).agg(F.sum(amount).alias("_a"))
    return above.join(per, "start").groupBy("node").agg(F.sum("_a").alias("total"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each undirected component, by taking the
    minimum of the neighbours' labels and then of the label's label, until all agree."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("src is not null and dst is not null")
    both = _cut(both.union(both.select("b", "a")).distinct())
    label = _cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).select(F.col("a").alias("node"), "c"))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
        step = label.join(near, label["node"] == near["a"], "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"))
        jump = step.join(step.select(F.col("node").alias("c"), F.col("c").alias("cc")), "c", "left").select("node", F.least("c", F.coalesce("cc", "c")).alias("c"))
        nxt = _cut(jump)
        moved = nxt.join(label.withColumnRenamed("c", "old"), "node").where("c <> old")
        label = nxt
        if moved.isEmpty():
            return label.withColumnRenamed("c", "component")
