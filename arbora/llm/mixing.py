"""Mixing sources to target weights by entropy balancing.

Of all document rates with the wanted number of words in every source, those nearest to
one copy each in relative entropy are exponential tilts r = min(2, exp(lambda * size)) with
one multiplier a source. The convex dual separates by source and depends on a source's
documents only through the counts of its sizes, so documents are reduced to counts of
(source, size) and distributed Newton iterations (guarded by bisection) run for all sources
at once, each one aggregation of the counts. Rates become whole copies by carrying the
rounding error from the longest documents to the shortest, so that a source's words end
within one short document of its target; documents of one source and size share the copies
of their size in the order of a hash of the row.

Defined results: null texts have no words; a null source is a source of its own, last in
order; empty tables give empty results; repeated rows count one by one, and where only some
of them get a copy more, equal rows are told apart by nothing; very long texts are counted
whole; reruns agree; extra columns are ignored by `mix` and kept by `apply_mix`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, numbered, settle

#: Weights of the sources in order, repeating; words wanted and most copies of a document,
#: as multiples of what there is.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
_FEW = 200_000  # rows of a broadcast table, of some fifty bytes each


def global_rank(df: DataFrame, *order) -> DataFrame:
    """df with `rank` (long, from 0) in the given total order, without a single-task
    window: a range sort, then the row counts of its partitions as offsets."""
    placed = settle(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    spark = df.sparkSession
    start, offsets = 0, []
    for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").toLocalIterator():
        offsets.append((r["p"], start))  # one entry for each task of the sort
        start += r["n"]
    marks = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "p long, off long"))
    return placed.join(marks, part == marks["p"]).withColumn("rank", F.col("off") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("p", "off", "__at")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, size) rows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(per, F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = settle(ranked.withColumn("w", w).withColumn("cap", most * F.col("source_size")))
    total, all_w = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    budget = share * (total or 0)
    level = budget / all_w if all_w else 0.0
    while True:  # excess of the capped sources goes to the others by weight
        capped, rest = ranked.agg(F.sum(F.when(F.col("cap") < level * F.col("w"), F.col("cap"))), F.sum(F.when(F.col("cap") >= level * F.col("w"), F.col("w")))).first()
        nxt = (budget - (capped or 0.0)) / rest if rest else level
        if nxt <= level * (1 + 1e-15):
            break
        level = nxt
    return ranked.select("source", "source_size", F.least(F.col("cap"), level * F.col("w")).alias("target"))


def tilted(hist: DataFrame, most: float = MOST) -> DataFrame:
    """hist (source, size, n, source_size, target) with `rate` = min(most, exp(lambda x)), x
    the size over the source's mean, so that sum(n * size * rate) is the source's target.

    Newton's iterations on the dual, guarded by bisection: each evaluates all sources by one
    distributed aggregation of the counts; the multipliers are a table by source."""
    words = F.col("n") * F.col("size")
    scale = hist.groupBy("source").agg((F.sum(words * F.col("size")) / F.sum(words)).alias("mean"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"), F.first("source_size").alias("total"), F.first("target").alias("want"))
    free = (F.col("total") > 0) & (F.col("want") > 0) & (F.col("want") < most * F.col("total"))
    rise = F.log(F.col("want") / F.col("total"))
    low = F.col("least") / F.col("mean")
    # all rates are below target / total at lo, and at most at hi
    state = scale.where(free).select("source", "mean", "want", F.least(rise, F.lit(0.0)).alias("lam"), (F.least(rise, F.lit(0.0)) / low - 1e-9).alias("lo"), (math.log(most) / low).alias("hi"), F.lit(1.0).alias("miss"))
    state = settle(state)
    x = F.col("size") / F.col("mean")
    rate = F.least(F.lit(most), F.exp(F.least(F.col("lam") * x, F.lit(50.0))))
    for turn in range(1, 201):
        h, t = hist.select("source", "size", "n").alias("h"), state.drop("miss").alias("t")
        at = h.join(t, F.col("h.source").eqNullSafe(F.col("t.source"))).select("t.*", "h.size", "h.n")
        now = at.groupBy("source", "mean", "want", "lam", "lo", "hi").agg(F.sum(words * rate).alias("got"), F.sum(words * x * F.when(rate < most, rate).otherwise(0.0)).alias("slope"))
        gap = F.col("got") - F.col("want")
        now = now.withColumn("miss", F.abs(gap) / F.col("want")).withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap < 0, F.col("hi")).otherwise(F.col("lam")))
        step = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        step = F.when((step > F.col("lo")) & (step < F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2)
        now = now.select("source", "mean", "want", F.when(F.col("miss") <= 1e-10, F.col("lam")).otherwise(step).alias("lam"), "lo", "hi", "miss")
        old, state = state, settle(now) if turn % 3 == 0 else now
        if turn % 3 == 0:
            open_ = (F.col("miss") > 1e-9) & (F.col("hi") - F.col("lo") > 1e-14 * F.abs("hi"))
            if state.where(open_).isEmpty():
                break
    h, t = hist.alias("h"), state.select("source", "mean", "lam").alias("t")
    out = h.join(t, F.col("h.source").eqNullSafe(F.col("t.source")), "left").select("h.*", "mean", "lam")
    fixed = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.lit(most)).otherwise(0.0)
    return out.withColumn("rate", F.when(F.col("lam").isNull(), fixed).otherwise(rate)).drop("mean", "lam")


def copies(size: np.ndarray, n: np.ndarray, rate: np.ndarray, most: float = MOST) -> np.ndarray:
    """Whole copies of each size, the rounding error carried from long to short."""
    out, debt = np.zeros(len(size), np.int64), 0.0
    for i in np.argsort(-size, kind="stable"):
        if size[i] > 0:
            k = int(min(max(np.floor(rate[i] * n[i] + debt / size[i] + 0.5), 0), most * n[i]))
            debt += (rate[i] * n[i] - k) * size[i]
            out[i] = k
    return out


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", kind="stable")
    return pdf.assign(k=copies(pdf["size"].to_numpy(), pdf["n"].to_numpy(), pdf["rate"].to_numpy()))[["source", "size", "n", "source_size", "target", "rate", "k"]]


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.size") == F.col(f"{b}.size"))


def _cuts(narrow: DataFrame) -> DataFrame:
    """For each source and size of a settled table of rows (source, size, h): source_size, target, rate, every
    row's `base` copies, and which rows get one more: those of h below `cut`, and `take` of
    the `of` rows at it."""
    part = F.shiftright("h", 52).alias("part")  # 4096 ranges of the hash, in order
    per_part = settle(narrow.groupBy("source", "size", part).agg(F.count("*").alias("m")))
    hist = settle(per_part.groupBy("source", "size").agg(F.sum("m").alias("n")))
    t = source_targets(hist.select("source", (F.col("size") * F.col("n")).alias("size"))).alias("t")
    given = settle(hist.alias("h").join(t, F.col("h.source").eqNullSafe(F.col("t.source"))).select("h.source", "h.size", "h.n", "t.source_size", "t.target"))
    kind = "source string, size long, n long, source_size long, target double, rate double, k long"
    # a source has no more sizes than its longest document has words
    solved = tilted(given).groupBy("source").applyInPandas(_round, kind)
    solved = settle(solved.withColumn("base", F.floor(F.col("k") / F.greatest("n", F.lit(1)))).withColumn("more", F.col("k") - F.col("base") * F.col("n")))
    a, b = per_part.alias("a"), solved.where("more > 0").alias("b")
    within = a.join(b, _same("a", "b")).selectExpr("a.source", "a.size", "a.part", "a.m", "b.more", "sum(a.m) over (partition by a.source, a.size order by a.part) - a.m as before")
    within = within.where("before < more and more <= before + m").select("source", "size", "part", (F.col("more") - F.col("before")).alias("left"))
    c, d = narrow.select("*", part).alias("c"), within.alias("d")
    near = c.join(d, _same("c", "d") & (F.col("c.part") == F.col("d.part"))).groupBy("c.source", "c.size", "d.left", "c.h").agg(F.count("*").alias("of"))
    near = near.selectExpr("source", "size", "left", "h as cut", "of", "sum(of) over (partition by source, size order by h) - of as before")
    near = near.where("before < left and left <= before + of").select("source", "size", "cut", (F.col("left") - F.col("before")).alias("take"), "of")
    e, f = solved.alias("e"), near.alias("f")
    out = e.join(f, _same("e", "f"), "left").select("e.source", "e.size", "e.source_size", "e.target", "e.rate", "e.base", "f.cut", "f.take", "f.of")
    return settle(out)


def _with_copies(rows: DataFrame, cuts: DataFrame, keep: list[Column]) -> DataFrame:
    """`keep` and `copies` of every row of rows (source, size, h and others). The cuts are
    one row for each source and size; they are broadcast if they are few, and joined else."""
    few = cuts.count() <= _FEW
    joined = rows.alias("r").join(F.broadcast(cuts).alias("p") if few else cuts.alias("p"), _same("r", "p"))
    at = F.coalesce(F.col("r.h") == F.col("p.cut"), F.lit(False))
    tied = at & (F.col("p.take") < F.col("p.of"))
    sure = (F.col("p.base") + F.coalesce((F.col("r.h") < F.col("p.cut")) | at, F.lit(False)).cast("long")).alias("copies")
    if cuts.where("take < of").isEmpty():
        return joined.select(*keep, sure)
    # equal rows of which only some get a copy more
    names = joined.select(*keep).columns
    cols = [f"c{i}" for i in range(len(keep))]
    more = joined.where(tied).select(*[k.alias(c) for k, c in zip(keep, cols)], "p.source", "p.size", "p.base", "p.take")
    more = numbered(more, ["source", "size"])
    more = more.select(*[F.col(c).alias(n) for c, n in zip(cols, names)], (F.col("base") + (F.col("rn") <= F.col("take")).cast("long")).alias("copies"))
    return joined.where(~tied).select(*keep, sure).unionByName(more)


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken for every row of docs."""
    rows = settle(docs.select("doc_id", F.col("source").cast("string").alias("source"), _size(), F.xxhash64("doc_id", "text").alias("h")))
    out = _with_copies(rows, _cuts(rows.drop("doc_id")), [F.col(f"r.{c}") for c in ("doc_id", "size")] + [F.col(f"p.{c}") for c in ("source_size", "target", "rate")])
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """docs with every row repeated by its copies (rows without words once each: they cost
    no words). The texts are not shuffled: a row's copies follow from its source, its size and
    a hash of all its columns."""
    own = [F.col("source").cast("string").alias("source"), _size(), F.xxhash64(*docs.columns).alias("h")]
    cuts = _cuts(settle(docs.select(*own)))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), *own)
    out = _with_copies(rows, cuts, [F.col("r.__row").alias("__row"), F.col("r.size").alias("__size")])
    times = F.when(F.col("__size") == 0, F.lit(1)).otherwise(F.col("copies"))
    return out.where(times > 0).select("__row.*", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("__c")).select(*docs.columns)
