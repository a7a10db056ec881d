"""Coverage tracks, peaks, smoothing and intervals. A track has (target, x, y)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import dealt, neighbour, running


def depth(hits: DataFrame, target: str, start: str, end: str, weight=None) -> DataFrame:
    """(target, x1, x2, y): stretches of equal depth of [start, end] intervals."""
    w = F.lit(1).cast("double") if weight is None else F.col(weight).cast("double")
    marks = hits.select(F.col(target).alias("target"), F.explode(F.array(F.struct(F.col(start).alias("x"), w.alias("d")), F.struct((F.col(end) + 1).alias("x"), (-w).alias("d")))).alias("m"))
    steps = marks.groupBy("target", F.col("m.x").alias("x")).agg(F.sum("m.d").alias("d"))
    steps = running(dealt(steps, ["target"], ["x"]), ["target"], ["x"], "d", "y")
    runs = neighbour(steps, ["target"], ["x"], {"x": "after"}, ahead=True)
    return runs.select("target", F.col("x").alias("x1"), (F.col("after") - 1).alias("x2"), "y").where("x2 >= x1 and y > 0")


def _islands(rows: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Rows with a number `island`: a new one where x is over `gap` beyond the row before."""
    rows = neighbour(dealt(rows, by, ["x"]), by, ["x"], {"x": "before"}, ahead=False)
    rows = rows.withColumn("new", F.coalesce((F.col("x") - F.col("before") > gap).cast("int"), F.lit(1)))
    return running(rows, by, ["x"], "new", "island")


def peaks(track: DataFrame, least: float, gap: int = 50, area: float = 1.5, width: int = 1) -> DataFrame:
    """Islands of y >= least, bridged over gaps of up to `gap`: target, start, end, high,
    mean, total, of a total of at least area * width * least."""
    island = _islands(track.where(F.col("y") >= least), ["target"], gap)
    out = island.groupBy("target", "island").agg(F.min("x").alias("start"), F.max("x").alias("end"), F.max("y").alias("high"), F.avg("y").alias("mean"), F.sum("y").alias("total"))
    return out.where(F.col("total") >= area * width * least).drop("island")


def plateaus(track: DataFrame, levels: list[float], gap: int = 1) -> DataFrame:
    """Islands at each of several levels: level, target, start, end, high."""
    rows = track.select("*", F.explode(F.array(*[F.lit(float(v)) for v in levels])).alias("level")).where("y >= level")
    rows = _islands(rows, ["level", "target"], gap)
    return rows.groupBy("level", "target", "island").agg(F.min("x").alias("start"), F.max("x").alias("end"), F.max("y").alias("high")).drop("island")


def gaussian(sigma: float) -> list[tuple[int, float]]:
    """Offsets and weights of the kernel, cut at 1e-6 and normalised."""
    s = max(1.0, sigma)
    half = 0
    while math.exp(-((half + 1) ** 2) / (2 * s * s)) > 1e-6:
        half += 1
    raw = [(k, math.exp(-(k * k) / (2 * s * s))) for k in range(-half, half + 1)]
    total = sum(w for _, w in raw)
    return [(k, w / total) for k, w in raw]


def smooth(track: DataFrame, sigma: float, step: int = 1) -> DataFrame:
    """Gaussian smoothing of a track with points `step` apart, by spreading each point."""
    kernel = F.array(*[F.struct(F.lit(k * step).alias("k"), F.lit(w).alias("w")) for k, w in gaussian(sigma)])
    spread = track.select("target", "x", "y", F.explode(kernel).alias("k")).select("target", (F.col("x") + F.col("k.k")).alias("x"), (F.col("y") * F.col("k.w")).alias("y"))
    return spread.groupBy("target", "x").agg(F.sum("y").alias("y"))


def lag_correlation(a: DataFrame, b: DataFrame, lags: range) -> DataFrame:
    """(lag, cosine) of one track against another one shifted."""
    shifted = b.select("target", F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), "x", F.col("y").alias("z")).withColumn("x", F.col("x") - F.col("lag"))
    norm = math.sqrt((a.agg(F.sum(F.col("y") * F.col("y"))).first()[0] or 0.0) * (b.agg(F.sum(F.col("y") * F.col("y"))).first()[0] or 0.0))
    return a.join(shifted, ["target", "x"]).groupBy("lag").agg((F.sum(F.col("y") * F.col("z")) / F.lit(norm or None)).alias("cosine"))


def log_ratio(a: DataFrame, b: DataFrame, damper: float = 5.0) -> DataFrame:
    """Damped log2 ratio of two tracks."""
    j = a.join(b.withColumnRenamed("y", "z"), ["target", "x"], "full")
    y, z = F.coalesce("y", F.lit(0.0)), F.coalesce("z", F.lit(0.0))
    return j.select("target", "x", F.log2((y + damper) / (z + damper)).alias("y"))


def reshape(track: DataFrame, scale: float = 1.0, shift: int = 0, floor: float = 0.0, step: int | None = None) -> DataFrame:
    """Scale, shift, floor, and resample to a step (means)."""
    t = track.select("target", (F.col("x") + shift).alias("x"), (F.col("y") * scale).alias("y")).where(F.col("y") >= floor)
    if step:
        t = t.groupBy("target", (F.floor(F.col("x") / step) * step).alias("x")).agg(F.avg("y").alias("y"))
    return t


def overlaps(a: DataFrame, b: DataFrame, key: str, bin_width: int, least: int = 1) -> DataFrame:
    """Pairs of intervals (id, key, lo, hi, both ends included) that share at least so many
    positions. Each interval goes to the bins it touches; a pair is taken in the bin that
    holds the later start, so that nothing is found twice."""

    def binned(df: DataFrame, p: str) -> DataFrame:
        named = df.select(F.col(key).alias("key"), *[F.col(c).alias(f"{p}_{c}") for c in ("id", "lo", "hi")])
        return named.select("*", F.explode(F.sequence(F.floor(F.col(f"{p}_lo") / bin_width), F.floor(F.col(f"{p}_hi") / bin_width))).alias("bin"))

    j = binned(a, "a").join(binned(b, "b"), ["key", "bin"])
    start, end = F.greatest("a_lo", "b_lo"), F.least("a_hi", "b_hi")
    hit = j.where((end - start + 1 >= least) & (F.floor(start / bin_width) == F.col("bin")))
    return hit.select("key", "a_id", "b_id", (end - start + 1).alias("shared"))


def remap(hits: DataFrame, segments: DataFrame, bin_width: int) -> DataFrame:
    """Hits (id, key, lo, hi) moved by segments (key, lo, hi, to_key, to_lo, strand) that
    hold them whole: id, to_key, lo, hi."""
    seg = segments.select("*", F.explode(F.sequence(F.floor(F.col("lo") / bin_width), F.floor(F.col("hi") / bin_width))).alias("bin")).withColumnRenamed("lo", "s_lo").withColumnRenamed("hi", "s_hi")
    h = hits.withColumn("bin", F.floor(F.col("lo") / bin_width))
    j = h.join(seg, ["key", "bin"]).where("lo >= s_lo and hi <= s_hi")
    up = F.col("strand") >= 0
    lo = F.when(up, F.col("to_lo") + F.col("lo") - F.col("s_lo")).otherwise(F.col("to_lo") + F.col("s_hi") - F.col("hi"))
    return j.select("id", "to_key", lo.alias("new_lo"), (lo + F.col("hi") - F.col("lo")).alias("new_hi"))


def nearest_next(df: DataFrame, key: str, start: str, end: str, ident: str) -> DataFrame:
    """For each interval the next one of its key by start, and the gap to it."""
    rows = dealt(df.select(key, start, end, ident), [key], [start, ident])
    near = neighbour(rows, [key], [start, ident], {ident: "next_id", start: "next_start"}, ahead=True)
    return near.select(ident, key, "next_id", (F.col("next_start") - F.col(end)).alias("gap"))


def best_hits(df: DataFrame, read: str, score: str) -> DataFrame:
    """The best hits of each read, ties kept, with their number (`unicity`)."""
    own = Window.partitionBy(read)  # one shuffle: the two windows share it
    hit = df.withColumn("_best", F.max(score).over(own)).where(F.col(score) == F.col("_best")).drop("_best")
    return hit.withColumn("unicity", F.count("*").over(own))


def pair_tracks(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y of the one track and z of the other, 0 where it has no point."""
    j = a.join(b.withColumnRenamed("y", "z"), keys, "full")
    return j.select(*keys, F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("z", F.lit(0.0)).alias("z"))


def coverage_of_regions(runs: DataFrame, regions: DataFrame, bin_width: int) -> DataFrame:
    """For regions (id, target, lo, hi, both ends included) over runs of equal depth (target,
    x1, x2, y): covered positions, sum, mean over the region and greatest depth."""
    r = regions.select(F.col("id").alias("a"), "target", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / bin_width), F.floor(F.col("hi") / bin_width))).alias("bin"))
    c = runs.select("target", "x1", "x2", "y", F.explode(F.sequence(F.floor(F.col("x1") / bin_width), F.floor(F.col("x2") / bin_width))).alias("bin"))
    start, end = F.greatest("lo", "x1"), F.least("hi", "x2")
    hit = r.join(c, ["target", "bin"]).where((end >= start) & (F.floor(start / bin_width) == F.col("bin")))
    n = end - start + 1
    per = hit.groupBy("a").agg(F.sum(n).alias("covered"), F.sum(n * F.col("y")).alias("total"), F.max("y").alias("high"))
    out = regions.join(per, regions["id"] == per["a"], "left")
    total = F.coalesce("total", F.lit(0.0))
    return out.select("id", "target", F.coalesce("covered", F.lit(0)).alias("covered"), total.alias("total"), (total / (F.col("hi") - F.col("lo") + 1)).alias("mean"), F.coalesce("high", F.lit(0.0)).alias("high"))


def compact_introns(df: DataFrame, keys: list[str], support: str) -> DataFrame:
    """Equal introns (keys: chromosome, both ends, run) as one row, their support summed; the
    strand follows from the order of the ends."""
    out = df.groupBy(*keys).agg(F.sum(support).alias(support), F.count("*").alias("n"))
    a1, a2 = (F.col(k) for k in keys[1:3])
    return out.withColumn("strand", F.when(a1 <= a2, F.lit("+")).otherwise(F.lit("-")))
