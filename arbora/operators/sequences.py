"""Reads against references: seeds, motifs, duplicates, variants, comparisons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import canonical, kmers


def seeds(df: DataFrame, ident: str, sequence: str, k: int, step: int = 1, strand: bool = False) -> DataFrame:
    """(id, pos from 1, seed) of the words of k bases."""
    rows = df.select(F.col(ident).alias("id"), F.posexplode(kmers(F.lower(sequence), k)).alias("pos", "seed")).where(F.col("pos") % step == 0)
    seed = canonical(F.col("seed")) if strand else F.col("seed")
    return rows.select("id", (F.col("pos") + 1).alias("pos"), seed.alias("seed"))


def seed_join(reads: DataFrame, target: DataFrame, most: int = 81) -> DataFrame:
    """Seeds of reads found in the target, without target seeds that repeat more than
    `most` times; a hit keeps its diagonal: (id, target_id, diagonal, seeds)."""
    few = target.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("seed")
    t = target.join(few, "seed").withColumnsRenamed({"id": "target_id", "pos": "tpos"})
    return reads.join(t, "seed").groupBy("id", "target_id", (F.col("tpos") - F.col("pos")).alias("diagonal")).agg(F.count("*").alias("seeds"))


def motif_counts(df: DataFrame, ident: str, sequence: str, motifs: dict[str, str]) -> DataFrame:
    """Number of occurrences of each motif (a regular expression) in each sequence."""
    return df.select(ident, *[F.regexp_count(F.lower(F.col(sequence)), F.lit(m)).alias(name) for name, m in motifs.items()])


def position_profile(df: DataFrame, sequence: str) -> DataFrame:
    """(pos, base, n): bases at each place from the start of the sequences."""
    rows = df.select(F.posexplode(F.split(F.lower(F.col(sequence)), "")).alias("pos", "base")).where(F.col("base") != "")
    return rows.groupBy((F.col("pos") + 1).alias("pos"), "base").agg(F.count("*").alias("n"))


def homopolymers(df: DataFrame, sequence: str, least: int = 5) -> DataFrame:
    """(base, length, n) of runs of one base."""
    runs = F.regexp_extract_all(F.lower(F.col(sequence)), F.lit(r"((.)\2*)"), F.lit(1))
    r = df.select(F.explode(runs).alias("run")).where(F.length("run") >= least)
    return r.groupBy(F.left("run", F.lit(1)).alias("base"), F.length("run").alias("length")).agg(F.count("*").alias("n"))


_CODES = {c: v for c, v in zip("acgturykmswbdhvn", (1, 2, 4, 8, 8, 5, 10, 12, 3, 6, 9, 14, 13, 11, 7, 15))}


def fuzzy_match(df: DataFrame, ident: str, sequence: str, pattern: str, max_error: int, max_n: int = 0) -> DataFrame:
    """(id, pos, errors): places where a pattern of IUPAC codes fits with so few mismatches
    and unknown bases. Whole sequences are compared at once in numpy."""
    table = np.zeros(256, np.uint8)
    for c, v in _CODES.items():
        table[ord(c)] = table[ord(c.upper())] = v
    want = table[np.frombuffer(pattern.encode(), np.uint8)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, s in zip(pdf["id"], pdf["s"]):
                code = table[np.frombuffer((s or "").encode("ascii", "replace"), np.uint8)]
                if len(code) < len(want):
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(code, len(want))
                wrong = ((windows & want) == 0).sum(axis=1)
                unknown = (windows == 15).sum(axis=1)
                out += [(i, int(p) + 1, int(wrong[p])) for p in np.nonzero((wrong <= max_error) & (unknown <= max_n))[0]]
            yield pd.DataFrame(out, columns=["id", "pos", "errors"])

    kind = f"id {df.schema[ident].dataType.simpleString()}, pos int, errors int"
    return df.select(F.col(ident).alias("id"), F.col(sequence).alias("s")).mapInPandas(run, kind)


def consensus(df: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """The most frequent sequence of each key, its support and the number of reads."""
    per = df.groupBy(*key, sequence).agg(F.count("*").alias("support"))
    best = per.groupBy(*key).agg(F.max_by(F.struct(sequence, "support"), F.struct("support", sequence)).alias("b"), F.sum("support").alias("reads"), F.count("*").alias("kinds"))
    return best.select(*key, F.col(f"b.{sequence}").alias(sequence), F.col("b.support").alias("support"), "reads", "kinds")


def variant_support(calls: DataFrame, least_cover: int = 10, least_percent: float = 5.0) -> DataFrame:
    """From (sample, target, pos, variant, is_variant) reads: cover, support and frequency
    of each variant of a sample, above both thresholds."""
    g = calls.groupBy("sample", "target", "pos", "variant").agg(F.count("*").alias("cover"), F.sum(F.col("is_variant").cast("long")).alias("support"))
    g = g.withColumn("percent", 100.0 * F.col("support") / F.col("cover"))
    return g.where((F.col("cover") >= least_cover) & (F.col("percent") >= least_percent))


def break_points(pairs: DataFrame, reach: int, least: int = 2) -> DataFrame:
    """Donor and acceptor positions (target, a, b) clustered within `reach`, with support."""
    g = pairs.groupBy("target", F.floor(F.col("a") / reach).alias("ka"), F.floor(F.col("b") / reach).alias("kb"))
    return g.agg(F.count("*").alias("support"), F.median("a").cast("long").alias("donor"), F.median("b").cast("long").alias("acceptor")).where(F.col("support") >= least).drop("ka", "kb")


def against_truth(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row: true and false positives, false negatives, precision, recall, F."""
    a = found.select(*keys).distinct().withColumn("_f", F.lit(1))
    b = truth.select(*keys).distinct().withColumn("_t", F.lit(1))
    n = a.join(b, keys, "full").agg(F.count(F.when(F.col("_f").isNotNull() & F.col("_t").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("_t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("_f").isNull(), 1)).alias("fn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f"))
