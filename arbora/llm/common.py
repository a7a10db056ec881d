"""Shared plumbing of the training-data operators: table access, shared scratch tables,
byte-level tokenising and distributed connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: Arrow batches of texts: a worker holds one or two at a time, however long the texts are.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
#: A word is a run of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    for key, value in _BATCH.items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where the session names none and all runs on one
    machine, as in tests, a temporary one is made."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="arbora-")
        atexit.register(shutil.rmtree, base, True)
        spark.sparkContext.setCheckpointDir(base)
    return base


def settle(df: DataFrame, *by: str) -> DataFrame:
    """Cut lineage: write df as a Parquet table in the shared folder, in folders by the last
    columns if they are named, and read it back."""
    spark = df.sparkSession
    ship(spark)
    path = f"{scratch_dir(spark)}/arbora-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._arbora_path = path
    return out


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with `rn` (from 1) among the rows of equal keys, whatever their number: rows are
    numbered within tasks of a settled copy, with the counts of earlier tasks as offsets."""
    held = settle(df.withColumn("__i", F.monotonically_increasing_id()))
    held = held.withColumn("__part", F.shiftright("__i", 33))
    names = ", ".join(keys)
    per = held.groupBy(*keys, "__part").agg(F.count("*").alias("__m")).selectExpr(*keys, "__part", f"sum(__m) over (partition by {names} order by __part) - __m as __off")
    g, o = held.selectExpr("*", f"row_number() over (partition by {names}, __part order by __i) as __r").alias("g"), per.alias("o")
    same = F.col("g.__part") == F.col("o.__part")
    for k in keys:
        same = same & F.col(f"g.{k}").eqNullSafe(F.col(f"o.{k}"))
    return g.join(o, same).select(*[F.col(f"g.{x}") for x in df.columns], (F.col("g.__r") + F.col("o.__off")).alias("rn"))


def discard(df: DataFrame | None) -> None:
    """Delete a table made by settle() that nothing reads any more."""
    path = getattr(df, "_arbora_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


pa.set_memory_pool(pa.system_memory_pool())  # what Arrow frees, give_back can return


def give_back() -> None:
    """Return freed memory to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(spark: SparkSession) -> None:
    """Let go of what no longer has a reader: its shuffle files go, and the driver gives back
    the memory that plans and results of earlier jobs took."""
    for _ in range(2):  # one collection of the driver's garbage does not reach the shuffles of a write
        gc.collect()
        spark._jvm.System.gc()
    give_back()


def lean(run):
    """A function over Arrow batches that gives its memory back at the end of a task: workers
    live on, beside an executor that needs it."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def row_key() -> list[Column]:
    """Two 64-bit hashes of doc_id and text: together they tell rows apart by both."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2")]


class Marks:
    """A bitmap of row keys, of at most 2^27 bits whatever the input: lets through all keys
    that were put in, and few others."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame) -> Marks:
        """Of the keys in column k1."""
        size = 1 << min(27, max(12, (16 * max(1, keys.count())).bit_length()))
        word = F.shiftright(F.col("k1").bitwiseAND(F.lit(size - 1)), 6)
        got = keys.select(word.alias("w"), F.expr("shiftleft(1L, cast(k1 & 63 as int))").alias("x")).groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
        words = np.zeros(size // 64, np.uint64)
        words[got["w"].to_numpy()] = got["x"].to_numpy().astype(np.int64).view(np.uint64)
        return cls(words)

    def has(self, keys: pa.Array) -> np.ndarray:
        at = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) & np.uint64(len(self.words) * 64 - 1)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of so few rows, for wide rows, while a job runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key's text, modulo `of`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % of


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words. bytes.lower() and bytes.split() touch ASCII alone and
    split at exactly the six characters of WORD's complement."""
    return text.lower().split() if text else []


def id_remainder(doc_id: int | None, of: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % of


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: two columns of one orderable type; nulls and loops are ignored. Returns
    (node, component) with component the smallest node reachable, for every node that has
    an edge to another. Each round shuffles the edge list by key with map-side minima, so
    that a node with very many edges costs one partial result a task; its join is split by
    adaptive execution. The driver sees one count and one checksum a round.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = settle(e)
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        j = down.join(low, "u")
        small = j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(j.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = settle(small)
        discard(e)
        e, now = nxt, _fingerprint(nxt)
        if now == seen:
            break
        seen = now
    # at the fixed point every node but the smallest of its component points at the smallest
    pointed = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return pointed.union(e.select("v", "v").distinct())
