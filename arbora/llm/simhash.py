"""Document fingerprints by SimHash.

The terms of a text are its lower-cased words and pairs of neighbouring words, weighing
1 + ln(count). Every term's 64-bit hash votes with its weight on each bit, and the sign of
a bit's sum is the bit. All fingerprints within a Hamming radius of each other are found by
permuted block tables: with the 64 bits in radius + KEY blocks, two such fingerprints agree
on some KEY blocks, which are the key of one of the tables. A pair counts in the first table
that it meets in.

The next document comes beside each one by a range sort: each task walks its rows in order
and puts its first and last row out, with their texts, to be matched across tasks.

Defined results: a null text is empty, and the fingerprint of a text without words is 0;
very long texts are read whole; rows with one doc_id follow each other in the order of a
hash of the text, null doc_ids come last; a single row is its own next; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import lean, settle

BITS, KEY = 64, 3
RADIUS = 3
_ROWS = 4000  # documents that a task walks
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str) -> int:
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    with np.errstate(over="ignore"):
        one = _spread((np.fromiter(map(crc32, w), np.uint64, len(w)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        two = _spread(one[:-1] * np.uint64(3) + one[1:])
    term, count = np.unique(np.concatenate((one, two)), return_counts=True)
    weight = (1 + np.log(count)).astype(np.float32)
    votes = np.zeros(BITS, np.float64)
    for lo in range(0, len(term), 8192):
        bits = np.unpackbits(term[lo : lo + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += weight[lo : lo + 8192] @ bits.astype(np.float32)
    up = 2 * votes > weight.sum(dtype=np.float64)
    return int.from_bytes(np.packbits(up).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType())] + [T.StructField(x, T.StringType()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")] + [T.StructField(x, T.DoubleType()) for x in ("near_edited", "near_next")])
_EDGE = T.StructType([T.StructField("task", T.LongType()), T.StructField("last", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("mark", T.LongType())])
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _pair(doc_id, text: str, mark: int, next_text: str, next_mark: int) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    e = fingerprint(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), f"{mark:016x}", f"{e:016x}", likeness(mark, e), likeness(mark, next_mark)


def _signed(mark: int) -> int:
    return mark - (1 << 64) if mark >> 63 else mark


def _walk(batches) -> Iterator[pa.RecordBatch]:
    """Walk rows in order; each is put out with its next row, the first and the last of the
    task as edges."""
    task, prev = TaskContext.get().partitionId(), None
    edge = pa.struct([("task", pa.int64()), ("last", pa.bool_()), ("text", pa.string()), ("mark", pa.int64())])

    def out(rows, edges):
        c = list(zip(*rows)) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([*[pa.array(x, k) for x, k in zip(c, _KINDS)], pa.array(edges, edge)], [*_OUT.names, "edge"])

    def at_edge(row, last):
        return out([(row[0], None, None, None, None, None, None)], [{"task": task, "last": last, "text": row[1], "mark": _signed(row[2])}])

    for b in batches:
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_py() or ""
            mark = fingerprint(text)
            if prev is None:
                yield at_edge((doc_id, text, mark), False)
            else:
                rows.append(_pair(*prev, text, mark))
            prev = (doc_id, text, mark)
        yield out(rows, [None] * len(rows))
    if prev is not None:
        yield at_edge(prev, True)


def _stitch(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_pair(i, t, m % (1 << 64), u, k % (1 << 64)) for i, t, m, u, k in zip(*(c.to_pylist() for c in b.columns))]
        c = list(zip(*rows)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, _KINDS)], _OUT.names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    order = ["z", "d", "h"]
    id_ = F.col("doc_id").cast("long")
    keyed = docs.select(id_.alias("doc_id"), "text", id_.isNull().alias("z"), F.bitwise_not(id_).alias("d"), F.xxhash64("text").alias("h"))
    tasks = max(1, -(-docs.count() // _ROWS))
    sorted_ = keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "text")
    walked = settle(sorted_.mapInArrow(lean(_walk), T.StructType([*_OUT.fields, T.StructField("edge", _EDGE)])))
    edges = walked.where("edge is not null").select("doc_id", "edge.*")
    first, last = edges.where("not last"), edges.where("last")
    # one narrow row a task: which task comes next, the first after the last
    tasks_ = first.select("task").withColumn("next", F.lead("task").over(Window.orderBy("task")))
    tasks_ = tasks_.crossJoin(F.broadcast(first.agg(F.min("task").alias("start")))).select("task", F.coalesce("next", "start").alias("next"))
    joined = last.join(tasks_, "task").join(first.select(F.col("task").alias("next"), F.col("text").alias("next_text"), F.col("mark").alias("next_mark")), "next")
    ends = joined.select("doc_id", "text", "mark", "next_text", "next_mark").mapInArrow(lean(_stitch), _OUT)
    return walked.where("edge is null").drop("edge").unionByName(ends)


def _masks(radius: int) -> list[int]:
    """The key bits of each table."""
    blocks = radius + KEY
    edge = [i * BITS // blocks for i in range(blocks + 1)]
    return [_signed(sum(((1 << edge[p + 1]) - 1) ^ ((1 << edge[p]) - 1) for p in pick)) for pick in combinations(range(blocks), KEY)]


def _tables(marks: DataFrame, masks: list[int]) -> DataFrame:
    """The columns of marks, t and key for every table."""
    key = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("k")
    return marks.select("*", key).select(*marks.columns, "k.t", "k.key")


def _meets_first(a: str, b: str, t: str, masks: list[int]) -> Column:
    """Is t the first table in which the two fingerprints have one key?"""
    apart = F.col(a).bitwiseXOR(F.col(b))
    return F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)]) == F.col(t)


def near_counts(marks: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, n_within: for each distinct fingerprint of queries (column `fp`, long) the rows of
    marks (fp, n rows each) within the Hamming radius, by one join of block tables."""
    masks = _masks(radius)
    q, r = _tables(queries.select("fp").distinct(), masks).alias("q"), _tables(marks, masks).alias("r")
    near = (F.bit_count(F.col("q.fp").bitwiseXOR(F.col("r.fp"))) <= radius) & _meets_first("q.fp", "r.fp", "q.t", masks)
    hits = q.join(r, (F.col("q.t") == F.col("r.t")) & (F.col("q.key") == F.col("r.key")) & near)
    return hits.groupBy("q.fp").agg(F.sum("r.n").alias("n_within"))


def with_near_counts(docs: DataFrame, every: int = 100, radius: int = RADIUS) -> DataFrame:
    """fingerprints() and n_within: for documents whose doc_id is divisible by `every`, how
    many other documents lie within the radius; else null."""
    out = settle(fingerprints(docs))
    fp = F.conv("fingerprint", 16, -10).cast("long")
    own = out.select(fp.alias("fp"), (F.col("doc_id") % every == 0).alias("asked"))
    marks = settle(own.groupBy("fp").agg(F.count("*").alias("n"), F.max(F.coalesce("asked", F.lit(False))).alias("asked")))
    near = near_counts(marks.select("fp", "n"), marks.where("asked"), radius).select(F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "n_within")
    asked = F.col("doc_id") % every == 0
    return out.join(near, (F.col("fingerprint") == F.col("f")) & asked, "left").select(*out.columns, F.when(asked, F.col("n_within") - 1).alias("n_within"))


def within_radius(marks: DataFrame, radius: int = RADIUS, limit: int = 64) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints (column `fp`, long) within the
    Hamming radius. A bucket of more than `limit` fingerprints is compared slice against
    slice, so that no task holds all of it."""
    masks = _masks(radius)
    fps = settle(marks.select("fp").where("fp is not null").distinct())
    rows = _tables(fps, masks)
    size = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(size, ["t", "key"])
    # a large bucket is paired slice by slice: each pair of slices is its own small task
    parts = F.ceil(F.col("n") / limit).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    sliced = rows.withColumn("parts", parts).withColumn("mine", mine)
    left = sliced.select("t", "key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    left = left.select("t", "key", F.col("fp").alias("a"), F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
    pairs = left.alias("l").join(left.alias("r"), ["t", "key", "p", "q"]).where("l.a < r.a").select("t", F.col("l.a").alias("a"), F.col("r.a").alias("b"))
    return pairs.where((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius) & _meets_first("a", "b", "t", masks)).select("a", "b").distinct()
