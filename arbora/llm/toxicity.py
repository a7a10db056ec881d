"""Toxicity by subword-bag embeddings under a linear softmax.

A word is the bag of its byte n-grams (3 to 6, with its borders), hashed into buckets; a
document is the mean over its words of the mean embedding of their n-grams, each n-gram
weighing by its rarity in the training sample (those of fewer than LEAST documents are
left out); a linear
softmax on it gives the two classes. Embeddings and softmax are trained jointly in numpy
by Adam on a bounded sample of labelled documents; misspellings and inflections that were
never seen share the vectors of their n-grams. For scoring the product of embeddings and
softmax is one number a bucket, so a whole batch of texts is scored by array operations.

Parameters: at most TRAIN labelled documents (a quarter of them label 1 where there are so
many), those of the least hash of doc_id; the sampling is undone in the intercept.

Defined results: null and empty texts, and texts without a word, get the score of the
intercept; labels other than 0 and 1 are ignored; of several labels of one doc_id the
largest counts, of several texts of one labelled doc_id the smallest; texts of any length
are scored whole; without training rows of both classes every score is the share of label 1
(0 without labels); extra columns are ignored.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, lean, remainder

GRAMS, BUCKETS, WIDTH, TRAIN = (3, 4, 5, 6), 1 << 17, 8, 2000
EPOCHS, RATE, DECAY, SCALE, LEAST = 80, 0.02, 1e-4, 100.0, 3
THRESHOLD = 0.3
_BLOCK = 1 << 18  # bytes of text worked on at once
_HALF = 1000.0  # brings shares into the range of half precision, in which they are sent
_PART = 100  # documents of the sample worked on at once

_letters = np.ones(256, bool)
_letters[list(range(0, 48)) + list(range(58, 65)) + list(range(91, 97)) + list(range(123, 128))] = False
_MULT = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[bytes]):
    """For lower-cased texts: n-gram buckets, the word of each, the text of each word."""
    buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    is_letter = _letters[buf]
    start = is_letter[1:] & ~is_letter[:-1]
    word = np.concatenate(([0], np.cumsum(start))) - 1  # of each byte, the last word begun
    at = np.nonzero(start)[0] + 1
    text = np.searchsorted(ends, at - 1, side="right")
    code = np.where(is_letter, buf, 32).astype(np.uint64)
    keys, owners = [], []
    inner = np.ones(len(buf), bool)
    for n in range(3, max(GRAMS) + 1):
        m = len(buf) - n + 1
        if m <= 0:
            break
        inner = inner[:m] & is_letter[n - 2 : n - 2 + m]  # bytes 1 .. n-2 of the window
        if n in GRAMS:
            i = np.nonzero(inner)[0]
            h = np.full(len(i), n, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    h = h * np.uint64(1099511628211) + code[i + k]
                h = (h ^ (h >> np.uint64(29))) * _MULT
            keys.append((h >> np.uint64(64 - 17)).astype(np.int64))
            owners.append(word[i + 1])
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), text
    return np.concatenate(keys), np.concatenate(owners), text


def _features(batches):
    """Per document: buckets with the shares they have in it."""
    for b in batches:
        idx, val = [], []
        for t in b.column(0):
            key, owner, text = grams([(t.as_py() or b"").lower()])
            if len(text):
                n = np.bincount(owner, minlength=len(text))
                w = np.bincount(key, 1.0 / n[owner] / len(text), BUCKETS)
                i = np.nonzero(w)[0]
                idx.append(i.astype(np.int32).tobytes())
                val.append((w[i] * _HALF).astype(np.float16).tobytes())
            else:
                idx.append(b"")
                val.append(b"")
        yield pa.RecordBatch.from_arrays([pa.array(idx, pa.binary()), pa.array(val, pa.binary()), b.column(1)], ["idx", "val", "toxic"])


def _views(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    """The values of a binary column as arrays over its own memory."""
    out = []
    for chunk in column.chunks:
        _, ends, data = chunk.buffers()
        if data is None:
            out += [np.empty(0, kind)] * len(chunk)
            continue
        at = np.frombuffer(ends, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] // np.dtype(kind).itemsize
        flat = np.frombuffer(data, kind, data.size // np.dtype(kind).itemsize)
        out += [flat[a:b] for a, b in zip(at, at[1:])]
    return out


def fit(rows: pa.Table, prior: float) -> tuple[np.ndarray, float]:
    """Per bucket the embedding's product with the softmax difference, and the intercept.
    The sample (idx, val, toxic) is held once, in parts, and every pass makes temporaries
    of one part only."""
    idx, val, y = _views(rows["idx"], np.int32), _views(rows["val"], np.float16), rows["toxic"].to_numpy().astype(np.float64)
    order = np.argsort([crc32(v.tobytes()) for v in idx], kind="stable")  # the order of arrival is not fixed
    y, share = y[order], y.mean()
    parts = []
    held = np.zeros(BUCKETS, np.int64)  # documents that hold a bucket
    for lo in range(0, len(y), _PART):
        own = order[lo : lo + _PART]
        flat = np.concatenate([idx[i] for i in own])
        held += np.bincount(flat, minlength=BUCKETS)
        parts.append([lo, np.array([len(idx[i]) for i in own]), flat, np.concatenate([val[i] for i in own])])
    del idx, val, rows
    if not held.any() or share in (0.0, 1.0):
        return np.zeros(BUCKETS), float(np.log((prior + 1e-9) / (1 - prior + 1e-9)))
    rarity = np.where(held >= LEAST, np.log((len(y) + 1) / (held + 1)), 0).astype(np.float32)
    for p in parts:
        p[3] = p[3].astype(np.float32) * (rarity[p[2]] * np.float32(SCALE / _HALF))
    rng = np.random.default_rng(7)
    e = rng.normal(0, 0.001, (BUCKETS, WIDTH)).astype(np.float32)
    w = rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32)
    b = np.array([np.log(1 - share), np.log(share)], np.float32)
    params, moment = [e, w, b], [[np.zeros_like(p), np.zeros_like(p)] for p in (e, w, b)]
    for step in range(1, EPOCHS + 1):
        d = w[:, 1] - w[:, 0]
        s = e @ d
        back, miss = np.zeros(BUCKETS), 0.0
        for lo, n, flat, x in parts:
            row = np.repeat(np.arange(len(n)), n)
            z = np.bincount(row, x * s[flat], len(n)) + b[1] - b[0]
            r = (1 / (1 + np.exp(-z)) - y[lo : lo + len(n)]) / len(y)
            back += np.bincount(flat, x * r[row].astype(np.float32), BUCKETS)
            miss += r.sum()
        back = back.astype(np.float32)
        pull = (e.T @ back).astype(np.float32)
        grads = [back[:, None] * d[None, :] + DECAY * e, np.stack([-pull, pull], 1) + DECAY * w, np.array([-miss, miss], np.float32)]
        for p, g, (m, v) in zip(params, grads, moment):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return ((e @ (w[:, 1] - w[:, 0])) * rarity).astype(np.float64), float(b[1] - b[0] + shift)


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model from labelled documents whose crc32(doc_id) mod 4 is not 2."""
    lab = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sum(n.values()):
        return np.zeros(BUCKETS), -20.0
    prior = n.get(1, 0) / sum(n.values())
    pick = [lab.where(f"toxic = {c}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_c) for c, n_c in ((0, TRAIN - TRAIN // 4), (1, TRAIN // 4))]
    pick = F.broadcast(pick[0].union(pick[1]))  # at most TRAIN rows
    text = docs.select("doc_id", "text").join(pick, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))  # of repeated ids one text
    rows = text.select(F.col("text").cast("binary").alias("text"), "toxic").mapInArrow(lean(_features), "idx binary, val binary, toxic int").toArrow()
    if not rows.num_rows:
        return np.zeros(BUCKETS), float(np.log((prior + 1e-9) / (1 - prior + 1e-9)))
    out = fit(rows, prior)
    del rows
    give_back()
    return out


def _scores(column: pa.Array, weight: np.ndarray, bias: float) -> np.ndarray:
    out, block, size, done = np.full(len(column), bias), [], 0, 0

    def flush() -> None:
        nonlocal block, size, done
        key, owner, text = grams(block)
        if len(text):
            n = np.maximum(1, np.bincount(owner, minlength=len(text)))
            s = np.bincount(owner, weight[key], len(text)) / n
            k = np.bincount(text, minlength=len(block))
            out[done : done + len(block)] += SCALE * np.bincount(text, s, len(block)) / np.maximum(1, k)
        done += len(block)
        block, size = [], 0

    for t in column:
        v = (t.as_py() or b"").lower()
        block.append(v)
        size += len(v)
        if size >= _BLOCK:
            flush()
    if block:
        flush()
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score of every row of docs."""
    weight, bias = model
    packed = docs.sparkSession.sparkContext.broadcast(weight.astype(np.float32))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b.column(1), packed.value, bias))], ["doc_id", "score"])

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), kind)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score under the threshold, whole and without a shuffle."""
    weight, bias = train(docs, labels)
    packed = docs.sparkSession.sparkContext.broadcast(weight.astype(np.float32))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(b.column(at).cast(pa.binary()), packed.value, bias) < THRESHOLD))

    return docs.mapInArrow(lean(run), docs.schema)
