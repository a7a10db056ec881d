"""Personal data: base patterns and information-theoretic sanitisation.

Protected entities are the values that the base patterns find (e-mail, ip, card, phone).
A term (a run of four or more letters) that shares documents with an entity may reveal it:
corpus co-occurrence gives the pointwise mutual information of term and entity, and its
share of the entity's own information content is the disclosure, 1 when the term occurs
with that entity only. Terms of a disclosure of at least DISCLOSURE whose co-occurrence is
no chance (log-likelihood ratio of at least RATIO, one in a thousand) are spans too (kind
`term`), wherever they stand in any text outside the base spans, generalised or removed by
`sanitise`. No number of texts is asked for: in a large corpus one text with an address
and a name found nowhere else is enough.

Counts are over all documents. Entities that stand in the same documents are one class (told
by two sums of document hashes), so a text with many values of its own costs as much as one
with a single value. A term can only pass if no more than n_e^d * n^(1-d) of the n documents
hold it (n_e those of the entity, d the threshold), so terms are counted first and only those
rare enough for a document's entities are paired with them, pre-aggregated by task. Where
disclosing terms stand is found in a last pass. Passes let words through bitmaps of bounded
size and then join them exactly.

Defined results: null texts are empty and have no spans; the hash of no spans is that of
the empty string; repeated rows are found one by one; very long texts are read whole, in
time in proportion to them; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, lean, settle

DISCLOSURE, RATIO = 0.9, 10.83
KINDS = ("email", "ip", "card", "phone", "term")
_BITS, _SHIFTS = 1 << 26, (0, 18, 36)  # of the bitmaps

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is entered at its start only: no match begins within one
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{4,}")


def _emails(t: str):
    """Leftmost matches: a local part starts where its run of characters does, or after
    the match before it."""
    done, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = t.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = []
    if "@" in t:
        out += [(a, 0, b) for a, b in _emails(t)]
    if _DIGIT.search(t):
        if "." in t:
            for m in _IP.finditer(t):
                parts = m.group().split(".")
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
                    out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in t:
            for m in _PHONE.finditer(t):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _outside(spans, matches):
    """The matches, in order, that stand outside all spans (which are in order of start)."""
    k, reach = 0, 0  # the spans up to k reach to `reach`
    for m in matches:
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][2])
            k += 1
        if m.start() >= reach:
            yield m


_SPAN = pa.list_(pa.struct([("a", pa.int32()), ("k", pa.int32()), ("b", pa.int32())]))


def _find(batches):
    for batch in batches:
        n, sha, spans, values, terms = [[], [], [], []], [], [], [], []
        for v in batch.column(2):
            t = v.as_py() or ""
            s = base_spans(t)
            c = Counter(k for _, k, _ in s)
            for k in range(4):
                n[k].append(c[k])
            sha.append(hashlib.sha256(joined(s).encode()).hexdigest())
            spans.append([{"a": a, "k": k, "b": b} for a, k, b in s])
            values.append(list({f"{KINDS[k]}:{t[a:b].lower()}" for a, k, b in s}))
            terms.append(list({m.group().lower() for m in _outside(s, _TERM.finditer(t))}) if s else [])
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(x, pa.int64()) for x in n], pa.array(sha), pa.array(spans, _SPAN), pa.array(values, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.string()))], ["key", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "values", "terms"])


def _bits(words: DataFrame) -> np.ndarray:
    """A bitmap of the words in column t, three bits each, of bounded size."""
    size = min(_BITS, 1 << max(16, (16 * words.count()).bit_length()))
    h = F.xxhash64(F.col("t").cast("binary"))
    at = words.select(F.explode(F.array(*[F.shiftrightunsigned(h, k).bitwiseAND(F.lit(size - 1)) for k in _SHIFTS])).alias("at"))
    got = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("x")).toArrow()
    packed = np.zeros(size // 64, np.uint64)
    packed[got["w"].to_numpy()] = got["x"].to_numpy().view(np.uint64)
    return packed.view(np.uint8)


class _Candidates(dict):
    """Word as written: lower-cased if the bitmap lets it in, else None."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.mask = packed, 8 * len(packed) - 1

    def __missing__(self, word: str) -> str | None:
        if len(self) > 500_000:
            self.clear()
        low = word.lower()
        h = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 42)  # as Spark's
        fits = all(self.packed[(h >> k & self.mask) >> 3] >> (h >> k & 7) & 1 for k in _SHIFTS)
        self[word] = out = low if fits else None
        return out


def _holders(packed: np.ndarray):
    """Pre-aggregated counts of documents that hold a term, for terms the bitmap lets in."""

    def run(batches):
        counts: Counter = Counter()
        fit = _Candidates(packed)
        for batch in batches:
            for v in batch.column(0):
                t = v.as_py()
                if t:
                    held = {fit[w] for w in set(_TERM.findall(t))}
                    held.discard(None)
                    counts.update(held)
                    if len(counts) > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["t", "n"])
                        counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["t", "n"])

    return run


def _places(packed: np.ndarray):
    """Where terms that the bitmap lets in stand, outside the base spans."""

    def run(batches):
        fit = _Candidates(packed)
        for batch in batches:
            key, term, start, end = [], [], [], []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = v.as_py()
                hits = [m for m in _TERM.finditer(t) if fit[m.group()]] if t else []
                for m in _outside(base_spans(t) if hits else [], hits):
                    key.append(k)
                    term.append(fit[m.group()])
                    start.append(m.start())
                    end.append(m.end())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(term, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["key", "t", "a", "b"])

    return run


def _kind(id_type) -> T.StructType:
    span = T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("a", "k", "b")]))
    words = T.ArrayType(T.StringType())
    return T.StructType([T.StructField("key", T.LongType()), T.StructField("doc_id", id_type)] + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]] + [T.StructField("base_sha256", T.StringType()), T.StructField("base", span), T.StructField("values", words), T.StructField("terms", words)])


def _pairs(sent):
    """Pre-aggregated (c, t, n_te): classes of entities beside terms of their documents, as
    far as the bitmap of the document's level lets the terms in."""

    def run(batches):
        fits = {level: _Candidates(packed) for level, packed in sent.value.items()}
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in counts], pa.int64()), pa.array([t for _, t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["c", "t", "n_te"])

        for b in batches:
            for classes, level, terms in zip(b.column(0), b.column(1).to_pylist(), b.column(2)):
                own = [t for t in terms.as_py() if fits[level][t]]
                for c in classes.as_py():
                    counts.update((c, t) for t in own)
                    if len(counts) > 500_000:
                        yield out()
                        counts.clear()
        yield out()

    return run


def disclosing(found: DataFrame, docs: DataFrame) -> DataFrame | None:
    """t of the terms that reveal an entity; None where there is none."""
    n = found.count()
    some = found.where(F.size("values") > 0)
    held = docs.select("text").mapInArrow(lean(_holders(_bits(some.select(F.explode("terms").alias("t"))))), "t string, n long").groupBy("t").agg(F.sum("n").alias("n_t"))
    mention = some.select("key", F.explode("values").alias("e"))
    mark = lambda salt: F.sum(F.xxhash64("key", F.lit(salt)).cast("decimal(20,0)"))
    entity = mention.groupBy("e").agg(F.count("*").alias("n_e"), mark(0).alias("s0"), mark(1).alias("s1"))
    entity = settle(entity.select("e", "n_e", F.xxhash64("n_e", "s0", "s1").alias("c")))
    # the most documents that a disclosing term can be in, as a power of two
    most = F.ceil(DISCLOSURE * F.log2(F.max("n_e")) + (1 - DISCLOSURE) * math.log2(max(n, 1)) + 1e-9).cast("int")
    per_doc = mention.distinct().join(entity, "e").groupBy("key").agg(F.collect_set("c").alias("classes"), most.alias("level"))
    tied = settle(some.select("key", "terms").join(per_doc, "key").select("classes", "level", "terms"))
    levels = [r["level"] for r in tied.select("level").distinct().collect()]  # logarithms: a few dozen at most
    if not levels:
        return None
    held = settle(held.where(F.col("n_t") <= 2 ** max(levels)))
    sent = docs.sparkSession.sparkContext.broadcast({k: _bits(held.where(F.col("n_t") <= 2**k)) for k in levels})
    pairs = tied.mapInArrow(lean(_pairs(sent)), "c long, t string, n_te long").groupBy("c", "t").agg(F.sum("n_te").alias("n_te"))
    classes = entity.groupBy("c").agg(F.first("n_e").alias("n_e"))
    n = F.lit(float(n))
    te, t, e = F.col("n_te"), F.col("n_t"), F.col("n_e")
    whole = F.log2(n / e)
    mutual = F.log2(te * n / (t * e))

    def part(x, row, column):
        return F.when(x > 0, x * F.log(x * n / (row * column))).otherwise(0.0)

    ratio = 2 * (part(te, t, e) + part(t - te, t, n - e) + part(e - te, n - t, e) + part(n - t - e + te, n - t, n - e))
    out = settle(pairs.join(held, "t").join(classes, "c").where((whole > 0) & (mutual >= DISCLOSURE * whole) & (ratio >= RATIO)).select("t").distinct())
    for x in (entity, tied, held):
        discard(x)
    return None if out.isEmpty() else out


def _key() -> Column:
    """Rows of one doc_id and text have the same spans."""
    return F.xxhash64("doc_id", "text")


def found_spans(docs: DataFrame) -> DataFrame:
    """Of every row key, doc_id, the counts, hash and spans of the base patterns (`base`), the
    values found and, where there are any, the terms beside them; settled."""
    return settle(docs.select(_key().alias("key"), "doc_id", "text").mapInArrow(lean(_find), _kind(docs.schema["doc_id"].dataType)))


def _marked(docs: DataFrame) -> DataFrame:
    """key, the columns of personal_data() but `spans`, and `all` spans of every row."""
    found = found_spans(docs)
    terms = disclosing(found, docs)
    out = found.drop("values", "terms")
    if terms is None:
        return out.withColumn("all", F.col("base"))
    places = docs.select(_key().alias("key"), "text").mapInArrow(lean(_places(_bits(terms))), "key long, t string, a int, b int")
    more = places.join(terms, "t").select("key", F.struct("a", F.lit(4).alias("k"), "b").alias("s")).groupBy("key").agg(F.collect_set("s").alias("more"))
    return out.join(more, "key", "left").withColumn("all", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<a:int,k:int,b:int>>"))))).drop("more")


def _spans() -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform("all", lambda s: F.concat_ws(":", F.get(name, s["k"]), s["a"].cast("string"), s["b"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs."""
    return _marked(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", _spans().alias("spans"))


def redact(text: str | None, spans: str) -> str | None:
    """The text with base spans generalised to their kind and terms removed."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in spans.split(","):
        kind, a, b = s.rsplit(":", 2)
        a, b = int(a), int(b)
        if b <= at:
            continue
        out += [text[at : max(at, a)], "" if kind == "term" else f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with `text` sanitised; other columns stay."""
    found = _marked(docs).where(F.size("all") > 0).select(F.col("key").alias("__key"), _spans().alias("__s")).dropDuplicates(["__key"])

    @F.pandas_udf("string")
    def clean(t, s):
        import pandas as pd

        return pd.Series([redact(x, y or "") for x, y in zip(t, s)])

    out = docs.withColumn("__k", _key()).join(found, F.col("__k") == F.col("__key"), "left")
    return out.withColumn("text", clean("text", "__s")).select(*docs.columns)
