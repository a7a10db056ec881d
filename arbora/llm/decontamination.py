"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters (lower-cased, white space made single) may be found with up to
k = m // PIECE edits. Split into k + 1 pieces, at least one piece must occur unchanged in
any such match; one Aho-Corasick pass over a whole document finds all pieces of all items,
and every hit is verified by Myers' bit-parallel distance on the stretch of text in which
the match would have to lie. Items of fewer than PIECE characters must occur exactly,
between word borders.

Items are taken in blocks of bounded size, each of one pass over the documents, so that
what is sent to the executors does not grow with the benchmark.

Defined results: null or empty texts and items match nothing; a null doc_id or item_id is
carried; repeated documents and items are each reported; very long texts are searched whole;
an empty benchmark matches nothing; extra columns are ignored by
`contaminated` and kept by `drop_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean

#: Characters of an item for each edit allowed; characters of items in one block.
PIECE, BLOCK = 14, 4_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 near-equal pieces with their places."""
    m, n = len(item), k + 1
    marks = [i * m // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(marks, marks[1:])]


def myers(pattern: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the best match of a pattern of m characters within text."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for i, ch in enumerate(text):
        eq = pattern.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    """The items of one block, ready for search."""

    def __init__(self, items: list[str]):
        self.items, self.k, self.masks = items, [len(t) // PIECE for t in items], [None] * len(items)
        by: dict[str, list[tuple[int, int]]] = {}
        for i, t in enumerate(items):
            for at, piece in pieces(t, self.k[i]):
                by.setdefault(piece, []).append((i, at))
        self.auto = ahocorasick.Automaton()
        for piece, where in by.items():
            self.auto.add_word(piece, (len(piece), where))
        if by:
            self.auto.make_automaton()
        self.any = bool(by)

    def mask(self, i: int) -> dict[str, int]:
        if self.masks[i] is None:
            m: dict[str, int] = {}
            for j, ch in enumerate(self.items[i]):
                m[ch] = m.get(ch, 0) | (1 << j)
            self.masks[i] = m
        return self.masks[i]

    def search(self, text: str) -> dict[int, int]:
        """item: least distance, for the items that the text holds."""
        found: dict[int, int] = {}
        if not text or not self.any:
            return found
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, (n, where) in self.auto.iter(text):
            for i, at in where:
                if found.get(i) == 0:
                    continue
                start, m, k = end + 1 - n - at, len(self.items[i]), self.k[i]
                if start >= 0 and text.startswith(self.items[i], start):
                    if k or ((start == 0 or text[start - 1] == " ") and text[start + m : start + m + 1] in ("", " ")):
                        found[i] = 0
                elif k:
                    spans.setdefault(i, []).append((max(0, start - k), start + m + k))
        for i, where in spans.items():
            if found.get(i) == 0:
                continue
            where.sort()
            merged = [where[0]]
            for a, b in where[1:]:  # overlapping stretches are one
                if a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            for a, b in merged:
                d, _ = myers(self.mask(i), len(self.items[i]), text[a:b])
                if d <= self.k[i] and d < found.get(i, d + 1):
                    found[i] = d
        return found


def blocks(items: DataFrame, size: int = BLOCK) -> Iterator[tuple[list, list[str]]]:
    """(item_ids, normal texts) of at most `size` characters, or of one item."""
    ids, texts, held = [], [], 0
    for r in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        t = normal(r["text"])
        if t:
            if texts and held + len(t) > size:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(r["item_id"])
            texts.append(t)
            held += len(t)
    if texts:
        yield ids, texts


_built: dict[int, Matcher] = {}


def _matcher(sent) -> Matcher:
    """One automaton a worker and broadcast."""
    if sent.id not in _built:
        _built.clear()
        _built[sent.id] = Matcher(sent.value)
    return _built[sent.id]


class _Sent:
    def __init__(self, spark, texts):
        self.b = spark.sparkContext.broadcast(texts)
        self.id = self.b._jbroadcast.id()

    def __getstate__(self):
        return {"b": self.b, "id": self.id}

    @property
    def value(self):
        return self.b.value


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, item_chars: every document with every item it holds."""
    spark = docs.sparkSession
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("distance", T.IntegerType()), T.StructField("item_chars", T.IntegerType())])
    out = spark.createDataFrame([], kind)
    narrow = docs.select("doc_id", "text")
    for ids, texts in blocks(items):
        uniq = sorted(set(texts))
        place = {t: i for i, t in enumerate(uniq)}
        owners: list[list] = [[] for _ in uniq]
        for i, t in zip(ids, texts):
            owners[place[t]].append(i)
        sent, named = _Sent(spark, uniq), spark.sparkContext.broadcast(owners)
        id_type = pa.int64() if kind["item_id"].dataType == T.LongType() else None

        def run(batches, sent=sent, named=named, id_type=id_type):
            match = _matcher(sent)
            for b in batches:
                rows = []
                for doc_id, t in zip(b.column(0), b.column(1)):
                    for i, d in match.search(normal(t.as_py())).items():
                        rows += [(doc_id.as_py(), x, d, len(match.items[i])) for x in named.value[i]]
                cols = list(zip(*rows)) if rows else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], id_type), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["doc_id", "item_id", "distance", "item_chars"])

        out = out.union(narrow.mapInArrow(lean(run), kind))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, whole and without a shuffle."""
    at, out = docs.columns.index("text"), docs
    for _, texts in blocks(items):
        sent = _Sent(docs.sparkSession, sorted(set(texts)))

        def run(batches, sent=sent):
            match = _matcher(sent)
            for b in batches:
                yield b.filter(pa.array([not match.search(normal(t.as_py())) for t in b.column(at)], pa.bool_()))

        out = out.mapInArrow(lean(run), docs.schema)
    return out
