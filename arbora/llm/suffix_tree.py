"""Language-model scoring by a probabilistic suffix tree.

Tokens are the lower-cased words of a text and one end token. The tree's root is the
add-one distribution over the training tokens and one class of unseen ones. A state is a
context of any length that occurs CONTEXT times or more and whose next-token distribution
diverges from that of its parent (the context without its first token) by DIVERGENCE nats or
more. It keeps the counts k of the tokens that follow it LEAST times or more; P(x | s) =
(k + t P(x | parent)) / (held + t), held the sum of the kept counts and t the occurrences not
kept and one for each kept token, so that every distribution sums to one. A token is scored in
the state of the longest suffix of the text before it.

The tree is grown depth by depth until no state is found, however long contexts get. A
context is tried if its parent is a state and it is itself a kept gram: the state of all but
its last token has kept that token, so that the tree can be walked from left to right. A
parent whose occurrences but for LEAST - 1 go on with one token is not lengthened: longer
contexts say the same.

All counts cover all training texts, and CONTEXT and LEAST are absolute numbers, so the tree
grows with the input. It is a distributed table: tokens, contexts and grams go by 64-bit codes
(polynomials in the tokens' hashes), a depth's grams are counted and joined to the grams one
token shorter. A text's score is a sum of weights by code: of a token its base score, of a kept
token what it adds to its state's share for tokens it has not kept, and of either, where its
gram is itself a state, that state's share, which the next token takes. So every place asks
for its token and for the grams it ends, longer ones only where the shorter one is kept.

The most frequent codes, a share of all and at most HEAD, are broadcast. The others lie packed
by ranges of codes; each block of texts sends a range its sorted codes and gets back sums for
its texts, one slice of the texts after the other, so that only a slice is on disk at a time.
Bitmaps of at most _BITS bits for each depth keep codes that cannot match from the shuffles:
grams too rare at depth one (counted by truncated codes, packed by task), grams of rare ones,
codes without a weight. What they let in wrongly, exact counts, joins and searches drop; in a
corpus so large that the bitmaps fill up, more is shuffled, with the same result.

Defined results: null and empty texts are the end token alone; without training rows every
count is 0; a null doc_id counts as the empty text in the split; repeated rows are scored
one by one; very long texts are taken whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, lean, remainder, settle, tidy

CONTEXT, LEAST, DIVERGENCE, HEAD = 32, 4, 0.01, 1_500_000
END = np.uint64(xxhash.xxh64_intdigest(b" "))  # no word holds a space
_BITS = 1 << 27  # of a bitmap, at most
_MIX = np.uint64(0x9E3779B97F4A7C15)  # spreads codes over a table
_K = np.uint64(0x9E3779B97F4A7C13)  # base of the polynomials; odd, so it can be divided by
_BY_K = np.uint64(pow(int(_K), -1, 1 << 64))
_FLUSH = 1_000_000  # tokens that a task pre-aggregates at once
_HELD = 1_500_000  # grams that a task holds
_CHUNK = 250_000  # tokens that are scored at once
_PART = 1_000_000  # of which about so many meet in a task that counts truncated codes
_WHOLE = 4  # grams of at most so many tokens are made at all places, longer ones where the shorter ones are kept
_SPREAD = 1 << 22  # tokens of whose grams a range is counted at once
_SHARE = 16  # one code of so many is broadcast, of large trees
_ALL = 1 << 16  # so many are in any case
_RANGE = 1 << 19  # codes that are not broadcast meet in ranges of about so many
_ASKED = 1_000_000  # codes that a block asks for at once
_SLICES = 8  # of the texts; they are scored one after the other
_SLICED = 1_000_000  # tokens of a slice, at least


def token_codes(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all tokens of a column of texts, and the number of tokens of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    flat, off = lists.flatten(), lists.offsets.to_numpy()
    row = np.repeat(np.arange(len(lists)), np.diff(off))
    d = flat.dictionary_encode()
    own = np.fromiter(map(xxhash.xxh64_intdigest, d.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(d.dictionary))
    word = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    codes, row = own[d.indices.to_numpy()][word] if len(own) else np.empty(0, np.uint64), row[word]
    out = np.full(len(codes) + len(lists), END)
    out[np.arange(len(codes)) + row] = codes
    return out, np.bincount(row, minlength=len(lists)) + 1


def _code(batches):
    """Texts as packed 64-bit codes of their tokens."""
    for b in batches:
        codes, n = token_codes(b.column(2))
        end = np.concatenate(([0], np.cumsum(n * 8)))
        packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(end.astype(np.int64).tobytes()), pa.py_buffer(codes.tobytes())])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed.cast(pa.binary())], ["doc_id", "held", "codes"])


def _flat(packed: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a column of packed ones, and the number of each row's."""
    off = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = packed.buffers()[2]
    return np.frombuffer(data, np.uint64, data.size // 8)[off[0] // 8 : off[-1] // 8] if data is not None and data.size else np.empty(0, np.uint64), np.diff(off) // 8


def _gathered(batches):
    """Column 0 of batches, put together to about _FLUSH tokens."""
    held, size = [], 0
    for b in batches:
        flat, n = _flat(b.column(0))
        held.append((flat, n))
        size += len(flat)
        if size >= _FLUSH:
            yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held, size = [], 0
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def _count(batches):
    """Pre-aggregated (code, c) of a task's tokens."""
    for flat, _ in _gathered(batches):
        code, c = np.unique(flat, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(c)], ["code", "c"])


class Bits:
    """A bitmap of bounded size that lets codes through: all that were put in, few others."""

    def __init__(self, expected: int):
        self.size = min(_BITS, 1 << max(12, (8 * int(expected)).bit_length()))
        self.words = np.zeros(self.size // 64, np.uint64)

    def add(self, codes: DataFrame) -> None:
        low = F.col("code").bitwiseAND(F.lit(self.size - 1))
        got = codes.select(F.shiftright(low, 6).alias("w"), F.expr("shiftleft(1L, cast(code & 63 as int))").alias("x")).groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
        self.words[got["w"].to_numpy()] |= got["x"].to_numpy().view(np.uint64)

    def has(self, code: np.ndarray) -> np.ndarray:
        at = code & np.uint64(self.size - 1)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


class Often:
    """Which grams of depth one occur LEAST times or more, by their first bits: those that
    do, and few others. Each task packs the sorted distinct codes of its grams by ranges of
    codes; a range is counted in one task, whatever grams are frequent."""

    def __init__(self, n: int):
        self.bits = min(64, max(16, int(n).bit_length() + 8))  # of a truncated code
        self.size = min(_BITS.bit_length() - 1, self.bits)  # log2 of the bitmap
        self.parts = min(self.size - 3, max(0, (n // _PART).bit_length()))  # log2 of the ranges
        self.local = np.uint64(self.bits - self.parts)
        self.bitmap = np.zeros(0, np.uint8)

    def codes(self, gram: np.ndarray) -> np.ndarray:
        return gram >> np.uint64(64 - self.bits)

    def fill(self, train: DataFrame, sent) -> None:
        def packed(batches):
            for flat, n in _gathered(batches):
                _, gram, _ = _lengthened(flat, n, *sent.value)
                code, k = np.unique(self.codes(gram), return_counts=True)
                part = (code >> self.local).astype(np.int64)
                cut = np.concatenate(([0], np.nonzero(np.diff(part))[0] + 1, [len(part)])) if len(part) else [0]
                rows = {"part": [], "gaps": [], "k": []}
                for lo, hi in zip(cut, cut[1:]):
                    own = code[lo:hi] & np.uint64((1 << int(self.local)) - 1)
                    gaps = np.diff(own, prepend=np.uint64(0))
                    rows["part"].append(int(part[lo]))
                    rows["gaps"].append(gaps.view(np.uint8).reshape(-1, 8)[:, : (int(self.local) + 7) // 8].T.tobytes())  # zeros lie together
                    rows["k"].append(np.minimum(k[lo:hi], LEAST).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("part", pa.int64()), ("gaps", pa.binary()), ("k", pa.binary())]))

        def marked(table: pa.Table) -> pa.Table:
            width, codes, ks = (int(self.local) + 7) // 8, [], []
            for gaps, k in zip(table["gaps"].to_pylist(), table["k"].to_pylist()):
                wide = np.zeros((len(k), 8), np.uint8)
                wide[:, :width] = np.frombuffer(gaps, np.uint8).reshape(width, -1).T
                codes.append(np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64))
                ks.append(np.frombuffer(k, np.uint8))
            code, k = np.concatenate(codes), np.concatenate(ks)
            order = np.argsort(code, kind="stable")
            code = code[order]
            first = np.concatenate(([True], code[1:] != code[:-1]))
            often = code[first][np.add.reduceat(k[order].astype(np.int64), np.nonzero(first)[0]) >= LEAST]
            bits = np.zeros(1 << (self.size - self.parts), bool)
            bits[(often >> np.uint64(self.bits - self.size)).astype(np.int64)] = True
            return pa.table({"part": table["part"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        got = train.mapInArrow(lean(packed), "part long, gaps binary, k binary").groupBy("part").applyInArrow(marked, "part long, bits binary").toArrow()
        self.bitmap = np.zeros(1 << (self.size - 3), np.uint8)
        wide = 1 << (self.size - self.parts - 3)
        for part, bits in zip(got["part"].to_pylist(), got["bits"]):
            self.bitmap[part * wide : (part + 1) * wide] = np.frombuffer(bits.as_py(), np.uint8)

    def has(self, gram: np.ndarray) -> np.ndarray:
        at = gram >> np.uint64(64 - self.size)
        return (self.bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _places(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _lengthened(flat: np.ndarray, n: np.ndarray, tried: Bits, opens: list[Bits]):
    """The codes of context, gram and gram without its first token of all places whose gram
    may count at the next depth. tried: contexts of that depth; opens: for each depth before it
    the kept grams, at first tokens."""
    depth = len(opens)
    first = min(depth, _WHOLE) - 1
    power = pow(int(_K), first, 1 << 64)
    run = _run(flat, first + 1)
    at = np.nonzero((_places(n) >= depth) & opens[first].has(run))[0]
    shorter = run[at]
    for j in range(first + 1, depth):
        power = power * int(_K) % (1 << 64)
        shorter = shorter + np.uint64(power) * flat[at - j]
        fits = opens[j].has(shorter)
        at, shorter = at[fits], shorter[fits]
    gram = shorter + np.uint64(power * int(_K) % (1 << 64)) * flat[at - depth]
    context = (gram - flat[at]) * _BY_K
    fits = tried.has(context)
    return context[fits], gram[fits], shorter[fits]


def _run(flat: np.ndarray, tokens: int) -> np.ndarray:
    """For each place the code of so many tokens that end there; right from place tokens - 1 of a text."""
    out, power = flat.copy(), 1
    for j in range(1, tokens):
        power = power * int(_K) % (1 << 64)
        out[j:] += np.uint64(power) * flat[:-j]
    return out


_GRAMS = "part int, gaps binary, context binary, shorter binary, k binary"


def _grams(sent, ranges: int):
    """Pre-aggregated counts of the grams of a depth over training texts, packed by ranges."""

    def run(batches):
        tried, opens, often = sent.value
        held, size = [], 0

        def out(code, context, shorter, k):
            rows = [(p, _gaps(code[lo:hi]), _planes(context[lo:hi]), _planes(shorter[lo:hi]) if len(opens) > 1 else b"", _planes(k[lo:hi])) for p, lo, hi in _cuts(code, ranges)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int32()] + [pa.binary()] * 4)], ["part", "gaps", "context", "shorter", "k"])

        for flat, n in _gathered(batches):
            context, gram, shorter = _lengthened(flat, n, tried, opens)
            if often is not None:
                fits = often.has(gram)
                context, gram, shorter = context[fits], gram[fits], shorter[fits]
            code, first, k = np.unique(gram, return_index=True, return_counts=True)
            held.append((code, context[first], shorter[first], k.astype(np.int64)))
            size += len(code)
            if size > _HELD:
                held = [_together(held)]
                size = len(held[0][0])
                if size > _HELD // 2:
                    yield out(*held[0])
                    held, size = [], 0
        if held:
            yield out(*_together(held))

    return run


def _together(held: list):
    """Grams of several lists, each once, with the sum of their counts."""
    code, context, shorter, k = (np.concatenate(x) for x in zip(*held))
    if not len(code):
        return code, context, shorter, k
    order = np.argsort(code)
    code = code[order]
    first = np.nonzero(np.concatenate(([True], code[1:] != code[:-1])))[0]
    one = order[first]
    return code[first], context[one], shorter[one], np.add.reduceat(k[order], first)


def _counted(t: pa.Table) -> pa.Table:
    """The grams of a range that occur LEAST times or more."""
    held = []
    for r in t.to_pylist():
        code, context = _of_gaps(r["gaps"]), _of_planes(r["context"], np.uint64)
        shorter = _of_planes(r["shorter"], np.uint64) if r["shorter"] else code - _K * context  # one token
        held.append((code, context, shorter, _of_planes(r["k"], np.int64)))
    code, context, shorter, k = _together(held)
    fits = k >= LEAST
    return pa.table([x[fits].view(np.int64) for x in (code, context, shorter, k)], ["code", "context", "shorter", "k"])


class Table:
    """Places of 64-bit codes in an array of distinct ones, by open addressing."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.shift = np.uint64(64 - max(4, (4 * max(1, len(code))).bit_length()))
        self.slot = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        left, at = np.arange(len(code), dtype=np.int32), self._first(code)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            missed = self.slot[at] != left
            left, at = left[missed], (at[missed] + 1) % len(self.slot)

    def _first(self, code: np.ndarray) -> np.ndarray:
        return ((code * _MIX) >> self.shift).astype(np.int64)

    def find(self, code: np.ndarray) -> np.ndarray:
        """Places of the codes, else -1."""
        if not len(self.code):
            return np.full(len(code), -1, np.int32)
        at = self._first(code)
        out = self.slot[at]
        rows = np.nonzero((out >= 0) & (self.code[out] != code))[0]
        at = at[rows]
        while len(rows):
            at = (at + 1) % len(self.slot)
            held = self.slot[at]
            out[rows] = held
            go = (held >= 0) & (self.code[held] != code[rows])
            rows, at = rows[go], at[go]
        return out


def _looked_up(flat: np.ndarray, n: np.ndarray, known: list[Bits]):
    """(places, codes) of everything whose weight the score may hold: tokens, and the grams
    that end there. known: the codes of each depth; what it keeps of a gram it has kept of the
    gram without its first token."""
    yield None, flat
    place = _places(n)
    at = np.nonzero(place >= 1)[0]
    place, gram, power = place[at], flat[at], 1
    for d, kept in enumerate(known[1:], 1):
        power = power * int(_K) % (1 << 64)
        gram = gram + np.uint64(power) * flat[at - d]
        fits = kept.has(gram)
        at, place, gram = at[fits], place[fits], gram[fits]
        if not len(at):
            break
        yield at, gram
        fits = place >= d + 1
        at, place, gram = at[fits], place[fits], gram[fits]


def _chunks(packed: pa.BinaryArray):
    """(rows from, to, codes, their numbers) of pieces of a batch of about _CHUNK tokens."""
    flat, n = _flat(packed)
    end = np.cumsum(n)
    lo = 0
    while lo < len(n):
        start = end[lo] - n[lo]
        hi = max(lo + 1, int(np.searchsorted(end, start + _CHUNK, "right")))
        yield lo, hi, flat[start : end[hi - 1]], n[lo:hi]
        lo = hi


def _planes(x: np.ndarray) -> bytes:
    """An array byte by byte: those that are zero lie together."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _of_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _cuts(code: np.ndarray, ranges: int):
    """(range, from, to) of sorted codes; ranges: their log2."""
    part = (code >> np.uint64(64 - ranges)).astype(np.int64) if ranges else np.zeros(len(code), np.int64)
    cut = np.concatenate(([0], np.nonzero(np.diff(part))[0] + 1, [len(part)])) if len(part) else [0]
    return [(int(part[lo]), lo, hi) for lo, hi in zip(cut, cut[1:])]


def _gaps(code: np.ndarray) -> bytes:
    return _planes(np.diff(code, prepend=np.uint64(0)))


def _of_gaps(data: bytes) -> np.ndarray:
    return np.cumsum(_of_planes(data, np.uint64), dtype=np.uint64)


def _merged(code: np.ndarray, c: np.ndarray, gain: np.ndarray):
    """Sorted distinct codes with the sums of their counts as tokens and of their gains."""
    if not len(code):
        return code, c, gain
    order = np.argsort(code)
    code, c, gain = code[order], c[order], gain[order]
    first = np.nonzero(np.concatenate(([True], code[1:] != code[:-1])))[0]
    return code[first], np.add.reduceat(c, first), np.add.reduceat(gain, first)


_PACKED = "part int, gaps binary, c binary, gain binary"


def _pack(code: np.ndarray, c: np.ndarray, gain: np.ndarray, ranges: int) -> dict:
    code, c, gain = _merged(code, c, gain)
    cuts = _cuts(code, ranges)
    return {
        "part": pa.array([p for p, _, _ in cuts], pa.int32()),
        "gaps": pa.array([_gaps(code[lo:hi]) for _, lo, hi in cuts], pa.binary()),
        "c": pa.array([_planes(c[lo:hi]) for _, lo, hi in cuts], pa.binary()),
        "gain": pa.array([_planes(gain[lo:hi]) for _, lo, hi in cuts], pa.binary()),
    }


def _unpack(t: pa.Table):
    rows = t.select(["gaps", "c", "gain"]).to_pylist()
    one = [(_of_gaps(r["gaps"]), _of_planes(r["c"], np.int64), _of_planes(r["gain"], np.float64)) for r in rows]
    return [np.concatenate(x) for x in zip(*one)] if one else [np.empty(0, k) for k in (np.uint64, np.int64, np.float64)]


def _by_range(rest: DataFrame, ranges: int) -> DataFrame:
    """Codes, counts and gains packed by ranges of codes, each in one row."""

    def packed(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= _ASKED:
                yield batch(held)
                held, size = [], 0
        if size:
            yield batch(held)

    def batch(held):
        t = pa.Table.from_batches(held)
        return pa.RecordBatch.from_pydict(_pack(t["code"].to_numpy().view(np.uint64), t["c"].to_numpy(), t["gain"].to_numpy(), ranges))

    def together(t: pa.Table) -> pa.Table:
        return pa.table(_pack(*_unpack(t), ranges))

    return rest.mapInArrow(lean(packed), _PACKED).groupBy("part").applyInArrow(together, _PACKED)


def _asked(sent, ranges: int):
    """For each block of texts (a batch) its sums over what is broadcast, in one row with the
    doc_ids, and for each range the sorted codes it asks for and their texts."""
    names = ["part", "block", "ids", "n", "known", "base", "gain", "gaps", "text"]
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 7

    def asks(block: int, code: list, text: list):
        code, text = np.concatenate(code), np.concatenate(text)
        order = np.argsort(code, kind="stable")
        code, text = code[order], text[order]
        rows = [(p, block, None, None, None, None, None, _gaps(code[lo:hi]), _planes(text[lo:hi])) for p, lo, hi in _cuts(code, ranges)]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        known, head, base, gain = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            block = b.column(2)[0].as_py()
            n_all, some, sums = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [np.zeros(b.num_rows), np.zeros(b.num_rows)]
            codes, texts, size = [], [], 0
            for lo, hi, flat, n in _chunks(b.column(1)):
                row = np.repeat(np.arange(hi - lo), n)
                n_all[lo:hi] = n
                for at, code in _looked_up(flat, n, known):
                    found = head.find(code)
                    hit = found >= 0
                    own = row if at is None else row[at]
                    mine, found = own[hit], found[hit]
                    sums[1][lo:hi] += np.bincount(mine, gain[found], hi - lo)
                    if at is None:
                        sums[0][lo:hi] += np.bincount(mine, base[found], hi - lo)
                        some[lo:hi] += np.bincount(mine, minlength=hi - lo)
                    rest = ~hit & known[0].has(code) if at is None else ~hit
                    codes.append(code[rest])
                    texts.append((own[rest] + lo).astype(np.uint32))
                    size += len(codes[-1])
                if size >= _ASKED:
                    yield asks(block, codes, texts)
                    codes, texts, size = [], [], 0
            if size:
                yield asks(block, codes, texts)
            ids = pa.BufferOutputStream()
            with pa.ipc.new_stream(ids, pa.schema([("doc_id", b.column(0).type)])) as out:
                out.write_batch(pa.RecordBatch.from_arrays([b.column(0)], ["doc_id"]))
            part = (block * int(_MIX) % (1 << 64)) >> (64 - ranges)
            row = [part, block, ids.getvalue().to_pybytes(), n_all.tobytes(), some.tobytes(), sums[0].tobytes(), sums[1].tobytes(), None, None]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    return run


_ANSWER = "block long, ids binary, n binary, known binary, base binary, gain binary, text binary"


def _answered(asked: pa.Table, held: pa.Table) -> pa.Table:
    """For what blocks ask of a range, sums for their texts."""
    own, c, gain = _unpack(held)
    base = np.log10(c + 1.0)
    out = []
    for r in asked.to_pylist():
        if r["ids"] is not None:
            out.append((r["block"], r["ids"], r["n"], r["known"], r["base"], r["gain"], None))
        elif len(own):
            code, text = _of_gaps(r["gaps"]), _of_planes(r["text"], np.uint32)
            at = np.searchsorted(own, code)
            at[at == len(own)] = 0
            hit = own[at] == code
            at, text = at[hit], text[hit]
            if len(at):
                text, to = np.unique(text, return_inverse=True)
                some = np.bincount(to, c[at] > 0).astype(np.int64)
                out.append((r["block"], None, None, _planes(some), _planes(np.bincount(to, base[at])), _planes(np.bincount(to, gain[at])), _planes(text)))
    kinds = [pa.int64()] + [pa.binary()] * 6
    names = ["block", "ids", "n", "known", "base", "gain", "text"]
    return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)


def _summed(t: pa.Table) -> pa.Table:
    """The texts of a block with the sums of all answers."""
    rows = t.to_pylist()
    whole = next(r for r in rows if r["ids"] is not None)
    known, base, gain = (np.frombuffer(whole[c], k).copy() for c, k in (("known", np.int64), ("base", np.float64), ("gain", np.float64)))
    for r in rows:
        if r["ids"] is None:
            text = _of_planes(r["text"], np.uint32)
            known[text] += _of_planes(r["known"], np.int64)
            base[text] += _of_planes(r["base"], np.float64)
            gain[text] += _of_planes(r["gain"], np.float64)
    ids = pa.ipc.open_stream(whole["ids"]).read_all()["doc_id"]
    return pa.table([ids, pa.array(np.frombuffer(whole["n"], np.int64)), pa.array(known), pa.array(base), pa.array(gain)], ["doc_id", "n_tokens", "known", "base", "gain"])


def _grown(grams: DataFrame, totals: DataFrame, above: DataFrame) -> DataFrame:
    """A depth's states: code, context, k, n, p, gain, unseen, open of every kept token.

    grams: code, context, shorter, k; totals: occurrences (n) of each context (code); above:
    P(token | parent) (p) of each gram without its first token (code)."""
    own = grams.groupBy("context").agg(F.sum("k").alias("held"), F.count("*").alias("kinds"), F.max("k").alias("top"))
    own = own.hint("shuffle_hash").join(totals.select(F.col("code").alias("context"), "n"), "context").withColumn("t", (F.col("n") - F.col("held") + F.col("kinds")).cast("double"))
    pairs = grams.hint("shuffle_hash").join(above.select(F.col("code").alias("shorter"), F.col("p").alias("q")), "shorter").join(own.hint("shuffle_hash"), "context")
    pairs = pairs.withColumn("p", (F.col("k") + F.col("t") * F.col("q")) / (F.col("held") + F.col("t")))
    # Kullback-Leibler divergence from the parent: over the kept tokens, and over all others,
    # which have the parent's distribution times one factor
    rest, before = 1 - F.sum("p"), 1 - F.sum("q")
    apart = F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))) + F.when((rest > 0) & (before > 0), rest * F.log(rest / before)).otherwise(0.0)
    states = pairs.groupBy("context").agg(apart.alias("apart")).where(F.col("apart") >= DIVERGENCE).select("context")
    unseen = F.log10(F.col("t") / (F.col("held") + F.col("t")))
    return pairs.join(states.hint("shuffle_hash"), "context").select("code", "context", "k", "n", "p", F.log10(F.col("p") / F.col("q")).alias("gain"), unseen.alias("unseen"), (F.col("n") - F.col("top") >= LEAST).alias("open"))


def _head(weights: DataFrame, most: int) -> int:
    """The least count of the broadcast codes: those above it are at most so many."""
    size = F.floor(F.log2("often") * 16).cast("int")
    total, least = 0, 0
    for r in weights.groupBy(size.alias("b")).agg(F.count("*").alias("n"), F.min("often").alias("low"), F.max("often").alias("high")).orderBy(F.desc("b")).collect():  # at most 16 rows a power of two
        total += r["n"]
        if total > most:
            return least or r["high"] + 1
        least = r["low"]
    return 0


def _bits(codes: DataFrame, size: int) -> Bits:
    out = Bits(size)
    out.add(codes)
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    id_type = docs.schema["doc_id"].dataType
    kind = T.StructType([T.StructField("doc_id", id_type), T.StructField("held", T.BooleanType()), T.StructField("codes", T.BinaryType())])
    coded = docs.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held"), "text").mapInArrow(lean(_code), kind)
    coded = settle(coded.withColumn("row", F.monotonically_increasing_id()).withColumn("slice", F.spark_partition_id() % _SLICES), "slice")
    train = coded.where("not held").select("codes")
    counts = settle(train.mapInArrow(lean(_count), "code long, c long").groupBy("code").agg(F.sum("c").alias("c")))
    n, kinds, several, many = (x or 0 for x in counts.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") >= LEAST), F.count_if(F.col("c") >= CONTEXT)).first())
    zero = F.lit(0.0)
    weights = counts.select("code", F.col("c").alias("often"), "c", zero.alias("gain"))
    above = counts.select("code", ((F.col("c") + 1) / F.lit(float(n + kinds + 1))).alias("p"))
    totals = counts.where(F.col("c") >= CONTEXT).select("code", F.col("c").alias("n"))
    tried, opens, known = _bits(totals, many), [_bits(counts.where(F.col("c") >= LEAST), several)], [_bits(counts, kinds)]
    tidy(spark)
    # fewer and larger tasks pre-aggregate more
    train = train.coalesce(max(sc.defaultParallelism, train.rdd.getNumPartitions() // 8))
    sent = sc.broadcast((tried, opens))
    often = Often(n)
    often.fill(train, sent)
    sent.destroy()
    tidy(spark)
    used = [counts]
    spread = max(4, (n // _SPREAD).bit_length())  # log2 of the ranges of grams
    while True:
        sent = sc.broadcast((tried, opens, often))
        grams = settle(train.mapInArrow(lean(_grams(sent, spread)), _GRAMS).groupBy("part").applyInArrow(_counted, "code long, context long, shorter long, k long"))
        sent.destroy()
        often = None
        tidy(spark)
        level = settle(_grown(grams, totals, above))
        discard(grams)
        used.append(level)
        tidy(spark)
        size, many = level.agg(F.count("*"), F.count_if(F.col("k") >= CONTEXT)).first()
        if not size:
            break
        totals, above = level.where(F.col("k") >= CONTEXT).select("code", F.col("k").alias("n")), level.where("open").select("code", "p")
        tried = _bits(totals, many)
        known.append(_bits(level, size))
        opens.append(known[-1])  # what is not lengthened, the join drops
        states = level.groupBy("context").agg(F.first("n").alias("n"), F.first("unseen").alias("unseen"))
        no = F.lit(0).cast("long")
        weights = weights.union(level.select("code", "k", no, F.col("gain") - F.col("unseen"))).union(states.select("context", "n", no, "unseen"))
    weights = settle(weights)  # a state is as frequent as its gram, so both go the same way
    for t in used:
        discard(t)
    tidy(spark)
    size = weights.count()
    least = _head(weights, min(HEAD, max(_ALL, size // _SHARE)))
    head = weights.where(F.col("often") >= least).select("code", "c", "gain").toArrow()
    code, c, gain = _merged(head["code"].to_numpy().view(np.uint64), head["c"].to_numpy(), head["gain"].to_numpy())
    del head
    ranges = max(4, (size // _RANGE).bit_length())  # their log2
    rest = settle(_by_range(weights.where(F.col("often") < least).select("code", "c", "gain"), ranges))
    discard(weights)
    tidy(spark)
    sent = sc.broadcast((known, Table(code), np.log10(c + 1.0), gain))
    kind = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(c, t) for c, t in (("n_tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("gain", T.DoubleType()))])
    asked = "part int, block long, ids binary, n binary, known binary, base binary, gain binary, gaps binary, text binary"
    out = None
    step = _SLICES if n < _SLICES * _SLICED else 1
    for k in range(0, _SLICES, step):
        texts = coded.where(F.col("slice").between(k, k + step - 1)).select("doc_id", "codes", "row")
        asks = texts.mapInArrow(lean(_asked(sent, ranges)), asked)
        answers = asks.groupBy("part").cogroup(rest.groupBy("part")).applyInArrow(_answered, _ANSWER)
        scored = settle(answers.groupBy("block").applyInArrow(_summed, kind))
        out = scored if out is None else out.union(scored)
        tidy(spark)
    sent.destroy()
    discard(coded)
    discard(rest)
    every = F.lit(float(np.log10(float(n + kinds + 1))))  # of each token; log10(c + 1) is 0 where c is
    base = F.col("base") - F.col("n_tokens") * every
    return out.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))
