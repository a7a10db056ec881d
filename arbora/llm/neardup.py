"""Near-duplicate search by a chosen-path set similarity join.

Every document is the set of its distinct w-word shingles. Equal sets are one class, so
exact copies cost one row each and no pairs. The classes are joined by T independent
trees: a node of a tree chooses coordinates of the minwise signature (1/threshold of them
on average, seeded by the node itself) and every chosen coordinate sends a class to the
child named by the minwise token found there. Roots divide the sets by size, with borders
of each tree's own, since sets that link have like sizes. Classes of similarity s survive
a level with probability s or more each, unrelated ones part at once.

A node first links its classes to a few of them, its leaders: a set of pairs that spans it,
some for each row, whatever the node's size. The links found are confirmed and contracted
to components, and nodes whose classes are all in one component are done. Of the others,
those of at most LIMIT classes are compared exhaustively, pairs of one component left out;
larger ones compare all classes with a new leader and branch on. After another contraction,
what is large and mixed still at the last level is compared exhaustively too, every class
outside a node's largest component with all others, so nothing is cut off. Comparing goes
slice against slice of a node, on signatures. Every link is
confirmed on the full shingle sets. A pair is missed if it meets in no tree, or if its
signatures agree by _SLACK deviations less than the threshold (about one in ten million);
links inside a component found earlier are not looked for again.

Defined results: null or empty texts have an empty set, are linked with nothing and are
kept; a text with fewer than w words has its whole word sequence as single shingle; texts
of any length are taken whole; rows repeated with one doc_id are documents of their own
texts; a null doc_id takes part in its class but names no component unless all of its
component are null (then component_id is null); extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Marks, components, discard, lean, row_key, settle, small_batches, tidy, words

WIDTH, THRESHOLD = 5, 0.8
#: Coordinates of the minwise signature; trees; leaders of a node of the first level; largest
#: small node; levels; classes in a slice of a node; powers of 1/threshold that the sizes of
#: one root span.
COORDINATES, TREES, LEADERS, LIMIT, LEVELS, SLICE, SIZES = 64, 12, 1, 16, 5, 256, 4
_SLACK = 5  # standard deviations by which an estimate may fall short of the threshold
_BYTES = 2 << 20  # of shingle sets in a slice or batch

_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one whole text."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(width, len(w))
    with np.errstate(over="ignore"):
        acc = np.full(len(w) - k + 1, np.uint64(k), np.uint64)
        for i in range(k):
            acc = _mix(acc * _STEP + h[i : len(w) - k + 1 + i])
    return np.unique(acc)


def _signature(s: np.ndarray) -> bytes:
    """The minwise tokens of one set: for each coordinate 32 bits of the least rank."""
    out = np.full(COORDINATES, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for lo in range(0, len(s), 4096):  # long texts in slices, so that memory is bounded
            out = np.minimum(out, _mix(s[lo : lo + 4096, None] * _A + _B).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32).tobytes()


def _profiles(width: int):
    def run(batches):
        for b in batches:
            n, dig, sig = [], [], []
            for text in b.column(3):
                s = shingles(text.as_py(), width)
                n.append(len(s))
                dig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(_signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(dig, pa.binary()), pa.array(sig, pa.binary())], ["k1", "k2", "doc_id", "n_shingles", "digest", "sig"])

    return run


def _sets(width: int, marks: Marks):
    """Full sets of the rows whose key the bitmap lets through, in batches of bounded size."""

    def run(batches):
        for b in batches:
            at, sets, size = [], [], 0

            def out():
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["k1", "k2", "shingles"])

            for i in np.nonzero(marks.has(b.column(0)))[0].tolist():
                at.append(i)
                sets.append(shingles(b.column(2)[i].as_py(), width))
                size += sets[-1].nbytes
                if size >= _BYTES:
                    yield out()
                    at, sets, size = [], [], 0
            if at:
                yield out()

    return run


def _coordinate(node: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(salt)), F.lit(COORDINATES)).cast("int")


def _token(sig: Column, at: Column) -> Column:
    return sig.substr(at * 4 + 1, F.lit(4))


def _children(rows: DataFrame, threshold: float) -> DataFrame:
    """(node, c) one level down from (node, c, sig): one chosen coordinate, and another one
    in the share of nodes that makes 1/threshold on average."""
    more = (1 / threshold - 1) * 10**6
    first = F.xxhash64("node", F.lit(1), _coordinate(F.col("node"), 1), _token(F.col("sig"), _coordinate(F.col("node"), 1)))
    second = F.when(
        F.pmod(F.xxhash64("node", F.lit(7)), F.lit(10**6)) < more,
        F.xxhash64("node", F.lit(2), _coordinate(F.col("node"), 2), _token(F.col("sig"), _coordinate(F.col("node"), 2))),
    )
    return rows.select(F.explode(F.filter(F.array(first, second), lambda x: x.isNotNull())).alias("node"), "c")


def _open(rows: DataFrame, comp: DataFrame | None, salt: int, leaders: int = 1) -> DataFrame:
    """The rows of nodes that are not done, with the node's `leaders`, classes picked by hash (of its largest component), and given components (comp) with the class's `component`, the node's largest one
    (`most`), its size `n` and `n_odd`, the classes outside the largest component. A node is
    done with a single class or component. All is pre-aggregated by map tasks."""
    lead = lambda *cols: [F.min(F.struct(F.xxhash64("node", "c", F.lit(LEADERS * salt + i)).alias("h"), *cols)).alias(f"l{i}") for i in range(leaders)]
    all_ = [f"l{i}" for i in range(leaders)]
    if comp is None:
        size = rows.groupBy("node").agg(F.count("*").alias("n"), *lead("c")).where("n > 1")
        return settle(rows.join(size.select("node", F.array(*all_).alias("leaders")), "node"))
    rows = rows.join(comp, "c", "left").withColumn("component", F.coalesce("component", "c"))
    part = rows.groupBy("node", "component").agg(F.count("*").alias("k"), *lead("c", "component"))
    # leaders are of the largest component: only classes outside it are compared with them
    whole = part.groupBy("node").agg(F.max(F.struct("k", "component", *all_)).alias("top"), F.sum("k").alias("n"))
    whole = whole.select("node", "n", (F.col("n") - F.col("top.k")).alias("n_odd"), F.col("top.component").alias("most"), F.array(*[F.col(f"top.{x}") for x in all_]).alias("leaders")).where("n_odd > 0")
    return settle(rows.join(whole, "node"))


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _to_leaders(rows: DataFrame, leaders: int = 1) -> DataFrame:
    """Each class with the leaders of its node, where they are not in one component."""
    own = "component" if "component" in rows.columns else "c"
    lead = [rows.select("c", F.col(own).alias("own"), F.get("leaders", F.lit(i)).alias("leader")).where(f"own <> leader.{own}") for i in range(leaders)]
    return _union([_ordered(x, "leader.c", "c") for x in lead])


def _agreement(x, y):
    """Estimated similarity: the share of equal coordinates."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), F.lit(0), lambda acc, i: acc + (_token(x, i) == _token(y, i)).cast("int"))
    return same / F.lit(float(COORDINATES))


def _least(threshold: float) -> float:
    return threshold - _SLACK * math.sqrt(threshold * (1 - threshold) / COORDINATES)


def _full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(c, shingles) of the classes in `ids` (c, k1, k2: a row of the class), settled."""
    marks = Marks.of(ids)
    text = docs.select(*row_key(), F.col("text").cast("binary").alias("text"))
    sets = text.mapInArrow(lean(_sets(width, marks)), "k1 long, k2 long, shingles array<long>")
    return settle(sets.join(ids, ["k1", "k2"]).select("c", "shingles").dropDuplicates(["c"]))


def _confirm(docs: DataFrame, reps: DataFrame, pairs: DataFrame | None, likely: DataFrame | None, width: int, threshold: float) -> DataFrame | None:
    """The candidate pairs of at least the threshold, decided on full sets; None if there
    are no candidates. Those of `likely` have passed the comparison of sizes and signatures."""
    p = likely
    if pairs is not None:
        sig = reps.select("c", "sig", "n_shingles")
        j = pairs.distinct().join(sig.toDF("a", "sa", "na"), "a").join(sig.toDF("b", "sb", "nb"), "b")
        j = j.where((F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & (_agreement(F.col("sa"), F.col("sb")) >= _least(threshold))).select("a", "b")
        p = j if likely is None else j.union(likely).distinct()
    p = settle(p)
    if p.isEmpty():
        discard(p)
        return None
    ids = settle(reps.join(p.select("a").union(p.select("b")).distinct().toDF("c"), "c", "left_semi").select("c", "k1", "k2"))
    sets = _full_sets(docs, ids, width)
    j = p.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    both = F.size(F.array_intersect("x", "y"))
    per = round(threshold * 100)
    links = settle(j.where(100 * both >= per * (F.size("x") + F.size("y") - both)).select("a", "b"))
    for t in (p, ids, sets):
        discard(t)
    return links


def _labels(links: DataFrame) -> DataFrame:
    """(c, component): the smallest class within three links. Classes of one label are
    connected; that is all that contraction needs, and costs fewer rounds than components."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.union(both.select("v", "u"))
    label = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l"))
    for _ in range(2):
        near = both.join(label.toDF("v", "l"), "v").select("u", "l").union(label)
        label = near.groupBy("u").agg(F.min("l").alias("l"))
    return settle(label.toDF("c", "component"))


def _members(column: pa.ListArray, i: int, *names: str) -> list:
    m = column.slice(i, 1).flatten()
    return [m.field(x) if x == "shingles" else m.field(x).to_numpy() if x != "sig" else np.frombuffer(b"".join(m.field(x).to_pylist()), np.uint32).reshape(-1, COORDINATES) for x in names]


def _near(threshold: float, c, component, n, sig, ids, comps, size, table, most):
    """Of two slices of a node: for each class of the first the places of the likely partners
    in the second, of other components (a pair of two odd classes in one order only)."""
    twice = comps != most
    for k in range(len(c)):
        near = (comps != component[k]) & ~(twice & (ids < c[k])) & (np.minimum(size, n[k]) >= threshold * np.maximum(size, n[k]))
        at = np.nonzero(near)[0]
        yield at[(table[at] == sig[k]).mean(axis=1) >= _least(threshold)]


def _compare(threshold: float, pairs: bool):
    """Two slices of a node, on signatures: the likely pairs, or the classes in such pairs."""
    names = "c", "component", "n_shingles", "sig"

    def run(batches):
        for b in batches:
            node, left, right = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i in range(b.num_rows):
                one, two = _members(b.column(1), i, *names), _members(b.column(2), i, *names)
                near = list(_near(threshold, *one, *two, b.column(3)[i].as_py()))
                if pairs:
                    left += [np.full(len(at), c) for c, at in zip(one[0], near)]
                    right += [two[0][at] for at in near]
                elif any(map(len, near)):
                    held = np.unique(np.concatenate((one[0][[len(at) > 0 for at in near]], two[0][np.concatenate(near)])))
                    node.append(np.full(len(held), b.column(0)[i].as_py()))
                    right.append(held)
            if pairs:
                a, b_ = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b_)), pa.array(np.maximum(a, b_))], ["a", "b"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *node])), pa.array(np.concatenate(right))], ["node", "c"])

    return run


def _verify(threshold: float):
    """Two slices of a node, on full sets: for each class of the first the first link to
    each other component."""
    per, names = round(threshold * 100), ("c", "component", "n_shingles", "sig", "shingles")

    def run(batches):
        for b in batches:
            links = set()
            for i in range(b.num_rows):
                (*one, x), (*two, y) = _members(b.column(1), i, *names), _members(b.column(2), i, *names)
                xs, x_at, ys, y_at = x.flatten().to_numpy(), x.offsets.to_numpy() - x.offsets[0].as_py(), y.flatten().to_numpy(), y.offsets.to_numpy() - y.offsets[0].as_py()
                for k, at in enumerate(_near(threshold, *one, *two, b.column(3)[i].as_py())):
                    own, done = np.sort(xs[x_at[k] : x_at[k + 1]]), set()
                    for j in at.tolist():
                        if two[1][j] not in done:
                            other = ys[y_at[j] : y_at[j + 1]]
                            place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                            both = int((own[place] == other).sum())
                            if 100 * both >= per * (len(own) + len(other) - both):
                                done.add(two[1][j])
                                links.add((int(min(one[0][k], two[0][j])), int(max(one[0][k], two[0][j]))))
            yield pa.RecordBatch.from_pylist([{"a": a, "b": c} for a, c in links], pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _sliced(full: DataFrame, columns: list[str], size: Column) -> DataFrame:
    """node, odd, all, most: every slice of the classes outside the largest component of a
    node beside every slice of the node, so that no task holds a large one. size: of a row,
    as a share of a slice."""
    per = full.groupBy("node").agg(F.sum(size).alias("all_"), F.sum(F.when(F.col("component") != F.col("most"), size)).alias("odd_"))
    full = full.join(per, "node")
    packed = F.collect_list(F.struct(*columns))

    def part(total: str):
        return F.pmod(F.xxhash64("c"), F.ceil(total).cast("long")).alias("slice")

    every = full.groupBy("node", part("all_"), "most").agg(packed.alias("all")).drop("slice")
    odd = full.where("component <> most").groupBy("node", part("odd_")).agg(packed.alias("odd")).drop("slice")
    return odd.join(every, "node").select("node", "odd", "all", "most")


def _likely(reps: DataFrame, rows: DataFrame, threshold: float, pairs: bool = True) -> DataFrame:
    """The likely pairs of whole nodes, or (node, c) of all classes in such pairs."""
    full = rows.select("node", "c", "component", "most").join(reps.select("c", "sig", "n_shingles"), "c")
    dealt = _sliced(full, ["c", "component", "n_shingles", "sig"], F.lit(1.0 / SLICE))
    return dealt.mapInArrow(lean(_compare(threshold, pairs)), "a long, b long" if pairs else "node long, c long").distinct()


def _exhaust(docs: DataFrame, reps: DataFrame, rows: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links of nodes that stay large and mixed, on full sets: every class outside a node's
    largest component against all others. Only links come out, one for each class and other
    component of a slice, so that nodes of very many unlinked pairs make no rows."""
    held = settle(_likely(reps, rows, threshold, pairs=False))
    ids = settle(reps.join(held.select("c").distinct(), "c", "left_semi").select("c", "k1", "k2"))
    sets = _full_sets(docs, ids, width)
    full = rows.select("node", "c", "component", "most").join(held, ["node", "c"]).join(reps.select("c", "sig", "n_shingles"), "c").join(sets, "c")
    dealt = _sliced(full, ["c", "component", "n_shingles", "sig", "shingles"], F.col("n_shingles") * 8.0 / _BYTES + 1.0 / SLICE)
    with small_batches(docs.sparkSession, 8):
        links = settle(dealt.mapInArrow(lean(_verify(threshold)), "a long, b long").distinct())
    for t in (held, ids, sets):
        discard(t)
    return links


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def _links(docs: DataFrame, reps: DataFrame, width: int, threshold: float) -> DataFrame | None:
    """Links (a, b) that connect the classes of each component; None if there are none."""
    # a tree has a root for each range of set sizes: sets that link differ in size by less
    # than the threshold, and the borders of a range differ from tree to tree
    tree = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(TREES).cast("long"))).alias("tree")
    steps = F.log("n_shingles") / math.log(1 / threshold) / SIZES
    roots = reps.select(tree, "c", "sig", steps.alias("steps")).select(F.xxhash64("tree", F.floor(F.col("steps") + F.col("tree") * 0.6180339887 % 1)).alias("node"), "c", "sig")
    sig = reps.select("c", "sig")
    rest = _open(_children(roots, threshold), None, 0, LEADERS)
    links = _confirm(docs, reps, _to_leaders(rest, LEADERS), None, width, threshold)
    comp = _labels(links) if links is not None else None

    def again(rows: DataFrame, salt: int) -> DataFrame:
        """What is open of these rows by the links found so far."""
        none = reps.select("c", F.col("c").alias("component")).limit(0)
        return _open(rows.select("node", "c"), none if comp is None else comp, salt)

    tidy(docs.sparkSession)
    old, rest = rest, again(rest, 1)
    discard(old)
    held, found = [rest], []
    for level in range(2, LEVELS + 1):
        large = rest.where(F.col("n") > LIMIT)
        if large.isEmpty():
            break
        found.append(_to_leaders(large))
        rest = again(_children(large.select("node", "c").join(sig, "c"), threshold), level)
        held.append(rest)
        tidy(docs.sparkSession)
    small = _union([t.where(F.col("n") <= LIMIT) for t in held])
    likely = None if small.isEmpty() else _likely(reps, small, threshold)
    large = rest.where(F.col("n") > LIMIT)

    def add(new: DataFrame | None) -> None:
        nonlocal links
        links = new if links is None else links if new is None else links.union(new)

    if found or likely is not None:
        new = _confirm(docs, reps, _union(found) if found else None, likely, width, threshold)
        add(new)
        tidy(docs.sparkSession)
        if not large.isEmpty():
            if new is not None:
                # what a component is linked by need not be walked again
                old, comp = comp, _labels(new if comp is None else comp.toDF("a", "b").where("a <> b").union(new))
                discard(old)
            mixed = again(large, LEVELS + 1)
            if not mixed.isEmpty():
                add(_exhaust(docs, reps, mixed, width, threshold))
            discard(mixed)
    for t in held:
        discard(t)
    if comp is not None:
        discard(comp)
    return links


def _labelled(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """k1, k2, doc_id, n_shingles, component (of its classes; null without shingles) and
    component_id of every row of docs."""
    id_type = docs.schema["doc_id"].dataType
    kind = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("doc_id", id_type), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType())])
    prof = settle(docs.select(*row_key(), "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(_profiles(width)), kind))
    row = F.min(F.struct("k1", "k2"))
    reps = prof.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"), row.alias("row"))
    reps = settle(reps.select(F.monotonically_increasing_id().alias("c"), "digest", "rep", "sig", "n_shingles", "row.k1", "row.k2"))
    links = _links(docs, reps, width, threshold)
    classes = reps.select("digest", "rep", F.col("c").alias("component"), F.col("rep").alias("component_id"))
    if links is not None:
        comp = components(links, "a", "b").withColumnRenamed("node", "c")
        tidy(docs.sparkSession)
        own = reps.select("c", "digest", "rep").join(comp, "c")
        named = own.groupBy("component").agg(F.min("rep").alias("component_id"))
        linked = own.join(named, "component").select("digest", "component", "component_id")
        alone = reps.join(comp, "c", "left_anti").select("digest", F.col("c").alias("component"), F.col("rep").alias("component_id"))
        classes = alone.union(linked)
    classes = classes.select("digest", "component", "component_id")
    joined = prof.where("digest is not null").join(classes, "digest").select("k1", "k2", "doc_id", "n_shingles", "component", "component_id")
    empty = prof.where("digest is null").select("k1", "k2", "doc_id", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return joined.union(empty)


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of at least
    the threshold), kept."""
    out = _labelled(docs, width, threshold)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs of which one stays of each component: that of the smallest doc_id
    (null last), of several texts with it the first by a hash, of several rows with it and
    the text the first by a hash of all columns. Rows without words all stay, and so do all
    rows that are linked with nothing, whatever their doc_id. All columns are kept."""
    rows = settle(_labelled(docs, width, threshold).where("component is not null").select("k1", "k2", "doc_id", "component"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "k1", "k2")).alias("first")
    groups = rows.groupBy("component").agg(first, F.count("*").alias("n")).where("n > 1")
    odd = rows.join(groups, "component").select("k1", "k2", ((F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))).alias("__kept"))
    odd = settle(odd.distinct())  # rows of groups; all others stay without a join
    tidy(docs.sparkSession)
    marks = Marks.of(odd)
    keyed = docs.select("*", *(k.alias(f"__k{i}") for i, k in enumerate(row_key(), 1)))

    def part(marked: bool, names: int):
        def run(batches):
            for b in batches:
                yield b.select(b.schema.names[:names]).filter(pa.array(marks.has(b.column(b.num_columns - 2)) == marked))

        return run

    stay = keyed.mapInArrow(lean(part(False, len(docs.columns))), docs.schema)
    doubt = keyed.mapInArrow(lean(part(True, len(keyed.columns))), keyed.schema)
    doubt = doubt.join(odd.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), ["__k1", "__k2"], "left").where("__kept is null or __kept")
    let_in = doubt.where("__kept is null").select(*docs.columns)
    w = Window.partitionBy("__k1", "__k2").orderBy(F.xxhash64(*docs.columns))
    one = doubt.where("__kept").withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*docs.columns)
    return stay.unionByName(let_in).unionByName(one)
