import pytest
from pyspark.sql import functions as F

from arbora.llm import neardup
from arbora.llm.common import components

from .helpers import frame, rows, words


def brute(data, k, per=80):
    sets = {}
    for i, t, *_ in data:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= per * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, data, k):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, data, extra=True), width=k).collect()}
    assert got == brute(data, k)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    check(spark, rows(seed), 4)


def test_large_group_of_near_copies(spark):
    import random

    rng = random.Random(5)
    base = words(rng, 90).split()
    data = []
    for i in range(70):  # more than a node holds, some too far from each other
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(9)}"
        data.append((i, " ".join(w), "en", "s", 0))
    check(spark, data, 4)


def test_empty_table_and_null_ids(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    data = [(None, "a b c d e f", "en", "s", 0), (4, "a b c d e f", "en", "s", 0), (None, None, "en", "s", 0)]
    got = neardup.near_duplicates(frame(spark, data)).collect()
    assert len(got) == 3 and {r["component_id"] for r in got if r["n_shingles"]} == {4}
    assert neardup.drop_near_duplicates(frame(spark, data)).count() >= 1


def test_deep_nodes_are_exhausted(spark, monkeypatch):
    """With one level and tiny nodes and slices, all is left to the exhaustive comparison."""
    import random

    rng = random.Random(8)
    base = words(rng, 60).split()
    data = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(99)}"
        data.append((i, " ".join(w), "en", "s", 0))
    for name, value in (("LEVELS", 1), ("LIMIT", 2), ("LEADERS", 1), ("SLICE", 5)):
        monkeypatch.setattr(neardup, name, value)
    check(spark, data, 4)


def test_one_id_with_several_texts(spark):
    rng = __import__("random").Random(4)
    t1, t2, t3 = (words(rng, 40) for _ in range(3))
    data = [(1, t1, "en", "s", 0), (1, t2, "en", "s", 0), (2, t2, "en", "s", 0), (3, t1, "en", "s", 0), (4, t3, "en", "s", 0), (4, t3, "en", "s", 0), (None, t3, "en", "s", 0), (None, "", "en", "s", 0), (None, "", "en", "s", 0)]
    got = neardup.drop_near_duplicates(frame(spark, data)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["text"]) == sorted([(1, t1), (1, t2), (4, t3)])
    assert sum(r["text"] == "" for r in got) == 2
    only_null = [(None, t1, "en", "s", 0), (None, t1, "en", "s", 0), (None, t1 + " x", "en", "s", 0)]
    assert neardup.drop_near_duplicates(frame(spark, only_null)).count() == 1


def test_very_long_text(spark):
    rng = __import__("random").Random(9)
    long = words(rng, 60_000)
    data = [(1, long, "en", "s", 0), (2, long + " end", "en", "s", 0), (3, " ".join(long.split()[:30_000]), "en", "s", 0)]
    check(spark, data, 4)


def test_drop_keeps_one_of_each(spark):
    data = rows(2)
    kept = {r["doc_id"] for r in neardup.drop_near_duplicates(frame(spark, data), width=4).collect()}
    assert kept == {i for i, (_, c) in brute(data, 4).items() if i == c}
    twice = data + data
    wordless = sum(not (t or "").split() for _, t, *_ in data)
    assert neardup.drop_near_duplicates(frame(spark, twice), width=4).count() == len(kept) + wordless


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7), (None, 3)], "u long, v long")
    got = dict(components(e).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(e.where(F.lit(False))).count() == 0
