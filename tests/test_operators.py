import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from arbora.operators import linear, sequences, statistics, tables, texts, tracks
from arbora.operators.graph import closure, connected_components
from arbora.streaming import events


def test_smoothing_keeps_the_total(spark):
    kernel = tracks.gaussian(2.0)
    assert abs(sum(w for _, w in kernel) - 1) < 1e-12 and kernel[0][0] == -kernel[-1][0]
    t = spark.createDataFrame([("a", 5, 3.0), ("a", 7, 1.0)], "target string, x long, y double")
    out = {r["x"]: r["y"] for r in tracks.smooth(t, 2.0).collect()}
    w = dict(kernel)
    assert abs(sum(out.values()) - 4) < 1e-9 and abs(out[6] - (3 * w[1] + w[-1])) < 1e-12


def test_depth_and_overlaps_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "k", int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(0, 200, 60), rng.integers(0, 30, 60)))]
    df = spark.createDataFrame(rows, "id long, key string, lo long, hi long")
    depth = np.zeros(300, int)
    for _, _, a, b in rows:
        depth[a : b + 1] += 1
    got = np.zeros(300, int)
    for r in tracks.depth(df, "key", "lo", "hi").collect():
        got[r["x1"] : r["x2"] + 1] = int(r["y"])
    assert (got == depth).all()
    want = {(a[0], b[0]) for a in rows for b in rows if min(a[3], b[3]) - max(a[2], b[2]) + 1 >= 3}
    pairs = [(r["a_id"], r["b_id"]) for r in tracks.overlaps(df, df, "key", 7, 3).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = {tuple(r) for r in closure(e, spark.createDataFrame([(1,), (4,)], "s long")).collect()}
    assert got == {(1, 2), (1, 3), (1, 4)}
    assert {tuple(r) for r in connected_components(e).collect()} == {(i, 1) for i in (1, 2, 3, 4)}


def test_multiset_rules(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "x int") for v in ([1, 1, 2, None], [2, 3, 3, None]))
    assert sorted(str(r[0]) for r in tables.table_union(a, b).collect()) == ["1", "1", "2", "3", "3", "None"]
    assert [r[0] for r in tables.table_diff(a, b).collect()] == [1, 1]
    assert sorted(str(r[0]) for r in tables.table_intersect(a, b).collect()) == ["2", "None"]


def test_statistics(spark):
    df = spark.createDataFrame([(v, g) for v, g in [(1, 0), (2, 0), (2, 1), (5, 1), (9, 1)]], "v long, g int")
    r = statistics.mann_whitney(df, "v", "g").first()
    assert (r["n1"], r["n0"] if "n0" in r else r["n2"], r["u"]) == (3, 2, 5.5)
    t = statistics.two_populations(spark.createDataFrame([(x,) for x in (1.0, 2.0, 1.5, 10.0, 11.0)], "x double"), "x").first()
    assert (t["cut"], t["n_low"], t["n_high"]) == (2.0, 3, 2)
    n = spark.createDataFrame([(0,), (1,), (5,), (30,), (100,)], "n long").select("n", statistics.log_factorial(F.col("n")).alias("l")).collect()
    assert all(abs(x["l"] - math.lgamma(x["n"] + 1)) < 1e-6 for x in n)


def test_texts(spark):
    df = spark.createDataFrame([(1, "a B c d"), (2, "x"), (3, None)], "id long, t string")
    got = {r["id"]: r["s"] for r in df.select("id", texts.shingles(F.col("t"), 3).alias("s")).collect()}
    assert got[1] == ["a b c", "b c d"] and got[2] == [] and got[3] in ([], None)
    assert spark.range(1).select(texts.drop_contained(F.array(F.lit("lung"), F.lit("lung cancer"), F.lit("mouse"))).alias("x")).first()["x"] == ["lung cancer", "mouse"]


def test_sequences(spark):
    df = spark.createDataFrame([(1, "ttacgnacgaaaaaa"), (2, "cc")], "id long, s string")
    hits = [tuple(r) for r in sequences.fuzzy_match(df, "id", "s", "acr", 0, 0).collect()]
    assert hits == [(1, 3, 0), (1, 7, 0)]
    assert {tuple(r) for r in sequences.homopolymers(df, "s", 5).collect()} == {("a", 6, 1)}
    reads = sequences.seeds(df, "id", "s", 5)
    j = {(r["id"], r["target_id"], r["diagonal"]): r["seeds"] for r in sequences.seed_join(reads, reads).collect()}
    assert j[1, 1, 0] == 11
    c = spark.createDataFrame([("u", "ac"), ("u", "ac"), ("u", "gg")], "k string, s string")
    assert tuple(sequences.consensus(c, ["k"], "s").first()) == ("u", "ac", 2, 3, 2)
    a = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    b = spark.createDataFrame([(2,), (3,), (4,), (5,)], "x int")
    r = sequences.against_truth(a, b, ["x"]).first()
    assert (r["tp"], r["fp"], r["fn"], r["recall"]) == (2, 1, 2, 0.5)


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [5, 1, 0.1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    mean, dirs, var = linear.principal(df, "v", 2)
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.abs(dirs[0]), [1, 0, 0], atol=0.1) and var[0] > var[1]
    p = np.array([r["projection"] for r in linear.project(df, "v", mean, dirs).orderBy("id").collect()])
    assert np.allclose(p, (x - mean) @ dirs.T)
    rows, _ = linear.seriate(pd.DataFrame(np.eye(4)[[2, 0, 3, 1]] + np.eye(4, k=1)[[2, 0, 3, 1]], index=list("cadb")))
    assert "".join(rows) in ("abcd", "dcba")
    g = spark.createDataFrame([("g", i, v) for i, v in enumerate((1.0, 1.2, 5.0, 5.1))], "k string, i long, v double")
    assert {r["i"]: r["cluster"] for r in linear.merge_closest(g, "k", "i", "v", 1.0).collect()} == {0: 0, 1: 0, 2: 1, 3: 1}


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    folder = tmp_path / "in"
    batch.repartition(3).write.parquet(str(folder))
    stream = events.windowed(events.read(spark, str(folder), batch.schema), "1 hour", late="2 hours")
    got = events.drain(stream, "hourly", str(tmp_path / "cp"))
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["n"], round(r["total"], 2)) for r in df.collect())
    assert key(got) == key(events.windowed(batch, "1 hour"))


def test_components_of_whole_keys(spark, tmp_path):
    from arbora.queries import QUERIES

    # keys that fold together modulo 500 and 700, and orders not divisible by three
    lines = [(1, 7, 50.0), (501, 707, 50.0), (2, 707, 50.0), (2, 8, 50.0), (9, 9, 50.0), (3, 9, 50.0), (9, 7, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    near = {}
    for o, p, q in lines:
        if q > 49.5:
            near.setdefault(o, set()).add(-p)
            near.setdefault(-p, set()).add(o)
    want = {}
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        want[x] = min(seen)
    assert {tuple(r) for r in QUERIES["connected_components"](spark, str(tmp_path)).collect()} == set(want.items())


def test_seeds_of_all_reads(spark, tmp_path):
    from collections import Counter

    from arbora.queries import QUERIES, _reads

    names = [(i, "acgtacgg tta" if i < 100 else f"read {'abcdefgh'[i % 8]}{'klmnopqr'[i % 7]} widget") for i in range(0, 140)]
    spark.createDataFrame(names, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    w = [(r["p_partkey"], k + 1, r["s"][k : k + 8]) for r in _reads(spark, str(tmp_path)).collect() for k in range(len(r["s"]) - 7)]
    often = Counter(seed for _, _, seed in w)
    assert max(often.values()) > 81
    want = Counter((i, j, q - p) for i, p, s in w for j, q, t in w if s == t and often[s] <= 81)
    got = {tuple(r)[:3]: r["seeds"] for r in QUERIES["seed_join"](spark, str(tmp_path)).collect()}
    assert got == want and max(i for i, _, _ in got) >= 60
