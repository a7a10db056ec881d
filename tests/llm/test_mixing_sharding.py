import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from arbora.llm import mixing, resharding

from .helpers import frame, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
    left, fixed = 1.5 * sum(size.values()), {}
    while True:
        rest = [n for n in names if n not in fixed]
        level = (left - sum(fixed.values())) / sum(weight[n] for n in rest) if rest else 0
        over = [n for n in rest if weight[n] * level > 2 * size[n]]
        if not over:
            return {n: fixed.get(n, weight[n] * level) for n in names}
        fixed |= {n: 2 * size[n] for n in over}


def test_mix(spark):
    data = rows(4, 200) + rows(4, 3)
    got = mixing.mix(frame(spark, data, extra=True)).collect()
    assert len(got) == len(data)
    size, taken, text = Counter(), Counter(), {r[0]: r for r in data}
    for r in data:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    want = targets(size)
    for r in got:
        source = text[r["doc_id"]][3]
        assert r["size"] == len(WORD.findall(text[r["doc_id"]][1] or "")) and r["source_size"] == size[source]
        assert abs(r["target"] - want[source]) < 1e-6 * max(1, want[source])
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[source] += r["taken"]
    for s in size:
        assert abs(taken[s] - want[s]) <= 0.02 * max(1, want[s]) + 5
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(frame(spark, data)).collect()))


def test_tilted_is_the_entropy_optimum(spark):
    """Against plain bisection on the dual; and the rates are exponential in the size."""
    rng = np.random.default_rng(1)
    data, want = [], {}
    for k, share in enumerate((0.1, 0.7, 1.0, 1.5, 1.97, 2.0, 3.0)):
        size, n = np.unique(rng.integers(0, 900, 60)), rng.integers(1, 9, 60)
        n = n[: len(size)]
        total = int((size * n).sum())
        data += [(f"s{k}", int(a), int(b), total, share * total) for a, b in zip(size, n)]
        lo, hi = -50.0, 50.0
        x = size / ((size * n) @ size / total)
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (n * size) @ np.minimum(2, np.exp(np.minimum(mid * x, 50))) < share * total else (lo, mid)
        want |= {(f"s{k}", int(a)): min(2.0, float(np.exp(min(lo * v, 50)))) if share < 2 else 2.0 for a, v in zip(size, x)}
    got = mixing.tilted(spark.createDataFrame(data, "source string, size long, n long, source_size long, target double")).collect()
    assert len(got) == len(data)
    for r in got:
        assert abs(r["rate"] - want[r["source"], r["size"]]) < 1e-6


def test_apply_mix_deals_by_row(spark):
    """Rows of one id and text in two sources, and equal rows of which some get more."""
    data = [(1, "a b c", "en", "s1", 0), (1, "a b c", "en", "s2", 0)] + [(7, "x y", "en", "s3", 5)] * 9 + [(8, "", "en", "s3", 0)] * 2
    out = Counter(tuple(r) for r in mixing.apply_mix(frame(spark, data)).collect())
    want = targets({"s1": 3, "s2": 3, "s3": 18})
    for s, size in (("s1", 3), ("s2", 3), ("s3", 2)):
        words = sum(n * size for r, n in out.items() if r[3] == s and r[1])
        assert abs(words - want[s]) <= size
    assert all(n <= 2 for r, n in out.items() if r[0] == 1) and out[(8, "", "en", "s3", 0)] == 2
    taken = [r["copies"] for r in mixing.mix(frame(spark, data)).where("size = 2").collect()]
    assert sum(taken) == out[(7, "x y", "en", "s3", 5)] and max(taken) - min(taken) <= 1


def test_mix_edges(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    only = [(1, None, "en", None, 0), (2, "", "en", "s", 0)]
    assert {r["taken"] for r in mixing.mix(frame(spark, only)).collect()} == {0}
    out = mixing.apply_mix(frame(spark, rows(4, 100)))
    per = {r["doc_id"]: r["copies"] for r in mixing.mix(frame(spark, rows(4, 100))).collect()}
    n = Counter(r["doc_id"] for r in out.collect())
    kind = {r[0]: (r[3], len(WORD.findall(r[1] or ""))) for r in rows(4, 100)}
    want, got = Counter(), Counter()
    for i, k in per.items():
        want[kind[i]] += k if kind[i][1] else 1
    for i, k in n.items():
        got[kind[i]] += k
    assert got == +want and max(n.values()) <= 2 and out.columns == frame(spark).columns


def test_reshard(spark):
    data = rows(6, 300)
    data += [(1000 + i, "the same long text over and over", "en", "s1", 0) for i in range(150)]
    got = resharding.reshard(frame(spark, data, extra=True)).collect()
    by, size, text = defaultdict(list), Counter(), {r[0]: r[1] for r in data}
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        by[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert len(got) == len(data) and set(by) == set(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(size.values()) - min(size.values()) <= 0.02 * sum(size.values()) / 8 + 60


def test_flow_moves_the_fewest_bytes():
    flow = resharding.min_cost_flow([50, 30, 20], [25, 25, 25, 25], lambda i, j: int(i != j))
    assert [sum(r) for r in flow] == [50, 30, 20] and [sum(c) for c in zip(*flow)] == [25] * 4
    assert sum(flow[i][i] for i in range(3)) == 25 + 25 + 20


def test_reshard_edges(spark):
    assert resharding.reshard(frame(spark, [])).count() == 0
    one = resharding.reshard(frame(spark, [(None, None, "en", "s", 0), (None, None, "en", "s", 0)])).collect()
    assert len(one) == 2 and {r["size"] for r in one} == {1}


def test_rewrite_affected(spark, tmp_path):
    df = frame(spark, rows(6, 60)).where(F.col("doc_id").isNotNull())
    plan = resharding.reshard(df)
    resharding.rewrite_affected(df, plan, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 60 and {(r["doc_id"], r["shard"]) for r in back.collect()} == {(r["doc_id"], r["shard"]) for r in plan.collect()}


def test_rewrite_with_repeats_and_an_emptied_shard(spark, tmp_path):
    data = rows(6, 60) + [(5, "same words", "en", "s1", 0)] * 90 + [(None, "same words", "en", "s1", 0)] * 5
    df = frame(spark, data)
    plan = resharding.reshard(df)
    at = str(tmp_path / "out")
    gone = plan.withColumn("old_shard", F.lit(99)).limit(1).unionByName(plan)  # a shard that has no rows any more
    spark.range(1).selectExpr("id", "99 as shard").write.partitionBy("shard").parquet(at)
    resharding.rewrite_affected(df, plan.withColumn("old_shard", F.lit(99)), at)
    assert gone.count() == plan.count() + 1
    back = spark.read.parquet(at)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r[0], r[1]) for r in data)
    assert Counter(r["shard"] for r in back.collect()) == Counter(r["shard"] for r in plan.collect())


def test_groups_stay_whole(spark):
    """Equal texts of a third of a shard's bytes share a shard; a group larger than any
    shard is split."""
    data = [(i, f"text number {i} of many others here", "en", "s", 0) for i in range(400)]
    data += [(1000 + i, "a group of medium size", "en", "s", 0) for i in range(40)]
    got = resharding.reshard(frame(spark, data)).collect()
    assert len({r["shard"] for r in got if r["doc_id"] >= 1000}) == 1
    data += [(2000 + i, "half of everything is this one text over and over", "en", "s", 0) for i in range(600)]
    got = resharding.reshard(frame(spark, data)).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert len(got) == len(data) and max(size.values()) - min(size.values()) <= 0.02 * sum(size.values()) / 8 + 60
