import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from arbora.llm import decontamination, neardup, toxicity  # noqa: E402
from arbora.llm.common import settle  # noqa: E402

from .helpers import rows, words  # noqa: E402
from .test_neardup import brute  # noqa: E402


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    data = rows(5, 120)
    items = [(1, words(rng, 30)), (2, words(rng, 25))]
    data += [(500, words(rng, 20) + " " + items[0][1], "en", "s1", 0), (501, items[1][1], "en", "s2", 0)]
    labels = []
    for i in range(150):
        w = words(rng, 40)
        if i % 2:
            w += " grumblefoo grumblebar grumblefoo"
        data.append((600 + i, w, "en", "s1", 0))
        labels.append((600 + i, 1, i % 2))
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    held, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, str(tmp_path)))
        held.append((name, docs))
    (_, a), (_, b), (_, c), (_, d), (_, e) = held
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    first = {r["doc_id"] for r in a.collect()}
    assert first == {i for i, p in scores.items() if not p}
    left = [r for r in data if r[0] in first]
    want = {i for i, (_, k) in brute(left, neardup.WIDTH).items() if i == k}
    assert {r["doc_id"] for r in b.collect()} == want
    assert {r["doc_id"] for r in c.collect()} == want - {500, 501}
    assert all(x.columns == columns for x in (a, b, c, d))
    assert d.count() == e.count() and {r["doc_id"] for r in d.collect()} <= want
    assert decontamination.PIECE > 1 and sorted(r["slot"] for r in e.where("shard = 0").collect()) == list(range(e.where("shard = 0").count()))


def test_driver_lets_go_between_stages(spark, monkeypatch, tmp_path):
    """The shuffles of a stage are not tracked any more when the next one has begun."""
    import time

    spark.range(100).selectExpr("id as doc_id", "cast(id as string) as text").write.parquet(str(tmp_path / "documents.parquet"))
    tracked = spark._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    left = []

    def shuffled(spark, docs, sf_dir):
        return docs.repartition(5).groupBy("doc_id", "text").count().drop("count")

    def last(spark, docs, sf_dir):
        end = time.time() + 20
        while tracked.size() > before and time.time() < end:
            time.sleep(0.2)
        left.append(tracked.size())
        return docs

    corpus_pipeline.tidy(spark)
    time.sleep(2)
    before = tracked.size()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", shuffled), ("b", shuffled), ("c", last)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 100
    assert left[0] <= before
