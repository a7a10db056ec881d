"""Small document tables with nulls, ties, repeats and columns of clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + rng.choice("rstlmn") + rng.choice("aeiouy") for _ in range(n))


def rows(seed=3, n=60):
    """Documents of three sources: copies, near copies, empty and null texts, odd spaces."""
    rng = random.Random(seed)
    out, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            t = rng.choice(texts)
        elif texts and kind < 0.4:
            w = rng.choice(texts).split()
            if w:
                w[rng.randrange(len(w))] = "zz%d" % i
            t = " ".join(w)
        elif kind < 0.45:
            t = rng.choice([None, "", " ", "one", "Ünï ÅÄ x", "a\tb\x0bc"])
        else:
            t = words(rng, rng.randint(3, 120))
        if t and t.strip():
            texts.append(t)
        out.append((i, t, "en", rng.choice(["s1", "s2", None]), len(t or "")))
    return out


def frame(spark, data=None, extra=False):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    if extra:  # names that operators use themselves
        from pyspark.sql import functions as F

        for c in ("size", "score", "shard", "component", "h", "node", "rank", "at", "token"):
            df = df.withColumn(c, F.lit("x"))
    return df
