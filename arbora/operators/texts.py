"""Words, k-mers and text comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text, none of them empty."""
    return F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")


def kmers(text: Column, k: int) -> Column:
    """All substrings of k characters."""
    n = F.length(text) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: text.substr(i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def canonical(kmer: Column) -> Column:
    """A k-mer of odd length on the strand whose middle base is a or c."""
    from ..functions.dna import reverse_complement

    mid = F.substring(kmer, F.floor(F.length(kmer) / 2).cast("int") + 1, F.lit(1))
    return F.when(F.lower(mid).isin("a", "c"), F.lower(kmer)).otherwise(reverse_complement(kmer))


def kmer_count(df: DataFrame, text: str, k: int, strand: bool = False, most: int | None = None) -> DataFrame:
    """(kmer, n) over all texts; `most` leaves out those that repeat more."""
    x = df.select(F.explode(kmers(F.col(text), k)).alias("kmer"))
    x = x.withColumn("kmer", canonical(F.col("kmer"))) if strand else x
    out = x.groupBy("kmer").agg(F.count("*").alias("n"))
    return out if most is None else out.where(F.col("n") <= most)


def shingles(text: Column, k: int) -> Column:
    """Distinct runs of k words, joined by a space. The word array is shifted against
    itself, so that it is split once and not for every run."""
    w = words(text)
    run = w
    for i in range(1, k):
        run = F.zip_with(run, F.slice(w, i + 1, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.coalesce(F.array_distinct(F.filter(run, lambda x: x.isNotNull())), F.array().cast("array<string>"))


def run_hashes(text: Column, k: int) -> Column:
    """Distinct 64-bit hashes of the runs of k words."""
    w = words(text)

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - k)
        runs = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(F.size(w) >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))

    # a lambda's variable: the words are made once, not for every run
    return F.element_at(F.transform(F.array(w), of), 1)


#: Runs of a reference (of 8 bytes each) that are broadcast at most.
BROADCAST_RUNS = 2_000_000


def containment(docs: DataFrame, ident: str, text: str, reference: DataFrame, ref_text: str, k: int) -> DataFrame:
    """(id, n, found, percent): how many of a text's runs of k words are in the reference.
    Texts stay where they are: of each only counts are shuffled. A reference of more runs
    than may be broadcast is joined by their hashes."""
    known = reference.select(F.explode(run_hashes(F.col(ref_text), k)).alias("s")).distinct().withColumn("hit", F.lit(1))
    if known.count() <= BROADCAST_RUNS:
        known = F.broadcast(known)
    mine = docs.select(F.col(ident), F.explode(run_hashes(F.col(text), k)).alias("s"))
    out = mine.join(known, "s", "left").groupBy(ident).agg(F.count("*").alias("n"), F.count("hit").alias("found"))
    return out.withColumn("percent", 100.0 * F.col("found") / F.col("n"))


def exact_duplicates(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(least id, copies) of texts that occur more than once."""
    g = df.groupBy(F.sha2(F.col(text), 256).alias("h")).agg(F.min(ident).alias("least"), F.count("*").alias("copies"))
    return g.where("copies > 1").select("least", "copies")


def token_overlap(df: DataFrame, ident: str, text: str, most: int | None = None) -> DataFrame:
    """(a, b, shared): pairs of texts by the number of words they share, by an inverted
    index of all words, or of those that occur in at most `most` texts."""
    w = df.select(F.col(ident).alias("id"), F.explode(F.array_distinct(words(F.col(text)))).alias("w"))
    few = w.groupBy("w").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    few = few.select("w") if most is None else few.where(F.col("df") <= most).select("w")
    x = w.join(few, "w")
    return x.alias("x").join(x.alias("y"), "w").where("x.id < y.id").groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("shared"))


def trigram_similarity(df: DataFrame, ident: str, text: str, least: float) -> DataFrame:
    """(a, b, cosine) of pairs of names by their trigram counts."""
    t = df.select(F.col(ident).alias("id"), F.explode(kmers(F.lower(text), 3)).alias("g")).groupBy("id", "g").agg(F.count("*").alias("n"))
    norm = t.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    dot = t.alias("x").join(t.alias("y"), "g").where("x.id < y.id").groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.sum(F.col("x.n") * F.col("y.n")).alias("dot"))
    out = dot.join(norm.toDF("a", "na"), "a").join(norm.toDF("b", "nb"), "b")
    return out.select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine")).where(F.col("cosine") >= least)


def drop_contained(tokens: Column) -> Column:
    """Tokens of an array that are not part of another one."""
    return F.filter(tokens, lambda x: ~F.exists(tokens, lambda y: (y != x) & F.contains(y, x)))


def search_ranked(df: DataFrame, ident: str, text: str, terms: list[str]) -> DataFrame:
    """(id, rank, hits): rank 0 for all terms, then by how many are missing."""
    low = F.lower(text)
    hit = [F.contains(low, F.lit(t.lower())).cast("int") for t in terms]
    total = sum(hit[1:], hit[0])
    return df.select(ident, (F.lit(len(terms)) - total).alias("rank"), total.alias("hits")).where("hits > 0")
