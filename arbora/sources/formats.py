"""Readers and writers of sequence, annotation, alignment, coverage and record files.

Readers are Spark text sources with expressions on top; compressed files are unpacked by
Spark's codecs. Writers give a DataFrame with one `value` column for a text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def text_sink(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


# -- sequences ------------------------------------------------------------------------
def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, title, sequence; a record is what follows a > at the start of a line."""
    rec = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("r"))
    head = F.split_part("r", F.lit("\n"), F.lit(1))
    body = F.regexp_replace(F.expr("substring(r, instr(r, '\n') + 1)"), r"\s", "")
    out = rec.where(F.trim("r") != "").select(F.split_part(F.trim(head), F.lit(" "), F.lit(1)).alias("name"), F.trim(F.regexp_extract(head, r"^\S+\s*(.*)$", 1)).alias("title"), F.when(F.contains("r", F.lit("\n")), body).otherwise(F.lit("")).alias("sequence"))
    return out


def multiplicity(name: Column) -> Column:
    """The number after # in a name that stands for several equal reads, else 1."""
    n = F.regexp_extract(name, r"#(\d+)", 1)
    return F.when(n != "", n.cast("long")).otherwise(F.lit(1))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, n (line number in the file, from 0), value. Lines are counted within the
    blocks that tasks read, and blocks within their file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    own = Window.partitionBy("file", "block").orderBy("i")
    per = rows.groupBy("file", "block").agg(F.count("*").alias("m"))
    start = per.withColumn("start", F.sum("m").over(Window.partitionBy("file").orderBy("block")) - F.col("m")).drop("m")
    return rows.withColumn("k", F.row_number().over(own) - 1).join(start, ["file", "block"]).select("file", "block", (F.col("start") + F.col("k")).alias("n"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence, quality of records of four lines; a quality line may begin with @."""
    lines = numbered_lines(spark, path).withColumn("record", F.floor(F.col("n") / 4))
    part = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("value")))
    rec = lines.groupBy("file", "record").agg(part(0).alias("head"), part(1).alias("sequence"), part(3).alias("quality")).where("head like '@%' and quality is not null")
    return rec.select(F.split_part(F.substring("head", 2, 1 << 30), F.lit(" "), F.lit(1)).alias("name"), "sequence", "quality")


def write_fasta(df: DataFrame, name: str = "name", sequence: str = "sequence", width: int = 60) -> DataFrame:
    lines = F.regexp_replace(F.col(sequence), f"(.{{{width}}})(?=.)", "$1\n")
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), lines).alias("value"))


# -- annotation and alignment ---------------------------------------------------------
_GFF = "seqname string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns, with the attributes as a map (of both `key "v";` and `key=v;`)."""
    df = spark.read.csv(path, sep="\t", schema=_GFF, comment="#", quote="")
    pairs = F.filter(F.split("attributes", r"\s*;\s*"), lambda x: x != "")
    entry = lambda x: F.struct(F.regexp_extract(x, r"^\s*([^\s=]+)", 1).alias("k"), F.regexp_replace(F.regexp_extract(x, r"^\s*[^\s=]+[\s=]+(.*)$", 1), '"', "").alias("v"))
    first = F.aggregate(F.transform(pairs, entry), F.array().cast("array<struct<k:string,v:string>>"), lambda a, x: F.when(F.exists(a, lambda y: y["k"] == x["k"]), a).otherwise(F.concat(a, F.array(x))))
    return df.withColumn("tags", F.map_from_entries(first)).withColumn("score", F.col("score").try_cast("double"))


def write_gff(df: DataFrame) -> DataFrame:
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return df.select(F.concat_ws("\t", *[dot(c) for c in ("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")]).alias("value"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Mapped records: name, flag, target, pos, mapq, cigar, sequence, strand, end, aligned."""
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 11)
    f = F.col("f")
    df = rows.select(f[0].alias("name"), f[1].try_cast("int").alias("flag"), f[2].alias("target"), f[3].try_cast("long").alias("pos"), f[4].try_cast("int").alias("mapq"), f[5].alias("cigar"), f[9].alias("sequence"))
    df = df.where("(flag & 4) = 0 and target <> '*'")
    return df.withColumn("strand", F.when(F.col("flag").bitwiseAND(16) > 0, F.lit("-")).otherwise(F.lit("+"))).withColumn("end", F.col("pos") + cigar_sum("cigar", "MDN=X") - 1).withColumn("aligned", cigar_sum("cigar", "M=X"))


def cigar(col: str | Column) -> Column:
    """array<struct<n: int, op: string>> of an alignment string."""
    runs = F.regexp_extract_all(F.col(col) if isinstance(col, str) else col, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(runs, lambda x: F.struct(x.substr(F.lit(1), F.length(x) - 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def cigar_sum(col: str | Column, ops: str) -> Column:
    """Total length of some operations."""
    return F.aggregate(F.filter(cigar(col), lambda x: F.contains(F.lit(ops), x["op"])), F.lit(0), lambda a, x: a + x["n"]).cast("long")


def write_sam(df: DataFrame) -> DataFrame:
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    return df.select(F.concat_ws("\t", star("name"), star("flag"), star("target"), star("pos"), star("mapq"), star("cigar"), F.lit("*\t0\t0"), star("sequence"), F.lit("*")).alias("value"))


# -- coverage -------------------------------------------------------------------------
def read_wiggle(spark: SparkSession, path: str) -> DataFrame:
    """(target, x, y) of fixedStep, variableStep and bedGraph lines. Headers are carried down
    within the blocks that tasks read, and from block to block of a file."""
    lines = numbered_lines(spark, path).withColumnRenamed("value", "line").where("line <> '' and line not like 'track%' and line not like '#%'")
    is_head = F.col("line").rlike("^(fixed|variable)Step")
    own = Window.partitionBy("file", "block").orderBy("n")
    # data lines so far, and the last header with the number of those before it
    rows = lines.withColumn("is_head", is_head).withColumn("c", F.sum((~is_head).cast("long")).over(own))
    mark = F.struct("line", "c")
    rows = rows.withColumn("h", F.last(F.when(F.col("is_head"), mark), ignorenulls=True).over(own))
    per = rows.groupBy("file", "block").agg(F.max("c").alias("m"), F.max_by("h", "n").alias("last"))
    blocks = Window.partitionBy("file").orderBy("block")
    per = per.withColumn("start", F.sum("m").over(blocks) - F.col("m")).withColumn("last", F.when(F.col("last").isNotNull(), F.struct(F.col("last.line").alias("line"), (F.col("last.c") + F.col("start")).alias("c"))))
    per = per.select("file", "block", "start", F.last("last", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    rows = rows.where("not is_head").join(per, ["file", "block"])
    df = rows.select("line", F.coalesce("h.line", "carried.line").alias("head"), (F.col("c") + F.col("start") - 1 - F.coalesce(F.col("h.c") + F.col("start"), "carried.c", F.lit(0))).alias("row"))
    opt = lambda name, default: F.coalesce(F.regexp_extract("head", rf"{name}=(\S+)", 1).try_cast("long"), F.lit(default))
    f = F.split(F.trim("line"), r"\s+")
    chrom = F.regexp_extract("head", r"chrom=(\S+)", 1)
    fixed = F.col("head").startswith("fixed")
    bed = df.where(F.size(f) >= 4).select(f[0].alias("target"), F.explode(F.sequence(f[1].cast("long") + 1, f[2].cast("long"))).alias("x"), f[3].cast("double").alias("y"))
    step = df.where(F.size(f) < 3).select(chrom.alias("target"), F.when(fixed, opt("start", 1) + F.col("row") * opt("step", 1)).otherwise(f[0].try_cast("double").cast("long")).alias("x"), F.when(fixed, f[0].try_cast("double")).otherwise(F.get(f, F.lit(1)).try_cast("double")).alias("y"))
    return bed.unionByName(step)


def write_bedgraph(runs: DataFrame) -> DataFrame:
    """From (target, x1, x2, y) with both ends included to 0-based half-open lines."""
    return runs.select(F.concat_ws("\t", "target", (F.col("x1") - 1).cast("string"), F.col("x2").cast("string"), F.col("y").cast("string")).alias("value"))


def write_variable_step(track: DataFrame, step: int = 10) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("x", "y")))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws("\t", r["x"].cast("string"), r["y"].cast("string"))), "\n")
    return track.groupBy("target", F.floor(F.col("x") / 1_000_000).alias("part")).agg(text.alias("t")).select(F.concat(F.lit("variableStep chrom="), "target", F.lit(f" span={step}\n"), "t").alias("value"))


# -- tables and records ---------------------------------------------------------------
def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t", null: str = "NULL") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, nullValue=null, comment="#")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A saved set: `Class : name` lines as (class, name)."""
    line = F.regexp_replace("value", '"', "")
    return spark.read.text(path).where(F.col("value").rlike(r"^\s*\w+\s*:")).select(F.trim(F.regexp_extract(line, r"^\s*(\w+)\s*:", 1)).alias("class"), F.trim(F.regexp_extract(line, r"^\s*\w+\s*:\s*(.*)$", 1)).alias("name")).distinct()


def write_names(df: DataFrame, cls: str, name: str = "name") -> DataFrame:
    return df.select(F.concat(F.lit(f'{cls} : "'), F.col(name), F.lit('"')).alias("value"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Sparse records `sample tag format values…` as (sample, tag, k, number, text): format
    letters i and f are numbers, t and c texts; a count before a letter repeats it, and an
    upper-case letter takes all values left."""
    rows = spark.read.text(path).where("value <> '' and value not like '#%'").select(F.split("value", "\t").alias("f")).where(F.size("f") >= 4)
    letters = F.regexp_extract_all(F.col("f")[2], F.lit(r"(\d*[A-Za-z])"), F.lit(1))
    kinds = F.flatten(F.transform(letters, lambda x: F.array_repeat(F.right(x, F.lit(1)), F.greatest(F.lit(1), F.coalesce(F.regexp_extract(x, r"^(\d+)", 1).try_cast("int"), F.lit(1))))))
    df = rows.select(F.col("f")[0].alias("sample"), F.col("f")[1].alias("tag"), kinds.alias("kinds"), F.posexplode(F.slice("f", F.lit(4), F.size("f"))).alias("k", "v"))
    kind = F.coalesce(F.get("kinds", F.col("k")), F.element_at("kinds", -1))
    number = F.when(F.lower(kind).isin("i", "f"), F.col("v").try_cast("double"))
    return df.select("sample", "tag", "k", number.alias("number"), F.when(~F.lower(kind).isin("i", "f"), F.col("v")).alias("text"))


def merge(records: DataFrame) -> DataFrame:
    """Records of one (sample, tag) merged: numbers add up, the last text stays."""
    return records.withColumn("_o", F.monotonically_increasing_id()).groupBy("sample", "tag", "k").agg(F.sum("number").alias("number"), F.max_by("text", "_o").alias("text"))
