import gzip

from pyspark.sql import functions as F

from arbora.sources import formats as f


def test_fasta_and_fastq(spark, tmp_path):
    with gzip.open(tmp_path / "a.fa.gz", "wt") as out:
        out.write(">s1 first one\nACGT\nAC\n>s2#12\nGG\n>s3\n")
    rows = {r["name"]: r for r in f.read_fasta(spark, str(tmp_path / "a.fa.gz")).withColumn("m", f.multiplicity(F.col("name"))).collect()}
    assert (rows["s1"]["sequence"], rows["s1"]["title"], rows["s2#12"]["m"], rows["s3"]["sequence"]) == ("ACGTAC", "first one", 12, "")
    text = f.write_fasta(spark.createDataFrame([("x", "acgtacgt")], "name string, sequence string"), width=3).first()["value"]
    assert text == ">x\nacg\ntac\ngt"
    (tmp_path / "b.fq").write_text("@r1 z\nACG\n+\nIII\n@r2\nTT\n+\n##\n")
    assert [tuple(r) for r in f.read_fastq(spark, str(tmp_path / "b.fq")).collect()] == [("r1", "ACG", "III"), ("r2", "TT", "##")]


def test_gff_round_trip(spark, tmp_path):
    (tmp_path / "a.gff").write_text('#c\nchr1\tx\texon\t10\t20\t.\t+\t0\tgene_id "g1"; note "a b"; gene_id "g2"\nchr1\tx\tCDS\t5\t9\t2.5\t-\t.\tID=c1;Parent=g1\n')
    rows = f.read_gff(spark, str(tmp_path / "a.gff")).orderBy("start").collect()
    assert rows[0]["tags"] == {"ID": "c1", "Parent": "g1"} and rows[0]["score"] == 2.5
    assert rows[1]["tags"] == {"gene_id": "g1", "note": "a b"} and rows[1]["end"] == 20
    assert f.write_gff(f.read_gff(spark, str(tmp_path / "a.gff"))).where("value like 'chr1\tx\tCDS\t5\t9\t2.5\t-%'").count() == 1


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\nr1\t16\tc\t101\t60\t5S10M2D3M1I4N6M\t*\t0\t0\tAC\t*\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n")
    r = f.read_sam(spark, str(tmp_path / "a.sam")).collect()
    assert len(r) == 1 and (r[0]["strand"], r[0]["end"], r[0]["aligned"]) == ("-", 101 + 10 + 2 + 3 + 4 + 6 - 1, 19)


def test_wiggle(spark, tmp_path):
    (tmp_path / "a.wig").write_text("track x\nfixedStep chrom=c1 start=11 step=10\n1\n2\nvariableStep chrom=c2\n5 7\n9 8.5\n")
    (tmp_path / "b.bg").write_text("c3\t0\t2\t4\n")
    got = sorted(tuple(r) for r in f.read_wiggle(spark, str(tmp_path / "a.wig")).collect())
    assert got == [("c1", 11, 1.0), ("c1", 21, 2.0), ("c2", 5, 7.0), ("c2", 9, 8.5)]
    assert sorted(tuple(r) for r in f.read_wiggle(spark, str(tmp_path / "b.bg")).collect()) == [("c3", 1, 4.0), ("c3", 2, 4.0)]
    runs = spark.createDataFrame([("c", 3, 5, 2.0)], "target string, x1 long, x2 long, y double")
    assert f.write_bedgraph(runs).first()["value"] == "c\t2\t5\t2.0"


def test_records(spark, tmp_path):
    (tmp_path / "a.tsf").write_text("s1\tt1\tiit\t1\t2\tx\ns1\tt1\tiit\t10\t5\ty\ns2\tt1\t2i\t3\t4\n")
    got = {(r["sample"], r["k"]): (r["number"], r["text"]) for r in f.merge(f.read_records(spark, str(tmp_path / "a.tsf"))).collect()}
    assert got == {("s1", 0): (11.0, None), ("s1", 1): (7.0, None), ("s1", 2): (None, "y"), ("s2", 0): (3.0, None), ("s2", 1): (4.0, None)}


def test_names_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("a b",), ("c",)], "name string")
    f.text_sink(f.write_names(df, "Person"), str(tmp_path / "n"))
    assert sorted(tuple(r) for r in f.read_names(spark, str(tmp_path / "n")).collect()) == [("Person", "a b"), ("Person", "c")]
    (tmp_path / "t.tsv").write_text("1\tNULL\n2\tx\n")
    assert [tuple(r) for r in f.read_table(spark, str(tmp_path / "t.tsv"), "a int, b string").collect()] == [(1, None), (2, "x")]


def test_fastq_quality_lines_may_begin_with_at(spark, tmp_path):
    (tmp_path / "q.fq").write_text("@r1 x\nACGT\n+\n@III\n@r2\nTTG\n+r2\n@@@\n@r3\nA\n+\nI\n")
    got = sorted(tuple(r) for r in f.read_fastq(spark, str(tmp_path / "q.fq")).collect())
    assert got == [("r1", "ACGT", "@III"), ("r2", "TTG", "@@@"), ("r3", "A", "I")]


def test_files_of_several_blocks(spark, tmp_path):
    """Lines are counted over the blocks that tasks read."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        (tmp_path / "q.fq").write_text("".join(f"@r{i}\n{'ACGT' * 3}\n+\n@{'I' * 11}\n" for i in range(40)))
        got = sorted(tuple(r) for r in f.read_fastq(spark, str(tmp_path / "q.fq")).collect())
        assert got == sorted((f"r{i}", "ACGT" * 3, "@" + "I" * 11) for i in range(40))
        text = "".join(f"fixedStep chrom=c{k} start={k} step=2\n" + "".join(f"{v}\n" for v in range(25)) + "# remark\n\n" for k in range(1, 6))
        (tmp_path / "a.wig").write_text("track x\n" + text)
        got = sorted(tuple(r) for r in f.read_wiggle(spark, str(tmp_path / "a.wig")).collect())
        assert got == sorted((f"c{k}", k + 2 * v, float(v)) for k in range(1, 6) for v in range(25))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
