import pytest

from cellweave.operators import library as L
from cellweave.sources import text


def test_discovery_by_name(spark):
    """Forms of names, mates that lack and the options."""
    paths = ["/a/x_R1.fastq.gz", "/a/x_R2.fastq.gz", "y_R1.fastq", "SRR12_1.fastq.gz", "SRR12_2.fastq.gz", "z-1-a_L001_R1_001.fastq.gz", "z-1-a_L001_R2_001.fastq.gz", "z-1-a_L002_R1_001.fastq.gz", None]
    files = spark.createDataFrame([(p, 1) for p in paths], "path string, lane int")
    got = {r.path: (r.library, r.lane, r.mate, r.complete) for r in L.discovered(files).collect()}
    assert got["/a/x_R1.fastq.gz"] == ("x", "single_file", "R1", True) and got["y_R1.fastq"] == ("y", "single_file", "R1", False)
    assert got["SRR12_2.fastq.gz"] == ("SRR12", "single_file", "R2", True)
    assert got["z-1-a_L001_R2_001.fastq.gz"] == ("z-1-a", "z-1-a_L001", "R2", True) and not got["z-1-a_L002_R1_001.fastq.gz"][3]
    assert len(got) == 8
    one = {r.path: (r.library, r.lane, r.complete) for r in L.discovered(files, one_library="all", single=True).collect()}
    assert one["SRR12_1.fastq.gz"] == ("all", "SRR12", True) and one["y_R1.fastq"] == ("y", "single_file", True) and one["z-1-a_L002_R1_001.fastq.gz"] == ("all", "z-1-a_L002", True)
    merged = {r.path: r.library for r in L.discovered(files, merge=("-", 1)).collect()}
    assert merged["z-1-a_L001_R1_001.fastq.gz"] == "z" and merged["/a/x_R1.fastq.gz"] == "x"
    assert L.discovered(files.limit(0)).collect() == []


def test_masks(spark):
    seq = "ACGTACGTAC"
    chunks = spark.createDataFrame([("c", 0, seq), ("c", 10, seq), ("c", 20, "ACG"), ("d", 0, seq)], "contig string, chunk_start long, seq string")
    places = [("c", 0), ("c", 9), ("c", 10), ("c", 14), ("c", 14), ("c", 22), ("c", 24), ("c", 99), ("e", 1)]
    variants = spark.createDataFrame([(*p, "A", "G") for p in places] + [("d", 3, "A", None), ("d", 4, "AC", "G"), ("d", 5, "A", "GG")], "contig string, pos long, ref string, alt string")
    got = {(r.contig, r.chunk_start): r.seq for r in L.masked(chunks, variants).collect()}
    assert got == {("c", 0): "NCGTACGTAN", ("c", 10): "NCGTNCGTAC", ("c", 20): "ACN", ("d", 0): "ACGNACGTAC"}
    assert L.masked(chunks.limit(0), variants).collect() == []


def test_groups_of_cells(spark):
    reads = spark.createDataFrame([("a", False), ("a", True), ("b", False), (None, False)], "sm string, duplicate boolean")
    groups = spark.createDataFrame([("a", "x"), ("a", "x"), (None, "y")], "cell string, cluster string")
    assert [(r.sm, r.cluster) for r in L.pseudobulks(reads, groups).collect()] == [("a", "x")]
    with pytest.raises(Exception, match="two clusters"):
        L.pseudobulks(reads, groups.union(spark.createDataFrame([("a", "z")], groups.schema))).collect()


def test_call_forms(spark):
    calls = spark.createDataFrame([("P_7", 1, 5, None, "ACG", "+", "c", 8, "Z", "TA", 30, 2), ("P_7", 1, 5, 9, "ACG", "+", "c", 9, ".", "TA", 30, 2)], "sample string, molecule int, site int, length int, umi string, strand string, contig string, pos int, symbol string, motif string, qual int, cov int")
    lines = lambda *a, **k: [r.value for r in L.call_lines(calls, *a, **k).collect()]
    assert lines() == ["P_7:1:5:None:ACG:+\tc\t9\tZ\tTA"]
    assert lines("table_more") == ["P_7:1:5:None:ACG:+\tc\t9\tZ\t30\t2\tTA"]
    assert lines("bed") == ["c\t8\t9\t7\t1\t+"] and lines(contexts=["x"]) == []


def test_measured_places_without_limits(spark):
    v = spark.createDataFrame([("a", "c", 0, 1), ("b", "c", 0, 3), ("a", "c", 1, 4)], "cell string, contig string, bin_start int, value int")
    assert L.measured(v).count() == 3 and L.measured(v, least=1).count() == 2 and L.measured(v, variance=2.0).count() == 2 and L.measured(v, variance=2.1).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "v").write_text("#c\nchr1 10 id A G\nchr2\t3\tid\tC\tT\n")
    got = sorted(tuple(r) for r in text.variant_columns(spark, str(tmp_path / "v"), "chr1").collect())
    assert got == [("chr1", 9, "A", "REF"), ("chr1", 9, "G", "ALT")]
    (tmp_path / "b").write_text("chr1\t0\t10\tname\nchr2 5 9\n")
    assert sorted(tuple(r) for r in text.bed_bins(spark, str(tmp_path / "b")).collect()) == [("chr1", 0, 10), ("chr2", 5, 9)]
    (tmp_path / "m").write_text("gene,a.1,b\ng1,2,\ng2,0,4\n")
    assert sorted(tuple(r) for r in text.count_matrix(spark, str(tmp_path / "m")).collect()) == [("g1", "a.1", 2.0), ("g2", "a.1", 0.0), ("g2", "b", 4.0)]
    reads = spark.createDataFrame([("c",), ("c",), (None,)], "contig string")
    assert [r.contig for r in text.used_contigs(reads).collect()] == ["c"]


def test_tag_names_of_tools(spark):
    reads = spark.createDataFrame([({"BC": "AC", "RX": "G", "XC": "old"},), ({"XM": "own"},), (None,)], "tags map<string,string>")
    got = [r.tags for r in L.in_dialect(reads, "dropseq").collect()]
    assert got == [{"BC": "AC", "RX": "G", "XC": "AC", "XM": "G"}, {"XM": "own"}, None]
