from cellweave.functions import sequence as S
from cellweave.operators import barcodes, calls, molecules
from cellweave.sources import sinks, text
from pyspark.sql import functions as F


def test_fastq_and_demultiplexing(spark, tmp_path):
    seq = "TTTTGGGGCCCCAAAA"
    (tmp_path / "a_R1.fastq").write_text(f"@NS500414:628:H7:1:11101:15963:1046 1:N:0:GTGAAA\nATAATATCTGGGCA{seq}\n+\n@EEE{'E' * 26}\n@x:1\nATAATAACACACTA{seq}\n+\n{'E' * 30}\n")
    (tmp_path / "a_R2.fastq").write_text("@NS500414:628:H7:1:11101:15963:1046 2:N:0:GTGAAA\nGGGGGGACGT\n+\nEEEEEEEEEE\n@x:1\nCCCCCCAC\n+\nEEEEEEEE\n")
    pairs = text.fastq_pairs(spark, str(tmp_path / "a_R1.fastq"), str(tmp_path / "a_R2.fastq"))
    (tmp_path / "bc.tsv").write_text("TCTGGGCA\t55\n1\tGGGGGGGG\n")
    wl = text.barcode_file(spark, str(tmp_path / "bc.tsv"))
    assert {tuple(r) for r in wl.collect()} == {("TCTGGGCA", "55"), ("GGGGGGGG", "1")}
    got = {r.header[:2]: r for r in barcodes.demultiplexed(pairs, barcodes.LAYOUTS["CS2C8U6"], barcodes.expanded(wl, 1)).collect()}
    r = got["NS"]
    assert (r.rx, r.barcode, r["index"], r.hd, r.rest1, r.rest2, r.rr) == ("ATAATA", "TCTGGGCA", "55", 0, seq, "ACGT", None)
    assert got["x:"].rr == "barcode"
    h = pairs.select(*[v.alias(k) for k, v in text.illumina_header(F.col("header")).items()]).orderBy("RN").collect()[-1]
    assert (h.Is, h.La, h.Re, h.aA) == ("NS500414", "1", "1", "GTGAAA")
    back = text.fastq(spark, str(tmp_path / "a_R1.fastq"))
    sinks.write_fastq(back.withColumn("SM", F.col("record")), str(tmp_path / "out"), "SM")
    assert text.fastq(spark, str(tmp_path / "out" / "SM=0")).first().qual.startswith("@EEE")


def test_whitelist_ties(spark):
    one = barcodes.expanded(spark.createDataFrame([("AAA", 1)], "barcode string, index int"), 1)
    assert {"AAT", "CAA", "AGA", "TAA", "AAA", "NAA"} <= {r.observed for r in one.collect()}
    assert not {"TAT", "CCA", "GGA", "TCA"} & {r.observed for r in one.collect()}
    three = {r.observed: r for r in barcodes.expanded(spark.createDataFrame([("AAA", 1), ("AAT", 2), ("TTT", 3)], "barcode string, index int"), 2).collect()}
    assert (three["CTC"].barcode, three["CTC"].hd) == ("TTT", 2) and (three["TAA"].barcode, three["TAA"].hd) == ("AAA", 1)
    assert "AAG" not in three and "TCA" not in three and three["AAA"].hd == 0


def test_sam_bed_gtf_vcf_fasta(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@SQ\tSN:chr1\tLN:1000\nq1\t99\tchr1\t101\t60\t5S10M2D3M\t=\t150\t60\tACGTACGTACGTACGTAC\tEEEEEEEEEEEEEEEEEE\tRX:Z:CAT\tNM:i:1\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tEE\n")
    r = text.sam(spark, str(tmp_path / "a.sam")).orderBy("query_name").collect()
    assert (r[0].start_, r[0].end_, r[0].is_read1, r[0].proper, r[0].tags["RX"], r[1].unmapped, r[1].contig) == (100, 115, True, True, "CAT", True, None)
    assert text.contig_lengths(spark, str(tmp_path / "a.sam")).first().length_ == 1000
    assert sinks.tabulated(text.sam(spark, str(tmp_path / "a.sam")), ["query_name", "RX"]).orderBy("query_name").collect()[1].RX == "None"
    (tmp_path / "a.bed").write_text("chr1 10 20 x 0 +\nchr2\t5\nchr1\t100\t200\tb\t0\t-\t100\t200\t0\t2\t10,20,\t0,80,\n")
    assert sorted(map(tuple, text.bed(spark, str(tmp_path / "a.bed")).collect()), key=repr) == sorted([("chr1", 10, 20, "x", "+"), ("chr2", 5, 6, None, None), ("chr1", 100, 110, "b", "-"), ("chr1", 180, 200, "b", "-")], key=repr)
    (tmp_path / "a.gtf").write_text('#!x\n1\th\texon\t11\t20\t.\t+\t.\tgene_id "G1"; transcript_id "T1";\n1\th\tgene\t11\t90\t.\t+\t.\tgene_id "G1";\n')
    g = text.gtf(spark, str(tmp_path / "a.gtf"), ["exon"], ("gene_id", "transcript_id")).collect()
    assert [(x.f_start, x.f_end, x.f_name) for x in g] == [(10, 19, "G1,T1")]
    (tmp_path / "a.vcf").write_text(
        "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE_A\tSAMPLE_B\n1\t18\t.\tA\tT\t.\t.\t.\tGT\t1/1\t1/1\n1\t20\t.\tA\tT\t.\t.\t.\tGT\t0/0\t1/1\n1\t22\t.\tG\tA\t.\t.\t.\tGT\t0/0\t1/1\n1\t40\t.\tA\tC\t.\t.\t.\tGT\t./.\t1/1\n"
    )
    a = {(r.pos, r.base): r.samples for r in calls.informative_alleles(text.vcf(spark, str(tmp_path / "a.vcf"))).collect()}
    assert a == {(19, "A"): ["SAMPLE_A"], (19, "T"): ["SAMPLE_B"], (21, "G"): ["SAMPLE_A"], (21, "A"): ["SAMPLE_B"]}
    (tmp_path / "r.fa").write_text(">chr1 x\nACGT\nacg\n>chr2\nTT\n")
    assert sorted(map(tuple, text.fasta(spark, str(tmp_path / "r.fa"), 5).collect())) == [("chr1", 0, "ACGTA"), ("chr1", 5, "CG"), ("chr2", 0, "TT")]


def test_tolerant_molecules(spark):
    rows = [(1, "c1", 100, "CAT"), (2, "c1", 101, "CAT"), (3, "c1", 101, "CAG"), (4, "c1", 140, "CAT"), (5, "c2", 100, "CAT"), (6, "c1", 100, "GGG"), (7, "c1", 102, "NNT")]
    df = spark.createDataFrame(rows, "read_index long, sm string, site long, rx string")
    got = {r.read_index: r.molecule for r in molecules.assign(df, ["sm"], radius=2, hamming=1).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 1}
    full = {r.read_index: (r.molecule, r.overflow) for r in molecules.assign(df, ["sm"], radius=2, hamming=1, most=2).collect()}
    assert full[1] == (1, False) and full[3] == (3, True)
    zero = {r.read_index: r.molecule for r in molecules.assign(df, ["sm"], radius=2, hamming=0, pooling=0).collect()}
    assert zero[2] == 1 and zero[3] == 3


def test_methylation_update(spark):
    k = "sample string, contig string, pos long, methylated long, unmethylated long"
    base = spark.createDataFrame([("A", "chr1", 10, 0, 1), ("A", "chr2", 10, 0, 2)], k)
    merged = calls.merged_counts(base, spark.createDataFrame([("A", "chr2", 10, 2, 0), ("B", "chr2", 10, 1, 2)], k), "sample", "contig", "pos")
    totals = merged.agg(F.sum("methylated"), F.sum("unmethylated")).first()
    assert tuple(totals) == (3, 3)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("AANT", "AACC", "GATTACAAAAAAAAAAAATT")], "a string, b string, s string")
    r = df.select(S.hamming(F.col("a"), F.col("b")).alias("h"), S.reverse_complement(F.col("a")).alias("rc"), S.trim_poly_tail(F.col("s")).alias("t"), S.substitution_class(F.lit("G"), F.lit("A"), F.lit("T"), F.lit("C")).alias("k")).first()
    assert (r.h, r.rc, r.t, r.k) == (1, "ANTT", "GAT", "G[C>T]A")
