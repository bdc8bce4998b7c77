"""Aligned bases, digestion, unmixing and copy-number profiles against small brute-force versions."""

import numpy as np
from pyspark.sql import functions as F

from cellweave.operators import bases as B
from cellweave.operators import segmentation, variants


def test_aligned_bases(spark):
    rows = [("a", "1", False, 10, "2S3M1I2M2D2M", "TTACGATCGA", "IIIIIIIIII"), ("b", "1", True, 5, "3M", "ACG", "I#I"), ("c", "1", False, 5, None, "ACG", "III"), ("d", "1", False, 5, "2M", None, None)]
    reads = spark.createDataFrame(rows, "name string, contig string, is_reverse boolean, start_ long, cigar string, seq string, qual string")
    got = {(r.name, r.pos): (r.base, r.qual, r.cycle) for r in B.aligned_bases(reads, "name").collect()}
    want = {("a", 10): ("A", 40, 2), ("a", 11): ("C", 40, 3), ("a", 12): ("G", 40, 4), ("a", 13): ("T", 40, 6), ("a", 14): ("C", 40, 7), ("a", 17): ("G", 40, 8), ("a", 18): ("A", 40, 9)}
    assert got == want | {("b", 5): ("A", 40, 2), ("b", 6): ("C", 2, 1), ("b", 7): ("G", 40, 0)}


def test_reference_and_symbols(spark):
    seq = "ACGTTCAGACCTTGGCATCGA" * 3
    genome = spark.createDataFrame([("1", seq), ("empty", ""), ("none", None)], "contig string, seq string")
    reads = spark.createDataFrame([("1", s, 1, f"{len(seq) - 1}M", seq.replace("C", "T")[1:] if not s else seq[1:], None) for s in (False, True)] + [("2", False, 1, "4M", "ACGT", None)],
                                  "contig string, is_reverse boolean, start_ long, cigar string, seq string, qual string")
    chunks = B.reference_chunks(genome, width=16, halo=64)
    assert {r.contig for r in chunks.collect()} == {"1"}
    got = {(r.contig, r.is_reverse, r.pos): r.symbol for r in B.conversion_symbols(B.aligned_bases(B.with_reference(reads, chunks, 16))).collect()}
    flip = str.maketrans("ACGT", "TGCA")
    for reverse in (False, True):
        for pos in range(2, len(seq) - 2):
            three = seq[pos - 2:pos + 1].translate(flip)[::-1] if reverse else seq[pos:pos + 3]
            kind = "." if three[0] != "C" else "z" if three[1] == "G" else "x" if three[2] == "G" else "h"
            assert got["1", reverse, pos] == (kind if reverse else kind.upper())
    assert {v for k, v in got.items() if k[0] == "2"} == {"."}


def test_digestion(spark):
    seq = "ggCATGaaaaCATGttCATGc"
    genome = spark.createDataFrame([("1", seq), ("2", "CATG"), ("3", None), ("4", "")], "contig string, seq string")
    got = {tuple(r) for r in variants.digested_fragments(genome, "CATG", 8, 8).collect()}
    assert got == {("1", 2, "+", "CATGAAAA"), ("1", 10, "-", "CATGTTTT"), ("1", 10, "+", "CATGTTCA"), ("1", 16, "-", "CATGAACA")}


def test_unmixing_is_calibrated_and_stable(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 2).alias("bin"), F.lit("c").alias("sm"))
    p = spark.createDataFrame([(0, "c", 0.2)], "bin long, sm string, p double")
    out = variants.unmixed(rows, p, F.col("id"))
    n = {(r.bin, r.signal): r["count"] for r in out.groupBy("bin", "signal").count().collect()}
    assert abs(n[0, "A"] / 2000 - 0.2) < 0.03 and n[1, None] == 2000
    again = variants.unmixed(rows.repartition(3), p, F.col("id"))
    assert out.orderBy("id").collect() == again.orderBy("id").collect()


def test_lowess_finds_a_line_and_forgives_an_outlier():
    x = np.linspace(0, 1, 60)
    y = 3 * x + 1
    assert np.allclose(segmentation.lowess(y, x), y)
    y2 = y.copy()
    y2[30] = 50
    assert np.abs(np.delete(segmentation.lowess(y2, x) - y, 30)).max() < 0.1
    assert segmentation.lowess(np.array([1.0, 3.0]), np.array([0.5, 0.5])).tolist() == [2.0, 2.0]


def test_gc_correction_flattens_a_trend(spark):
    rows = [("c", k, float(10 + 20 * (k % 50) / 50), (k % 50) / 50) for k in range(200)] + [("empty", 1, 0.0, None)]
    got = segmentation.gc_corrected(spark.createDataFrame(rows, "sm string, bin long, n double, gc double"), 10.0).collect()
    assert all(abs(r.copies - 2) < 0.01 for r in got if r.sm == "c") and [r.copies for r in got if r.sm == "empty"] == [None]


def test_scaling_and_segments_and_clones(spark):
    rng = np.random.default_rng(3)
    truth = np.repeat([2, 4, 2, 1], [60, 30, 40, 30])
    rows = [("c", "1", k, float(v * 0.9 + e)) for k, (v, e) in enumerate(zip(truth, rng.normal(0, 0.03, len(truth)), strict=True))] + [("c", "2", 0, 1.8), ("c", "3", 1, None)]
    df = spark.createDataFrame(rows, "sm string, contig string, bin long, copies double")
    scaled = {r.bin: r.copies for r in segmentation.scale_to_integers(df.where("contig = '1'")).collect()}
    assert all(abs(scaled[k] - v) < 0.35 for k, v in enumerate(truth))
    got = sorted(segmentation.segments(df, shuffles=200).collect())
    assert got == sorted(segmentation.segments(df.repartition(3), shuffles=200).collect())
    ones = [r for r in got if r.contig == "1"]
    assert {60, 90, 130} <= {r.start_bin for r in ones} and sum(r.bins for r in ones) == len(truth)
    assert [r.bins for r in got if r.contig == "2"] == [1] and not [r for r in got if r.contig == "3"]
    cells = spark.createDataFrame([(s, "1", b, c) for s, c in (("a", 2.1), ("b", 1.9), ("c", 3.0)) for b in (0, 1)] + [("d", "1", 0, None)], "sm string, contig string, bin long, copies double")
    assert sorted(tuple(r) for r in segmentation.clones(cells, 2).collect()) == [("a", "a", 2), ("b", "a", 2)]
