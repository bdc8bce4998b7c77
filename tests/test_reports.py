import gzip
import struct
import zlib

import pytest
from cellweave.operators import reports as R
from cellweave.sources import bam
from pyspark.sql import functions as F


def block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, flag, ref, pos, mapq, cigar, seq, qual, tags=b"", mate=-1, mate_pos=-1):
    ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(op)) for n, op in cigar)
    codes = ["=ACMGRSVTWYHKDBN".index(x) for x in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), mate, mate_pos, 0)
    body += name.encode() + b"\0" + ops + packed + bytes(qual) + tags
    return struct.pack("<i", len(body)) + body


def header():
    text = b"@HD\tVN:1.6\n"
    return b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + n + b"\0" + struct.pack("<i", k) for n, k in ((b"chr1", 1000), (b"chrM", 90)))


def test_bam(spark, tmp_path):
    tags = b"RXZCAT\0" + b"NMC\x07" + b"xsf" + struct.pack("<f", 0.5) + b"arBs" + struct.pack("<ihh", 2, -3, 4) + b"ccAq"
    data = header() + record("q1", 99, 0, 100, 60, [(2, "S"), (4, "M"), (2, "D"), (1, "M")], "ACGTACN", [30] * 7, tags) + record("q2", 4, -1, -1, 0, [], "", [])
    data += b"".join(record(f"m{i}", 0, 1, i % 80, 9, [(3, "M")], "ACG", [255] * 3) for i in range(12_000))
    raw = b"".join(block(data[i : i + 60_000]) for i in range(0, len(data), 60_000)) + block(b"")
    assert gzip.decompress(raw) == data
    (tmp_path / "a.bam").write_bytes(raw)
    (tmp_path / "b.bam").write_bytes(block(header()) + block(b""))
    got = bam.bam(spark, str(tmp_path))
    assert got.count() == 12_002
    one, two = got.where("query_name like 'q%'").orderBy("query_name").collect()
    assert (one.contig, one.start_, one.end_, one.cigar, one.seq, one.qual, one.proper, one.is_read1) == ("chr1", 100, 107, "2S4M2D1M", "ACGTACN", "?" * 7, True, True)
    assert one.tags == {"RX": "CAT", "NM": "7", "xs": "0.5", "ar": "s,-3,4", "cc": "q"}
    assert (two.contig, two.start_, two.unmapped, two.seq, two.qual, two.cigar, two.tags) == (None, -1, True, "*", "*", "*", {})
    assert got.where("contig = 'chrM'").agg(F.max("end_"), F.min("qual")).first() == (82, "*")
    assert {(r.contig, r.length_) for r in bam.bam_contigs(spark, str(tmp_path)).collect()} == {("chr1", 1000), ("chrM", 90)}
    (tmp_path / "c.bam").write_bytes(block(b"text"))
    with pytest.raises(Exception, match="not a BAM file"):
        bam.bam(spark, str(tmp_path / "c.bam")).count()


def test_transcript_pass(spark):
    tx, t = "ACGACGAC", "T" * 5
    rows = [
        ("umi", "N" * 11 + "TAxx", "E" * 15, "1", "GGCATTTA" + tx + t + "CC", "ACGTACGTAAAAAAAAAACC", None),
        ("edge", "N" * 15, "E" * 15, "1", tx + t, "ACGT", None),
        ("mate", "N" * 15, "E" * 15, "1", "CCCC", "GG" + "A" * 5 + "GTCGTCGT" + "TTAACC", None),
        ("poly", "N" * 15, "E" * 15, "1", "T" * 23, "ACGT", None),
        ("t7", "N" * 15, "E" * 15, "1", "CCAGTCCGACGATCC", "ACGT", None),
        ("late", "N" * 15, "E" * 15, "1", "C" * 30 + "AGTCCGACGAT", "ACGT", None),
        ("gone", "N" * 15, "E" * 15, None, "CCCC", "ACGT", "barcode"),
        ("null", None, None, "2", None, None, None),
    ]
    pairs = spark.createDataFrame(rows, "name string, r1 string, q1 string, index string, rest1 string, rest2 string, rr string")
    out = {r.name: r for r in R.transcript_pass(pairs, spark.createDataFrame([("1", tx)], "index string, tx_barcode string")).collect()}
    assert len(out) == 8
    assert (out["umi"].dt, out["umi"].rx_tx, out["umi"].lh, out["umi"].lq, out["umi"].rr) == ("VASA", "CATTTA", "TA", "EE", None) and out["umi"].rest2 == "ACGTA"
    assert (out["edge"].dt, out["edge"].rx_tx) == ("VASA", None)
    assert (out["mate"].dt, out["mate"].rx_tx) == ("VASA", "GGTTAA")
    assert (out["poly"].dt, out["poly"].rr, out["t7"].dt, out["t7"].rr, out["late"].dt, out["late"].rr) == ("CHIC", "PolyT", "VASA", "T7_found", "CHIC", None)
    assert (out["gone"].rr, out["null"].dt, out["null"].rr, out["null"].rest2) == ("barcode", "CHIC", None, None)


def test_nearest_opposite_over_window_borders(spark):
    import random

    rng = random.Random(4)
    cuts = [(s, "1", rng.random() < 0.5, rng.randrange(3000)) for s in "ab" for _ in range(90)] + [("c", "1", True, 5), ("c", "1", False, 9), (None, "1", True, 4), ("a", "1", True, None)]
    want = {}
    for s in "ab":
        f, r = ({p for x, _, rev, p in cuts if x == s and rev is k and p is not None} for k in (False, True))
        for kind, of, to in (("forward", f, r), ("reverse", r, f)):
            for p in of:
                for side, ds in (("above", [x - p for x in to if 0 < x - p < 40]), ("below", [p - x for x in to if 0 < p - x < 40])):
                    if ds:
                        k = (f"{kind}_{side}", min(ds))
                        want[k] = want.get(k, 0) + 1
    df = spark.createDataFrame(cuts, "sm string, contig string, is_reverse boolean, ds long")
    for size in (64, 1 << 18):
        assert {(r.kind, r.distance): r.n for r in R.nearest_opposite(df, 40, size).collect()} == want


def test_bias_correction_flattens_a_biased_count(spark):
    bins = spark.range(200).select(F.col("id").alias("bin"), (F.col("id") % 2 * 1.0).alias("gc"), F.when(F.col("id") > 0, F.col("id") % 3).alias("sites"))
    counts = bins.select(F.lit("a").alias("cell"), "bin", (10 + 30 * F.col("gc")).cast("long").alias("n"))
    out = R.bias_corrected(counts, bins, ["gc", "sites"], F.col("bin") < 150, trees=20)
    low, high = (out.where(F.col("bin") % 2 == k).agg(F.avg("corrected")).first()[0] for k in (0, 1))
    assert out.count() == 200 and abs(low - 0.5) < 0.03 and abs(high - 0.5) < 0.03


def test_filters_without_rows(spark):
    empty = spark.createDataFrame([], "query_name string, mapq int, seq string")
    assert R.pair_filter(empty, 5, homopolymer=3).count() == 0
    calls = spark.createDataFrame([(0, 0), (1, 1), (9, 1), (None, 2)], "ad_ref int, ad_alt int")
    assert [tuple(r) for r in R.frequency_filter(calls, 0.25).collect()] == [(1, 1)]
