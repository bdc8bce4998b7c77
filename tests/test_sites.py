"""What the registered SQL does not reach: equality by protocol, fits, tags, segmentation by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import sequence as S
from cellweave.operators import assignment, distances, haplotypes, molecules, segmentation, windows

READS = [  # name, start, end, reverse, cell, umi
    ("A", 100, 106, False, "CELL_1", "CAT"), ("B", 102, 108, False, "CELL_1", "CAT"), ("C", 110, 116, False, "CELL_1", "CAT"), ("D", 105, 111, True, "CELL_1", "CAT"),
    ("E", 105, 111, True, "CELL_2", "CAT"), ("F", 105, 111, True, "CELL_2", "CAG"), ("G", 102, 136, False, "CELL_1", "CAT"),
]


def frame(spark, names, umi=None):
    rows = [(k, n, a, z, r, s, umi if umi and n == "F" else u) for k, (n, a, z, r, s, u) in enumerate(x for x in READS if x[0] in names)]
    return spark.createDataFrame(rows, "read_index long, name string, start_ long, end_ long, is_reverse boolean, sm string, rx string").withColumn("contig", F.lit("chr1"))


def equal(spark, names, rule, umi=None):
    got = assignment.with_molecules(frame(spark, names, umi), rule).collect()
    return len({r.molecule for r in got}) == 1


@pytest.mark.parametrize(("names", "same"), [("AB", True), ("AG", True), ("AC", False), ("AD", False), ("CD", False), ("DE", False)])
def test_generic_equality(spark, names, same):
    assert equal(spark, names, assignment.Rule(("sm", "contig", "is_reverse"), radius=2)) is same


def test_umi_distance(spark):
    rule = assignment.Rule(("sm", "contig", "is_reverse"), radius=2, hamming=1)
    assert equal(spark, "EF", rule) and not equal(spark, "EF", rule, "GGG")


def test_only_edges_count(spark):
    """A fragment within a molecule's span, but far from both of its edges, is one of its own."""
    rows = [(0, 100, 500, "A"), (1, 250, 300, "A"), (2, 101, 320, "A"), (3, 255, 501, "A")]
    df = spark.createDataFrame(rows, "read_index long, start_ long, end_ long, rx string").withColumns({"sm": F.lit("c"), "contig": F.lit("1"), "is_reverse": F.lit(False)})
    got = {r.read_index: r.molecule for r in assignment.with_molecules(df, assignment.Rule(("sm", "contig", "is_reverse"), radius=2)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0}


def brute(rows, radius, hamming):
    """Greedy, in order: the first molecule whose span's edge is near and whose commonest UMI fits."""
    found, out = [], {}
    for i, cell, a, z, u in rows:
        for m in found:
            mode = max(m["u"], key=m["u"].get)
            if m["cell"] == cell and min(abs(a - m["a"]), abs(z - m["z"])) <= radius and sum(x != y for x, y in zip(u, mode, strict=True)) <= hamming:
                break
        else:
            m = {"id": i, "cell": cell, "a": a, "z": z, "u": {}}
            found.append(m)
        m["a"], m["z"], m["u"][u] = min(m["a"], a), max(m["z"], z), m["u"].get(u, 0) + 1
        out[i] = m["id"]
    return out


@pytest.mark.parametrize("tile", [1 << 20, 64])
def test_assign_against_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(windows.running_max, "__defaults__", (tile,))
    rng = np.random.default_rng(5)
    rows = [(i, f"c{rng.integers(0, 3)}", int(a), int(a + rng.integers(5, 60)), "".join(rng.choice(list("AC"), 3))) for i, a in enumerate(rng.integers(0, 2000, 600))]
    df = spark.createDataFrame(rows, "read_index long, sm string, start_ long, end_ long, rx string")
    got = {r.read_index: r.molecule for r in molecules.assign(df, ["sm"], "start_", "rx", 2, 1, end="end_").collect()}
    assert got == brute(rows, 2, 1)


def test_transcripts_and_methods(spark):
    rows = [(0, ["a", "b"], "AC"), (1, ["b"], "AC"), (2, ["c"], "AC"), (3, ["a"], "GG"), (4, [], "AC")]
    df = spark.createDataFrame(rows, "read_index long, genes array<string>, rx string").withColumns({"sm": F.lit("s"), "contig": F.lit("1"), "is_reverse": F.lit(False)})
    assert {r.read_index: r.molecule for r in assignment.tagged(df, "vasa").collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    assert {r.molecule for r in assignment.tagged(df, "qflag").collect()} == {0, 1, 2, 3, 4}
    assert len(assignment.METHODS) == 18
    with pytest.raises(ValueError):
        assignment.tagged(df, "none")


def test_md_and_contexts(spark):
    rows = spark.createDataFrame([("ACGT", "ACGT"), ("ACGT", "AGGA"), ("NNNN", "ACGT"), ("", ""), (None, "A")], "a string, b string")
    assert [r.md for r in rows.select(S.md_tag(F.col("a"), F.col("b")).alias("md")).collect()] == ["4", "1C1T", "NNNN", "", None]
    one = spark.range(1).select(S.base_in_context(F.lit("ACG"), F.lit("T")).alias("c"), S.file_type(F.lit("x/Y.FASTQ.gz")).alias("f")).first()
    assert (one.c, one.f) == ("ATG", "fastq")


def test_consensus_reads_have_md(spark):
    rows = [("m", "1", p, b, r) for p, b, r in ((5, "A", "A"), (6, "C", "G"), (7, "N", "T"), (8, "T", "T"))]
    got = haplotypes.consensus_reads(spark.createDataFrame(rows, "molecule string, contig string, pos long, base string, ref string"), "molecule").collect()
    assert sorted((r.start_, r.cigar, r.seq, r.md) for r in got) == [(5, "2M", "AC", "1G"), (8, "1M", "T", "1")]


def test_damped_cosine(spark):
    x = np.arange(0, 1000)
    y = 120 * np.cos(2 * np.pi * (x + 5) / 190) * np.exp(-x / 600) + 300
    df = spark.createDataFrame([("c", float(a), float(b)) for a, b in zip(x, y, strict=True)], "sm string, distance double, n double")
    r = distances.damped_cosine(df).first()
    assert abs(r.period - 190) < 3 and abs(r.amplitude - 120) < 10 and abs(r["mean"] - 300) < 3 and abs(r.decay - 600) < 90


def test_arc_statistic_against_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(20):
        x = rng.normal(size=rng.integers(6, 25))
        n, least = len(x), 2
        best = 0.0
        for i in range(n):
            for j in range(i + least, n + 1):
                k = j - i
                if k == n or 0 < i < least or 0 < n - j < least or n - k < least:
                    continue
                inner, outer = x[i:j].mean(), np.delete(x, np.s_[i:j]).mean()
                best = max(best, abs(inner - outer) / np.sqrt(1 / k + 1 / (n - k)))
        path = np.concatenate(([0.0], np.cumsum(x)))[None, :]
        (got,), (i,), (j,) = segmentation.arc_statistics(path, least)
        assert np.isclose(got, best)


def test_segment_calls(spark):
    rows = [("c", "1", 0, 0, 4, 5, 2.1, 2.0), ("c", "1", 1, 5, 9, 5, 1.9, 2.1), ("c", "1", 2, 10, 14, 5, 3.0, 3.2)]
    cut = spark.createDataFrame(rows, "sm string, contig string, segment int, start_bin long, end_bin long, bins long, copies double, median double")
    assert sorted((r.start_bin, r.end_bin, r.bins, r.copy_number) for r in segmentation.segment_calls(cut).collect()) == [(0, 9, 10, 2), (10, 14, 5, 3)]


def test_recalled_counts_every_row(spark):
    """A germline base that an alternative molecule has in two reads counts twice in its share."""
    at = ("chr1", 5, "C", "T")
    calls = spark.createDataFrame([(1, "s1", *at, "A"), (2, "s1", *at, "A"), (3, "s1", *at, "A"), (4, "s2", *at, "R"), (5, "s3", *at, "R")], "molecule long, sm string, contig string, pos long, ref string, alt string, call string")
    phased = spark.createDataFrame([(1, "A"), (1, "A"), (2, "C"), (3, "G"), (4, "A"), (5, "C")], "molecule long, g_base string").withColumns({"g_contig": F.lit("chr1"), "g_pos": F.lit(9)})
    got = sorted((r.sm, r.present) for r in haplotypes.recalled(calls, phased, 0.5).collect())
    assert got == [("s1", 1), ("s2", 0)]
