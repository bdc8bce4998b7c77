import json
import math

import numpy as np
import pytest

from cellweave.functions import sequence as S
from cellweave.operators import models as M
from cellweave.operators import molecules, pileup
from cellweave.sources import bam, sheets, sinks
from pyspark.sql import functions as F


def test_f_tail_is_the_integral():
    """Against the density's integral, and against the two-sided t of one degree."""
    for f, a, b in ((0.3, 1, 5), (2.0, 1, 40), (4.7, 3, 12), (1.0, 2, 2)):
        x = np.linspace(f, 2000 * f, 4_000_001) if b > 2 else None
        if x is not None:
            front = math.exp(math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2)) * (a / b) ** (a / 2)
            y = front * x ** (a / 2 - 1) * (1 + a * x / b) ** (-(a + b) / 2)
            assert abs(M.f_tail(f, a, b) - float(np.trapezoid(y, x))) < 2e-3
        else:
            assert abs(M.f_tail(f, a, b) - 1 / (1 + f)) < 1e-12
    assert M.f_tail(0, 1, 5) == 1.0 and M.f_tail(1e9, 1, 50) < 1e-100


def test_differential_against_cells(spark):
    """Sums by plate and cluster give the models of all cells one by one."""
    dice = np.random.default_rng(3)
    cells = [(f"c{k}", f"p{k % 3}", int(k % 2 == (k % 5 > 1))) for k in range(60)]
    counts = [(c, f"g{g}", int(dice.poisson(2 + g + 6 * cl * (g == 1)))) for c, _, cl in cells for g in range(4)]
    rows = [r for r in counts if r[2]]
    df = spark.createDataFrame([*rows, ("nobody", "g0", 5)], "cell string, gene string, n long")
    who = spark.createDataFrame([*cells, ("empty", "p0", 1), (None, "p0", 0), ("x", None, 1)], "cell string, plate string, cluster int")
    got = {r.gene: r for r in M.differential(df, who).collect()}
    total = {c: sum(n for d, _, n in counts if d == c) for c, _, _ in cells}
    null = np.array([[1.0, p == "p1", p == "p2"] for _, p, _ in cells], float)
    full = np.concatenate((null, np.array([[c] for _, _, c in cells], float)), 1)
    e = np.array([total[c] for c, _, _ in cells], float)
    for g in range(4):
        y = np.array([next(n for d, h, n in counts if d == c and h == f"g{g}") for c, _, _ in cells], float) + 1
        dev = []
        for x in (null, full):
            b, cov = M.poisson_fit(x, y, e)
            mean = e * np.exp(x @ b)
            dev.append(2 * float((y * np.log(y / mean) - (y - mean)).sum()))
        r = got[f"g{g}"]
        assert abs(r.f_score - (dev[0] - dev[1])) < 1e-6 and abs(r.cluster_coeff - b[-1]) < 1e-8 and abs(r.cluster_stderr - cov[-1, -1] ** 0.5) < 1e-8
        assert abs(r.p_value - M.f_tail(r.f_score, 1, 60 - 3)) < 1e-9
    assert got["g1"].p_value < 1e-3 < min(got["g0"].p_value, 0.5) or got["g1"].p_value < got["g0"].p_value
    assert M.differential(df.limit(0), who).collect() == []
    alike = who.withColumn("cluster", F.lit(1))
    assert M.differential(df, alike).collect() == []


def test_topics(spark):
    """Two groups of features that never meet are two topics."""
    rows = [(f"s{k}", f"f{4 * (k % 2) + j}", 20 + j) for k in range(12) for j in range(4)]
    weights, terms = M.topics(spark.createDataFrame([*rows, ("s0", None, 3), ("s0", "f9", 0)], "sm string, feature string, n int"), 2, 30, 5)
    w = {}
    for r in weights.collect():
        w.setdefault(r.sm, {})[r.topic] = r.weight
    top = {s: max(v, key=v.get) for s, v in w.items()}
    assert all(abs(sum(v.values()) - 1) < 1e-6 for v in w.values()) and top["s0"] == top["s2"] != top["s1"] == top["s3"]
    share = {}
    for r in M.reconstructed(weights, terms).collect():
        share.setdefault(r.sm, {})[r.feature] = r.share
    assert all(abs(sum(v.values()) - 1) < 1e-6 and len(v) == 8 for v in share.values()) and sum(share["s0"][f"f{j}"] for j in range(4)) > 0.8


@pytest.mark.parametrize("size", [3, 9, 30])
def test_smoothing_against_numpy(spark, size):
    """Mirrored edges, also where the reach is many times the matrix."""
    m = np.random.default_rng(size).random((size, 4))
    rows = [(i, j, float(m[i, j])) for i in range(size) for j in range(4)]
    got = np.zeros((size, 4))
    for r in M.smoothed(spark.createDataFrame(rows, "row int, column int, value double"), size, 4, (2.0, 0.5)).collect():
        got[r.row, r.column] = r.value

    def blur(a, sigma):
        reach = int(4 * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        return np.stack([np.pad(c, reach, mode="symmetric") for c in a.T]), w / w.sum()

    want = m
    for sigma, turn in ((2.0, False), (0.5, True)):
        a = want.T if turn else want
        padded, w = blur(a, sigma)
        a = np.stack([np.convolve(c, w, "valid") for c in padded]).T
        want = a.T if turn else a
    assert np.abs(got - want).max() < 1e-9


def test_complete_distances(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("d", "e")]
    df = spark.createDataFrame([(a, b, 0.5) for a, b in pairs], "a string, b string, distance double")
    names = spark.createDataFrame([(s,) for s in "abcdefa"] + [(None,)], "sm string")
    assert {(r.a, r.b) for r in M.complete_distances(df, names).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert M.complete_distances(df.limit(0), names.limit(0)).collect() == []


def test_places(spark):
    """Places lie in their contigs, as often as these are long, and again the same."""
    contigs = spark.createDataFrame([("a", 3_000_000), ("b", 1_000_000), ("c", 10), ("z", 0)], "contig string, length_ long")
    rows = pileup.random_places(contigs, 8000, 4).collect()
    n = [r.contig for r in rows]
    assert len(rows) == 8000 and abs(n.count("a") - 6000) < 200 and n.count("z") == 0
    assert all(0 <= r.pos < {"a": 3_000_000, "b": 1_000_000, "c": 10}[r.contig] for r in rows)
    assert set(rows) == set(pileup.random_places(contigs.repartition(3), 8000, 4).collect()) and pileup.random_places(contigs.limit(0), 5).collect() == []


def test_transitions(spark):
    bases = [(1, "c", 5, "T", "C", False), (1, "c", 6, "A", "G", True), (1, "c", 7, "G", "C", False), (1, "c", 8, "G", "G", False), (1, "c", 9, "A", "G", False), (2, "c", 5, "A", "A", False)]
    df = spark.createDataFrame(bases, "molecule int, contig string, pos long, base string, ref string, is_reverse boolean")
    consensus = spark.createDataFrame([(1, "c", 5, "T"), (1, "c", 6, "A"), (1, "c", 7, "G"), (1, "c", 8, "G"), (1, "c", 9, "G")], "molecule int, contig string, pos long, base string")
    (r,) = pileup.transition_tags(df, consensus, "molecule").collect()
    assert (r.mM, r.pP, r.pF, r.pR, r.pE) == (3, 2, 0, 2, "c:6 C>T,c:7 C>T")


def test_bam_round_trip(spark, tmp_path):
    """What is written is read again, sorted, in whole files that follow one another."""
    schema = "query_name string, flag int, contig string, start_ long, mapq int, cigar string, mate_contig string, mate_start long, isize long, seq string, qual string, tags map<string,string>"
    rows = [(f"r{k}", 16 * (k % 2), ["chr2", "chr10", None, "other"][k % 4], (k * 7919) % 5000, 60, "3S7M2D1M", "chr2", 9, -4, "ACGTNACGTAC", "I" * 11, {"RX": "ACG", "NM": str(k), "SM": "x"}) for k in range(400)]
    rows.append(("bare", 4, None, None, None, None, None, None, None, None, None, None))
    contigs = spark.createDataFrame([("chr2", 9000), ("chr10", 8000)], "contig string, length_ long")
    at = str(tmp_path / "out")
    bam.write_bam(spark.createDataFrame(rows, schema), contigs, at, [{"ID": "g1", "SM": "x"}], {"ID": "cw"}, part=50)
    got = bam.bam(spark, at).collect()
    assert len(got) == 401 and len({r.file for r in got}) > 8
    want = {r[0]: r for r in rows}
    for r in got:
        w = want[r.query_name]
        placed = w[2] in ("chr2", "chr10")
        assert r.contig == (w[2] if placed else None) and r.flag == w[1] and (r.query_name == "bare" or (r.start_, r.seq, r.qual, r.cigar, r.tags, r.isize, r.mate_contig, r.end_) == (w[3], w[9], w[10], w[5], w[11], -4, "chr2", w[3] + 10))
    files = {}
    for r in got:
        files.setdefault(r.file, []).append((r.contig is None, {"chr2": 0, "chr10": 1, None: 2}[r.contig], r.start_))
    assert all(v == sorted(v) and len(v) <= 50 for v in files.values())
    order = [files[f] for f in sorted(files)]
    assert all(a[-1] <= b[0] for a, b in zip(order, order[1:], strict=False))
    assert {(r.contig, r.length_) for r in bam.bam_contigs(spark, at).collect()} == {("chr2", 9000), ("chr10", 8000)}
    raw = next((tmp_path / "out").glob("*.bam")).read_bytes()
    assert raw.endswith(bam._EOF) and b"@RG\tID:g1\tSM:x\n@PG\tID:cw" in __import__("gzip").decompress(raw)


def test_sheets(spark, tmp_path):
    one = {"marks": {"l1": "k4", "l2": "k9"}, "libtype": {"l1": "chic"}, "layout_format": {"lay": "384"}, "well2index": {"384": {"A1": 1, "A2": 2}}, "layouts": {"lay": {"A1": "ctrl", "A2": "drug"}}}
    (tmp_path / "a.json").write_text(json.dumps(one, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"marks": {"l2": "k27", "l3": "k4"}}))
    sheet = sheets.sample_sheet(spark, str(tmp_path / "*.json"))
    assert {(r.key, r.value) for r in sheet.where("section = 'marks'").collect()} == {("l1", "k4"), ("l2", "k27"), ("l3", "k4")}
    assert {r.key for r in sheets.without_libraries(sheet, ["l2"], ["k4"]).where("section in ('marks', 'libtype')").collect()} == set()
    assert {tuple(r) for r in sheets.well_conditions(sheet, "lay").collect()} == {(1, "A1", "ctrl"), (2, "A2", "drug")}


def test_reports_and_tracks(spark, tmp_path):
    (tmp_path / "r.grp").write_text("#:Report.v1.1:2\n#:Table:2:3:%s:%s:;\n#:Table:Arguments:what\nArgument  Value\na  1\nb  2\nodd\n\n#:Table:3:1:%d:%d:%d:;\n#:Table:Counts:more\nx y z\n1 2 3\n")
    got = {(r.table, r.row, r.column, r.value) for r in sheets.report_tables(spark, str(tmp_path / "r.grp")).collect()}
    assert got == {("Arguments", 0, "Argument", "a"), ("Arguments", 0, "Value", "1"), ("Arguments", 1, "Argument", "b"), ("Arguments", 1, "Value", "2"), ("Counts", 0, "x", "1"), ("Counts", 0, "y", "2"), ("Counts", 0, "z", "3")}
    (tmp_path / "t.bedgraph").write_text("track type=bedGraph\n#c\nchr1\t0\t15\t2\nchr1\t15\t20\t8.0\nchr1\t30\t30\t9\n")
    track = sheets.bedgraph(spark, str(tmp_path / "t.bedgraph"))
    assert {(r.bin_start, r.value) for r in sheets.binned_track(track, 10).collect()} == {(0, 2.0), (10, 5.0)}
    (tmp_path / "i.tsv").write_text("chrom\tlength\nchr1\t200\n")
    assert sheets.tabbed(spark, str(tmp_path / "i.tsv")).collect()[0].asDict() == {"chrom": "chr1", "length": "200"}
    introns = spark.createDataFrame([("chr1", "+", "g", 5, 9)], "contig string, strand string, gene_id string, intron_start long, intron_end long")
    sinks.write_introns(introns, str(tmp_path / "gtf"))
    assert spark.read.text(str(tmp_path / "gtf")).first().value == 'chr1\t.\tintron\t5\t9\t.\t+\t.\tgene_id "g";'
    assert sinks.merged(introns, introns.drop("strand")).where("strand is null").count() == 1


def test_names_and_bounds(spark):
    names = ["APKS3-P23-1-1s_cell18", "APKS2_15_NLAP1_cell7", "APKS1P25-NLAP1L2s_9", "X-P4-NLAP2L1_33", None, "odd"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", S.cell_name(F.col("n")).alias("c"))
    got = {r.n: tuple(r.c) if r.c else None for r in df.collect()}
    assert got[names[0]] == ("APKS3", 23, "1-1", 18) and got[names[1]] == ("APKS2", 15, "NLAP1", 7) and got[names[2]] == ("APKS1", 25, "1-2", 9) and got[names[3]] == ("X", 4, "2-1", 33)
    m = spark.createDataFrame([(1, 5, 30, 1, 40, True), (2, 2, 10, 3, 40, False), (3, None, 60, 1, 90, True)], "id int, fragments int, max_mapq int, reactions int, span int, has_both boolean")
    ids = lambda **k: {r.id for r in molecules.filtered(m, **k).collect()}
    assert ids() == {1, 2, 3} and ids(fragments=(2, 4)) == {2} and ids(reactions_=(None, 2), both_mates=True) == {1, 3} and ids(span=(50, None)) == {3} and ids(mapq=(None, 30)) == {1, 2}
