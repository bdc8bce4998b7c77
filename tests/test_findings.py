"""Findings of the reviews: odd inputs that the registered SQL does not reach at the smallest scale."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from cellweave.operators import annotation, calls, distances, intervals, pileup, sites, statistics
from cellweave.operators import bases as B
from cellweave.plans import registry

SF = "/root/testdata/sf0.001"



def test_coverage_goes_by_the_cigar(spark):
    """A read whose end_ lies before its last aligned base still covers that base."""
    rows = [("c", 1, "chr1", 100, 120, "30M", False, False), ("c", 2, "chr1", 100, 120, "10M25N5M", False, False), ("c", 3, "chr1", 126, 150, "30M", False, False)]
    reads = spark.createDataFrame(rows, "sm string, read_index long, contig string, start_ long, end_ long, cigar string, duplicate boolean, qcfail boolean")
    got = lambda pos: [tuple(r) for r in annotation.coverage_at(reads, "chr1", pos).collect()]
    assert got(125) == [("c", 1)] and got(137) == [("c", 2)] and got(115) == [("c", 1)]


def test_reference_past_a_contig_is_empty(spark):
    """A read that ends past its contig has no motif after it, which is known; a contig without reference is not."""
    genome = spark.createDataFrame([("chr1", 0, "ACGTCATGAC"), ("chr1", 10, "GGCATGTTAC")], "contig string, chunk_start long, seq string")
    rows = [(1, "chr1", 5, 12), (2, "chr1", 5, 20), (3, "chr1", 5, 43), (4, "chr9", 5, 12)]
    got = sites.around_start(spark.createDataFrame(rows, "k long, contig string, start_ long, end_ long"), genome).orderBy("k").collect()
    assert [r.downstream for r in got] == ["CATGTTA", "", "", None] and [r.upstream for r in got] == ["ACGTC"] * 3 + [None]


def test_name_blocks_can_be_written(spark, tmp_path):
    case = spark.conf.get("spark.sql.caseSensitive")
    names = registry.queries()["name_blocks"](spark, SF)
    names.write.parquet(str(tmp_path / "names"))
    assert names.sparkSession.read.parquet(str(tmp_path / "names")).count() == names.count() > 0
    assert spark.conf.get("spark.sql.caseSensitive") == case


def test_interpolation_sums_no_shrinking_frame(spark):
    """The rows after a target are no frame of their own, which would cost the square of a series."""
    points = spark.range(400).selectExpr("'c' as sm", "id * 10 as x", "cast(id * id as double) as y")
    targets = spark.range(-5, 4005).selectExpr("'c' as sm", "id as x")
    out = distances.interpolated(targets, points, "sm")
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower().replace("$", "").replace(" ", "").replace("()", "")
    got = {r.x: r.y for r in out.collect()}
    for x in range(-5, 4005):
        k = min(max(x, 0) // 10, 399)
        want = k * k if x <= 0 or k == 399 else k * k + (x - 10 * k) / 10 * (2 * k + 1)
        assert abs(got[x] - want) < 1e-6, x


def test_undigested_sites_meet_no_sequence(spark):
    """Sites within a span, across chunks and past the contig; reads are not joined to whole contigs."""
    seq = "CATGAACATGCATGTTTTCATGACGTACATG"
    genome = spark.createDataFrame([("chr1", seq)], "contig string, seq string")
    spans = [(a, z) for a in range(0, 34) for z in range(a, 38)]
    reads = spark.createDataFrame([(i, "chr1", a, z) for i, (a, z) in enumerate(spans)] + [(9999, "chr2", 0, 9)], "k long, contig string, start_ long, end_ long")
    for width in (4, 7, 1 << 13):
        out = sites.undigested_of_reads(reads, genome, F.when(F.col("k") % 2 == 0, "CATG"), width)
        got = {r.k: r.sites for r in out.collect()}
        assert got == {i: seq[a:z].count("CATG") - (i % 2 == 0) for i, (a, z) in enumerate(spans)}
    assert "seq" not in out.columns


def test_counts_without_pairs(spark):
    """Overlaps, sites and bases by group against all pairs: empty and repeated intervals, sites apart from their reads, two groups of
    which one is null, regions over many bins. No join compares positions other than for sites apart from their reads."""
    rng = random.Random(3)
    reads = []
    for i in range(300):
        a = rng.randrange(0, 400)
        z = a + rng.choice([0, 1, 5, 40, 130])
        reads.append((i, rng.choice(["chr1", "chr2"]), a, z, rng.choice([a, z, (a + z) // 2, a - 7, z + 9, None]), rng.choice(["u", "v", None]), rng.choice([0.5, 1.0, None])))
    regions = [(rng.choice(["chr1", "chr2", "chr3"]), a, a + rng.choice([0, 1, 3, 30, 300]), f"F{i % 40}") for i, a in enumerate(rng.choices(range(0, 450), k=80))]
    r = spark.createDataFrame(reads, "k long, contig string, start_ long, end_ long, ds long, g string, v double")
    f = spark.createDataFrame(regions, "contig string, f_start long, f_end long, f_name string")
    meet = [(x, y) for x in reads for y in regions if x[1] == y[0] and max(x[2], y[1]) < min(x[3], y[2])]
    n, total, site, base = Counter(), Counter(), Counter(), Counter()
    for x, y in meet:
        n[y[3], x[5]] += 1
        total[y[3], x[5]] += x[6] or 0
        site[y[3], x[5]] += x[4] is not None and y[1] <= x[4] <= y[2]
    for x in reads:
        for y in regions:
            if x[1] == y[0]:
                base[y[3], x[5]] += max(0, min(x[3], y[2] + 1) - max(x[2], y[1]))
    for size in (16, 128, None):
        found = intervals.overlap_sums(r, f, ["g"], ["f_name"], F.col("v"), size=size)
        assert "greatest" not in " ".join(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line)
        got = found.collect()
        assert {(x.f_name, x.g): x.n for x in got} == dict(n) and {(x.f_name, x.g): x.total or 0 for x in got} == dict(total)
        assert {(x.f_name, x.g): x.n for x in intervals.site_counts(r, f, ["g"], ["f_name"], size=size).collect()} == {k: v for k, v in site.items() if v}
        blocks = r.withColumnsRenamed({"start_": "b_start", "end_": "b_end"})
        assert {(x.f_name, x.g): x.n for x in intervals.covered_bases(blocks, f, ["g"], ["f_name"], size=size).collect()} == {k: v for k, v in base.items() if v}


def test_targets_distances_and_pairs_without_pairs(spark):
    """Coverage around targets, distances and numbered pairs against all pairs, with repeated cuts and targets at a contig's start."""
    rng = random.Random(5)
    rows = [(k, rng.choice("ab"), rng.choice(["chr1", "chr2"]), a, a + rng.choice([1, 20, 90]), rng.random() < 0.5) for k, a in enumerate(rng.choices(range(0, 3000), k=700))]
    reads = spark.createDataFrame(rows, "k long, sm string, contig string, start_ long, end_ long, is_reverse boolean").withColumns({"ds": F.col("start_"), "qcfail": F.lit(False), "duplicate": F.lit(False)})
    targets = spark.createDataFrame([(f"F{i}", rng.choice(["chr1", "chr2"]), a, a + 50, rng.choice("+-")) for i, a in enumerate(rng.choices(range(0, 3000), k=60))], "f_name string, contig string, f_start long, f_end long, f_strand string")
    for radius, step, extra in ((300, 20, 500), (31, 7, 9), (30, 7, 7)):
        new = distances.around_targets(reads, targets, radius, step, extra)
        assert "greatest" not in " ".join(line for line in new._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line)
        old = distances._around_targets_by_pairs(reads, targets, radius, step, extra)
        assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))
    cuts = sorted({(s, c, a) for _, s, c, a, _, _ in rows})
    want = Counter((x[0], (abs(x[2] - y[2]) - 1) // 7) for x in cuts for y in cuts if x[:2] == y[:2] and 0 < abs(x[2] - y[2]) <= 90)
    assert {(r.sm, r.bin): r.n for r in distances.all_distances(distances.cut_counts(reads, F.col("ds")), 90, 7).collect()} == dict(want)
    dense = spark.range(40_000).selectExpr("'a' as sm", "'chr1' as contig", "id as pos")
    assert {r.bin: r.n for r in distances.all_distances(dense, 300, 100).collect()} == {b: 2 * sum(40_000 - d for d in range(100 * b + 1, 100 * b + 101)) for b in range(3)}
    pairs = sorted({(x[1], x[2], x[3], y[3]) for x in rows for y in rows if x[1:3] == y[1:3] and not x[5] and y[5] and 0 < y[3] - x[3] < 80})
    got = sorted((r.bx, r.sm, r.contig, r.ds, r.pc) for r in distances.paired_cuts(reads, 80).collect())
    assert got == sorted((i, s, c, *p) for i, (s, c, a, z) in enumerate(pairs) for p in ((a, z), (z, a)))


def test_downsampling_is_spread(spark):
    """A few large counts are no one task's work: they are dealt out before they are hashed."""
    counts = spark.createDataFrame([("a", "x", 25_000), ("a", "y", 3), ("b", "x", 7), ("b", "y", 0)], "cell string, item string, n long")
    out = statistics.downsampled(counts, "cell", "item", 100)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    want = Counter()
    for cell in "ab":
        one = sorted((hashlib.md5(f"{cell}:{i}:{k}:1".encode()).hexdigest(), i) for c, i, n in [tuple(r) for r in counts.collect()] if c == cell for k in range(1, n + 1))
        want.update((cell, i) for _, i in one[:100])
    assert {(r.cell, r.item): r.n for r in out.collect()} == dict(want)


def test_stretches_give_the_same_bases(spark):
    """Symbols, counts, molecules, places and pile-ups by stretch against single bases: odd CIGARs, sequences that end early, lower
    case, a reference with N, reads over both ends of a contig and over tiles, mates that overlap."""
    rng = random.Random(11)
    genome = spark.createDataFrame([("chr1", "".join(rng.choice("ACGTCGN") for _ in range(1200)))], "contig string, seq string")
    cigars = ["20M", "5S10M3I7M2D4M", "3H2S18M", "6M30N9M4S", "8M8M", "40M", "*", None, "4=1X9M"]
    rows = [
        (i, f"q{i % 90}", "chr1", a, rng.random() < 0.5, i < 90, i >= 90, rng.choice(cigars), "".join(rng.choice("ACGTacgtN") for _ in range(rng.choice([0, 20, 25, 40]))), rng.choice(["I" * 40, "", None]))
        for i, a in enumerate(rng.choices([0, 1, 2, 3, 490, 505, 512, 600, 1180, 1190, 1199], k=180))
    ]
    reads = spark.createDataFrame(rows, "read_index long, query_name string, contig string, start_ long, is_reverse boolean, is_read1 boolean, is_read2 boolean, cigar string, seq string, qual string")
    pieces = B.symbol_pieces(B.aligned_pieces(B.with_reference(reads, B.reference_chunks(genome, 256, 128), 256), "query_name")).cache()
    bases = [tuple(r) for r in B.conversion_symbols(B.bases_of(pieces, "query_name")).select("query_name", "pos", "symbol", "is_reverse").collect()]
    assert bases and {s for _, _, s, _ in bases} == set(".zZxXhH")
    assert sorted(map(tuple, B.called_bases(pieces, "zZ", "query_name").select("query_name", "pos", "symbol", "is_reverse").collect())) == sorted(b for b in bases if b[2] in "zZ")
    assert {r.symbol: r.n for r in B.symbol_counts(pieces).collect()} == Counter(s for _, _, s, _ in bases)
    names = {q for q, *_ in bases}
    assert {r.query_name: r.xm for r in B.molecule_totals(pieces, "query_name").collect()} == {q: "".join(s for _, s in sorted((p, s) for n, p, s, _ in bases if n == q)) for q in names}
    places = spark.createDataFrame([("chr1", p) for p in range(0, 1500, 3)] + [("chr1", 0), ("chr2", 5)], "contig string, pos long")
    for inside in (True, False):
        got = Counter((r.query_name, r.pos) for r in B.bases_of(B.at_places(pieces, places, inside), "query_name").collect())
        assert got == Counter((q, p) for q, p, _, _ in bases if (p % 3 == 0) == inside)
    got = [tuple(r) for r in pileup.mate_pileup(pieces, reads, places).select("query_name", "pos", "read1", "read2").collect()]
    assert sorted(got) == sorted({(q, p, int(q[1:]), int(q[1:]) + 90) for q, p, _, _ in bases if p % 3 == 0})


def test_genes_are_counted_by_place(spark):
    """Many reads at a place meet its genes once; a read at several places counts each of their genes once."""
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.randrange(0, 150), rng.choice(["chr1", "chr2", None]), rng.choice([None, *range(0, 60)])) for _ in range(400)]
    genes = [("chr1", "A", 0, 20), ("chr1", "A", 25, 30), ("chr1", "B", 10, 40), ("chr2", "B", 5, 9), ("chr2", "C", 0, 59)]
    reads = spark.createDataFrame(rows, "sm string, read_index long, contig string, ds long")
    frame = spark.createDataFrame(genes, "contig string, gene string, f_start long, f_end long")
    has = {}
    for s, k, c, p in rows:
        has.setdefault((s, k), set()).update(g for gc, g, a, z in genes if c == gc and p is not None and a <= p <= z)
    want = Counter()
    for (s, _), names in has.items():
        for g in names:
            want[s, g] += 1 / len(names)
    got = {(r.sm, r.gene): r.n for r in calls.genes_by_place(reads, frame, "sm").collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
