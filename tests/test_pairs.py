"""Joins that list pairs, and what was found without them, against brute force; and that pairs are never moved."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellweave.operators import annotation, calls, intervals, molecules, reports

FEATURES = "contig string, f_start long, f_end long, f_strand string, f_name string, gene string"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def drawn(seed: int, n: int = 60):
    rng = random.Random(seed)
    starts = [rng.randrange(900) for _ in range(n)]
    return [(rng.choice("ab"), s, s + rng.choice((0, 3, 40, 300)), rng.choice("+-"), f"F{k}", rng.choice("GHIJ")) for k, s in enumerate(starts)]


def placed(df):
    """The runs of equal (contig, place) in each part of a frame, and its rows."""
    runs, rows, last = 0, 0, None
    for r in df.select(F.spark_partition_id().alias("part"), "contig", "place").collect():
        now = (r.part, r.contig, r.place)
        runs, rows, last = runs + (now != last), rows + 1, now
    return runs, rows


def test_pairs_of_one_place_come_together(spark):
    """Reads of one place, far apart in the input, give their pairs one after another."""
    f = spark.createDataFrame(drawn(1), FEATURES)
    rng = random.Random(2)
    points = [(k, rng.choice("ab"), rng.randrange(40) * 25) for k in range(1500)]
    reads = spark.createDataFrame(points, "k long, contig string, ds long").repartition(8).withColumns({"place": F.col("ds"), "start_": F.col("ds"), "end_": F.col("ds") + 30})
    for got in (intervals.points_in(reads, f), intervals.overlaps(reads, f), intervals.covering_both_ends(reads, f)):
        runs, rows = placed(got)
        assert rows > 5 * runs and runs <= 2 * 2 * 40


@pytest.mark.parametrize("most", [4096, 3])
def test_pairs_against_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(intervals, "LIST", most)
    f = drawn(3)
    rng = random.Random(4)
    r = [(k, rng.choice("ab"), s := rng.randrange(950), s + rng.choice((0, 20, 200)), rng.random() < 0.5) for k in range(150)]
    r += [(900, None, 5, 9, True), (901, "a", None, None, True)]
    features, reads = spark.createDataFrame(f, FEATURES), spark.createDataFrame(r, "k long, contig string, start_ long, end_ long, is_reverse boolean")
    pairs = [(a, b) for a in r for b in f if a[1] == b[0] and a[2] is not None]
    listed = lambda df: Counter((x.k, x.f_name) for x in df.collect())
    assert listed(intervals.points_in(reads, features, "start_")) == Counter((a[0], b[4]) for a, b in pairs if b[1] <= a[2] <= b[2])
    assert listed(intervals.points_in(reads, features, "start_", strand=True)) == Counter((a[0], b[4]) for a, b in pairs if b[1] <= a[2] <= b[2] and b[3] == "+-"[a[4]])
    assert listed(intervals.overlaps(reads, features)) == Counter((a[0], b[4]) for a, b in pairs if max(a[2], b[1]) <= min(a[3], b[2]))
    assert listed(intervals.covering_both_ends(reads, features)) == Counter((a[0], b[4]) for a, b in pairs if b[1] <= a[2] and b[2] >= a[3])


@pytest.mark.parametrize("shared", [False, True])
def test_block_features_move_no_pairs(spark, shared):
    """Each feature of a read once, whichever blocks meet it; only shared keys and names are put together."""
    rng = random.Random(5)
    cigars = ["10M25N5M", "20M2I10M", "30M4S", "5M10D5M40N9M", "0M7M", "4M300N4M"]
    r = [(k, rng.choice("ab"), rng.randrange(900), rng.choice(cigars)) for k in range(120)]
    f = drawn(6)
    if shared:
        r += [(k, "a", 3 * k, "20M") for k in range(0, 120, 7)]
        f += [("a", 100 + k, 130 + k, "+", f"F{k}", "G") for k in range(0, 60, 5)]
    got = annotation.features_of_blocks(spark.createDataFrame(r, "k long, contig string, start_ long, cigar string"), spark.createDataFrame(f, FEATURES), "k")
    want = set()
    for k, c, at, cigar in r:
        for n, op in __import__("re").findall(r"(\d+)([MIDNS])", cigar):
            if op == "M" and int(n):
                want |= {(k, x[4]) for x in f if x[0] == c and max(at, x[1]) <= min(at + int(n) - 1, x[2])}
            at += int(n) if op in "MDN" else 0
    rows = [tuple(x) for x in got.collect()]
    assert sorted(rows) == sorted(want)
    assert shared or "Aggregate [k" not in plan(got)


def test_splicing_makes_no_pairs(spark):
    """As the state of all hits: names that repeat, long and short reads, reads of two rows, introns, unknown genes."""
    rng = random.Random(7)
    f = [(c, a, z, s, f"F{rng.randrange(40)}", g if rng.random() < 0.9 else None, "intron" if rng.random() < 0.2 else "exon") for c, a, z, s, _, g in drawn(8, 90)]
    features = spark.createDataFrame(f, FEATURES + ", kind string").withColumn("transcript", F.col("f_strand"))
    r = [(k, rng.choice("abc"), s := rng.randrange(900), s + rng.choice((0, 3, 30, 5000))) for k in range(200)]
    for several in ([], [(k, "a", 9 * k, 9 * k + 5) for k in range(0, 90, 4)]):
        reads = spark.createDataFrame(r + several, "k long, contig string, start_ long, end_ long")
        hits = reads.alias("r").join(features.alias("f"), F.expr("r.contig = f.contig and greatest(start_, f_start) <= least(end_, f_end)")).drop("contig")
        want = calls.spliced_state(hits, "k").select("k", F.array_join("genes", ","), F.array_join("junctions", ","), "it")
        got = calls.spliced_spans(reads, features, "k")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert several or "f_name" not in plan(got).split("FlatMapCoGroupsInPandas")[0]


def test_opposite_cuts_by_growing_frames(spark):
    """No frame over a range, which would cost rows times the cuts in range."""
    rng = random.Random(9)
    r = [(rng.choice("st"), "a", rng.randrange(700), rng.random() < 0.5) for _ in range(300)]
    got = reports.nearest_opposite(spark.createDataFrame(r, "sm string, contig string, ds long, is_reverse boolean"), 40, size=64)
    assert "rangeframe" not in plan(got).lower()
    want, cuts = Counter(), set(r)
    for s, _, p, rev in cuts:
        other = [q for t, _, q, v in cuts if t == s and v != rev]
        kind = "reverse" if rev else "forward"
        for side, d in (("above", [q - p for q in other if 0 < q - p < 40]), ("below", [p - q for q in other if 0 < p - q < 40])):
            want.update([(f"{kind}_{side}", min(d))] if d else [])
    assert {(x.kind, x.distance): x.n for x in got.collect()} == want


def test_neighbours_are_sought_once_a_place(spark):
    """A window over a tile holds places, not the points that stand at them."""
    f = drawn(10)
    points = [(k, "a", 17 * (k % 20)) for k in range(400)] + [(500, None, 4), (501, "z", 4)]
    got = intervals.nearest(spark.createDataFrame(points, "read_index long, contig string, ds long"), spark.createDataFrame(f, FEATURES))
    windows = plan(got)[plan(got).index("Window"):]
    assert "read_index" not in windows.split("Aggregate")[0] and "Aggregate [_c" in windows
    want = {(k, max((x[2] for x in f if x[0] == c and x[2] <= p), default=None), min((x[1] for x in f if x[0] == c and x[1] >= p), default=None)) for k, c, p in points if c}
    assert {(x.read_index, x.left_end, x.right_start) for x in got.collect()} == want


def test_runs_are_sought_among_positions(spark):
    rng = random.Random(11)
    r = [(k, "s", 10 * rng.randrange(30) + rng.randrange(3)) for k in range(500)]
    df = spark.createDataFrame(r, "read_index long, sm string, site long")
    got = molecules.near_groups(df, ["sm"], "site", 8)
    assert not any("Window" in x and "read_index" in x for x in plan(got).splitlines())
    at = sorted({p for _, _, p in r})
    runs = {}
    for before, p in zip([None, *at], at, strict=False):
        runs[p] = p if before is None or p - before > 8 else runs[before]
    assert {(x.read_index, x.session) for x in got.collect()} == {(k, runs[p]) for k, _, p in r}


@pytest.mark.parametrize("pooling", [0, 1])
@pytest.mark.parametrize("radius", [0, 1, 7])
def test_molecules_by_bucket(spark, pooling, radius):
    """The first molecule that accepts a fragment, as if all were asked."""
    rng = random.Random(12 + radius)
    r = [(k, "s", s := rng.randrange(-60, 120), s + rng.choice((0, 5, 20)), "".join(rng.choice("AC") for _ in range(3))) for k in range(400)]
    df = spark.createDataFrame(r, "read_index long, sm string, site long, z long, rx string")
    got = {x.read_index: x.molecule for x in molecules.assign(df, ["sm"], radius=radius, hamming=1, pooling=pooling, end="z").collect()}
    found, want = [], {}
    for k, _, p, e, u in r:
        def fits(m):
            edges = [(m["low"], m["high"], max(m["n"], key=m["n"].get))] if pooling else m["all"]
            return any(min(abs(p - a), abs(e - z)) <= radius and molecules.umi_matches(u, v, 1) for a, z, v in edges)

        home = next((m for m in found if fits(m)), None)
        if home is None:
            found.append(home := {"id": k, "low": p, "high": e, "n": {}, "all": []})
        home["low"], home["high"] = min(p, home["low"]), max(e, home["high"])
        home["n"][u] = home["n"].get(u, 0) + 1
        home["all"].append((p, e, u))
        want[k] = home["id"]
    assert got == want
