"""The Jaccard join against brute force."""

import re
from fractions import Fraction

import numpy as np
import pytest

from cellweave.llm import jaccard


def brute(rows, n, ratio):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = sorted(sets)
    up, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if ratio.denominator * both >= ratio.numerator * len(sets[a] | sets[b]):
                    links[a] += 1
                    links[b] += 1
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), root(i), links[i]) for i in ids}


def corpus(seed, docs=160):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = list(rng.choice(vocabulary, 40))
    base = [list(rng.choice(vocabulary, rng.integers(1, 220))) for _ in range(docs // 4)]
    rows = []
    for i in range(docs):
        w = list(base[rng.integers(0, len(base))])
        for _ in range(rng.integers(0, 6)):
            w[rng.integers(0, len(w))] = str(rng.choice(vocabulary))
        if rng.random() < 0.4:
            w = shared + w
        rows.append((i * 3, " ".join(w).upper() if rng.random() < 0.1 else "\n".join(w)))
    return rows + [(1000, None), (1001, ""), (1002, "  \t"), (1003, "a"), (1004, "A"), (1005, "a b c"), (1006, "b a c")]


@pytest.mark.parametrize(("n", "ratio", "options"), [(4, Fraction(85, 100), {}), (5, Fraction(4, 5), {"shard": 8, "sketch_bits": 10, "frequent": 0.0})])
def test_same_as_brute_force(spark, n, ratio, options):
    rows = corpus(n)
    docs = spark.createDataFrame([(i, t, "key", 1) for i, t in rows], "doc_id long, text string, key string, class int")
    got = {tuple(r) for r in jaccard.jaccard_join(docs, n, ratio, **options).collect()}
    assert got == brute(rows, n, ratio)


def test_empty_table(spark):
    assert jaccard.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 60, dtype=np.int64).astype(np.uint64)) for _ in range(150)]
    for k in range(0, 140, 7):
        sets[k + 1] = np.unique(np.concatenate((sets[k][:-2], sets[k + 1][:2])))
    ratio = Fraction(85, 100)
    tree = jaccard.RTree(np.array([jaccard.count_vector(s, 16) for s in sets]), np.array([len(s) for s in sets]), ratio)
    found = {(min(a, b), max(a, b)) for x, y in tree.pairs() for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    true = {(a, b) for a in range(150) for b in range(a + 1, 150) if len(np.intersect1d(sets[a], sets[b])) * 100 >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert true <= found and true
    assert len(found) < 150 * 149 / 4


def test_null_and_repeated_ids(spark):
    words = [f"w{k}" for k in range(60)]
    a, near = " ".join(words), " ".join([*words[:59], "x"])
    b, near_b = " ".join(f"v{k}" for k in range(60)), " ".join([*(f"v{k}" for k in range(59)), "y"])
    rows = [(None, a), (5, near), (1, a + " tail"), (1, b), (2, a), (3, near_b), (None, None), (None, "alone here is one"), (9, b), (9, b)]
    got = sorted(((r.doc_id, r.component_id, r.n_links) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    # 1 stands for a text of the first group and for one of the second; both groups have it as their smallest id
    assert got == sorted([(None, 1, 3), (5, 1, 3), (1, 1, 3), (2, 1, 3), (1, 1, 3), (3, 1, 3), (9, 1, 3), (9, 1, 3), (None, None, 0), (None, None, 0)], key=repr)
    docs = spark.createDataFrame([(None, a), (5, near)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.n_links) for r in jaccard.jaccard_join(docs).collect()} == {(None, 5, 1), (5, 5, 1)}


def test_any_threshold(spark):
    """At low thresholds sets whose vectors are four times as wide are compared."""
    words = [f"u{k}" for k in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words[:138])), (2, " ".join(words[:267])), (3, " ".join(words[290:]))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_join(docs, 4, Fraction(51, 100)).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_shards_at_any_count():
    sketch = np.ones(1 << 10, np.int64)
    sketch[3], sketch[4] = 10**9, 5000
    shards = jaccard.shards_by_slot(sketch, 1024, 4.0)
    assert shards[3] == 0 or shards[3] > 1
    sketch = np.full(1 << 20, 100, np.int64)
    sketch[3], sketch[4] = 10**9, 5000
    shards = jaccard.shards_by_slot(sketch, 1024, 4.0)
    assert shards[3] == jaccard.WAYS and shards[4] == 5 and shards[5] == 0


def test_large_blocks_in_tiles(spark):
    """Blocks of over eight shards are dealt into tiles where they meet; nothing is lost."""
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 80, 2):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in jaccard.jaccard_join(docs, 4, Fraction(7, 10), shard=4, frequent=1e9).collect()}
    assert got == brute(rows, 4, Fraction(7, 10))


def test_groups_are_whole_and_few_at_once():
    """Batches of sorted rows become tables of whole groups, none much larger than its largest group or the bound."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    for size in (1, 7, 50, 400):
        key = np.sort(rng.integers(0, 60, 500))
        key[100:300] = key[100]
        key = np.sort(key)
        rows = pa.RecordBatch.from_pydict({"a": key // 8, "b": key % 8, "v": np.arange(500)})
        got = list(jaccard._whole([rows.slice(k, size) for k in range(0, 500, size)], "a", "b", most=800))
        assert np.concatenate([t["v"].to_numpy() for t in got]).tolist() == list(range(500))
        groups = [set((t["a"].to_numpy() * 8 + t["b"].to_numpy()).tolist()) for t in got]
        assert sum(len(g) for g in groups) == len(set(key.tolist()))
        assert len(got) > 1
    assert list(jaccard._whole([], "a")) == []


def test_members_of_frequent_shingles_are_copied_few_times(spark, monkeypatch):
    """Copies of a member follow the bands of sizes that it meets, not the number of members; and nothing is lost."""
    entries, made = [], jaccard.map_batches
    monkeypatch.setattr(jaccard, "map_batches", lambda df, f, schema: entries.append((schema, made(df, f, schema))) or entries[-1][1])
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(120):
        w = base[: int(rng.integers(20, 60))]
        w[int(rng.integers(0, len(w)))] = f"e{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in jaccard.jaccard_join(docs, 4, Fraction(4, 5), shard=4, frequent=0.5).collect()}
    assert got == brute(rows, 4, Fraction(4, 5))
    copies = next(df for schema, df in entries if schema.startswith("token"))
    most = {r["class"]: r.n for r in copies.groupBy("token", "class").count().groupBy("class").agg({"count": "max"}).toDF("class", "n").collect()}
    assert max(most.values()) == 2


def test_only_texts_that_are_asked_for_are_moved(spark):
    """Of 2,000 rows a bitmap leaves the wanted and few others; null is a key, too."""
    from cellweave.llm.frames import maybe_in

    rows = spark.createDataFrame([(k,) for k in range(2000)] + [(None,)], "doc_id long")
    wanted = spark.createDataFrame([(7,), (70,), (None,), (5000,)], "id long")
    kept = {r.doc_id for r in maybe_in(rows, "doc_id", wanted, "id").collect()}
    assert kept >= {7, 70, None} and len(kept) < 10
    assert {r.doc_id for r in maybe_in(rows, "doc_id", wanted, "id", "left_anti").collect()} == set(range(2000)) - kept
    assert {None, 7, 70} <= {r.doc_id for r in maybe_in(rows, "doc_id", wanted, "id", bits=1).collect()}
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in jaccard.keep_one(docs).collect()), key=repr) == sorted([(1, "a b c d e f"), (None, "a b c d e f"), (3, None)], key=repr)


def test_sizes_within_the_ratio_share_or_follow_a_band():
    for ratio in (Fraction(85, 100), Fraction(4, 5), Fraction(51, 100), Fraction(1)):
        least = jaccard.size_bands(ratio)
        for n in [*range(1, 3000), 10**6, 10**9 + 7]:
            a, b = np.searchsorted(least, [n, n * ratio.denominator // ratio.numerator], "right")
            assert b - a <= 1
