import numpy as np

from cellweave.llm import decontam


def brute_score(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best


def test_alignment_score():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 14)).astype(np.uint64), rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64)
        assert decontam.smith_waterman(a, b) == brute_score(a.tolist(), b.tolist())


def test_planted_passages(spark):
    rng = np.random.default_rng(6)
    words = [f"v{k}" for k in range(900)]
    items = [list(rng.choice(words, n)) for n in (2, 12, 20, 45, 60)]
    rows, expected = [], set()
    for i in range(120):
        w = list(rng.choice(words, rng.integers(1, 300)))
        if i % 4 == 0:
            k = int(rng.integers(0, 5))
            p = list(items[k])
            for _ in range(len(p) // 10):
                p[rng.integers(0, len(p))] = "edit"
            if k == 3:
                p.insert(20, "more")
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = [x.upper() for x in p]
            expected.add((i, k))
        rows.append((i, " \n".join(w)))
    rows += [(500, None), (501, ""), (502, "pad " * 30_000 + " ".join(items[2]))]
    expected.add((502, 2))
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, item_id int, score string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    got = decontam.contaminated(docs, bench).collect()
    assert expected <= {(r.doc_id, r.item_id) for r in got}
    assert {(r.doc_id, r.item_id) for r in got if r.item_id != 0} == {e for e in expected if e[1] != 0}
    assert decontam.contaminated(docs.limit(0), bench).collect() == []
    assert decontam.contaminated(docs, bench.limit(0)).collect() == []


def test_common_passages_keep_their_rarest_seeds(spark):
    text = " ".join(f"c{k}" for k in range(25))
    docs = spark.createDataFrame([(i, f"a{i} {text} b{i}") for i in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert decontam.contaminated(docs, bench).count() == 300


def test_many_scores_at_once():
    rng = np.random.default_rng(8)
    a = [rng.integers(0, 6, rng.integers(1, 14)).astype(np.uint64) for _ in range(80)]
    b = [rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64) for _ in range(80)]
    want = [brute_score(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]
    assert decontam.smith_waterman_many(a, b).tolist() == want
    index = decontam.Index([])
    index.words, index.sizes = a, np.array([len(x) for x in a])
    index.vocabulary = np.arange(6, dtype=np.uint64)
    index.of_item, index.times = np.unique(np.concatenate([k * 6 + x.astype(np.int64) for k, x in enumerate(a)]), return_counts=True)
    assert (index.bounds(np.arange(80), b) >= want).all()


def test_edited_copies_of_a_common_passage(spark):
    """Copies with one edit in common hold only seeds that many documents hold; so do edited copies beside many exact ones."""
    words = [f"d{k}" for k in range(40)]
    same = [*words[:20], "edit", *words[21:]]
    rows = [(i, f"a{i} {' '.join(same)} b{i}") for i in range(400)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.score) for r in got) == [(i, round(77 / 80, 6)) for i in range(400)]
    rows = [(i, f"a{i} {' '.join(words)} b{i}") for i in range(1000)]
    for i in range(1000, 1050):
        w = list(words)
        w[5 + i % 30] = "edit"
        rows.append((i, f"a{i} {' '.join(w)} b{i}"))
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.score) for r in got) == [(i, 1.0 if i < 1000 else round(77 / 80, 6)) for i in range(1050)]
