"""Repeated byte strings against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from cellweave.llm import substrings


def brute(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + length] for _, b in raw for s in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefg é\n"))
    text = lambda n: "".join(rng.choice(letters, n))
    common = [text(n) for n in (150, 199, 210, 300, 900)]
    rows = []
    for i in range(60):
        parts = [text(rng.integers(0, 500))]
        for _ in range(rng.integers(0, 4)):
            c = common[rng.integers(0, len(common))]
            a = rng.integers(0, 60)
            parts += [c[a:], text(rng.integers(0, 120))]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "x" * 199), (103, "y" * 200), (104, "z" * 201), (105, "ab" * 400), (106, rows[5][1]), (107, "q" * 3000)]
    rows += [rows[7], rows[7], (108, "éü" * 90 + text(300) + "éü" * 90)]
    return rows


@pytest.mark.parametrize("together", [substrings.TOGETHER, 1])
def test_same_as_brute_force(spark, together):
    rows = corpus(together)
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, uid int, runs string")
    assert sorted(map(tuple, substrings.remove_repeats(docs, 200, together).collect()), key=repr) == brute(rows, 200)


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_multikey_order():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 5, 300) for _ in range(3))
    assert [(a[k], b[k], c[k]) for k in substrings.multikey_order(a, b, c)] == sorted(zip(a, b, c, strict=True))


def test_texts_longer_than_a_piece(spark):
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdefgh"), 1_300_000))
    docs = spark.createDataFrame([(1, long), (2, long[300_000:900_000]), (3, "-" * 40 + long[1_200_000:1_200_260])], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in substrings.remove_repeats(docs).collect()}
    assert got == {1: (1_300_000, 600_260, 2), 2: (600_000, 600_000, 1), 3: (300, 260, 1)}


def test_null_and_repeated_ids(spark):
    """Ids that are null, -1 or the same for different texts do not mix their spans; other columns called id do not clash."""
    rows = [(None if k % 3 == 0 else -1 if k % 3 == 1 else 7, t) for k, (_, t) in enumerate(corpus(21))]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, id string, uid int")
    assert sorted(map(tuple, substrings.remove_repeats(docs).collect()), key=repr) == brute(rows, 200)
