"""The Pitman-Yor scores: counts and base against brute force, seating against an exact sampler, probabilities against their sum."""

import copy
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import language

ROWS = [(i, " ".join(f"W{(i * k * k) % 23}" for k in range(1, 4 + i % 37))) for i in range(120)] + [(500, None), (501, ""), (502, "zz new words"), (503, "a\x0bb\tC"), (None, "w1 w2"), (7, "w1 w2"), (7, "w1 w2")]


def held():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in ROWS], "doc_id long, text string, score double")
    return language.log_probabilities(docs, held(), burn=1, samples=2).collect()


def key(r):
    return (-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.base_score)


def test_counts_and_base(scored):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in ROWS]
    c = Counter(w for (_, t), h in zip(ROWS, held, strict=True) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = [(i, h, len(tokens(t)), sum(w in c for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for (i, t), h in zip(ROWS, held, strict=True)]
    got = sorted(scored, key=key)
    want.sort(key=lambda r: (-1 if r[0] is None else r[0], r[2], r[5]))
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [w[:5] for w in want]
    assert np.allclose([r.base_score for r in got], [w[5] for w in want], rtol=1e-9)
    same = [r.score for r in scored if r.n_tokens == 3 and r.doc_id in (None, 7)]
    assert len(same) >= 3 and max(same) - min(same) < 1e-9


def test_better_than_base_on_held_out(scored):
    out = [r for r in scored if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_word_order_counts(spark):
    rows = [(i, " ".join(f"a{k}" for k in range(40))) for i in range(30)] + [(100, " ".join(f"a{k}" for k in range(40))), (101, " ".join(f"a{(k * 17) % 40}" for k in range(40)))]
    got = {r.doc_id: r for r in language.log_probabilities(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100, burn=1, samples=1).collect()}
    assert math.isclose(got[100].base_score, got[101].base_score, rel_tol=1e-9)
    assert got[100].score > got[101].score + 20


def test_same_in_any_number_of_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in ROWS], "doc_id long, text string")
    before, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    monkeypatch.setattr(language, "PART_TOKENS", 10)
    try:
        for parts in ("4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            out.append([(key(r), r.score) for r in sorted(language.log_probabilities(docs.repartition(int(parts) // 2), held(), burn=1, samples=1).collect(), key=key)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert np.allclose([x[1] for x in out[0]], [x[1] for x in out[1]], rtol=1e-9)


def small_part(seed=2):
    rng = np.random.default_rng(seed)
    key = np.unique(rng.integers(0, 5 * 12, 45))
    return language.Part(np.arange(1, 13, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(1, 6, dtype=np.uint64), key // 12, key % 12, rng.integers(1, 9, len(key)), np.zeros(0, np.int64))


def run(part, m, sweeps):
    """Sweeps in one place, as the operator makes them: with few dishes, moves that others see late weigh the most."""
    home = language.Home(part.words, part.sent(part.c))
    order = np.argsort(home.words)
    home = language.Home(home.words[order], home.known[order])
    back = np.argsort(order)
    part.seat(m, home.known[back], int(part.c.sum()), part.size)
    low, high = language.Alone(m.d1), language.Alone(m.d2)
    for k in range(sweeps):
        home.sweep(m, k, part.sent(part.t)[order], low)
        m.customers, m.tables = home.c.sum(), home.t.sum()
        yield home.c[back], home.t[back]
        part.sweep(m, k + 1, home.c[back], home.t[back], part.tables(), high)


def test_probabilities_sum_to_one():
    part = small_part()
    m = language.Model(0.6, 0.4, 1.0, 12, 0, 0, 3, 8)
    kept = []
    for k, (c1, t1) in enumerate(run(part, m, 6)):
        if k >= 3:
            part.keep(c1, t1, part.tables())
            kept.append(copy.copy(m))
            assert (part.t >= 1).all() and (part.t <= part.c).all()
    for v in range(5):
        ups, shares = part.averages(kept)
        p = part.predict(m, (ups, shares), np.full(12, v), np.arange(12))
        unknown = np.mean(shares[:, v] * (1 - ups.sum(1)))
        assert math.isclose(p.sum() + unknown, 1, rel_tol=1e-9) and unknown > 0


def exact_sampler(part, m, sweeps, seed):
    """One customer at a time over explicit tables, every move seen at once; mean tables of each dish, and of each word above."""
    rng = np.random.default_rng(seed)
    dishes = [[] for _ in part.c]  # table sizes
    above = [[] for _ in range(12)]
    total, up_total = np.zeros(5), [0, 0]

    def up_probability(w):
        return (sum(above[w]) - m.d1 * len(above[w]) + (m.strength + m.d1 * up_total[1]) * m.base) / (m.strength + up_total[0])

    def sit(tables, weight, d):
        w = np.array([x - d for x in tables] + [weight])
        k = rng.choice(len(w), p=w / w.sum())
        if k == len(tables):
            tables.append(1)
            return True
        tables[k] += 1
        return False

    def rise(tables):
        k = rng.choice(len(tables), p=np.array(tables) / sum(tables))
        tables[k] -= 1
        if tables[k] == 0:
            tables.pop(k)
            return True
        return False

    def add(i):
        v, w = part.of[i], part.word[i]
        if sit(dishes[i], (m.strength + m.d2 * total[v]) * up_probability(w), m.d2):
            total[v] += 1
            up_total[0] += 1
            if sit(above[w], (m.strength + m.d1 * up_total[1]) * m.base, m.d1):
                up_total[1] += 1

    def take(i):
        v, w = part.of[i], part.word[i]
        if rise(dishes[i]):
            total[v] -= 1
            up_total[0] -= 1
            if rise(above[w]):
                up_total[1] -= 1

    for i, c in enumerate(part.c):
        for _ in range(c):
            add(i)
    mean, up = np.zeros(len(part.c)), np.zeros(12)
    for s in range(sweeps):
        for i, c in enumerate(part.c):
            for _ in range(c):
                take(i)
                add(i)
        if s >= sweeps // 5:
            mean += [len(x) for x in dishes]
            up += [len(x) for x in above]
    n = sweeps - sweeps // 5
    return mean / n, up / n


def test_seating_against_exact_sampler():
    part = small_part(4)
    m = language.Model(0.6, 0.4, 1.0, 12, 0, 0, 3, 8)
    want, want_up = exact_sampler(part, m, 250, 1)
    mean, up, n = np.zeros(len(part.c)), np.zeros(12), 0
    for k, (_, t1) in enumerate(run(part, m, 1500)):
        if k >= 100:
            mean, up, n = mean + part.t, up + t1, n + 1
    assert abs(mean / n - want).max() < 0.4
    assert abs(mean.sum() / n - want.sum()) < 0.06 * want.sum() and abs(up.sum() / n - want_up.sum()) < 0.08 * want_up.sum()


def test_all_customers_move_in_a_sweep():
    """From all alone or all together, a few sweeps reach the mean of the distribution S(c, t) w**t of the tables."""
    d, w = 0.5, 6.0
    log = np.full(1501, -np.inf)
    log[0], want, t = 0.0, {}, np.arange(1, 1501)
    for c in range(1, 1501):
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(c - 1 - d * t, 0)) + log[1:]
        log = np.append(-np.inf, np.logaddexp(log[:-1], stay))
        if c in (40, 1500):
            p = np.exp(log[1:] + t * math.log(w) - (log[1:] + t * math.log(w)).max())
            want[c] = (p * t).sum() / p.sum()
    alone, key = language.Alone(d), np.arange(1, 501, dtype=np.uint64)
    for c, mean in want.items():
        for start in (1, c):
            t = np.full(500, start)
            for k in range(16):
                t = language.reseat(np.full(500, c), t, lambda at, now: np.full(len(at), w), alone, d, key, (1, k, 2), 8)
            assert (t >= 1).all() and (t <= c).all() and abs(t.mean() / mean - 1) < 0.06, (c, start, t.mean(), mean)


def test_alone_beyond_the_exact_table():
    for d in (0.3, 0.6, 0.9):
        alone = language.Alone(d)
        t = np.arange(1, language.EXACT)
        c = np.full(len(t), language.EXACT)
        exact, near = alone(c, t), alone(c + 1, t)
        assert near[0] == 0 and abs(near[1:] - exact[1:]).max() < 0.03
        assert alone(np.array([5, 5]), np.array([5, 1])).tolist() == [1, 0]


def test_empty_table(spark):
    assert language.log_probabilities(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).collect() == []


def test_arrays_as_bytes():
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 1 << 63, 100).astype(np.uint64), np.zeros(0, np.uint64), np.arange(300), np.array([1 << 40]), rng.random(7), np.zeros(0)]
    back = language.unpack(language.pack(*arrays))
    assert all(np.array_equal(a, b) for a, b in zip(arrays, back, strict=True))
    x = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    short = x >> np.uint64(64 - language._bits(x))
    assert len(np.unique(short)) == 1000 and language._bits(np.zeros(0, np.uint64)) == 1
