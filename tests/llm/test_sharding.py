import zlib
from collections import Counter

import numpy as np
import pytest

from cellweave.llm import sharding


def smallest_capacity(sizes, shards):
    def need(c):
        n, at = 1, 0
        for s in sizes:
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if need(mid) <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(12))
def test_cuts(seed):
    rng = np.random.default_rng(seed)
    sizes = sorted(rng.integers(1, 50, rng.integers(1, 200)).tolist() + [int(rng.integers(1, 3000))] * (seed % 3), reverse=True)
    shards = int(rng.integers(1, 30))
    runs = sorted(Counter(sizes).items(), reverse=True)
    capacity, cuts = sharding.minimax_cuts(runs, shards)
    assert capacity == smallest_capacity(sizes, shards)
    ends = np.cumsum(sizes).tolist()
    bounds = [0, *cuts, sum(sizes)]
    assert len(cuts) == shards - 1 and cuts == sorted(cuts) and set(bounds) <= {0, *ends}
    assert max(np.diff(bounds)) <= capacity


def test_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "é" * int(rng.integers(0, 60)) + str(i % 150)) for i in range(400)] + [(900, None), (901, ""), (902, "x" * 20_000), (5, "5"), (None, "n")] + [(1000 + i, "hot") for i in range(150)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, size int")
    got = sharding.shard_by_bytes(docs, 7, buckets=4).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    by: dict = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 7
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 7
    place: dict = {}
    for r in got:
        place.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for s in place.values())
    total, sums = sum(r.size for r in got), Counter()
    for r in got:
        sums[r.shard] += r.size
    rest = sorted(sums.values())[:-1]  # the long text has a shard of its own
    assert max(rest) - min(rest) < 0.1 * total / 7
    assert sharding.shard_by_bytes(docs.limit(0), 7).collect() == []
