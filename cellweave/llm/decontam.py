"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman scores decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.arrow import map_batches, small_batches
from cellweave.llm.words import shingles, word_hashes

#: Words of a seed; items up to these totals are broadcast as one index, larger benchmarks are taken in parts.
SEED = 3
ITEMS_PER_PART = 20_000
WORDS_PER_PART = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of the windows that are scored together, at most (a single window may be longer).
WORDS_TOGETHER = 200_000


class Index:
    """Benchmark items as word hashes, and their seeds as sorted hashes with the items and places of each."""

    def __init__(self, items: list[tuple[int, str | None]], seed: int = SEED):
        self.ids = [i for i, _ in items]
        self.words: list[np.ndarray] = []
        for _, _, h, b in word_hashes(pa.array([t for _, t in items], pa.string())):
            self.words.extend(h[b[k] : b[k + 1]] for k in range(len(b) - 1))
        key, item, place = [], [], []
        for k, w in enumerate(self.words):
            g, _ = shingles(w, np.array([0, len(w)]), seed)
            key.append(g)
            item.append(np.full(len(g), k))
            place.append(np.arange(len(g)))
        key = np.concatenate(key) if key else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.item = (np.concatenate(item) if item else np.zeros(0, int))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, int))[order]
        self.keys, self.first = np.unique(key[order], return_index=True)
        self.first = np.append(self.first, len(key))
        self.seed = seed
        self.mask = np.zeros(1 << 20, bool)
        self.mask[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        words = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        self.vocabulary, code = np.unique(words, return_inverse=True)
        own = np.repeat(np.arange(len(self.words)), self.sizes) * len(self.vocabulary) + code
        self.of_item, self.times = np.unique(own, return_counts=True)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in grams of those that are seeds, and which."""
        at = np.flatnonzero(self.mask[(grams >> np.uint64(44)).astype(np.int64)])
        k = np.searchsorted(self.keys, grams[at])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == grams[at] if len(self.keys) else np.zeros(len(at), bool)
        return at[ok], k[ok]

    def bounds(self, items: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
        """What the score of each window with its item is at most: a match for each item word that the window holds."""
        words, which = np.concatenate(windows), np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        code = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        ok = self.vocabulary[code] == words
        which, own = which[ok], items[which[ok]] * len(self.vocabulary) + code[ok]
        at = np.minimum(np.searchsorted(self.of_item, own), len(self.of_item) - 1)
        ok = self.of_item[at] == own
        held = np.unique(which[ok] * len(self.of_item) + at[ok])
        return MATCH * np.bincount(held // len(self.of_item), self.times[held % len(self.of_item)], len(windows)).astype(np.int64)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> int:
    """The best local score of two word sequences, one row of numpy per word of a.

    Gaps within b are resolved by a running maximum, since a gap of k words costs k * GAP."""
    n = len(b)
    slope = -GAP * np.arange(n + 1)
    row, best = np.zeros(n + 1, np.int64), 0
    for w in a:
        hit = np.where(b == w, MATCH, MISMATCH)
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(np.maximum(row[:-1] + hit, row[1:] + GAP), 0)
        row = np.maximum.accumulate(new + slope) - slope
        best = max(best, int(row.max()))
    return best


def smith_waterman_many(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """smith_waterman of each pair, over all pairs at once; what fills up the shorter ones matches nothing."""
    n, m = max(len(x) for x in a), max(len(x) for x in b)
    left, is_left = np.zeros((len(a), n), np.uint64), np.zeros((len(a), n), bool)
    right, is_right = np.zeros((len(b), m), np.uint64), np.zeros((len(b), m), bool)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        left[k, : len(x)], is_left[k, : len(x)] = x, True
        right[k, : len(y)], is_right[k, : len(y)] = y, True
    slope = (-GAP * np.arange(m + 1)).astype(np.int32)
    row, best = np.zeros((len(a), m + 1), np.int32), np.zeros(len(a), np.int32)
    for r in range(n):
        hit = np.where((right == left[:, r, None]) & is_right & is_left[:, r, None], np.int32(MATCH), np.int32(MISMATCH))
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(np.maximum(row[:, :-1] + hit, row[:, 1:] + np.int32(GAP)), 0)
        row = np.maximum.accumulate(new + slope, axis=1) - slope
        best = np.maximum(best, row.max(axis=1))
    return best


def _scores(index: Index, items: np.ndarray, windows: list[np.ndarray], threshold: float, known: dict[bytes, int]) -> np.ndarray:
    """The Smith-Waterman score of each window with its item, or -1 where it provably stays under the threshold."""
    out = np.full(len(windows), -1, np.int64)
    asked: dict[bytes, list[int]] = {}
    for k in np.flatnonzero(index.bounds(items, windows) / (MATCH * index.sizes[items]) >= threshold):
        key = int(items[k]).to_bytes(4, "little") + windows[k].tobytes()
        if key in known:
            out[k] = known[key]
        else:
            asked.setdefault(key, []).append(k)
    # windows of like length together, so that little is filled up
    order = sorted(asked.items(), key=lambda x: len(x[0]))
    while order:
        longest, n = len(windows[order[-1][1][0]]), len(order)
        now, order = order[-max(1, WORDS_TOGETHER // longest) :], order[: max(0, n - max(1, WORDS_TOGETHER // longest))]
        got = smith_waterman_many([index.words[items[w[0]]] for _, w in now], [windows[w[0]] for _, w in now])
        for (key, w), s in zip(now, got.tolist(), strict=True):
            out[w] = s
            if len(known) < 20_000:
                known[key] = s
    return out


def _grams(texts: pa.Array, seed: int):
    """(text, its words, its n-grams) of every text."""
    for i, j, h, bounds in word_hashes(texts):
        g, at = shingles(h, bounds, seed)
        yield i, j, h, bounds, g, at


def align(docs: DataFrame, items: list[tuple[int, str | None]], threshold: float, seed: int = SEED) -> DataFrame:
    """The documents' alignments with items that fit into one index, all of whose items have seed words at least."""
    index = Index(items, seed)

    def work(b: pa.RecordBatch):
        out: dict[str, list] = {"doc_id": [], "item_id": [], "score": [], "first_word": [], "last_word": []}
        known: dict[bytes, int] = {}
        ids = b.column(0)
        for i, j, h, bounds, g, at in _grams(b.column(1), index.seed):
            pos, k = index.find(g)
            if not len(pos):
                continue
            # every (seed in the text, place in an item)
            n = index.first[k + 1] - index.first[k]
            p = np.repeat(pos, n)
            e = np.arange(n.sum()) + np.repeat(index.first[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            doc = np.searchsorted(at, p, "right") - 1
            word = p - at[doc]
            item, start = index.item[e], word - index.place[e]
            order = np.lexsort((start, item, doc))
            doc, item, start = doc[order], item[order], start[order]
            size = index.sizes[item]
            # one window for starts that lie within an item's length of each other
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > size[1:])
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(doc)) - 1
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            held: list[tuple[int, int, int, int, np.ndarray]] = []
            total = 0

            def score_held(held=held, best=best) -> None:
                q = np.array([x[1] for x in held], np.int64)
                for (d, q, a, z, _), s in zip(held, _scores(index, q, [x[4] for x in held], threshold, known).tolist(), strict=True):
                    score = s / (MATCH * len(index.words[q]))
                    if s >= 0 and score > best.get((d, q), (-1.0,))[0]:
                        best[d, q] = (score, a, z)
                held.clear()

            for f, t in zip(heads, tails, strict=True):
                d, q = int(doc[f]), int(item[f])
                text = h[bounds[d] : bounds[d + 1]]
                slack = int(size[f]) // 2 + 2
                lo, hi = max(0, int(start[f]) - slack), min(len(text), int(start[t]) + int(size[f]) + slack)
                for a in range(lo, hi, 4096):  # windows of bounded length that overlap by more than an item
                    z = min(hi, a + 4096 + 2 * int(size[f]) + slack)
                    held.append((d, q, a, z, text[a:z]))
                    total += z - a
                    if total >= 5 * WORDS_TOGETHER:
                        score_held()
                        total = 0
                    if z == hi:
                        break
            if held:
                score_held()
            for (d, q), (s, lo, hi) in best.items():
                if s >= threshold:
                    out["doc_id"].append(ids[i + d].as_py())
                    out["item_id"].append(index.ids[q])
                    out["score"].append(round(s, 6))
                    out["first_word"].append(lo)
                    out["last_word"].append(hi - 1)
        return out

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, item_id long, score double, first_word long, last_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): documents that hold a passage aligned to a benchmark item.

    score is the Smith-Waterman score of words (match 2, mismatch -1, gap -1) over twice the item's words, so that 1 is
    the whole item; rows of at least threshold return, one for each document row and item, with the words of the window
    was aligned. Seeds are the item's runs of three words (the whole item when it is shorter), each of which leads to an
    alignment however many documents hold it; a window is left out only when it holds too few of the item's words to reach
    the threshold. The benchmark is checked for its size and taken in parts that fit.

    Null or empty texts and items match nothing; null ids stay null; repeated documents repeat; empty tables give no rows;
    other columns are not read."""
    size = benchmark.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    parts = max(1, -(-size.n // ITEMS_PER_PART), -(-(size.chars or 0) // (4 * WORDS_PER_PART)))
    out = None
    for p in range(parts):
        rows = benchmark.select("item_id", "text").where("text is not null")
        if parts > 1:
            rows = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        by_seed: dict[int, list] = {}
        for item in sorted(((r.item_id, r.text) for r in rows.collect()), key=repr):
            n = sum(len(h) for _, _, h, _ in word_hashes(pa.array([item[1]], pa.string())))
            by_seed.setdefault(min(n, SEED), []).append(item)
        by_seed.pop(0, None)
        for n, items in sorted(by_seed.items()) or [(SEED, [])]:
            part = align(docs, items, threshold, n)
            out = part if out is None else out.unionByName(part)
    return out


def op10(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
