"""N-gram Jaccard join: count-vector R-trees over the classes that share a seed shingle, survivors verified exactly.

1. Every whole text becomes a set of shingle hashes; documents of equal sets are one class.
2. Shingles are ordered (frequent ones last, then by hash). Two sets of the wanted similarity share a shingle among the
   first (1 - t) n + 1 of each, so the classes that share one of these form a block, and all pairs lie in blocks.
   A block of a frequent shingle is dealt into tiles of two neighbouring bands of set sizes each, beyond which no sets are
   similar, and only what is still large into tiles of two shards each.
3. In a block each class is a point, its shingle counts by hash group; an R-tree over the points prunes every pair of
   boxes, then of points, whose summed coordinate minima cannot reach the overlap. What survives connects candidates.
4. The sets of connected candidates come together once (large components again in tiles), run through an R-tree of
   finer groups, and the surviving pairs are verified by exact intersection sizes."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.arrow import PIECE_BYTES, map_batches, pieces, released, small_batches
from cellweave.llm.frames import collect_garbage, components, cut, drop, maybe_in, partitions, written
from cellweave.llm.words import shingles, word_hashes

#: Slots of the frequency sketch, as bits; members of a shard of a large block or component; children of a tree node.
SKETCH_BITS = 20
SHARD = 1024
WAYS = 256
#: Shards of a frequent shingle, by its count in the sketch, that one of its dealt parts stands for: its bands of sizes divide it further.
SHARDS_A_WAY = 32
FANOUT = 16
LEAF = 32


def sets_of(texts: pa.Array, n: int):
    """The sorted distinct shingle hashes of each text."""
    for i, j, h, bounds in word_hashes(texts):
        g, at = shingles(h, bounds, n)
        for t in range(j - i):
            yield np.unique(g[at[t] : at[t + 1]])


# -- frequent shingles ------------------------------------------------------------------------------------------------


def frequency_sketch(docs: DataFrame, n: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Occurrences of all shingles of all documents by the low bits of their hash: 2**bits counts, whatever the input."""
    rows = min(64, 1 << bits)
    width = (1 << bits) // rows

    def count(batches):
        total, held, size = np.zeros(1 << bits, np.int64), [], 0
        mask = np.uint64((1 << bits) - 1)

        def add():
            nonlocal held, size
            if held:
                total[:] += np.bincount((np.concatenate(held) & mask).astype(np.int64), minlength=1 << bits)
            held, size = [], 0

        for b in batches:
            for _, _, h, bounds in word_hashes(b.column(0)):
                g, _ = shingles(h, bounds, n)
                held.append(g)
                size += len(g)
                if size > 1 << 20:
                    add()
        add()
        yield pa.RecordBatch.from_pydict({"r": pa.array(range(rows), pa.int32()), "v": [x.astype("<u4").tobytes() for x in total.reshape(rows, width)]})

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for r, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(v.as_py(), "<u4").astype(np.int64)
                total[r] = total[r] + x if r in total else x
        yield pa.RecordBatch.from_pydict({"r": pa.array(list(total), pa.int32()), "v": [np.minimum(x, 2**32 - 1).astype("<u4").tobytes() for x in total.values()]})

    small_batches(docs.sparkSession)
    parts = docs.select("text").mapInArrow(released(count), "r int, v binary")
    merged = parts.repartition(min(rows, partitions(docs.sparkSession)), "r").mapInArrow(released(merge), "r int, v binary")
    out = np.zeros((rows, width), np.int64)
    for r in merged.collect():
        out[r.r] = np.frombuffer(bytes(r.v), "<u4")
    return out.reshape(-1)


def shards_by_slot(sketch: np.ndarray, shard: int, frequent: float) -> np.ndarray:
    """0 for ordinary slots; for frequent ones the shards that a block of one of its shingles is dealt into beforehand: WAYS at
    most, so that members are not copied more often than that."""
    mean = sketch.mean()
    hot = sketch > frequent * (mean + 2 * math.sqrt(mean) + 12)
    return np.where(hot, np.minimum(np.ceil(sketch / shard), WAYS), 0).astype(np.int32)


# -- count vectors and the R-tree -------------------------------------------------------------------------------------


def group_count(n: int) -> int:
    """Groups of a set's count vector: about eight shingles each, a power of two."""
    return 16 if n <= 128 else 1 << (n // 8 - 1).bit_length()


def count_vector(s: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((s >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups)


def folded(v: np.ndarray, groups: int) -> np.ndarray:
    """A count vector of fewer groups, a power of two."""
    return v.reshape(-1, groups).sum(0)


class RTree:
    """A packed R-tree over count vectors: points ordered by size and a bit-interleaving of their largest spreads,
    leaves of LEAF points, FANOUT children, every node with its points' coordinate maxima and smallest and largest size."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, ratio: Fraction):
        self.order = np.lexsort((*vectors.T[: min(4, vectors.shape[1])], sizes)) if len(sizes) else np.zeros(0, int)
        self.v, self.n, self.ratio = vectors[self.order].astype(np.int32), sizes[self.order], ratio
        self.levels = []
        top, low, high = self.v, self.n, self.n
        first = LEAF
        while True:
            at = np.arange(0, len(top), first)
            if len(at) == 0:
                break
            top, low, high = np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high, first))
            if len(at) == 1:
                break
            first = FANOUT

    def _may(self, bound: np.ndarray, low: np.ndarray, high: np.ndarray, n_low: int, n_high: int) -> np.ndarray:
        """Whether an overlap of bound can be t of a union, for sizes in the two ranges."""
        a, b = self.ratio.numerator, self.ratio.denominator
        size = (high >= -(-n_low * a // b)) & (low * a <= n_high * b)
        least = np.maximum(low, 0) + n_low
        return size & ((a + b) * bound >= a * least)

    def leaf_pairs(self):
        """Pairs of leaves (i <= j) whose boxes may hold a pair of points."""
        if not self.levels:
            return
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            top, low, high, step = self.levels[level]
            bound = int(np.minimum(top[i], top[j]).sum())
            if not bool(self._may(np.array([bound]), low[j : j + 1], high[j : j + 1], int(low[i]), int(high[i]))[0]):
                continue
            if level == 0:
                yield i, j
                continue
            below = len(self.levels[level - 1][0])
            for x in range(i * step, min(below, (i + 1) * step)):
                for y in range(max(x, j * step), min(below, (j + 1) * step)):
                    stack.append((level - 1, x, y))

    def pairs(self):
        """Arrays (a, b) of points that the bound leaves, leaf pair by leaf pair; each pair once."""
        n = len(self.n)
        num, den = self.ratio.numerator, self.ratio.denominator
        for i, j in self.leaf_pairs():
            ia, ib = slice(i * LEAF, min(n, (i + 1) * LEAF)), slice(j * LEAF, min(n, (j + 1) * LEAF))
            bound = np.minimum(self.v[ia, None, :], self.v[None, ib, :]).sum(2)
            sizes = self.n[ia, None] + self.n[None, ib]
            ok = (num + den) * bound >= num * sizes
            if i == j:
                ok &= np.triu(np.ones(ok.shape, bool), 1)
            x, y = np.nonzero(ok)
            if len(x):
                yield self.order[x + i * LEAF], self.order[y + j * LEAF]


class Forest:
    """Union-find over 0 to n - 1, roots the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _tile(shard: int, shards: int) -> list[tuple[int, int]]:
    """The tiles (of two shards, the smaller first) that a member of a shard belongs to."""
    return [(min(shard, k), max(shard, k)) for k in range(shards)]


def size_bands(ratio: Fraction) -> np.ndarray:
    """The least sizes of bands: sets whose sizes are within ratio lie in one band or in two that follow one another."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(max(least[-1] * ratio.denominator // ratio.numerator, least[-1] * 11 // 10) + 1)
    return np.array(least)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys in sorted columns."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(1, int)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.append(np.flatnonzero(new), n)


def _table(batches) -> dict[str, pa.Array]:
    got = list(batches)
    if not got:
        return {}
    t = pa.Table.from_batches(got)
    return {c: t.column(c).combine_chunks() for c in t.column_names}


def _whole(batches, *keys: str, most: int = 4 * PIECE_BYTES):
    """Tables of the rows of batches sorted by keys: whole groups of equal keys, several together while they are small, so that
    memory follows the largest group and not the partition."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        if size + b.nbytes > most:
            at = _runs(*[b.column(b.schema.get_field_index(k)).to_numpy() for k in keys])
            same = bool(held) and all(held[-1].column(k)[-1].as_py() == b.column(k)[0].as_py() for k in keys)
            cuts = [int(x) for x in (at[1:-1] if same or not held else at[:-1])]
            # what is held ends with the first group of b; of the rest, all but the last group is whole
            if cuts:
                if cuts[0]:
                    held.append(b.slice(0, cuts[0]))
                yield _table(held)
                if cuts[-1] > cuts[0]:
                    yield _table([b.slice(cuts[0], cuts[-1] - cuts[0])])
                b, held, size = b.slice(cuts[-1]), [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield _table(held)


# -- the join ---------------------------------------------------------------------------------------------------------


def jaccard_join(docs: DataFrame, n: int = 4, threshold: Fraction = Fraction(85, 100), shard: int = SHARD, sketch_bits: int = SKETCH_BITS, frequent: float = 4.0) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document.

    n_shingles: distinct runs of n lower-cased words (a text of fewer words has its whole as one; without words, none).
    Documents link when their sets' Jaccard similarity is threshold or more, exactly; n_links counts the other documents
    that a document links with, and component_id is the smallest doc_id reachable by links, itself included. Null and
    empty texts link with nothing. Documents of equal sets link with one another and are compared once. Repeated rows
    are documents of their own, whatever their ids and texts (n_links counts each of them); a null doc_id has a null
    component unless it is linked with one that is not null. An empty table gives no rows. Other columns are not read."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_id"))
    level = shards_by_slot(frequency_sketch(docs, n, sketch_bits), shard, frequent)
    slot_mask = np.uint64((1 << sketch_bits) - 1)
    num, den = threshold.numerator, threshold.denominator

    def prefix(s: np.ndarray) -> np.ndarray:
        """The first shingles of a set in the common order; a similar set shares one of them."""
        k = len(s) - -(-num * len(s) // den) + 1
        hot = level[(s & slot_mask).astype(np.int64)] > 0
        cold = s[~hot]
        return cold[:k] if len(cold) >= k else np.concatenate((cold, s[hot][: k - len(cold)]))

    def described(b: pa.RecordBatch):
        out: dict[str, list] = {"n": [], "key": [], "prefix": [], "vector": []}
        for s in sets_of(b.column(1), n):
            out["n"].append(len(s))
            out["key"].append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
            out["prefix"].append(prefix(s).astype(np.int64) if len(s) else None)
            out["vector"].append(np.minimum(count_vector(s, group_count(len(s))), 65535).astype("<u2").tobytes() if len(s) else None)
        return out | {"doc_id": b.column(0), "text_id": b.column(2)}

    def describe(b: pa.RecordBatch):
        return map(described, pieces(b, 1))

    described_docs = written(map_batches(docs, describe, "doc_id long, text_id binary, n long, key binary, prefix array<long>, vector binary"))
    # A class has a number of its own, a head, the document whose text stands for it, and the description that its documents share.
    heads = written(
        described_docs.where("key is not null").groupBy("key").agg(
            F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "text_id")).alias("head"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "prefix", "vector")]
        ).select("key", "rep", F.col("head.doc_id").alias("head_id"), F.col("head.text_id").alias("head_text"), "copies", "n", "prefix", "vector", F.monotonically_increasing_id().alias("class"))
    )
    classes = heads.select("key", "rep", "head_id", "head_text", "copies", "class")
    # Descriptions are many times what the answer needs of a document, so they go as soon as the classes have them.
    seen = written(described_docs.select("doc_id", "n", "key"))
    drop(described_docs)
    collect_garbage(spark)
    least_sizes = size_bands(threshold)

    # Blocks: which classes share a shingle, with the bands of their sizes. For an ordinary shingle the tile is -1 less the band. A
    # frequent one is dealt by bands: tile // 2 is a band and the shards of two members, tile % 2 tells those of the next band.
    def blocks(b: pa.RecordBatch):
        ids, lists = b.column(0).to_numpy(), b.column(2)
        flat = lists.values.to_numpy().view(np.uint64)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
        times = np.diff(lists.offsets.to_numpy())
        who, band = np.repeat(ids, times), np.repeat(np.searchsorted(least_sizes, b.column(1).to_numpy(), "right") - 1, times)
        deal = level[(flat & slot_mask).astype(np.int64)].astype(int)
        plain = deal <= 1
        yield {"token": flat[plain].view(np.int64), "tile": (-1 - band[plain]).astype(np.int32), "class": who[plain]}
        for ways in np.unique(-(-deal[~plain] // SHARDS_A_WAY)):
            at = ~plain & (-(-deal // SHARDS_A_WAY) == ways)
            token, owner, own = flat[at].view(np.int64), who[at], band[at]
            s = (owner.view(np.uint64) % np.uint64(ways)).astype(np.int64)
            for other in range(ways):
                two = np.minimum(s, other) * ways + np.maximum(s, other)
                for upper in (0, 1):
                    ok = own >= upper
                    tile = (((own - upper) * ways * ways + two) * 2 + upper)[ok].astype(np.int32)
                    yield {"token": token[ok], "tile": tile, "class": owner[ok]}

    entries = map_batches(heads.select("class", "n", "prefix"), blocks, "token long, tile int, class long")

    def groups(batches):
        """The blocks of two classes or more, named by their members, so that blocks of the same members are one."""
        t = _table(batches)
        if not t:
            return
        token, tile, who = (t[c].to_numpy() for c in ("token", "tile", "class"))
        of, band = np.where(tile < 0, -1, tile >> 1), np.where(tile < 0, -1 - tile, tile & 1)
        order = np.lexsort((who, band, of, token))
        token, of, band, who = token[order], of[order], band[order], who[order]
        # a block ends where a band of sizes is empty
        chain = np.concatenate(([0], np.cumsum(np.diff(band) > 1))) if len(band) else band
        at = _runs(token, of, chain)
        size = np.diff(at)
        # what has only the upper of its two bands is whole in the tile of that band
        size[(of[at[:-1]] >= 0) & (band[at[:-1]] > 0)] = 0
        mixed = who.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        name = np.add.reduceat(mixed, at[:-1]) + np.diff(at).astype(np.uint64)
        many = (size > 1) & (size <= large)
        pick = np.repeat(many, np.diff(at))
        yield from named(np.repeat(name[many], size[many]), who[pick])
        for k in np.flatnonzero(size > large):
            f, e = at[k], at[k + 1]
            yield from dealt(who[f:e], mixed[f:e], band[f:e])

    def named(names: np.ndarray, who: np.ndarray):
        if not len(who):
            return
        names = names.view(np.int64)
        order = np.lexsort((who, names))
        names, who = names[order], who[order]
        new = np.ones(len(who), bool)
        new[1:] = (names[1:] != names[:-1]) | (who[1:] != who[:-1])
        yield pa.RecordBatch.from_pydict({"block": names[new], "class": who[new]})

    def dealt(block: np.ndarray, code: np.ndarray, band: np.ndarray):
        """A large block by pairs of bands, which are in order; what is still large in tiles of two shards, each named by its members."""
        firsts = np.searchsorted(band, np.unique(band))
        for f in firsts:
            e = int(np.searchsorted(band, band[f] + 1, "right"))
            if f and e == np.searchsorted(band, band[f], "right") and band[f - 1] == band[f] - 1:
                continue  # no band follows: this one was whole in the pair before
            some, its = block[f:e], code[f:e]
            if e - f <= large:
                if e - f > 1:
                    yield from named(np.full(e - f, its.sum() + np.uint64(e - f), np.uint64), some)
                continue
            ways = min(WAYS, -(-int(e - f) // shard))
            own = (its % np.uint64(ways)).astype(np.int64)
            by = np.argsort(own, kind="stable")
            some, its, own = some[by], its[by], np.searchsorted(own[by], np.arange(ways + 1))
            for i in range(ways):
                for j in range(i + 1, ways):
                    two = np.concatenate((np.arange(own[i], own[i + 1]), np.arange(own[j], own[j + 1])))
                    yield from named(np.full(len(two), its[two].sum() + np.uint64(len(two)), np.uint64), some[two])

    parts, large = partitions(spark), 8 * shard
    shared = cut(entries.repartition(parts, F.col("token"), F.when(F.col("tile") < 0, -1).otherwise(F.shiftright("tile", 1))).mapInArrow(released(groups), "block long, class long").distinct())
    collect_garbage(spark)
    points = shared.join(heads.select("class", "n", "vector"), "class")

    # Sets of like size have vectors that differ in width by this factor at most (group_count rounds up, from n // 8 - 1).
    widest = 1 << max(1, math.floor(math.log2(2.3 / threshold)))

    def connect(batches):
        for t in _whole(batches, "block"):
            yield from connected(t)

    def connected(t):
        block, who, size = (t[c].to_numpy() for c in ("block", "class", "n"))
        vectors = t["vector"]
        order = np.lexsort((who, size, block))
        block, who, size = block[order], who[order], size[order]
        at = _runs(block)
        a_out, b_out = [], []
        for f, e in zip(at[:-1], at[1:], strict=True):
            got = [np.frombuffer(vectors[int(k)].as_py(), "<u2") for k in order[f:e]]
            forest = Forest(e - f)
            # a tree for each width of vectors, with the wider ones that sets of like size may have
            widths = np.array([len(v) for v in got])
            for width in np.unique(widths):
                near = np.flatnonzero((widths >= width) & (widths <= width * widest))
                if len(near) < 2:
                    continue
                tree = RTree(np.array([folded(got[k], width) if len(got[k]) > width else got[k] for k in near]), size[f:e][near], threshold)
                for x, y in tree.pairs():
                    for p, q in zip(near[x].tolist(), near[y].tolist(), strict=True):
                        if forest.join(p, q):
                            a_out.append(who[f + p])
                            b_out.append(who[f + q])
        if a_out:
            yield pa.RecordBatch.from_pydict({"a": np.array(a_out, np.int64), "b": np.array(b_out, np.int64)})

    edges = cut(points.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(released(connect), "a long, b long"))
    collect_garbage(spark)
    candidate = components(edges)
    collect_garbage(spark)

    # The sets of the candidates, each component together; a large one in tiles of two shards.
    sizes = candidate.groupBy("root").agg(F.count("*").alias("members"))
    members = candidate.join(sizes, "root").join(classes.select(F.col("class").alias("id"), "head_id", "head_text", "copies"), "id")
    wanted = cut(members.select(F.col("id").alias("class"), "head_id", "head_text", "copies", F.col("root"), F.ceil(F.col("members") / shard).cast("int").alias("shards")))
    texts = maybe_in(docs, "doc_id", wanted, "head_id").join(wanted, F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("text_id") == F.col("head_text")))
    loaded_here: set[int] = set()  # of a task: rows that repeat come once

    def load(b: pa.RecordBatch):
        """A set comes once for each tile of its shard, so what goes out is cut by its own size, not by that of the texts."""
        out: dict[str, list] = {k: [] for k in ("root", "tile", "class", "copies", "own", "set")}
        size = 0
        fresh = [k for k, c in enumerate(b.column(1).to_pylist()) if not (c in loaded_here or loaded_here.add(c))]
        b = b.take(pa.array(fresh, pa.int64()))
        root, who, copies, shards = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
        for k, s in enumerate(sets_of(b.column(4), n)):
            own = (who[k] & 0xFFFFFFFFFFFFFFFF) % shards[k]
            raw = s.tobytes()
            for i, j in _tile(own, shards[k]):
                out["root"].append(root[k])
                out["tile"].append(i * shards[k] + j if shards[k] > 1 else -1)
                out["class"].append(who[k])
                out["copies"].append(copies[k])
                out["own"].append(own)
                out["set"].append(raw)
                size += len(raw)
                if size > PIECE_BYTES:
                    yield out
                    out, size = {k: [] for k in out}, 0
        yield out

    loaded = map_batches(texts.select("root", "class", "copies", "shards", "text"), load, "root long, tile int, class long, copies long, own int, set binary")

    def verify(batches):
        for t in _whole(batches, "root", "tile"):
            yield from verified(t)

    def verified(t):
        root, tile, who, copies, own = (t[c].to_numpy() for c in ("root", "tile", "class", "copies", "own"))
        order = np.lexsort((who, tile, root))
        at = _runs(root[order], tile[order])
        out_id, out_links, out_to = [], [], []
        for f, e in zip(at[:-1], at[1:], strict=True):
            idx = order[f:e]
            # a class may come twice where a row repeats in another task
            _, firsts = np.unique(who[idx], return_index=True)
            idx = idx[firsts]
            sets = [np.frombuffer(t["set"][int(k)].as_py(), np.uint64) for k in idx]
            links, forest = exact_links(sets, copies[idx], own[idx], threshold)
            for k in range(len(idx)):
                r = forest.root(k)
                if links[k] or r != k:
                    out_id.append(who[idx[k]])
                    out_links.append(links[k])
                    out_to.append(who[idx[r]])
        if out_id:
            yield pa.RecordBatch.from_pydict({"class": np.array(out_id, np.int64), "links": np.array(out_links, np.int64), "to": np.array(out_to, np.int64)})

    checked = cut(loaded.repartition(parts, "root", "tile").sortWithinPartitions("root", "tile").mapInArrow(released(verify), "class long, links long, to long"))
    collect_garbage(spark)
    linked = components(checked.select(F.col("class").alias("a"), F.col("to").alias("b")))
    links = checked.groupBy("class").agg(F.sum("links").alias("links"))
    joined = classes.join(linked.withColumnRenamed("id", "class"), "class", "left").join(links, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    answer = joined.join(least, "root").select("key", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return seen.select("doc_id", "n", "key").join(answer, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def exact_links(sets: list[np.ndarray], copies: np.ndarray, own: np.ndarray, ratio: Fraction) -> tuple[np.ndarray, Forest]:
    """For each set the copies of the sets it links with, and the forest of the links. Pairs of one shard count only where
    all sets are of that shard, so that over the tiles of a component every pair counts once."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    width = group_count(int(np.median(sizes)))
    tree = RTree(np.array([count_vector(s, width) for s in sets]), sizes, ratio)
    single = (own == own[0]).all()
    links, forest = np.zeros(n, np.int64), Forest(n)
    distinct = np.unique(np.concatenate(sets))
    at = np.concatenate(([0], np.cumsum(sizes)))
    universe, dense = len(distinct), np.empty(at[-1], np.int32)
    for k, s in enumerate(sets):
        dense[at[k] : at[k + 1]] = np.searchsorted(distinct, s)
    del distinct
    num, den = ratio.numerator, ratio.denominator
    mark = np.zeros(universe, bool)
    for x, y in tree.pairs():
        if not single:
            apart = own[x] != own[y]
            x, y = x[apart], y[apart]
        if not len(x):
            continue
        rows, rx = np.unique(x, return_inverse=True)
        cols, ry = np.unique(y, return_inverse=True)
        if len(x) > 3 * (len(rows) + len(cols)):
            used = np.unique(np.concatenate([dense[at[k] : at[k + 1]] for k in rows]))
            place = np.full(universe, -1, np.int64)
            place[used] = np.arange(len(used))
            m = np.zeros((len(rows), len(used)), np.float32)
            o = np.zeros((len(cols), len(used)), np.float32)
            for q, k in enumerate(rows):
                m[q, place[dense[at[k] : at[k + 1]]]] = 1
            for q, k in enumerate(cols):
                p = place[dense[at[k] : at[k + 1]]]
                o[q, p[p >= 0]] = 1
            common = (m @ o.T)[rx, ry].astype(np.int64)
        else:
            common = np.empty(len(x), np.int64)
            last = -1
            for q in np.argsort(x, kind="stable").tolist():
                if x[q] != last:
                    if last >= 0:
                        mark[dense[at[last] : at[last + 1]]] = False
                    last = int(x[q])
                    mark[dense[at[last] : at[last + 1]]] = True
                common[q] = mark[dense[at[y[q]] : at[y[q] + 1]]].sum()
            mark[dense[at[last] : at[last + 1]]] = False
        ok = (num + den) * common >= num * (sizes[x] + sizes[y])
        x, y = x[ok], y[ok]
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            forest.join(p, q)
    return links, forest


def op2(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(8, 10)) -> DataFrame:
    """The documents without those whose component has a smaller doc_id.

    Null ids and texts without words stay, rows that repeat an id stay or go together; an empty table stays empty."""
    gone = cut(jaccard_join(docs, n, threshold).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    collect_garbage(docs.sparkSession)
    # only texts that may go are moved to meet the ids
    asked = maybe_in(docs, "doc_id", gone, "_gone")
    return maybe_in(docs, "doc_id", gone, "_gone", "left_anti").unionByName(asked.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti"))
