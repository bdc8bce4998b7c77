"""Suffix-array deduplication of byte strings: sampled splitters, buckets sorted by multikey quicksort, boundaries compared.

Which 200-byte windows of all texts start at more than one place? In every window one position is picked by the
window's content alone (the smallest hash of the 50-byte strings that start in it), so that equal windows pick the same
place in them. Consecutive windows that pick the same place are one suffix, whose leading tokens are the hash of the 50
bytes there and the hash of the whole span of the windows. Suffixes are range-partitioned by their leading tokens with
sampled splitters, sorted in their bucket, and runs of equal tokens are compared across the boundaries of buckets.

A suffix whose two tokens stand elsewhere is repeated as a whole. Where only the first token does, its windows are
compared one by one with those of the suffixes of the same first token: their bytes come together by that token, and
the hashes of the windows' halves are sorted. Where very many share a first token, the windows become suffixes of
their own and go through the range-partitioned sort. Windows whose first token stands nowhere else cannot be repeated.
Nothing is sampled but the splitters. A document is named by its id and a hash of its text."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.arrow import map_batches, small_batches
from cellweave.llm.frames import cut, partitions, written
from cellweave.llm.words import _RANDOM, mix, powers, text_bytes

GRAM = 50
#: Bytes worked on at a time; positions must fit into 20 bits.
PIECE = 1 << 19
#: Suffixes of one first token up to which their bytes come together.
TOGETHER = 5_000
_LOW = np.uint64((1 << 20) - 1)


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_RANDOM[data] * up[: len(data)], out=total[1:])
    return total


def _hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(total))
    with np.errstate(over="ignore"):
        return mix((total[end] - total[start]) * down[start])


def _pieces(off: np.ndarray, length: int):
    """(texts i to j, first byte, end, offset in the text): whole texts together, long texts in overlapping pieces."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, "right")) - 1)
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= PIECE + length:
            yield i, j, lo, hi, 0
        else:
            for a in range(lo, hi - length + 1, PIECE):
                yield i, j, a, min(hi, a + PIECE + length - 1), a - lo
        i = j


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of the union of intervals; touching ones are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]


def picked(data: np.ndarray, off: np.ndarray, length: int):
    """(text, first window, windows, token 0, token 1) of the suffixes of texts data[off[i]:off[i + 1]]."""
    n, span = len(data), length - GRAM + 1
    out = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    if n < length:
        return out
    size = np.diff(off)
    fit = np.maximum(size - length + 1, 0)
    if not fit.any():
        return out
    total = _prefix_sums(data)
    i = np.arange(n - GRAM + 1)
    g = _hash(total, i, i + GRAM)
    least = (g & ~_LOW) | i.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    text = np.repeat(np.arange(len(size)), fit)
    s = np.arange(len(text)) + np.repeat(off[:-1] - np.concatenate(([0], np.cumsum(fit)[:-1])), fit)
    p = (least[s] & _LOW).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (p[1:] != p[:-1]) | (text[1:] != text[:-1])
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(s)) - 1
    first, last, place = s[a], s[z], p[a]
    with np.errstate(over="ignore"):
        t1 = mix(_hash(total, first, last + length) + (last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (place - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return text[a], first - off[:-1][text[a]], last - first + 1, g[place], t1


def suffixes(docs: DataFrame, length: int) -> DataFrame:
    """(id, uid, kind, s, n, t0, t1): kind 0 is a suffix of n windows from byte s, kind 1 a run of n bytes known as repeated
    within its own text. A suffix that stands several times in a text is given once."""

    def work(b: pa.RecordBatch):
        ident, uid = b.column(0).to_numpy(), b.column(1).to_numpy()
        data, off = text_bytes(b.column(2))
        for i, j, lo, hi, skip in _pieces(off, length):
            rel = off[i : j + 1] - lo if skip == 0 and hi == off[j] else np.array([0, hi - lo])
            text, s, n, t0, t1 = picked(data[lo:hi], rel, length)
            if not len(s):
                continue
            s = s + skip
            with np.errstate(over="ignore"):
                own = mix(t0 ^ mix(t1 + text.astype(np.uint64) * np.uint64(0x165667B19E3779F9)))
            _, first, inverse, count = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
            again = np.flatnonzero(count[inverse] > 1)
            who, start, size = [], [], []
            for t in np.unique(text[again]):
                k = again[text[again] == t]
                a, z = _merge(s[k], s[k] + n[k] - 1 + length)
                who.append(np.full(len(a), t))
                start.append(a)
                size.append(z - a)
            first.sort()
            m = sum(len(x) for x in who)
            at = np.concatenate([i + text[first], *[i + x for x in who]])
            yield {
                "id": ident[at], "uid": uid[at], "kind": np.repeat(np.array([0, 1], np.int8), [len(first), m]),
                "s": np.concatenate([s[first], *start]), "n": np.concatenate([n[first], *size]).astype(np.int32),
                "t0": np.concatenate([t0[first].view(np.int64), np.zeros(m, np.int64)]), "t1": np.concatenate([t1[first].view(np.int64), np.zeros(m, np.int64)]),
            }

    return map_batches(docs.select("id", "uid", "text"), work, "id long, uid long, kind tinyint, s long, n int, t0 long, t1 long")


def multikey_order(*tokens: np.ndarray) -> np.ndarray:
    """The order of rows by their tokens: quicksort on the first, and on the next one only within runs of equal ones."""
    order = np.argsort(tokens[0], kind="quicksort")
    run = np.zeros(len(order), np.int64)
    for before, now in zip(tokens[:-1], tokens[1:], strict=True):
        b = before[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (run[1:] != run[:-1])
        run = np.cumsum(new)
        tied = np.zeros(len(order), bool)
        tied[1:] = ~new[1:]
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if len(at) == 0:
            break
        sub = order[at]
        order[at] = sub[np.lexsort((now[sub], run[at]))]
    return order


def sorted_buckets(rows: DataFrame) -> DataFrame:
    """Rows (id, uid, s, n, t0, t1) whose first token stands more than once, with some = the first token is repeated, all =
    both are, and lead = the row begins a run of equal tokens in its bucket and its first token has other runs."""
    spark = rows.sparkSession

    def sort(batches):
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        ident, uid, s, n, t0, t1 = (t.column(c).combine_chunks().to_numpy() for c in ("id", "uid", "s", "n", "t0", "t1"))
        k = multikey_order(t0, t1, uid)
        ident, uid, s, n, t0, t1 = ident[k], uid[k], s[k], n[k], t0[k], t1[k]
        new0 = np.ones(len(k), bool)
        new0[1:] = t0[1:] != t0[:-1]
        new1 = new0.copy()
        new1[1:] |= t1[1:] != t1[:-1]
        run0, run1 = np.cumsum(new0) - 1, np.cumsum(new1) - 1
        count0, count1 = np.bincount(run0), np.bincount(run1)
        kinds = np.bincount(run0[new1])  # runs of both tokens within a run of the first
        edge0, edge1 = (run0 == 0) | (run0 == run0[-1]), (run1 == 0) | (run1 == run1[-1])
        keep = (count0[run0] > 1) | edge0
        pid = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({
            "id": ident[keep], "uid": uid[keep], "s": s[keep], "n": n[keep], "t0": t0[keep], "t1": t1[keep], "bucket": pa.array(np.full(keep.sum(), pid), pa.int32()),
            "some": (count0[run0] > 1)[keep], "all": (count1[run1] > 1)[keep], "lead": (new1 & ((kinds[run0] > 1) | edge0))[keep], "edge0": edge0[keep], "edge1": (edge0 & edge1)[keep],
        })

    schema = "id long, uid long, s long, n int, t0 long, t1 long, bucket int, some boolean, all boolean, lead boolean, edge0 boolean, edge1 boolean"
    small_batches(spark)
    out = cut(rows.select("id", "uid", "s", "n", "t0", "t1").repartitionByRange(partitions(spark), "t0", "t1", "uid").mapInArrow(sort, schema))
    # At most two runs of a bucket reach its ends, so these lists have two entries a bucket at most.
    edges = out.where("edge0").select("t0", "t1", "bucket", "edge1")
    across0 = [r.t0 for r in edges.groupBy("t0").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a < b").collect()]
    across1 = edges.where("edge1").groupBy("t0", "t1").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a < b").select(
        F.col("t0").alias("x0"), F.col("t1").alias("x1")
    )
    out = out.join(F.broadcast(across1), (F.col("t0") == F.col("x0")) & (F.col("t1") == F.col("x1")), "left")
    some = F.col("some") | (F.col("edge0") & F.col("t0").isin(across0)) if across0 else F.col("some")
    return out.select("id", "uid", "s", "n", "t0", some.alias("some"), (F.col("all") | F.col("x0").isNotNull()).alias("all"), "lead").where("some")


def _windows_of(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, hash of the first half, of the second half) of every window of the parts data[at[i]:at[i + 1]]."""
    total = _prefix_sums(data)
    n = np.diff(at) - length + 1
    part = np.repeat(np.arange(len(n)), n)
    s = np.arange(len(part)) + np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return part, _hash(total, s, s + length // 2), _hash(total, s + length // 2, s + length)


def _repeated(group: np.ndarray, h0: np.ndarray, h1: np.ndarray) -> np.ndarray:
    """Which rows have an equal (group, h0, h1)."""
    k = multikey_order(h0, h1, group)
    same = (h0[k][1:] == h0[k][:-1]) & (h1[k][1:] == h1[k][:-1]) & (group[k][1:] == group[k][:-1])
    out = np.zeros(len(k), bool)
    out[k[1:]] = same
    out[k[:-1]] |= same
    return out


def _compared(rows: DataFrame, length: int) -> DataFrame:
    """(id, uid, s, n): runs of n bytes under repeated windows, from rows (t0, id, uid, s, bytes) that come together by t0."""

    def work(batches):
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        t0, ident, uid, start = (t.column(c).combine_chunks().to_numpy() for c in ("t0", "id", "uid", "s"))
        data, off = text_bytes(t.column("bytes").combine_chunks())
        size = np.diff(off)
        order = np.argsort(t0, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = t0[order][1:] != t0[order][:-1]
        bounds = np.append(np.flatnonzero(new), len(order))
        at = 0
        while at < len(bounds) - 1:
            # whole groups, about PIECE bytes of them
            reach = np.cumsum(size[order[bounds[at] :]])
            to = at + 1
            while to < len(bounds) - 1 and reach[bounds[to + 1] - bounds[at] - 1] <= PIECE:
                to += 1
            own = order[bounds[at] : bounds[to]]
            ends = np.concatenate(([0], np.cumsum(size[own])))
            pick = np.arange(ends[-1]) + np.repeat(off[own] - ends[:-1], size[own])
            part, h0, h1 = _windows_of(data[pick], ends, length)
            group = (np.cumsum(new[bounds[at] : bounds[to]]))[part]
            hit = np.flatnonzero(_repeated(group, h0, h1))
            at = to
            if not len(hit):
                continue
            first = np.concatenate(([0], np.cumsum(size[own] - length + 1)))[:-1]
            p, w = part[hit], hit - first[part[hit]]
            head = np.ones(len(hit), bool)
            head[1:] = (p[1:] != p[:-1]) | (w[1:] != w[:-1] + 1)
            a = np.flatnonzero(head)
            z = np.append(a[1:], len(hit)) - 1
            yield pa.RecordBatch.from_pydict({"id": ident[own[p[a]]], "uid": uid[own[p[a]]], "s": start[own[p[a]]] + w[a], "n": (w[z] - w[a] + length).astype(np.int32)})

    return rows.repartition(partitions(rows.sparkSession), "t0").mapInArrow(work, "id long, uid long, s long, n int")


def remove_repeats(docs: DataFrame, length: int = 200, together: int = TOGETHER) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document, judged on UTF-8 bytes.

    A byte is removed when a string of length bytes that covers it also starts anywhere else, in the same document (with
    overlap) or another; strings never cross documents. n_spans counts maximal removed runs. Null text counts as empty.
    Rows of equal doc_id and text are documents that repeat one another; null ids are kept; an empty table gives no rows;
    other columns are not read."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-1)).cast("long").alias("id")).withColumn("uid", F.xxhash64("text"))
    found = written(suffixes(docs, length))
    judged = cut(sorted_buckets(found.where("kind = 0")))
    whole = judged.where("all").select("id", "uid", "s", (F.col("n") + length - 1).alias("n"))
    # Suffixes to compare window by window, and of every run of equal suffixes beside them one.
    asked = judged.where("not all or lead").select("id", "uid", "s", "n", "t0").distinct()
    crowd = asked.groupBy("t0").agg(F.count("*").alias("k")).where(F.col("k") > together).select(F.col("t0").alias("c0"))
    asked = asked.join(crowd, F.col("t0") == F.col("c0"), "left")
    runs = asked.groupBy("id", "uid").agg(F.collect_list(F.struct("s", "n", "t0", F.col("c0").isNotNull().alias("crowd"))).alias("runs"))

    def take(b: pa.RecordBatch):
        ident, uid, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
        data, off = text_bytes(b.column(2))
        out: dict[str, list] = {k: [] for k in ("id", "uid", "s", "n", "t0", "crowd", "bytes")}
        for k in range(b.num_rows):
            own = data[off[k] : off[k + 1]]
            for r in lists[k].as_py():
                out["id"].append(ident[k])
                out["uid"].append(uid[k])
                for c in ("s", "n", "t0", "crowd"):
                    out[c].append(r[c])
                out["bytes"].append(own[r["s"] : r["s"] + r["n"] - 1 + length].tobytes())
            if len(out["uid"]) > 20_000 or k == b.num_rows - 1:
                yield out
                out = {c: [] for c in out}

    taken = written(map_batches(docs.join(runs, ["id", "uid"]).select("id", "uid", "text", "runs"), take, "id long, uid long, s long, n int, t0 long, crowd boolean, bytes binary"))

    def windows(b: pa.RecordBatch):
        ident, uid, start = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
        data, off = text_bytes(b.column(3))
        if b.num_rows:
            part, h0, h1 = _windows_of(data, off, length)
            first = np.concatenate(([0], np.cumsum(np.diff(off) - length + 1)))[:-1]
            w = np.arange(len(part)) - first[part]
            yield {"id": ident[part], "uid": uid[part], "s": start[part] + w, "n": np.ones(len(w), np.int32), "t0": h0.view(np.int64), "t1": h1.view(np.int64)}

    repeated = _compared(taken.where("not crowd").select("t0", "id", "uid", "s", "bytes"), length)
    if crowd.limit(1).count():
        single = written(map_batches(taken.where("crowd").select("id", "uid", "s", "bytes"), windows, "id long, uid long, s long, n int, t0 long, t1 long"))
        repeated = repeated.union(sorted_buckets(single).where("all").select("id", "uid", "s", F.lit(length).alias("n")))
    known = found.where("kind = 1").select("id", "uid", "s", "n")
    spans = whole.union(repeated).union(known).groupBy("id", "uid").agg(F.collect_set(F.struct("s", "n")).alias("spans"))

    def finish(b: pa.RecordBatch):
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        data, off = text_bytes(b.column(1))
        lists = b.column(2)
        for k in range(b.num_rows):
            own = data[off[k] : off[k + 1]]
            got = lists[k]
            removed, count = 0, 0
            digest = hashlib.sha256()
            if got.is_valid:
                v = got.values
                s, n = v.field("s").to_numpy(), v.field("n").to_numpy()
                a, z = _merge(s, s + n)
                removed, count, at = int((z - a).sum()), len(a), 0
                for x, y in zip(a.tolist(), z.tolist(), strict=True):
                    digest.update(own[at:x])
                    at = y
                digest.update(own[at:])
            else:
                digest.update(own)
            out["n_bytes"].append(len(own))
            out["n_removed"].append(removed)
            out["n_spans"].append(count)
            out["kept_sha256"].append(digest.hexdigest())
        return out | {"doc_id": b.column(0)}

    joined = docs.join(spans, ["id", "uid"], "left").select("doc_id", "text", "spans")
    return map_batches(joined, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op9(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
