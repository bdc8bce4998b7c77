"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.arrow import map_batches, pieces, released, small_batches
from cellweave.llm.words import SPACE, text_bytes, word_hashes

#: Labelled rows of each class that the fit uses at most, and the model's size.
SAMPLE_PER_CLASS = 2000
WORD_SLOTS = 1 << 13
RANK = 8
STATS = 15


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # (features,)
    factor: np.ndarray  # (features, rank)
    mean: np.ndarray
    scale: np.ndarray

    def margins(self, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
        """Linear part plus half of (sum of v x) squared minus the sum of (v x) squared, over the rank."""
        linear = _sums(self.weight[idx] * val, ptr)
        vx = self.factor[idx] * val[:, None]
        s, q = _sums(vx, ptr), _sums(vx * vx, ptr)
        return self.bias + linear + 0.5 * (s * s - q).sum(1)


def _sums(x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of the rows ptr[i]:ptr[i + 1]; every run has a row at least."""
    return np.add.reduceat(x, ptr[:-1], axis=0)


_CLASS = np.zeros(256, np.int8)  # kinds of bytes
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[33, 63]] = 4
_CLASS[[44, 46, 58, 59]] = 5
_CLASS[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 96, 123, 125, 126, 91, 93, 92]] = 6
_CLASS[124] = 7
_CLASS[10] = 8
_CLASS[[9, 11, 12, 13, 32]] = 9
_CLASS[128:] = 10


def structure(data: np.ndarray, off: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """(texts, STATS - 2): shares of kinds of bytes, and the logarithm of the length and of the metadata's length."""
    n = np.diff(off)
    kinds = _CLASS[data]
    out = np.zeros((len(n), STATS - 2), np.float64)
    size = np.maximum(n, 1)
    for k in range(1, 11):
        c = np.concatenate(([0], np.cumsum(kinds == k, dtype=np.int64)))
        out[:, k - 1] = (c[off[1:]] - c[off[:-1]]) / size
    out[:, 10] = np.log1p(n)
    out[:, 11] = np.log1p(np.maximum(n_chars, 0))
    out[:, 12] = n == 0
    return out


def features(texts: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ptr, slots, values) of the hashed words, scaled to length one, and the structure statistics."""
    data, off = text_bytes(texts)
    meta = np.nan_to_num(np.array(n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64), nan=0.0)
    ptr, slots, values, extra = [0], [], [], []
    for i, j, h, bounds in word_hashes(texts):
        slot = (h >> np.uint64(64 - 13)).astype(np.int64)
        for t in range(j - i):
            own = slot[bounds[t] : bounds[t + 1]]
            u, c = np.unique(own, return_counts=True)
            v = np.sqrt(c)
            norm = np.sqrt((v * v).sum()) or 1.0
            slots.append(u)
            values.append(v / norm)
            ptr.append(ptr[-1] + len(u))
            extra.append((len(own) / max(1, off[i + t + 1] - off[i + t]), len(u) / max(1, len(own))))
    stats = np.hstack([structure(data, off, meta), np.array(extra, np.float64).reshape(-1, 2)])
    cat = (lambda x, d: np.concatenate(x) if x else np.zeros(0, d))
    return np.array(ptr), cat(slots, np.int64), cat(values, np.float64), stats


def _joined(ptr, slots, values, stats, mean, scale):
    """One sparse row per text: the statistics' features first, then the words'."""
    n = len(stats)
    z = np.clip((stats - mean) / scale, -4, 4)
    length = np.diff(ptr) + STATS
    new = np.concatenate(([0], np.cumsum(length)))
    idx, val = np.empty(int(new[-1]), np.int64), np.empty(int(new[-1]), np.float64)
    head = (new[:-1, None] + np.arange(STATS)).reshape(-1)
    mask = np.ones(len(idx), bool)
    mask[head] = False
    idx[head], val[head] = np.tile(np.arange(STATS), n), z.reshape(-1)
    idx[mask], val[mask] = slots + STATS, values
    return new, idx, val


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int, float]], rounds: int = 12, rate: float = 0.08, seed: int = 7) -> Machine:
    """rows: (slots, values, stats, label, weight). Adagrad on the logistic loss in batches of 64."""
    rng = np.random.default_rng(seed)
    d = STATS + WORD_SLOTS
    stats = np.array([r[2] for r in rows]).reshape(-1, STATS)
    mean = stats.mean(0) if len(rows) else np.zeros(STATS)
    scale = np.maximum(stats.std(0), 1e-6) if len(rows) else np.ones(STATS)
    m = Machine(0.0, np.zeros(d), rng.normal(0, 0.01, (d, RANK)), mean, scale)
    if not rows:
        return m
    ptr = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])))
    ptr, idx, val = _joined(ptr, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), stats, mean, scale)
    y, w = np.array([r[3] for r in rows], float), np.array([r[4] for r in rows])
    share = np.clip((y * w).sum() / w.sum(), 0.01, 0.99)
    m.bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(d, 1e-6), np.full((d, RANK), 1e-6), 1e-6
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            take = order[at : at + 64]
            n = ptr[take + 1] - ptr[take]
            p = np.concatenate(([0], np.cumsum(n)))
            pick = np.arange(p[-1]) + np.repeat(ptr[take] - p[:-1], n)
            i, x = idx[pick], val[pick]
            vx = m.factor[i] * x[:, None]
            s = _sums(vx, p)
            margin = m.bias + _sums(m.weight[i] * x, p) + 0.5 * (s * s - _sums(vx * vx, p)).sum(1)
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[take]) * w[take] / 64
            e = np.repeat(err, n)
            u, inv = np.unique(i, return_inverse=True)
            dw = np.bincount(inv, e * x, len(u)) + 1e-5 * m.weight[u]
            full = e[:, None] * x[:, None] * (np.repeat(s, n, 0) - vx)
            dv = np.stack([np.bincount(inv, full[:, k], len(u)) for k in range(RANK)], 1) + 1e-5 * m.factor[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            gb += err.sum() ** 2
            m.weight[u] -= rate * dw / np.sqrt(gw[u])
            m.factor[u] -= rate * dv / np.sqrt(gv[u])
            m.bias -= rate * err.sum() / np.sqrt(gb)
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Machine:
    """Fit on a bounded sample of labelled rows: the per_class rows of each class with the smallest hash of their id
    (ids whose crc32 modulo 5 is 0 stay out). Classes are weighted back to their shares among all labelled rows."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    known = known.where(F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(5)) != 0).groupBy("_id").agg(F.max("_y").alias("_y"))
    count = {r._y: r.n for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for c in sorted(count):
        part = known.where(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return fit([])
    rows = docs.select(F.col("doc_id").alias("_id"), "text", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(chosen), "_id")

    def work(b: pa.RecordBatch):
        ptr, slots, values, stats = features(b.column(1), b.column(2))
        cut = lambda x, t: [x[ptr[k] : ptr[k + 1]].astype(t).tobytes() for k in range(b.num_rows)]
        return {"_id": b.column(0), "_y": b.column(3), "slots": cut(slots, np.int32), "vals": cut(values, np.float32), "stats": [s.tobytes() for s in stats]}

    got = map_batches(rows.select("_id", "text", "n_chars", "_y"), work, "_id long, _y int, slots binary, vals binary, stats binary").collect()
    got = sorted({(r._id, bytes(r.slots), bytes(r.vals), bytes(r.stats)): r for r in got}.items(), key=lambda kv: kv[0])
    taken = {c: sum(r._y == c for _, r in got) or 1 for c in count}
    weight = {c: count[c] / taken[c] for c in count}
    norm = sum(weight[r._y] for _, r in got) / max(1, len(got))
    return fit([
        (np.frombuffer(r.slots, np.int32).astype(np.int64), np.frombuffer(r.vals, np.float32).astype(float), np.frombuffer(r.stats, float), r._y, weight[r._y] / norm)
        for _, r in got
    ])


def score(docs: DataFrame, model: Machine, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, from its whole text and n_chars alone.

    Null text counts as empty and null n_chars as 0; an empty text is scored on its statistics. Repeated rows repeat,
    equal rows get equal scores, an empty table gives no rows, and other columns are not read."""
    weight, factor = model.weight.astype(np.float32), model.factor.astype(np.float32)
    small = Machine(model.bias, weight, factor, model.mean, model.scale)

    def scored(b: pa.RecordBatch):
        m = Machine(small.bias, small.weight.astype(float), small.factor.astype(float), small.mean, small.scale)
        ptr, slots, values, stats = features(b.column(1), b.column(2))
        if b.num_rows:
            margin = m.margins(*_joined(ptr, slots, values, stats, m.mean, m.scale))
        else:
            margin = np.zeros(0)
        p = np.round(1 / (1 + np.exp(-np.clip(margin, -30, 30))), 6)
        return {"doc_id": b.column(0), "score": p, "predicted": (p >= threshold).astype(np.int32)}

    def work(b: pa.RecordBatch):
        return map(scored, pieces(b, 1))

    out = map_batches(docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")), work, "doc_id long, score double, predicted int")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def accepted(docs: DataFrame, model: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source, n_chars) whose score is threshold or more, unchanged."""

    def work(batches):
        for whole in batches:
            for b in pieces(whole, 1):
                ptr, slots, values, stats = features(b.column(1), b.column(4))
                margin = model.margins(*_joined(ptr, slots, values, stats, model.mean, model.scale))
                yield b.filter(pa.array(np.round(1 / (1 + np.exp(-np.clip(margin, -30, 30))), 6) >= threshold))

    rows = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    small_batches(docs.sparkSession)
    return rows.mapInArrow(released(work), rows.schema)
