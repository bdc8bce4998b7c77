"""LM scoring by a hierarchical Pitman-Yor model whose contexts are the words themselves.

Restaurants: one for each word that comes before another (and one for the text's start), all of which share the unigram
restaurant as their parent, whose own parent is uniform over the known words and one unknown. A dish (a word in a context)
has customers and tables; its seating given these two numbers is integrated out. In a sweep all customers of every dish get
up and sit down again, one by one or, in large dishes, in small groups: whoever gets up sat alone with the probability that Stirling numbers give, and sits down
at a new table in proportion to the parent's probability. A dish sees its own moves at once and those of all others after
the sweep. Random numbers come from hashes of the dish and the sweep, so results do not depend on how data are dealt out.

Contexts are dealt to parts by their hash; a context with more than a quarter of a mean part's tokens is dealt by its
followers too. A word's place in the parent is at its home, by the word's hash. In a sweep a part sends the tables of its
words (and the totals of the contexts that it shares) to their homes, which seat the parent's customers and answer. States
are written after each step. Documents go in blocks: each asks the parts for its distinct pairs of words, and each part
answers with its share of each document's sums."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.arrow import small_batches
from cellweave.llm.frames import collect_garbage, drop, partitions, written
from cellweave.llm.words import mix, word_hashes

BLOCK_TOKENS = 2_000_000
#: Tokens of a mean part; there are as many parts as shuffle partitions at most.
PART_TOKENS = 2_500_000
BURN, SAMPLES = 3, 3
#: Of the customers of a dish, all of whom get up in a sweep, those who do so one by one, and the part (2**-GRAIN) of the dish
#: that the others go in groups of; strength of every restaurant.
MOVES = 8
GRAIN = 6
STRENGTH = 1.0
#: Rows of the sample that finds contexts to be dealt out further; this changes where work is done, not its result.
LAYOUT_ROWS = 5_000
#: Dishes of up to so many customers have exact Stirling ratios.
EXACT = 128
_START, _END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D)
_ROWS = "dest int, kind int, src long, data binary, stat array<double>"
STATE, REPLY, ASK, ANSWER, PAYLOAD, MESSAGE, HOME = range(7)


# -- arrays as bytes --------------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed piece: integers as narrow as they fit, hashes (uint64, mostly ascending) as the bytes of
    their differences, place by place."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype == np.uint64:
            a = np.ascontiguousarray(np.diff(a, prepend=np.zeros(1, np.uint64)).view(np.uint8).reshape(-1, 8).T).reshape(-1).view(np.uint64)
        elif a.dtype.kind in "iu":
            top = int(a.max(initial=0))
            a = a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<i8")
        out += [a.dtype.str.encode().ljust(4), struct.pack("<Q", a.nbytes), a.tobytes()]
    raw = b"".join(out)
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(data) -> list[np.ndarray]:
    (size,) = struct.unpack_from("<Q", data)
    raw = pa.Codec("zstd").decompress(memoryview(data)[8:], size, asbytes=True)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        kind, (size,) = np.dtype(raw[at : at + 4].decode().strip()), struct.unpack_from("<Q", raw, at + 4)
        a = np.frombuffer(raw, kind, size // kind.itemsize, at + 12)
        if kind == np.uint64:
            a = np.cumsum(np.ascontiguousarray(a.view(np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64), dtype=np.uint64)
        out.append(a.astype(np.int64) if kind.kind in "iu" and kind != np.uint64 else a)
        at += 12 + size
    return out


# -- seating ----------------------------------------------------------------------------------------------------------


def uniform(key: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers of [0, 1) by key and salt."""
    s = np.array([0x9E3779B97F4A7C15], np.uint64)
    for x in salt:
        s = mix(s ^ np.uint64(x + 1))
    return (mix(mix(key) ^ s) >> np.uint64(11)) * 2.0**-53


class Alone:
    """The probability that a customer of a dish with c customers at t tables sits alone: S(c-1, t-1) / S(c, t), with the
    generalised Stirling numbers of a discount d. Beyond EXACT customers it is that of one large table and t - 1 tables
    of independent sizes with the mean c / t (within 3 % at EXACT)."""

    def __init__(self, d: float):
        n = EXACT + 1
        log = np.full((n, n), -np.inf)
        log[0, 0] = 0.0
        self.exact = np.zeros((n, n))
        t = np.arange(1, n)
        for c in range(1, n):
            with np.errstate(divide="ignore", invalid="ignore"):
                more = np.where(c - 1 - d * t > 0, np.log(np.maximum(c - 1 - d * t, 1e-300)), -np.inf) + log[c - 1, 1:]
            log[c, 1:] = np.logaddexp(log[c - 1, :-1], more)
            with np.errstate(invalid="ignore"):
                self.exact[c, 1:] = np.where(np.isfinite(log[c, 1:]), np.exp(log[c - 1, :-1] - log[c, 1:]), 0.0)
        y = np.logspace(-0.0001, -40, 4000)
        full = -np.expm1(d * np.log(y))
        self.mean, self.one = np.log((1 - y) * d * y ** (d - 1) / full), (1 - y) * d / full

    def __call__(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = self.exact[np.minimum(c, EXACT), np.minimum(t, EXACT)]
        big = c > EXACT
        if big.any():
            c, t = c[big], t[big]
            out[big] = np.clip((t - 1) * np.interp(np.log(c / t), self.mean, self.one) / c, 0, 1) + (t == c)
            out[big] = np.minimum(out[big], 1)
        return out


def arrive(c: np.ndarray, t: np.ndarray, more: np.ndarray, weight: np.ndarray, d: float, key: np.ndarray, salt: tuple, grain: int) -> np.ndarray:
    """Tables after more customers sit down one by one; beyond 2**grain of a dish, in groups of that part of them."""
    c, t, left = c.copy(), t.copy(), more.copy()
    live, r = np.flatnonzero(left > 0), 0
    while len(live):
        n = np.minimum(left[live], np.maximum(1, c[live] >> grain))
        chance = np.where(c[live] == 0, 1.0, weight[live] / np.maximum(weight[live] + c[live] - d * t[live], 1e-12))
        t[live] += np.minimum(np.floor(n * chance + uniform(key[live], *salt, r)).astype(np.int64), n)
        c[live] += n
        left[live] -= n
        live, r = live[left[live] > 0], r + 1
    return t


def leave(c: np.ndarray, t: np.ndarray, fewer: np.ndarray, alone: Alone, key: np.ndarray, salt: tuple, grain: int) -> np.ndarray:
    """Tables after some customers go, likewise."""
    c, t, left = c.copy(), t.copy(), fewer.copy()
    live, r = np.flatnonzero(left > 0), 0
    while len(live):
        n = np.minimum(left[live], np.maximum(1, c[live] >> grain))
        gone = np.minimum(np.floor(n * alone(c[live], t[live]) + uniform(key[live], *salt, r)).astype(np.int64), n)
        c[live] -= n
        t[live] = np.clip(t[live] - gone, np.minimum(c[live], 1), c[live])
        left[live] -= n
        live, r = live[left[live] > 0], r + 1
    return t


def reseat(c: np.ndarray, t: np.ndarray, weight, alone: Alone, d: float, key: np.ndarray, salt: tuple, moves: int) -> np.ndarray:
    """Gibbs: as many customers as a dish has get up and sit down again, the first moves of them one by one, the rest in groups
    of 2**-GRAIN of the dish (one by one below 2 * 2**GRAIN customers). weight(dishes, tables) is a new table's weight when so
    many of the dish stand."""
    t, left = t.copy(), np.where(c > 1, c, 0)
    live, r = np.flatnonzero(left), 0
    while len(live):
        n, now = c[live], t[live]
        g = np.ones(len(live), np.int64) if r < moves else np.minimum(left[live], np.maximum(1, n >> GRAIN))
        gone = np.ceil(g * alone(n, now) - uniform(key[live], *salt, 2 * r)).astype(np.int64)
        now = np.clip(now - gone, 1, n - g)
        w = weight(live, now)
        chance = w / np.maximum(w + n - g - d * now, 1e-12)
        t[live] = now + np.minimum(np.ceil(g * chance - uniform(key[live], *salt, 2 * r + 1)).astype(np.int64), g)
        left[live] -= g
        live, r = live[left[live] > 0], r + 1
    return t


class Model:
    """Numbers that all places share: discounts and strength of both levels, the parent's totals, the words known."""

    def __init__(self, d2=0.5, d1=0.5, strength=STRENGTH, words=0, customers=0, tables=0, seed=11, moves=MOVES):
        self.d2, self.d1, self.strength, self.words = d2, d1, strength, words
        self.customers, self.tables, self.seed, self.moves = customers, tables, seed, moves
        self.base = 1.0 / (words + 1)

    def parent(self, c: np.ndarray, t: np.ndarray, away: np.ndarray | int = 0) -> np.ndarray:
        """The parent's probability of words with c customers at t tables, when some of the customers are away."""
        c = np.maximum(c - away, 0)
        own = np.maximum(c - self.d1 * np.minimum(t, c), 0)
        return (own + (self.strength + self.d1 * self.tables) * self.base) / np.maximum(self.strength + self.customers - away, 1e-9)


class Part:
    """Contexts with their dishes: context and word of each dish (places in the lists of hashes), customers and tables."""

    FIELDS = ("words", "contexts", "of", "word", "c", "t", "sum_t", "size", "above", "standing", "known", "shared")

    def __init__(self, words, contexts, of, word, c, shared):
        self.words, self.contexts, self.of, self.word, self.c, self.shared = words, contexts, of, word, c, shared
        self.t, self.sum_t = np.minimum(c, 1), np.zeros(len(c), np.int64)
        self.size = np.bincount(of, c, len(contexts)).astype(np.int64)
        self.above = self.standing = np.zeros(0, np.int64)
        self.known = np.zeros(len(words), np.int64)

    def dump(self) -> bytes:
        return pack(*(getattr(self, f) for f in self.FIELDS))

    @classmethod
    def load(cls, data) -> Part:
        out = cls.__new__(cls)
        for f, a in zip(cls.FIELDS, unpack(data), strict=True):
            setattr(out, f, a)
        return out

    def keys(self) -> np.ndarray:
        return mix(self.contexts[self.of] * np.uint64(3) + np.uint64(1)) ^ self.words[self.word]

    def tables(self) -> np.ndarray:
        """Tables by context."""
        return np.bincount(self.of, self.t, len(self.contexts)).astype(np.int64)

    def sent(self, what: np.ndarray) -> np.ndarray:
        """What the dishes of each word have together."""
        return np.bincount(self.word, what, len(self.words)).astype(np.int64)

    def seat(self, m: Model, known: np.ndarray, n: int, size: np.ndarray) -> None:
        """A start: customers sit down one by one, words as frequent as in the corpus."""
        self.known, self.size = known, size
        weight = (m.strength + m.d2 * size**m.d2)[self.of] * ((known + 1) / (n + m.words + 1))[self.word]
        one = np.minimum(self.c, 1)
        self.t = arrive(one, one, self.c - one, weight, m.d2, self.keys(), (m.seed, 0, 2), 6)

    def sweep(self, m: Model, k: int, c1: np.ndarray, t1: np.ndarray, total: np.ndarray, alone: Alone) -> None:
        """One sweep, given each word's customers and tables at the parent and each context's tables."""
        before, c1, t1 = self.t, c1[self.word], t1[self.word]
        total = total[self.of]

        def weight(at, now):
            own = before[at] - now
            return (m.strength + m.d2 * (total[at] - own)) * m.parent(c1[at], t1[at], own)

        self.t = reseat(self.c, self.t, weight, alone, m.d2, self.keys(), (m.seed, k, 2), m.moves)

    def keep(self, c1: np.ndarray, t1: np.ndarray, total: np.ndarray) -> None:
        """Add the state at hand to the samples."""
        self.sum_t = self.sum_t + self.t
        self.above, self.standing = np.concatenate((self.above, c1, t1)), np.concatenate((self.standing, total))

    def averages(self, kept: list[Model]) -> tuple[np.ndarray, np.ndarray]:
        """Of each sample: the parent's probability of each word, and each context's share for it."""
        above, standing = self.above.reshape(len(kept), 2, -1), self.standing.reshape(len(kept), -1)
        return np.array([m.parent(a[0], a[1]) for m, a in zip(kept, above, strict=True)]), np.array([(m.strength + m.d2 * t) / (m.strength + self.size) for m, t in zip(kept, standing, strict=True)])

    def predict(self, m: Model, averages: tuple[np.ndarray, np.ndarray], context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Averaged probabilities of words after contexts, both as places in the lists."""
        ups, shares = averages
        n, wide = len(ups), len(self.words)
        key, dish = context * wide + word, self.of * wide + self.word
        at = np.minimum(np.searchsorted(dish, key), len(dish) - 1) if len(dish) else np.zeros(len(key), np.int64)
        has = dish[at] == key if len(dish) else np.zeros(len(key), bool)
        out = sum(shares[s][context] * ups[s][word] for s in range(n)) / n
        at = at[has]
        out[has] += (self.c[at] - m.d2 * self.sum_t[at] / n) / (m.strength + self.size[context[has]])
        return out


class Home:
    """Words at the parent: occurrences, customers and tables; and the totals of contexts that several parts share."""

    FIELDS = ("words", "known", "c", "t")

    def __init__(self, words, known):
        self.words, self.known = words, known
        self.c = self.t = np.zeros(len(words), np.int64)

    dump, load = Part.dump, classmethod(Part.load.__func__)

    def sweep(self, m: Model, k: int, sent: np.ndarray, alone: Alone) -> None:
        """The parent's customers are now sent: some come or go, then customers get up and sit down again."""
        fresh = np.full(len(self.words), (m.strength + m.d1 * m.tables) * m.base)
        t = leave(self.c, self.t, np.maximum(self.c - sent, 0), alone, self.words, (m.seed, k, 0), 10)
        t = arrive(np.minimum(self.c, sent), t, np.maximum(sent - self.c, 0), fresh, m.d1, self.words, (m.seed, k, 1), 10 if k else 6)
        before = t

        def weight(at, now):
            return (m.strength + m.d1 * (m.tables - (before[at] - now))) * m.base

        self.c, self.t = sent, reseat(sent, t, weight, alone, m.d1, self.words, (m.seed, k, 3), m.moves)


# -- blocks of documents ----------------------------------------------------------------------------------------------


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, tokens by text); a text's last token is its end."""
    out, sizes = [], []
    for _, _, h, bounds in word_hashes(texts):
        n = np.diff(bounds)
        words = np.empty(len(h) + len(n), np.uint64)
        end = np.zeros(len(words), bool)
        end[bounds[1:] + np.arange(len(n))] = True
        words[end], words[~end] = _END, h
        out.append(words)
        sizes.append(n + 1)
    return (np.concatenate(out), np.concatenate(sizes)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _blocks(batches):
    """(ids, held out, tokens by text, hashes of the distinct words with the start as last, context and word of each token as places)."""
    held: list = []
    size = 0

    def close():
        ids = pa.concat_arrays([b.column(0) for b, _, _ in held])
        out = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b, _, _ in held])
        words, n = np.concatenate([p for _, p, _ in held]), np.concatenate([k for _, _, k in held])
        distinct, word = np.unique(words, return_inverse=True)
        context = np.empty(len(word), np.int64)
        context[1:] = word[:-1]
        context[np.cumsum(n) - n] = len(distinct)
        return ids, out, n, np.append(distinct, _START), context, word

    for b in batches:
        for at in range(0, b.num_rows, 512):
            piece = b.slice(at, 512)
            words, n = _tokens(piece.column(2))
            held.append((piece, words, n))
            size += len(words)
            if size >= BLOCK_TOKENS:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def _dealt(context: np.ndarray, word: np.ndarray, parts: int, hot: dict[int, int]) -> np.ndarray:
    """The part of each pair of hashes."""
    salt = np.zeros(len(context), np.uint64)
    if hot:
        known = np.array(sorted(hot), np.uint64)
        at = np.minimum(np.searchsorted(known, context), len(known) - 1)
        is_hot = known[at] == context
        ways = np.array([hot[int(x)] for x in known], np.uint64)[at[is_hot]]
        salt[is_hot] = np.uint64(1) + mix(word[is_hot]) % ways
    return (mix(context + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)


def _bits(*sorted_hashes: np.ndarray) -> int:
    """First bits by which the hashes of each list differ."""
    least = min((int((x[1:] ^ x[:-1]).min()) for x in sorted_hashes if len(x) > 1), default=1 << 63)
    return 65 - least.bit_length()


def _asks(batches, parts: int, hot: dict[int, int], bits: int = 0):
    """For each block and part: the block's distinct pairs there, context by context, with their training counts. With bits,
    the documents of each pair instead, words by the first bits of their hashes, and the block itself."""
    short = np.uint64(64 - bits if bits else 0)
    for k, (ids, out, n, distinct, context, word) in enumerate(_blocks(batches)):
        name = (TaskContext.get().partitionId() << 32) + k
        wide = len(distinct)
        key = context * wide + word
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        doc = np.repeat(np.arange(len(n)), n)[order]
        times = np.diff(np.append(first, len(key)))
        train = np.add.reduceat((~out)[doc].astype(np.int64), first)
        v, w = key[first] // wide, key[first] % wide
        part = _dealt(distinct[v], distinct[w], parts, hot)
        by = np.argsort(part, kind="stable")
        v, w, at = v[by], w[by], np.searchsorted(part[by], np.arange(parts + 1))
        for p in range(parts):
            a, z = at[p], at[p + 1]
            if a == z:
                continue
            new = np.flatnonzero(np.concatenate(([True], v[a + 1 : z] != v[a : z - 1])))
            words, local = np.unique(w[a:z], return_inverse=True)
            data = [distinct[v[a:z][new]] >> short, np.diff(np.append(new, z - a)), distinct[words] >> short, local]
            if bits:
                some = times[by[a:z]]
                start = np.repeat(first[by[a:z]] - (np.cumsum(some) - some), some) + np.arange(some.sum())
                data += [some, doc[start]]
            else:
                data += [train[by[a:z]]]
            yield p, ASK, name, pack(*data)
        if bits:
            table = pa.RecordBatch.from_arrays([ids, pa.array(out), pa.array(n, pa.int64())], ["id", "out", "n"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as s:
                s.write_batch(table)
            yield int(name % parts), PAYLOAD, name, sink.getvalue().to_pybytes()


def _batches(rows):
    """Rows (dest, kind, src, data[, stat]) as batches of bounded size."""
    held: list = []
    size = 0
    schema = pa.schema([("dest", pa.int32()), ("kind", pa.int32()), ("src", pa.int64()), ("data", pa.binary()), ("stat", pa.list_(pa.float64()))])
    
    def batch():
        cols = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for r in rows:
        held.append((*r, None)[:5])
        size += len(r[3] or b"")
        if size > 1 << 23 or len(held) >= 4096:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _rows(batches):
    for b in batches:
        dest, kind, src, data = (b.column(i) for i in range(4))
        for i in range(b.num_rows):
            yield dest[i].as_py(), kind[i].as_py(), src[i].as_py(), data[i].as_py()


def _by_dest(batches):
    """(dest, rows (kind, src, data)) of rows sorted by dest."""
    now, held = None, []
    for dest, kind, src, data in _rows(batches):
        if dest != now and held:
            yield now, held
            held = []
        now = dest
        held.append((kind, src, data))
    if held:
        yield now, held


def _home_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(parts)).astype(np.int64)


def _send(p: int, part: Part, parts: int, by_word: np.ndarray, by_context: np.ndarray):
    """Messages to the homes: a number of each word, and one of each shared context."""
    a, b = _home_of(part.words, parts), _home_of(part.contexts[part.shared], parts)
    for h in range(parts):
        i, j = np.flatnonzero(a == h), part.shared[b == h]
        if len(i) or len(j):
            yield h, MESSAGE, p, pack(part.words[i], by_word[i], part.contexts[j], by_context[j])


def _received(part: Part, parts: int, replies: dict[int, list[np.ndarray]], totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two numbers of each word, one of each context) from the homes' answers."""
    x, y, total = np.zeros(len(part.words), np.int64), np.zeros(len(part.words), np.int64), totals.copy()
    a, b = _home_of(part.words, parts), _home_of(part.contexts[part.shared], parts)
    for h, (c, t, shared) in replies.items():
        i = a == h
        x[i], y[i] = c, t
        total[part.shared[b == h]] = shared
    return x, y, total


def _answer_homes(h: int, home: Home, messages: list, two) -> object:
    """Replies to all parts: two(home) gives two numbers of each word; shared contexts get their totals."""
    keys = np.concatenate([m[2] for _, m in messages])
    distinct, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, np.concatenate([m[3] for _, m in messages]), len(distinct)).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
    x, y = two(home)
    for p, m in messages:
        i = np.searchsorted(home.words, m[0])
        yield p, REPLY, h, pack(x[i], y[i], total[np.searchsorted(distinct, m[2])])


def _sum_at(home_words: np.ndarray, messages: list) -> np.ndarray:
    out = np.zeros(len(home_words), np.int64)
    for _, m in messages:
        np.add.at(out, np.searchsorted(home_words, m[0]), m[1])
    return out


# -- the operator -----------------------------------------------------------------------------------------------------


def layout(rows: DataFrame, most: int) -> tuple[int, dict[int, int]]:
    """(parts, {word: ways to deal it}), by a sample of rows: words with more than a quarter of a mean part's tokens, 4 * parts
    at most. Only where work is done follows from this, not what comes out."""
    n = rows.count()
    some = rows.select("text") if n <= LAYOUT_ROWS else rows.select("text").sample(min(1.0, LAYOUT_ROWS / n), 5)

    def count(batches):
        for b in batches:
            words, n = _tokens(b.column(0))
            words = np.append(words[words != _END], np.full(len(n), _START))
            w, c = np.unique(words, return_counts=True)
            yield pa.RecordBatch.from_pydict({"w": pa.array(w.view(np.int64)), "c": pa.array(c.astype(np.int64))})

    counted = written(some.mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")))
    total = counted.agg(F.sum("c")).first()[0] or 0
    parts = int(min(most, max(1, np.ceil(total * max(1, n / LAYOUT_ROWS) / PART_TOKENS))))
    least = max(2.0, total / (4 * parts))
    out = {r.w & 0xFFFFFFFFFFFFFFFF: min(parts, int(np.ceil(r.c / least))) for r in counted.where(F.col("c") > least).collect()}
    drop(counted)
    return parts, {w: k for w, k in out.items() if k > 1}


def log_probabilities(docs: DataFrame, held_out, seed: int = 11, burn: int = BURN, samples: int = SAMPLES, moves: int = MOVES, strength: float = STRENGTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; held_out is a Column.

    Tokens are lower-cased words and one end; the model learns from all whole texts that are not held out, and scores
    every whole text. base_score sums log10((c + 1) / (N + V + 1)); score sums log10 of the model's averaged predictive
    probabilities of each token after the one before. Null text counts as empty (one token), a null held_out as false.
    Repeated rows are texts of their own, equal texts get equal scores, null ids are kept, an empty table gives no rows, and
    other columns are not read. The scores do not depend on how many parts the model has."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    parts, hot = layout(rows, partitions(spark))
    ways = np.array(sorted(hot), np.uint64)

    def dealt(df: DataFrame, f, schema: str = _ROWS) -> DataFrame:
        """f over the rows of each dest, in its own task."""

        def run(batches):
            yield from _batches(x for dest, held in _by_dest(batches) for x in f(dest, held))

        return df.select("dest", "kind", "src", "data").repartitionById(parts, "dest").sortWithinPartitions("dest", "kind", "src").mapInArrow(run, schema)

    def ask(bits: int = 0) -> DataFrame:
        return rows.mapInArrow(lambda batches: _batches(_asks(batches, parts, hot, bits)), _ROWS)

    def stats(df: DataFrame, kind: int, n: int) -> list[float]:
        got = df.where(F.col("kind") == kind).agg(*[F.sum(F.get("stat", F.lit(i))) for i in range(n)]).first()
        return [float(x or 0) for x in got]

    # Parts: the distinct pairs of all blocks, with their training counts.
    def gather(p, held):
        got = [unpack(x) for _, _, x in held]
        words, contexts = np.unique(np.concatenate([g[2] for g in got])), np.unique(np.concatenate([g[0] for g in got]))
        key = np.concatenate([np.repeat(np.searchsorted(contexts, g[0]), g[1]) * len(words) + np.searchsorted(words, g[2])[g[3]] for g in got])
        count = np.concatenate([g[4] for g in got])
        key, count = key[count > 0], count[count > 0]
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        count = np.add.reduceat(count, new) if len(new) else np.zeros(0, np.int64)
        key = key[new]
        part = Part(words, contexts, key // len(words), key % len(words), count, np.flatnonzero(np.isin(contexts, ways)))
        yield p, STATE, -1, part.dump(), [float((count == 1).sum()), float((count == 2).sum()), float(count.sum()), float(_bits(words, contexts))]
        yield from _send(p, part, parts, part.sent(part.c), part.size)

    def first_home(h, held):
        messages = [(src, unpack(x)) for kind, src, x in held if kind == MESSAGE]
        words = np.unique(np.concatenate([m[0] for _, m in messages]))
        home = Home(words, _sum_at(words, messages))
        yield h, HOME, -1, home.dump(), [float((home.known > 0).sum())]
        yield from _answer_homes(h, home, messages, lambda x: (x.known, x.known))

    state = written(dealt(ask(), gather))
    once, twice, n = stats(state, STATE, 3)
    n, bits = int(n), int(state.agg(F.max(F.get("stat", F.lit(3)))).first()[0] or 64)
    homes = written(dealt(state.where(F.col("kind") == MESSAGE), first_home))
    (words,) = stats(homes, HOME, 1)
    d2 = _discount(once, twice)
    # The parent's discount is not known before its customers are; it starts from the middle.
    m = Model(d2, 0.5, strength, int(words), n, int(words), seed, moves)

    def parts_step(k: int, m: Model):
        """Take the homes' answers (to the state that sweep k - 1 left), keep a sample, then make sweep k."""
        alone = Alone(m.d2)

        def work(p, held):
            part = Part.load(next(x for kind, _, x in held if kind == STATE))
            replies = {src: unpack(x) for kind, src, x in held if kind == REPLY}
            if k == 0:
                known, _, size = _received(part, parts, replies, part.size)
                part.seat(m, known, n, size)
            else:
                c1, t1, total = _received(part, parts, replies, part.tables())
                if k > burn:
                    part.keep(c1, t1, total)
                if k < burn + samples:
                    part.sweep(m, k, c1, t1, total, alone)
            yield p, STATE, -1, part.dump()
            if k < burn + samples:
                yield from _send(p, part, parts, part.sent(part.t), part.tables())

        return work

    def homes_step(k: int, m: Model):
        alone = Alone(m.d1)

        def work(h, held):
            home = Home.load(next(x for kind, _, x in held if kind == HOME))
            messages = [(src, unpack(x)) for kind, src, x in held if kind == MESSAGE]
            home.sweep(m, k, _sum_at(home.words, messages), alone)
            yield h, HOME, -1, home.dump(), [float(home.c.sum()), float(home.t.sum()), float((home.c == 1).sum()), float((home.c == 2).sum())]
            yield from _answer_homes(h, home, messages, lambda x: (x.c, x.t))

        return work

    kept = []
    for k in range(burn + samples + 1):
        kept += [m] * (k > burn)
        new = written(dealt(state.where(F.col("kind") == STATE).union(homes.where(F.col("kind") == REPLY)), parts_step(k, m)))
        drop(state)
        state = new
        if k < burn + samples:
            new = written(dealt(state.where(F.col("kind") == MESSAGE).union(homes.where(F.col("kind") == HOME)), homes_step(k, m)))
            drop(homes)
            homes = new
            customers, tables, once, twice = stats(homes, HOME, 4)
            m = Model(d2, _discount(once, twice) if k == 0 else m.d1, strength, int(words), customers, tables, seed, moves)
        collect_garbage(spark)
    drop(homes)
    collect_garbage(spark)

    # Answers: each part's share of each document's sums.
    asked = state.where(F.col("kind") == STATE).select("dest", "kind", "src", "data").union(ask(bits).select("dest", "kind", "src", "data"))

    def answers(batches):
        """Rows are streamed: a part's state comes first, then block by block."""

        def work():
            part = None
            for dest, kind, src, data in _rows(batches):
                if kind == STATE:
                    part = Part.load(data)
                    lists = (part.words >> np.uint64(64 - bits), part.contexts >> np.uint64(64 - bits), part.averages(kept))
                elif kind == PAYLOAD:
                    yield dest, PAYLOAD, src, data
                else:
                    yield dest, ANSWER, src, _answer(part, lists, data, m, n, int(words))

        yield from _batches(work())

    given = asked.repartitionById(parts, "dest").sortWithinPartitions("dest", "kind", "src").mapInArrow(answers, _ROWS)

    def add_up(batches):
        def close(held):
            ((_, table),) = [x for x in held if x[0] == PAYLOAD]
            t = pa.ipc.open_stream(table).read_all().combine_chunks()
            size = t.column("n").to_numpy()
            score, base, known = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size))
            for kind, data in held:
                if kind == ANSWER:
                    which, a, b, c = unpack(data)
                    score[which] += a
                    base[which] += b
                    known[which] += c
            return pa.RecordBatch.from_pydict({
                "doc_id": t.column("id").combine_chunks(), "held_out": t.column("out").combine_chunks(), "n_tokens": size, "n_known": known.astype(np.int64),
                "train_tokens": np.full(len(size), n), "base_score": base, "score": score,
            })

        now, held = None, []
        for _, kind, src, data in _rows(batches):
            if src != now and held:
                yield close(held)
                held = []
            now = src
            held.append((kind, data))
        if held:
            yield close(held)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return given.repartition(parts, "src").sortWithinPartitions("src", "kind", "dest").select("dest", "kind", "src", "data").mapInArrow(add_up, schema)


def _discount(once: float, twice: float) -> float:
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5


def _answer(part: Part, lists: tuple, data, m: Model, n: int, words: int) -> bytes:
    """A part's answer to a block: of each of its documents, the sums over the pairs that lie here."""
    short_words, short_contexts, averages = lists
    v, runs, w, local, some, doc = unpack(data)
    word, context = np.searchsorted(short_words, w)[local], np.repeat(np.searchsorted(short_contexts, v), runs)
    chance, known = np.log10(part.predict(m, averages, context, word)), part.known[word]
    base = np.log10((known + 1) / (n + words + 1))
    which, at = np.unique(doc, return_inverse=True)
    score, least, seen = (np.bincount(at, np.repeat(y, some), len(which)) for y in (chance, base, (known > 0).astype(float)))
    return pack(which, score, least, seen.astype(np.int64))


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds perplexity: 10 ** (-score / n_tokens). Null scores or sizes give null, rows stay as they are."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op6(spark, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    return perplexity(log_probabilities(spark.read.parquet(f"{sf_dir}/documents.parquet"), held))
