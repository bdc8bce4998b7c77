"""Words and hashes of whole texts, computed by numpy over the bytes of many texts at once.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z lower-cased. A word's hash is a
polynomial over its bytes modulo 2**64, finalised by xor-shifts; two words of a corpus collide with a
probability of about pairs / 2**64."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in pieces of about this many bytes, so that memory does not follow the text's length.
PIECE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 64, 256, dtype=np.uint64)
_LETTER = _RANDOM[LOWER]
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i under n at least."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        n = max(n, PIECE + 1)
        with np.errstate(over="ignore"):
            for name, x in (("up", _BASE), ("down", _INVERSE)):
                a = np.full(n, x, np.uint64)
                a[0] = 1
                _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets between them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _of_piece(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts data[off[i]:off[i+1]]: word starts, ends and hashes."""
    n = len(data)
    solid = ~SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begin[inner] = solid[inner]
    end[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[data] * up[:n], out=total[1:])
        return starts, ends, mix((total[ends] - total[starts]) * down[starts])


def word_spans(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, hashes, bounds, starts, ends) for runs of texts i to j: bounds are the word offsets of each text,
    starts and ends are byte offsets in the run's own text. Long texts are cut at spaces and put together again."""
    data, off = text_bytes(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, "right")) - 1)
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= 2 * PIECE:
            rel = off[i : j + 1] - lo
            s, e, h = _of_piece(data[lo:hi], rel)
            bounds = np.searchsorted(s, rel)
            own = np.repeat(rel[:-1], np.diff(bounds))
            yield i, j, h, bounds, s - own, e - own
        else:
            parts, at = [], lo
            while at < hi:
                to = min(hi, at + PIECE)
                while to < hi and not SPACE[data[to]]:
                    gap = np.flatnonzero(SPACE[data[to : to + PIECE]])
                    to = to + int(gap[0]) if len(gap) else min(hi, to + PIECE)
                s, e, h = _of_piece(data[at:to], np.array([0, to - at]))
                parts.append((s + at - lo, e + at - lo, h))
                at = to
            s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield i, j, h, np.array([0, len(h)]), s, e
        i = j


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, h, bounds, _, _ in word_spans(texts):
        yield i, j, h, bounds


def shingles(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and their bounds by text. A text of 1 to n - 1 words has one: the whole."""
    sizes = np.diff(bounds)
    with np.errstate(over="ignore"):
        if len(h) >= n:
            m = len(h) - n + 1
            x = np.zeros(m, np.uint64)
            for k in range(n):
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + m]
            x = mix(x)
            ok = np.zeros(m, bool)
            at = np.concatenate(([0], np.cumsum(np.maximum(sizes - n + 1, 0))))
            total = int(at[-1])
            pick = np.arange(total) + np.repeat(bounds[:-1] - at[:-1], np.diff(at))
            ok = x[pick]
        else:
            ok, at = np.zeros(0, np.uint64), np.zeros(len(sizes) + 1, np.int64)
        short = np.flatnonzero((sizes > 0) & (sizes < n))
        if len(short) == 0:
            return ok, at
        parts, counts = [], np.diff(at)
        for t in short:
            v = np.uint64(sizes[t])
            for w in h[bounds[t] : bounds[t + 1]]:
                v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w
            parts.append(mix(np.array([v ^ np.uint64(0xA5A5A5A5A5A5A5A5)]))[0])
        counts[short] = 1
        new = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(int(new[-1]), np.uint64)
        whole = np.zeros(len(out), bool)
        whole[new[short]] = True
        out[whole], out[~whole] = np.array(parts, np.uint64), ok
        return out, new
