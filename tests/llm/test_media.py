import hashlib
import struct
import zlib

import numpy as np
import pytest

from cellweave.llm import jpeg, media


@pytest.mark.parametrize("n", [576, 1152, 5760])
def test_payload_round_trip(n):
    p = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    d = jpeg.encode_payload(p)
    assert jpeg.decode_payload(d) == p == jpeg.decode_payload(d, fast=False)
    assert (jpeg.decode(d) == jpeg.decode(d, fast=False)).all()


class Writer:
    def __init__(self):
        self.s = ""

    def put(self, v, n):
        self.s += format(v, f"0{n}b") if n else ""

    def done(self):
        s = self.s + "1" * (-len(self.s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\0")


def general_file(coef, h, w):
    """A grey image of sparse coefficients (blocks, 64) by a plain encoder: runs of zeros, ends of band over many blocks, refinement."""
    symbols = sorted({(r << 4) | s for r in range(16) for s in range(11)} - {0})[:175] + [0]
    symbols = [0, *[s for s in symbols if s]]
    lengths = bytes([0] * 7 + [len(symbols)] + [0] * 8)
    code = {s: i for i, s in enumerate(symbols)}
    seg = lambda m, b: struct.pack(">BBH", 255, m, len(b) + 2) + b
    out = [b"\xff\xd8", seg(jpeg.DQT, bytes([0] + [1] * 64)), seg(jpeg.SOF2, struct.pack(">BHHB", 8, h, w, 1) + bytes([1, 0x11, 0]))]
    out.append(seg(jpeg.DHT, bytes([0]) + lengths + bytes(symbols)) + seg(jpeg.DHT, bytes([0x10]) + lengths + bytes(symbols)))

    def signed(b, v):
        n = int(abs(v)).bit_length()
        b.put(v if v > 0 else v + (1 << n) - 1, n)

    b, before = Writer(), 0
    for c in coef:
        d = (int(c[0]) >> 1) - before
        before += d
        b.put(code[int(abs(d)).bit_length()], 8)
        if d:
            signed(b, d)
    out.append(seg(jpeg.SOS, bytes([1, 1, 0, 0, 0, 0x01])) + b.done())
    b = Writer()
    for c in coef:
        b.put(int(c[0]) & 1, 1)
    out.append(seg(jpeg.SOS, bytes([1, 1, 0, 0, 0, 0x10])) + b.done())
    b = Writer()
    for c in coef:  # AC 1 to 63, Al 1
        run = 0
        high = [int(np.sign(v)) * (abs(int(v)) >> 1) for v in c]
        last = max([k for k in range(1, 64) if high[k]], default=0)
        for k in range(1, last + 1):
            if not high[k]:
                run += 1
                if run == 16:
                    b.put(code[0xF0], 8)
                    run = 0
                continue
            b.put(code[run << 4 | abs(high[k]).bit_length()], 8)
            signed(b, high[k])
            run = 0
        if last < 63:
            b.put(code[0], 8)
    out.append(seg(jpeg.SOS, bytes([1, 1, 0, 1, 63, 0x01])) + b.done())
    b = Writer()
    for c in coef:  # refinement to Al 0
        last = max([k for k in range(1, 64) if abs(c[k]) == 1], default=0)
        run, pending = 0, []
        for k in range(1, last + 1):
            if abs(c[k]) > 1:
                pending.append(abs(int(c[k])) & 1)
            elif c[k] == 0:
                run += 1
                if run == 16:
                    b.put(code[0xF0], 8)
                    for x in pending:
                        b.put(x, 1)
                    run, pending = 0, []
            else:
                b.put(code[run << 4 | 1], 8)
                b.put(int(c[k] > 0), 1)
                for x in pending:
                    b.put(x, 1)
                run, pending = 0, []
        if last < 63:
            b.put(code[0], 8)
            for x in pending + [abs(int(c[k])) & 1 for k in range(last + 1, 64) if abs(c[k]) > 1]:
                b.put(x, 1)
    out.append(seg(jpeg.SOS, bytes([1, 1, 0, 1, 63, 0x10])) + b.done() + b"\xff\xd9")
    return b"".join(out)


def test_general_scans():
    rng = np.random.default_rng(4)
    coef = rng.integers(-60, 60, (6, 64)) * (rng.random((6, 64)) < 0.2)
    coef[2, 1:] = 0
    coef[:, 0] = rng.integers(-400, 400, 6)
    h, w, parts, quant, _ = jpeg.coefficients(general_file(coef, 16, 20))
    assert (h, w) == (16, 20) and (parts[0].coef.reshape(-1, 64) == coef).all()
    image = jpeg.tensor(h, w, parts, quant)
    u = np.arange(8)
    c = np.where(u[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * u[None] + 1) * u[:, None] * np.pi / 16)
    natural = np.zeros(64)
    natural[jpeg.ZIGZAG] = coef[0]
    assert np.abs(np.clip(c.T @ natural.reshape(8, 8) @ c + 128, 0, 255) - image[:8, :8, 0]).max() <= 0.51


def test_query_columns(spark):
    texts = [None, "", "x", "é" * 400, "long " * 9000, "x"]
    docs = spark.createDataFrame([(i, t, b"1") for i, t in enumerate(texts)] + [(2, "x", b"2")], "doc_id long, text string, media binary")
    got = media.read_features(media.store_text(docs)).collect()
    assert len(got) == 7
    same = set()
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        p = media.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert len(p) % 576 == 0 and r.media_bytes > len(p)
        if raw == b"x":
            same.add((r.media_sha256, r.feature))
    assert len(same) == 1
    t = media.read_tensors(media.store_text(docs)).where("doc_id = 3").first()
    assert len(t.tensor) == t.height * t.width * 3
    assert media.read_features(media.store_text(docs.limit(0))).collect() == []
