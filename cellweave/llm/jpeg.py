"""Progressive JPEG: a decoder of its scans into coefficients and RGB tensors, and an encoder that stores bytes in them.

The decoder takes 8-bit Huffman-coded progressive files (SOF2): DC and AC scans, spectral selection, successive
approximation, end-of-band runs, restart intervals, interleaved DC scans, any sampling factors. Scans whose Huffman
table has one symbol have a fixed length per coefficient, and those are read by numpy as a whole; all others are
read bit by bit.

The encoder keeps a payload in the quantised coefficients of a 4:2:0 image: each byte b is one coefficient 256 + b,
in zigzag order, with a quantisation of ones. All coefficients then have nine bits, so every scan it writes has
one symbol."""

from __future__ import annotations

import math
import re
import struct

import numpy as np

# Fixed values of the format: zigzag order as the natural index of each coefficient.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
SOI, EOI, SOF2, DHT, SOS, DQT, DRI, COM = 0xD8, 0xD9, 0xC2, 0xC4, 0xDA, 0xDB, 0xDD, 0xFE
PAYLOAD_UNIT = 576

_BITS = 20
_u = np.arange(8)
_COS = np.where(_u[:, None] == 0, math.sqrt(1 / 8), 0.5) * np.cos((2 * _u[None, :] + 1) * _u[:, None] * math.pi / 16)
#: Inverse transform from zigzag coefficients to 64 pixels, in whole numbers of 2**-20, so that sums are exact in any order.
_INVERSE = np.rint(np.kron(_COS, _COS).reshape(64, 64)[ZIGZAG] * (1 << _BITS))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(data: np.ndarray) -> bytes:
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    """Bits (any shape) as entropy-coded bytes, padded with ones."""
    bits = bits.reshape(-1)
    pad = -len(bits) % 8
    return _stuffed(np.packbits(np.concatenate((bits, np.ones(pad, np.uint8))) if pad else bits))


def _scan(component: int, ss: int, se: int, ah: int, al: int, symbol: int | None, data: bytes) -> bytes:
    table = b"" if symbol is None else _segment(DHT, bytes([0x10 if ss else 0, 1] + [0] * 15 + [symbol]))
    return table + _segment(SOS, bytes([1, component, 0, ss, se, ah << 4 | al])) + data


def _shape(n_blocks: int) -> tuple[int, int]:
    """MCU rows and columns of a 4:2:0 image of at least n_blocks blocks."""
    mcus = max(1, -(-n_blocks // 6))
    wide = math.isqrt(mcus - 1) + 1
    return -(-mcus // wide), wide


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold the payload; its length must be a positive multiple of 64."""
    if not payload or len(payload) % 64:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    n = len(payload) // 64
    high, wide = _shape(n)
    cells = np.zeros((6 * high * wide, 64), np.uint8)
    cells[:n] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    m = high * wide
    out = [b"\xff\xd8", _segment(COM, b"payload %d" % len(payload)), _segment(DQT, bytes([0] + [1] * 64))]
    out.append(_segment(SOF2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    for c, part in ((1, cells[: 4 * m]), (2, cells[4 * m : 5 * m]), (3, cells[5 * m :])):
        k, dc = len(part), part[:, 0]
        # DC, Al 2: a code bit 0 and the seven bits of (256 + b) >> 2; every block is a restart interval.
        first = np.empty((k, 3), np.uint8)
        first[:, 0], first[:, 1], first[:, 2] = dc >> 2 | 64, 0xFF, 0xD0 + np.arange(k) % 8
        out.append(_segment(DRI, b"\0\1") + _scan(c, 0, 0, 0, 2, 7, first.reshape(-1)[:-2].tobytes()) + _segment(DRI, b"\0\0"))
        out.append(_scan(c, 0, 0, 2, 1, None, _packed(dc >> 1 & 1)))
        out.append(_scan(c, 0, 0, 1, 0, None, _packed(dc & 1)))
        bits = np.unpackbits(part, axis=1).reshape(k, 64, 8)
        for ss, se in ((1, 5), (6, 63)):
            # AC, Al 1: a code bit 0, then a one and the upper seven bits of b.
            coded = np.zeros((k, se - ss + 1, 9), np.uint8)
            coded[:, :, 1] = 1
            coded[:, :, 2:] = bits[:, ss : se + 1, :7]
            out.append(_scan(c, ss, se, 0, 1, 8, _packed(coded)))
        last = np.zeros((k, 64), np.uint8)  # an end of band of code 0, then a correction bit for each coefficient
        last[:, 1:] = bits[:, 1:, 7]
        out.append(_scan(c, 1, 63, 1, 0, 0, _packed(last)))
    out.append(b"\xff\xd9")
    return b"".join(out)


_NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")


class _Bits:
    """Entropy-coded bytes, bit by bit."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def bits(self, n: int) -> int:
        if n > self.left:
            raise ValueError("the scan ends early")
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bits(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        v = self.bits(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _huffman(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Component:
    def __init__(self, name: int, h: int, v: int, table: int):
        self.name, self.h, self.v, self.table = name, h, v, table
        self.rows = self.cols = self.own_rows = self.own_cols = 0
        self.coef = np.zeros((0, 0, 64), np.int32)


def _single(codes: dict) -> tuple[int, int] | None:
    """(code length, symbol) of a table with one symbol whose code is zeros."""
    if len(codes) == 1:
        ((n, code), symbol) = next(iter(codes.items()))
        return (n, symbol) if code == 0 else None
    return None


def _scan_at_once(coef: np.ndarray, ss: int, se: int, ah: int, al: int, codes: dict | None, parts: list[bytes], joined: np.ndarray | None, restart: int) -> bool:
    """Read a scan of one component (blocks, 64) as a whole where its codes have one length; False where not."""
    k, n = len(coef), se - ss + 1
    if ss == 0 and ah:
        if restart:
            return False
        bits = np.unpackbits(np.frombuffer(parts[0], np.uint8))[:k]
        if len(bits) < k:
            raise ValueError("the scan ends early")
        coef[:, 0] |= bits.astype(np.int32) << al
        return True
    one = _single(codes or {})
    if one is None:
        return False
    length, symbol = one
    if ss == 0:
        size = symbol
        if restart != 1 or joined is None or not 0 < size or length + size > 8:
            return False
        value = (joined.astype(np.int32) >> (8 - length - size)) & ((1 << size) - 1)
        coef[:, 0] = np.where(value >> (size - 1), value, value - (1 << size) + 1) << al
        return True
    if restart:
        return False
    if ah == 0:
        size = symbol
        if not 0 < size < 16:  # a run of zeros or an end of band
            return False
        step = length + size
        bits = np.unpackbits(np.frombuffer(parts[0], np.uint8))
        if len(bits) < k * n * step:
            raise ValueError("the scan ends early")
        bits = bits[: k * n * step].reshape(k, n, step)
        if bits[:, :, :length].any():
            return False
        if size <= 8:
            value = np.packbits(bits[:, :, length:], axis=2)[:, :, 0].astype(np.int32) >> (8 - size)
        else:
            value = bits[:, :, length:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1))
        low = value < 1 << (size - 1)
        if low.any():
            value -= low * ((1 << size) - 1)
        coef[:, ss : se + 1] = value << al
        return True
    if symbol != 0 or not coef[:, ss : se + 1].all():
        return False
    step = length + n
    bits = np.unpackbits(np.frombuffer(parts[0], np.uint8))
    if len(bits) < k * step:
        raise ValueError("the scan ends early")
    bits = bits[: k * step].reshape(k, step)
    if bits[:, :length].any():
        return False
    old = coef[:, ss : se + 1]
    step = bits[:, length:].astype(np.int32) << al
    if (old < 0).any():
        step *= np.sign(old)
    coef[:, ss : se + 1] += step
    return True


def _ac_block(b: _Bits, c: np.ndarray, ss: int, se: int, ah: int, al: int, codes: dict, run: int) -> int:
    """One block of an AC scan, bit by bit; run: blocks of the end-of-band run that are left, this one included."""
    k, one = ss, 1 << al

    def correct(i: int) -> None:
        if b.bits(1):
            c[i] += one if c[i] > 0 else -one

    if run == 0:
        while k <= se:
            s = b.symbol(codes)
            zeros, size = s >> 4, s & 15
            if size == 0 and zeros < 15:
                run = (1 << zeros) + (b.bits(zeros) if zeros else 0)
                break
            if ah == 0:
                k += zeros
                if size:
                    c[k] = b.signed(size) * one
                k += 1
                continue
            new = (one if b.bits(1) else -one) if size else 0
            while k <= se:
                if c[k]:
                    correct(k)
                elif zeros == 0:
                    c[k] = new
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
    if run:
        if ah:
            for i in range(k, se + 1):
                if c[i]:
                    correct(i)
        run -= 1
    return run


def coefficients(data: bytes, fast: bool = True) -> tuple[int, int, list[_Component], dict[int, np.ndarray], list[bytes]]:
    """(height, width, components with their coefficients, quantisation tables, comments) of a progressive JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, restart, height, width = 2, 0, 0, 0
    quant: dict[int, np.ndarray] = {}
    huff: dict[int, dict] = {}
    parts_of: list[_Component] = []
    comments: list[bytes] = []
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, at = data[at + 1], at + 2
        if marker == EOI:
            break
        n = struct.unpack_from(">H", data, at)[0]
        body, at = data[at + 2 : at + n], at + n
        if marker == COM:
            comments.append(body)
        elif marker == DRI:
            restart = struct.unpack(">H", body)[0]
        elif marker == DQT:
            i = 0
            while i < len(body):
                wide, name = body[i] >> 4, body[i] & 15
                quant[name] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(np.int32)
                i += 1 + 64 * (2 if wide else 1)
        elif marker == DHT:
            i = 0
            while i < len(body):
                m = sum(body[i + 1 : i + 17])
                huff[body[i]] = _huffman(body[i + 1 : i + 17], body[i + 17 : i + 17 + m])
                i += 17 + m
        elif marker == SOF2:
            depth, height, width, k = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("only eight bits a sample")
            parts_of = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
            hm, vm = max(c.h for c in parts_of), max(c.v for c in parts_of)
            for c in parts_of:
                c.cols, c.rows = -(-width // (8 * hm)) * c.h, -(-height // (8 * vm)) * c.v
                c.own_cols, c.own_rows = -(-(-(-width * c.h // hm)) // 8), -(-(-(-height * c.v // vm)) // 8)
                c.coef = np.zeros((c.rows, c.cols, 64), np.int32)
        elif marker == SOS:
            k = body[0]
            chosen = [(next(c for c in parts_of if c.name == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(k)]
            ss, se, ah, al = body[1 + 2 * k], body[2 + 2 * k], body[3 + 2 * k] >> 4, body[3 + 2 * k] & 15
            raw, end = _entropy(data, at)
            at = end
            one, table = chosen[0]
            codes = huff.get((table & 15) | 0x10) if ss else huff.get(table >> 4)
            blocks = one.own_rows * one.own_cols
            if fast and k == 1 and (one.own_rows, one.own_cols) == (one.rows, one.cols):
                flat = one.coef.reshape(-1, 64)
                joined = None
                if restart == 1 and len(raw) == 3 * blocks - 2:
                    grid = np.append(raw, np.array([0xFF, 0xD0], np.uint8)).reshape(-1, 3)
                    if (grid[:, 1] == 0xFF).all() and (grid[:-1, 2] >> 3 == 0xD0 >> 3).all():
                        joined = grid[:, 0]
                whole = [] if restart else [_unstuffed(raw)]
                if _scan_at_once(flat, ss, se, ah, al, codes, whole, joined, restart):
                    continue
            _scan_by_bit(chosen, huff, ss, se, ah, al, _intervals(raw), restart, height, width)
        # other segments have nothing for the coefficients
    return height, width, parts_of, quant, comments


def _entropy(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The entropy-coded bytes from at, restart markers and stuffing included, and where the next marker stands."""
    found = _NEXT_MARKER.search(data, at)
    if not found:
        raise ValueError("the file ends in a scan")
    return np.frombuffer(data, np.uint8, found.start() - at, at), found.start()


def _unstuffed(raw: np.ndarray) -> bytes:
    return raw.tobytes().replace(b"\xff\x00", b"\xff")


def _intervals(raw: np.ndarray) -> list[bytes]:
    at = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)) if len(raw) > 1 else np.zeros(0, int)
    bounds = [0, *(at + 2).tolist()]
    ends = [*at.tolist(), len(raw)]
    return [_unstuffed(raw[a:b]) if b > a else b"" for a, b in zip(bounds, ends, strict=True)]


def _scan_by_bit(chosen, huff, ss, se, ah, al, parts, restart, height, width) -> None:
    if len(chosen) == 1:
        c = chosen[0][0]
        units = [[(0, y, x)] for y in range(c.own_rows) for x in range(c.own_cols)]
    else:
        across, down = chosen[0][0].cols // chosen[0][0].h, chosen[0][0].rows // chosen[0][0].v
        units = [
            [(i, my * c.v + y, mx * c.h + x) for i, (c, _) in enumerate(chosen) for y in range(c.v) for x in range(c.h)]
            for my in range(down) for mx in range(across)
        ]
    bits, part, run, before = _Bits(parts[0]), 0, 0, [0] * len(chosen)
    for n, unit in enumerate(units):
        if restart and n and n % restart == 0:
            part += 1
            bits, run, before = _Bits(parts[part]), 0, [0] * len(chosen)
        for i, y, x in unit:
            c, table = chosen[i]
            block = c.coef[y, x]
            if ss:
                run = _ac_block(bits, block, ss, se, ah, al, huff[(table & 15) | 0x10], run)
            elif ah:
                block[0] |= bits.bits(1) << al
            else:
                before[i] += bits.signed(bits.symbol(huff[table >> 4]))
                block[0] = before[i] << al


def decode_payload(data: bytes, fast: bool = True) -> bytes:
    """The payload that encode_payload stored."""
    _, _, parts, _, comments = coefficients(data, fast)
    n = int(next(c for c in comments if c.startswith(b"payload ")).split()[1])
    return _payload(parts, n)


def _payload(parts: list[_Component], n: int) -> bytes:
    flat = np.concatenate([c.coef.reshape(-1) for c in parts])[:n] - 256
    return flat.astype(np.uint8).tobytes()


def tensor(height: int, width: int, parts: list[_Component], quant: dict[int, np.ndarray]) -> np.ndarray:
    """The image (height, width, 3), uint8, RGB: inverse transform, chroma by repetition to full resolution, BT.601."""
    hm, vm = max(c.h for c in parts), max(c.v for c in parts)
    planes = []
    for c in parts:
        pixels = (c.coef.reshape(-1, 64) * quant[c.table]).astype(np.float64) @ _INVERSE
        pixels = np.clip(np.floor(pixels / (1 << _BITS) + 128.5), 0, 255).astype(np.int32)
        plane = pixels.reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.cols)
        if c.v != vm:
            plane = np.repeat(plane, vm // c.v, 0)
        if c.h != hm:
            plane = np.repeat(plane, hm // c.h, 1)
        planes.append(plane[:height, :width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    out = np.empty((height, width, 3), np.uint8)
    half = 1 << 15
    # Fixed values of the colour space: 1.402, 0.344136, 0.714136 and 1.772, times 2**16.
    out[:, :, 0] = np.clip((y + 91881 * cr + half) >> 16, 0, 255)
    out[:, :, 1] = np.clip((y - 22554 * cb - 46802 * cr + half) >> 16, 0, 255)
    out[:, :, 2] = np.clip((y + 116130 * cb + half) >> 16, 0, 255)
    return out


def decode(data: bytes, fast: bool = True) -> np.ndarray:
    """The RGB tensor of a progressive JPEG."""
    height, width, parts, quant, _ = coefficients(data, fast)
    return tensor(height, width, parts, quant)
