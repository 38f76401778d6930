"""Progressive JPEG in numpy: coefficients to scans, scans to coefficients, coefficients to RGB.

The decoder reads progressive files with Huffman coding, any spectral selection and successive
approximation, restart intervals, and one or three components whose sampling factors divide the
largest. Whatever else it is given, it says so in a ValueError. Every
scan adds its part to the components' coefficient arrays; then all blocks are transformed back at
once, chroma is brought to full resolution, and the colours are converted.

The encoder writes 4:2:0 files whose coefficients hold a payload, one byte in each. A byte b from
128 on is the coefficient b, others are b - 255; the DC coefficients are b as it is. So all AC
coefficients have 8 bits of magnitude and are never zero, the first AC scan sends their upper 7
bits and the refinement scan the last, and what the encoder has put in comes back exactly.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
#: From zigzag coefficients of a block to its 64 samples.
_INVERSE = np.einsum("ux,vy->uvxy", _COS, _COS).reshape(64, 64)[_ZIGZAG].astype(np.float32)
_MAX_RUN = 0x7FFF
#: Pixels of a file, at most: what a header asks for is bound before it is made.
MOST_PIXELS = 1 << 26


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols_of_length: dict[int, list[int]]) -> bytes:
    counts = bytes(len(symbols_of_length.get(n, [])) for n in range(1, 17))
    return _segment(0xC4, bytes([kind]) + counts + b"".join(bytes(symbols_of_length.get(n, [])) for n in range(1, 17)))


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits to bytes, the last filled with ones, a zero after each 0xFF."""
    bits = np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _run_symbols(n: int) -> list[tuple[int, int]]:
    """(symbol, extra bits' value) of end-of-band runs that cover n blocks."""
    out = []
    while n:
        part = min(n, _MAX_RUN)
        size = part.bit_length() - 1
        out.append((size << 4, part - (1 << size)))
        n -= part
    return out


def _bits_of(value: int, width: int) -> np.ndarray:
    return np.array([value >> i & 1 for i in range(width - 1, -1, -1)], np.uint8)


_SIZE_OF = np.array([i.bit_length() for i in range(2048)])


def _dc_first(values: np.ndarray) -> np.ndarray:
    """Differences: the size as a code of 4 bits, then so many bits."""
    d = np.diff(values, prepend=0)
    size = _SIZE_OF[np.abs(d)]
    word = size << size | np.where(d > 0, d, d + (1 << size) - 1)
    wide = 4 + int(size.max(initial=0))
    place = np.arange(wide - 1, -1, -1)
    return (word[:, None] >> place & 1).astype(np.uint8)[place < 4 + size[:, None]]


#: DC sizes 0 to 11 in 4 bits each; the only AC symbol of the first scan in 1 bit; end-of-band runs in 4.
_DC_TABLE = {4: list(range(12))}
_AC_TABLE = {1: [0x07]}
_RUN_TABLE = {4: [n << 4 for n in range(15)]}


def geometry(n_blocks: int) -> tuple[int, int]:
    """Columns and rows of 16 x 16 pixel units that hold so many blocks, six in each."""
    units = max(1, -(-n_blocks // 6))
    rows = -(-units // 64)
    return -(-units // rows), rows


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that holds ``payload``, a positive multiple of 64 bytes, in its coefficients."""
    if not payload or len(payload) % 64:
        raise ValueError("a positive multiple of 64 bytes is needed")
    cols, rows = geometry(len(payload) // 64)
    n = cols * rows
    data = np.zeros((6 * n, 64), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    planes = [data[: 4 * n], data[4 * n : 5 * n], data[5 * n :]]  # row by row, as non-interleaved scans go
    out = [
        b"\xff\xd8",
        _segment(0xFE, b"payload %d" % len(payload)),
        _segment(0xDB, bytes([0]) + b"\x01" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 16 * cols, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _table(0x00, _DC_TABLE),
        _table(0x10, _AC_TABLE),
        _table(0x11, _RUN_TABLE),
    ]
    for c, plane in enumerate(planes):
        dc = plane[:, 0].astype(np.int64)
        first = _dc_first(dc >> 1)
        out += [_scan(c, 0, 0, 0, 1), _stuffed(first), _scan(c, 0, 0, 1, 0), _stuffed((dc & 1).astype(np.uint8))]
        ac = plane[:, 1:]
        # The code is one 0 bit and the 7 bits after it are the upper ones of the byte: just the byte, shifted.
        out += [_scan(c, 1, 63, 0, 1), (ac >> 1).tobytes(), _scan(c, 1, 63, 1, 0, table=1)]
        last = ((ac & 1) ^ (ac < 128)).reshape(-1)
        bits, at = [], 0
        for symbol, extra in _run_symbols(len(plane)):
            size = symbol >> 4
            blocks = (1 << size) + extra
            bits += [_bits_of(size, 4), _bits_of(extra, size), last[63 * at : 63 * (at + blocks)]]
            at += blocks
        out.append(_stuffed(np.concatenate(bits)))
    return b"".join(out) + b"\xff\xd9"


def _scan(component: int, first: int, last: int, high: int, low: int, table: int = 0) -> bytes:
    return _segment(0xDA, bytes([1, component + 1, table, first, last, high << 4 | low]))


# ---------------------------------------------------------------- reading


@dataclass
class Component:
    number: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks in a row, and rows, as stored
    high: int = 0
    own_wide: int = 0  # those that a scan of this component alone goes through
    own_high: int = 0
    coefficients: np.ndarray | None = None  # blocks x 64, in zigzag order


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    comments: list[bytes]


class _Bits:
    """The bits of one entropy-coded interval, with the Huffman lookups."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
        self.bits = np.unpackbits(raw)
        self.raw = raw.tobytes() + b"\xff" * 8
        self.at = 0

    def peek16(self) -> int:
        byte, shift = divmod(self.at, 8)
        return int.from_bytes(self.raw[byte : byte + 3], "big") >> (8 - shift) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        byte, shift = divmod(self.at, 8)
        self.at += n
        if self.at > 8 * len(self.raw):
            raise ValueError("a scan ends early")
        return int.from_bytes(self.raw[byte : byte + 4], "big") >> (32 - shift - n) & ((1 << n) - 1)

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        code = self.peek16()
        self.at += table[0][code]
        if not table[0][code] or self.at > 8 * len(self.raw):
            raise ValueError("no such code")
        return table[1][code]

    def many(self, n: int) -> np.ndarray:
        out = self.bits[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("a scan ends early")
        self.at += n
        return out


_LOOKUPS: dict[bytes, tuple[list[int], list[int]]] = {}


def _lookup(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """For each 16 bits ahead: the code's length and its symbol."""
    if (key := counts + symbols) not in _LOOKUPS:
        lengths, values, at, k = np.zeros(65536, np.int64), np.zeros(65536, np.int64), 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                lengths[at : at + (1 << 16 - n)], values[at : at + (1 << 16 - n)] = n, symbols[k]
                at, k = at + (1 << 16 - n), k + 1
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        _LOOKUPS[key] = lengths.tolist(), values.tolist()
    return _LOOKUPS[key]


def _signed(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _ac_first(bits: _Bits, blocks: np.ndarray, first: int, last: int, low: int, table) -> None:
    """First pass over a band of a component's blocks."""
    n, width, at, k, run = len(blocks), last - first + 1, 0, 0, 0
    while at < n:
        if k == 0:
            # A stretch of whole blocks in which every coefficient has the same code and size is read at once.
            length, symbol = table[0][code := bits.peek16()], table[1][code]
            size = symbol & 15
            if length and symbol >> 4 == 0 and size:
                step = length + size
                ahead = bits.bits[bits.at :]
                cells = ahead[: min(len(ahead) // step, (n - at) * width) * step].reshape(-1, step)
                same = (cells[:, :length] == cells[0, :length]).all(1) if len(cells) else np.zeros(0, bool)
                good = len(same) if same.all() else int(np.argmin(same))
                if whole := good // width:
                    shown = cells[: whole * width, length:]
                    value = np.packbits(shown, axis=1).astype(np.int32)
                    value = value[:, 0] >> (8 - size) if size <= 8 else (value[:, 0] << 8 | value[:, 1]) >> (16 - size)
                    value = np.where(shown[:, 0], value, value - (1 << size) + 1)
                    blocks[at : at + whole, first : last + 1] = value.reshape(whole, width) * (1 << low)
                    bits.at += whole * width * step
                    at += whole
                    continue
        symbol = bits.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if size:
            k += zeros
            if k >= width:
                raise ValueError("a run leaves its band")
            blocks[at, first + k] = _signed(bits.take(size), size) * (1 << low)
            k += 1
        elif zeros == 15:
            k += 16
        else:
            run = (1 << zeros) + bits.take(zeros)
            at, k = at + run, 0
        if k >= width:
            at, k = at + 1, 0


def _correct(bits: _Bits, part: np.ndarray, low: int) -> None:
    """One more bit for each coefficient of ``part`` (blocks x band) that is not zero yet."""
    there = part != 0
    by = bits.many(int(there.sum())).astype(np.int16) << low
    now = part[there]
    part[there] = now + np.where(now > 0, by, -by)


def _ac_refine(bits: _Bits, blocks: np.ndarray, first: int, last: int, low: int, table) -> None:
    at, n = 0, len(blocks)
    band = blocks[:, first : last + 1]
    while at < n:
        k = 0
        while k <= last - first:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            if not size and zeros < 15:  # the rest of this block and whole ones after it only get corrections
                run = (1 << zeros) + bits.take(zeros)
                _correct(bits, band[at : at + 1, k:], low)
                end = min(n, at + run)
                _correct(bits, band[at + 1 : end], low)
                at = end - 1
                break
            new = 0
            if size:
                new = (1 << low) if bits.take(1) else -(1 << low)
            row = band[at]
            start = k
            while k <= last - first:
                if row[k] == 0:
                    if zeros == 0:
                        break
                    zeros -= 1
                k += 1
            _correct(bits, band[at : at + 1, start:k], low)
            if new and k <= last - first:
                row[k] = new
            k += 1
        at += 1


def _order(c: Component, alone: bool, units_wide: int, units_high: int) -> np.ndarray | None:
    """Places of the blocks of a scan in the component's array; None if they are all, in order."""
    if alone:
        if (c.own_wide, c.own_high) == (c.wide, c.high):
            return None
        return (np.arange(c.own_high)[:, None] * c.wide + np.arange(c.own_wide)).ravel()
    grid = np.arange(c.wide * c.high).reshape(units_high, c.v, units_wide, c.h)
    return grid.transpose(0, 2, 1, 3).reshape(-1)


def _read_scan(image: Image, body: bytes, data: list[bytes], tables: dict, restart: int) -> None:
    n = body[0]
    if len(body) != 4 + 2 * n:
        raise ValueError("a scan header of another length")
    parts = [(next(c for c in image.components if c.number == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
    first, last, approx = body[1 + 2 * n : 4 + 2 * n]
    high, low = approx >> 4, approx & 15
    if not (first <= last < 64 and low < 14 and (first == 0) == (last == 0) and (first == 0 or n == 1) and high in (0, low + 1)):
        raise ValueError("no progressive scan")
    h = max(c.h for c in image.components)
    v = max(c.v for c in image.components)
    wide, tall = -(-image.width // (8 * h)), -(-image.height // (8 * v))
    orders = [_order(c, n == 1, wide, tall) for c, _ in parts]
    per_unit = [1 if n == 1 else c.h * c.v for c, _ in parts]
    units = (len(orders[0]) if orders[0] is not None else len(parts[0][0].coefficients)) // per_unit[0]
    step = restart or units
    places = lambda order, m: slice(begin * m, end * m) if order is None else order[begin * m : end * m]
    for k, interval in enumerate(data):
        bits, begin, end = _Bits(interval), k * step, min(units, (k + 1) * step)
        if first == 0:
            if high:  # one bit for each block, in order
                got = bits.many((end - begin) * sum(per_unit)).reshape(end - begin, -1).astype(np.int16) << low
                at = 0
                for (c, _), order, m in zip(parts, orders, per_unit):
                    c.coefficients[places(order, m), 0] += got[:, at : at + m].ravel()
                    at += m
                continue
            before, found = [0] * n, [[] for _ in parts]
            for _ in range(begin, end):
                for i, (_, t) in enumerate(parts):
                    table = tables[t >> 4]
                    for _ in range(per_unit[i]):
                        size = bits.symbol(table)
                        before[i] += _signed(bits.take(size), size)
                        found[i].append(before[i])
            for (c, _), order, m, values in zip(parts, orders, per_unit, found):
                c.coefficients[places(order, m), 0] = np.array(values, np.int16) << low
            continue
        c, t = parts[0]
        blocks = c.coefficients[places(orders[0], 1)]
        (_ac_refine if high else _ac_first)(bits, blocks, first, last, low, tables[16 + (t & 15)])
        if orders[0] is not None:
            c.coefficients[places(orders[0], 1)] = blocks


def _frame(body: bytes, size: int) -> Image:
    """The image that a frame header describes, still empty; ``size`` is that of the whole file."""
    depth, high, wide, n = struct.unpack(">BHHB", body[:6])
    if depth != 8 or not high or not wide or n not in (1, 3) or len(body) != 6 + 3 * n:
        raise ValueError("a frame of another kind")
    parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    if any(not 1 <= x <= 4 for c in parts for x in (c.h, c.v)):
        raise ValueError("sampling factors out of range")
    h, v = max(c.h for c in parts), max(c.v for c in parts)
    if any(h % c.h or v % c.v for c in parts):
        raise ValueError("sampling factors that do not divide the largest")
    for c in parts:
        c.wide, c.high = -(-wide // (8 * h)) * c.h, -(-high // (8 * v)) * c.v
        c.own_wide, c.own_high = -(-(-(-wide * c.h // h)) // 8), -(-(-(-high * c.v // v)) // 8)
    # Each block takes a bit of the first scan at least, so a small file cannot hold a large image.
    if wide * high > MOST_PIXELS or sum(c.wide * c.high for c in parts) > 8 * size:
        raise ValueError("a frame too large for its file")
    for c in parts:
        c.coefficients = np.zeros((c.wide * c.high, 64), np.int16)
    return Image(wide, high, parts, {}, [])


def read(media: bytes) -> Image:
    """Parse a progressive file and accumulate its scans; a ValueError says what a file lacks."""
    try:
        return _read(media)
    except (struct.error, IndexError, KeyError, StopIteration, OverflowError, FloatingPointError) as e:
        raise ValueError(f"malformed file: {type(e).__name__} {e}".rstrip()) from e


def _read(media: bytes) -> Image:
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, image, quants, tables, restart, comments = 2, None, {}, {}, 0, []
    while at < len(media) and media[at + 1] != 0xD9:
        marker, length = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        if media[at] != 0xFF or length < 2 or at + 2 + length > len(media):
            raise ValueError("no segment where one should be")
        body, at = media[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xFE:
            comments.append(body)
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else "u1", 64, 1).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                m = sum(body[1:17])
                tables[body[0]] = _lookup(body[1:17], body[17 : 17 + m])
                body = body[17 + m :]
        elif marker == 0xC2:
            if image is not None:
                raise ValueError("a second frame")
            image = _frame(body, len(media))
            image.quants, image.comments = quants, comments
        elif marker in (0xC0, 0xC1):
            raise ValueError("not a progressive file")
        elif marker == 0xDA:
            if image is None:
                raise ValueError("a scan before the frame")
            end, data = at, []
            while True:
                end = media.index(b"\xff", end)
                if media[end + 1] == 0:
                    end += 2
                elif 0xD0 <= media[end + 1] <= 0xD7:
                    data.append(media[at:end])
                    at = end = end + 2
                else:
                    data.append(media[at:end])
                    break
            at = end
            _read_scan(image, body, data, tables, restart)
    if image is None:
        raise ValueError("no frame")
    if at >= len(media):
        raise ValueError("no end of the file")
    if any(c.quant not in quants for c in image.components):
        raise ValueError("a component without a table")
    return image


def payload(image: Image) -> bytes:
    """The bytes that ``encode`` has put into the coefficients."""
    note = next((c for c in image.comments if c.startswith(b"payload ")), None)
    if note is None:
        raise ValueError("no payload in the file")
    size = int(note[8:])
    values = np.concatenate([c.coefficients for c in image.components])
    values[:, 1:] += 255 * (values[:, 1:] < 0)
    return values.astype(np.uint8).tobytes()[:size]


def samples(c: Component, quant: np.ndarray) -> np.ndarray:
    """A component's plane of 8-bit samples, whole blocks."""
    blocks = (c.coefficients * quant).astype(np.float32) @ _INVERSE + 128
    return blocks.reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.high, 8 * c.wide)


def rgb(image: Image) -> np.ndarray:
    """height x width x 3 of 8-bit samples, chroma brought to full resolution."""
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    full = []
    for c in image.components:
        plane = np.clip(samples(c, image.quants[c.quant]), 0, 255)
        plane = np.repeat(np.repeat(plane, v // c.v, 0), h // c.h, 1)
        full.append(plane[: image.height, : image.width])
    if len(full) == 1:
        return np.repeat(np.rint(full[0]).astype(np.uint8)[:, :, None], 3, 2)
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    return np.rint(np.clip(out, 0, 255, out=out), out=out).astype(np.uint8)
