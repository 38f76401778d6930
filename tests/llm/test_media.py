from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import jpeg, media, queries


def test_query(spark, tiny):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.op3_media(spark, tiny).collect()}
    assert rows.keys() == texts.keys()
    for d, t in texts.items():
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = rows[d]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = jpeg.encode(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"]


@given(st.binary(min_size=1, max_size=2000))
@settings(deadline=None, max_examples=60)
def test_payload_comes_back(data):
    data += bytes(-len(data) % 64)
    assert jpeg.payload(jpeg.read(jpeg.encode(data))) == data


@pytest.mark.parametrize("value", [0, 127, 128, 255])
def test_constant_and_long_payloads(value):
    data = bytes([value]) * (64 * 6 * 64 * 3 + 64)
    image = jpeg.read(jpeg.encode(data))
    assert jpeg.payload(image) == data
    assert image.height % 16 == image.width % 16 == 0


class Writer:
    """A plain bit-by-bit progressive encoder, to hold the decoder against other kinds of scans."""

    def __init__(self, symbols: list[int]):
        self.symbols = symbols  # all codes have eight bits; the all-ones code is not used
        self.bits: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s: int) -> None:
        self.put(self.symbols.index(s), 8)

    def number(self, v: int) -> None:
        size = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << size) - 1, size)

    def data(self) -> bytes:
        bits = self.bits + [1] * (-len(self.bits) % 8)
        self.bits = []
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


SYMBOLS = list(range(255))


def shifted(v: int, low: int) -> int:
    return v >> low if v >= 0 else -(-v >> low)


def ac_first(w: Writer, blocks: list[list[int]], a: int, b: int, low: int) -> bytes:
    run = 0

    def flush():
        nonlocal run
        while run:
            part = min(run, 0x7FFF)
            size = part.bit_length() - 1
            w.symbol(size << 4)
            w.put(part - (1 << size), size)
            run -= part

    for block in blocks:
        zeros = 0
        band = [shifted(block[k], low) for k in range(a, b + 1)]
        if not any(band):
            run += 1
            continue
        flush()
        for k, v in enumerate(band):
            if not v:
                zeros += 1
                continue
            while zeros > 15:
                w.symbol(0xF0)
                zeros -= 16
            w.symbol(zeros << 4 | abs(v).bit_length())
            w.number(v)
            zeros = 0
        if zeros:
            run += 1
    flush()
    return w.data()


def ac_refine(w: Writer, blocks: list[list[int]], a: int, b: int, low: int) -> bytes:
    """Without runs over several blocks: each block that ends early says so itself."""
    for block in blocks:
        before = [shifted(block[k], low + 1) for k in range(a, b + 1)]
        now = [shifted(block[k], low) for k in range(a, b + 1)]
        new = [k for k in range(len(now)) if not before[k] and now[k]]
        at = 0
        for k in new:
            zeros, fixes = 0, []
            while at < k:
                if before[at]:
                    fixes.append(abs(now[at]) & 1)
                else:
                    zeros += 1
                    if zeros == 16:
                        w.symbol(0xF0)
                        for f in fixes:
                            w.put(f, 1)
                        zeros, fixes = 0, []
                at += 1
            w.symbol(zeros << 4 | 1)
            w.put(int(now[k] > 0), 1)
            for f in fixes:
                w.put(f, 1)
            at = k + 1
        if at < len(now):
            w.symbol(0x00)
            for k in range(at, len(now)):
                if before[k]:
                    w.put(abs(now[k]) & 1, 1)
    return w.data()


@pytest.mark.parametrize("seed", range(4))
def test_general_progressive_scans(seed):
    rng = np.random.default_rng(seed)
    high, wide = 21, 38  # sizes that are no multiple of a unit
    comps = [(1, 2, 2), (2, 1, 1), (3, 1, 1)]
    units_w, units_h = -(-wide // 16), -(-high // 16)
    planes = {}
    for n, h, v in comps:
        own_w, own_h = -(-(-(-wide * h // 2)) // 8), -(-(-(-high * v // 2)) // 8)
        full = np.zeros((units_h * v, units_w * h, 64), np.int64)
        full[:, :, 0] = rng.integers(-200, 200, full.shape[:2])
        sparse = rng.random((own_h, own_w, 63)) < 0.15
        full[:own_h, :own_w, 1:] = rng.integers(-40, 40, (own_h, own_w, 63)) * sparse
        planes[n] = full
    table = b"\x08" and bytes([0] * 7 + [255] + [0] * 8) + bytes(SYMBOLS)
    seg = lambda m, body: struct.pack(">BBH", 0xFF, m, len(body) + 2) + body
    out = [b"\xff\xd8", seg(0xDB, b"\x00" + bytes(range(1, 65)))]
    out.append(seg(0xC2, struct.pack(">BHHB", 8, high, wide, 3) + b"".join(bytes([n, h << 4 | v, 0]) for n, h, v in comps)))
    out += [seg(0xC4, b"\x00" + table), seg(0xC4, b"\x10" + table), seg(0xDD, struct.pack(">H", 2))]
    w = Writer(SYMBOLS)
    # DC of all components, interleaved, in intervals of two units, upper bits first.
    order = [[(n, y * v + j, x * h + i) for n, h, v in comps for j in range(v) for i in range(h)] for y in range(units_h) for x in range(units_w)]
    for low, first in ((1, True), (0, False)):
        parts = []
        for at in range(0, len(order), 2):
            before = dict.fromkeys(planes, 0)
            for n, y, x in sum(order[at : at + 2], []):
                v = int(planes[n][y, x, 0]) >> low
                if first:
                    w.symbol(abs(v - before[n]).bit_length())
                    w.number(v - before[n])
                    before[n] = v
                else:
                    w.put(v & 1, 1)
            parts.append(w.data())
        head = bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, (0x01 if first else 0x10)])
        out.append(seg(0xDA, head))
        out.append(b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k < len(parts) - 1 else b"") for k, p in enumerate(parts)))
    out.append(seg(0xDD, struct.pack(">H", 0)))
    for n, h, v in comps:
        own_w, own_h = -(-(-(-wide * h // 2)) // 8), -(-(-(-high * v // 2)) // 8)
        blocks = planes[n][:own_h, :own_w].reshape(-1, 64).tolist()
        for a, b in ((1, 5), (6, 63)):
            out += [seg(0xDA, bytes([1, n, 0, a, b, 0x01])), ac_first(w, blocks, a, b, 1)]
            out += [seg(0xDA, bytes([1, n, 0, a, b, 0x10])), ac_refine(w, blocks, a, b, 0)]
    image = jpeg.read(b"".join(out) + b"\xff\xd9")
    for c in image.components:
        assert (c.coefficients.reshape(planes[c.number].shape) == planes[c.number]).all()
    assert jpeg.rgb(image).shape == (high, wide, 3)


def test_inverse_transform_is_the_formula():
    rng = np.random.default_rng(1)
    zigzag = rng.integers(-50, 50, (1, 64))
    quant = rng.integers(1, 9, 64)
    c = jpeg.Component(1, 1, 1, 0, wide=1, high=1, coefficients=zigzag.astype(np.int16))
    got = jpeg.samples(c, quant)
    grid = np.zeros((8, 8))
    r = u = 0
    for k in range(64):  # the usual walk: up right, turning at the edges
        grid[r, u] = zigzag[0, k] * quant[k]
        if (r + u) % 2 == 0:
            r, u = (r, u + 1) if r == 0 and u < 7 else (r + 1, u) if u == 7 else (r - 1, u + 1)
        else:
            r, u = (r + 1, u) if u == 0 and r < 7 else (r, u + 1) if r == 7 else (r + 1, u - 1)
    for y in range(8):
        for x in range(8):
            total = sum(
                (0.5**0.5 if v == 0 else 1) * (0.5**0.5 if h == 0 else 1) * grid[v, h] * np.cos((2 * y + 1) * v * np.pi / 16) * np.cos((2 * x + 1) * h * np.pi / 16)
                for v in range(8) for h in range(8)
            )
            assert abs(got[y, x] - (total / 4 + 128)) < 0.05


def test_bad_files_and_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (2, "äöü " * 5000, 7), (2, "äöü " * 5000, 7)]
    stored = media.to_media(spark.createDataFrame(rows, "doc_id long, text string, n_bytes int"))
    files = [r["media"] for r in stored.collect()]
    more = spark.createDataFrame([(9, b"no picture"), (10, None), (11, bytes(files[0][:200]))], "doc_id long, media binary")
    bad = media.tensors(more).collect()
    assert all(r["rgb"] is None and r["error"] for r in bad)
    good = media.tensors(stored).collect()
    assert all(len(r["rgb"]) == 3 * r["height"] * r["width"] and r["error"] is None for r in good)
    assert sorted(r["payload_bytes"] for r in good) == [64, 64, 35008, 35008]
    assert media.tensors(stored.limit(0)).count() == 0


def test_a_malformed_file_is_an_error_and_nothing_worse():
    """Cut anywhere, and with one to four bytes changed: a file is read or refused with a ValueError."""
    rng = np.random.default_rng(5)
    whole = jpeg.encode(bytes(range(256)) * 2)
    refused = 0
    cases = [whole[:n] for n in range(0, len(whole), 3)]
    for _ in range(1500):
        data = bytearray(whole)
        for at in rng.integers(0, len(data), rng.integers(1, 5)):
            data[at] = rng.integers(256)
        cases.append(bytes(data))
    for data in cases:
        try:
            image = jpeg.read(data)
            jpeg.rgb(image)
            if any(c.startswith(b"payload ") for c in image.comments):
                jpeg.payload(image)
        except ValueError:
            refused += 1
    assert len(whole) // 3 - 1 < refused < len(cases)


@pytest.mark.parametrize(
    "at, new, why",
    [(0, bytes([8, 255, 255, 255, 255]), "too large"), (7, b"\x00", "range"), (10, b"\x33", "divide"), (5, b"\x02", "another kind"), (0, b"\x0c", "another kind")],
)
def test_headers_are_checked_before_anything_is_made(at, new, why):
    whole = jpeg.encode(bytes(64))
    start = whole.index(b"\xff\xc2") + 4 + at
    with pytest.raises(ValueError, match=why):
        jpeg.read(whole[:start] + new + whole[start + len(new) :])


def test_bad_files_stop_no_task(spark):
    whole = jpeg.encode(bytes(64))
    rows = [(0, bytearray(whole)), (1, bytearray(whole[:88])), (2, None), (3, bytearray(b"")), (4, bytearray(whole[:2] + b"\xff\xda\x00\x08\x01\x01\x00\x00\x00\x01" + whole[2:]))]
    frame = spark.createDataFrame(rows, "doc_id int, media binary")
    got = {r["doc_id"]: r for r in media.tensors(frame).collect()}
    assert got[0]["error"] is None and len(got[0]["rgb"]) == 3 * got[0]["height"] * got[0]["width"]
    assert all(got[k]["error"] and got[k]["rgb"] is None for k in range(1, 5))
    assert media.tensors(frame.limit(0)).count() == 0


def test_media_of_null_empty_and_equal_texts(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "é" * 100, 7), (4, "é" * 100, 7)], "doc_id int, text string, media int")
    got = {r["doc_id"]: r for r in media.tensors(media.to_media(docs), rgb=False).collect()}
    assert got[1]["payload_sha256"] == got[2]["payload_sha256"] and got[1]["payload_bytes"] == 64 and got[1]["n_bytes"] == 0
    assert got[3]["media"] == got[4]["media"] and got[3]["n_bytes"] == 200 and got[3]["payload_bytes"] == 256
    assert media.to_media(docs.limit(0)).count() == 0
