"""The PNG decoder on files made here, chunk by chunk."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import png


def make(width, height, depth, colour, rows, extra=(), interlace=0, split=False):
    body = zlib.compress(rows)
    parts = [body[: len(body) // 2], body[len(body) // 2 :]] if split else [body]
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlace)
    return png.SIGNATURE + png.chunk(b"IHDR", head) + b"".join(png.chunk(*x) for x in extra) + b"".join(png.chunk(b"IDAT", p) for p in parts) + png.chunk(b"IEND", b"")


def pixels(*args, **more):
    return png.decode(make(*args, **more)).reshape(-1, 4).tolist()


def test_colour_types():
    assert pixels(2, 1, 8, 0, b"\0\x10\xff") == [[16, 16, 16, 255], [255, 255, 255, 255]]
    assert pixels(2, 1, 16, 0, b"\0\x12\x34\xff\x00") == [[0x12] * 3 + [255], [255, 255, 255, 255]]
    assert pixels(2, 1, 1, 0, b"\0\x40") == [[0, 0, 0, 255], [255, 255, 255, 255]]
    assert pixels(2, 1, 2, 0, b"\0\x60") == [[85, 85, 85, 255], [170, 170, 170, 255]]
    assert pixels(2, 1, 4, 0, b"\0\x1f") == [[17, 17, 17, 255], [255, 255, 255, 255]]
    assert pixels(1, 1, 8, 4, b"\0\x10\x20") == [[16, 16, 16, 32]]
    assert pixels(1, 1, 16, 4, b"\0\x10\x00\x20\x00") == [[16, 16, 16, 32]]
    assert pixels(1, 1, 8, 2, b"\0\x01\x02\x03") == [[1, 2, 3, 255]]
    assert pixels(1, 1, 16, 2, b"\0\x01\0\x02\0\x03\0") == [[1, 2, 3, 255]]
    assert pixels(1, 1, 8, 6, b"\0\x01\x02\x03\x04") == [[1, 2, 3, 4]]
    assert pixels(1, 1, 16, 6, b"\0\x01\0\x02\0\x03\0\x04\0") == [[1, 2, 3, 4]]


@pytest.mark.parametrize("depth,row", [(1, b"\0\x40"), (2, b"\0\x10"), (4, b"\0\x01"), (8, b"\0\0\x01")])
def test_palette(depth, row):
    extra = [(b"PLTE", bytes([1, 2, 3, 4, 5, 6])), (b"tRNS", b"\x07")]
    assert pixels(2, 1, depth, 3, row, extra=extra) == [[1, 2, 3, 7], [4, 5, 6, 255]]


def test_palette_out_of_range_and_colour_keys():
    assert pixels(1, 1, 8, 3, b"\0\x09", extra=[(b"PLTE", bytes(3))]) == [[0, 0, 0, 255]]
    assert pixels(2, 1, 8, 0, b"\0\x05\x06", extra=[(b"tRNS", b"\0\x05")]) == [[5, 5, 5, 0], [6, 6, 6, 255]]
    assert pixels(2, 1, 16, 0, b"\0\x05\x01\x05\x02", extra=[(b"tRNS", b"\x05\x01")]) == [[5, 5, 5, 0], [5, 5, 5, 255]]
    assert pixels(1, 1, 8, 2, b"\0\x01\x02\x03", extra=[(b"tRNS", b"\0\x01\0\x02\0\x03")]) == [[1, 2, 3, 0]]


def filtered(image, kinds):
    """Applies filters by their definition."""
    h, w, _ = image.shape
    raw, out = image.reshape(h, -1).astype(int), b""
    for y in range(h):
        line = []
        for x in range(w * 4):
            a = raw[y, x - 4] if x >= 4 else 0
            b = raw[y - 1, x] if y else 0
            c = raw[y - 1, x - 4] if y and x >= 4 else 0
            paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((raw[y, x] - [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256)
        out += bytes([kinds[y], *line])
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.lists(st.integers(0, 4), min_size=5, max_size=5), st.booleans())
def test_filters(seed, kinds, split):
    image = np.random.default_rng(seed).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    assert (png.decode(make(7, 5, 8, 6, filtered(image, kinds), split=split)) == image).all()
    assert (png.decode(png.encode(image)) == image).all()


@pytest.mark.parametrize("size", [(1, 1), (3, 2), (8, 8), (9, 13)])
def test_interlaced(size):
    w, h = size
    image = np.random.default_rng(1).integers(0, 256, (h, w, 4)).astype(np.uint8)
    rows = b"".join(b"\0" + line.tobytes() for x, y, dx, dy in png.PASSES for line in image[y::dy, x::dx] if line.size)
    assert (png.decode(make(w, h, 8, 6, rows, interlace=1)) == image).all()


def code(data):
    with pytest.raises(png.PngError) as e:
        png.decode(data)
    return e.value.code


def test_errors():
    good = make(2, 1, 8, 0, b"\0\x10\xff")
    assert code(b"") == 48 and code(good[:20]) == 27 and code(b"x" * 40) == 28
    assert code(good[:12] + b"XXXX" + good[16:]) == 29
    assert code(good[:29] + b"0000" + good[33:]) == 57
    assert code(make(2, 1, 4, 2, b"")) == 37 and code(make(2, 1, 8, 5, b"")) == 31
    assert code(make(2, 1, 8, 0, b"\x07\x10\xff")) == 36
    assert code(make(2, 1, 8, 0, b"\0")) == 23
    assert code(make(2, 1, 8, 0, b"\0\0\0", interlace=2)) == 34
    assert code(make(2, 1, 8, 0, b"\0\0\0", extra=[(b"ABCD", b"")])) == 69
    assert code(make(2, 1, 8, 6, b"\0" * 9, extra=[(b"tRNS", b"")])) == 42
    assert code(good[:-12]) == 30
    bad = zlib.compress(b"\0\x10\xff")[:-1] + b"\0"
    head = struct.pack(">IIBBBBB", 2, 1, 8, 0, 0, 0, 0)
    assert code(png.SIGNATURE + png.chunk(b"IHDR", head) + png.chunk(b"IDAT", bad) + png.chunk(b"IEND", b"")) == 58
    assert pixels(2, 1, 8, 0, b"\0\x10\xff", extra=[(b"abCd", b"x"), (b"tEXt", b"k\0v")])


@pytest.mark.parametrize(("kind", "body", "code"), [
    (b"bKGD", b"1", 45), (b"tIME", b"123456", 73), (b"pHYs", b"12345678", 74), (b"tEXt", b"", 89), (b"tEXt", b"k" * 80 + b"\0x", 89),
    (b"zTXt", b"key\0", 75), (b"zTXt", b"key\0\1" + zlib.compress(b"x"), 72), (b"zTXt", b"key\0\0" + zlib.compress(b"x")[:-1] + b"!", 58), (b"iTXt", b"k\0\0", 30), (b"iTXt", b"key\0\0\0", 75), (b"iTXt", b"\0\0\0\0\0\0", 89),
])
def test_ancillary_chunks_can_fail(kind, body, code):
    image = np.zeros((2, 2, 4), np.uint8)
    with pytest.raises(png.PngError) as e:
        png.decode(png.encode_as(image, 6, 8, chunks=((kind, body),)))
    assert e.value.code == code
    good = ((b"bKGD", b"123456"), (b"tIME", b"1234567"), (b"pHYs", b"123456789"), (b"tEXt", b"key\0text"), (b"zTXt", b"key\0\0" + zlib.compress(b"x")), (b"iTXt", b"key\0\1\0en\0\0" + zlib.compress(b"x")))
    assert (png.decode(png.encode_as(image, 6, 8, chunks=good)) == image).all()


@pytest.mark.parametrize(("stream", "code"), [(b"\x07", 20), (b"\x01\x01\0\0\0x", 21), (b"\x01", 52), (b"", 52)])
def test_inflate_errors(stream, code):
    with pytest.raises(png.PngError) as e:
        png._inflate(b"\x78\x01" + stream)
    assert e.value.code == code


def test_full_tiles_with_neighbour_filters_are_fast():
    import time

    image = np.random.default_rng(1).integers(0, 256, (256, 256, 4)).astype(np.uint8)
    for kind in (3, 4):
        file = png.encode_as(image, 6, 8, kind=kind)
        began = time.perf_counter()
        assert (png.decode(file) == image).all()
        assert time.perf_counter() - began < 0.5
