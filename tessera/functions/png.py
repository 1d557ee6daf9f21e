"""PNG files to RGBA bytes and back, on zlib and numpy alone.

Every colour type and depth decodes to four 8-bit channels: grey below 8 bits is scaled to 0..255, 16-bit channels keep
their high byte, tRNS gives palette entries their alpha and makes a grey or RGB colour key transparent (compared at full
depth), and palette indices out of range are opaque black. Failures carry a number, with its text in ERRORS.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Numbers of the failures that callers know.
ERRORS = {
    18: "an invalid distance code in the compressed data",
    20: "an invalid block type in the compressed data",
    21: "a stored block's length and its complement differ",
    43: "bKGD of a palette image isn't 1 byte",
    44: "bKGD of a grey image isn't 2 bytes",
    45: "bKGD of an RGB image isn't 6 bytes",
    52: "the compressed data ends early",
    72: "a text chunk's compression method isn't 0",
    73: "tIME isn't 7 bytes",
    74: "pHYs isn't 9 bytes",
    75: "a text chunk without the end of its keyword",
    89: "a text chunk's keyword isn't 1 to 79 bytes",
    -1: "the image doesn't have the size of a tile",
    23: "the image data isn't valid",
    24: "the compressed data's check bits are wrong",
    25: "the compression method isn't 8 with a window of 32 KiB at most",
    26: "the compressed data asks for a dictionary",
    27: "the file is shorter than a PNG header",
    28: "the file doesn't begin with the PNG signature",
    29: "the first chunk isn't IHDR",
    30: "the file or a chunk ends early",
    31: "the colour type isn't allowed",
    32: "the compression method isn't 0",
    33: "the filter method isn't 0",
    34: "the interlace method isn't 0 or 1",
    36: "a row has an unknown filter type",
    37: "the bit depth isn't allowed for the colour type",
    38: "the palette is too large, or has fewer entries than tRNS",
    41: "tRNS of an RGB image isn't 6 bytes",
    42: "tRNS stands with a colour type that has alpha",
    48: "the file is empty",
    53: "the compressed data is too short",
    57: "a chunk's CRC is wrong",
    58: "the Adler checksum is wrong",
    63: "a chunk is longer than allowed",
    64: "a chunk goes beyond the end of the file",
    69: "an unknown critical chunk",
    93: "the image has no pixels",
}
#: Bit depths that each colour type allows, and its channels.
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column, first row, column step and row step of the interlaced passes.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class PngError(ValueError):
    def __init__(self, code: int) -> None:
        super().__init__(ERRORS.get(code, "unknown"))
        self.code = code


def _inflate(data: bytes) -> bytes:
    if len(data) < 2:
        raise PngError(53)
    if (data[0] * 256 + data[1]) % 31:
        raise PngError(24)
    if data[0] & 15 != 8 or data[0] >> 4 > 7:
        raise PngError(25)
    if data[1] & 32:
        raise PngError(26)
    inflater, out = zlib.decompressobj(-15), b""
    try:
        out = inflater.decompress(data[2:])
    except zlib.error as e:
        found = [code for text, code in (("invalid block type", 20), ("invalid stored block", 21), ("invalid distance code", 18)) if text in str(e)]
        raise PngError(found[0] if found else 23) from e
    if not inflater.eof:
        raise PngError(52)
    if int.from_bytes(data[-4:]) != zlib.adler32(out):
        raise PngError(58)
    return out


def _check_ancillary(kind: bytes, body: bytes, colour: int) -> None:
    """Chunks that never change a pixel can still make a file invalid."""
    n = len(body)
    if kind == b"bKGD":
        size, code = {3: (1, 43), 0: (2, 44), 4: (2, 44)}.get(colour, (6, 45))
        if n != size:
            raise PngError(code)
    elif kind in (b"tIME", b"pHYs"):
        if n != (7 if kind == b"tIME" else 9):
            raise PngError(73 if kind == b"tIME" else 74)
    else:
        end = body.find(b"\0")
        end = n if end < 0 else end
        marks = {b"tEXt": 0, b"zTXt": 2, b"iTXt": 3}[kind]  # bytes after the keyword: its end, flag and method
        if kind == b"iTXt" and n < 5:
            raise PngError(30)
        if marks and end + marks >= n:
            raise PngError(75)
        if not 1 <= end <= 79:
            raise PngError(89)
        if marks and body[end + marks - 1]:
            raise PngError(72)
        if kind == b"zTXt":
            _inflate(body[end + 2 :])
        elif kind == b"iTXt" and body[end + 1]:
            _inflate(b"".join(body[end + 3 :].split(b"\0", 2)[2:]))


def _along_diagonals(kinds: np.ndarray, raw: np.ndarray, step: int) -> np.ndarray:
    """Rows without their filters where a pixel needs its left neighbour: all pixels of a diagonal at once, as those they
    need stand on the two before."""
    height, stride = raw.shape
    width = -(-stride // step)
    padded = np.zeros((height, width * step), np.int16)
    padded[:, :stride] = raw
    pixels, out = padded.reshape(height, width, step), np.zeros((height + 1, width + 1, step), np.int16)
    kinds = kinds[:, None]
    for t in range(width + height - 1):
        y = np.arange(max(0, t - width + 1), min(height, t + 1))
        x, kind = t - y, kinds[y]
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        da, db, dc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        paeth = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        guess = np.where(kind == 4, paeth, np.where(kind == 3, (a + b) >> 1, np.where(kind == 2, b, np.where(kind == 1, a, 0))))
        out[y + 1, x + 1] = (pixels[y, x] + guess) & 255
    return out[1:, 1:].reshape(height, -1)[:, :stride].astype(np.uint8)


def _unfiltered(data: bytes, at: int, width: int, height: int, bits: int) -> tuple[np.ndarray, int]:
    """Rows of bytes without their filters."""
    stride, step = (width * bits + 7) // 8, max(1, bits // 8)
    if at + height * (stride + 1) > len(data):
        raise PngError(23)
    raw = np.frombuffer(data, np.uint8, height * (stride + 1), at).reshape(height, stride + 1)
    if (raw[:, 0] > 4).any():
        raise PngError(36)
    if (raw[:, 0] > 2).any():
        return _along_diagonals(raw[:, 0], raw[:, 1:], step), at + height * (stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, row = raw[y, 0], raw[y, 1:]
        if kind == 0:
            line = row
        elif kind == 2:
            line = row + above
        else:
            padded = np.zeros(-(-stride // step) * step, np.uint8)
            padded[:stride] = row
            line = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        out[y] = above = line
    return out, at + height * (stride + 1)


def _samples(rows: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """height x width x channels at full depth."""
    height = len(rows)
    if depth == 16:
        return rows.reshape(height, width, channels, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if depth == 8:
        return rows.reshape(height, width, channels).astype(np.uint16)
    bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)[:, :width]
    return (bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint16))[:, :, None].astype(np.uint16)


def decode(data: bytes) -> np.ndarray:
    """height x width x 4 bytes, or PngError."""
    if not data:
        raise PngError(48)
    if len(data) < 29:
        raise PngError(27)
    if data[:8] != SIGNATURE:
        raise PngError(28)
    if data[12:16] != b"IHDR":
        raise PngError(29)
    width, height, depth, colour, compression, filtering, interlace = struct.unpack_from(">IIBBBBB", data, 16)
    if len(data) < 33:
        raise PngError(27)
    if struct.unpack_from(">I", data, 29)[0] != zlib.crc32(data[12:29]):
        raise PngError(57)
    if not width or not height:
        raise PngError(93)
    for value, most, code in ((compression, 0, 32), (filtering, 0, 33), (interlace, 1, 34)):
        if value > most:
            raise PngError(code)
    if colour not in DEPTHS:
        raise PngError(31)
    if depth not in DEPTHS[colour]:
        raise PngError(37)
    palette, key, parts, at, unknown = None, None, [], 33, False
    while True:
        if at + 12 > len(data):
            raise PngError(30)
        n, kind = struct.unpack_from(">I4s", data, at)
        if n >= 1 << 31:
            raise PngError(63)
        if at + 12 + n > len(data):
            raise PngError(64)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IEND":
            break
        if kind == b"IDAT":
            parts.append(body)
        elif kind == b"PLTE":
            if n > 768:
                raise PngError(38)
            palette = np.full((n // 3, 4), 255, np.uint8)
            palette[:, :3] = np.frombuffer(body, np.uint8, n // 3 * 3).reshape(-1, 3)
        elif kind == b"tRNS":
            if colour == 3:
                if palette is None or n > len(palette):
                    raise PngError(38)
                palette[:n, 3] = np.frombuffer(body, np.uint8)
            elif colour in (0, 2):
                if n != 2 * CHANNELS[colour]:
                    raise PngError(30 if colour == 0 else 41)
                key = np.frombuffer(body, ">u2").astype(np.uint16)
            else:
                raise PngError(42)
        elif kind in (b"bKGD", b"tEXt", b"zTXt", b"iTXt", b"tIME", b"pHYs"):
            _check_ancillary(kind, body, colour)
        else:
            if not kind[0] & 32:
                raise PngError(69)
            unknown = True
        if not unknown and struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(data[at + 4 : at + 8 + n]):
            raise PngError(57)
        at += 12 + n
    raw, channels = _inflate(b"".join(parts)), CHANNELS[colour]
    bits = depth * channels
    if interlace:
        full, at = np.zeros((height, width, channels), np.uint16), 0
        for x, y, dx, dy in PASSES:
            w, h = max(0, -(-(width - x) // dx)), max(0, -(-(height - y) // dy))
            if w and h:
                rows, at = _unfiltered(raw, at, w, h, bits)
                full[y::dy, x::dx] = _samples(rows, w, depth, channels)
    else:
        full = _samples(_unfiltered(raw, 0, width, height, bits)[0], width, depth, channels)
    return _rgba(full, colour, depth, palette, key)


def _rgba(full: np.ndarray, colour: int, depth: int, palette: np.ndarray | None, key: np.ndarray | None) -> np.ndarray:
    out = np.full((*full.shape[:2], 4), 255, np.uint8)
    if colour == 3:
        table = np.zeros((256, 4), np.uint8)
        table[:, 3] = 255
        if palette is not None:
            table[: len(palette)] = palette
        return table[full[:, :, 0]]
    bright = full >> 8 if depth == 16 else full if depth == 8 else full * 255 // ((1 << depth) - 1)
    if colour in (0, 4):
        out[:, :, :3] = bright[:, :, :1]
    else:
        out[:, :, :3] = bright[:, :, :3]
    if colour in (4, 6):
        out[:, :, 3] = bright[:, :, -1]
    elif key is not None:
        out[(full == key).all(2), 3] = 0
    return out


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(rows: np.ndarray, kind: int, step: int) -> bytes:
    """Rows of bytes with a filter."""
    wide = rows.astype(np.int16)
    a, b, c = (np.zeros_like(wide) for _ in range(3))
    a[:, step:], b[1:], c[1:, step:] = wide[:, :-step], wide[:-1], wide[:-1, :-step]
    da, db, dc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    guess = (0 * a, a, b, (a + b) >> 1, np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c)))[kind]
    out = np.full((len(rows), rows.shape[1] + 1), kind, np.uint8)
    out[:, 1:] = (wide - guess) & 255
    return out.tobytes()


def encode_as(samples: np.ndarray, colour: int, depth: int, *, kind: int = 0, interlaced: bool = False, chunks: tuple = (), level: int = 6) -> bytes:
    """height x width x channels at full depth as a file of the colour type and depth, all rows with one filter."""
    height, width, channels = samples.shape
    step = max(1, depth * channels // 8)

    def rows(part: np.ndarray) -> bytes:
        if depth == 16:
            packed = part.astype(">u2").reshape(len(part), -1).view(np.uint8)
        elif depth == 8:
            packed = part.astype(np.uint8).reshape(len(part), -1)
        else:
            bits = (part[:, :, 0, None] >> np.arange(depth - 1, -1, -1)).astype(np.uint8) & 1
            packed = np.packbits(bits.reshape(len(part), -1), axis=1)
        return _filtered(np.ascontiguousarray(packed), kind, step)

    parts = [samples[y::dy, x::dx] for x, y, dx, dy in PASSES] if interlaced else [samples]
    data = b"".join(rows(x) for x in parts if x.size)
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced))
    return SIGNATURE + chunk(b"IHDR", head) + b"".join(chunk(k, x) for k, x in chunks) + chunk(b"IDAT", zlib.compress(data, level)) + chunk(b"IEND", b"")


def encode(rgba: np.ndarray, level: int = 6) -> bytes:
    """height x width x 4 bytes as an RGBA file with unfiltered rows."""
    return encode_as(rgba, 6, 8, level=level)
