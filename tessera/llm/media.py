"""GIF: LZW code streams, palettes, disposal and transparency, timed frames and colour histograms.

Many frames are compressed at once: each is a lane of array operations that take one sample of every lane at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tessera.llm._store import rows_of

WIDTH = 64
#: Rows of a frame at most; longer payloads go on in further frames.
FRAME_ROWS = 64
#: Pixels of a canvas, or samples of a frame, that the decoder takes at most.
MOST_PIXELS = 1 << 24
#: Payload bytes that are compressed together, and bytes of their tables.
GROUP_BYTES, TABLE_BYTES = 4 << 20, 32 << 20
#: The colour of sample b is (b, 73 b + 41, 151 b + 7) modulo 256: no two are equal.
COLOURS = np.stack([np.arange(256), np.arange(256) * 73 + 41, np.arange(256) * 151 + 7], 1).astype(np.uint8)
_EMPTY = np.uint32(0xFFFFFFFF)


class BadGif(ValueError):
    """The bytes aren't a complete GIF, or claim more than MOST_PIXELS."""


def _widths(nth: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Bits of the nth code after a clear code: enough for the table's next entry."""
    following = (1 << np.asarray(size, np.int64)) + 2 + np.maximum(0, nth - 1)
    return np.minimum(12, np.maximum(np.asarray(size) + 1, np.floor(np.log2(following)).astype(np.int64) + 1))


def _lanes(samples: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of lanes, one lane after the other, and how many each has. samples is time x lanes, the longest lanes first.
    A lane's table is a hash table of its own, of entries (code, next sample) << 12 | new code; a full table stays."""
    time, lanes = samples.shape
    slots = 1 << int(np.ceil(np.log2(2 * min(time, 4096) + 2)))
    table = np.full(lanes * slots, _EMPTY, np.uint32)
    codes, sent = np.zeros((time, lanes), np.uint16), np.zeros((time, lanes), bool)
    now, free, base = samples[0].astype(np.uint32), ((1 << sizes) + 2).astype(np.uint32), np.arange(lanes) * slots
    alive = np.searchsorted(-lengths, -np.arange(time), "left")  # lanes longer than t
    shift, mask = np.uint32(32 - int(np.log2(slots))), slots - 1
    for t in range(1, time):
        n = alive[t]
        key = now[:n] << np.uint32(8) | samples[t, :n]
        slot = base[:n] + ((key * np.uint32(2654435761)) >> shift)
        entry = table[slot]
        open_ = np.flatnonzero((entry >> np.uint32(12) != key) & (entry != _EMPTY))
        while len(open_):
            own = base[open_]
            slot[open_] = own + ((slot[open_] - own + 1) & mask)
            entry[open_] = table[slot[open_]]
            open_ = open_[(entry[open_] >> np.uint32(12) != key[open_]) & (entry[open_] != _EMPTY)]
        miss = entry == _EMPTY
        codes[t - 1, :n], sent[t - 1, :n] = now[:n], miss
        new = np.flatnonzero(miss & (free[:n] < 4096))
        table[slot[new]] = key[new] << np.uint32(12) | free[new]
        free[new] += np.uint32(1)
        now[:n] = np.where(miss, samples[t, :n], entry & np.uint32(4095))
        done = slice(alive[t], alive[t - 1])  # lanes whose last sample was the one before
        codes[t - 1, done], sent[t - 1, done] = now[done], True
    codes[time - 1, : alive[time - 1]], sent[time - 1, : alive[time - 1]] = now[: alive[time - 1]], True
    return np.ascontiguousarray(codes.T)[np.ascontiguousarray(sent.T)].astype(np.int64), sent.sum(0)


def _packed(codes: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Code streams, least bit first: of each lane a clear code, its codes and an end code."""
    n, lanes = counts + 2, len(counts)
    starts = np.cumsum(n) - n
    lane = np.repeat(np.arange(lanes), n)
    nth = np.arange(len(lane)) - starts[lane]
    every = np.zeros(len(lane), np.int64)
    every[(nth > 0) & (nth <= counts[lane])] = codes
    every[starts] = 1 << sizes
    every[starts + n - 1] = (1 << sizes) + 1
    width = np.where(nth == 0, sizes[lane] + 1, _widths(nth - 1, sizes[lane]))
    until = np.cumsum(width)
    bits = np.add.reduceat(width, starts)
    size = (bits + 7) // 8
    at = np.cumsum(size) - size
    place = until - width - np.repeat(np.cumsum(bits) - bits, n) + 8 * at[lane]
    value, byte = every << (place & 7), place >> 3
    total = int(size.sum()) + 2
    out = sum(np.bincount(byte + k, (value >> (8 * k)) & 255, total) for k in range(3)).astype(np.uint8).tobytes()
    return [out[a : a + b] for a, b in zip(at.tolist(), size.tolist(), strict=True)]


def lzw_encode(frames: Sequence[np.ndarray], sizes: Sequence[int]) -> list[bytes]:
    """The code stream of each frame's samples, none of them empty, for the given code sizes (2 to 8)."""
    lengths, sizes = np.array([len(x) for x in frames], np.int64), np.array(sizes, np.int64)
    order, out, at = np.argsort(-lengths, kind="stable"), [b""] * len(frames), 0
    while at < len(order):
        time = int(lengths[order[at]])
        step = max(1, TABLE_BYTES // (8 * min(time, 4096) + 4 * time + 16))
        some = order[at : at + step]
        samples = np.zeros((len(some), time), np.uint8)
        for k, i in enumerate(some):
            samples[k, : lengths[i]] = frames[i]
        codes, counts = _lanes(np.ascontiguousarray(samples.T), lengths[some], sizes[some])
        for i, stream in zip(some, _packed(codes, counts, sizes[some]), strict=True):
            out[i] = stream
        at += step
    return out


def _bits_at(data: np.ndarray, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """The codes of the given widths (12 at most) at the given bits; data has three bytes beyond them."""
    byte = at >> 3
    wide = data[byte].astype(np.uint32) | data[byte + 1].astype(np.uint32) << np.uint32(8) | data[byte + 2].astype(np.uint32) << np.uint32(16)
    return ((wide >> (at & 7).astype(np.uint32)) & ((np.uint32(1) << np.asarray(width, np.uint32)) - np.uint32(1))).astype(np.int64)


def _segment(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of the codes between two clear codes: table entry clear + 2 + k is code k and the first sample of
    code k + 1, so parents, first samples and lengths follow from the codes by pointer jumping."""
    n, base = len(codes), clear + 2
    entries = max(0, min(n - 1, 4096 - base))
    size = base + entries
    parent = np.arange(size)
    parent[base:] = codes[:entries]
    if n and (codes[0] >= clear or (codes[1:] > np.minimum(base + np.arange(n - 1), 4095)).any() or ((codes == clear) | (codes == clear + 1)).any()):
        raise BadGif("a code before its table entry")
    root, steps = parent.copy(), (np.arange(size) >= base).astype(np.int64)
    while (root >= base).any():
        steps = steps + steps[root]
        root = root[root]
    length = steps + 1
    last = np.arange(size)
    if entries:
        last[base:] = root[codes[1 : entries + 1]]
    ends = np.cumsum(length[codes])
    out = np.empty(ends[-1] if n else 0, np.uint8)
    at, place = codes.copy(), ends - 1
    while len(at):
        out[place] = last[at]
        more = at >= base
        at, place = parent[at[more]], place[more] - 1
    return out


def lzw_decode(data: bytes, size: int, wanted: int) -> np.ndarray:
    """The samples of a code stream; what follows the wanted number, or the end code, is left out."""
    if not 1 <= size <= 8:
        raise BadGif("a code size out of range")
    clear, bits = 1 << size, 8 * len(data)
    stream = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    out, at, have = [], 0, 0
    while have < wanted:
        n = 512
        while True:
            k = np.arange(n)
            width = _widths(k, size)
            where = at + np.cumsum(width) - width
            fits = where + width <= bits
            codes = _bits_at(stream, where[fits], width[fits])
            special = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(special) or not fits.all():
                break
            n *= 4
        end = int(special[0]) if len(special) else len(codes)
        if end:
            out.append(_segment(codes[:end], clear))
            have += len(out[-1])
        if not len(special):
            if have < wanted:
                raise BadGif("the code stream ends early")
            break
        at = int(where[end] + width[end])
        if codes[end] == clear + 1:
            break
    return (np.concatenate(out) if out else np.zeros(0, np.uint8))[:wanted]


def _blocks(data: bytes) -> bytes:
    """Sub-blocks of 255 bytes and a last, shorter one, then the empty block."""
    whole = len(data) // 255
    rows = np.empty((whole, 256), np.uint8)
    rows[:, 0] = 255
    rows[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return rows.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _frames(payload: np.ndarray, width: int, rows: int) -> tuple[bytes, int, list[tuple]]:
    """The palette, the code size, and of each frame its samples as indices, its rows, disposal and transparent index.

    The palette has the payload's samples in order and, if there's room, a transparent one: what a frame would draw over
    equal pixels stays as it is. A frame is disposed of as leaves most pixels of the next one drawn: it's left, or what was
    before it is restored, or, if no pixel stays either way, its part is cleared."""
    held = np.flatnonzero(np.bincount(payload, minlength=256))
    index = np.zeros(256, np.uint8)
    index[held] = np.arange(len(held))
    clear = len(held) if len(held) < 256 else None
    bits = max(1, int(len(held) - (clear is None)).bit_length())
    palette = np.zeros((1 << bits, 3), np.uint8)
    palette[: len(held)] = COLOURS[held]
    parts = [payload[at : at + width * rows] for at in range(0, len(payload), width * rows)]
    out, canvas = [], np.full(width * rows, -1, np.int16)
    for k, part in enumerate(parts):
        n, disposal, samples = len(part), 0, index[part]
        if clear is not None and k:
            samples = np.where(canvas[:n] == part, np.uint8(clear), samples)
        if k + 1 < len(parts):
            following = parts[k + 1]
            before, after = canvas.copy(), canvas
            after[:n] = part
            kept, restored = ((x[: len(following)] == following).sum() for x in (after, before))
            disposal = 2 if not max(kept, restored) else 1 if kept >= restored else 3
            if disposal == 2:
                canvas[:n] = -1
            elif disposal == 3:
                canvas = before
        out.append((samples, n // width, disposal, clear))
    return palette.tobytes(), bits, out


def encode(payloads: Sequence[bytes], *, width: int = WIDTH, rows: int = FRAME_ROWS, delay: int = 10) -> list[bytes]:
    """Of each payload, a positive multiple of width, a GIF whose composed frames hold it row by row, as 8-bit samples."""
    made = []
    for payload in payloads:
        if not payload or len(payload) % width:
            raise ValueError(f"a payload isn't a positive multiple of {width} bytes")
        made.append(_frames(np.frombuffer(payload, np.uint8), width, rows))
    sizes = [max(2, bits) for _, bits, frames in made for _ in frames]
    streams = iter(lzw_encode([x[0] for _, _, frames in made for x in frames], sizes))
    out = []
    for palette, bits, frames in made:
        file = [b"GIF89a", struct.pack("<HHBBB", width, frames[0][1], 0xF0 | (bits - 1), 0, 0), palette]
        for _, n, disposal, clear in frames:
            file += [b"\x21\xf9\x04", struct.pack("<BHBB", disposal << 2 | (clear is not None), delay, clear or 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, width, n, 0), bytes([max(2, bits)]), _blocks(next(streams))]
        out.append(b"".join(file) + b"\x3b")
    return out


@dataclass
class Frame:
    delay: int  #: hundredths of a second
    disposal: int
    box: tuple[int, int, int, int]  #: left, top, width, height of the part that the frame drew
    rgba: np.ndarray  #: the canvas after the frame, height x width x 4; the next frame draws on the same one

    def part(self) -> np.ndarray:
        x, y, w, h = self.box
        return self.rgba[y : y + h, x : x + w]


def decode(data: bytes) -> Iterator[Frame]:
    """The frames one by one, each on the canvas as it is then. BadGif if the bytes aren't a complete GIF."""
    try:
        yield from _decode(data)
    except (struct.error, IndexError) as e:
        raise BadGif("the file ends early") from e


def _decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise BadGif("no GIF header")
    width, height, packed, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    if width * height > MOST_PIXELS:
        raise BadGif(f"a canvas of {width} x {height} pixels")

    def palette(packed: int, at: int) -> tuple[np.ndarray | None, int]:
        if not packed & 0x80:
            return None, at
        n = 2 << (packed & 7)
        if at + 3 * n > len(data):
            raise BadGif("the palette ends early")
        colours = np.full((256, 4), 255, np.uint8)
        colours[:, :3] = 0
        colours[:n, :3] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        return colours, at + 3 * n

    def gather(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    shared, at = palette(packed, at)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear = 0, 0, None
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            label = data[at + 1]
            body, at = gather(at + 2)
            if label == 0xF9 and len(body) >= 4:
                flags, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear = flags >> 2 & 7, index if flags & 1 else None
            continue
        if kind != 0x2C:
            raise BadGif(f"an unknown block {kind:#x}")
        x, y, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        if x + w > width or y + h > height:
            raise BadGif("a frame beyond the canvas")
        own, at = palette(packed, at + 10)
        colours = shared if own is None else own
        if colours is None:
            raise BadGif("a frame without palette")
        size = data[at]
        stream, at = gather(at + 1)
        samples = lzw_decode(stream, size, w * h)
        if len(samples) < w * h:
            raise BadGif("a frame of too few samples")
        image = samples.reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(s, h, t) for s, t in ((0, 8), (4, 8), (2, 4), (1, 2))])
            image = image[np.argsort(order)]
        before = canvas.copy() if disposal == 3 else None
        part = canvas[y : y + h, x : x + w]
        pixels = colours.view(np.uint32).ravel()[image].view(np.uint8).reshape(h, w, 4)
        if clear is None:
            part[:] = pixels
        else:
            drawn = image != clear
            part[drawn] = pixels[drawn]
        yield Frame(delay, disposal, (x, y, w, h), canvas)
        if disposal == 2:
            part[:] = 0
        elif before is not None:
            canvas = before
        delay, disposal, clear = 0, 0, None


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Opaque pixels by colour: a quarter of the red, of the green and of the blue range each, 64 bins."""
    some = rgba[rgba[..., 3] > 0]
    bins = (some[:, 0] >> 6).astype(np.int64) << 4 | (some[:, 1] >> 6) << 2 | some[:, 2] >> 6
    return np.bincount(bins, minlength=64)


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, n_bytes of its text as UTF-8 (null: empty), and media: a GIF of the text and zeros up to a positive
    multiple of 64. Rows stay where they are read; equal texts give equal files. Other columns aren't read."""
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, at, texts = rows_of(batch, "doc"), 0, 0, []
            for k, value in enumerate(rows_of(batch, "text")):
                texts.append(value.as_py() or b"")
                held += len(texts[-1])
                if held > GROUP_BYTES or k + 1 == len(ids):
                    files = encode([x + bytes(-len(x) % WIDTH or (0 if x else WIDTH)) for x in texts])
                    yield pa.RecordBatch.from_arrays([ids.slice(at, k + 1 - at), pa.array([len(x) for x in texts], pa.int64()), pa.array(files, pa.large_binary())], ["doc", "n_bytes", "media"])
                    at, held, texts = k + 1, 0, []

    return source.mapInArrow(run, f"doc {source.schema['doc'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("doc", id_col)


def describe(media: bytes) -> dict:
    """What the frames of a file hold: the payload's digests are over the red samples of the parts that frames show."""
    sha, n, tail, frames, delay, bins = hashlib.sha256(), 0, b"", 0, 0, np.zeros(64, np.int64)
    for frame in decode(media):
        part = frame.part()
        samples = part[..., 0].tobytes()
        sha.update(samples)
        n += len(samples)
        tail = (tail + samples)[-64:]
        bins += histogram(part)
        frames += 1
        delay += frame.delay
    return {"payload_bytes": n, "payload_sha256": sha.hexdigest(), "tail_crc32": zlib.crc32(tail), "frames": frames, "duration": delay, "histogram": bins.tolist()}


_LONGS = ArrayType(LongType())
_ABOUT = [("payload_bytes", LongType(), pa.int64()), ("payload_sha256", StringType(), pa.string()), ("tail_crc32", LongType(), pa.int64()), ("media_bytes", LongType(), pa.int64()), ("media_sha256", StringType(), pa.string()), ("frames", IntegerType(), pa.int32()), ("duration", LongType(), pa.int64()), ("histogram", _LONGS, pa.list_(pa.int64())), ("error", StringType(), pa.string())]
_FRAME = [("frame", IntegerType(), pa.int32()), ("starts", LongType(), pa.int64()), ("delay", LongType(), pa.int64()), ("disposal", IntegerType(), pa.int32()), *((x, IntegerType(), pa.int32()) for x in ("left", "top", "width", "height")), ("histogram", _LONGS, pa.list_(pa.int64())), ("error", StringType(), pa.string())]


def _described(media: DataFrame, media_col: str, about: list, rows: object) -> DataFrame:
    """The columns of media but the files and those that `about` replaces, and what rows() tells of each file."""
    made = {name for name, _, _ in about}
    names = [c for c in media.columns if c.lower() != media_col.lower() and c.lower() not in made]
    schema = StructType([*media.select(*names).schema.fields, *(StructField(name, kind) for name, kind, _ in about)])
    source = media.select(*names, F.col(media_col).alias("media file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, place = [], []
            for k, raw in enumerate(rows_of(batch, "media file")):
                for x in rows(raw.as_py()):
                    found.append(x)
                    place.append(k)
            others = batch.select(names).take(pa.array(place, pa.int64()))
            yield pa.RecordBatch.from_arrays([*others.columns, *(pa.array([x.get(name) for x in found], kind) for name, _, kind in about)], schema.names)

    return source.mapInArrow(run, schema)


def read_media(media: DataFrame, *, media_col: str = "media") -> DataFrame:
    """The input's other columns, payload_bytes, payload_sha256 and tail_crc32 (of its last 64 bytes) of the samples read
    back, media_bytes, media_sha256, frames, duration (hundredths of a second), histogram (pixels by 64 colours) and error.
    Null or damaged files, and those that claim more than MOST_PIXELS, have an error and null in the other columns. Input
    columns of these names are replaced."""

    def rows(raw: bytes | None) -> list[dict]:
        if raw is None:
            return [{"error": "no file"}]
        own = {"media_bytes": len(raw), "media_sha256": hashlib.sha256(raw).hexdigest()}
        try:
            return [own | describe(raw)]
        except BadGif as e:
            return [own | {"error": str(e)}]

    return _described(media, media_col, _ABOUT, rows)


def read_frames(media: DataFrame, *, media_col: str = "media") -> DataFrame:
    """A row for each frame of each file: the input's other columns, frame (from 0), starts and delay (hundredths of a
    second), disposal, left, top, width and height of its part, and histogram, the part's pixels by 64 colours. A null or
    damaged file gives the frames before the damage and a row with an error. Input columns of these names are replaced."""

    def rows(raw: bytes | None) -> Iterator[dict]:
        if raw is None:
            yield {"error": "no file"}
            return
        starts = 0
        try:
            for k, frame in enumerate(decode(raw)):
                x, y, w, h = frame.box
                yield {"frame": k, "starts": starts, "delay": frame.delay, "disposal": frame.disposal, "left": x, "top": y, "width": w, "height": h, "histogram": histogram(frame.part()).tolist()}
                starts += frame.delay
        except BadGif as e:
            yield {"error": str(e)}

    return _described(media, media_col, _FRAME, rows)
