"""Words of whole Arrow string columns as numpy arrays.

Word classes are sets of ASCII bytes; every byte of a non-ASCII character counts as a word byte or as none,
so spans over UTF-8 bytes are the spans over characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a chunk holds, but for a longer single text.
CHUNK_BYTES = 4 << 20
_BLOCK = 1 << 18
_LONG = 1 << 14


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each uint64."""
    return _mixed(x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes of words: all but those in the given inclusive ranges."""
    out = np.ones(256, bool)
    for low, high in excluded:
        out[low : high + 1] = False
    return out


#: `[^\x20\x09-\x0D]+`
BLANK_SEPARATED = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_BYTE = mixed(_FOLD * np.uint64(0x2545F4914F6CDD1D) + np.uint64(77))
_P = 0xD6E8FEB86659FD93
_POWERS = np.cumprod(np.full(_BLOCK + _LONG + 1, _P, np.uint64))
_INVERSES = np.cumprod(np.full(_BLOCK + _LONG + 1, pow(_P, -1, 1 << 64), np.uint64))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows together, and len + 1 offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, to, their bytes and offsets: runs of whole rows of `limit` bytes at most, or a single longer row."""
    data, offsets = text_buffer(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and len(offsets) indices: row i has the words first[i] to first[i + 1]."""
    inside = word[data]
    after = np.zeros(len(data) + 1, bool)
    after[1:] = inside
    after[offsets] = False
    starts = np.flatnonzero(inside & ~after[:-1])
    before = np.zeros(len(data) + 1, bool)
    before[:-1] = inside
    before[offsets] = False
    ends = np.flatnonzero(inside & ~before[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, with A-Z read as a-z."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
        high = int(ends[to - 1])
        if high - low > _BLOCK + _LONG:  # a single very long word
            folded = _FOLD[data[low:high]].astype(np.uint8).tobytes()
            out[at] = int.from_bytes(hashlib.blake2b(folded, digest_size=8).digest(), "little")
        else:
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTE[data[low:high]] * _POWERS[: high - low], out=total[1:])
            s = starts[at:to] - low
            out[at:to] = _mixed((total[ends[at:to] - low] - total[s]) * _INVERSES[s])
        at = to
    return out


def owners(first: np.ndarray) -> np.ndarray:
    """The row that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def crc32_of_ids(ids: list) -> np.ndarray:
    """crc32 of each id as text; -1 where null."""
    import zlib

    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) for i in ids], np.int64)
