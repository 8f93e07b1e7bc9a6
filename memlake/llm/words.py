"""Vectorised word kernel shared by the text operators of this subpackage.

A chunk of documents is one UTF-8 byte buffer plus document offsets. Words are
found by a 256-entry byte table and hashed eight bytes at a time, so no Python
object is made per word. Window hashes are rolling polynomials of word hashes
modulo 2**64. One 64-bit hash identifies a word or window inside a
document; where identity must hold across the corpus, callers use two
independent hashes (128 bits).
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: After chunks of so many bytes freed memory is given back.
RELEASED_BYTES = 1 << 20

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_WINDOW_BASES = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F))
#: Masks of the first 0 to 8 bytes of a little-endian word.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one.
_STEPPED = 1024
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _table(chars: bytes, inside: bool) -> np.ndarray:
    t = np.full(256, not inside)
    t[list(chars)] = inside
    return t


#: Words are runs of anything but space and \t \n \v \f \r.
SPACED = _table(b" \t\n\x0b\x0c\r", inside=False)
#: Words are runs of ASCII letters, digits and non-ASCII characters.
ALNUM = _table(bytes(b for b in range(128) if not chr(b).isalnum()), inside=False)
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept up to a bound."""
    key = (base, 0)
    if key not in _powers or len(_powers[key][0]) < n:
        size = max(n, 1 << max(16, n.bit_length()) if n <= CHUNK_BYTES else 0)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, np.uint64(b))
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        if n > CHUNK_BYTES:
            return out[0], out[1]
        _powers[key] = (out[0], out[1])
    return _powers[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _rolled(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(int(base), len(values) + 1)
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=c[1:])
    return c, down


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of buf[start:end] for each span: eight bytes a step, so a span of up to eight has a hash of its own."""
    size = (ends - starts).astype(np.uint64)
    padded = np.concatenate((buf, np.zeros(16, np.uint8)))
    eight = np.ndarray((len(buf) + 8,), "<u8", padded.data, strides=(1,))
    base = _BASES[which]
    h = mix((eight[starts] & MASKS[np.minimum(size, 8).astype(np.int64)]) ^ (size * base))
    more, k = np.flatnonzero(size > 8), 8
    while len(more) and k < _STEPPED:
        left = size[more] - np.uint64(k)
        h[more] = mix(h[more] * base + (eight[starts[more] + k] & MASKS[np.minimum(left, 8).astype(np.int64)]))
        k += 8
        more = more[size[more] > k]
    for i in more.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([which])).digest(), "little")
    return h


def window_hash(h: np.ndarray, first: np.ndarray, last: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the word sequences h[first:last]; the length takes part."""
    c, down = _rolled(h, _WINDOW_BASES[which])
    return mix((c[last] - c[first]) * down[first] + (last - first).astype(np.uint64))


class Words:
    """The words of a chunk: byte spans, document bounds and hashes."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED, lower: bool = False, hashes: int = 1, cut: np.ndarray | None = None):
        self.buf, self.offsets = buf, offsets
        inside = table[buf]
        n = len(buf)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        if cut is not None:
            edges = np.union1d(edges, np.flatnonzero(cut))
        before[edges] = False
        after[edges - 1] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: The words of document d are bounds[d]:bounds[d + 1].
        self.bounds = np.searchsorted(self.starts, offsets)
        self.text = LOWER[buf] if lower else buf
        self.h = [span_hash(self.text, self.starts, self.ends, k) for k in range(hashes)]

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def windows(self, n: int) -> np.ndarray:
        """First words of the n-word windows, none of which crosses documents."""
        last = np.repeat(self.bounds[1:], self.counts)
        i = np.arange(len(self))
        return i[i + n <= last]

    def window_hashes(self, first: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        return window_hash(self.h[which], first, first + n, which)


def cover(first: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n positions lie in any of the spans first:first + length."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, first, 1)
    np.add.at(d, first + length, -1)
    return np.cumsum(d[:-1]) > 0


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.large_binary()
    column = pc.fill_null(column.cast(big if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()), b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Gives freed memory back to the system: workers are many and live long."""
    if _trim is not None:
        _trim(0)
    pa.default_memory_pool().release_unused()


def chunks(buf: np.ndarray, offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end document, bytes, offsets) of chunks of about `most` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if offsets[j] - offsets[i] >= RELEASED_BYTES:
            release()
        i = j
