"""Words of many texts at once: NumPy over the bytes of an Arrow column, without a Python object per word.

A slice is hashed eight bytes at a time, each taken in by a bijection that is not linear; slices of more than LONG bytes
by BLAKE2b. Equal slices have equal hashes; different ones agree with probability near 2**-64, whatever pattern their
bytes follow. Null texts count as empty; an empty buffer has no words.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Slices of more bytes than this go through hashlib, one by one.
LONG = 64
_TAKE = U(0xA0761D6478BD642F)
#: The first n bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)

#: Bytes that are not white space: everything but 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words as letters: ASCII letters and every byte of other characters.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: ASCII upper case to lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Hashes:
    """Hashes of slices of one byte buffer."""

    def __init__(self, buf: np.ndarray):
        self.bytes = np.zeros(len(buf) + 8, np.uint8)
        self.bytes[:-8] = buf
        #: eight bytes from every place
        self.eight = np.ndarray((len(buf) + 1,), "<u8", self.bytes, strides=(1,))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        h = mix((self.eight[start] & _FIRST[np.minimum(size, 8)]) + size.astype(U) * U(0xD6E8FEB86659FD93))
        todo, at = np.flatnonzero(size > 8), 8
        while len(todo):
            if at >= LONG:
                for i in todo.tolist():
                    h[i] = int.from_bytes(hashlib.blake2b(self.bytes[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
                break
            h[todo] = mix(h[todo] * _TAKE + (self.eight[start[todo] + at] & _FIRST[np.minimum(size[todo] - at, 8)]))
            at += 8
            todo = todo[size[todo] > at]
        return h


def blocks(batch: pa.RecordBatch, column: int, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with up to ``limit`` bytes of text, or one row.
    Null texts are empty."""
    col = batch.column(column)
    col = col.cast(pa.large_binary())
    col = col.fill_null(b"") if col.null_count else col
    n = len(col)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
    release()


def release() -> None:
    """Give memory that is free inside this process back to the machine, as a worker may idle long after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def spans(buf: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and row of the maximal runs of member bytes inside each row."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = member[buf]
    border = np.zeros(len(buf) + 1, bool)
    border[off] = True
    start = inside[:-1].copy()
    start[1:] &= ~inside[:-2] | border[1:-1]
    end = inside[:-1] & (~inside[1:] | border[1:])
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1
