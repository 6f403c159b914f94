"""Word-level hashing of whole Arrow batches of texts, without a Python loop over words.

A batch of texts is one byte array plus offsets. Words are found by a table
lookup per byte; each word gets a 64-bit hash from prefix sums of a polynomial
over the bytes (the multiplier is odd, so it has an inverse modulo 2**64), and
n-gram hashes come from a few shifted vector operations. Memory is a small
multiple of the chunk; texts longer than a chunk are a chunk of their own, and are hashed
a chunk's length at a time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; arrays over them take some forty times as much.
CHUNK_BYTES = 1 << 18
# Arrow's buffers come from the C library too, so that `release` gives them back.
pa.set_memory_pool(pa.system_memory_pool())

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse; those of more than a chunk are not kept."""
    size = max(n, CHUNK_BYTES + 1)
    made = _POWERS
    if len(made.get("up", ())) < n:
        made = _POWERS if size == CHUNK_BYTES + 1 else {}
        for name, base in (("up", _MULT), ("down", _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made[name] = np.multiply.accumulate(steps)
    return made["up"][:n], made["down"][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of spans in ascending order, a chunk's length of spans at a time."""
    out, lo = np.empty(len(start), np.uint64), 0
    while lo < len(out):
        base = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(end, base + CHUNK_BYTES, side="right")))
        part = data[base : end[hi - 1]]
        up, down = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        out[lo:hi] = mix((total[end[lo:hi] - base] - total[start[lo:hi] - base]) * down[start[lo:hi] - base])
        lo = hi
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; a null text is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offs = offs[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that gives free memory back to the system, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def release() -> None:
    """Gives the memory that a worker has freed back: workers stay, idle, while later stages need it for themselves."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text, or of one row; together they are all rows.

    Behind the last one the worker's freed memory is released.
    """
    _, offs = text_bytes(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi
    release()


class Words:
    """The words of a chunk: `start` and `end` bytes, `doc` of each, and `first` word of each document.

    `breaks` tells of each byte whether it stands between words; white space does unless stated.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, breaks: np.ndarray = _SPACE):
        self.data, self.offs = data, offs
        n = len(data)
        word = ~breaks[data]
        begin, end = word.copy(), word.copy()
        if n:
            begin[1:] &= ~word[:-1]
            end[:-1] &= ~word[1:]
            full = offs[:-1][offs[:-1] < offs[1:]]
            begin[full] = word[full]
            last = offs[1:][offs[:-1] < offs[1:]] - 1
            end[last] = word[last]
        self.word_byte = word
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        if self._hash is None:
            self._hash = span_hashes(self.data, self.start, self.end)
        return self._hash

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of every run of `n` words of one document."""
        h = self.hash
        size = len(h) - n + 1
        if size <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        g = h[:size].copy()
        for k in range(1, n):
            g *= np.uint64(0xD6E8FEB86659FD93)
            g += h[k : k + size]
        at = np.flatnonzero(self.doc[:size] == self.doc[n - 1 : n - 1 + size])
        return mix(g[at]), at

    def bytes_of(self, doc: int) -> bytes:
        return self.data[self.offs[doc] : self.offs[doc + 1]].tobytes()


def per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many `flags` are set between consecutive `bounds`."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
