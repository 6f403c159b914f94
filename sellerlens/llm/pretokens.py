"""Byte-level BPE over whole Arrow batches: vectorised pre-tokens, each distinct one encoded once per worker.

The byte-level pre-tokenizer splits a text by the classes of its characters
(letter, number, white space, other), takes one blank before a run into the
run, leaves the last of several blanks to the run behind, and splits off the
English contractions. `pieces` finds those boundaries for a whole chunk with
array operations and gives each piece a 64-bit hash. `Encoder` maps hashes to
ids through two tiers: an optional table shared by all workers, and a cache of
this worker that the tokenizers library fills. Texts that hold a special token,
or bytes that are not UTF-8, go to the library whole.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from sellerlens.llm.textops import span_hashes

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Entries of a worker's cache; beyond, it starts anew.
CACHE_ENTRIES = 400_000
#: Fixed values of the byte-level pre-tokenizer: what follows an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of every code point, as the tokenizers library sees it.

    Where two versions of the Unicode tables at hand differ, the library is asked.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    out = np.full(0x110000, OTHER, np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    every = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    other = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for c in every:
        category = unicodedata.category(c)
        if category == "Cn" and out[ord(c)] != OTHER or other.get(category[0], OTHER) != out[ord(c)]:
            joined = [k for k, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(x + c)) == 1]
            out[ord(c)] = joined[0] if joined else SPACE
    return out


def byte_starts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, text) of every pre-token of a chunk of texts, in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    at = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
    texts = np.searchsorted(at, offs)
    m = len(points)
    kind = char_classes()[points]
    fresh = np.zeros(m + 1, bool)  # a text starts here
    fresh[texts] = True
    begins = fresh[:m].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    # White space before something else of the same text: its last character stands alone, or goes with what follows.
    inner = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~fresh[1:m])
    begins[inner] = True
    begins[inner[points[inner] == 32] + 1] = False
    # Contractions: an apostrophe that begins a piece, letters directly behind it.
    quote = np.flatnonzero((points[:-1] == 39) & begins[:-1] & (kind[1:] == LETTER) & ~fresh[1:m])
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        size = np.zeros(len(quote), np.int64)
        for c in CONTRACTIONS[::-1]:
            hit = one == ord(c[0])
            if len(c) == 2:
                hit &= (two == ord(c[1])) & ~fresh[np.minimum(quote + 2, m)]
            size[hit] = len(c)
        quote, size = quote[size > 0], size[size > 0]
        begins[quote + 1] = False
        behind = quote + 1 + size
        ok = behind < m
        ok[ok] = (kind[behind[ok]] == LETTER) & ~fresh[behind[ok]]
        begins[behind[ok]] = True
    first = np.flatnonzero(begins)
    return at[first], np.searchsorted(texts, first, side="right") - 1


class Pieces:
    """The pre-tokens of a chunk: bytes from `start` to `end`, `doc`, and `hash`."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data = data
        self.start, self.doc = byte_starts(data, offs)
        self.end = np.append(self.start[1:], len(data)).astype(np.int64)
        self.hash = span_hashes(data, self.start, self.end)

    def bytes_at(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


class HashTable:
    """Numbers by 64-bit hash: open addressing in two arrays, looked up and filled many keys at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.n = 0
        self._make(max(10, int(4 * len(keys)).bit_length()))
        self.add(keys, values)

    def _make(self, log2: int) -> None:
        self.shift, self.mask = np.uint64(64 - log2), (1 << log2) - 1
        self.keys, self.values = np.zeros(1 << log2, np.uint64), np.zeros(1 << log2, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        at, todo = (keys >> self.shift).astype(np.int64), None
        while len(keys):
            there = self.keys[at]
            hit = there == keys
            if todo is None:
                out[hit] = self.values[at[hit]]
            else:
                out[todo[hit]] = self.values[at[hit]]
            on = np.flatnonzero(~hit & (there != 0))
            todo = on if todo is None else todo[on]
            keys, at = keys[on], (at[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct new keys; 0 stands for no key and is never added."""
        values = values[keys != 0].astype(np.int32)
        keys = keys[keys != 0]
        self.n += len(keys)
        if 2 * self.n > len(self.keys):
            old = np.flatnonzero(self.keys)
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self._make(int(4 * self.n).bit_length())
        at = (keys >> self.shift).astype(np.int64)
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & self.mask


#: Fixed values of byte-level BPE: the bytes that stand for themselves; the others are 256, 257, ... in order.
_AS_IS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGN = np.zeros(256, "<u4")
_SIGN[_AS_IS] = _AS_IS
_SIGN[np.setdiff1d(np.arange(256), _AS_IS)] = 256 + np.arange(256 - len(_AS_IS))


class Encoder:
    """Ids of pre-tokens by hash, through a cache that the tokenizers library fills."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = [x.content.encode() for x in self.library.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.table = HashTable(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        #: By number: where a pre-token's ids begin in `ids`, and how many there are.
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_pieces(self, pieces: Pieces, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these pieces, how many each has), by the library's model."""
        if not len(which):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        size = pieces.end[which] - pieces.start[which] + 1
        signs = _SIGN[gather(np.append(pieces.data, np.uint8(0)), pieces.start[which], size)]
        signs[np.cumsum(size) - 1] = 10  # no sign of a byte
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(p)] for p in signs[:-1].tobytes().decode("utf-32-le").split("\n")]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def places(self, pieces: Pieces, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each wanted piece begin in `ids`, and how many it has; new ones are encoded first."""
        number = self.table.find(pieces.hash[wanted])
        missing = np.flatnonzero(number < 0)
        if len(missing):
            if self.table.n + len(missing) > CACHE_ENTRIES:
                self._clear()
                missing = np.arange(len(wanted))
            keys, sample, back = np.unique(pieces.hash[wanted[missing]], return_index=True, return_inverse=True)
            ids, counts = self.encode_pieces(pieces, wanted[missing[sample]])
            new = len(self.first) + np.arange(len(keys))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
            self.size, self.ids = np.concatenate([self.size, counts]), np.concatenate([self.ids, ids])
            self.table.add(keys, new)
            number[missing] = new[back]
        return self.first[number], self.size[number]

    def aside(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Texts that the library must see whole: those that hold a special token or broken UTF-8."""
        raw = data.tobytes()
        out: set[int] = set()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                out.add(int(np.searchsorted(offs, at, side="right")) - 1)
                at = raw.find(s, at + 1)
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            for d in range(len(offs) - 1):
                try:
                    raw[offs[d] : offs[d + 1]].decode("utf-8")
                except UnicodeDecodeError:
                    out.add(d)
        return np.array(sorted(out), np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    return Encoder(path)


def split_aside(data: np.ndarray, offs: np.ndarray, aside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunk with the texts in `aside` made empty."""
    if not len(aside):
        return data, offs
    size = np.diff(offs)
    keep = np.ones(len(size), bool)
    keep[aside] = False
    data = data[np.repeat(keep, size)]
    return data, np.concatenate([[0], np.cumsum(np.where(keep, size, 0))])


def gather(source: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """source[first[0] : first[0] + size[0]], source[first[1] : ...], ... as one array."""
    total = int(size.sum())
    if not total:
        return source[:0]
    step = np.arange(total) + np.repeat(first - (np.cumsum(size) - size), size)
    return source[step]


def encode_chunk(texts: pa.Array, enc: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, how many each has)."""
    from sellerlens.llm.textops import text_bytes

    data, offs = text_bytes(texts)
    aside = enc.aside(data, offs)
    raw, raw_offs = data, offs
    data, offs = split_aside(data, offs, aside)
    p = Pieces(data, offs)
    first, size = enc.places(p, np.arange(len(p.hash)))
    ids = gather(enc.ids, first, size)
    counts = np.bincount(p.doc, weights=size, minlength=len(texts)).astype(np.int64)
    if len(aside):
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for d in aside:
            parts[d] = enc.encode(raw[raw_offs[d] : raw_offs[d + 1]].tobytes().decode("utf-8", "replace"))
            counts[d] = len(parts[d])
        ids = np.concatenate(parts)
    return ids, counts
