"""Spelling variant grouping by Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced code point makes one of the
other. Each word of the vocabulary generates its edits, and every edit is probed in a
blocked Bloom filter of the words of its length. Only the edits that pass are made into strings
and shuffled to a join with the vocabulary, which drops the filter's false positives; what is left is exact.

Each pair is found from one side: a deletion from its longer word, a replacement from the word whose letter is the rarer one
of the two, so a word of common letters has few edits to probe. An edit's hash comes from its word's prefix
sums in constant time; no string is built before its probe is positive.

Scale: the documents are scanned once and leave (word, count) rows, summed in each task before they are shuffled. The filter has
BITS bits a word, sharded by length (all lengths from LONG on are one shard), in blocks of 256 bits; at most ROUND_BLOCKS blocks are broadcast at a time,
and a larger vocabulary takes several rounds, each over the blocks of one range. What a driver holds is one round's blocks and one count
per length and letter. A word has at most one pair per edit, so no group grows with the corpus; counts are
summed by word with partial aggregation. Chains of forms are followed by pointer doubling over tables: n grows tenfold a step, so
a few joins reach the end of all.

Words: runs of `[A-Za-z\\u00C0-\\u00FF]`, A-Z lower-cased; where 31 divides h = crc32("<doc_id>:<run>"), the run loses its code point
h mod length. Those of at least LEAST code points and MIN_COUNT occurrences are the vocabulary.
A word's form is its near word of the largest count n (ties: the least in code-point order), if that is at least RATIO times its own; its root is the last form of
that chain, itself if it has no form.

Defined cases: null and empty texts have no words; a null doc_id is written as nothing before the colon;
repeated rows count as often as they come; a text that is one very long run is a word like any other; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerlens.llm.common import bound_batches, discard, table, written
from sellerlens.llm.pretokens import gather
from sellerlens.llm.textops import _powers, Words, chunks, mix, release, span_hashes, text_bytes

LEAST, MIN_COUNT, RATIO, DROP_ONE_IN = 7, 2, 10, 31
BITS = 16
LONG = 256
ROUND_BLOCKS = 1 << 21
#: Different words that a task counts before it sends them on; probes and letters handled at once.
TASK_WORDS, TASK_LETTERS = 500_000, 1 << 19

_WORD_N = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
_BITS8 = T.StructType([T.StructField("block", T.LongType())] + [T.StructField(f"w{j}", T.IntegerType()) for j in range(8)])
_EDIT = T.StructType([T.StructField("edit", T.StringType()), T.StructField("of", T.StringType()), T.StructField("of_n", T.LongType())])

#: Letters by byte: a-z and A-Z as a-z, all else 0; code points from U+00C0 are set from their second byte.
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)
_GAP = np.arange(256) == 0
_SALTS = (mix(np.arange(1, 9, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = (_CRC >> np.uint32(1)) ^ np.where(_CRC & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))


def letters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 texts as one byte a letter (its code point, A-Z folded), 0 for anything else."""
    lead = data == 0xC3
    after = np.zeros(len(data), bool)
    after[1:] = lead[:-1]
    codes = _LETTER[data]
    codes[after] = data[after] + np.uint8(0x40)
    before = np.concatenate([[0], np.cumsum(lead)])
    return codes[~lead], offs - before[offs]


def strings(codes: np.ndarray, size: np.ndarray) -> pa.Array:
    """Words of one byte a letter as an Arrow array."""
    wide = codes >= 0xC0
    ends = np.arange(1, len(codes) + 1) + np.cumsum(wide)
    data = np.zeros(len(codes) + int(wide.sum()), np.uint8)
    data[ends - 1] = np.where(wide, codes - np.uint8(0x40), codes)
    data[ends[wide] - 2] = 0xC3
    offs = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(size)])]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])


def crcs(codes: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """crc32 of each word's UTF-8 behind bytes whose crc32 is `first`."""
    out = ~first.astype(np.uint32)
    order = np.argsort(-size, kind="stable")
    many = int((size > 64).sum())
    active = len(size) - np.searchsorted(np.sort(size), np.arange(65), side="right")

    def step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return _CRC[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))

    for k in range(64):
        at = order[many : active[k]]
        if not len(at):
            break
        c = codes[start[at] + k].astype(np.uint32)
        state, wide = out[at], c >= 0xC0
        if wide.any():
            state[wide] = step(state[wide], np.uint32(0xC3))
            c[wide] -= np.uint32(0x40)
        out[at] = step(state, c)
    out = ~out
    for w in order[:many]:
        raw = codes[start[w] : start[w] + size[w]].tobytes().decode("latin-1").encode()
        out[w] = zlib.crc32(raw, int(first[w]))
    return out


def _words(ids: pa.Array, texts: pa.Array, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(letters, start, end) of the words of a chunk: those left as they are, and those that lost a letter."""
    codes, offs = letters(*text_bytes(texts))
    w = Words(codes, offs, _GAP)
    size = w.end - w.start
    at = np.flatnonzero(size >= least)
    first = np.array([zlib.crc32(("" if i is None else str(i)).encode() + b":") for i in ids.to_pylist()], np.uint32)
    h = crcs(codes, w.start[at], size[at], first[w.doc[at]])
    hit = h % np.uint32(DROP_ONE_IN) == 0
    lost, kept = at[hit], at[~hit]
    without = h[hit].astype(np.int64) % size[lost]
    start = np.cumsum(size[lost]) - size[lost]
    left = np.delete(gather(codes, w.start[lost], size[lost]), start + without)
    size = size[lost] - 1
    start = np.cumsum(size) - size
    whole = size >= least
    return [(codes, w.start[kept], w.end[kept]), (left, start[whole], (start + size)[whole])]


def _counts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(word, how often), each word once as long as a task holds no more than TASK_WORDS."""
    hashes, n, words = np.zeros(0, np.uint64), np.zeros(0, np.int64), pa.array([], pa.large_string())

    def rows() -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(n), 50_000):
            yield pa.RecordBatch.from_arrays([words.slice(lo, 50_000).cast(pa.string()), pa.array(n[lo : lo + 50_000])], _WORD_N.names)

    for batch in batches:
        for lo, hi in chunks(batch.column(1)):
            parts = [(hashes, n, words)]
            for codes, start, end in _words(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), least):
                new, sample, times = np.unique(span_hashes(codes, start, end), return_index=True, return_counts=True)
                size = (end - start)[sample]
                parts.append((new, times, strings(gather(codes, start[sample], size), size)))
            every = np.concatenate([p[0] for p in parts])
            hashes, sample, back = np.unique(every, return_index=True, return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(hashes)).astype(np.int64)
            words = pa.concat_arrays([p[2] for p in parts]).take(pa.array(sample))
            if len(n) > TASK_WORDS:
                yield from rows()
                hashes, n, words = hashes[:0], n[:0], words.slice(0, 0)
    yield from rows()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of all documents, and how often they are there."""
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counts(batches, least)

    counted = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(count, _WORD_N)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


@dataclass(frozen=True)
class Shards:
    """Where each length's blocks begin (`first`, by shard) and how many they are; `letters` from the rarest to the commonest."""

    first: np.ndarray
    blocks: np.ndarray
    letters: np.ndarray

    @property
    def size(self) -> int:
        return int(self.first[-1] + self.blocks[-1])

    def block(self, length: int, hashes: np.ndarray) -> np.ndarray:
        k = min(length, LONG)
        return self.first[k] + (((hashes >> np.uint64(32)) * np.uint64(self.blocks[k])) >> np.uint64(32)).astype(np.int64)


def bits(hashes: np.ndarray, j: int) -> np.ndarray:
    """The bit that a hash has in the j-th word of its block."""
    low = hashes.astype(np.uint32)
    return np.uint32(1) << ((low * _SALTS[j]) >> np.uint32(27))


def _by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, which words, their letters as a table), a bounded number of letters at a time."""
    codes, offs = letters(*text_bytes(words))
    size = np.diff(offs)
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        length = int(size[order[lo]])
        hi = int(np.searchsorted(size[order], length, side="right"))
        hi = min(hi, lo + max(1, TASK_LETTERS // max(1, length)))
        at = order[lo:hi]
        yield length, at, gather(codes, offs[at], size[at]).reshape(len(at), length)
        lo = hi


def _shards(words: DataFrame) -> Shards:
    """The shards of a vocabulary: its lengths and its letters are counted."""
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length, by_letter = np.zeros(LONG + 1, np.int64), np.zeros(256, np.int64)
        for batch in batches:
            for length, at, codes in _by_length(batch.column(0)):
                by_length[min(length, LONG)] += len(at)
                by_letter += np.bincount(codes.ravel(), minlength=256)
        n = np.concatenate([by_length, by_letter])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    found = words.select("word").mapInArrow(lengths, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(LONG + 257, np.int64)
    n[found.column(0).to_numpy()] = found.column(1).to_numpy()
    blocks = -(-n[: LONG + 1] * BITS // 256)
    by_letter = n[LONG + 1 :]
    order = np.argsort(by_letter, kind="stable")
    return Shards(np.cumsum(blocks) - blocks, blocks, order[by_letter[order] > 0].astype(np.uint8))


def _filter(words: DataFrame, shards: Shards, lo: int, hi: int) -> np.ndarray:
    """The filter's blocks from lo to hi, 8 words of 32 bits each."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, value = [np.zeros(0, np.int64)], [np.zeros((8, 0), np.uint32)]
            for length, at, codes in _by_length(batch.column(0)):
                ends = np.arange(1, len(at) + 1) * length
                h = span_hashes(codes.ravel(), ends - length, ends)
                b = shards.block(length, h)
                mine = (b >= lo) & (b < hi)
                block.append(b[mine] - lo)
                value.append(np.stack([bits(h[mine], j) for j in range(8)]))
            b, v = np.concatenate(block), np.concatenate(value, axis=1)
            if not len(b):
                continue
            order = np.argsort(b, kind="stable")
            different, first = np.unique(b[order], return_index=True)
            v = np.bitwise_or.reduceat(v[:, order], first, axis=1).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(different), *map(pa.array, v)], _BITS8.names)
        release()

    found = words.select("word").mapInArrow(fill, _BITS8).groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(8)]).toArrow()
    out = np.zeros((8, hi - lo), np.uint32)
    at = found.column(0).to_numpy()
    for j in range(8):
        out[j, at] = found.column(j + 1).to_numpy().view(np.uint32)
    return out


def _edits(codes: np.ndarray, order: np.ndarray, rank: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(length, word, place, hash, letter) of the edits of equally long words; letter 0 deletes."""
    n, length = codes.shape
    up, down = _powers(length + 1)
    total = np.zeros((n, length + 1), np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:length], axis=1, out=total[:, 1:])
    changes = np.ones((n, length), bool)
    changes[:, :-1] = codes[:, 1:] != codes[:, :-1]  # of equal neighbours, only the last is deleted
    word, place = np.nonzero(changes)
    whole = total[:, -1]
    yield length - 1, word, place, mix(total[word, place] + (whole[word] - total[word, place + 1]) * down[1]), 0
    ranks = rank[codes]
    for k, x in enumerate(order):
        word, place = np.nonzero(ranks < k)
        step = (np.uint64(x) - codes[word, place].astype(np.uint64)) * up[place]
        yield length, word, place, mix(whole[word] + step), int(x)


def _positives(words: DataFrame, shards: Shards, lo: int, hi: int, blocks: np.ndarray) -> DataFrame:
    """The edits that the filter's blocks from lo to hi let pass: edit, of, of_n."""
    shared = words.sparkSession.sparkContext.broadcast(blocks)
    rank = np.zeros(256, np.int16)
    rank[shards.letters] = np.arange(len(shards.letters))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        for batch in batches:
            for _, at, codes in _by_length(batch.column(0)):
                for length, word, place, h, letter in _edits(codes, shards.letters, rank):
                    if not shards.blocks[min(length, LONG)]:
                        continue
                    b = shards.block(length, h)
                    passed = np.flatnonzero((b >= lo) & (b < hi))
                    b = b[passed] - lo
                    for j in range(8):
                        there = (blocks[j, b] & bits(h[passed], j)) != 0
                        passed, b = passed[there], b[there]
                    for few in range(0, len(passed), max(1, TASK_LETTERS // max(1, length))):
                        p = passed[few : few + max(1, TASK_LETTERS // max(1, length))]
                        edit = codes[word[p]]
                        if letter:
                            edit[np.arange(len(p)), place[p]] = letter
                        else:
                            edit = np.delete(edit.ravel(), np.arange(len(p)) * (length + 1) + place[p])
                        of = pa.array(at[word[p]])
                        yield pa.RecordBatch.from_arrays([strings(edit.ravel(), np.full(len(p), length)).cast(pa.string()),
                                                          batch.column(0).take(of), batch.column(1).take(of)], _EDIT.names)
        release()

    out = written(words.select("word", "n").mapInArrow(probe, _EDIT), "edits")
    shared.unpersist()
    return out


def near_pairs(words: DataFrame, round_blocks: int = ROUND_BLOCKS) -> tuple[DataFrame, list[DataFrame]]:
    """word, n, near, near_n: every pair of near words of the vocabulary `words` (word, n), in both orders; and the tables that they are read from."""
    shards = _shards(words)
    rounds = [(lo, min(shards.size, lo + round_blocks)) for lo in range(0, shards.size, round_blocks)]
    edits = [_positives(words, shards, lo, hi, _filter(words, shards, lo, hi)) for lo, hi in rounds]
    every = reduce(DataFrame.unionAll, edits, words.sparkSession.createDataFrame([], _EDIT))
    pairs = every.join(words, F.col("edit") == F.col("word"))
    this, other = (F.col("word"), F.col("n")), (F.col("of"), F.col("of_n"))
    sides = [F.struct(*[c.alias(a) for c, a in zip(x + y, ("word", "n", "near", "near_n"), strict=True)]) for x, y in ((this, other), (other, this))]
    return pairs.select(F.explode(F.array(*sides)).alias("p")).select("p.*"), edits


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, min_count: int = MIN_COUNT,
             ratio: int = RATIO, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = written(vocabulary(docs, doc_id, text, least, min_count), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    pairs, edits = near_pairs(words, round_blocks)
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    is_form = F.col("best.less") <= -ratio * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    formed = written(formed, "forms")
    discard(words, *edits)
    chain = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    most = formed.agg(F.max("form_n")).first()[0]
    if most:
        steps = max(1, math.floor(math.log(most / min_count, ratio) + 1e-9))  # a chain has no more
        for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
            on = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
            before, chain = chain, written(chain.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
            discard(before)
    rooted = formed.join(chain, "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
