"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: its ones are hashed, its zeros
are ignored. The two masks together hit every aligned run of WINDOW words with
up to MAX_CHANGED substituted words (all 78 cases, see the tests). Test seeds
and training seeds are joined on their hashes; each hit gives an alignment of a
benchmark item with a document, and the words around it are compared in place:
an item leaks if WINDOW consecutive words of it differ in MAX_CHANGED at most.

Scale: the test seeds set bits in a filter of fixed size (FILTER_BITS), which is
broadcast; the documents are scanned once, and only seeds that pass the filter,
with the texts they are in, go on to the join. A passage in a third of all
documents is one hot join key on the training side; the join is split by Spark,
or needs no shuffle where the test seeds are within the checked broadcast bound. The alignments of a document
and an item are verified in rows of at most SHIFTS, and the best is a grouped maximum, so neither a very long text nor a phrase
of many items makes a list that grows. A benchmark with more than some ten million seeds fills the filter, and more seeds go to the join; results stay the same.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z folded. Items of fewer than WINDOW
words must occur whole, with SHORT_CHANGED substituted word at most: the three masks of their length have
zeros at every third place, so each place is a zero of one of them. Items under MIN_ITEM words must be the
words of a whole line or of a whole text, unchanged.
Defined cases: null and empty texts leak nothing; a very long text is scanned whole; a null doc_id is reported as
null; rows equal in id and text are reported once; benchmark rows equal in id
and text count once; an empty documents or benchmark table gives no rows; other
columns are carried by `without_leaks`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerlens.llm.common import fresh, table, written
from sellerlens.llm.textops import Words, chunks, mix, release, text_bytes
from sellerlens.plans.broadcast import broadcast_if_small

WINDOW = 13
MAX_CHANGED = 2
MIN_ITEM = 5
SHORT_CHANGED = 1
MASKS = ("11101101", "11001000111")
FILTER_BITS = 1 << 26
#: Alignments of a document and an item that one row holds, at most.
SHIFTS = 1 << 14

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_SEED = T.StructType([T.StructField("seed", T.LongType()), T.StructField("at", T.IntegerType())])
_LEAK = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("ref", T.LongType()), T.StructField("item_id", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("n_aligned", T.LongType()), T.StructField("n_matched", T.LongType()),
])


def folded(texts: pa.Array) -> Words:
    data, offs = text_bytes(texts)
    return Words(_FOLD[data], offs)


def short_masks(n: int) -> list[str]:
    """The masks of an item of n words, fewer than WINDOW; one of `=` stands for the words of a whole line or text."""
    if n < MIN_ITEM:
        return ["=" * n]
    return ["".join("0" if k % 3 == j else "1" for k in range(n)) for j in range(3)]


def all_masks(short: list[int]) -> list[str]:
    """The fixed masks, and those of each length of a short item."""
    return [*MASKS, *(m for n in sorted(short) for m in short_masks(n))]


def line_seeds(words: Words, n: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every line of n words and every text of n words; only of texts if `whole`."""
    texts = words.first[:-1][words.count == n]
    at = texts
    if not whole and len(words.start):
        line = np.concatenate([[0], np.cumsum(words.data == 10)])[words.start]
        begin = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (words.doc[1:] != words.doc[:-1])]))
        at = np.union1d(texts, begin[np.diff(np.append(begin, len(words.start))) == n])
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words.hash[at + k]
    return mix(mix(h) + np.uint64(n)), at


def seeds(words: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every place where a mask fits into one document."""
    span = len(mask)
    if mask[0] == "=":
        return line_seeds(words, span)
    size = len(words.start) - span + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(size, int(mask[::-1], 2) * 2 + 1, np.uint64)
    for k in (k for k, c in enumerate(mask) if c == "1"):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words.hash[k : k + size]
    at = np.flatnonzero(words.doc[:size] == words.doc[span - 1 : span - 1 + size])
    return mix(h[at]), at


def _bits(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The three places of each hash in the filter."""
    out = []
    for salt in (1, 2, 3):
        out.append(mix(h + np.uint64(salt)) & np.uint64(bits - 1))
    return out


def _item_seeds(texts: pa.Array) -> pa.Array:
    """Per item its seeds; items of fewer than WINDOW words have one by each mask of their length."""
    w = folded(texts)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for mask in MASKS:
        h, at = seeds(w, mask)
        long = w.count[w.doc[at]] >= WINDOW
        found.append((h[long], at[long]))
    for n in np.unique(w.count[(w.count > 0) & (w.count < WINDOW)]).tolist():
        for mask in short_masks(n):
            h, at = seeds(w, mask) if n >= MIN_ITEM else line_seeds(w, n, whole=True)
            exact = w.count[w.doc[at]] == n
            found.append((h[exact], at[exact]))
    h, at = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    order = np.argsort(at, kind="stable")
    h, at = h[order], at[order]
    docs = w.doc[at]
    values = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array((at - w.first[docs]).astype(np.int32))], names=["seed", "at"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(docs, np.arange(len(texts) + 1)), pa.int32()), values)


def item_seeds(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, text, seed, at: the seeds of every benchmark item."""
    udf = F.arrow_udf(_item_seeds, T.ArrayType(_SEED))
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("item")).distinct()
    return rows.select("item_id", "item", F.explode(udf("item")).alias("s")).select("item_id", "item", "s.seed", "s.at")


def seed_filter(seeds_of_items: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The filter as an array of bytes, its size fixed: built in 8-byte words, of which there are bits / 64."""

    def places(h: pa.Array) -> pa.Array:
        found = np.stack(_bits(h.to_numpy().view(np.uint64), bits), axis=1).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * 3, pa.int32()), pa.array(found.view(np.int64)))

    at = seeds_of_items.select("seed").distinct().select(F.explode(F.arrow_udf(places, T.ArrayType(T.LongType()))("seed")).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def _passes(h: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    bits = len(filter_) * 8
    ok = np.arange(len(h))
    for salt in (1, 2, 3):
        p = mix(h[ok] + np.uint64(salt)) & np.uint64(bits - 1)
        ok = ok[(filter_[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return ok


def _doc_seeds(texts: pa.Array, masks: list[str], filter_: np.ndarray) -> pa.Array:
    """Per text the seeds that pass the filter."""
    sizes, hashes, places = [], [], []
    for lo, hi in chunks(texts):
        w = folded(texts.slice(lo, hi - lo))
        found = []
        for mask in masks:
            h, at = seeds(w, mask)
            ok = _passes(h, filter_)
            found.append((h[ok], at[ok]))
        h, at = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        order = np.argsort(at, kind="stable")
        h, docs = h[order], w.doc[at[order]]
        sizes.append(np.bincount(docs, minlength=hi - lo))
        hashes.append(h)
        places.append((at[order] - w.first[docs]).astype(np.int32))
    none = [np.zeros(0, np.int64)]
    values = pa.StructArray.from_arrays([pa.array(np.concatenate(hashes or none).view(np.int64)), pa.array(np.concatenate(places or none), pa.int32())], names=["seed", "at"])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes or none))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(first word in the document, words aligned, words equal) if the item leaks at this alignment.

    `shift` is the item's first word in the document, negative where the document begins within the item.
    """
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    window = min(WINDOW, len(item))
    changed = MAX_CHANGED if len(item) >= WINDOW else SHORT_CHANGED if len(item) >= MIN_ITEM else 0
    if hi - lo < window:
        return None
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    total = np.concatenate([[0], np.cumsum(same)])
    if (total[window:] - total[:-window]).max() < window - changed:
        return None
    return lo + shift, hi - lo, int(total[-1])


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best leak of an item in a document among some of their alignments; rows come by document."""
    key, words = None, np.zeros(0, np.uint64)
    for batch in batches:
        out = []
        doc_ids, keys, refs, item_ids = (batch.column(k).to_pylist() for k in range(4))
        for r in range(batch.num_rows):
            if keys[r] != key:
                key, words = keys[r], folded(batch.column("text").slice(r, 1)).hash
            item = folded(batch.column("item").slice(r, 1)).hash
            found = [x for x in (overlap(words, item, s) for s in batch.column("shifts")[r].as_py()) if x]
            if found:
                first, n, matched = max(found, key=lambda x: (x[2], -x[0], x[1]))
                out.append((doc_ids[r], key, refs[r], item_ids[r], first, n, matched))
        columns = zip(*out, strict=True) if out else [()] * len(_LEAK)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if f.name == "key" else pa.int64())
                                          for c, f in zip(columns, _LEAK.fields, strict=True)], _LEAK.names)
    release()


def row_key(doc_id: Column, text: Column) -> Column:
    return F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """One row per (document, leaked item): doc_id, key, item_id, first_word, n_aligned, n_matched."""
    tests = written(item_seeds(items, item_id, item_text), "seeds")
    n_words = F.regexp_count("item", F.lit(r"[^\x20\x09-\x0D]+"))
    short = [r[0] for r in tests.select(n_words.alias("n")).filter(F.col("n") < WINDOW).distinct().collect()]
    masks = all_masks(short)
    shared = docs.sparkSession.sparkContext.broadcast(seed_filter(tests, bits))

    def scan(texts: pa.Array) -> pa.Array:
        return _doc_seeds(texts, masks, shared.value)

    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = found.withColumn("hits", F.arrow_udf(scan, T.ArrayType(_SEED))("text")).filter(F.size("hits") > 0)
    found = written(found.withColumn("key", row_key(F.col("doc_id"), F.col("text"))), "hits")
    hits = found.select("key", F.explode("hits").alias("h")).select("key", F.col("h.seed").alias("seed"), F.col("h.at").alias("place"))
    tests = tests.withColumn("ref", F.xxhash64("item_id", "item"))
    aligned = (hits.join(broadcast_if_small(tests.select("ref", "seed", "at"), 200_000), "seed")
               .select("key", "ref", (F.col("place") - F.col("at")).alias("shift")).distinct())
    # a list holds the shifts within a stretch of a document, so at most SHIFTS of them
    some = aligned.groupBy("key", "ref", F.floor(F.col("shift") / SHIFTS).alias("stretch")).agg(F.collect_list("shift").alias("shifts"))
    some = some.join(broadcast_if_small(tests.select("ref", "item_id", "item").distinct(), 200_000), "ref")
    texts = written(found.select("doc_id", "key", "text").dropDuplicates(["key"]), "leak-texts")
    each = texts.join(some, "key").select("doc_id", "key", "ref", "item_id", "item", "shifts", "text").sortWithinPartitions("key")
    best = F.max(F.struct("n_matched", (-F.col("first_word")).alias("before"), "n_aligned")).alias("b")
    whole = each.mapInArrow(_check, _LEAK).groupBy("key", "ref").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), best)
    # rows of one item_id with different texts are one item: its best leak
    return whole.groupBy("key", "item_id").agg(F.first("doc_id").alias("doc_id"), F.max("b").alias("b")).select(
        "doc_id", "key", "item_id", (-F.col("b.before")).alias("first_word"), F.col("b.n_aligned").alias("n_aligned"), F.col("b.n_matched").alias("n_matched"))


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no benchmark item leaks, with the columns of `docs`."""
    gone = fresh("leaked", docs)
    bad = written(leaks(docs, items, doc_id, text).select(F.col("key").alias(gone)).distinct(), "leaks")
    return docs.join(broadcast_if_small(bad), row_key(docs[doc_id], docs[text]) == F.col(gone), "left_anti")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "n_aligned", "n_matched")
