"""Ranked lexical search by pipelined term partitioning.

The terms of the items are dealt to OWNERS, rarest first: an owner holds the posting
lists of the terms whose share of the documents lies in its range. Bundles of items
visit the owners one after another. A bundle carries sparse accumulators, the score so
far of (item, document), meets the owner's postings by cogroup, adds the owner's integer
contributions, and goes on; behind the last owner the best documents of each item are chosen.

Nothing that can still be among the best is left out. An owner's terms have known
greatest contributions, so behind each owner every item has a floor (its k-th best score so
far) and a rest (all that later owners may add): an accumulator whose score plus rest
is below the floor can't reach the best, nor tie with them, and a document that isn't carried yet is let in only
while the rest alone reaches the floor.

Scale: documents are scanned once, in blocks of BLOCK_DOCS; a posting list is cut by block, so the
postings of a term that is in every document lie in as many rows as there are blocks, and a bundle
of BUNDLE_ITEMS items visits an owner block by block. A cogroup key is (block, bundle): its size is bounded by these two
parameters, whatever the terms' frequencies. Postings travel as arrays, one row a block and owner. The items' terms are
broadcast, in passes of at most PASS_ITEMS items and PASS_TERMS (item, term) pairs (one larger item is a pass of its own); each
pass scans the documents. What is collected is one number per item, or a few per term, of a pass.

Terms are the maximal runs of characters outside `\\x00-\\x2F \\x3A-\\x40 \\x5B-\\x60 \\x7B-\\x7F`, A-Z lower-cased,
known by their 64-bit hash and their length in bytes. With N documents that hold a term, L terms in them, n terms in a document, df and tf:

    w = floor(1000 * ln((2N + 2) / (2df + 1)))    m = 100 - 90 + (90 * n * N) div L
    score = sum of w * ((1000000000 * tf) div (1000 * tf + 8 * m)) over an item's different terms

Defined cases: null and empty texts have no term, neither score nor count among the N; a
null doc_id is reported as null and comes before all others among equal scores; rows of equal doc_id are documents of
their own, and equal in score too, are interchangeable; items without a term have no rows; a null item_id is an item of its own, and
rows of equal item_id are items of their own, ranked each for itself; one very long text is a block of its own size;
an empty table of documents or items gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerlens.llm.common import bound_batches, discard, table, written
from sellerlens.llm.textops import Words, chunks, mix, text_bytes

TOP = 10
#: Owner k holds the terms in at most this share of the documents (and in more than owner k - 1's).
OWNERS = (2.0**-10, 2.0**-7, 2.0**-5, 2.0**-3, 1.0)
BLOCK_DOCS, BLOCK_BYTES = 8_192, 32 << 20
BUNDLE_ITEMS = 256
PASS_ITEMS, PASS_TERMS = 1 << 16, 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Fixed ranges of the contract: ASCII characters that aren't letters or digits.
_BREAK = np.zeros(256, bool)
for _first, _last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _BREAK[_first : _last + 1] = True

_INTS, _LONGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
#: A block: its documents (id, null or not, terms in all), its postings by term, and its counts for df and L.
_BLOCK = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("doc_ids", _LONGS), T.StructField("n", _LONGS),
    T.StructField("terms", _INTS), T.StructField("sizes", _INTS), T.StructField("docs", _INTS), T.StructField("tf", _INTS),
    T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType()),
])
_BUNDLE = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("bundle", T.IntegerType()),
    T.StructField("items", _INTS), T.StructField("docs", _INTS), T.StructField("scores", _LONGS),
    T.StructField("best_items", _INTS), T.StructField("best", _LONGS),
])
_FOUND = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def terms_of(texts: pa.Array) -> Words:
    data, offs = text_bytes(texts)
    return Words(_FOLD[data], offs, _BREAK)


def term_keys(words: Words) -> np.ndarray:
    """A term's key: its hash and its length."""
    return mix(words.hash ^ (words.end - words.start).astype(np.uint64))


@dataclass(frozen=True)
class Items:
    """The items of a pass: `keys` of all terms (ascending), and each item's terms by number in `first`, `terms`."""

    ids: list
    keys: np.ndarray
    first: np.ndarray
    terms: np.ndarray

    @staticmethod
    def of(ids: list, texts: list) -> Items:
        w = terms_of(pa.array(texts, pa.large_string()))
        keys, number = np.unique(term_keys(w), return_inverse=True)
        pairs = np.unique(w.doc * max(1, len(keys)) + number)
        first = np.searchsorted(pairs // max(1, len(keys)), np.arange(len(ids) + 1))
        return Items(ids, keys, first, (pairs % max(1, len(keys))).astype(np.int32))


def _blocks(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of documents with their postings of the terms in `keys`."""
    ids, sizes, found, counts, held = [], [], [], [], 0

    def block() -> pa.RecordBatch:
        n = np.concatenate(sizes)
        first = np.cumsum([0, *map(len, sizes)])
        doc = np.concatenate([d + f for (d, _), f in zip(found, first, strict=False)])
        term = np.concatenate([t for _, t in found])
        tf = np.concatenate(counts)
        order = np.lexsort((doc, term))
        terms, at = np.unique(term, return_counts=True)
        row = [pa.array([0], pa.int64())]
        for values, kind in ((pa.concat_arrays(ids), pa.int64()), (n, pa.int64()), (terms, pa.int32()), (at, pa.int32()),
                             (doc[order], pa.int32()), (tf[order], pa.int32())):
            values = pa.array(values) if isinstance(values, np.ndarray) else values
            row.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind)))
        row += [pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())]
        return pa.RecordBatch.from_arrays(row, names=_BLOCK.names)

    for batch in batches:
        for lo, hi in chunks(batch.column(1)):
            w = terms_of(batch.column(1).slice(lo, hi - lo))
            key = term_keys(w)
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            hit = np.flatnonzero(keys[at] == key) if len(keys) else np.zeros(0, np.int64)
            pair, tf = np.unique(w.doc[hit] * np.int64(max(1, len(keys))) + at[hit], return_counts=True)
            ids.append(batch.column(0).slice(lo, hi - lo))
            sizes.append(w.count)
            found.append((pair // max(1, len(keys)), pair % max(1, len(keys))))
            counts.append(tf)
            held += len(w.data)
            if sum(map(len, sizes)) >= BLOCK_DOCS or held >= BLOCK_BYTES:
                yield block()
                ids, sizes, found, counts, held = [], [], [], [], 0
    if ids:
        yield block()


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with n terms."""
    return 10 + (90 * n.astype(np.int64) * n_docs) // max(1, n_terms)


def parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score for each unit of its weight."""
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _lists(values: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow list column as arrays."""
    flat, offs = values.flatten().to_numpy(zero_copy_only=False), values.offsets.to_numpy()
    return np.split(flat, np.cumsum(np.diff(offs))[:-1]) if len(values) else []


def _greatest_parts(blocks: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """term, part: the most that a term adds for a unit of its weight, anywhere."""
    def block_parts(n: pa.Array, terms: pa.Array, sizes: pa.Array, docs: pa.Array, tf: pa.Array) -> pa.Array:
        out = []
        for n_, t, s, d, f in zip(*map(_lists, (n, terms, sizes, docs, tf)), strict=True):
            value = parts(f, lengths(n_, n_docs, n_terms)[d])
            out.append(np.maximum.reduceat(value, np.cumsum(s) - s) if len(t) else value)
        offsets = pa.array(np.cumsum([0, *map(len, out)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *out])))

    greatest = F.arrow_udf(block_parts, _LONGS)("n", "terms", "sizes", "docs", "tf")
    each = blocks.select(F.explode(F.arrays_zip("terms", greatest.alias("parts"))).alias("x"))
    return each.select(F.col("x.terms").alias("term"), F.col("x.parts").alias("part")).groupBy("term").agg(F.max("part").alias("part"))


def _visit(spark: SparkSession, blocks: DataFrame, carried: DataFrame | None, owned: np.ndarray, items: Items, weights: np.ndarray,
           floor: np.ndarray, rest: np.ndarray, totals: tuple[int, int], k: int) -> DataFrame:
    """The bundles behind one owner: their accumulators with the contributions of the `owned` terms."""
    shared = spark.sparkContext.broadcast((owned, items.first, items.terms, weights, floor, rest))
    n_bundles = -(-len(items.ids) // BUNDLE_ITEMS)

    def owned_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value[0]
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                terms, sizes, docs, tf = (x[0] for x in (_lists(one.column(c)) for c in ("terms", "sizes", "docs", "tf")))
                keep = mine[terms]
                each = np.repeat(keep, sizes)
                columns = [one.column("block"), one.column("n")] + [
                    pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, pa.int32()))
                    for v in (terms[keep], sizes[keep], docs[each], tf[each])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "n", "terms", "sizes", "docs", "tf"])

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("n", _LONGS)]
                          + [T.StructField(c, _INTS) for c in ("terms", "sizes", "docs", "tf")])
    postings = blocks.select("block", "n", "terms", "sizes", "docs", "tf").mapInArrow(owned_postings, schema)
    postings = postings.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))))
    if carried is None:
        carried = spark.createDataFrame([], _BUNDLE)

    def add(bundle: pa.Table, owner: pa.Table) -> pa.Table:
        """Both tables have one row for a (block, bundle); the bundle's may be missing before the first owner."""
        _, first, item_terms, weights, floor, rest = shared.value
        head = owner if owner.num_rows else bundle
        block, number = head.column("block")[0].as_py(), head.column("bundle")[0].as_py()
        lists = lambda t, *names: [_lists(t.column(c).combine_chunks())[0] for c in names]
        held, docs, scores = lists(bundle, "items", "docs", "scores") if bundle.num_rows else (np.zeros(0, np.int64),) * 3
        n, terms, sizes, at, tf = lists(owner, "n", "terms", "sizes", "docs", "tf") if owner.num_rows else (np.zeros(0, np.int64),) * 5
        value = parts(tf, lengths(n, *totals)[at]) * np.repeat(weights[terms], sizes)
        ends = np.cumsum(sizes)
        slot = np.full(len(weights), -1)
        slot[terms] = np.arange(len(terms))
        size = int(max(docs.max(initial=-1) + 1, len(n)))
        out: list[tuple[np.ndarray, ...]] = []
        cut = np.searchsorted(held, np.arange(number * BUNDLE_ITEMS, min((number + 1) * BUNDLE_ITEMS, len(first) - 1) + 1))
        for j, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            item = number * BUNDLE_ITEMS + j
            score = np.zeros(size, np.int64)
            mine = docs[lo:hi]
            score[mine] = scores[lo:hi]
            here = slot[item_terms[first[item] : first[item + 1]]]
            for t in here[here >= 0]:
                span = slice(ends[t] - sizes[t], ends[t])
                score[at[span]] += value[span]
            # before this owner all of its terms were in the rest: new documents came in if that reached the floor
            open_ = rest[0, item] >= floor[item]
            at_all = np.flatnonzero(score) if open_ else mine
            reach = at_all[score[at_all] + rest[1, item] >= floor[item]]
            out.append((np.full(len(reach), item), reach, score[reach]))
        columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)]
        items_, docs_, scores_ = columns
        order = np.lexsort((-scores_, items_))
        place = np.arange(len(order)) - np.searchsorted(items_[order], items_[order])
        best = order[place < k]
        best = best[scores_[best] >= floor[items_[best]]]
        values = (items_, docs_, scores_, items_[best], scores_[best])
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        return pa.table([pa.array([block], pa.int64()), pa.array([number], pa.int32())]
                        + [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v).cast(kind))
                           for v, kind in zip(values, kinds, strict=True)], _BUNDLE.names)

    key = ("block", "bundle")
    out = carried.groupBy(*key).cogroup(postings.groupBy(*key)).applyInArrow(add, _BUNDLE)
    return written(out, "bundles")


def _floors(bundles: DataFrame, n_items: int, k: int) -> np.ndarray:
    """The k-th best score of each item so far; 1 (any score) where fewer documents have one."""
    each = bundles.select(F.explode(F.arrays_zip("best_items", "best")).alias("x")).select("x.best_items", "x.best")
    ranked = each.withColumn("r", F.row_number().over(W.partitionBy("best_items").orderBy(F.col("best").desc())))
    found = ranked.filter(F.col("r") <= k).filter(F.col("r") == k).select("best_items", "best").toArrow()
    out = np.ones(n_items, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return np.maximum(out, 1)


def _search(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """(item number, doc_id, score) of each item's k best documents, and of those equal to the last."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items.keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks(batches, shared.value)

    blocks = docs.mapInArrow(scan, _BLOCK).withColumn("block", F.monotonically_increasing_id())
    blocks = written(blocks, "postings")
    total = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    each = blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy(F.col("x.terms").alias("term"))
    counted = each.agg(F.sum("x.sizes").alias("df"))
    stats = counted.join(_greatest_parts(blocks, *total), "term").toArrow()
    df, weights, top_part = (np.zeros(len(items.keys), np.int64) for _ in range(3))
    term = stats.column("term").to_numpy()
    df[term], top_part[term] = stats.column("df").to_numpy(), stats.column("part").to_numpy()
    weights[term] = [weight(total[0], int(x)) for x in df[term]]

    owner = np.searchsorted(np.array(OWNERS), df / max(1, total[0]))
    owner = np.where((df > 0) & (weights > 0), np.minimum(owner, len(OWNERS) - 1), -1)
    most = weights * top_part
    n_items = len(items.ids)
    item_of = np.repeat(np.arange(n_items), np.diff(items.first))

    def later(k: int) -> np.ndarray:
        """The most that owners from the k-th on add to each item's scores."""
        return np.bincount(item_of, weights=np.where(owner >= k, most, 0)[items.terms], minlength=n_items).astype(np.int64)

    floor, carried = np.ones(n_items, np.int64), None
    for stage in range(len(OWNERS)):
        if not (owner == stage).any():
            continue
        rest = np.stack([later(stage), later(stage + 1)])
        before, carried = carried, _visit(spark, blocks, carried, owner == stage, items, weights, floor, rest, tuple(total), k)
        discard(before)
        floor = np.maximum(floor, _floors(carried, n_items, k))
    if carried is None:
        return spark.createDataFrame([], _FOUND)
    ids = blocks.select("block", "doc_ids")
    got = carried.select("block", F.explode(F.arrays_zip("items", "docs", "scores")).alias("x"))
    got = got.select("block", F.col("x.items").alias("item"), F.col("x.docs").alias("doc"), F.col("x.scores").alias("score"))
    last = spark.createDataFrame(pa.table([pa.array(range(n_items), pa.int32()), pa.array(floor)], ["item", "floor"]))
    got = got.join(F.broadcast(last), "item").filter("score >= floor and score > 0")
    return got.join(ids, "block").select("item", F.element_at("doc_ids", F.col("doc") + 1).alias("doc_id"), "score")


def _passes(items: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """The items in passes that are small enough to broadcast, one held at a time."""
    ids, texts, held = [], [], 0
    for row in items.select(item_id, text).toLocalIterator():
        size = len(row[1] or "") // 2 + 1  # a term takes two characters at least, with what ends it
        if ids and (len(ids) >= PASS_ITEMS or held + size > PASS_TERMS):
            yield Items.of(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        held += size
    if ids:
        yield Items.of(ids, texts)


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    for one in _passes(items, item_id, item_text):
        names = spark.createDataFrame(pa.table([pa.array(range(len(one.ids)), pa.int32()), pa.array(one.ids, pa.int64())], ["item", "item_id"]))
        top = _search(rows, one, k).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        out = out.unionByName(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = """
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
    SELECT row, doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), postings AS (
    SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), sizes AS (
    SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY row
), totals AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, docs
), items AS (
    SELECT DISTINCT item, item_id, term FROM (
        SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
        FROM benchmark)
), scores AS (
    SELECT item, item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
    FROM items JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (row), totals
    GROUP BY ALL
), ranks AS (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranks WHERE rank <= 10
"""
