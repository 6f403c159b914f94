"""N-gram Jaccard join by MinHash banding.

Documents whose sets of word n-grams have a Jaccard similarity of at least
`threshold` are linked. Bands and rows are chosen for a target recall at the
threshold. Equal texts are one node (a class of copies), so copies never meet
in pairs. Nodes are shuffled on their band hashes; a bucket of two or more
nodes is a candidate group; buckets with the same members are merged. Within a
bucket all pairs are verified on their full n-gram sets, counted and united in
the task: what leaves it is one row per node, never the pairs.

Scale: buckets are cut into slots of about SLOT nodes, and every pair of slots
is a group of its own, so no task holds more than two slots of texts, whatever
the size of the bucket. A pair that meets in several buckets is counted in the
first of them. Links of different slots and buckets meet in connected
components, over one row per linked node and bucket.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A text of 1 to n - 1 words has one
n-gram, all its words. Defined cases: null texts and texts without words are
linked to nothing and are a class of their own; a null doc_id is never a class
id unless all ids of the class are null; equal rows are copies; an empty table
gives no rows; a very long text is a node like any other, verified whole; other columns are carried by `one_of_each`.

Every pair of a bucket's different texts is verified, because each document's number of links is part of the result; a bucket of
n different texts costs n * n / 2 comparisons of n-gram sets, in n * n / (2 * SLOT * SLOT) tasks of equal size.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerlens.llm.common import WORD, fresh, table, written
from sellerlens.llm.components import components
from sellerlens.llm.textops import Words, chunks, mix, release, text_bytes

N = 5
THRESHOLD = 0.8
#: 38 bands of 5 rows: one pair in three million at exactly the threshold is missed, and far fewer above it.
RECALL = 0.9999996
MAX_HASHES = 190
#: Nodes of a slot, about; a verified group has two slots at most.
SLOT = 512
_COLUMNS = 4_096


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which so many bands find a pair at the threshold with the target recall."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = ceil(log1p(-recall) / log1p(-(threshold**rows)))
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no bands reach this recall with so few hashes")
    return best


def shingles(words: Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every n-gram; texts of fewer words have one, of all their words."""
    grams, at = words.grams(n)
    found, docs = [grams], [words.doc[at]]
    for size in range(1, n):
        few = np.flatnonzero(words.count == size)
        if len(few):
            g = words.hash[words.first[few]].copy()
            for k in range(1, size):
                g = g * np.uint64(0xD6E8FEB86659FD93) + words.hash[words.first[few] + k]
            found.append(mix(g + np.uint64(size)))
            docs.append(few)
    docs, found = np.concatenate(docs), np.concatenate(found)
    order = np.argsort(docs, kind="stable")
    return found[order], docs[order]


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(20240607).integers(0, 1 << 63, size=(2, n), dtype=np.uint64)
    return made[0] * np.uint64(2) + np.uint64(1), mix(made[1])


def band_keys(texts: pa.Array, n: int, bands: int, rows: int) -> pa.Array:
    """Per text the hash of each band of its MinHash signature; none for a text without words."""
    multiply, flip = _constants(bands * rows)
    size, keys = [], []
    for lo, hi in chunks(texts):
        grams, docs = shingles(Words(*text_bytes(texts.slice(lo, hi - lo))), n)
        has, first = np.unique(docs, return_index=True)
        out = np.zeros((len(has), bands), np.uint64)
        for b in range(bands if len(has) else 0):
            key = np.full(len(has), b + 1, np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                least = np.minimum.reduceat((grams ^ flip[k]) * multiply[k], first)
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            out[:, b] = key
        count = np.zeros(hi - lo, np.int64)
        count[has] = bands
        size.append(count)
        keys.append(out.reshape(-1))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(size) if size else np.zeros(0, np.int64))])
    values = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """The least member of each member's component of a symmetric boolean matrix."""
    root = np.arange(len(linked))
    while True:
        reach = np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, reach)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links_in_group(texts: pa.Array, slots: np.ndarray, buckets: list[np.ndarray], bucket: int, cross: bool,
                   n: int, threshold: float) -> np.ndarray:
    """Which members are linked and have this bucket as their first in common; across slots only if `cross`."""
    m = len(texts)
    linked = np.zeros((m, m), bool)
    grams, docs = shingles(Words(*text_bytes(texts)), n)
    order = np.lexsort((grams, docs))
    grams, docs = grams[order], docs[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
    grams, docs = grams[keep], docs[keep]
    size = np.bincount(docs, minlength=m)
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, docs = np.unique(column[shared], return_inverse=True)[1], docs[shared]
    order = np.argsort(column, kind="stable")
    column, docs = column[order], docs[order]
    common = np.zeros((m, m), np.float32)  # counts of n-grams, exact below 2**24
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, _COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + _COLUMNS))
        has = np.zeros((m, min(_COLUMNS, width - lo)), np.float32)
        has[docs[a:b], column[a:b] - lo] = 1
        common += has @ has.T
    t = Fraction(threshold).limit_denominator(10_000)
    least = (t.numerator * size / (t.numerator + t.denominator)).astype(np.float64)
    linked = common >= least[:, None] + least[None, :] - 1e-6  # common / (size + size - common) >= t
    linked &= common > 0
    np.fill_diagonal(linked, False)
    if cross:
        linked &= slots[:, None] != slots[None, :]
    if linked.any():
        early = np.unique(np.concatenate([x[x < bucket] for x in buckets]))
        if len(early):
            seen = np.zeros((m, len(early)), np.float32)
            for k, x in enumerate(buckets):
                seen[k, np.searchsorted(early, x[x < bucket])] = 1
            linked &= (seen @ seen.T) == 0
    return linked


_GROUP = ("bucket", "i", "j")
_LINKS = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("root", T.BinaryType())])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by `keys`."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        last = np.ones(rows.num_rows, bool)
        for k in keys:
            column = rows.column(k).to_numpy()
            last &= column == column[-1]
        cut = rows.num_rows - int(last[::-1].argmin() if not last.all() else rows.num_rows)
        if cut:
            yield rows.slice(0, cut).combine_chunks()
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _verify(batches: Iterator[pa.RecordBatch], n: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for rows in whole_groups(batches, _GROUP):
        key = np.stack([rows.column(k).to_numpy() for k in _GROUP])
        starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        nodes, links, roots = [], [], []
        for lo, hi in zip(starts, [*starts[1:], rows.num_rows], strict=True):
            if hi - lo < 2:
                continue
            group = rows.slice(lo, hi - lo)
            bucket, i, j = (int(x) for x in key[:, lo])
            texts = group.column("text").combine_chunks()
            linked = links_in_group(
                texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, group.column("slot").to_numpy(),
                [np.array(x, np.int64) for x in group.column("buckets").to_pylist()], bucket, i != j, n, threshold)
            some = np.flatnonzero(linked.any(axis=1))
            if len(some):
                names, copies = group.column("node").to_pylist(), group.column("copies").to_numpy()
                root = _local_roots(linked)
                count = linked @ copies
                nodes += [names[k] for k in some]
                roots += [names[root[k]] for k in some]
                links += [int(count[k]) for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary())],
                                         ["node", "links", "root"])
    release()


def _signed(docs: DataFrame, doc_id: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    def keys(texts: pa.Array) -> pa.Array:
        return band_keys(texts, n, bands, rows)

    udf = F.arrow_udf(keys, T.ArrayType(T.LongType()))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("node"),
                       udf(F.col(text)).alias("bands"))


def similar(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, slot: int = SLOT,
            doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, node (md5 of its text), class_id, n_links, copies, stays.

    class_id is the least doc_id of all documents that links connect; n_links counts the other documents that
    are linked to this one, copies among them; stays marks the document that stands for its class.
    """
    bands, rows = choose_bands(threshold, recall)
    signed = written(_signed(docs, doc_id, text, n, bands, rows), "signed")
    nodes = written(signed.filter(F.size("bands") > 0).groupBy("node").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.min("bands").alias("bands")), "nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))
    h = F.xxhash64("node")
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.min(h).alias("least"), F.bit_xor(h).alias("all")).filter("n > 1")
    buckets = buckets.groupBy("n", "least", "all").agg(F.min("key").alias("bucket")).select("bucket", "n")
    inside = written(members.join(buckets, F.col("key") == F.col("bucket")).select("node", "bucket", "n"), "members")

    wanted = inside.groupBy("node").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"), F.collect_list(F.struct("bucket", "n")).alias("groups"))
    wanted = wanted.join(nodes.select("node", "copies", "rep"), "node")
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).withColumn("of", F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = (texts.join(wanted, (F.col("of") == F.col("node")) & F.col("id").eqNullSafe(F.col("rep")))
             .dropDuplicates(["node"]).select("node", "copies", "buckets", "text", F.explode("groups").alias("g")))
    slots = F.ceil(F.col("g.n") / slot).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), slots).cast("int")
    rows_ = texts.select("node", "copies", "buckets", "text", F.col("g.bucket").alias("bucket"), own.alias("slot"), slots.alias("slots"))
    rows_ = rows_.select("*", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("other"))
    rows_ = rows_.select("node", "copies", "buckets", "text", "bucket", "slot", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _verify(batches, n, threshold)

    found = written(rows_.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(verify, _LINKS), "found")
    stars = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = (nodes.select("node", "copies", "rep")
               .join(stars.withColumnRenamed("a", "node"), "node", "left")
               .join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
               .withColumn("root", F.coalesce("root", "node")))
    first = F.min(F.struct(F.col("rep").isNull().alias("nameless"), "rep", "node"))
    roots = classes.groupBy("root").agg(F.min("rep").alias("class_id"), first.alias("first"))
    named = classes.join(roots, "root").select(
        "node", "class_id", "copies", "rep", (F.col("first.node") == F.col("node")).alias("stays"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "node").join(written(named, "classes"), "node", "left").select(
        "doc_id", "node", F.coalesce("class_id", F.when(F.col("copies").isNull(), F.col("doc_id"))).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("copies"),
        (F.col("copies").isNull() | (F.col("stays") & F.col("doc_id").eqNullSafe(F.col("rep")))).alias("stays"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """`docs` with one document of each class, the one of the least id (of equal ids, the least text hash).

    Documents without words all stay, equal rows too; other rows equal in id and text stay once.
    """
    gone = similar(docs, doc_id=doc_id, text=text, **how).filter(~F.col("stays"))
    key, row = fresh("key", docs), fresh("row", docs)
    as_key = lambda i, t: F.concat_ws("/", F.coalesce(i.cast("string"), F.lit("-")), t)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row))
    worded = F.coalesce(F.col(row)[text].rlike(WORD), F.lit(False))
    kept = rows.filter(worded).select(row, as_key(F.col(row)[doc_id], F.md5(F.coalesce(F.col(row)[text], F.lit("")).cast("binary"))).alias(key))
    gone = written(gone.select(as_key(F.col("doc_id"), F.lower(F.hex("node"))).alias(key)).distinct(), "gone")
    kept = kept.join(gone, key, "left_anti").dropDuplicates([key]).select(row)
    return kept.union(rows.filter(~worded)).select(f"{row}.*")


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies")
