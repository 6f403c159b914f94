"""Substring dedup with prefix-partitioned suffix trees, over words.

A word is removed if it is covered by a window of WINDOW consecutive words whose
sequence also starts in a document with a smaller doc_id. Windows are judged on
the input.

1. Prefixes. Every window has an anchor: its least (by hash) run of GRAM words.
   A window's prefix is the text up to the end of its anchor, GRAM to WINDOW words long
   and given by the window's own words, so equal windows share it. Windows with
   one anchor are a stretch of the document; about one word in 22 is an anchor.
   Only anchors that two documents have go on; the rest of the corpus ends here.
2. Equal stretches are counted first (partial aggregation), and all but the
   one of the least doc_id are repeats as a whole. So copies, and passages that a third of all
   documents share, never gather in one group.
3. Groups. The different stretches of one prefix are a group, dealt to one task. A group of more than GROUP
   stretches (a common line in ever other surroundings) doesn't fit: its prefix is lengthened by STEPS words on the side of
   the anchor on which each window has more of its own words (two halves of a stretch, therefore), step by step, until the
   parts fit; what still doesn't is cut by the windows' whole WINDOW words, the longest prefix there is.
4. Subtrees. A group's suffixes are its windows' starts, and its tree, cut off at depth WINDOW, is built level by level by
   prefix doubling (1, 2, 4, ..., 32, WINDOW words). The deep internal nodes, those at the last level with leaves of
   several documents, are the repeats; runs of them are the maximal ones. Under a prefix of WINDOW words a tree is one node,
   whose least document is a grouped minimum.

Tables that an aggregate of theirs is joined back to are written first, so Spark can split the tasks of a common prefix.

Defined cases: null and empty texts have no words; a null doc_id counts as
larger than all others and is returned as null; rows equal in doc_id do not
remove from each other, whatever their texts; repeats within one document stay;
texts below WINDOW words are kept whole; a very long text is cut and rebuilt alone; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerlens.llm.common import discard, table, written
from sellerlens.llm.op06_ngram_join import whole_groups
from sellerlens.llm.textops import Words, _powers, chunks, mix, text_bytes

WINDOW = 50
GRAM = 8
#: Stretches of a group that one task takes at once; about 100 words each.
GROUP = 4_096
#: By how many words a prefix is lengthened, in all; a window has 21 words at least on one side of its anchor.
STEPS = (8, 16, 21)
_LAST = (1 << 63) - 1

_ANCHOR = T.StructType([
    T.StructField("did", T.LongType()), T.StructField("th", T.LongType()), T.StructField("first", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("body", T.LongType()),
    T.StructField("anchor", T.IntegerType()),
])
_SPAN = _ANCHOR.names[:4]
_RUN = T.StructType([T.StructField("gram", T.LongType()), T.StructField("body", T.LongType()), T.StructField("offset", T.IntegerType()), T.StructField("windows", T.IntegerType())])
#: A run of windows of a stretch with its words; `keys` are its prefixes: the anchor, or of a `large` group the ever longer ones.
_STRETCH = T.StructType([*_RUN.fields, T.StructField("did", T.LongType()), T.StructField("large", T.BooleanType()),
                         T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("words", T.StringType())])
_LEAF = T.StructType([*_RUN.fields, T.StructField("did", T.LongType()), T.StructField("prefix", T.LongType())])
_KEPT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def run_hashes(words: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each run of words from `start` to `end`."""
    up, down = _powers(len(words.hash) + 1)
    total = np.zeros(len(words.hash) + 1, np.uint64)
    np.cumsum(words.hash * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def stretches(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of every stretch of windows that share an anchor."""
    n = len(words.start) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    h = words.hash
    g = h[: len(h) - gram + 1].copy()
    for k in range(1, gram):
        g *= np.uint64(0xD6E8FEB86659FD93)
        g += h[k : k + len(g)]
    mask = np.uint64((1 << len(g).bit_length()) - 1)
    least = (mix(g) & ~mask) | np.arange(len(g), dtype=np.uint64)  # the leftmost of equal ones
    width, want = 1, window - gram + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if want > width:
        least = np.minimum(least[: width - want], least[want - width :])
    at = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :])
    anchor = (least[at] & mask).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(at) else at
    return anchor[cut], at[cut], at[np.concatenate([cut[1:], [len(at)]]).astype(np.int64) - 1] if len(at) else at


def _anchors(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _ANCHOR.fields]
    for batch in batches:
        did, th, texts = (batch.column(k) for k in range(3))
        for lo, hi in chunks(texts):
            w = Words(*text_bytes(texts.slice(lo, hi - lo)))
            anchor, first, last = stretches(w, window, gram)
            doc = w.doc[first]
            yield pa.RecordBatch.from_arrays([
                did.slice(lo, hi - lo).take(pa.array(doc)), th.slice(lo, hi - lo).take(pa.array(doc)),
                pa.array((first - w.first[doc]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)),
                pa.array(run_hashes(w, anchor, anchor + gram).view(np.int64)),
                pa.array(run_hashes(w, first, last + window).view(np.int64)), pa.array((anchor - first).astype(np.int32)),
            ], names)


def _cut(batches: Iterator[pa.RecordBatch], window: int, gram: int, group: int) -> Iterator[pa.RecordBatch]:
    """The words of each wanted stretch; one of too large a group comes as two runs, by the side on which their prefixes grow."""
    steps = [x for x in STEPS if 2 * x <= window - gram]
    half = (window - gram) // 2  # windows whose anchor is at most so far in have as many words behind it
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in _STRETCH.fields}
        size = 0
        for did, text, cuts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = text.encode().split()
            for c in cuts:
                first, n, at = c["first"], c["size"], c["first"] + c["anchor"]
                runs = [(0, n, [c["gram"]])]
                if c["n"] > group:
                    # the windows that begin `half` words before the anchor or later have more words behind it
                    turn = min(n, max(0, at - half - first))
                    left = [_hash(words[at - x : at + gram], 2 * x) for x in steps] if turn else []
                    right = [_hash(words[at : at + gram + x], 2 * x + 1) for x in steps] if turn < n else []
                    runs = [r for r in ((0, turn, left), (turn, n - turn, right)) if r[1]]
                for offset, windows, keys in runs:
                    run = b" ".join(words[first + offset : first + offset + windows + window - 1])
                    size += len(run)
                    for name, value in zip(out, (c["gram"], c["body"], offset, windows, did, c["n"] > group, keys, run.decode()), strict=True):
                        out[name].append(value)
            if size > 4 << 20:
                yield _batch(out)
                out, size = {k: [] for k in out}, 0
        yield _batch(out)


def _hash(words: list[bytes], salt: int) -> int:
    """A signed 64-bit hash of a run of words and a number."""
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8, salt=salt.to_bytes(4, "little")).digest(), "little", signed=True)


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"offset": pa.int32(), "windows": pa.int32(), "words": pa.string(), "large": pa.bool_(), "keys": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The hash of all words of each window of runs: the longest prefix."""
    for batch in batches:
        w = Words(*text_bytes(batch.column("words")))
        size = batch.column("windows").to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        leaf = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = w.first[owner] + leaf
        of = pa.array(owner)
        yield pa.RecordBatch.from_arrays([
            batch.column("gram").take(of), batch.column("body").take(of), pa.array((batch.column("offset").to_numpy()[owner] + leaf).astype(np.int32)),
            pa.array(np.ones(len(at), np.int32)), batch.column("did").take(of), pa.array(run_hashes(w, at, at + window).view(np.int64))], _LEAF.names)


def _named(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A number for each different pair of numbers under 2**32."""
    return np.unique((high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64), return_inverse=True)[1]


def tree_nodes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix of a word sequence, its node at `depth` words (or fewer, at the end), by prefix doubling."""
    names = np.unique(symbols, return_inverse=True)[1] + 1
    width = 1

    def behind(k: int) -> np.ndarray:
        return np.concatenate([names[k:], np.zeros(min(k, len(names)), names.dtype)])

    while 2 * width <= depth:
        names = _named(names, behind(width)) + 1
        width *= 2
    return _named(names, behind(depth - width)) if width < depth else names


def _subtrees(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for rows in whole_groups(batches, ("key",)):
        for lo, hi in _group_runs(rows.column("key").to_numpy(), 8 * GROUP):
            yield _repeats(rows.slice(lo, hi - lo), window)


def _group_runs(keys: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole groups, of about `limit` rows or one group."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    lo = 0
    while lo < len(keys):
        ends = starts[(starts > lo) & (starts <= lo + limit)]
        later = starts[starts > lo]
        hi = len(keys) if lo + limit >= len(keys) or not len(later) else int(ends[-1] if len(ends) else later[0])
        yield lo, hi
        lo = hi


def _repeats(rows: pa.Table, window: int) -> pa.RecordBatch:
    """The runs of windows, in groups of whole trees, whose node has a leaf of a smaller document."""
    did, size, gram, body, key, offset = (rows.column(k).to_numpy() for k in ("did", "windows", "gram", "body", "key", "offset"))
    texts = rows.column("words").combine_chunks()
    w = Words(*text_bytes(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts))
    nodes = tree_nodes(w.hash, window)
    leaf = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)  # window within its stretch
    owner = np.repeat(np.arange(len(size)), size)
    group = np.unique(key, return_inverse=True)[1]
    node = _named(group[owner], nodes[w.first[owner] + leaf])
    order = np.argsort(node, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(node[order]) > 0])) if len(order) else order
    least = np.minimum.reduceat(did[owner[order]], begin) if len(order) else order
    again = did[owner] > least[node]
    at = np.flatnonzero(again)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(owner[at]) > 0)
    run = np.flatnonzero(new)
    o = owner[at[run]]
    return pa.RecordBatch.from_arrays([
        pa.array(gram[o]), pa.array(body[o]), pa.array((offset[o] + leaf[at[run]]).astype(np.int32)),
        pa.array(np.diff(np.append(run, len(at))).astype(np.int32)),
    ], _RUN.names)


def _ranked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("did"), F.xxhash64("text").alias("th"), "text")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """did (doc_id, or the largest long), th (text hash), first, size: `size` repeated windows from word `first` on."""
    ranked = _ranked(docs, doc_id, text).select("did", "th", "text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _anchors(batches, window, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut(batches, window, gram, group)

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _subtrees(batches, window)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _windows(batches, window)

    every = written(ranked.mapInArrow(anchors, _ANCHOR), "anchors")
    shared = every.groupBy("gram").agg(F.min("did").alias("a"), F.max("did").alias("b")).filter("a < b").select("gram")
    shared = written(shared, "shared-grams")
    found = written(every.join(shared, "gram").select(*_ANCHOR.names), "shared-anchors")
    discard(every, shared)
    bodies = written(found.groupBy("gram", "body").agg(F.min("did").alias("least")), "bodies")
    groups = written(bodies.groupBy("gram").agg(F.count("*").alias("n")), "groups")
    judged = written(found.join(bodies.join(groups, "gram"), ["gram", "body"]), "stretches")
    discard(found, bodies, groups)
    whole = judged.filter("least < did").select(*_SPAN)

    places = judged.filter("least = did and n > 1")
    one = places.dropDuplicates(["gram", "body"])
    wanted = one.groupBy("did", "th").agg(F.collect_list(F.struct("gram", "body", "first", "size", "anchor", "n")).alias("cuts"))
    texts = ranked.join(wanted, ["did", "th"]).dropDuplicates(["did", "th"])
    cuts = written(texts.select("did", "text", "cuts").mapInArrow(cut, _STRETCH), "cuts")

    fit = [cuts.filter(~F.col("large")).withColumn("key", F.element_at("keys", 1))]
    rest = cuts.filter("large")
    some_large = bool(rest.limit(1).count())
    for k in range(sum(2 * x <= window - gram for x in STEPS) if some_large else 0):
        rest = rest.withColumn("key", F.element_at("keys", k + 1))
        sizes = written(rest.groupBy("key").agg(F.count("*").alias("n")), "prefixes")
        sized = rest.join(sizes, "key")
        fit.append(sized.filter(F.col("n") <= group).select(*cuts.columns, "key"))
        rest = written(sized.filter(F.col("n") > group).select(*cuts.columns), "long-prefixes")
    fitting = reduce(DataFrame.unionByName, fit)
    runs = fitting.repartition("key").sortWithinPartitions("key").select(*_STRETCH.names, "key").mapInArrow(subtrees, _RUN)
    if some_large:
        ends = written(rest.mapInArrow(leaves, _LEAF), "leaves")
        least = written(ends.groupBy("prefix").agg(F.min("did").alias("least"), F.max("did").alias("most")).filter("least < most"), "least")
        runs = runs.union(ends.join(least.select("prefix", "least"), "prefix").filter("did > least").select(*_RUN.names))
    return whole.union(places.join(runs, ["gram", "body"]).select("did", "th", (F.col("first") + F.col("offset")).alias("first"), F.col("windows").alias("size")))


def _keep(texts: pa.Array, spans: pa.Array, window: int) -> Iterator[tuple[int, list[bytes]]]:
    """(words, kept words) of each text."""
    for text, runs in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        words = (text or "").encode().split()
        kept = words
        if runs:
            gone = np.zeros(len(words) + 1, np.int64)
            for r in runs:
                gone[r["first"]] += 1
                gone[min(len(words), r["first"] + r["size"] + window - 1)] -= 1
            kept = [words[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
        yield len(words), kept


def _with_spans(docs: DataFrame, spans: DataFrame, doc_id: str, text: str) -> DataFrame:
    # Rows equal in id and text have the same spans: a set, so that a list is no longer than one text's stretches.
    runs = spans.groupBy("did", "th").agg(F.collect_set(F.struct("first", "size")).alias("runs"))
    return _ranked(docs, doc_id, text).join(runs, ["did", "th"], "left")


def dedup_text(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the kept words of each document, joined by one blank."""
    def kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([b" ".join(k).decode() for _, k in _keep(texts, spans, window)], pa.string())

    spans = repeated_spans(docs, window, doc_id=doc_id, text=text)
    return _with_spans(docs, spans, doc_id, text).select("doc_id", F.arrow_udf(kept, T.StringType())("text", "runs").alias("text"))


def dedup_digest(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 of what `dedup_text` keeps."""
    def digest(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = [(n, n - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for n, k in _keep(texts, spans, window)]
        n, removed, sha = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=_KEPT.names)

    spans = repeated_spans(docs, window, doc_id=doc_id, text=text, **how)
    return _with_spans(docs, spans, doc_id, text).select("doc_id", F.arrow_udf(digest, _KEPT)("text", "runs").alias("k")).select("doc_id", "k.*")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_digest(table(spark, sf_dir, "documents"))
