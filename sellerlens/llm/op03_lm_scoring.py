"""Language-model scoring by cross-entropy difference.

Two bigram models, of the target documents and of the background (all
documents), share one vocabulary, order, cut-offs and smoothing, and the background counts are scaled
to the target's mass, so the two differ in the text alone. A
document's score is its mean loss under the target model less that under the
background, in bits a token: below 0 it is more like the target than like the corpus.

The vocabulary is every word that the corpus has MIN_WORD times, so it grows with it; rarer words are one
class in both models. A text is predicted from a start mark to an end mark:

    p(w)     = (c(w) + 1) / (M + V + 2)         M tokens in all, V words, the rare class and the end mark
    p(w | v) = (c(v, w) + STRENGTH * p(w)) / (c(v) + STRENGTH)

with c(v, w) of all words of the vocabulary and both marks, from MIN_PAIR occurrences on, and c(v) their sum. So the loss of a text is
a sum of independent terms: one for each word, -log2 p(w) + log2((c(w) + STRENGTH) / STRENGTH), and one for each
pair that is counted, -log2(1 + c(v, w) / (STRENGTH * p(w))); a term is a row of a table, known by its key.

Scale: counts are exact, over all documents, summed in each task and again before they are shuffled. There are fewer than BROADCAST_WORDS words
of a share above 1 / BROADCAST_WORDS, and fewer than FREQUENT_PAIRS pairs of a share above 1 / FREQUENT_PAIRS, whatever the corpus: their terms are broadcast and
added up where the texts are read. Each other word and counted pair of a text is a row (document, key) that is joined with
the table of terms; none of these keys has more than such a share of the rows. The table grows with the corpus, and is never collected.
Two filters of a fixed size (FILTER_BITS) spare the shuffles what can't matter: pairs of a word that is rarer than a counted pair, and, where
texts are scored, pairs that aren't counted, whose term is 0. A corpus that fills them sends more rows; results stay the same.

Words are `[^\\x20\\x09-\\x0D]+`, known by their 63-bit hash.
Defined cases: null and empty texts have no words, losses 0 and score 0; a very long text is a sum like any other; a null
doc_id is in the background only; of several labels of one id the least counts; without
target documents the target model is the uniform one; equal rows count as often
as they come, and have a row each; an empty table gives no rows; other columns are not read; documents outside the
background may be scored, their new words are words of 0 occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerlens.llm.common import bound_batches, discard, table, written
from sellerlens.llm.op10_decontamination import _passes, seed_filter
from sellerlens.llm.pretokens import HashTable
from sellerlens.llm.textops import Words, chunks, mix, text_bytes
from sellerlens.plans.broadcast import broadcast_if_small

MIN_WORD, MIN_PAIR = 3, 5
STRENGTH = 200.0
#: Words and pairs of a larger share than one in so many are broadcast.
BROADCAST_WORDS, FREQUENT_PAIRS = 1 << 20, 1 << 21
#: For a smaller model: only words of a larger share than one in so many have pairs, and are broadcast. None: all words have pairs.
FREQUENT_WORDS: int | None = None
#: Size of the filters of words and of pairs.
FILTER_BITS = 1 << 26
#: Different words that a task counts, and pairs that it gathers, before it sends them on.
TASK_WORDS, TASK_PAIRS = 500_000, 1_000_000

_COUNT = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "n", "n_target")])
_PAIR = T.StructType([T.StructField(c, T.LongType()) for c in ("v", "w", "n", "n_target")])
_TERM = T.StructType([T.StructField("target", T.FloatType()), T.StructField("background", T.FloatType())])
_PART = T.StructType([T.StructField(c, T.LongType()) for c in ("row", "key", "doc_id", "n_words")]
                     + [T.StructField(c, T.DoubleType()) for c in ("target", "background")])
#: Keys that count the texts with words, and all words; no word has them.
_TEXTS, _ALL = 0, 1
#: The code of a word that has no pairs; no word's key but by chance.
_NONE = np.iinfo(np.int64).min


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of words: below 0, so that no pair has one."""
    return (hashes | np.uint64(1 << 63)).view(np.int64)


def _rows(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 50_000]) for c in columns], names)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n, n_target: how often each word is there, and in targets."""
    keys, n = np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
    for batch in batches:
        is_target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi in chunks(batch.column(0)):
            w = Words(*text_bytes(batch.column(0).slice(lo, hi - lo)))
            full = w.count > 0
            new, at = np.unique(word_keys(w.hash), return_inverse=True)
            target, of = is_target[lo + w.doc], is_target[lo:hi]
            times = [np.bincount(x, minlength=len(new)) for x in (at, at[target])]
            new = np.append(new, (_TEXTS, _ALL))
            times = [np.append(times[0], (full.sum(), len(at))), np.append(times[1], (full[of].sum(), target.sum()))]
            merged, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            n = np.stack([np.bincount(back, weights=np.concatenate(x), minlength=len(merged)) for x in zip(n, times, strict=True)]).astype(np.int64)
            keys = merged
            if len(keys) > TASK_WORDS:
                yield from _rows(_COUNT.names, keys, *n)
                keys, n = keys[:0], n[:, :0]
    yield from _rows(_COUNT.names, keys, *n)


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of pairs, of the codes of their words: from 0 on, so that no word has one."""
    h = mix(before.astype(np.int64).view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return (mix(h + word.astype(np.int64).view(np.uint64)) >> np.uint64(1)).view(np.int64)


@dataclass(frozen=True)
class Ids:
    """Codes of words: the numbers of the frequent ones, then the marks `start` and `end`; any other word's key, below 0."""

    lookup: HashTable
    start: int

    @property
    def end(self) -> int:
        return self.start + 1

    def of(self, words: Words) -> np.ndarray:
        keys = word_keys(words.hash)
        number = self.lookup.find(keys.view(np.uint64)).astype(np.int64)
        return np.where(number >= 0, number, keys)

    def pairs(self, words: Words, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, code before, code) of the pairs of words and marks in a chunk."""
        full = np.flatnonzero(words.count)
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[words.first[full]] = self.start
        before = np.concatenate([before, codes[words.first[full + 1] - 1]])
        return np.concatenate([words.doc, full]), before, np.concatenate([codes, np.full(len(full), self.end)])


@dataclass(frozen=True)
class Models:
    """Both models as terms: arrays (target, background) by frequent word, by frequent pair, of a new word and of both marks, and the table of all others.

    terms: key, target, background; `counted` is a filter of the pairs' keys; `size` words in the vocabulary, `pairs` pairs counted.
    """

    ids: Ids
    words: np.ndarray
    pair_keys: np.ndarray
    pair_terms: np.ndarray
    new: np.ndarray
    marks: np.ndarray
    counted: np.ndarray
    terms: DataFrame
    size: int
    pairs: int


def train(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", min_word: int = MIN_WORD,
          min_pair: int = MIN_PAIR, strength: float = STRENGTH) -> Models:
    """Models of `docs` (background) and of those whose id is in the first column of `targets`."""
    spark = docs.sparkSession
    bound_batches(spark)
    ids = targets.select(F.col(targets.columns[0]).alias("target_id")).filter("target_id is not null").distinct().withColumn("hit", F.lit(True))
    marked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(broadcast_if_small(ids), F.col("id") == F.col("target_id"), "left")
    marked = marked.select("text", F.coalesce("hit", F.lit(False)).alias("is_target"))

    counted = marked.mapInArrow(_word_counts, _COUNT).groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))
    counted = written(counted, "words")
    where = [F.col("key") == _TEXTS, F.col("key") == _ALL, (F.col("key") < 0) & (F.col("n") >= min_word)]
    sums = [F.coalesce(F.sum(F.when(x, F.col(c))), F.lit(0)) for x in where for c in ("n_target", "n")]
    *found, size = counted.agg(*sums, F.count(F.when(where[2], 1))).first()
    texts, every, known = np.array(found, np.int64).reshape(3, 2)
    rare = every - known
    mass = texts + every  # (target, background): an end mark for each text
    scale = np.array([1.0, mass[0] / max(1, mass[1])])

    def loss(counts: np.ndarray) -> np.ndarray:
        """-log2 p(w) in both models, of counts (target, background) in rows."""
        return -np.log2((counts * scale[:, None] + 1) / (mass[0] + size + 2))

    few = FREQUENT_WORDS is not None
    frequent = F.col("n") * (FREQUENT_WORDS or BROADCAST_WORDS) > int(mass[1])
    top = counted.filter(where[2] & frequent).orderBy("key").toArrow()
    keys = top.column("key").to_numpy()
    ids = Ids(HashTable(keys.view(np.uint64), np.arange(len(keys))), len(keys))
    # p(w) of the frequent words and the end mark; the start mark, between them, is never predicted
    nothing = np.zeros((2, 1), np.int64)
    tops = np.concatenate([np.stack([top.column("n_target").to_numpy(), top.column("n").to_numpy()]).astype(np.int64), nothing, texts[:, None]], axis=1)
    word_loss = loss(tops)
    tail = counted.filter(where[2] & ~frequent)
    # a pair is no more frequent than either of its words
    able = None if few else seed_filter(tail.filter(F.col("n") >= min_pair).select(F.col("key").alias("seed")), FILTER_BITS)
    shared = spark.sparkContext.broadcast((ids, word_loss, scale, able))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            v, w, target = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            _, first, at, n = np.unique(pair_keys(v, w), return_index=True, return_inverse=True, return_counts=True)
            n_target, v, w = np.bincount(at[target], minlength=len(n)), v[first], w[first]
            order = np.argsort(v)  # equal words beside each other take less room in a shuffle
            yield from _rows(_PAIR.names, *(x[order] for x in (v, w, n, n_target)))

        for batch in batches:
            is_target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in chunks(batch.column(0)):
                words = Words(*text_bytes(batch.column(0).slice(lo, hi - lo)))
                known, _, _, able = shared.value
                codes = known.of(words)
                fit = codes >= 0
                if able is not None:
                    other = np.flatnonzero(~fit)
                    fit[other[_passes(codes[other].view(np.uint64), able)]] = True
                doc, v, w = known.pairs(words, np.where(fit, codes, _NONE))
                fit = np.flatnonzero((v != _NONE) & (w != _NONE))
                held.append((v[fit], w[fit], is_target[lo + doc[fit]]))
                size += len(fit)
                if size > TASK_PAIRS:
                    yield from sent()
                    size = 0
        if held:
            yield from sent()

    def pair_terms(w: pa.Array, n: pa.Array, n_target: pa.Array) -> pa.Array:
        _, losses, by, _ = shared.value
        p = 2.0 ** -losses[:, w.to_numpy()]
        found = -np.log2(1 + np.stack([n_target.to_numpy(), n.to_numpy()]) * by[:, None] / (strength * p))
        return pa.StructArray.from_arrays([pa.array(x.astype(np.float32)) for x in found], names=_TERM.names)

    def key(v: pa.Array, w: pa.Array) -> pa.Array:
        return pa.array(pair_keys(v.to_numpy(), w.to_numpy()))

    total = float(mass[0] + size + 2)
    p_of = [(F.col(c) * F.lit(float(by)) + 1.0) / F.lit(total) for c, by in zip(("w_target", "w_n"), scale, strict=True)]
    added = lambda c, by, p: (-F.log2(1.0 + F.col(c) * F.lit(float(by)) / (F.lit(strength) * p))).cast("float")
    found = written(marked.mapInArrow(count, _PAIR).groupBy("v", "w").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))
                    .filter(F.col("n") >= min_pair), "found-pairs")
    pairs = found
    if min_pair < min_word and not few:  # else each word of a pair has as many occurrences
        pairs = pairs.filter("v >= 0").unionByName(pairs.filter("v < 0").join(tail.select(F.col("key").alias("v")), "v", "left_semi"))
    # the frequent words, which have the most pairs, are not joined
    whole = pairs.filter("w >= 0").withColumn("t", F.arrow_udf(pair_terms, _TERM)("w", "n", "n_target")).select("v", "w", "n", "n_target", "t.target", "t.background")
    if not few:
        of = tail.select(F.col("key").alias("w"), F.col("n").alias("w_n"), F.col("n_target").alias("w_target"))
        whole = whole.unionByName(pairs.filter("w < 0").join(of, "w").select(
            "v", "w", "n", "n_target", added("n_target", scale[0], p_of[0]).alias("target"), added("n", scale[1], p_of[1]).alias("background")))
    pairs = written(whole.withColumn("key", F.arrow_udf(key, T.LongType())("v", "w")).drop("w"), "pairs")
    discard(found)
    context = pairs.groupBy("v").agg(F.sum("n_target").alias("v_n_target"), F.sum("n").alias("v_n"), F.count("*").alias("pairs"))
    context = written(context, "contexts")
    n_pairs = context.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    known = context.filter("v >= 0").toArrow()
    after = np.zeros((2, ids.start + 2))
    after[:, known.column("v").to_numpy()] = np.stack([known.column("v_n_target").to_numpy(), known.column("v_n").to_numpy()])
    backed = np.log2((after * scale[:, None] + strength) / strength)

    most = F.col("n") * FREQUENT_PAIRS > int(mass[1])
    top = pairs.filter(most).orderBy("key").select("key", "target", "background").toArrow()
    tail = tail.join(context.filter("v < 0"), F.col("key") == F.col("v"), "left")

    def term(c: str, by: float) -> Column:
        one = -F.log2((F.col(c) * F.lit(float(by)) + 1.0) / F.lit(total))
        return one + F.log2((F.coalesce(F.col(f"v_{c}"), F.lit(0)) * F.lit(float(by)) + F.lit(strength)) / F.lit(strength))

    tail = tail.select("key", term("n_target", scale[0]).alias("target"), term("n", scale[1]).alias("background"))
    others = counted.filter((F.col("key") < 0) & (F.col("n") < min_word))
    others = others.select("key", *[F.lit(float(x)).alias(c) for c, x in zip(_TERM.names, loss(rare[:, None])[:, 0], strict=True)])
    terms = pairs.filter(~most).select("key", *[F.col(c).cast("double").alias(c) for c in _TERM.names]).unionByName(tail).unionByName(others)
    return Models(ids, (word_loss + backed)[:, : ids.start], top.column("key").to_numpy(),
                  np.stack([top.column(c).to_numpy() for c in ("target", "background")]).astype(np.float64),
                  loss(np.zeros((2, 1)))[:, 0], word_loss[:, ids.end] + backed[:, ids.start],
                  seed_filter(pairs.select(F.col("key").alias("seed")), FILTER_BITS), terms, size, int(n_pairs))


def _parts(batches: Iterator[pa.RecordBatch], m: tuple) -> Iterator[pa.RecordBatch]:
    """The sums of a document's broadcast terms, under a key of its own, and a row for each other word and pair of it."""
    ids, words, frequent_pairs, pair_terms, new, marks, counted = m
    for batch in batches:
        for lo, hi in chunks(batch.column(2)):
            w = Words(*text_bytes(batch.column(2).slice(lo, hi - lo)))
            row, doc_id = batch.column(0).slice(lo, hi - lo).to_numpy(), batch.column(1).slice(lo, hi - lo)
            codes = ids.of(w)
            known = codes >= 0
            doc, *pair = ids.pairs(w, codes)
            key = pair_keys(*pair)
            may = _passes(key.view(np.uint64), counted)
            doc, key = doc[may], key[may]
            at = np.searchsorted(frequent_pairs, key)
            at[at == len(frequent_pairs)] = 0
            hit = frequent_pairs[at] == key if len(frequent_pairs) else np.zeros(len(key), bool)
            sums = [np.bincount(w.doc[known], weights=words[k][codes[known]], minlength=hi - lo)
                    + np.bincount(doc[hit], weights=pair_terms[k][at[hit]], minlength=hi - lo) + np.where(w.count > 0, marks[k], 0.0) for k in (0, 1)]
            own = word_keys(row.view(np.uint64))  # of no word and no pair but by chance, and its term then is the row's own
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(own), doc_id, pa.array(w.count), *map(pa.array, sums)], _PART.names)
            other = np.concatenate([codes[~known], key[~hit]])
            of = row[np.concatenate([w.doc[~known], doc[~hit]])]
            default = [np.concatenate([np.full(int((~known).sum()), new[k]), np.zeros(int((~hit).sum()))]) for k in (0, 1)]
            for x in range(0, len(other), 50_000):
                few = slice(x, x + 50_000)
                none = pa.nulls(len(other[few]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(of[few]), pa.array(other[few]), none, none, *[pa.array(d[few]) for d in default]], _PART.names)


def scored(docs: DataFrame, models: Models, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, h_target, h_background (bits a token, the end mark included), score (their difference)."""
    bound_batches(docs.sparkSession)
    m = models
    shared = docs.sparkSession.sparkContext.broadcast((m.ids, m.words, m.pair_keys, m.pair_terms, m.new, m.marks, m.counted))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _parts(batches, shared.value)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    terms = m.terms.select("key", F.col("target").alias("t"), F.col("background").alias("b"))
    parts = rows.mapInArrow(scan, _PART).join(terms, "key", "left")
    term = lambda found, else_: F.sum(F.when(F.col("n_words").isNotNull(), F.col(else_)).otherwise(F.coalesce(found, else_)))
    sums = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
                                    term("t", "target").alias("target"), term("b", "background").alias("background"))
    mean = lambda c: F.round(F.col(c) / (F.col("n_words") + 1), 9)
    return sums.select("doc_id", "n_words", mean("target").alias("h_target"), mean("background").alias("h_background"),
                       F.round((F.col("target") - F.col("background")) / (F.col("n_words") + 1), 9).alias("score"))


def good_ids(labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """The ids whose labels are all 1."""
    return labels.groupBy(doc_id).agg(F.min(label).alias("least")).filter("least = 1").select(doc_id)


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, good_ids(table(spark, sf_dir, "labels"))))
