"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted small trees are grown on labelled documents; every path from a root to
a node is a rule, a conjunction of comparisons of statistics. A lasso logistic
regression over the rules keeps a few with weights, and those are compiled into
one Spark column expression over the statistics.

The statistics of a text come from an Arrow UDF; nothing else is an input: no
id, language, source or label. Training uses at most SAMPLE labelled documents
(those of least hash of doc_id, so the same at every run), which are all that reaches the
driver; every document is scored.

Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0. Defined
cases: a null or empty text has all statistics 0 and is scored like any other; a
null doc_id counts as the empty text, whose remainder is 0 (held out); of several
labels of one id the least counts; null labels are ignored; without labels, or with
one class only, every score is that class's share (0.5 without labels); equal
rows are scored one by one; a very long text is measured whole, alone; an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerlens.llm.common import table
from sellerlens.llm.op02_quality_rules import _duplicate_lines, repeated_words
from sellerlens.llm.textops import Words, chunks, per_doc, text_bytes

FOLDS = 5
CUT = 0.3
#: Labelled documents that the rules are learnt from, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF = 60, 3, 32, 0.3, 20
LASSO, STEPS = 2e-3, 400

STATISTICS = ("log_words", "word_chars", "symbols", "bars", "exclamations", "digits", "capitals", "commas_stops",
              "duplicate_lines", "repeated_words", "doubled_words", "distinct_words", "short_words", "lines",
              "longest_word", "marked_words")


def _is(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _BAR, _BANG, _DIGIT, _STOP = _is(b"#*$%&<>"), _is(b"|"), _is(b"!"), _is(b"0123456789"), _is(b".,;:")
_UPPER, _LETTER = _is(bytes(range(65, 91))), _is(bytes([*range(65, 91), *range(97, 123), 0xC3]))


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    out = [np.zeros((0, len(STATISTICS)))]
    for lo, hi in chunks(texts):
        data, offs = text_bytes(texts.slice(lo, hi - lo))
        w = Words(data, offs)
        n = np.maximum(w.count, 1)
        total = lambda flags, offs=offs: per_doc(flags, offs)
        chars = total(w.word_byte & ((data & 0xC0) != 0x80))
        letters = np.maximum(total(_LETTER[data]), 1)
        upper = _UPPER[data]
        if len(data):
            upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        size = w.end - w.start
        same = np.zeros(len(size), bool)
        if len(size) > 1:
            same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        order = np.lexsort((w.hash, w.doc))
        first = np.zeros(len(size), bool)
        if len(size):
            first[0] = True
            h, d = w.hash[order], w.doc[order]
            first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        marked = (_SYMBOL | _BAR | _BANG)[data[w.end - 1]] if len(size) else first
        longest = np.zeros(hi - lo)
        has = w.count > 0
        if has.any():
            longest[has] = np.maximum.reduceat(size, w.first[:-1][has])
        lines = total(data == 10) + (np.diff(offs) > 0)
        columns = (
            np.log1p(w.count), chars / n, total(_SYMBOL[data]) / n, total(_BAR[data]) / n, total(_BANG[data]) / n,
            total(_DIGIT[data]) / n, total(upper) / letters, total(_STOP[data]) / n,
            np.array([_duplicate_lines(w.bytes_of(k)) for k in range(hi - lo)]) / np.maximum(lines, 1),
            per_doc(repeated_words(w), w.first) / n, per_doc(same, w.first) / n, per_doc(first, w.first) / n,
            per_doc(size <= 3, w.first) / n, lines / n, longest, per_doc(marked, w.first) / n,
        )
        out.append(np.stack(columns, axis=1).astype(np.float64))
    return np.concatenate(out)


def statistics_of(text: Column) -> Column:
    """The statistics of a text column, as an array of doubles."""
    def count(texts: pa.Array) -> pa.Array:
        x = statistics(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32()), pa.array(x.reshape(-1)))

    return F.arrow_udf(count, T.ArrayType(T.DoubleType()))(text)


@dataclass(frozen=True, order=True)
class Test:
    """A comparison: statistic <= limit, or > limit."""

    statistic: int
    above: bool
    limit: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.statistic] > self.limit if self.above else x[:, self.statistic] <= self.limit

    def column(self, x: Column) -> Column:
        value = x[self.statistic]
        return value > F.lit(self.limit) if self.above else value <= F.lit(self.limit)


Rule = tuple[Test, ...]


@dataclass(frozen=True)
class RuleModel:
    """log-odds = bias + the weights of the rules that hold."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z += weight * reduce(np.logical_and, [t.holds(x) for t in rule])
        return 1 / (1 + np.exp(-z))

    def column(self, x: Column) -> Column:
        """The score as a Spark expression over the array of statistics."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            z = z + F.when(reduce(lambda a, b: a & b, [t.column(x) for t in rule]), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _simplified(path: list[Test]) -> Rule:
    """The path with the tightest limit per statistic and side."""
    best: dict[tuple[int, bool], float] = {}
    for t in path:
        old = best.get((t.statistic, t.above))
        best[t.statistic, t.above] = t.limit if old is None else max(old, t.limit) if t.above else min(old, t.limit)
    return tuple(sorted(Test(s, a, v) for (s, a), v in best.items()))


def _grow(codes: np.ndarray, limits: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, path: list[Test],
          rules: dict[Rule, None], value: np.ndarray, depth: int) -> None:
    """Splits `rows` where the squared residual falls most, and notes every node's path."""
    if path:
        rules.setdefault(_simplified(path))
    value[rows] = residual[rows].mean()
    if depth == 0 or len(rows) < 2 * LEAST_LEAF:
        return
    best = (1e-9, 0, 0)
    total, n = residual[rows].sum(), len(rows)
    for s, cuts in enumerate(limits):
        if not len(cuts):
            continue
        c = codes[rows, s]
        count = np.cumsum(np.bincount(c, minlength=len(cuts) + 1))[:-1]
        part = np.cumsum(np.bincount(c, weights=residual[rows], minlength=len(cuts) + 1))[:-1]
        ok = (count >= LEAST_LEAF) & (n - count >= LEAST_LEAF)
        if ok.any():
            gain = np.where(ok, part**2 / np.maximum(count, 1) + (total - part) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), s, k)
    if best[0] <= 1e-9:
        return
    _, s, k = best
    below = codes[rows, s] <= k
    limit = float(limits[s][k])
    _grow(codes, limits, residual, rows[below], [*path, Test(s, False, limit)], rules, value, depth - 1)
    _grow(codes, limits, residual, rows[~below], [*path, Test(s, True, limit)], rules, value, depth - 1)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The paths of boosted trees, each grown on a half of the rows."""
    limits = []
    for s in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, s], np.arange(1, BINS) / BINS))
        cuts = np.unique(np.concatenate([cuts, np.quantile(x[:, s], [0.003, 0.01, 0.99, 0.997])]))
        limits.append(cuts[cuts < x[:, s].max()])
    codes = np.stack([np.searchsorted(c, x[:, s], side="left") for s, c in enumerate(limits)], axis=1)
    rng = np.random.default_rng(11)
    rules: dict[Rule, None] = {}
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-z))
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        value = np.zeros(len(y))
        _grow(codes, limits, residual, rows, [], rules, value, depth)
        z[rows] += RATE * 4 * value[rows]
    return list(rules)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """(bias, weights) of least log-loss plus penalty times the absolute weights, by accelerated proximal steps."""
    n, k = r.shape
    spread = np.maximum(r.std(axis=0), 1e-3)
    a = np.concatenate([np.ones((n, 1)), r / spread], axis=1)
    v = np.ones(k + 1) / np.sqrt(k + 1)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * 1.05 * float(v @ (a.T @ (a @ v))) / n)
    w = np.zeros(k + 1)
    w[0] = np.log(y.mean() / (1 - y.mean()))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        new = ahead - step * (a.T @ (1 / (1 + np.exp(-(a @ ahead))) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:] / spread


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """The rule ensemble for statistics `x` and labels `y` (0 or 1)."""
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return RuleModel(float(np.log(share / (1 - share))), ())
    rules = tree_rules(x, y.astype(float))
    if not rules:
        share = float(y.mean())
        return RuleModel(float(np.log(share / (1 - share))), ())
    held = np.stack([reduce(np.logical_and, [t.holds(x) for t in rule]) for rule in rules], axis=1).astype(float)
    bias, weights = lasso_logistic(held, y.astype(float))
    kept = sorted(((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-4), key=lambda x: -abs(x[1]))
    return RuleModel(bias, tuple(kept))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> RuleModel:
    """The model of at most `sample` labelled documents that aren't held out."""
    h = F.xxhash64("labelled")
    known = (labels.select(F.col(doc_id).alias("labelled"), F.col(label).alias("label"))
             .filter(F.col("labelled").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("labelled")))
             .groupBy("labelled").agg(F.min("label").alias("label")).orderBy(h, "labelled").limit(sample))
    rows = docs.select(F.col(doc_id).alias("labelled"), F.col(text).alias("text")).join(F.broadcast(known), "labelled")
    rows = rows.select("labelled", "label", statistics_of(F.col("text")).alias("x")).orderBy(h, "labelled", "x").limit(sample)
    got = rows.select("label", "x").toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(got.num_rows, len(STATISTICS))
    return fit(x, got.column("label").to_numpy())


def scored(docs: DataFrame, model: RuleModel, doc_id: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), statistics_of(F.col(text)).alias("x"))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column(F.col("x")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
