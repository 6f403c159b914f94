"""Secret scan by grammar inference.

Three base patterns find credentials by their context or alphabet (assign, access, hex). What
they find are the labelled credentials: for each kind, a prefix tree of labelled values is
reduced to a probabilistic automaton by merging states whose next symbols and ends are
statistically compatible (Hoeffding bound, state by state from the root). A last
automaton is inferred from natural words (OTHER_WORD or more lower-case letters, the first may be a capital), so credentials that no
pattern knows can't teach it their own format. Every other candidate of every text, a
run of CANDIDATE or more credential characters, is then scored by format likelihood: its bits a
character under the natural words' automaton less those under the kind's. A candidate that is
likelier by GAIN bits a character and TOTAL_GAIN in all is a span of kind "inferred". Base spans always stay.

Scale: texts are scanned twice and never shuffled. The first scan leaves the EXAMPLES values of the least hash of each
kind, cut in each task, then in SALTS parts, then overall, so no task gathers more; a fixed number of examples of at most
EXAMPLE_CHARS characters is the documented bound of what the automata learn from. Their tables have at most as many
states as the examples have characters; they are built on the driver and broadcast. The second scan walks all
candidates of a chunk at once, a symbol at a time.

Patterns and candidates are of ASCII characters only, so they are matched on UTF-8 bytes and reported in code points, end exclusive.
Defined cases: null and empty texts have no spans; candidates of any length are scored whole; a kind of
fewer than FEW labelled values has no automaton, and without natural words nothing is inferred; repeated rows and values are one example, and each row has
its own spans; an empty table gives no rows; all columns of the input stay, `spans` gets another name where it is taken.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerlens.llm.common import bound_batches, fresh, table
from sellerlens.llm.textops import Words, chunks, span_hashes, text_bytes

#: Kinds in the order of the contract; "inferred" is the method's own.
KINDS = ("assign", "access", "hex", "inferred")
BASE = 3
#: Fixed patterns of the contract, and the least length of what counts of each.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = (12, 18, 16)

SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CANDIDATE, OTHER_WORD = 16, 8
EXAMPLES, EXAMPLE_CHARS, FEW, SALTS = 1_000, 256, 20, 64
#: Confidence of the merge test, and the fewest visits of a state that it can tell anything from.
ALPHA, SEEN = 0.05, 8
SMOOTHING = 1.0
GAIN, TOTAL_GAIN = 0.5, 16.0

_CODE = np.full(256, -1, np.int16)
_CODE[list(SYMBOLS)] = np.arange(len(SYMBOLS))
_NO_SYMBOL = _CODE < 0
_NO_HEX = np.ones(256, bool)
_NO_HEX[list(b"0123456789abcdef")] = False
#: Marks of a sentence that may stand around a candidate.
_MARKS = np.zeros(256, bool)
_MARKS[list(b".-/")] = True

_EXAMPLE = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("hash", T.LongType())])
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType()), T.StructField("gain", T.DoubleType())]))


# ----------------------------------------------------------------------------- base spans and candidates

@dataclass
class Spans:
    """Spans of a chunk in bytes: `doc`, `kind`, `start`, `end`, and where the credential itself begins."""

    doc: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    value: np.ndarray


def base_spans(data: np.ndarray, offs: np.ndarray) -> Spans:
    """What the base patterns find in a chunk, ordered by start, then kind."""
    raw, found = data.tobytes(), []
    signs = (data == 58) | (data == 61)
    total = np.concatenate([[0], np.cumsum(signs)])
    for d in np.flatnonzero(total[offs[1:]] > total[offs[:-1]]):
        for m in ASSIGN.finditer(raw, offs[d], offs[d + 1]):
            if m.end(2) - m.start(2) >= LEAST[0]:
                found.append((d, 0, m.start(), m.end(), m.start(2)))
    if b"AKIA" in raw:
        for d in range(len(offs) - 1):
            for m in ACCESS.finditer(raw, offs[d], offs[d + 1]):
                if m.end() - m.start() >= LEAST[1]:
                    found.append((d, 1, m.start(), m.end(), m.start()))
    w = Words(data, offs, _NO_HEX)
    at = np.flatnonzero(w.end - w.start >= LEAST[2])
    columns = np.array(found, np.int64).reshape(-1, 5).T
    hexes = np.stack([w.doc[at], np.full(len(at), 2), w.start[at], w.end[at], w.start[at]])
    columns = np.concatenate([columns, hexes], axis=1)
    return Spans(*columns[:, np.lexsort((columns[1], columns[2]))])


def runs(data: np.ndarray, offs: np.ndarray, base: Spans, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the runs of credential characters without sentence marks around them, clear of base spans."""
    w = Words(data, offs, _NO_SYMBOL)
    at = np.flatnonzero(w.end - w.start >= least)
    doc, start, end = w.doc[at], w.start[at].copy(), w.end[at].copy()
    for edge, step, last in ((start, 1, 0), (end, -1, 1)):
        on = np.arange(len(edge))
        while len(on):
            on = on[(start[on] < end[on])]
            on = on[_MARKS[data[edge[on] - last]]]
            edge[on] += step
    keep = end - start >= least
    order = np.argsort(base.start, kind="stable")
    reach = np.maximum.accumulate(np.concatenate([[-1], base.end[order]]))
    before = reach[np.searchsorted(base.start[order], end, side="left")]  # base spans that begin before the run ends
    keep &= before <= start
    return doc[keep], start[keep], end[keep]


# ----------------------------------------------------------------------------- grammar inference

@dataclass(frozen=True)
class Automaton:
    """A probabilistic automaton: next state and bits of each symbol by state, and bits of an end there. The last state is for the unseen."""

    after: np.ndarray
    bits: np.ndarray
    end_bits: np.ndarray

    def walk(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Bits of each run, all at once, a symbol at a time."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        ordered = np.sort(size)
        state, total = np.zeros(len(size), np.int32), np.zeros(len(size))
        for k in range(int(size.max(initial=0))):
            at = order[: len(size) - int(np.searchsorted(ordered, k, side="right"))]
            c = _CODE[data[start[at] + k]]
            s = state[at]
            total[at] += self.bits[s, c]
            state[at] = self.after[s, c]
        return total + self.end_bits[state]


class _Tree:
    """A prefix tree whose states are merged: visits, ends, and by symbol the next state and how often it is taken."""

    def __init__(self, values: list[bytes]):
        self.visits, self.ends, self.next = [0], [0], [{}]
        for v in values:
            s = 0
            self.visits[0] += 1
            for c in v:
                edge = self.next[s].get(c)
                if edge is None:
                    edge = self.next[s][c] = [len(self.visits), 0]
                    self.visits.append(0)
                    self.ends.append(0)
                    self.next.append({})
                edge[1] += 1
                s = edge[0]
                self.visits[s] += 1
            self.ends[s] += 1

    def differ(self, f1: int, n1: int, f2: int, n2: int, width: float) -> bool:
        return abs(f1 / n1 - f2 / n2) > width * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, a: int, b: int, width: float) -> bool:
        """Whether two states, and those behind them, may be one, as far as they are seen often enough to tell."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = self.visits[x], self.visits[y]
            if n < SEEN or m < SEEN:
                continue
            if self.differ(self.ends[x], n, self.ends[y], m, width):
                return False
            for c in self.next[x].keys() | self.next[y].keys():
                e, f = self.next[x].get(c), self.next[y].get(c)
                if self.differ(e[1] if e else 0, n, f[1] if f else 0, m, width):
                    return False
                if e and f and e[0] != f[0]:
                    todo.append((e[0], f[0]))
        return True

    def fold(self, a: int, b: int) -> set[int]:
        """Merges the subtree of b into a; the states that have new ways on since."""
        todo, grown = [(a, b)], set()
        while todo:
            x, y = todo.pop()
            self.visits[x] += self.visits[y]
            self.ends[x] += self.ends[y]
            for c, (to, times) in self.next[y].items():
                edge = self.next[x].get(c)
                if edge is None:
                    self.next[x][c] = [to, times]
                    grown.add(x)
                else:
                    edge[1] += times
                    todo.append((edge[0], to))
        return grown


def infer(values: list[bytes], alpha: float = ALPHA) -> Automaton:
    """The automaton of labelled values: states of their prefix tree, merged where statistically compatible."""
    tree = _Tree(sorted(values))
    width = math.sqrt(0.5 * math.log(2 / alpha))
    kept, number = [0], {0: 0}
    todo = [0]  # kept states, by number, some of whose next states are neither kept nor merged yet
    while todo:
        s = kept[heapq.heappop(todo)]
        for c in sorted(tree.next[s]):
            edge = tree.next[s][c]
            if edge[0] in number:
                continue
            b = edge[0]
            into = next((r for r in kept if tree.compatible(r, b, width)), None)
            if into is None:
                number[b] = len(kept)
                kept.append(b)
                heapq.heappush(todo, number[b])
            else:
                edge[0] = into
                for x in tree.fold(into, b):
                    if x in number:
                        heapq.heappush(todo, number[x])
    n, lost = len(kept) + 1, len(kept)
    counts = np.zeros((n, len(SYMBOLS)))
    after = np.full((n, len(SYMBOLS)), lost, np.int32)
    ends, visits = np.zeros(n), np.zeros(n)
    for s, k in number.items():
        visits[k], ends[k] = tree.visits[s], tree.ends[s]
        for c, (to, times) in tree.next[s].items():
            counts[k, _CODE[c]], after[k, _CODE[c]] = times, number[to]
    flat = 1 / (len(SYMBOLS) + 1)
    bits = -np.log2((counts + SMOOTHING * flat) / (visits + SMOOTHING)[:, None])
    return Automaton(after, bits, -np.log2((ends + SMOOTHING * flat) / (visits + SMOOTHING)))


# ----------------------------------------------------------------------------- examples and scores

def _examples(batches: Iterator[pa.RecordBatch], examples: int) -> Iterator[pa.RecordBatch]:
    """Of each kind (the last stands for natural words), the different values of the least hashes in a task."""
    held: list[dict[int, str]] = [{} for _ in KINDS]
    below = [(1 << 64) - 1] * len(KINDS)
    for batch in batches:
        for lo, hi in chunks(batch.column(0)):
            data, offs = text_bytes(batch.column(0).slice(lo, hi - lo))
            base = base_spans(data, offs)
            _, start, end = runs(data, offs, base, OTHER_WORD)
            odd = np.concatenate([[0], np.cumsum((data < 97) | (data > 122))])  # no lower-case letter
            natural = (odd[end] == odd[start + 1]) & ((data[start] | 32) >= 97) & ((data[start] | 32) <= 122)
            start, end = start[natural], end[natural]
            kind = np.concatenate([base.kind, np.full(len(start), BASE)])
            first, last = np.concatenate([base.value, start]), np.concatenate([base.end, end])
            order = np.argsort(first, kind="stable")
            hashes = np.empty(len(order), np.uint64)
            for k in range(len(KINDS)):
                mine = order[kind[order] == k]
                hashes[mine] = span_hashes(data, first[mine], last[mine])
            for k in range(len(KINDS)):
                at = np.flatnonzero((kind == k) & (last - first <= EXAMPLE_CHARS) & (hashes <= np.uint64(below[k])))
                _, sample = np.unique(hashes[at], return_index=True)
                for i in at[sample[:examples]]:
                    held[k][int(hashes[i])] = data[first[i] : last[i]].tobytes().decode()
                if len(held[k]) > examples:
                    held[k] = dict(sorted(held[k].items())[:examples])
                    below[k] = max(held[k])
    for k, values in enumerate(held):
        signed = np.array(list(values), np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k), pa.int32()), pa.array(list(values.values()), pa.string()),
                                          pa.array(signed, pa.int64())], _EXAMPLE.names)


def learn(docs: DataFrame, text: str = "text", examples: int = EXAMPLES) -> list[Automaton | None]:
    """An automaton for each base kind, and for natural words; none where there are too few examples."""
    bound_batches(docs.sparkSession)

    def gather_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _examples(batches, examples)

    order = [(F.col("hash") < 0).asc(), F.col("hash").asc()]
    found = docs.select(F.col(text)).mapInArrow(gather_examples, _EXAMPLE).distinct()
    for key in (["kind", F.pmod("hash", F.lit(SALTS))], ["kind"]):
        found = found.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("r") <= examples).drop("r")
    rows = found.select("kind", "value").toArrow()
    kinds, values = rows.column(0).to_numpy(), rows.column(1).to_pylist()
    by_kind = [[v.encode() for v, k in zip(values, kinds, strict=True) if k == j] for j in range(len(KINDS))]
    return [infer(v) if len(v) >= FEW else None for v in by_kind]


def gains(data: np.ndarray, start: np.ndarray, end: np.ndarray, automata: list[Automaton | None]) -> np.ndarray:
    """Bits by which the likeliest kind's format beats the natural words'."""
    *kinds, other = automata
    known = [a for a in kinds if a is not None]
    if other is None or not known or not len(start):
        return np.full(len(start), -np.inf)
    return other.walk(data, start, end) - np.minimum.reduce([a.walk(data, start, end) for a in known])


def scanned(docs: DataFrame, automata: list[Automaton | None], text: str = "text") -> DataFrame:
    """`docs` with `spans`: kind, start, end (code points) and gain (bits; null for base spans), by start, then kind."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(automata)

    def spans(texts: pa.Array) -> pa.Array:
        sizes, columns = [np.zeros(0, np.int64)], [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for lo, hi in chunks(texts):
            data, offs = text_bytes(texts.slice(lo, hi - lo))
            base = base_spans(data, offs)
            doc, start, end = runs(data, offs, base, CANDIDATE)
            gain = gains(data, start, end, shared.value)
            hit = (gain >= TOTAL_GAIN) & (gain >= GAIN * (end - start))
            kind = np.concatenate([base.kind, np.full(int(hit.sum()), BASE)])
            doc, start, end = (np.concatenate([b, x[hit]]) for b, x in ((base.doc, doc), (base.start, start), (base.end, end)))
            gain = np.concatenate([np.full(len(base.doc), np.nan), gain[hit]])
            order = np.lexsort((kind, start))
            point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
            sizes.append(np.bincount(doc, minlength=hi - lo))
            for out, x in zip(columns, (kind, point[start] - point[offs[doc]], point[end] - point[offs[doc]], gain), strict=True):
                out.append(x[order])
        kind, start, end, gain = (np.concatenate(x) for x in columns)
        names = pa.array(KINDS).take(pa.array(kind))
        each = pa.StructArray.from_arrays([names, pa.array(start), pa.array(end), pa.array(gain, mask=np.isnan(gain))], ["kind", "start", "end", "gain"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int32()), each)

    return docs.withColumn(fresh("spans", docs), F.arrow_udf(spans, SPANS)(F.col(text)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op11_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scanned(docs, learn(docs)).select("doc_id", "spans")
    count = [_count(k) for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != KINDS[BASE])
    return rows.select("doc_id", *count[:BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count[BASE])
