"""Secret scan, ranked search and spelling variants against their plain versions, on a made corpus and on edge cases."""

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import DOCS, EDGES, in_order, rows_of

from sellerlens.llm import op11_secret_scan as op11
from sellerlens.llm import op12_ranked_search as op12
from sellerlens.llm import op13_spelling_variants as op13

SYMBOLS = op11.SYMBOLS.decode()


def pairs(rows, *at):
    return [tuple(r[k] for k in at) for r in rows]


# -- secret scan

def secret_docs(seed=3, n=160):
    """Documents with labelled tokens of two formats, bare tokens of the same formats, plain long words, and near misses."""
    rng = random.Random(seed)
    token = lambda: "sk_" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(28))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    prose = ["".join(rng.choice(("re", "the", "on", "ing", "ha", "and", "ti")) for _ in range(rng.randint(1, 7))) for _ in range(60)]
    docs, bare = [], {}
    for i in range(n):
        w = [rng.choice(prose) for _ in range(40)]
        if i % 3 == 0:
            w[rng.randrange(40)] = rng.choice(("token = \"", "Api_Key:", "PASSWORD = '", "été secret=")) + token() + "'"
        if i % 4 == 1:
            w[7] = hexes(rng.choice((12, 15, 16, 40)))
        if i % 5 == 2:
            w[20] = "AKIA" + "".join(rng.choice("ABCDEFGHIJ0123456789") for _ in range(rng.choice((8, 16))))
        if i % 8 == 5:
            bare[i] = w[30] = token()
        if i % 9 == 4:
            w[3:5] = ["password=secret: abcdefghijklmnopqrstu", "ünïcode…token:\"short\""]
        docs.append((i, " ".join(w), "en", "s", 0))
    return docs, bare


@pytest.fixture(scope="module")
def secrets(spark):
    docs, bare = secret_docs()
    df = spark.createDataFrame(docs, DOCS)
    return df, docs, bare, op11.learn(df)


def spans_of(df, automata):
    return [(r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in op11.scanned(df, automata).collect()]


def test_spans(secrets):
    df, docs, _, automata = secrets
    want = [(i, brute.secret_spans(t, automata, SYMBOLS)) for i, t, *_ in docs]
    assert sorted(spans_of(df, automata)) == want
    assert any(k == "assign" for _, s in want for k, _, _ in s) and any(k == "access" for _, s in want for k, _, _ in s)


def test_bare_credentials_of_a_labelled_format_are_inferred(secrets):
    df, docs, bare, automata = secrets
    texts = {i: t for i, t, *_ in docs}
    got = {(i, texts[i][s:e]) for i, spans in spans_of(df, automata) for k, s, e in spans if k == "inferred"}
    assert got == set(bare.items())


def test_secrets_on_edges(edges, empty, secrets):
    automata = secrets[3]
    got = op11.scanned(edges, op11.learn(edges))
    assert got.columns == [*edges.columns, "spans"]
    assert got.count() == len(EDGES)
    assert spans_of(empty, op11.learn(empty)) == []
    want = sorted((str(r[0]), brute.secret_spans(r[1], automata, SYMBOLS)) for r in EDGES)
    assert sorted((str(i), s) for i, s in spans_of(edges, automata)) == want


def test_a_very_long_candidate_and_a_clashing_name(spark, secrets):
    from pyspark.sql import functions as F

    text = "x " + "Zq9+" * 30_000 + " token=" + "a" * 50_000 + " é " + "0f" * 20
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("spans", F.lit(0))
    got = op11.scanned(df, secrets[3])
    assert got.columns == ["doc_id", "text", "spans", "_spans"]
    found = [(s["kind"], s["start"], s["end"]) for s in got.first()["_spans"]]
    assert found == brute.secret_spans(text, secrets[3], SYMBOLS)


def test_states_of_one_format_merge():
    """Random digits of any length are one state with a loop; a fixed prefix stays a chain."""
    rng = random.Random(1)
    digits = ["".join(rng.choice("01") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    assert len(op11.infer([d.encode() for d in digits]).end_bits) <= 4
    keyed = op11.infer([("ab" + d).encode() for d in digits])
    bits = lambda s: keyed.walk(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)]))[0]
    assert bits(b"ab0110100110") < 30 < 60 < bits(b"0110100110ab")


def test_merged_counts_add_up():
    values = [b"abc1", b"abc2", b"abd1", b"x"] * 30
    a = op11.infer(values)
    assert a.after.max() < len(a.end_bits) and np.isfinite(a.bits).all()
    assert (2.0 ** -a.bits[:-1]).sum(axis=1) + 2.0 ** -a.end_bits[:-1] == pytest.approx(1.0)


def test_examples_are_bounded_and_repeatable(secrets):
    df, _, _, _ = secrets
    few = op11.learn(df, examples=25)
    again = op11.learn(df.repartition(7), examples=25)
    assert all(len(a.end_bits) == len(b.end_bits) and (a.bits == b.bits).all() for a, b in zip(few, again, strict=True) if a is not None)


# -- ranked search

ITEM_EDGES = [(1, "v1 v2 v3"), (1, "v1 v2 v3"), (2, None), (3, ""), (None, "one TWO"), (4, "absent-word only"), (5, " ".join(f"w{k}" for k in range(900)))]


@pytest.mark.parametrize("sizes", ["plain", "small"])
def test_ranked_search(spark, docs, items, corpus, edges, monkeypatch, sizes):
    if sizes == "small":
        for name, value in (("BLOCK_DOCS", 7), ("BUNDLE_ITEMS", 2), ("OWNERS", (0.05, 0.2, 0.5, 1.0))):
            monkeypatch.setattr(op12, name, value)
    assert rows_of(op12.ranked(docs, items), "item_id", "rank", "doc_id", "score") == in_order(
        brute.ranked(pairs(corpus[0], 0, 1), corpus[1]))
    odd = spark.createDataFrame(ITEM_EDGES, "item_id long, text string")
    assert rows_of(op12.ranked(edges, odd), "item_id", "rank", "doc_id", "score") == in_order(
        brute.ranked(pairs(EDGES, 0, 1), ITEM_EDGES))


def test_ranked_search_in_passes(docs, items, corpus, monkeypatch):
    monkeypatch.setattr(op12, "PASS_ITEMS", 2)
    assert rows_of(op12.ranked(docs, items, 3), "item_id", "rank", "doc_id", "score") == in_order(
        brute.ranked(pairs(corpus[0], 0, 1), corpus[1], 3))


def test_accumulators_that_cannot_win_are_left(spark, monkeypatch):
    """A common term lets no new document in once rarer ones have filled the ten places."""
    rows = [(i, "common " + " ".join(f"u{i}x{k}" for k in range(30)) + (" rare words here" if i % 40 == 0 else "")) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    carried = []
    visit = op12._visit
    monkeypatch.setattr(op12, "_visit", lambda *a: carried.append(visit(*a)) or carried[-1])
    got = op12.ranked(df, spark.createDataFrame([(0, "Common rare words here")], "item_id long, text string"))
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == in_order(brute.ranked(rows, [(0, "Common rare words here")]))
    assert sum(len(r["docs"]) for r in carried[-1].collect()) <= 20


def test_no_documents_or_items(docs, empty, items, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op12.ranked(empty, items).count() == 0 and op12.ranked(docs, none).count() == 0
    assert op12.ranked(empty, items).columns == op12.ranked(docs, none).columns == ["item_id", "rank", "doc_id", "score"]


# -- spelling variants

def variant_docs(seed=8):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßÀ") for _ in range(rng.randint(6, 11))) for _ in range(60)]
    docs = []
    for i in range(120):
        text = []
        for _ in range(80):
            w = rng.choice(words[: 1 + int(60 * rng.random() ** 3)])
            if rng.random() < 0.08:
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice("abcéÀ") + w[k:], w[:k] + rng.choice("abcde") + w[k + 1 :]))
            text.append(w.upper() if rng.random() < 0.05 else w)
        docs.append((i, " ".join(text) + " 日本 ×÷", "en", "s", 0))
    return docs


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_variants(spark):
    docs = variant_docs()
    want = brute.spelling_variants(pairs(docs, 0, 1))
    got = op13.variants(spark.createDataFrame(docs, DOCS))
    assert rows_of(got, *COLUMNS) == in_order(want)
    assert sum(w[1] is not None for w in want) > 20 and sum(w[4] > 1 for w in want) > 20


def test_variants_in_rounds(spark):
    docs = variant_docs(9)
    got = op13.variants(spark.createDataFrame(docs, DOCS), round_blocks=7)
    assert rows_of(got, *COLUMNS) == in_order(brute.spelling_variants(pairs(docs, 0, 1)))


def test_chains_of_forms(spark):
    """Each step's count is tenfold: roots are the ends of long chains."""
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb"]
    text = " ".join(" ".join([w] * (3 * 11**k)) for k, w in enumerate(chain))
    rows = [(i, text) for i in range(1000) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in chain)][:1]
    got = {r["word"]: r["root"] for r in op13.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(chain, chain[-1])


def test_variants_on_edges(edges, empty, spark):
    assert rows_of(op13.variants(edges), *COLUMNS) == in_order(brute.spelling_variants(pairs(EDGES, 0, 1)))
    assert op13.variants(empty).count() == 0
    few = "r" * 70 + "é" + "s" * 300 + " " + "r" * 70 + "s" * 300
    long = [(i, "q" * 300_000 + " " + few) for i in (None, 3, 3, 4)]
    got = rows_of(op13.variants(spark.createDataFrame(long, "doc_id long, text string")), *COLUMNS)
    assert [r for r in got if r[0][0] != "q"] == in_order(brute.spelling_variants([(i, few) for i, _ in long]))
    assert {len(r[0]) for r in got if r[0][0] == "q"} <= {299_999, 300_000} and any(r[0][0] == "q" for r in got)


def test_crc_of_runs():
    words = ["abcdefg", "é" * 9, "zÿ" * 50, "x" * 300]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    codes, offs = op13.letters(data, np.array([0, len(data)]))
    size = np.array([len(w) for w in words])
    start = np.cumsum(size + 1) - size - 1
    got = op13.crcs(codes, start, size, np.full(len(words), zlib.crc32(b"17:"), np.uint32))
    assert got.tolist() == [zlib.crc32(f"17:{w}".encode()) for w in words]
    assert op13.strings(np.concatenate([codes[s : s + n] for s, n in zip(start, size, strict=True)]), size).to_pylist() == words


def test_filter_knows_all_words_and_few_others(spark):
    rng = random.Random(2)
    make = lambda: "".join(rng.choice("abcdefgh") for _ in range(12))
    words = sorted({make() for _ in range(4000)})
    df = spark.createDataFrame([(w, 2) for w in words], op13._WORD_N)
    shards = op13._shards(df)
    blocks = op13._filter(df, shards, 0, shards.size)

    def passed(some):
        codes, offs = op13.letters(*op13.text_bytes(pa.array(some)))
        h = op13.span_hashes(codes, offs[:-1], offs[1:])
        b = shards.block(12, h)
        return np.all([(blocks[j, b] & op13.bits(h, j)) != 0 for j in range(8)], axis=0)

    assert passed(words).all()
    assert passed([make() for _ in range(20_000)]).mean() < 0.02
