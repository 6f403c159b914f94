"""Every operator against its plain version, on a made corpus and on the edge cases its docstring names."""

import hashlib
import math
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import DOCS, EDGES, in_order, rows_of
from pyspark.sql import functions as F

from sellerlens.llm import op01_substring_dedup as op1
from sellerlens.llm import op02_quality_rules as op2
from sellerlens.llm import op03_lm_scoring as op3
from sellerlens.llm import op04_token_output as op4
from sellerlens.llm import op05_token_counts as op5
from sellerlens.llm import op06_ngram_join as op6
from sellerlens.llm import op07_quality_classifier as op7
from sellerlens.llm import op08_html_extraction as op8
from sellerlens.llm import op09_mixing as op9
from sellerlens.llm import op10_decontamination as op10
from sellerlens.llm.common import run_folder
from sellerlens.llm.textops import Words, text_bytes

PATH = op5.tokenizer_path(op5.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def pairs(rows, *at):
    return [tuple(r[k] for k in at) for r in rows]


@pytest.fixture(scope="module", params=["corpus", "edges", "empty"])
def case(request, corpus, docs, edges, empty):
    """(frame, its rows)"""
    return {"corpus": (docs, corpus[0]), "edges": (edges, EDGES), "empty": (empty, [])}[request.param]


# -- substring dedup

def test_substring_dedup(case):
    df, rows = case
    got = op1.dedup_digest(df)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == in_order(brute.substring_dedup(pairs(rows, 0, 1)))


def test_substring_dedup_of_large_groups(docs, corpus):
    got = op1.dedup_digest(docs, group=1)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == in_order(brute.substring_dedup(pairs(corpus[0], 0, 1)))


@pytest.mark.parametrize("group", [2, 6])
def test_prefixes_of_a_common_line_are_lengthened(spark, group):
    """A line of 30 words in ever other surroundings, some of which repeat: groups are cut step by step, the trees decide."""
    rng = np.random.default_rng(6)
    line = [f"c{k}" for k in range(30)]
    sides = [[f"s{j}x{k}" for k in range(60)] for j in range(5)]
    rows = []
    for i in range(60):
        before, after = sides[rng.integers(5)], sides[rng.integers(5)]
        cut, end = rng.integers(0, 55), rng.integers(5, 60)
        rows.append((i, " ".join([*(f"u{i}b{k}" for k in range(rng.integers(0, 9))), *before[cut:], *line, *after[:end], f"u{i}e"])))
    got = op1.dedup_digest(spark.createDataFrame(rows, "doc_id long, text string"), group=group)
    want = brute.substring_dedup(rows)
    assert sum(r[2] > 0 for r in want) > 20
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == in_order(want)


def test_substring_dedup_keeps_text(docs, corpus):
    kept = {r["doc_id"]: r["text"] for r in op1.dedup_text(docs).collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()} == {r[0]: r[3] for r in brute.substring_dedup(pairs(corpus[0], 0, 1))}


def test_substring_dedup_small_windows(spark):
    rows = [(i, " ".join("ab"[(i * 7 + k * k) % 3 % 2] for k in range(30))) for i in range(12)]
    got = op1.dedup_digest(spark.createDataFrame(rows, "doc_id long, text string"), window=9, gram=3, group=4)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == in_order(brute.substring_dedup(rows, 9))


def test_a_stretch_twice_in_one_document(spark):
    """Both places are judged against a document that shares only a part of the stretch."""
    p = [f"p{k}" for k in range(60)]
    rows = [(1, " ".join(["x"] * 3 + p[:55])), (2, " ".join(p + ["y"] + p + ["z"]))]
    got = op1.dedup_digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == in_order(brute.substring_dedup(rows))


def test_spans_of_equal_rows_are_listed_once(spark):
    """All null ids count as one; their copies don't lengthen the list of each other."""
    p = [f"p{k}" for k in range(200)]
    rows = [(1, " ".join(p[:60])), (2, " ".join(p[120:]))] + [(None, " ".join(["x", *p, "y"]))] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = op1.repeated_spans(df)
    most = spans.groupBy("did", "th").agg(F.countDistinct("first", "size").alias("n")).agg(F.max("n")).first()[0]
    assert 0 < most == op1._with_spans(df, spans, "doc_id", "text").agg(F.max(F.size("runs"))).first()[0]
    assert rows_of(op1.dedup_digest(df), "doc_id", "n_words", "n_removed", "kept_sha256") == in_order(brute.substring_dedup(rows))


# -- quality rules

def test_quality_rules(case):
    df, rows = case
    got = rows_of(op2.judge(df), "doc_id", *op2.FIELDS, "base_failed", "kept")
    bad = brute.rejected_hosts(pairs(rows, 3, 1))
    assert got == in_order((r[0], *brute.base_stats(r[1]), brute.base_failed(r[1]), not brute.base_failed(r[1]) and r[3] not in bad) for r in rows)


def test_bad_host_goes(spark):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(i, "bad" if i % 2 else "good", "short" if i % 2 and i % 9 else good) for i in range(200)]
    rows += [(500 + i, None, "short") for i in range(300)] + [(900, "new", "short")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert brute.rejected_hosts([(r[1], r[2]) for r in rows]) == {"bad", "new"} - ({"new"} if ("new" not in {r["host"] for r in op2.host_verdicts(op2.host_failures(df.selectExpr("source as host", "text = 'short' as failed"), "host", "failed")).filter("rejected").collect()}) else set())
    assert {r["source"] for r in op2.keep_good(df).collect()} == {"good"}


def test_filter_keeps_columns(edges):
    kept = op2.keep_good(edges)
    assert kept.columns == edges.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(r["doc_id"] for r in op2.judge(edges).filter("kept and doc_id is not null").collect())


# -- language models

def close(got, want):
    for g, w in zip(got, in_order(want), strict=True):
        assert g[:2] == w[:2] and np.allclose(g[2:4], w[2:], atol=1e-5) and math.isclose(g[4], g[2] - g[3], abs_tol=1e-8)


@pytest.mark.parametrize("frequent", [1 << 18, 60])
def test_lm_scores(case, spark, monkeypatch, frequent):
    """Terms that are broadcast and terms that are joined give the same sums."""
    monkeypatch.setattr(op3, "FREQUENT_WORDS", frequent)
    monkeypatch.setattr(op3, "FREQUENT_PAIRS", 300)
    df, rows = case
    targets = {r[0] for r in rows if r[0] is not None and r[0] % 3 == 0}
    labels = spark.createDataFrame([(i, int(i in targets)) for i in {r[0] for r in rows if r[0] is not None}] + [(None, 1)], "doc_id long, quality int")
    got = op3.scored(df, op3.train(df, op3.good_ids(labels), min_pair=2))
    close(rows_of(got, "doc_id", "n_words", "h_target", "h_background", "score"),
          brute.lm_scores(pairs(rows, 0, 1), targets, min_pair=2, frequent=frequent))


@pytest.mark.parametrize(("share", "min_pair"), [(60, 2), (60, 5), (1 << 20, 5)])
def test_lm_pairs_of_all_words(case, monkeypatch, spark, share, min_pair):
    """Words that are joined have pairs like those that are broadcast."""
    monkeypatch.setattr(op3, "BROADCAST_WORDS", share)
    monkeypatch.setattr(op3, "FREQUENT_PAIRS", 300)
    df, rows = case
    targets = {r[0] for r in rows if r[0] is not None and r[0] % 3 == 0}
    models = op3.train(df, spark.createDataFrame([(i,) for i in targets], "doc_id long"), min_pair=min_pair)
    close(rows_of(op3.scored(df, models), "doc_id", "n_words", "h_target", "h_background", "score"),
          brute.lm_scores(pairs(rows, 0, 1), targets, min_pair=min_pair, frequent=1 << 40))


def test_lm_counts_pairs_of_seldom_words(spark):
    """Words of a share below one in 2^18 have pairs too."""
    rows = [(0, "x " * 1_400_000)] + [(i, "seldom seen words") for i in range(1, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    models = op3.train(df, spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert models.pairs == 5  # x x, < seldom, seldom seen, seen words, words >
    close(rows_of(op3.scored(df, models), "doc_id", "n_words", "h_target", "h_background", "score"),
          brute.lm_scores(rows, {1, 2}, frequent=1 << 40))


def test_lm_model_grows_with_the_corpus(spark, monkeypatch):
    """More words make a larger model; documents outside of it can be scored."""
    monkeypatch.setattr(op3, "FREQUENT_WORDS", 50)
    monkeypatch.setattr(op3, "FREQUENT_PAIRS", 60)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 150) % 5000)) for i in range(60)] + [(3, "w1 w2 w1 w2"), (70, None), (None, "w1 alone"), (None, "w1 alone")]
    df, targets = spark.createDataFrame(rows, "doc_id long, text string"), {i for i in range(0, 60, 4)} | {3}
    ids = spark.createDataFrame([(i,) for i in targets], "doc_id long")
    models = op3.train(df, ids)
    count = Counter(w for r in rows for w in brute.words(r[1]))
    assert models.size == sum(n >= 3 for n in count.values()) and models.pairs > 0 and models.terms.count() > 50
    assert op3.train(df.filter("doc_id < 20"), ids).size < models.size
    want = brute.lm_scores(rows, targets, frequent=50)
    close(rows_of(op3.scored(df, models), "doc_id", "n_words", "h_target", "h_background", "score"), want)
    more = df.filter("doc_id < 3").unionByName(spark.createDataFrame([(100, "never seen words")], df.schema))
    got = {r["doc_id"]: r for r in op3.scored(more, models).collect()}
    old = {w[0]: w for w in want}
    assert all(math.isclose(got[i]["h_background"], old[i][3], abs_tol=1e-5) for i in (0, 1, 2))
    assert got[100]["n_words"] == 3 and got[100]["h_background"] > max(got[i]["h_background"] for i in (0, 1, 2))


def test_lm_without_targets_is_uniform(spark):
    df = spark.createDataFrame([(1, "a b a b a"), (2, "a a a")], "doc_id long, text string")
    got = op3.scored(df, op3.train(df, spark.createDataFrame([], "doc_id long"))).collect()
    assert all(math.isclose(r["h_target"], math.log2(1 + 2), abs_tol=1e-6) for r in got)  # a, the rare class, the end mark


# -- tokens

def test_token_counts(case, library):
    df, rows = case
    got = rows_of(op5.count_tokens(df, PATH), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(r[0], len((r[1] or "").encode()), len(library(r[1] or ""))) for r in rows]
    assert got == in_order((*r, r[2] > 512) for r in want)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_tokenizers(docs, corpus, name):
    path = op5.tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        encode = lambda text: t.encode(text, add_special_tokens=False).ids
    assert rows_of(op5.count_tokens(docs, path), "doc_id", "n_tokens") == in_order((r[0], len(encode(r[1]))) for r in corpus[0])


def test_token_output(case, library):
    df, rows = case
    got = rows_of(op4.token_output(df, PATH), "doc_id", "start", "n_tokens", "ids_crc32")
    want = brute.token_rows(pairs(rows, 0, 1), library)
    if len({r[0] for r in rows}) == len(rows):
        assert got == in_order(want)
    else:  # the order of equal ids is the operator's own
        assert Counter(pairs(got, 0, 2, 3)) == Counter(pairs(want, 0, 2, 3))
        assert sorted(pairs(got, 1)) == sorted(pairs(want, 1)) or sum(r[2] for r in got) == sum(r[2] for r in want)
        at = 0
        for r in sorted(got, key=lambda r: r[1]):
            assert r[1] == at
            at += r[2]


def test_many_empty_texts_make_bounded_shards(spark, library, monkeypatch):
    """Equal rows are dealt to several tasks, and a shard ends after so many documents."""
    monkeypatch.setattr(op4, "SHARD_DOCS", 50)
    monkeypatch.setattr(op4, "READ_ROWS", 30)
    rows = [(None, None)] * 700 + [(i // 2, "") for i in range(300)] + [(7, "some words")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = run_folder(spark, "ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = op4.write_ids(df, folder, PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per_part = [r["n"] for r in manifest.groupBy("part").agg(F.sum("n_docs").alias("n")).collect()]
    assert len(per_part) > 1 and max(per_part) < len(rows) and manifest.agg(F.max("n_docs")).first()[0] <= 1_000
    got = rows_of(op4.read_ids(manifest), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == in_order(brute.token_rows(rows, library))


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_shards_round_trip(spark, docs, corpus, library, kind, monkeypatch):
    monkeypatch.setattr(op4, "BLOCK_IDS", 1000)
    folder = run_folder(spark, "round-trip")
    manifest = op4.write_ids(docs.coalesce(1), folder, PATH, kind=kind).collect()
    assert sum(r["n_docs"] for r in manifest) == len(corpus[0])
    found = {}
    for r in manifest:
        shard = op4.ShardReader(r["path"])
        for d, _, ids in shard.pieces():
            found.setdefault(int(shard.docs[d]), []).extend(ids.tolist())
    assert found == {r[0]: [*library(r[1]), 2] for r in corpus[0]}


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes(kind):
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (7, 2), (1000, 50_257), (65_536, 2**32), (13, 256)):
        ids = rng.integers(0, top, n, dtype=np.uint32)
        assert (op4.from_planes(op4.to_planes(ids, kind), n, kind) == ids).all()


# -- n-gram join

def test_ngram_join_of_large_buckets(docs, corpus):
    got = rows_of(op6.similar(docs, slot=2), "doc_id", "class_id", "n_links")
    assert got == in_order(brute.near_classes(pairs(corpus[0], 0, 1)))


def test_ngram_join(case):
    df, rows = case
    got = rows_of(op6.similar(df), "doc_id", "class_id", "n_links")
    # Wordless documents are classes of their own: their id, and no links.
    assert got == in_order(brute.near_classes(pairs(rows, 0, 1)))


def test_bands_reach_the_recall():
    bands, rows = op6.choose_bands(0.8, 0.9995, 128)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 128


def test_one_of_each(docs, corpus, edges):
    classes = brute.near_classes(pairs(corpus[0], 0, 1))
    assert sorted(r["doc_id"] for r in op6.one_of_each(docs).collect()) == sorted({c for _, c, _ in classes})
    kept = op6.one_of_each(edges)
    assert kept.columns == edges.columns
    # 5 (one of its rows), 4 for the long pair; the texts without words stay.
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 8]


def test_rows_without_words_all_stay(spark):
    rows = [(None, None), (None, ""), (None, None), (7, None), (7, ""), (7, " \n"), (7, " \n"), (8, "one two"), (8, "one two"), (9, "one two")]
    kept = op6.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(kept, "doc_id", "text") == in_order(rows[:8])


def test_a_chain_of_near_copies(spark):
    """Links that no single bucket holds still make one class."""
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(30):
        if i:
            base = list(base)
            base[(i * 3) % 100] = f"n{i}"
        rows.append((i, " ".join(base)))
    got = rows_of(op6.similar(spark.createDataFrame(rows, "doc_id long, text string"), slot=3), "doc_id", "class_id", "n_links")
    want = in_order(brute.near_classes(rows))
    assert pairs(got, 0, 1) == pairs(want, 0, 1)
    assert sum(r[2] for r in got) >= 0.99 * sum(r[2] for r in want)


# -- classifier

def test_rules_as_columns(spark, docs, corpus):
    x = op7.statistics(pa.array([r[1] for r in corpus[0]]))
    y = np.array([int("###" not in r[1]) for r in corpus[0]])
    model = op7.fit(np.tile(x, (5, 1)), np.tile(y, 5))
    assert model.rules and ((model.predict(x) >= 0.5) == (y == 1)).mean() > 0.95
    got = {r["doc_id"]: r["score"] for r in op7.scored(docs, model).collect()}
    assert np.allclose([got[r[0]] for r in corpus[0]], model.predict(x))


def test_classifier_learns_from_its_folds_only(spark):
    import zlib

    good, bad = " ".join(f"w{k}" for k in range(60)), " ".join(f"W{k}###" for k in range(60))
    rows = [(i, bad if i % 3 == 0 else good) for i in range(400)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = [(i, int(i % 3 != 0) if i not in held else int(i % 3 == 0)) for i, _ in rows] + [(None, 1), (3, None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = op7.train(docs, marks)
    got = op7.scored(docs, model).collect()
    assert {r["doc_id"] for r in got if r["held_out"]} == held
    assert all(r["predicted"] == int(r["doc_id"] % 3 != 0) == int(r["score"] >= 0.3) for r in got)


def test_classifier_edges(edges, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in op7.scored(edges, op7.train(edges, none)).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1), (8, 1)], "doc_id long, quality int")
    assert all(r["score"] > 0.99 for r in op7.scored(edges, op7.train(edges, one)).collect())
    assert op7.scored(empty, op7.train(empty, none)).count() == 0


def test_held_out_accuracy(spark):
    from conftest_paths import SF_MID

    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    got = op7.op7_quality_classifier(spark, SF_MID).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)


# -- html

PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>"
     "<article><h1>Head</h1><p><b>First &amp; best<br>line.<p>Second\n  line &lt;x&gt;.</p><p>Ok.</p></article><footer>&copy; us</footer></body></html>",
     "Head\nFirst & best line.\nSecond line <x>.\nOk."),
    ("<body><div id='cookie-notice'>We use cookies to give you the best experience on this site.</div><main><h2>A</h2><p>Some words stand here.</p>"
     "<aside>By the way</aside><ul><li>one thing</li><li>two things</li></ul></main><div class='comments'><p>I liked this one very much, thanks.</p></div>"
     "<form><label>Name</label><button>Send</button></form>", "A\nSome words stand here.\none thing\ntwo things"),
    ("<article><p>Unfinished &am", "Unfinished &am"), ("<article><p>cut <b", "cut"), ("", ""), (None, ""),
    ("<!-- <p>no</p> --><div class=ad>Buy this now and be happy.</div>", ""),
    ("<article><p>a<script>x<y</script>b</p><p hidden>gone</p><textarea>t</textarea></article>", "ab"),
    ("<article>" + "<p>Many short lines.</p>" * 3000 + "</article>", "\n".join(["Many short lines."] * 3000)),
]


def test_extraction(spark):
    df = spark.createDataFrame([(k, f"u{k}", p, "x") for k, (p, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0], "x")],
                               "page_id long, url string, html string, text string")
    got = rows_of(op8.extract_pages(df), "page_id", "url", "text", "n_chars")
    want = [(k, f"u{k}", t, len(t)) for k, (_, t) in enumerate(PAGES)] + [(0, None, PAGES[0][1], len(PAGES[0][1]))]
    assert got == in_order(want)
    assert op8.extract_pages(df.limit(0)).count() == 0


SENTENCES = "".join(f"<p>Here is sentence number {k} of a text that goes on for a while.</p>" for k in range(9))
SAID = "\n".join(f"Here is sentence number {k} of a text that goes on for a while." for k in range(9))


@pytest.mark.parametrize("before, after", [
    ("<article class='post category-x tag-python'>", "</article>"), ("<div class='content has-sidebar'>", "</div>"), ("<div class='post tag-x'>", "</div>"),
    ("<form id=aspnetForm>", "</form>"), ("<form id=f><main>", "</main></form>"), ("<div class='sidebar'><article>", "</article></div>"),
    ("<article><section id='discussion'>", "</section></article>"), ("<article><section id=legal>", "</section></article>"),
    ("<section id=related-work>", "</section>"), ("<div class=notice><div class='entry-content'>", "</div></div>"),
])
def test_names_and_forms_around_an_article(before, after):
    aside = "<div class='sidebar'><article><p>A card of another text.</p></article></div><div class='ad-box-300x250'><p>Buy this now and be happy.</p></div>"
    login = "<form><p>Name and password, please.</p></form><div class=legal><p>All rights are reserved here.</p></div>"
    assert op8.main_text(f"<body>{before}{SENTENCES}{after}{aside}{login}</body>") == SAID


def test_names_of_boilerplate():
    for strength, names in ((2, "ad ads ad-box ad-300x250 sidebar side-bar sidebar-right comment-list cookie-notice nav-links site-header share-buttons related-posts"),
                            (1, "legal discussion legal-notice tag"), (0, "tag-x tag-python has-sidebar no-sidebar content-sidebar related-work header post ad-x shadow")):
        assert {n: op8.name_strength(n) for n in names.split()} == dict.fromkeys(names.split(), strength)


def cut_cost(scores, edges, side):
    return (sum(s for s, x in zip(scores, side) if s > 0 and not x) - sum(s for s, x in zip(scores, side) if s < 0 and x)
            + sum(c for a, b, c in edges if side[a] != side[b]))


def test_large_and_deep_pages_take_time_in_proportion():
    import time

    wide = "<body><article>" + "<p>Some words that make a sentence here.</p>" * 300 + "</article>" + "<div>an odd line</div>" * 20_000
    deep = "<div>" * 30_000 + "x" + "</div>" * 30_000 + "<p>" * 3_000 + "<button>" + "<div>" * 10_000 + "<b><table><td>" + "</b><div>" * 10_000
    for page in (wide, deep):
        begun = time.thread_time()
        op8.main_text(page)
        assert time.thread_time() - begun < 2.5


def test_pages_shrink_to_nothing_before_any_flow(monkeypatch):
    """Rows of blocks with edges between siblings are series-parallel: no flow is left to send."""
    monkeypatch.setattr(op8, "_source_side", lambda *a: pytest.fail("flow"))
    rng = np.random.default_rng(4)
    nested = lambda d: "".join(f"<div>{'word ' * rng.integers(1, 9)}{nested(d - 1) if d else ''}</div>" for _ in range(3))
    page = nested(4)
    found = op8.blocks(page)
    scores = list(rng.normal(0, 1.0, len(found)))
    op8.minimum_cut(scores, op8.edges(found))


def test_minimum_cut():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        scores = rng.normal(size=n).round(3).tolist()
        edges = [(a, b, float(rng.uniform(0, 1.5))) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        got = op8.minimum_cut(scores, edges)
        best = min(cut_cost(scores, edges, [bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert math.isclose(cut_cost(scores, edges, got), best, abs_tol=1e-6)


# -- mixing

def test_mixture(case):
    df, rows = case
    got = rows_of(op9.mixture(df), "doc_id", "size", "source_size", "target", "taken")
    want = in_order((i, n, s, t, n * c) for i, n, s, t, c in brute.mixture([(r[0], r[3], r[1]) for r in rows]))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])
    assert all(g[4] <= 2 * g[1] for g in got)


def test_mixture_in_many_buckets(docs, corpus, monkeypatch):
    monkeypatch.setattr(op9, "BUCKET_ROWS", 2)
    got = rows_of(op9.mixture(docs), "doc_id", "taken")
    assert got == in_order((i, n * c) for i, n, _, _, c in brute.mixture([(r[0], r[3], r[1]) for r in corpus[0]]))


def test_a_source_of_equal_rows_comes_near_its_target(spark):
    """Equal rows are taken one by one, and so are rows of one key that differ elsewhere."""
    prose, same = "w " * 100, [(None, "x " * 50, None, "b", None)] * 3000
    rows = [(7, "y " * 100, "en", "a", 1)] * 900 + same + [(i, prose, "en", "c", i) for i in range(300)]
    rows += [(None, "z # " * 20, f"l{i}", "d", i) for i in range(700)]
    df = spark.createDataFrame(rows, DOCS)
    got = Counter((r["source_size"], r["target"], r["taken"] // max(1, r["size"])) for r in op9.mixture(df).collect())
    want = Counter((size, target, n) for _, _, size, target, n in brute.mixture(pairs(rows, 0, 3, 1)))
    assert got == want and len({t for _, t, _ in got}) > 2
    taken = Counter(r["source"] for r in op9.mixed(df).collect())
    assert taken == Counter({s: sum(n for (_, x, _), (_, _, _, _, n) in zip(pairs(rows, 0, 3, 1), brute.mixture(pairs(rows, 0, 3, 1))) if x == s) for s in taken})


def test_a_crowded_bucket_is_cut_until_it_is_small(spark, monkeypatch):
    monkeypatch.setattr(op9, "BUCKET_ROWS", 5)
    monkeypatch.setattr(op9, "SPLIT", 3)
    monkeypatch.setattr(op9, "UNFOLD_ROWS", 4)
    rows = [(i % 9 if i % 4 else None, "a # " * (1 + i % 5), "en", "s" if i % 3 else None, i % 2) for i in range(400)]
    got = rows_of(op9.mixture(spark.createDataFrame(rows, DOCS)), "doc_id", "size", "source_size", "target", "taken")
    want = in_order((i, n, s, t, n * c) for i, n, s, t, c in brute.mixture(pairs(rows, 0, 3, 1)))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]


def test_mix_repeats_documents(docs, corpus, edges):
    want = Counter()
    for i, _, _, _, c in brute.mixture([(r[0], r[3], r[1]) for r in corpus[0]]):
        want[i] += c
    mix = op9.mixed(docs)
    assert mix.columns == docs.columns
    assert Counter(r["doc_id"] for r in mix.collect()) == +want
    assert op9.mixed(edges).columns == edges.columns


def test_mixing_is_native(docs):
    plan = op9.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


# -- decontamination

def test_masks_find_every_two_changes():
    from itertools import combinations

    for changed in combinations(range(op10.WINDOW), op10.MAX_CHANGED):
        assert any(all(m[k] == "0" or k + o not in changed for k in range(len(m)))
                   for m in op10.MASKS for o in range(op10.WINDOW - len(m) + 1))


@pytest.mark.parametrize("bits", [op10.FILTER_BITS, 64])
def test_leaks(case, items, corpus, bits):
    df, rows = case
    got = {(r["doc_id"], r["item_id"]) for r in op10.leaks(df, items, bits=bits).collect()}
    assert got == brute.leaks(pairs(rows, 0, 1), corpus[1])


def test_changed_passages(spark, items, corpus):
    item = corpus[1][3][1].split()
    rows = []
    for k in range(12):
        w = list(item)
        for j in range(k):
            w[(j * 7) % len(w)] = "changed"
        rows.append((k, "before it " + " ".join(w) + " after it"))
    rows.append((99, " ".join(x.upper() for x in item)))
    got = {(r["doc_id"], r["item_id"]) for r in op10.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == brute.leaks(rows, corpus[1]) and (99, 3) in got and (11, 3) not in got


def test_short_items(spark):
    """One changed word at any place of an item of 5 to 12 words; whole lines and texts for shorter ones."""
    short = {n: [f"s{n}x{k}" for k in range(n)] for n in range(1, 13)}
    rows, want = [], set()
    for n, item in short.items():
        for k in range(-1, n):
            for more in ([], ["y"] if n > 1 else []):
                w = [*item]
                if k >= 0:
                    w[k] = "changed"
                if more:
                    w[k - 1] = "y"
                i = len(rows)
                rows.append((i, "some words before " + " ".join(w) + " and after"))
                if n >= 5 and sum(a != b for a, b in zip(w, item, strict=True)) <= 1:
                    want.add((i, n))
    for n in range(1, 5):
        item = " ".join(short[n])
        for text, hit in ((item, True), (f"before\n {item.upper()} \r\nafter it", True), ("\n".join(short[n]), True), (f"before\n{item} more\nafter", False),
                          (f"before {item}\nafter", False)):
            if hit:
                want.add((len(rows), n))
            rows.append((len(rows), text))
    rows += [(1000, "s1x0\n\ns2x0 s2x1"), (1001, ""), (1002, None)]
    want |= {(1000, 1), (1000, 2)}
    items = spark.createDataFrame([(n, " ".join(w)) for n, w in short.items()] + [(50, ""), (51, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op10.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == want


def test_many_alignments_are_checked_in_parts(spark, monkeypatch):
    """A phrase that a long document repeats, and that many items have."""
    monkeypatch.setattr(op10, "SHIFTS", 64)
    phrase = [f"p{k}" for k in range(11)]
    items = [(i, " ".join([f"a{i}x{k}" for k in range(3)] + phrase + [f"z{i}x{k}" for k in range(4)])) for i in range(12)] + [(3, "other words " * 9)]
    long = " ".join(" ".join(phrase) + f" n{k}" for k in range(400))
    docs = [(1, long), (2, "x " * 30 + items[4][1] + " y" * 700 + " " + items[7][1]), (None, None), (5, "")]
    got = op10.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == brute.leaks(docs, items)


def test_runs_delete_their_own_tables_only(spark, edges):
    from sellerlens.llm.common import scratch, written

    kept = op2.judge(edges)
    with scratch(spark):
        inner = written(edges.select("doc_id"), "inner")
        assert inner.count() == len(EDGES)
    assert kept.count() == len(EDGES)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        inner.select("doc_id").distinct().collect()


def test_without_leaks(spark, docs, items, corpus, edges):
    bad = {i for i, _ in brute.leaks(pairs(corpus[0], 0, 1), corpus[1])}
    assert bad and sorted(r["doc_id"] for r in op10.without_leaks(docs, items).collect()) == sorted(r[0] for r in corpus[0] if r[0] not in bad)
    none = spark.createDataFrame([], "item_id long, text string")
    assert op10.without_leaks(edges, none).count() == edges.count()
    odd = spark.createDataFrame([(None, None), (1, ""), (2, " ".join(f"v{k}" for k in range(20, 40))), (2, " ".join(f"v{k}" for k in range(20, 40)))], "item_id long, text string")
    left = op10.without_leaks(edges, odd)
    assert left.columns == edges.columns and not {r["doc_id"] for r in left.collect()} & {5, 7}
