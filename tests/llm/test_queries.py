"""The registered queries and the pipeline: DuckDB SQL where there is some, else plain versions."""

import hashlib
import os
import subprocess
import sys
from collections import Counter

import brute
import duckdb
import pytest
from conftest_paths import SF_MID, SF_SMALL

import __spark_entry__
import corpus_pipeline
from sellerlens.llm import op11_secret_scan as op11
from sellerlens.llm.common import run_folder, table
from sellerlens.llm.op05_token_counts import TOKENIZER, tokenizer_path
from sellerlens.llm.queries import QUERIES, SQL

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_thirteen_operators_and_the_pipeline():
    registered = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in registered) == 1
    assert "pipeline" in registered and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_equals_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.sql(SQL[name])
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == Counter(tuple(r[k] for k in at) for r in want.fetchall())


def plain(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    return docs, items


def collected(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_queries_equal_plain_versions(spark):
    from tokenizers import Tokenizer

    docs, items = plain(spark, SF_SMALL)
    library = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    encode = lambda t: library.encode(t, add_special_tokens=False).ids
    run = lambda name, *c: collected(QUERIES[name](spark, SF_SMALL), *c)
    assert run("op1_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring_dedup(docs))
    assert run("op4_token_output", "doc_id", "start", "n_tokens", "ids_crc32") == sorted(brute.token_rows(docs, encode))
    counts = [(i, len(t.encode()), len(encode(t))) for i, t in docs]
    assert run("op5_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted((*r, r[2] > 512) for r in counts)
    assert run("op6_ngram_join", "doc_id", "class_id", "n_links") == sorted(brute.near_classes(docs))
    assert {(r[0], r[1]) for r in run("op10_decontamination", "doc_id", "item_id")} == brute.leaks(docs, items)


def test_scans_and_variants_equal_plain_versions(spark):
    docs, _ = plain(spark, SF_SMALL)
    assert collected(QUERIES["op13_spelling_variants"](spark, SF_SMALL), "word", "root", "n", "n_near") == sorted(
        (w, root, n, near) for w, _, root, n, near, _ in brute.spelling_variants(docs))
    automata, symbols = op11.learn(table(spark, SF_SMALL, "documents")), op11.SYMBOLS.decode()
    want = []
    for i, t in docs:
        spans = brute.secret_spans(t, automata, symbols)
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans if k != "inferred")
        counts = [sum(k == kind for k, _, _ in spans) for kind in ("assign", "access", "hex")]
        want.append((i, *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in spans)))
    got = collected(QUERIES["op11_secret_scan"](spark, SF_SMALL), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert got == sorted(want) and any(r[1] for r in got)


def test_lm_query_equals_plain_version(spark):
    docs, _ = plain(spark, SF_SMALL)
    least = {}
    for r in table(spark, SF_SMALL, "labels").collect():
        least[r["doc_id"]] = min(r["quality"], least.get(r["doc_id"], 1))
    want = sorted(brute.lm_scores(docs, {i for i, q in least.items() if q == 1}))
    got = collected(QUERIES["op3_lm_scoring"](spark, SF_SMALL), "doc_id", "n_words", "h_target", "h_background")
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(x - y) < 1e-4 for g, w in zip(got, want, strict=True) for x, y in zip(g[2:], w[2:], strict=True))


def test_pipeline_equals_plain_versions(spark):
    """Each stage's plain version over its predecessor's rows; the last stage's rows are run()'s."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    rows = [(r["doc_id"], r["source"], r["text"]) for r in table(spark, SF_SMALL, "documents").collect()]
    items = plain(spark, SF_SMALL)[1]
    bad = brute.rejected_hosts([(s, t) for _, s, t in rows])
    rows = [r for r in rows if not brute.base_failed(r[2]) and r[1] not in bad]
    stays = {c for _, c, _ in brute.near_classes([(i, t) for i, _, t in rows])}
    rows = [r for r in rows if r[0] in stays]
    leaked = {i for i, _ in brute.leaks([(i, t) for i, _, t in rows], items)}
    rows = [r for r in rows if r[0] not in leaked]
    taken = brute.mixture(rows)
    texts = {i: t for i, _, t in rows}
    mixed = [(i, texts[i]) for i, _, _, _, c in taken for _ in range(c)]
    want = brute.token_rows(mixed, lambda t: library.encode(t, add_special_tokens=False).ids)
    got = collected(corpus_pipeline.run(spark, SF_SMALL), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == sorted(want)


def test_stages_return_the_columns_of_documents(spark, edges):
    folder, docs = run_folder(spark, "stages"), edges
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "token_ids"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_SMALL)
        if k < 4:
            assert out.columns == edges.columns
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    assert docs.count() > 0


def test_stages_on_no_documents(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_SMALL).count() == 0


def test_the_rest_does_without_the_subpackage(tmp_path):
    """__spark_entry__ imports, and lists the other queries, where the subpackage is not installed."""
    code = (
        "import sys, importlib.util as u; find = u.find_spec\n"
        "u.find_spec = lambda name, *a: None if name.startswith('sellerlens.llm') else find(name, *a)\n"
        "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q, len(e.oracle_sql()) > 0)"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 81 and out[1:] == ["False", "False", "True"]
