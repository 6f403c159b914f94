"""The vectorised pre-tokenizer against the tokenizers library, and the word hashing it shares."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sellerlens.llm import pretokens
from sellerlens.llm.op05_token_counts import TOKENIZER, tokenizer_path
from sellerlens.llm.textops import Words, chunks, text_bytes

PATH = tokenizer_path(TOKENIZER)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def encoded(texts):
    ids, counts = pretokens.encode_chunk(pa.array(texts, pa.string()), pretokens.encoder(PATH))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def test_odd_texts(library):
    rng = random.Random(1)
    signs = list("  \n\t'sstrevemldll aA1９.,!é中 　 \x1c\x85'’٣²") + ["'re", "'ll", " 's", "<|endoftext|>", "  ", "\r\n", "'S"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["", None]
    assert encoded(texts) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=30), max_size=5))
def test_any_text(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    assert encoded(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_cache_starts_anew(library, monkeypatch):
    monkeypatch.setattr(pretokens, "CACHE_ENTRIES", 20)
    rng = random.Random(2)
    for _ in range(5):
        texts = [" ".join(str(rng.randrange(10**6)) for _ in range(15)) for _ in range(3)]
        assert encoded(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_hash_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 1 << 63, 5000, dtype=np.uint64))
    table = pretokens.HashTable(keys[:10], np.arange(10))
    for k in range(10, len(keys), 700):
        table.add(keys[k : k + 700], np.arange(k, min(k + 700, len(keys))))
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1 << 63)) == -1).all()
    assert table.find(keys[:0]).shape == (0,)


def test_words_of_a_chunk():
    texts = ["a b", None, "", " \t", "x", "é  ü\x0b z ", "a b"]
    w = Words(*text_bytes(pa.array(["skip", *texts], pa.string()).slice(1)))
    assert w.count.tolist() == [2, 0, 0, 0, 1, 3, 2]
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == ["a", "b", "x", "é", "ü", "z", "a", "b"]
    assert w.hash[0] == w.hash[6] and len(set(w.hash[:6].tolist())) == 6
    grams, at = w.grams(2)
    assert at.tolist() == [0, 3, 4, 6] and grams[0] == grams[3]


def test_chunks_cover_all_rows():
    texts = pa.array(["x" * k for k in (0, 5, 100, 0, 3, 3, 3, 50)])
    assert list(chunks(texts, 10)) == [(0, 2), (2, 3), (3, 7), (7, 8)]
    assert list(chunks(texts.slice(0, 0), 10)) == []
