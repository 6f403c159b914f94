"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the frequent pre-tokens (64-bit hash, token
count), broadcast to all tasks; its size is bounded by TABLE_ENTRIES. Tier two
is each worker's cache, filled by the tokenizers library for the pre-tokens
that the table lacks. No pre-token is shuffled, and each text is read once. The table's pre-tokens are the
commonest of a fixed sample, SAMPLE_DOCS texts of at most SAMPLE_BYTES bytes that Spark reads first; it only
spares the workers' first look-ups, and every count, of every whole text, is what the library gives.

The two tiers apply to byte-level BPE without a normalizer; for other .json
files and for .model files each text goes to the library whole.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); special
strings inside texts are special tokens, as the library's default has it; a very long text is counted whole, alone; equal
rows are counted one by one; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerlens.llm.common import table
from sellerlens.llm.pretokens import HashTable, Pieces, encoder, split_aside
from sellerlens.llm.textops import chunks, text_bytes

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
TABLE_ENTRIES = 16_384
#: Bounds of the sample that chooses the table.
SAMPLE_DOCS, SAMPLE_BYTES = 1_024, 16_384


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=8)
def is_byte_level(path: str) -> bool:
    """Whether the two tiers apply: byte-level BPE with the usual pattern and nothing before it."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not x["normalized"] and not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in spec["added_tokens"])
    return (plain and spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
            and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"))


@lru_cache(maxsize=2)
def _whole(path: str):
    """text -> number of tokens, by the library."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)


def _chunk_pieces(texts: pa.Array, path: str) -> tuple[Pieces, np.ndarray, np.ndarray, np.ndarray]:
    data, offs = text_bytes(texts)
    aside = encoder(path).aside(data, offs)
    return Pieces(*split_aside(data, offs, aside)), aside, data, offs


def frequent_pieces(docs: DataFrame, path: str, text: str = "text") -> HashTable:
    """Token counts of the TABLE_ENTRIES commonest pre-tokens of a sample."""
    # take reads a few tasks' rows at a time, until there are enough
    few = docs.select(F.col(text).alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES).take(SAMPLE_DOCS)
    texts, seen = pa.array([r[0] for r in few], pa.string()), Counter()
    for lo, hi in chunks(texts):
        p, *_ = _chunk_pieces(texts.slice(lo, hi - lo), path)
        _, at, n = np.unique(p.hash, return_index=True, return_counts=True)
        for i, times in zip(at, n, strict=True):
            seen[p.bytes_at(i)] += int(times)
    pieces = sorted(seen, key=lambda x: (-seen[x], x))[:TABLE_ENTRIES]
    ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
    p = Pieces(np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], ends]).astype(np.int64))
    return HashTable(p.hash, encoder(path).places(p, np.arange(len(p.hash)))[1])


def count_chunk(texts: pa.Array, path: str, frequent: HashTable) -> np.ndarray:
    """Tokens of each text."""
    p, aside, data, offs = _chunk_pieces(texts, path)
    counts = frequent.find(p.hash).astype(np.int64)
    missing = np.flatnonzero(counts < 0)
    counts[missing] = encoder(path).places(p, missing)[1]
    out = np.bincount(p.doc, weights=counts, minlength=len(texts)).astype(np.int64)
    for d in aside:
        out[d] = len(encoder(path).encode(data[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace")))
    return out


def token_count(docs: DataFrame, text: str, path: str) -> Column:
    """The number of tokens of a text column of `docs`."""
    if not is_byte_level(path):

        def whole(texts: pa.Array) -> pa.Array:
            count = _whole(path)
            return pa.array([count(t or "") for t in texts.to_pylist()], pa.int64())

        return F.arrow_udf(whole, T.LongType())(F.col(text))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, path, text))

    def tiers(texts: pa.Array) -> pa.Array:
        parts = [count_chunk(texts.slice(lo, hi - lo), path, shared.value) for lo, hi in chunks(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.int64())

    return F.arrow_udf(tiers, T.LongType())(F.col(text))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    n = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"),
                    token_count(docs, text, path).alias("n_tokens"))
    return n.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))
