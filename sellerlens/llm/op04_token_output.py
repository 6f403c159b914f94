"""Token ids in bit-plane shards.

The ids of all documents, each with an end id, form one stream in ascending
doc_id order. It is cut into shards, and a shard into blocks of BLOCK_IDS ids. A
block is transposed into planes (bit k of every id, or byte k), each plane is
compressed with zstandard on its own, and the planes that are all zero are left
out. A shard file is

    magic | planes of block 0 | planes of block 1 | ... | footer | footer length (8 bytes) | magic

and its footer, zstandard over JSON and two arrays, has the block index (offset,
first id, number of ids, plane lengths) and the documents (doc_id, n_tokens), so
a reader seeks to any block or document.

Scale: documents are dealt by range of (doc_id, text hash, a random number), so rows that are equal are dealt to several tasks too, sorted in each task,
encoded there and written as they come; a task holds one block of ids, and starts a
new shard after SHARD_IDS ids or SHARD_DOCS documents, so a footer is bounded however short the texts are. File names hold the task attempt, and only the
attempt that Spark commits lists its files in the manifest, so lost executors and
retries leave no wrong data. The manifest has one row per shard; the place of a
shard in the whole stream is a running sum over it.

Defined cases: a null text encodes as empty (the end id alone); a null doc_id
comes first; equal ids are ordered by a hash of the text, and equal rows are
written as often as they come; a very long text is encoded alone and may span blocks; an empty table gives no shard and no rows;
other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerlens.llm.common import run_folder, table
from sellerlens.llm.op05_token_counts import TOKENIZER, tokenizer_path
from sellerlens.llm.pretokens import encode_chunk, encoder
from sellerlens.llm.textops import chunks

END_ID = 2
BLOCK_IDS = 1 << 16
SHARD_IDS, SHARD_DOCS = 1 << 26, 1 << 20
#: Rows of a batch that is read back.
READ_ROWS = 50_000
MAGIC = b"BITPLAN1"

MANIFEST = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("path", T.StringType()),
    T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("n_bytes", T.LongType()),
])
READ = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


def open_store(url: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a folder or file that all executors see."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", url))


def to_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """The planes of a block of ids, lowest first; an all-zero plane is empty."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(len(ids), 4)
    if kind == "byte":
        planes = raw.T
    else:
        used = -(-max(1, int(ids.max(initial=0)).bit_length()) // 8)
        planes = np.packbits(np.unpackbits(raw[:, :used], axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, p in enumerate(planes):
            if p:
                raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        size = (n + 7) // 8
        bits = np.zeros((-(-len(planes) // 8) * 8, size), np.uint8)
        for k, p in enumerate(planes):
            if p:
                bits[k] = np.frombuffer(p, np.uint8)
        wide = np.unpackbits(bits, axis=1, bitorder="little")[:, :n]
        raw[:, : len(bits) // 8] = np.packbits(wide.T, axis=1, bitorder="little")
    return raw.view("<u4").reshape(n)


class ShardWriter:
    """Writes one shard: `add` documents, then `close`."""

    def __init__(self, url: str, kind: str = "bit"):
        store, path = open_store(url)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.url, self.kind, self.out = url, kind, store.open_output_stream(path)
        self.out.write(MAGIC)
        self.at, self.n_ids, self.n_docs = len(MAGIC), 0, 0
        self.blocks: list[list] = []
        self.docs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents' ids, one after another; a null doc_id is the least long."""
        self.docs.append(doc_ids)
        self.n_docs += len(doc_ids)
        self.sizes.append(sizes)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK_IDS:
            ids = np.concatenate(self.waiting)
            full = len(ids) // BLOCK_IDS * BLOCK_IDS
            for k in range(0, full, BLOCK_IDS):
                self._block(ids[k : k + BLOCK_IDS])
            self.waiting, self.n_waiting = [ids[full:]], len(ids) - full

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) if p else b"" for p in to_planes(ids, self.kind)]
        self.out.write(b"".join(planes))
        self.blocks.append([self.at, self.n_ids, len(ids), [len(p) for p in planes]])
        self.at += sum(map(len, planes))
        self.n_ids += len(ids)

    def close(self) -> dict:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        docs, sizes = np.concatenate(self.docs), np.concatenate(self.sizes)
        head = json.dumps({"kind": self.kind, "n_ids": self.n_ids, "n_docs": len(docs), "blocks": self.blocks}).encode()
        footer = self.zstd.compress(len(head).to_bytes(8, "little") + head + docs.astype("<i8").tobytes() + sizes.astype("<i8").tobytes())
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return {"path": self.url, "n_docs": len(docs), "n_ids": self.n_ids, "n_bytes": self.at + len(footer) + 16}


class ShardReader:
    """Reads a shard: `docs` and `sizes` of its documents, and its ids by block."""

    def __init__(self, url: str):
        store, path = open_store(url)
        self.file = store.open_input_file(path)
        end = self.file.size()
        tail = self._read(end - 16, 16)
        if tail[8:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError(f"not a shard: {url}")
        length = int.from_bytes(tail[:8], "little")
        self.zstd = zstandard.ZstdDecompressor()
        footer = self.zstd.decompress(self._read(end - 16 - length, length))
        cut = 8 + int.from_bytes(footer[:8], "little")
        self.head = json.loads(footer[8:cut])
        both = np.frombuffer(footer[cut:], "<i8")
        self.docs, self.sizes = both[: len(both) // 2], both[len(both) // 2 :]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> np.ndarray:
        at, _, n, lengths = self.head["blocks"][k]
        raw, planes = self._read(at, sum(lengths)), []
        for x in lengths:
            planes.append(self.zstd.decompress(raw[:x]) if x else b"")
            raw = raw[x:]
        return from_planes(planes, n, self.head["kind"])

    def pieces(self) -> Iterator[tuple[int, bool, np.ndarray]]:
        """(document, is its last piece, ids), in order; a document that spans blocks comes in pieces."""
        ends = np.cumsum(self.sizes)
        d = at = 0
        for k in range(len(self.head["blocks"])):
            ids = self.block(k)
            lo = 0
            while lo < len(ids):
                hi = min(len(ids), int(ends[d]) - at)
                last = at + hi == ends[d]
                yield d, last, ids[lo:hi]
                d, lo = d + last, hi
            at += len(ids)


_NULL = np.iinfo(np.int64).min


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, kind: str, end_id: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    part, attempt = task.partitionId(), task.taskAttemptId()
    rows, out = [], None
    for batch in batches:
        ids_of, texts = batch.column(0), batch.column(1)
        for lo, hi in chunks(texts):
            ids, counts = encode_chunk(texts.slice(lo, hi - lo), encoder(path))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, np.uint32(end_id))
            out = out or ShardWriter(f"{folder}/part-{part:06d}-{len(rows):04d}-{attempt}.ids", kind)
            out.add(ids_of.slice(lo, hi - lo).fill_null(_NULL).to_numpy(), counts + 1, ids)
            if out.n_ids >= SHARD_IDS or out.n_docs >= SHARD_DOCS:
                rows.append({"part": part, "shard": len(rows)} | out.close())
                out = None
    if out:
        rows.append({"part": part, "shard": len(rows)} | out.close())
    yield pa.RecordBatch.from_pylist(rows, pa.schema(
        [(f.name, pa.string() if f.name == "path" else pa.int64()) for f in MANIFEST.fields]))


def write_ids(docs: DataFrame, folder: str, path: str, kind: str = "bit", end_id: int = END_ID,
              doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards under `folder`/ids and returns the manifest, written to `folder`/manifest."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _write(batches, f"{folder}/ids", path, kind, end_id)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("any", F.rand(4))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("any")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for url, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = ShardReader(url)
            starts = base + np.cumsum(shard.sizes) - shard.sizes
            sums, crc = np.zeros(len(shard.docs), np.int64), 0
            for d, last, ids in shard.pieces():
                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                if last:
                    sums[d], crc = crc, 0
            for lo in range(0, len(sums), READ_ROWS):
                some = slice(lo, lo + READ_ROWS)
                docs = shard.docs[some]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=docs == _NULL), pa.array(starts[some]), pa.array(shard.sizes[some]),
                                                  pa.array(sums[some])], READ.names)


def read_ids(manifest: DataFrame) -> DataFrame:
    """One row per document, from the shards: doc_id, start in the whole stream, n_tokens, ids_crc32."""
    before = W.orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return placed.repartition(max(1, min(manifest.count(), 10_000))).mapInArrow(_read_back, READ)


def token_output(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Writes the ids of `docs` and reads the files back, one row per document."""
    return read_ids(write_ids(docs, folder or run_folder(docs.sparkSession, "ids"), path))


def op4_token_output(spark, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))
