"""Distinct-word tables of blocks of documents, and the way back from words to documents.

A task cuts its documents into blocks of a few megabytes and numbers each
block's distinct words by falling frequency.  Two kinds of rows leave a block:
its words, dealt into hash buckets, and its documents as word numbers.  The
bucket of a word is the same in every block, so one task sees all rows of a word
and works on it once; a word sends at most one row a block, so frequent words
are no hot keys.  What was found for the words goes back to their block by
(block, number), where the documents are put together again.

Both kinds are computed from the same scan of the input, so the rows of a task
must be the same each time they are read (true of files); a checksum of the
block's words travels with both and a difference raises an error.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SPACES, chunks, number_words, slices, word_spans, words_per_doc

#: words: blob of a bucket's words joined by spaces, with their numbers and counts; docs: documents as numbers.
WORDS = "block long, bucket int, crc long, idx binary, n binary, words binary"
DOCS = "block long, crc long, doc_ids array<long>, flags array<boolean>, sizes array<int>, codes binary"
_WORDS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("crc", pa.int64()), ("idx", pa.binary()), ("n", pa.binary()), ("words", pa.binary())])
_DOCS = pa.schema([("block", pa.int64()), ("crc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())),
                   ("sizes", pa.list_(pa.int32())), ("codes", pa.binary())])


def pack(values, dtype: str, level: int = 3) -> bytes:
    """Numbers as compressed byte planes."""
    raw = np.ascontiguousarray(values, dtype).view(np.uint8).reshape(-1, np.dtype(dtype).itemsize)
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack(blob: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def _blocks(batches, split):
    """(block id, rows, offsets, data, starts, ends, hashes, first, number) of each block of the task."""
    part = TaskContext.get().partitionId()
    for k, (rows, offsets, data) in enumerate(chunks(batches)):
        data, starts, ends = split(data, offsets)
        hashes, first, inverse = number_words(data, starts, ends)
        count = np.bincount(inverse, minlength=len(hashes)) if len(hashes) else np.zeros(0, np.int64)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        hashes, first = hashes[order], first[order]
        yield (part << 32) | k, rows, offsets, data, starts, ends, hashes, first, rank[inverse], zlib.crc32(hashes.tobytes())


def word_rows(docs: DataFrame, split, buckets: int) -> DataFrame:
    """WORDS rows of (doc_id, text, flag); n counts a word's occurrences in documents with a true flag."""
    def run(batches):
        for block, rows, offsets, data, starts, ends, hashes, first, number, crc in _blocks(batches, split):
            if not len(hashes):
                continue
            flag = np.asarray(rows.column("flag").fill_null(False).to_numpy(zero_copy_only=False), float)
            n = np.bincount(number, weights=np.repeat(flag, words_per_doc(starts, offsets)), minlength=len(hashes)).astype("<i8")
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            words = slices(data, starts[first[order]], ends[first[order]])
            cut = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist() + [len(order)]
            zstd = zstandard.ZstdCompressor(level=3)
            out = [(block, int(bucket[order[a]]), crc, pack(order[a:b], "<u4"), pack(n[order[a:b]], "<i8"), zstd.compress(b" ".join(words[a:b])))
                   for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _WORDS.types)], schema=_WORDS)
    return docs.select("doc_id", "text", "flag").mapInArrow(run, WORDS)


def doc_rows(docs: DataFrame, split) -> DataFrame:
    """DOCS rows of (doc_id, text, flag): a row a block."""
    def run(batches):
        for block, rows, offsets, data, starts, ends, hashes, first, number, crc in _blocks(batches, split):
            row = dict(block=block, crc=crc, doc_ids=rows.column("doc_id").to_pylist(), flags=rows.column("flag").to_pylist(),
                       sizes=words_per_doc(starts, offsets).tolist(), codes=pack(number, "<u4"))
            yield pa.RecordBatch.from_pylist([row], schema=_DOCS)
    return docs.select("doc_id", "text", "flag").mapInArrow(run, DOCS)


class Bucket:
    """The distinct words of a bucket over all blocks; row k of `owners` has the word rows of `inverse[k]`."""

    def __init__(self, rows: list[dict]):
        zstd = zstandard.ZstdDecompressor()
        self.rows = rows
        text = np.frombuffer(b" ".join(zstd.decompress(r["words"]) for r in rows), np.uint8)
        starts, ends = word_spans(text, np.asarray([0, len(text)]), ~SPACES)
        self.idx = [unpack(r["idx"], "<u4") for r in rows]
        self.hashes, first, self.inverse = number_words(text, starts, ends)
        if len(self.inverse) != sum(map(len, self.idx)):
            raise ValueError("a bucket's words and numbers differ")
        self.words = slices(text, starts[first], ends[first])
        self.cut = np.cumsum([0] + [len(i) for i in self.idx]).tolist()

    def counts(self) -> np.ndarray:
        n = np.concatenate([unpack(r["n"], "<i8") for r in self.rows])
        return np.bincount(self.inverse, weights=n, minlength=len(self.words)).astype(np.int64)

    def owners(self):
        """(row, word of each of its numbers) of each block."""
        for k, row in enumerate(self.rows):
            yield row, self.idx[k], self.inverse[self.cut[k]:self.cut[k + 1]]


def by_bucket(words: DataFrame, buckets: int, work, schema: str) -> DataFrame:
    """work(Bucket) -> RecordBatches, once for each bucket with all its rows, one bucket in memory at a time."""
    def run(batches):
        rows, now = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["bucket"] != now:
                    yield from work(Bucket(rows))
                    rows = []
                now = row["bucket"]
                rows.append(row)
        if rows:
            yield from work(Bucket(rows))
    return words.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, schema)


def by_block(docs: DataFrame, found: DataFrame, work, schema: str) -> DataFrame:
    """work(docs row as dict, rows of `found` as dicts) -> pa.Table for each block; every number must be found.

    found: (block, crc, idx, ...) rows of the block's words."""
    columns = [c for c in found.columns if c not in ("block", "crc")]
    both = docs.unionByName(found, allowMissingColumns=True)

    def run(key, group: pa.Table) -> pa.Table:
        doc, words = None, []
        for row in group.to_pylist():
            if row["doc_ids"] is not None:
                doc = row
            else:
                words.append({c: row[c] for c in columns} | {"crc": row["crc"]})
        if doc is None or any(w["crc"] != doc["crc"] for w in words):
            raise ValueError("the input changed while it was read")
        return work(doc, words)
    return both.groupBy("block").applyInArrow(lambda key, t: run(key, t), schema)


def flagged(docs: DataFrame, flag=None) -> DataFrame:
    return docs.select("doc_id", "text", (F.lit(True) if flag is None else flag).alias("flag"))
