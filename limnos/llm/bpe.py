"""Operator 5: BPE encoding and decoding through a table of distinct words.

Documents are split into words in Spark's tasks; every distinct word of the
corpus meets in one hash bucket and is encoded once; ids return to the documents
by block and word number.  Decoding joins ids with the id-to-piece table of the
vocabulary, whose size is fixed, and joins the pieces with spaces, as the
library does for a file without decoder.

Results for odd input: null or empty text has no ids and decodes to the empty
text; rows that repeat a doc_id give a row each; an empty table gives no rows;
columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_blocks as W
from .kernels import ragged_take
from .store import partitions
from .tokens import encode_words, load, pieces, separable, split_words, tokenizer_path

_FOUND = "block long, crc long, idx binary, size binary, ids binary"
_KEPT = {"ids": (pa.list_(pa.int32()), "array<int>"), "decoded": (pa.string(), "string")}
_ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encode_bucket(path: str):
    schema = pa.schema([("block", pa.int64()), ("crc", pa.int64()), ("idx", pa.binary()), ("size", pa.binary()), ("ids", pa.binary())])

    def work(bucket: W.Bucket):
        ids, size = encode_words(load(path), bucket.words)  # each distinct word once
        at = np.cumsum(size) - size
        for row, _, word in bucket.owners():
            part, n = ragged_take(ids, at, size, word)
            yield pa.RecordBatch.from_pylist([dict(block=row["block"], crc=row["crc"], idx=row["idx"], size=W.pack(n, "<u4"), ids=W.pack(part, "<u4"))], schema=schema)
    return work


def _assemble(path: str, keep: tuple):
    def work(doc: dict, words: list[dict]) -> pa.Table:
        piece = np.asarray(pieces(path), object)  # the id-to-piece table
        count = sum(len(W.unpack(w["idx"], "<u4")) for w in words)
        raw, text = [b""] * count, [None] * count
        for w in words:
            idx, size, ids = W.unpack(w["idx"], "<u4").tolist(), W.unpack(w["size"], "<u4"), W.unpack(w["ids"], "<u4")
            ends = np.cumsum(size).tolist()
            data, names, a = ids.astype("<u4").tobytes(), piece[ids].tolist(), 0
            for k, b in zip(idx, ends):
                raw[k] = data[4 * a:4 * b]
                if b > a:
                    text[k] = " ".join(names[a:b])
                a = b
        codes, at, out = W.unpack(doc["codes"], "<u4"), 0, []
        if count < (int(codes.max()) + 1 if len(codes) else 0):
            raise ValueError("words of a block are missing")
        for doc_id, n in zip(doc["doc_ids"], doc["sizes"]):
            code = codes[at:at + n].tolist()
            ids = b"".join([raw[k] for k in code])
            decoded = " ".join([t for k in code if (t := text[k]) is not None])
            row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
            out.append(row + tuple(np.frombuffer(ids, "<i4") if name == "ids" else decoded for name in keep))
            at += n
        columns = list(zip(*out)) if out else [[]] * (4 + len(keep))
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[_KEPT[name][0] for name in keep]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    return work


def encode_decode(docs: DataFrame, tokenizer: str | None = None, keep: tuple = (), buckets: int | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every whole text.

    keep: further columns, of `ids` (array<int>) and `decoded`."""
    path = tokenizer_path(tokenizer)
    if not separable(path):
        raise ValueError(f"{path} does not cut text at white space")
    docs = W.flagged(docs)
    buckets = buckets or partitions(docs.sparkSession)
    found = W.by_bucket(W.word_rows(docs, split_words, buckets), buckets, _encode_bucket(path), _FOUND)
    return W.by_block(W.doc_rows(docs, split_words), found, _assemble(path, keep), ", ".join([_ENCODED, *[f"{name} {_KEPT[name][1]}" for name in keep]]))


def piece_table(spark, tokenizer: str | None = None) -> DataFrame:
    """(id, piece) of the vocabulary; as many rows as the vocabulary has."""
    return spark.createDataFrame(list(enumerate(pieces(tokenizer_path(tokenizer)))), "id long, piece string")


def decode(ids: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(key, decoded) of (key, ids array<long>): ids joined with the id-to-piece table and put in order by position.

    key must be unique; the array of a key is split over rows and joined by id, so no row grows but its own."""
    spread = ids.select("key", F.posexplode("ids").alias("pos", "id"))
    joined = spread.join(F.broadcast(piece_table(ids.sparkSession, tokenizer)), "id")
    text = joined.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ").alias("decoded"))
    return ids.select("key").join(text, "key", "left").select("key", F.coalesce("decoded", F.lit("")).alias("decoded"))
