"""Operator 1: token ids in a bit-plane shuffled binary table.

Documents are put in ascending ``doc_id`` order by a range partitioning (one
shard a partition); a shard's ids, each document's followed by the end id, are
one stream cut into blocks of a fixed number of ids.  A block is transposed into
byte planes (plane k holds byte k of every id) or bit planes, and each plane is
compressed with zstandard.  One row a block is stored: its place in the stream,
its planes, a checksum, and the chunk index, that is which documents the block
holds and where they begin.  Blocks can be read in any order and by any number
of tasks; only documents that cross a block border are put together afterwards.

Results for odd input: null text is an empty document (its end id only); a null
doc_id sorts first; rows that repeat a doc_id are kept as documents of their
own, equal ids in the order of their text's hash; an empty table gives an empty
store; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import chunks
from .store import Stage, partitions
from .tokens import encode_chunk, separable, tokenizer_path, word_table

BLOCK_IDS = 1 << 16
SCHEMA = ("shard int, block long, first long, n_ids int, bits int, crc long, planes array<binary>, "
          "first_doc long, continued boolean, open boolean, doc_ids array<long>, at array<int>")
_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int32()), ("bits", pa.int32()),
                    ("crc", pa.int64()), ("planes", pa.list_(pa.binary())), ("first_doc", pa.int64()), ("continued", pa.bool_()),
                    ("open", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])


def shuffle_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids: 4 byte planes (bits=8) or 32 bit planes (bits=1)."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [raw[:, k].tobytes() for k in range(4)]
    return [np.packbits((raw[:, k // 8] >> (k % 8)) & 1).tobytes() for k in range(32)]


def join_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    """The ids whose planes `shuffle_planes` gave."""
    raw = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        part = np.frombuffer(plane, np.uint8)
        if bits == 8:
            raw[:, k] = part
        else:
            raw[:, k // 8] |= np.unpackbits(part, count=n) << np.uint8(k % 8)
    return raw.reshape(-1).view("<u4")


class _Shard:
    """The ids of a shard that no block holds yet, and the documents that they belong to."""

    def __init__(self, shard: int, block: int, bits: int, level: int):
        self.shard, self.block, self.bits, self.zstd = shard, block, bits, zstandard.ZstdCompressor(level=level)
        self.ids, self.first, self.number = np.zeros(0, np.uint32), 0, 0
        self.doc_ids, self.starts, self.first_doc = [], np.zeros(0, np.int64), 0

    def add(self, ids, sizes, doc_ids) -> None:
        self.starts = np.concatenate([self.starts, self.first + len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.doc_ids += doc_ids

    def take(self, n: int) -> pa.RecordBatch:
        """The next n ids as a row."""
        ids, end = self.ids[:n], self.first + n
        docs = int(np.searchsorted(self.starts, end))
        continued = bool(self.starts[0] < self.first)
        still_open = bool(docs == len(self.starts) and len(self.ids) > n) or bool(docs < len(self.starts) and self.starts[docs] > end)
        row = dict(shard=self.shard, block=self.number, first=self.first, n_ids=n, bits=self.bits, crc=zlib.crc32(ids.tobytes()),
                   planes=[self.zstd.compress(p) for p in shuffle_planes(ids, self.bits)], first_doc=self.first_doc, continued=continued,
                   open=still_open, doc_ids=self.doc_ids[:docs], at=np.maximum(self.starts[:docs] - self.first, 0).tolist())
        gone = docs - still_open
        self.doc_ids, self.starts, self.first_doc = self.doc_ids[gone:], self.starts[gone:], self.first_doc + gone
        self.ids, self.first, self.number = self.ids[n:], end, self.number + 1
        return pa.RecordBatch.from_pylist([row], schema=_ARROW)


def _encode(path: str, end_id: int, block: int, bits: int, level: int):
    def run(batches):
        shard, table = _Shard(TaskContext.get().partitionId(), block, bits, level), word_table(path)
        for rows, offsets, data in chunks(batches):
            flat, n = encode_chunk(table, offsets, data)
            shard.add(np.insert(flat, np.cumsum(n), end_id).astype(np.uint32), n + 1, rows.column("doc_id").to_pylist())
            while len(shard.ids) >= block:
                yield shard.take(block)
        if len(shard.ids):
            yield shard.take(len(shard.ids))
    return run


def write_token_blocks(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, block: int = BLOCK_IDS,
                       bits: int = 8, level: int = 3, shards: int | None = None) -> None:
    """Encode every whole text of (doc_id, text) and write the block table to `path`.

    bits: 8 for byte planes, 1 for bit planes.  A shard's blocks stay in one task's order, so the store
    reads as one stream of ids in ascending doc_id order."""
    tokenizer = tokenizer_path(tokenizer)
    if not separable(tokenizer):
        raise ValueError(f"{tokenizer} does not cut text at white space")
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    ordered = (keyed.repartitionByRange(shards or partitions(spark), "doc_id", "h", "row")
               .sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text"))
    (ordered.mapInArrow(_encode(tokenizer, end_id, block, bits, level), SCHEMA)
     .write.option("compression", "none").parquet(path))


_SEGMENT = "shard int, doc long, doc_id long, start long, n long, crc long, part binary"
_SEGMENT_ARROW = pa.schema([("shard", pa.int32()), ("doc", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()),
                            ("n", pa.int64()), ("crc", pa.int64()), ("part", pa.binary())])


def _segments(keep_ids: bool):
    def run(batches):
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                ids = join_planes([zstd.decompress(p) for p in row["planes"]], row["n_ids"], row["bits"])
                raw = ids.tobytes()
                if zlib.crc32(raw) != row["crc"]:
                    raise ValueError(f"block {row['block']} of shard {row['shard']} is damaged")
                at, docs = row["at"] + [row["n_ids"]], len(row["at"])
                out = []
                for k in range(docs):
                    part = raw[4 * at[k]:4 * at[k + 1]]
                    whole = not (k == 0 and row["continued"]) and not (k == docs - 1 and row["open"])
                    out.append((row["shard"], row["first_doc"] + k, row["doc_ids"][k], row["base"] + row["first"] + at[k], at[k + 1] - at[k],
                                zlib.crc32(part) if whole else None, part if keep_ids or not whole else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SEGMENT_ARROW.types)], schema=_SEGMENT_ARROW)
    return run


def read_token_blocks(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """One row a document of the store at `path`: doc_id, start (ids before it), n_tokens, ids_crc32 (of its ids
    as little-endian unsigned 32-bit integers) and, with keep_ids, those bytes as `ids`.

    Whole documents of a block are finished in the block's task; parts of a document that crosses a border
    are joined by its place in the shard."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    segments = blocks.join(F.broadcast(base), "shard").mapInArrow(_segments(keep_ids), _SEGMENT)
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("start", "part"))), F.lit(b""), lambda a, x: F.concat(a, x["part"]))
    out = segments.groupBy("shard", "doc").agg(
        F.max("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.max("crc").alias("crc"),
        joined.alias("ids"))
    out = out.select("doc_id", "start", "n_tokens", F.coalesce("crc", F.crc32("ids")).alias("ids_crc32"), "ids")
    return out if keep_ids else out.drop("ids")


def token_blocks(docs: DataFrame, **options) -> DataFrame:
    """Write the documents' ids into a store in the shared folder and read its documents back."""
    stage = Stage(docs.sparkSession, "token-blocks")
    write_token_blocks(docs, f"{stage.path}/blocks", **options)
    return read_token_blocks(docs.sparkSession, f"{stage.path}/blocks")
