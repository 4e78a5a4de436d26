"""Operator 12: SimHash near duplicates through a byte-position inverted index.

A fingerprint has 64 bits, one for every bit that is set in over half of the
hashes of a document's 3-word shingles.  Documents link when their fingerprints
differ in two bits or fewer.

1. Documents of one fingerprint are a class; from here on a fingerprint counts
   once, however many copies of a document share it.
2. Two differing bits touch two bytes at most, so linked fingerprints share at
   least SHARED = 6 of their 8 positional bytes.  Six of eight leave four of the
   first six positions at least, so a fingerprint is posted under the 15
   combinations of four positional bytes among those six: linked fingerprints
   meet in one of these lists.
3. Inside a list the shared positional bytes of each pair are tallied; pairs that
   reach the guaranteed minimum are verified bit by bit.
4. A list of over LONG fingerprints is not tallied pair by pair: its members are
   posted again under every six positional bytes that hold the list's four.  With
   six bytes fixed, a list has at most 65,536 fingerprints whatever the corpus,
   every pair in it has the minimum, and the partners of a member are found by
   probing the 136 ways to flip up to two of the 16 open bits.
5. The links of a list are reduced to its components before they leave the task:
   an edge a member at most, never a row a pair.  The connected components of the
   edges are those of all links.

Results for odd input: null, empty and white-space texts have no shingles and
fingerprint zero, and link like any other; fewer than three words are one shingle
of the whole sequence; rows that repeat a doc_id give a row each, by their own
texts; rows without doc_id link and carry the smallest doc_id of their component,
null if it has none; an empty table gives no rows; columns other than ``doc_id``
and ``text`` are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import utf8
from .store import Stage

WORDS, SEED, BITS = 3, 42, 2
BYTES = 8
#: Positional bytes that fingerprints of BITS differing bits share at least.
SHARED = BYTES - BITS
#: Positions of the lists: of SHARED kept out of BYTES, so many stand among the first SHARED positions.
LISTS = list(itertools.combinations(range(SHARED), SHARED - BITS))
#: Positions of the lists that long ones are split into.
SPLIT = list(itertools.combinations(range(BYTES), SHARED))
LONG = 256
_SPACE = b" \t\n\v\f\r"


def shingle_hashes(text: bytes, words: int = WORDS, piece: int = 1 << 20):
    """The hashes of a text's shingles, repeats included, in arrays; the text is cut at white space in pieces."""
    text, at, carry, seen = text.lower(), 0, [], False  # bytes: A to Z alone
    while at < len(text):
        end = min(at + piece, len(text))
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        carry += text[at:end].split()
        at = end
        if len(carry) >= words:
            shingles = map(b" ".join, zip(*[carry[k:] for k in range(words)]))
            yield np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(carry) - words + 1)
            carry, seen = carry[1 - words:], True
    if carry and not seen:
        yield np.asarray([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bits set in over half of the text's shingle hashes."""
    ones, total = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        total += len(h)
        for k in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[k:k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            fps = [fingerprint(data[a:b].tobytes(), words) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.asarray(fps, np.uint64).view(np.int64))], schema=schema)
    return run


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def list_keys(fp: Column) -> Column:
    """The lists of a fingerprint: number of the combination above its four bytes."""
    keys = []
    for k, positions in enumerate(LISTS):
        key = F.lit(k).cast("long")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, p))
        keys.append(key)
    return F.array(*keys)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Tally of the positional bytes that two fingerprints share, from their exclusive or."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row that links reach from each of n rows."""
    root = np.arange(n)
    while True:
        low, now = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(now, root[i], low)
        np.minimum.at(now, root[j], low)
        np.minimum.at(now, i, low)
        np.minimum.at(now, j, low)
        now = now[now]
        if np.array_equal(now, root):
            return root
        root = now


def _tallied(fp, end):
    """Linked rows (i, j) of sorted lists, each row's list ending at row `end`."""
    rows, left, right, step = np.arange(len(fp)), [], [], 0
    while True:
        step += 1
        rows = rows[rows + step < end[rows]]
        if not len(rows):
            break
        x = fp[rows] ^ fp[rows + step]
        some = np.flatnonzero(shared_bytes(x) >= SHARED)
        some = some[np.bitwise_count(x[some]) <= BITS]
        left.append(rows[some])
        right.append(rows[some] + step)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


_FLIPS = np.asarray([sum(1 << b for b in c) for n in range(1, BITS + 1) for c in itertools.combinations(range(16), n)], np.int64)


def _probed(fp, open_bytes):
    """Linked rows (i, j) of one list of distinct fingerprints that differ in two bytes only."""
    lo, hi = (np.uint64(8 * p) for p in open_bytes)
    value = (((fp >> lo) & np.uint64(255)) | (((fp >> hi) & np.uint64(255)) << np.uint64(8))).astype(np.int64)
    row = np.full(1 << 16, -1)
    row[value] = np.arange(len(fp))
    left, right = [], []
    for flip in _FLIPS:
        j = row[value ^ flip]
        i = np.flatnonzero(j > np.arange(len(fp)))
        left.append(i)
        right.append(j[i])
    return np.concatenate(left), np.concatenate(right)


_LINKED = "a long, b long, list long"
_LINKED_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("list", pa.int64())])


def _edges(fp, i, j):
    root = _roots(len(fp), i, j)
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return _batch(fp[moved], fp[root[moved]], None)


def _batch(a, b, key):
    a = pa.array(a.view(np.int64))
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([a, none if b is None else pa.array(b.view(np.int64)), none if key is None else pa.array(key)], schema=_LINKED_SCHEMA)


def _short_lists(batches):
    """Edges (a, b) of the lists of a sorted partition; members (a, list) of the long ones."""
    held_key, held_fp, long = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

    def work(key, fp):
        end = np.searchsorted(key, key, "right")
        size = end - np.searchsorted(key, key)
        far = size > LONG
        if far.any():
            yield _batch(fp[far], None, key[far])
        near = ~far & (size > 1)
        if near.any():
            key, fp = key[near], fp[near]
            yield _edges(fp, *_tallied(fp, np.searchsorted(key, key, "right")))
    for batch in batches:
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        if long is not None:  # the list of the last batch goes on
            n = int(np.searchsorted(key, long, "right"))
            if n:
                yield _batch(fp[:n], None, key[:n])
            key, fp = key[n:], fp[n:]
            if not len(key):
                continue
            long = None
        key, fp = np.concatenate([held_key, key]), np.concatenate([held_fp, fp])
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        yield from work(key[:cut], fp[:cut])
        held_key, held_fp = key[cut:], fp[cut:]
        if len(held_key) > LONG:
            yield _batch(held_fp, None, held_key)
            long, held_key, held_fp = int(held_key[-1]), held_key[:0], held_fp[:0]
    yield from work(held_key, held_fp)


def _split_lists(batches):
    """(key, fp) of the members (a, list) of long lists under every six positions that hold the list's four."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
    wider = [[k for k, s in enumerate(SPLIT) if set(few) <= set(s)] for few in LISTS]
    for batch in batches:
        fp, number = batch.column("a").to_numpy().view(np.uint64), batch.column("list").to_numpy() >> np.int64(8 * len(LISTS[0]))
        for few in np.unique(number).tolist():
            own = fp[number == few]
            for k in wider[few]:
                key = np.full(len(own), k, np.uint64)
                for p in SPLIT[k]:
                    key = (key << np.uint64(8)) | ((own >> np.uint64(8 * p)) & np.uint64(255))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own.view(np.int64))], schema=schema)


def _long_lists(batches):
    """Edges of the split lists of a sorted partition, one list of at most 65,536 fingerprints in memory."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def work(key, fp):
        first = np.flatnonzero(np.diff(key, prepend=-1))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
            if b - a > 1:
                own = np.unique(fp[a:b])
                positions = SPLIT[int(key[a]) >> (8 * SHARED)]
                yield _edges(own, *_probed(own, [p for p in range(BYTES) if p not in positions]))
    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy()])
        fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        yield from work(key[:cut], fp[:cut])
        key, fp = key[cut:], fp[cut:]
    yield from work(key, fp)


def edges(fingerprints: DataFrame, stage: Stage) -> DataFrame:
    """(src, dst) edges with the components of all links between distinct `fp`."""
    posted = fingerprints.select("fp", F.explode(list_keys(F.col("fp"))).alias("key")).select("key", "fp")
    short = stage.keep(posted.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_short_lists, _LINKED), "short")
    split = short.where("list is not null").select("a", "list").mapInArrow(_split_lists, "key long, fp long").distinct()
    long = split.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_long_lists, _LINKED)
    return short.where("list is null").union(long).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach) of every document."""
    stage = Stage(docs.sparkSession, "simhash")
    fps = stage.keep(docs.select("doc_id", "text").mapInArrow(_fingerprints(words), "doc_id long, fp long"), "fingerprints")
    classes = stage.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    component = connected_components(edges(classes.select("fp"), stage), stage)
    # fingerprints without a link are their own component; the others take the least doc_id of theirs
    linked = classes.join(component, classes["fp"] == component["id"]).select("fp", "least", "component")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage.keep(linked.join(least, "component").select("fp", "component_id"), "named")
    alone = classes.join(named, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return fps.join(named.union(alone), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
