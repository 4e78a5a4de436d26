"""Operator 2: exact n-gram Jaccard join in the metric space of shingle sets.

The distance of two documents is 1 - Jaccard similarity of their sets of word
5-grams, a metric; documents link at a distance of `radius` = 0.2 or less.

1. Equal sets are one class with its smallest doc_id as representative.
2. A table of frequency classes of shingle codes (fixed size) orders shingles
   from rare to common.  Two linked sets share a shingle among the first
   n - ceil(0.8 n) + 1 of this order, so only documents that share such a
   prefix shingle can link; all others are alone in the space.
3. Pivots create Voronoi regions: of the documents that share a prefix shingle,
   the most central one (fewest rare shingles) is the pivot, and each of them
   measures its exact distance to it.  Within the radius a document is in the
   pivot's core.
4. Triangle-inequality windows replicate boundary documents: a document farther
   than twice the radius from a pivot has no link into its core; one in the
   shell, between one and two radii, can only link to core members whose
   distance to the pivot differs by at most the radius.  Those pairs and the
   pairs within a core are checked; in larger regions tile by tile, where a
   document goes along once a tile and not once a pair.
5. The documents outside the core are the next region of their shingle: they
   join recursively with a new pivot until no region has two of them.

Every linked pair of different sets is found: both meet in the region of a shared
prefix shingle, where either one is the pivot, or a check compares them, or both
go on to the next region together.  Components alone need fewer links: with
`every` false, pairs that one component already holds are left out, all of a core
among them.

Results for odd input: null and empty texts have no shingles and link with
nothing (component is their own doc_id); texts of fewer words are one shingle of
the whole sequence; doc_id is a key, so of rows that repeat one with unequal
sets a single set takes part in links between documents, while equal sets always
share a class; rows without doc_id join the class of an equal set with a doc_id
and have a null component otherwise; an empty table gives no rows;
columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import LOWER, SMALL_BYTES, SPACES, U64, chunks, mix, span_hashes, word_spans, words_per_doc
from .simhash import _roots
from .store import Stage, partitions
from .word_blocks import pack, unpack

WORDS = 5
PERCENT = 80
#: A code is the upper 32 bits of a shingle's hash; a cell of the class table holds 2**7 neighbouring codes.
BUCKET_BITS, CELL_BITS = 8, 25
#: Documents, and shingles, of one side of a tile; regions of up to a sixteenth of it are compared by joins.
TILE, TILE_SHINGLES = 512, 500_000
_WEIGHTS = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) | U64(1)


def _pieces(data, size: int):
    """Cuts of a text at white space into pieces of about `size` bytes (or one longer word)."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + size, n)
        while end < n and not SPACES[data[end]]:
            gap = np.flatnonzero(SPACES[data[end:end + size]])
            end = end + int(gap[0]) if len(gap) else min(end + size, n)
        yield at, end
        at = end


def word_hashes(offsets, data, size: int = SMALL_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words per document); a word's hash does not depend on its place, so a long text is read in pieces."""
    cuts = list(_pieces(data, size)) if len(offsets) == 2 and len(data) > size else [(0, len(data))]
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for a, b in cuts:
        part, inside = LOWER[data[a:b]], np.asarray([0, b - a]) if len(cuts) > 1 else offsets
        starts, ends = word_spans(part, inside, ~SPACES)
        hashes.append(span_hashes(part, starts, ends))
        counts += words_per_doc(starts, inside)
    return np.concatenate([np.zeros(0, U64), *hashes]), counts


def shingle_sets(offsets, data, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    h, counts = word_hashes(offsets, data)
    weight = _WEIGHTS[:words]
    total = np.zeros(max(len(h) - words + 1, 0), U64)
    for k in range(words):
        total += h[k:len(h) - words + 1 + k] * weight[k] if len(total) else total
    total = mix(total)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(total[at:at + n - words + 1]))
        elif n:
            out.append(mix((h[at:at + n] * weight[:n]).sum(keepdims=True) + U64(n)))
        else:
            out.append(np.zeros(0, U64))
        at += n
    return out


def _signed(x) -> int:
    return int(np.asarray(x, U64).view(np.int64))


def _code_rows(parts: list[np.ndarray]) -> pa.RecordBatch:
    codes, n = np.unique(np.concatenate(parts), return_counts=True)
    bucket = codes >> np.uint32(32 - BUCKET_BITS)
    cut = np.concatenate((np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1)), [len(codes)])).tolist()
    rows = [(None, None, None, None, int(bucket[a]), pack(np.diff(codes[a:b], prepend=np.uint32(0)), "<u4", 1), pack(n[a:b], "<u4", 1)) for a, b in zip(cut, cut[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PROFILE.types)], schema=_PROFILE)


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()),
                      ("bucket", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])


def _profile(words: int, flush: int = 500_000):
    """Set size and fingerprint of each document, and the code counts of the task in rows of a bucket."""
    def run(batches):
        held, size = [], 0
        for rows, offsets, data in chunks(batches, limit=SMALL_BYTES):
            sets = shingle_sets(offsets, data, words)
            with np.errstate(over="ignore"):
                fp1, fp2 = [_signed(s.sum(dtype=U64)) for s in sets], [_signed(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)) for s in sets]
            n = [len(s) for s in sets]
            none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), *none], schema=_PROFILE)
            held.append((np.concatenate(sets) >> U64(32)).astype(np.uint32))
            size += len(held[-1])
            if size >= flush:
                yield _code_rows(held)
                held, size = [], 0
        if size:
            yield _code_rows(held)
    return run


def _classes(batches):
    """The frequency classes (log2 of the count, rounded up) of each bucket's cells, compressed."""
    width = 1 << (32 - BUCKET_BITS)
    schema = pa.schema([("bucket", pa.int32()), ("classes", pa.binary())])

    def finish(bucket, count):
        top = count.reshape(1 << (CELL_BITS - BUCKET_BITS), -1).max(axis=1)
        cls = np.ceil(np.log2(np.maximum(top, 1))).astype(np.uint8)
        return pa.RecordBatch.from_pylist([dict(bucket=bucket, classes=zstandard.ZstdCompressor(level=3).compress(cls.tobytes()))], schema=schema)
    now, count = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                if now is not None:
                    yield finish(now, count)
                now, count = row["bucket"], np.zeros(width, np.int64)
            codes = np.cumsum(unpack(row["codes"], "<u4"), dtype=np.uint64) & U64(width - 1)
            count[codes.astype(np.int64)] += unpack(row["counts"], "<u4")
    if now is not None:
        yield finish(now, count)


_TABLE: dict = {}


def _class_table(blobs) -> np.ndarray:
    """The class table from its broadcast parts, once a worker; cells without codes are class 0."""
    if _TABLE.get("id") is not blobs:
        table, zstd = np.zeros(1 << CELL_BITS, np.uint8), zstandard.ZstdDecompressor()
        for bucket, blob in blobs.items():
            part = np.frombuffer(zstd.decompress(blob), np.uint8)
            table[bucket * len(part):(bucket + 1) * len(part)] = part
        _TABLE.update(id=blobs, table=table)
    return _TABLE["table"]


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """Linked sets share one of so many first shingles of any order that holds for all sets."""
    return n - -(-percent * n // 100) + 1 if n else 0


_PREFIX = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("com", pa.int64()), ("prefix", pa.list_(pa.int64()))])


def _prefixes(words: int, percent: int, blobs):
    """The prefix shingles that other documents may share, and how many of the whole set they may (com);
    documents without such a shingle give no row."""
    def run(batches):
        table = _class_table(blobs.value)
        for rows, offsets, data in chunks(batches, limit=SMALL_BYTES):
            out = []
            for doc_id, s in zip(rows.column("doc_id").to_pylist(), shingle_sets(offsets, data, words)):
                if doc_id is None or not len(s):
                    continue
                cls = table[(s >> U64(64 - CELL_BITS)).astype(np.int64)]
                order = np.argsort(cls, kind="stable")[:prefix_size(len(s), percent)]  # by class, then hash
                order = order[cls[order] > 0]
                if len(order):
                    out.append((doc_id, len(s), int((cls > 0).sum()), s[order].view(np.int64).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PREFIX.types)], schema=_PREFIX)
    return run


def _sets(words: int):
    schema = pa.schema([("id", pa.int64()), ("sh", pa.list_(pa.int64()))])

    def run(batches):
        for rows, offsets, data in chunks(batches, limit=SMALL_BYTES):
            sets = shingle_sets(offsets, data, words)
            at = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            flat = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), flat)], schema=schema)
    return run


def _may_reach(n, com, other_n, other_com, percent: int):
    """False only if two sets of these sizes and shareable counts are less similar than `percent`."""
    most = F.least(com, other_com, n, other_n)
    return 100 * most >= percent * (n + other_n - most)


def _similar(percent: int):
    return 100 * F.col("inter") >= percent * (F.col("an") + F.col("bn") - F.col("inter"))


def _measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, an, bn, inter) of (a, b): sizes of both sets and of their intersection."""
    a, b = sets.select(F.col("id").alias("a"), F.col("sh").alias("as")), sets.select(F.col("id").alias("b"), F.col("sh").alias("bs"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.size("as").alias("an"), F.size("bs").alias("bn"), F.size(F.array_intersect("as", "bs")).alias("inter"))


def _window(region: DataFrame, other: DataFrame, percent: int, condition) -> DataFrame:
    """Pairs of two parts of the same pivot's region, of unlike components (if known), that may link.

    Two bounds of the intersection leave them: by the sizes, and, where both distances to the pivot are known, by
    what each shares with the pivot and outside it; the triangle inequality is the second bound without sizes."""
    a = region.select("p", *[F.col(c).alias(f"a{c}") for c in ("x", "n", "com", "d", "inter", "component")])
    b = other.select("p", *[F.col(c).alias(f"b{c}") for c in ("x", "n", "com", "d", "inter", "component")])
    radius = (100 - percent) / 100 + 1e-9
    near = F.coalesce(F.abs(F.col("ad") - F.col("bd")) <= radius, F.lit(True))
    shared = F.least("ainter", "binter") + F.least(F.col("acom") - F.col("ainter"), F.col("bcom") - F.col("binter"))
    enough = F.coalesce(100 * shared >= percent * (F.col("an") + F.col("bn") - shared), F.lit(True))
    on = ((a["p"] == b["p"]) & condition(F.col("ax"), F.col("bx")) & F.coalesce(F.col("acomponent") != F.col("bcomponent"), F.lit(True)) & near & enough
          & _may_reach(F.col("an"), F.col("acom"), F.col("bn"), F.col("bcom"), percent))
    return a.join(b, on).select(F.col("ax").alias("a"), F.col("bx").alias("b"))


_PAIRS = "a long, b long, an int, bn int, inter int"
_LISTS = "x long, partners array<long>, root long"


def _overlaps(doc: np.ndarray, shingles: np.ndarray, n: int, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of `n` sets, by products of the shingles that two of them have."""
    _, column, count = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    doc, column = doc[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    out = np.zeros((n, n), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (first, first + width))
        has = np.zeros((n, width), np.float32)
        has[doc[a:b], column[a:b] - first] = 1
        out += has @ has.T
    return out.astype(np.int64)


def _tile(percent: int, last: bool, lists: bool):
    """The linked pairs of a tile's documents; of those of two sides, the pairs across.

    lists: give them as adjacency lists, a row a document with its partners and its root in the tile's components."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("an", pa.int32()), ("bn", pa.int32()), ("inter", pa.int32())])
    list_schema = pa.schema([("x", pa.int64()), ("partners", pa.list_(pa.int64())), ("root", pa.int64())])
    radius = (100 - percent) / 100 + 1e-9

    def run(key, members):
        x, n, com, side = (members.column(c).to_numpy() for c in ("x", "n", "com", "i"))
        core = members.column("core").to_numpy(zero_copy_only=False).astype(bool)
        inter, d = (members.column(c).cast(pa.float64()).to_numpy() for c in ("inter", "d"))  # nan: far from the pivot
        far = np.isnan(d)
        pair = x[:, None] < x
        if key[1].as_py() != key[2].as_py():
            pair &= side[:, None] != side
        pair &= ~(core[:, None] & far | far[:, None] & core)
        if not last:
            pair &= core[:, None] | core  # the others meet again in the next region
        total, known = n[:, None] + n, ~(far[:, None] | far)
        pair &= ~known | (np.abs(d[:, None] - d) <= radius)
        most = np.minimum(np.minimum(com, n)[:, None], np.minimum(com, n))
        pair &= 100 * most >= percent * (total - most)
        most = np.minimum(inter[:, None], inter) + np.minimum((com - inter)[:, None], com - inter)
        pair &= ~known | (100 * most >= percent * (total - most))
        rows = np.flatnonzero(pair.any(axis=0) | pair.any(axis=1))
        if not len(rows):
            return (list_schema if lists else schema).empty_table()
        sets = members.column("sh").combine_chunks().take(pa.array(rows))
        both = _overlaps(np.repeat(np.arange(len(rows)), n[rows]), sets.flatten().to_numpy(), len(rows))
        linked = pair[np.ix_(rows, rows)] & (100 * both >= percent * (total[np.ix_(rows, rows)] - both))
        a, b = np.nonzero(linked)
        if lists:
            own, partner = np.concatenate((a, b)), np.concatenate((b, a))
            order = np.argsort(own, kind="stable")
            own, partner = own[order], partner[order]
            cut = np.flatnonzero(np.diff(own, prepend=-1))
            ends = np.append(cut, len(own)).astype(np.int32)
            ids = x[rows]
            by_id = np.argsort(ids)
            place = np.empty(len(ids), np.int64)
            place[by_id] = np.arange(len(ids))
            root = ids[by_id][_roots(len(ids), place[a], place[b])][place]  # the smallest id that the tile's links reach
            return pa.table([pa.array(ids[own[cut]]), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[partner])), pa.array(root[own[cut]])], schema=list_schema)
        return pa.table([pa.array(c, t) for c, t in zip((x[rows[a]], x[rows[b]], n[rows[a]], n[rows[b]], both[a, b]), schema.types)], schema=schema)
    return run


def _tiles(region: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int, last: bool, tile: int, lists: bool) -> DataFrame:
    """The links inside the regions of `sizes` (p, k sides), as pairs or as adjacency lists."""
    dealt = region.join(sizes, "p").withColumn("i", F.pmod(F.xxhash64("x"), F.col("k")).cast("int"))
    if not last:
        dealt = dealt.where("d is not null")
    dealt = dealt.join(sets.select(F.col("id").alias("x"), "sh"), "x").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    spread = dealt.select("p", F.least("i", "o").alias("t"), F.greatest("i", "o").alias("u"), "x", "n", "com", "inter", "d", F.coalesce("core", F.lit(False)).alias("core"), "i", "sh")
    return spread.groupBy("p", "t", "u").applyInArrow(_tile(percent, last, lists), _LISTS if lists else _PAIRS)


def class_table(codes: DataFrame) -> dict:
    """The frequency classes of all shingle codes: 2**CELL_BITS cells whatever the input, compressed."""
    parts = (codes.where("bucket is not null").select("bucket", "codes", "counts").repartition(min(1 << BUCKET_BITS, partitions(codes.sparkSession)), "bucket")
             .sortWithinPartitions("bucket").mapInArrow(_classes, "bucket int, classes binary"))
    return {r.bucket: bytes(r.classes) for r in parts.collect()}


def links(prefixes: DataFrame, docs: DataFrame, stage: Stage, words: int, percent: int, rounds: int, every: bool = True, tile: int = TILE,
          lists: list | None = None) -> DataFrame:
    """(a, b, an, bn, inter) of the linked representatives a < b: all of them, once, or if not `every`, enough of
    them (with repeats) that linked documents are connected.

    lists: gets the links of large regions as adjacency lists (x, partners, root) instead.

    prefixes: (doc_id, n, com, prefix)."""
    shell = 2 * percent - 100  # similarity at twice the radius
    spread = prefixes.where(100 * F.col("com") >= percent * F.col("n"))  # others share too little with all documents together
    spread = spread.select(F.col("doc_id").alias("x"), "n", "com", F.explode("prefix").alias("s"))
    shared = spread.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("s")
    members = stage.keep(spread.join(shared, "s"), "members")
    active = members.select(F.col("x").alias("doc_id")).distinct()
    sets = stage.keep(docs.join(active, "doc_id", "left_semi").mapInArrow(_sets(words), "id long, sh array<long>").dropDuplicates(["id"]), "sets")
    found = []

    def add(pairs):
        turned = F.col("a") > F.col("b")
        found.append(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("bn")).otherwise(F.col("an")).alias("an"),
                                  F.when(turned, F.col("an")).otherwise(F.col("bn")).alias("bn"), "inter"))
    for k in range(rounds):
        # the pivot of a shingle: the document with the fewest shingles of its own
        pivots = members.groupBy("s").agg(F.min(F.struct((F.col("n") - F.col("com")).alias("own"), "x", "n", "com")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1")
        near = stage.keep(members.join(pivots.select("s", "p"), "s").where("x <> p.x").select("s", "x", "n", "com", "p"), f"regions-{k}")
        region = near.select("x", "n", "com", "p").distinct()
        pairs = region.where(_may_reach(F.col("n"), F.col("com"), F.col("p.n"), F.col("p.com"), shell)).select(F.col("x").alias("a"), F.col("p.x").alias("b"))
        measured = stage.keep(_measure(pairs, sets).where(_similar(shell)), f"distances-{k}")
        add(measured.where(_similar(percent)))
        placed = measured.select(F.col("a").alias("x"), F.col("b").alias("p"), _similar(percent).alias("core"), F.col("inter").cast("long").alias("inter"),
                                 (1 - F.col("inter") / (F.col("an") + F.col("bn") - F.col("inter"))).alias("d"))
        region = region.select("x", "n", "com", F.col("p.x").alias("p")).join(placed, ["x", "p"], "left")
        if every:
            region = region.withColumn("component", F.lit(None).cast("long"))
        else:
            component = connected_components(_edges(found), stage, f"region-components-{k}").select(F.col("id").alias("x"), "component")
            region = region.join(component, "x", "left").withColumn("component", F.coalesce("component", "x"))
        region = stage.keep(region, f"placed-{k}")
        inside, last = region.where("core"), k == rounds - 1
        few = region
        if every:
            sizes = region.groupBy("p").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
            sizes = stage.keep(sizes.where(F.col("c") > tile // 16).select("p", F.ceil(F.greatest(F.col("c") / tile, F.col("w") / TILE_SHINGLES)).cast("int").alias("k")), f"tiled-{k}")
            tiled = stage.keep(_tiles(region, sizes, sets, percent, last, tile, lists is not None), f"tiles-{k}")
            if lists is None:
                add(tiled)
            else:
                lists.append(tiled)
            few = region.join(sizes, "p", "left_anti")
        core, outside = few.where("core"), few.where("not coalesce(core, false)")
        checks = _window(outside.where("d is not null"), core, percent, lambda x, y: x != y)
        if every:
            checks = checks.union(_window(core, core, percent, lambda x, y: x < y))
        if last:  # the last regions are compared pair by pair within the windows
            checks = checks.union(_window(outside, outside, percent, lambda x, y: x < y))
        checks = checks.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        add(stage.keep(_measure(checks, sets).where(_similar(percent)), f"checked-{k}"))
        flat = near.select("s", "x", "n", "com", F.col("p.x").alias("p"))
        members = stage.keep(flat.join(inside.select("x", "p"), ["x", "p"], "left_anti").select("x", "n", "com", "s"), f"members-{k}")
        if members.isEmpty():
            break
    return stage.keep(_union(found).dropDuplicates(["a", "b"]), "links") if every else _union(found)


def _edges(found: list[DataFrame]) -> DataFrame:
    return _union(found).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, parts)


def _prepared(docs: DataFrame, stage: Stage, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(set size and fingerprint of each document, classes of equal sets, prefixes of their representatives)."""
    spark = docs.sparkSession
    profile = stage.keep(docs.mapInArrow(_profile(words), "doc_id long, n long, fp1 long, fp2 long, bucket int, codes binary, counts binary"), "profile")
    sets = profile.where("bucket is null").select("doc_id", "n", "fp1", "fp2")
    classes = stage.keep(sets.where("n > 0").groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("class_id")), "classes")
    blobs = spark.sparkContext.broadcast(class_table(profile))
    prefixes = docs.mapInArrow(_prefixes(words, percent, blobs), "doc_id long, n long, com long, prefix array<long>")
    return sets, classes, stage.keep(prefixes.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "prefixes")


def jaccard_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rounds: int = 2, tile: int = TILE) -> DataFrame:
    """(a, b, an, bn, inter) of every linked pair of class representatives a < b: their doc_ids, set sizes and
    shared shingles."""
    docs = docs.select("doc_id", "text")
    stage = Stage(docs.sparkSession, "jaccard")
    return links(_prepared(docs, stage, words, percent)[2], docs, stage, words, percent, rounds, tile=tile)


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rounds: int = 2, every: bool = True) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id of an equal set) and component_id of every document, and n_links,
    the number of classes that its class links to.

    percent: the least similarity of linked sets, above 50.  rounds: how often regions are joined recursively
    before the last ones are compared pair by pair.  every: find every link; if false, only those that the
    components need, without n_links."""
    docs = docs.select("doc_id", "text")
    stage = Stage(docs.sparkSession, "jaccard")
    sets, classes, prefixes = _prepared(docs, stage, words, percent)
    lists: list[DataFrame] = []
    found = links(prefixes, docs, stage, words, percent, rounds, every, lists=lists if every else None)
    edges = functools.reduce(DataFrame.union, [x.select(F.col("x").alias("src"), F.col("root").alias("dst")) for x in lists], _edges([found]))
    component = stage.keep(connected_components(edges, stage), "component")
    if every:
        partners = [x.select(F.col("x").alias("id"), "partners") for x in lists]
        partners = _union([found.select(F.col("a").alias("id"), F.array("b").alias("partners")), found.select(F.col("b").alias("id"), F.array("a").alias("partners")), *partners])
        # a pair can be found in several regions: partners count once
        degree = partners.groupBy("id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("partners")))).cast("long").alias("n_links"))
        component = component.join(degree, "id")
    counted = ["n_links"] if every else []
    zero = F.when(F.col("class_id").isNotNull(), F.lit(0).cast("long"))
    named = stage.keep(classes.join(component, classes["class_id"] == component["id"], "left")
                       .select("n", "fp1", "fp2", "class_id", F.coalesce("component", "class_id").alias("component_id"), *[F.coalesce(c, zero).alias(c) for c in counted]), "named")
    full, none = sets.where("n > 0"), sets.where("n = 0")
    out = full.join(named, ["n", "fp1", "fp2"]).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id", *counted)
    return out.union(none.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), *[F.lit(0).cast("long").alias(c) for c in counted]))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents with the smallest doc_id of their component, in all their columns; of rows that repeat such a
    doc_id one stays, rows without doc_id stay."""
    found = jaccard_components(docs, every=False, **options)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*[F.col(c) for c in docs.columns])
    rank = "_rank" + "_" * max(map(len, docs.columns), default=0)  # a name that no column has
    numbered = kept.where("doc_id is not null").withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id")))
    return numbered.where(F.col(rank) == 1).drop(rank).union(docs.where("doc_id is null"))
