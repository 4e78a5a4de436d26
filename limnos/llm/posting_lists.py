"""Operator 6: approximate nearest neighbours with balanced posting lists.

Equal vectors are one index entry with their smallest ids (as many as a result
can need).  Centroids come from balanced bisection of a bounded sample, so dense
regions get more of them and lists stay even.  Every vector is put into all lists
whose centroid is nearly as near as the nearest (boundary replication).  A query
finds centroids by walking an in-memory neighbour graph and keeps the lists
within a ratio of the nearest distance.  Neighbouring lists are stored together
in blocks of bounded size, which a query reads whole; a block's scores are one
matrix product in double precision, of which a query's best leave the block if
they reach what it finds among the sample's vectors in the blocks that it reads.
A query whose lists hold fewer entries than a result needs reads the next nearest
lists too, so every query has `top` rows or all candidates.

Nearness is the largest inner product.  Vectors get one more component that
makes all of them equally long, so that the nearest in distance has the largest
inner product; scores are taken on the original vectors.

Results for odd input: rows with null vec_id, null or zero vectors, null or
non-finite components, or another length than most rows take no part; rows that
repeat a vec_id count once with their best score; with fewer candidates than k
all are returned; an empty table gives no rows; columns other than ``vec_id``
and ``embedding`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Stage

TOP = 20
#: Vectors that the centroids are fitted on, wanted vectors a list, most centroids.
SAMPLE, LIST_SIZE, MOST_LISTS = 16_384, 256, 4_096
#: Most lists of a vector, and how much farther than the nearest their centroids may be.
REPLICAS, REPLICA_RATIO = 8, 1.15
#: Lists that a query reads: those within this ratio of the nearest distance, `LEAST_LISTS` at least.
SEARCH_RATIO, LEAST_LISTS = 1.13, 8
#: Entries, or queries, of a block.
BLOCK = 16_384
#: Nearest neighbours of a centroid in the graph; a walk enters it once in so many centroids of the tree's order.
_DEGREE, _ENTRY_STEP = 24, 16


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (x @ c.T), 0))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 6) -> np.ndarray:
    """Centroids of `lists` parts of about equal size, by halving along the main direction; neighbours in the
    tree are neighbours in the order."""
    r = np.random.default_rng(seed)
    leaves, open_ = [], [(np.arange(len(x)), lists)]
    while open_:
        part, n = open_.pop()
        if n == 1 or len(part) < 2:
            leaves.append(part)
            continue
        y = x[part] - x[part].mean(axis=0)
        direction = r.normal(size=x.shape[1])
        for _ in range(6):
            direction = y.T @ (y @ direction)
            direction /= max(np.linalg.norm(direction), 1e-300)
        order = np.argsort(y @ direction, kind="stable")
        cut = min(max(1, len(part) * (n // 2) // n), len(part) - 1)
        open_ += [(part[order[cut:]], n - n // 2), (part[order[:cut]], n // 2)]
    c = np.stack([x[p].mean(axis=0) for p in leaves])
    for _ in range(2):  # two rounds of refinement; empty parts keep their centroid
        near = np.concatenate([distances(x[a:a + 4096], c).argmin(axis=1) for a in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Index:
    """Centroids, their neighbour graph, and the length that all vectors are filled up to."""

    def __init__(self, sample: np.ndarray, lists: int, norm: float):
        self.norm, self.sample = norm, sample
        self.centroids = balanced_centroids(self.longer(sample), lists)
        n = len(self.centroids)
        near = np.concatenate([np.argsort(distances(self.centroids[a:a + 512], self.centroids), axis=1)[:, 1:_DEGREE + 1] for a in range(0, n, 512)])
        linked = [set(row) for row in near.tolist()]
        for k, row in enumerate(near.tolist()):  # both ways
            for j in row:
                linked[j].add(k)
        for k in range(n):  # neighbours in the tree's order, and farther ones: the graph is connected
            step = 1
            while k + step < n:
                linked[k].add(k + step)
                linked[k + step].add(k)
                step *= 4
        self.size = np.asarray([len(s) for s in linked])
        self.at = np.cumsum(self.size) - self.size
        self.next = np.asarray([j for s in linked for j in sorted(s)], np.int64)
        self.entries = np.unique(np.append(np.arange(0, n, _ENTRY_STEP), n - 1))  # one in every larger part of the tree

    def longer(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))[:, None]])

    def replicas(self, x: np.ndarray):
        """(row, list, rank) of all lists of each vector, the nearest with rank 0; the same lists in whatever batch
        the vector comes, as the last distances are taken row by row."""
        x = self.longer(x)
        order = np.sort(np.argsort(distances(x, self.centroids), axis=1)[:, :REPLICAS + 4], axis=1)
        d = np.linalg.norm(x[:, None] - self.centroids[order], axis=2)
        by = np.argsort(d, axis=1, kind="stable")[:, :REPLICAS]
        near, order = np.take_along_axis(d, by, axis=1), np.take_along_axis(order, by, axis=1)
        row, k = np.nonzero(near <= REPLICA_RATIO * near[:, :1] + 1e-12)
        return row, order[row, k], k

    def search(self, q: np.ndarray):
        """(row, list) of the lists that each query reads: a walk over the graph from fixed entries, on to the
        neighbours of every centroid within the ratio of the nearest found so far."""
        q = np.hstack([q, np.zeros((len(q), 1))])
        n, least = len(self.centroids), min(LEAST_LISTS, len(self.centroids))
        d, walked = np.full((len(q), n), np.inf), np.zeros((len(q), n), bool)
        d[:, self.entries] = distances(q, self.centroids[self.entries])
        while True:
            bound = np.maximum(d.min(axis=1) * SEARCH_RATIO, np.partition(d, least - 1, axis=1)[:, least - 1])
            row, node = np.nonzero((d <= bound[:, None]) & np.isfinite(d) & ~walked)
            if not len(row):
                break
            walked[row, node] = True
            size = self.size[node]
            to = self.next[np.repeat(self.at[node] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            pair = np.unique(np.repeat(row, size) * n + to)
            row, to = pair // n, pair % n
            new = ~np.isfinite(d[row, to])
            row, to = row[new], to[new]
            for a in range(0, len(row), 65_536):
                i, j = row[a:a + 65_536], to[a:a + 65_536]
                d[i, j] = np.linalg.norm(q[i] - self.centroids[j], axis=1)
        bound = np.maximum(d.min(axis=1) * SEARCH_RATIO, np.partition(d, least - 1, axis=1)[:, least - 1])
        return np.nonzero((d <= bound[:, None]) & np.isfinite(d))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


class Blocks:
    """Lists put together with their neighbours into blocks of bounded size; a longer list is a block in several parts."""

    def __init__(self, sizes: dict, index: Index, most: int):
        """sizes: (entries, entries whose nearest list it is) of each list."""
        lists = len(index.centroids)
        n, nearest = np.asarray([sizes.get(k, (0, 0)) for k in range(lists)], np.int64).T
        self.parts = np.maximum(1, -(-n // most))
        self.block, now, held = np.zeros(lists, np.int64), 0, 0
        for k in range(lists):
            if held and held + n[k] > most:
                now, held = now + 1, 0
            self.block[k], held = now, held + n[k]
        self.block_parts = np.ones(now + 1, np.int64)
        np.maximum.at(self.block_parts, self.block, self.parts)
        self.entries = np.zeros(now + 1, np.int64)  # each entry once
        np.add.at(self.entries, self.block, nearest)
        self.places = np.full((len(index.sample), REPLICAS), -1, np.int32)  # blocks of the sample's vectors
        for a in range(0, len(index.sample), 512):
            row, lists, rank = index.replicas(index.sample[a:a + 512])
            self.places[a + row, rank] = self.block[lists]

    def read(self, index: Index, q: np.ndarray, top: int) -> np.ndarray:
        """Which blocks each query reads: those of the lists that it finds, and of the next nearest lists until they
        hold `top` entries."""
        row, lists = index.search(q)
        read = np.zeros((len(q), len(self.entries)), bool)
        read[row, self.block[lists]] = True
        least = min(top, int(self.entries.sum()))
        for k in np.flatnonzero(read @ self.entries < least):
            for near in np.argsort(distances(np.append(q[k], 0)[None], index.centroids)[0], kind="stable"):
                read[k, self.block[near]] = True
                if read[k] @ self.entries >= least:
                    break
        return read

    def at_least(self, index: Index, q: np.ndarray, read: np.ndarray, top: int) -> np.ndarray:
        """A score that the `top` best entries of the blocks that each query reads reach, as that many of the
        sample's vectors in them do; less what sums of products in another order may differ by."""
        if len(index.sample) < top:
            return np.full(len(q), -np.inf)
        seen = np.zeros((len(q), len(index.sample)), bool)
        for block in self.places.T:
            held = np.flatnonzero(block >= 0)
            seen[:, held] |= read[:, block[held]]
        s = np.where(seen, q @ index.sample.T, -np.inf)
        rounding = 4 * q.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * index.norm
        return -np.partition(-s, top - 1, axis=1)[:, top - 1] - rounding


def _put(shared, blocks, dim: int, step: int = 512):
    """A row of (block, part, ids, vector) for every block of each entry."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                row, lists, _ = shared.value.replicas(_matrix(part.column("vector"), dim))
                pair = np.unique(row * len(blocks.block_parts) + blocks.block[lists])
                row, block = pair // len(blocks.block_parts), pair % len(blocks.block_parts)
                piece = np.asarray(part.column("key").to_numpy())[row] % blocks.block_parts[block]
                out = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(piece.astype(np.int32)), out.column("ids"), out.column("vector")],
                                                 names=["block", "i", "ids", "vector"])
    return run


def _lists(shared, dim: int, step: int = 512):
    """The lists of each entry, and which is the nearest, to count them."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                _, lists, rank = shared.value.replicas(_matrix(batch.slice(a, step).column("vector"), dim))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array((rank == 0).astype(np.int32))], names=["list", "nearest"])
    return run


def _look(shared, blocks, dim: int, top: int, step: int = 512):
    """A row of (block, part, key, least, vector) for every part of the blocks that each query reads."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                x = _matrix(part.column("vector"), dim)
                read = blocks.read(shared.value, x, top)
                row, block = np.nonzero(read)
                n = blocks.block_parts[block]
                piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                row, block = np.repeat(row, n), np.repeat(block, n)
                out = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(piece.astype(np.int32)), out.column("key"),
                                                  pa.array(blocks.at_least(shared.value, x, read, top)[row]), out.column("vector")], names=["block", "i", "key", "least", "vector"])
    return run


def best_of_block(query_keys, q: np.ndarray, floor: np.ndarray, first: np.ndarray, v: np.ndarray, top: int, step: int = 256):
    """(query key, entry, score) of the `top` entries of each query that reach its floor: largest scores first, ties to the smaller id."""
    out = []
    for a in range(0, len(q), step):
        s = q[a:a + step] @ v.T
        least = floor[a:a + step]
        if s.shape[1] > top:
            least = np.maximum(least, -np.partition(-s, top - 1, axis=1)[:, top - 1])
        row, col = np.nonzero(s >= least[:, None])
        order = np.lexsort((first[col], -s[row, col], row))
        row, col = row[order], col[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[rank < top], col[rank < top]
        out += list(zip(np.asarray(query_keys)[a + row].tolist(), col.tolist(), s[row, col].tolist()))
    return out


def _block(dim: int, top: int):
    schema = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(key, queries, entries):
        if not queries.num_rows or not entries.num_rows:
            return schema.empty_table()
        ids = entries.column("ids").to_pylist()
        found = best_of_block(queries.column("key").to_pylist(), _matrix(queries.column("vector"), dim), queries.column("least").to_numpy(),
                              np.asarray([i[0] for i in ids]), _matrix(entries.column("vector"), dim), top)
        rows = [(query, i, score) for query, k, score in found for i in ids[k]]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema) if rows else schema.empty_table()
    return run


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the rows that take part, and their common length (the most frequent one)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    dim = sizes[0][0] if sizes else 0
    return rows.where(F.size("embedding") == dim).select("vec_id", F.col("embedding").alias("vector")), dim


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """(key, vector, ids): equal vectors as one, with their `keep` smallest ids; key is the smallest."""
    rows = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64("vector", F.lit(1)))
    first = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep)  # cut to `keep` before the shuffle too
    return (few.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
            .select(F.get("ids", 0).alias("key"), "vector", "ids", "h1", "h2"))


def _norm(v) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def nearest(vectors: DataFrame, is_query: Column | None = None, top: int = TOP, list_size: int = LIST_SIZE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest found of every query, its own row left out.

    is_query: which rows are queries; default every vec_id divisible by 20."""
    spark = vectors.sparkSession
    stage = Stage(spark, "postings")
    rows, dim = usable(vectors)
    is_query = (F.col("vec_id") % 20 == 0) if is_query is None else is_query
    entries = stage.keep(_classes(rows, top + 1), "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = entries.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vector").toArrow()
    norm = entries.agg(F.max(_norm(F.col("vector")))).first()[0]
    x = _matrix(sample.column("vector"), dim)
    shared = spark.sparkContext.broadcast(Index(x, max(1, min(MOST_LISTS, len(x) // 4, n // list_size)), norm))

    asked = rows.where(is_query).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64("vector", F.lit(1)))
    queries = stage.keep(asked.groupBy("h1", "h2").agg(F.min("vec_id").alias("key"), F.first("vector").alias("vector")), "queries")
    # neighbouring lists form blocks of bounded size; the sizes are a number a list, MOST_LISTS at most
    placed = entries.select("vector").mapInArrow(_lists(shared, dim), "list int, nearest int")
    sizes = {r[0]: (r[1], r[2]) for r in placed.groupBy("list").agg(F.count(F.lit(1)), F.sum("nearest")).collect()}
    blocks = Blocks(sizes, shared.value, block)
    put = entries.select("key", "vector", "ids").mapInArrow(_put(shared, blocks, dim), "block int, i int, ids array<long>, vector array<float>")
    look = queries.select("key", "vector").mapInArrow(_look(shared, blocks, dim, top + 1), "block int, i int, key long, least double, vector array<float>")
    asking = stage.keep(look.groupBy("block").agg(F.count(F.lit(1)).alias("m")).select("block", F.ceil(F.col("m") / block).cast("int").alias("m")), "asking")
    asking = F.broadcast(asking)  # a row a block
    put = put.join(asking, "block").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    look = look.join(asking, "block").withColumn("j", F.pmod(F.xxhash64("key"), F.col("m")).cast("int"))
    left, right = look.select("block", "i", "j", "key", "least", "vector"), put.select("block", "i", "j", "ids", "vector")
    found = left.groupBy("block", "i", "j").cogroup(right.groupBy("block", "i", "j")).applyInArrow(_block(dim, top + 1), "query long, vec_id long, score double")

    found = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.asc("vec_id")]
    best = stage.keep(found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("r") <= top + 1).drop("r"), "best")
    members = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(queries.select("h1", "h2", F.col("key").alias("query")), ["h1", "h2"])
    ranked = (members.join(best, "query").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
              .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= top))
    return ranked.select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, vectors: DataFrame, query_ids: list[int], top: int = TOP) -> float:
    """Share of the true `top` of the given queries that `found` has; compares them with every vector."""
    rows, dim = usable(vectors)
    asked = rows.where(F.col("vec_id").isin(query_ids)).toArrow()
    keys, q = asked.column("vec_id").to_pylist(), _matrix(asked.column("vector"), dim)

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("vec_id").to_pylist(), np.int64)
            best = best_of_block(keys, q, np.full(len(q), -np.inf), ids, _matrix(batch.column("vector"), dim), top + 1)
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in best], pa.int64()), pa.array([int(ids[b[1]]) for b in best], pa.int64()), pa.array([b[2] for b in best], pa.float64())], names=["query_id", "vec_id", "score"])
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = (rows.mapInArrow(run, "query_id long, vec_id long, score double").where("vec_id <> query_id")
            .withColumn("r", F.row_number().over(window)).where(F.col("r") <= top).select("query_id", "vec_id"))
    hit = true.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hit / max(1, true.count())
