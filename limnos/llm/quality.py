"""Operator 10: quality classifier on random-indexing word vectors.

Tokens (letters, digits, punctuation, in their case) hash to a fixed number of
word rows.  Each row has a sparse random index vector; its word vector is the
sum of the index vectors of the words within two places, over the texts of all
documents, labelled or not, scaled to length one and added to its own index vector.  A document is
the mean and the spread of its words' vectors and three counts.  A two-layer
numpy network is trained on those, and a temperature fitted on a part that the
training did not see calibrates its probabilities.

The network is fitted on at most `sample` labelled rows, those with the
smallest hash of their doc_id; the vectors, summed over every task's texts, and
its weights have a fixed size.
Scoring reads every whole text, in its own task, without a shuffle.

Results for odd input: null and empty texts are documents without words and get
a score like any other; labels without text or with a null label are not used;
without labelled rows of both classes the score is the share of label 1 (0.5
without any); repeated rows are scored each, and for learning the smallest label and
the smallest text of a doc_id count, whatever the order of rows; an empty table gives
no rows; columns other than ``doc_id``, ``text`` and ``quality`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import SPACES, chunks, span_hashes, word_spans, words_per_doc
from .store import Stage
from .word_blocks import pack, unpack

ROWS, DIM, NONZERO = 1 << 15, 32, 4
SAMPLE = 20_000
THRESHOLD = 0.7
HIDDEN = 32
_SLICE = 200_000
_GROUP = 1024

_KIND = np.full(256, 3, np.uint8)  # punctuation and control characters
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[SPACES] = 0
_random = np.random.default_rng(10)
_PLACES = np.stack([_random.permutation(DIM)[:NONZERO] for _ in range(ROWS)])
_SIGNS = _random.choice([-1, 1], (ROWS, NONZERO))


def index_vectors() -> np.ndarray:
    out = np.zeros((ROWS, DIM), np.float32)
    np.put_along_axis(out, _PLACES, _SIGNS.astype(np.float32), axis=1)
    return out


def word_rows(offsets, data):
    """(row of each token, tokens per document)."""
    kind = _KIND[data]
    breaks = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts, ends = word_spans(data, offsets, ~SPACES, breaks)
    return (span_hashes(data, starts, ends) % np.uint64(ROWS)).astype(np.int64), words_per_doc(starts, offsets)


def context_sums(rows, sizes, reach: int = 2) -> np.ndarray:
    """Sum of the index vectors of the words within `reach` places of each word row."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    total = np.zeros(ROWS * DIM)
    for gap in range(1, reach + 1):
        same = doc[gap:] == doc[:-gap]
        left, right = rows[:-gap][same], rows[gap:][same]
        for word, near in ((left, right), (right, left)):
            for k in range(NONZERO):
                total += np.bincount(word * DIM + _PLACES[near, k], weights=_SIGNS[near, k], minlength=len(total))
    return total.reshape(ROWS, DIM)


def word_vectors(context: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return (context / np.maximum(length, 1e-9) + 0.5 * index_vectors()).astype(np.float32)


def features(rows, sizes, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of each document's word vectors, log of its length, shares of distinct and of repeated tokens."""
    n = len(sizes)
    total, square = np.zeros((n, DIM)), np.zeros((n, DIM))
    doc = np.repeat(np.arange(n), sizes)
    for a in range(0, len(rows), _SLICE):
        part, of = vectors[rows[a:a + _SLICE]], doc[a:a + _SLICE]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        total[of[first]] += np.add.reduceat(part, first, axis=0)
        square[of[first]] += np.add.reduceat(part * part, first, axis=0)
    count = np.maximum(sizes, 1)[:, None]
    mean = total / count
    spread = np.sqrt(np.maximum(square / count - mean * mean, 0))
    distinct = np.unique(doc * ROWS + rows)
    kinds = np.bincount(distinct // ROWS, minlength=n) / count[:, 0]
    again = rows[1:] == rows[:-1]
    repeated = np.bincount(doc[1:][again & (doc[1:] == doc[:-1])], minlength=n) / count[:, 0]
    return np.hstack([mean, spread, np.log1p(sizes)[:, None], kinds[:, None], repeated[:, None]]).astype(np.float32)


class Network:
    """Two layers (rectified, then logistic) with scaled inputs and a temperature."""

    def __init__(self, weights: dict):
        self.w = weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.w
        h = np.maximum((x - w["mean"]) / w["scale"] @ w["w1"] + w["b1"], 0)
        return (h @ w["w2"] + w["b2"])[:, 0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.w["temperature"], -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, seed: int = 7) -> Network:
    """Adam on the log loss; the weights of the epoch with the least loss on a fifth kept aside, whose temperature is fitted there too."""
    r = np.random.default_rng(seed)
    aside = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    check = aside if aside.any() else ~aside
    mean, scale = x[~aside].mean(axis=0), x[~aside].std(axis=0) + 1e-3
    w = {"w1": r.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), "b1": np.zeros(hidden), "w2": r.normal(0, np.sqrt(1 / hidden), (hidden, 1)), "b2": np.zeros(1)}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    net = Network(w | {"mean": mean, "scale": scale, "temperature": 1.0})
    train, best = np.flatnonzero(~aside), (np.inf, None)

    def loss(temperature=1.0):
        z = net.logits(x[check]) / temperature
        return float(np.mean(np.logaddexp(0, z) - y[check] * z))
    for _ in range(epochs):
        for part in np.array_split(r.permutation(train), max(1, len(train) // 128)):
            a = (x[part] - mean) / scale
            h = np.maximum(a @ w["w1"] + w["b1"], 0)
            z = (h @ w["w2"] + w["b2"])[:, 0]
            d = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[part]) / len(part))[:, None]
            back = (d @ w["w2"].T) * (h > 0)
            grad = {"w1": a.T @ back + 1e-4 * w["w1"], "b1": back.sum(axis=0), "w2": h.T @ d + 1e-4 * w["w2"], "b2": d.sum(axis=0)}
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        net.w.update(w)
        if (now := loss()) < best[0]:
            best = now, {k: v.copy() for k, v in w.items()}
    net.w.update(best[1])
    net.w["temperature"] = min(np.geomspace(0.3, 5, 60).tolist(), key=loss)
    return net


class Constant:
    """The answer where there is nothing to learn."""

    def __init__(self, share: float):
        self.share = share

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def _contexts(batches):
    total = np.zeros((ROWS, DIM))
    for _, offsets, data in chunks(batches, limit=1 << 20):
        total += context_sums(*word_rows(offsets, data))
    schema = pa.schema([("part", pa.int32()), ("sums", pa.binary())])
    for k in range(0, ROWS, _GROUP):
        if total[k:k + _GROUP].any():
            yield pa.RecordBatch.from_pylist([dict(part=k // _GROUP, sums=pack(total[k:k + _GROUP].reshape(-1), "<i4"))], schema=schema)


def _add(key, group):
    total = sum(unpack(b, "<i4").astype(np.int64) for b in group.column("sums").to_pylist())
    return pa.table({"part": group.column("part")[:1], "sums": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def _feature_rows(shared):
    def run(batches):
        for rows, offsets, data in chunks(batches, limit=1 << 20):
            x = features(*word_rows(offsets, data), shared.value)
            yield pa.RecordBatch.from_arrays([rows.column("quality"), pa.array(list(x), pa.list_(pa.float32()))], names=["quality", "x"])
    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, quality) of at most `sample` labelled rows that are not held out: the smallest hashes of doc_id.

    Of labels that repeat a doc_id the smallest counts, of documents that do the smallest text (null only without another)."""
    marked = labels.select("doc_id", "quality").where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by `sample`
    return found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(word vectors of all texts, network from the labelled rows that are not held out)."""
    spark = docs.sparkSession
    stage = Stage(spark, "quality")
    rows = stage.keep(training_rows(docs, labels, sample).repartition(16, "doc_id"), "sample")
    sums = docs.select("text").mapInArrow(_contexts, "part int, sums binary").groupBy("part").applyInArrow(_add, "part int, sums binary").collect()
    context = np.zeros((ROWS, DIM))
    for part, blob in sums:
        context[part * _GROUP:(part + 1) * _GROUP] = np.frombuffer(blob, "<i8").reshape(_GROUP, DIM)
    vectors = word_vectors(context)
    shared = spark.sparkContext.broadcast(vectors)
    learnt = rows.select("doc_id", "quality", "text").orderBy("doc_id").select("quality", "text").mapInArrow(_feature_rows(shared), "quality int, x array<float>").toArrow()
    y = np.asarray(learnt.column("quality").to_numpy(), float)
    if len(set(y.tolist())) < 2:
        return shared, Constant(float(y.mean()) if len(y) else 0.5)
    x = np.asarray(learnt.column("x").combine_chunks().values.to_numpy(zero_copy_only=False), np.float64).reshape(len(y), -1)
    return shared, fit_network(x, y)


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    shared, network = model

    def run(batches):
        for rows, offsets, data in chunks(batches, limit=1 << 20):
            p = pa.array(network.probability(features(*word_rows(offsets, data), shared.value)), pa.float64())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), p], names=["doc_id", "score"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose text scores `threshold` or more, in all their columns."""
    shared, network = model

    def run(batches):
        for rows, offsets, data in chunks(batches, limit=1 << 20):
            yield rows.filter(pa.array(network.probability(features(*word_rows(offsets, data), shared.value)) >= threshold))
    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, fit(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
