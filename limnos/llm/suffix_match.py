"""Operator 4: benchmark decontamination with suffix arrays of the training text.

Each chunk of documents is a shard.  Its words that occur in the benchmark are
numbered; maximal runs of such words (a match cannot leave one) form the shard's
text, and a suffix array over it is made by prefix doubling.  Every suffix of
every benchmark item is searched in it by binary search, all suffixes at once:
the bounds of its window (10 words, or the whole of a shorter item) are the
window's occurrences.  Windows that follow each other in both texts join to the
longest verbatim matches, with their places.  A document with a hit is affected
and can be removed.

The benchmark is broadcast as word numbers, in parts of at most ``PART_WORDS``
words.  With one part no document leaves its task, so there is no shuffle, and a
document or passage that is very common stays where it is.  With more, each part
is searched in a pass of its own whose hits are written by the hash of the text;
the covered words and items of a text are united over the parts.  An item of more
words than a part is cut into pieces that share a window less one word, so each
window is in one of them; only of such an item may a match be given as two spans.

Results for odd input: null and empty texts have no words and no hits; items
without words are left out; items without item_id are searched like the others,
count as one item together and are not in the list of ids; rows that repeat a
doc_id or an item_id are judged each; an empty table gives no rows, an empty
benchmark no hits; columns other than ``doc_id``, ``item_id`` and ``text`` are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, chunks, span_hashes, word_spans, words_per_doc
from .store import Stage

WINDOW = 10
#: Words of a benchmark that are broadcast at a time: 40 bytes each, and 32 while they are searched.
PART_WORDS = 1 << 20
#: Suffixes that are compared with a shard's at a time.
_BLOCK = 1 << 16
#: Word bytes: digits, letters and all of non-ASCII text.
_WORD = np.ones(256, bool)
_WORD[:48] = _WORD[58:97] = _WORD[123:128] = False
_WORD[65:91] = False  # upper-case letters are lowered before


def word_hashes(offsets, data):
    """(hash of each word, words per document, starts, ends)."""
    data = LOWER[data]
    starts, ends = word_spans(data, offsets, _WORD)
    return span_hashes(data, starts, ends), words_per_doc(starts, offsets)


class Benchmark:
    """Items, or pieces of them, as numbers of a common vocabulary, and the windows that they are searched by.

    `first` is the place in its item of a piece's first word; a piece whose place is not 0 goes on with the item of the
    piece before it."""

    def __init__(self, item_ids: list, hashes: np.ndarray, sizes: np.ndarray, window: int, first: np.ndarray | None = None):
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        self.text = (numbers + 1).astype(np.int64)  # 0: a word that no item has
        self.ids = item_ids
        first = np.zeros(len(sizes), np.int64) if first is None else first
        piece = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.cumsum(sizes) - sizes
        left = sizes[piece] - (np.arange(len(piece)) - begin[piece])  # words from here to the piece's end
        size = np.minimum(window, sizes)[piece]
        self.at = np.flatnonzero(left >= size)  # suffixes that hold a whole window
        self.size, self.piece = size[self.at], piece[self.at]
        starts = first == 0
        starts[:1] = True
        self.item = (np.cumsum(starts) - 1)[self.piece]
        self.item_at = self.at - (begin - first)[self.piece]
        self.least = int(self.size.min()) if len(self.size) else 0
        self.window = window

    def rows(self, begin: int, end: int):
        """The windows of these suffixes, a row each, filled up with 0."""
        span = np.arange(self.window)
        at = np.minimum(self.at[begin:end, None] + span, len(self.text) - 1)
        return np.where(span < self.size[begin:end, None], self.text[at], 0)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text in the order of their next `depth` numbers at least, by prefix doubling."""
    rank, n, k = text.astype(np.int64), len(text), 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        after = np.zeros(n, np.int64)
        after[:n - k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(ranked, prepend=ranked[:1]) != 0)
        if int(rank[order[-1]]) == n - 1:
            break
        k *= 2
    return order


def _bounds(text, order, rows, size):
    """First and last place in the suffix array whose suffix begins with each row's first `size` numbers."""
    width = rows.shape[1]
    padded = np.concatenate([text, np.full(width, -1, np.int64)])
    inside = np.arange(width) < size[:, None]
    out = []
    for upper in (False, True):
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(order), np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            found = padded[order[mid][:, None] + np.arange(width)]
            differs = (found != rows[open_]) & inside[open_]
            where = differs.argmax(axis=1)
            k = np.arange(len(open_))
            less = differs[k, where] & (found[k, where] < rows[open_][k, where])
            right = less | (~differs.any(axis=1) if upper else False)
            low[open_] = np.where(right, mid + 1, low[open_])
            high[open_] = np.where(right, high[open_], mid)
        out.append(low)
    return out


def shard_matches(hashes, sizes, bench: Benchmark):
    """(word position, benchmark suffix) of every occurrence of a window in a shard's words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(bench.at) or not len(hashes):
        return none
    at = np.minimum(np.searchsorted(bench.vocabulary, hashes), len(bench.vocabulary) - 1)
    number = np.where(bench.vocabulary[at] == hashes, at + 1, 0)
    doc_start = np.zeros(len(hashes) + 1, bool)
    doc_start[np.cumsum(sizes) - sizes] = True
    known = number > 0
    first = known.copy()
    first[1:] &= ~known[:-1] | doc_start[1:-1]
    last = known.copy()
    last[:-1] &= ~known[1:] | doc_start[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    keep = end - begin >= bench.least
    begin, size = begin[keep], (end - begin)[keep]
    if not len(begin):
        return none
    # the runs, each followed by a number that no item has
    place = np.repeat(begin - (np.cumsum(size + 1) - size - 1), size + 1) + np.arange(int((size + 1).sum()))
    text = number[np.minimum(place, len(number) - 1)]
    text[np.cumsum(size + 1) - 1] = 0
    order = suffix_array(text, bench.window)
    low, high = np.zeros(len(bench.at), np.int64), np.zeros(len(bench.at), np.int64)
    for k in range(0, len(bench.at), _BLOCK):
        low[k:k + _BLOCK], high[k:k + _BLOCK] = _bounds(text, order, bench.rows(k, k + _BLOCK), bench.size[k:k + _BLOCK])
    n = high - low
    suffix = np.repeat(np.arange(len(n)), n)
    hit = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    return place[hit], suffix


_SPAN, _RANGE = "item_id:long,at:long,item_at:long,words:long", "begin:long,upto:long"
_HITS = f"n_words long, n_hit long, items array<long>, spans array<struct<{_SPAN}>>, covered array<struct<{_RANGE}>>"


def _struct(fields):
    return pa.struct([(f.split(":")[0], pa.int64()) for f in fields.split(",")])


_HITS_ARROW = [pa.field("n_words", pa.int64()), pa.field("n_hit", pa.int64()), pa.field("items", pa.list_(pa.int64())),
               pa.field("spans", pa.list_(_struct(_SPAN))), pa.field("covered", pa.list_(_struct(_RANGE)))]


def _longest(doc, at, suffix, bench: Benchmark):
    """Windows that follow each other in document and item, joined: (doc, at, piece, item_at, words)."""
    item, item_at = bench.item[suffix], bench.item_at[suffix]
    order = np.lexsort((at, at - item_at, item, doc))
    doc, at, item, item_at, size, piece = doc[order], at[order], item[order], item_at[order], bench.size[suffix][order], bench.piece[suffix][order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (item_at[1:] != item_at[:-1] + 1)
    begin = np.flatnonzero(new)
    finish = np.append(begin[1:], len(doc)) - 1
    return doc[begin], at[begin], piece[begin], item_at[begin], at[finish] - at[begin] + size[finish]


def _by_document(doc):
    """(document, first row, end) of rows in the order of their documents."""
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    return zip(doc[begin].tolist(), begin.tolist(), np.append(begin[1:], len(doc)).tolist())


def _search(shared, key):
    """`key` and the hits of each row."""
    def run(batches):
        bench = shared.value
        for rows, offsets, data in chunks(batches):
            hashes, sizes = word_hashes(offsets, data)
            begin = np.cumsum(sizes) - sizes
            place, suffix = shard_matches(hashes, sizes, bench)
            n_hit, items, spans, covered = np.zeros(len(sizes), np.int64), [[]] * len(sizes), [[]] * len(sizes), [[]] * len(sizes)
            if len(place):
                cover = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(cover, place, 1)
                np.add.at(cover, place + bench.size[suffix], -1)
                hit = np.cumsum(cover[:-1]) > 0
                total = np.concatenate(([0], np.cumsum(hit)))
                n_hit = total[begin + sizes] - total[begin]
                edge = np.diff(hit, prepend=False)
                edge[begin[(sizes > 0) & (begin > 0)]] = True  # no range goes on into the next document
                cut = np.append(np.flatnonzero(edge), len(hit))
                first, upto = cut[:-1][hit[cut[:-1]]], cut[1:][hit[cut[:-1]]]
                doc = np.searchsorted(begin + sizes, first, "right")
                for k, a, b in _by_document(doc):
                    covered[k] = [dict(begin=x, upto=y) for x, y in zip((first[a:b] - begin[k]).tolist(), (upto[a:b] - begin[k]).tolist())]
                doc = np.searchsorted(begin + sizes, place, "right")
                d, at, piece, item_at, words = _longest(doc, place - begin[doc], suffix, bench)
                for k, a, b in _by_document(d):
                    ids = [bench.ids[i] for i in piece[a:b].tolist()]
                    spans[k] = [dict(item_id=i, at=x, item_at=y, words=w) for i, x, y, w in zip(ids, at[a:b].tolist(), item_at[a:b].tolist(), words[a:b].tolist())]
                    items[k] = sorted(set(ids), key=lambda i: (i is None, i))
            found = [pa.array(sizes), pa.array(n_hit), *(pa.array(x, f.type) for x, f in zip((items, spans, covered), _HITS_ARROW[2:]))]
            yield pa.RecordBatch.from_arrays([rows.column(key), *found], schema=pa.schema([rows.schema.field(key), *_HITS_ARROW]))
    return run


def _as_hashes(most: int, window: int):
    step = max(most - window + 1, 1)

    def run(batches):
        for rows, offsets, data in chunks(batches):
            hashes, sizes = word_hashes(offsets, data)
            ids, first, words = [], [], []
            for item_id, a, n in zip(rows.column("item_id").to_pylist(), (np.cumsum(sizes) - sizes).tolist(), sizes.tolist()):
                # every piece has a whole window; its next one begins with the first window that it lacks
                for k in range(0, max(n - window + 1, 1) if n > most else min(n, 1), step):
                    ids.append(item_id)
                    first.append(k)
                    words.append(hashes[a + k:a + min(k + step + window - 1, n)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first, pa.int64()), pa.array(words, pa.large_binary())], ["item_id", "first", "words"])
    return run


def parts(benchmark: DataFrame, window: int = WINDOW, most: int = PART_WORDS):
    """The items of (item_id, text) as numbers, in parts of at most `most` words (and a window); at least one part.

    Items arrive as word hashes, a partition of the benchmark at a time; the driver holds that and one part."""
    most = max(most, window)
    ids, first, words, n = [], [], [], 0

    def part():
        hashes = [np.frombuffer(w, np.uint64) for w in words]
        return Benchmark(list(ids), np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
                         np.array([len(h) for h in hashes], np.int64), window, np.array(first, np.int64))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    for row in items.mapInArrow(_as_hashes(most, window), "item_id long, first long, words binary").toLocalIterator():
        size = len(row.words) // 8
        if ids and n + size > most:
            yield part()
            ids, first, words, n = [], [], [], 0
        ids.append(row.item_id)
        first.append(row["first"])
        words.append(bytes(row.words))
        n += size
    yield part()


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, most: int):
    """(only one part, its broadcast) for each part in turn; the broadcast is freed before the next."""
    following = parts(benchmark, window, most)
    bench, only = next(following), True
    while bench is not None:
        after = next(following, None)
        shared = docs.sparkSession.sparkContext.broadcast(bench)
        only = only and after is None
        yield only, shared
        if not only:
            shared.destroy()
        bench = after


def _text_hits(docs: DataFrame, shared) -> DataFrame:
    """The hits of each distinct text that has some, under the hash of the text; copies are merged before the shuffle."""
    keyed = docs.select(_text_key().alias("key"), "text")
    found = keyed.mapInArrow(_search(shared, "key"), f"key string, {_HITS}").where("n_hit > 0")
    return found.groupBy("key").agg(*[F.any_value(c).alias(c) for c in ("items", "spans", "covered")])


def _text_key():
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _united(ranges):
    """Number of words in at least one of the ranges."""
    def add(done, r):
        return F.struct((done["n"] + F.greatest(F.lit(0), r["upto"] - F.greatest(done["upto"], r["begin"]))).alias("n"),
                        F.greatest(done["upto"], r["upto"]).alias("upto"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    return F.aggregate(F.array_sort(ranges), none, add, lambda done: done["n"])


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = PART_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a window's occurrence), items, spans: the longest verbatim matches of at
    least a window, by item and by word position in document and item; and covered: the hit words as ranges."""
    stage, found = Stage(docs.sparkSession, "suffix-match"), []
    for only, shared in _passes(docs, benchmark, window, most):
        if only:
            return docs.select("doc_id", "text").mapInArrow(_search(shared, "doc_id"), f"doc_id {dict(docs.dtypes)['doc_id']}, {_HITS}")
        found.append(stage.keep(_text_hits(docs, shared), f"part-{len(found)}"))
    # a text has at most a row a part
    hits = reduce(DataFrame.unionByName, found).groupBy("key").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("items", "spans", "covered")])
    sizes = docs.select("doc_id", "text", _text_key().alias("key")).mapInArrow(_sizes, f"doc_id {dict(docs.dtypes)['doc_id']}, key string, n_words long")
    return sizes.join(hits, "key", "left").select(
        "doc_id", "n_words", F.coalesce(_united(F.col("covered")), F.lit(0)).cast("long").alias("n_hit"),
        *[F.coalesce(F.array_distinct(F.array_sort(c)), F.array().cast(t)).alias(c) for c, t in
          (("items", "array<long>"), ("spans", f"array<struct<{_SPAN}>>"), ("covered", f"array<struct<{_RANGE}>>"))])


def _sizes(batches):
    for rows, offsets, data in chunks(batches):
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("key"), pa.array(word_hashes(offsets, data)[1], pa.int64())], ["doc_id", "key", "n_words"])


def affected(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = PART_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest (words)."""
    joined = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return search(docs, benchmark, window, most).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["words"])), F.lit(0)).cast("long").alias("longest"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = PART_WORDS) -> DataFrame:
    """The documents without a match, in all their columns; rows without doc_id are kept if their text is clean."""
    stage, found = Stage(docs.sparkSession, "suffix-match"), []
    for only, shared in _passes(docs, benchmark, window, most):
        if only:
            return docs.mapInArrow(_without_hits(shared), docs.schema)
        found.append(stage.keep(_text_hits(docs, shared).select("key"), f"part-{len(found)}"))
    hits = reduce(DataFrame.unionByName, found).distinct()
    return docs.join(hits, _text_key() == hits["key"], "left_anti")


def _without_hits(shared):
    def run(batches):
        for rows, offsets, data in chunks(batches):
            hashes, sizes = word_hashes(offsets, data)
            place, _ = shard_matches(hashes, sizes, shared.value)
            hit = np.zeros(len(sizes), bool)
            hit[np.searchsorted(np.cumsum(sizes), place, "right")] = True
            yield rows.filter(pa.array(~hit))
    return run
