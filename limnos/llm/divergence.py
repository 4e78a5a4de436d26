"""Operator 11: source divergence audit over a minimal acyclic transducer vocabulary.

1. Document frequencies of terms are counted in tasks, merged, and each language
   keeps the terms of at least `least` documents.
2. The kept terms, range-sorted by (language, term), are read in order by builder
   tasks.  A builder adds each term to a minimal acyclic automaton: states that
   accept the same endings are one state, found in a register as soon as no later
   term can change them.  Every transition carries the number of terms that come
   before it, so the sum along a term's way is its place among the sorted terms:
   its lexicographic ordinal.  A transducer is cut after `SHARD_TERMS` terms or
   `SHARD_BYTES` bytes; the shards of a language follow each other in order.
3. The text is streamed through the transducers for recounting: the distinct words
   of a chunk walk all at once, a byte a step, and leave (language, source,
   ordinal, count) rows.  Transducers of up to `BROADCAST_BYTES` go to the tasks in
   one pass over the text; a larger vocabulary takes several passes, each with its
   shards.
4. Shares, divergences and ranks are exact integers.  Ordinals stand for terms in
   all joins and break ties; only reported ones are turned back into terms by
   walking the transducers.

Two groups' divergence is the sum of f over all kept terms.  Only terms that one of
them has are visited: with p0 as the share of a term that a group lacks, the sum is
that over common terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), plus each
group's own sum of f(p, q0), which needs but its counts of counts, plus f(p0, q0)
for all others.

Results for odd input: null text, lang and source are empty strings; a group
without kept terms is audited with count 0 for every term; a language without kept
terms has pairs of value 0 and no terms; a language of one source has no pairs;
rows that repeat a doc_id are a document each; an empty table gives no rows;
columns other than ``text``, ``lang`` and ``source`` are not read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import LOWER, chunks, number_words, ragged_take, slices, word_spans, words_per_doc
from .store import Stage
from .word_blocks import pack, unpack

LEAST_DOCUMENTS, TOP = 10, 10
SCALE, PRIOR = 1_000_000_000, 2
#: A transducer ends after so many terms or bytes of terms.
SHARD_TERMS, SHARD_BYTES = 131_072, 2 << 20
#: Unpacked transducers that one pass over the text sends to the tasks.
BROADCAST_BYTES = 64 << 20
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


class Builder:
    """A minimal acyclic transducer from terms that come in ascending order of bytes."""

    def __init__(self):
        self.register, self.edges, self.final, self.count = {}, [], [], []
        self.open, self.last, self.n, self.bytes = [[False, []]], b"", 0, 0

    def _close(self, node) -> int:
        """The state of a node that no later term changes."""
        key = (node[0], tuple(node[1]))
        state = self.register.get(key)
        if state is None:
            state = self.register[key] = len(self.edges)
            self.edges.append(node[1])
            self.final.append(node[0])
            self.count.append(node[0] + sum(self.count[child] for _, child in node[1]))
        return state

    def _close_to(self, depth: int) -> None:
        while len(self.open) > depth + 1:
            node = self.open.pop()
            self.open[-1][1].append((self.last[len(self.open) - 1], self._close(node)))

    def add(self, term: bytes) -> None:
        if self.n and term <= self.last:
            raise ValueError("terms must ascend")
        same, most = 0, min(len(term), len(self.last))
        while same < most and term[same] == self.last[same]:
            same += 1
        self._close_to(same)
        self.open += [[False, []] for _ in range(len(term) - same)]
        self.open[-1][0] = True
        self.last, self.n, self.bytes = term, self.n + 1, self.bytes + len(term)

    def finish(self) -> "Transducer":
        self._close_to(0)
        root = self._close(self.open[0])
        keys, target, skip = [], [], []
        for state, edges in enumerate(self.edges):
            before = int(self.final[state])
            for label, child in edges:
                keys.append(state << 8 | label)
                target.append(child)
                skip.append(before)
                before += self.count[child]
        return Transducer(np.asarray(keys, np.int64), np.asarray(target, np.int64), np.asarray(skip, np.int64), np.asarray(self.final, bool), root)


class Transducer:
    """keys: state << 8 | byte of each transition, ascending; target: its next state; skip: terms before it in its state."""
    ENTRY = 24

    def __init__(self, keys, target, skip, final, root):
        self.keys, self.target, self.skip, self.final, self.root = keys, target, skip, final, root

    def packed(self) -> dict:
        return dict(keys=pack(self.keys, "<i8"), target=pack(self.target, "<u4"), skip=pack(self.skip, "<u4"), final=pack(self.final, "u1"), root=self.root)

    @classmethod
    def unpacked(cls, row) -> "Transducer":
        return cls(unpack(bytes(row["keys"]), "<i8"), unpack(bytes(row["target"]), "<u4").astype(np.int64), unpack(bytes(row["skip"]), "<u4").astype(np.int64),
                   unpack(bytes(row["final"]), "u1").astype(bool), row["root"])

    def ordinals(self, data, starts, ends) -> np.ndarray:
        """The ordinal of each byte span, -1 for spans that are no term; all walk together, a byte a step."""
        size, out, total = ends - starts, np.full(len(starts), -1), np.zeros(len(starts), np.int64)
        at, state, k = np.arange(len(starts)), np.full(len(starts), self.root), 0
        while len(at):
            stop = size[at] == k
            told = at[stop][self.final[state[stop]]]
            out[told] = total[told]
            at, state = at[~stop], state[~stop]
            if not len(at) or not len(self.keys):
                break
            key = state << 8 | data[starts[at] + k]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[edge] == key
            at, edge = at[hit], edge[hit]
            total[at] += self.skip[edge]
            state = self.target[edge]
            k += 1
        return out

    def term(self, ordinal: int) -> bytes:
        """The term of an ordinal."""
        state, out = self.root, bytearray()
        while not (self.final[state] and ordinal == 0):
            a, b = np.searchsorted(self.keys, (state << 8, (state + 1) << 8))
            edge = a + int(np.searchsorted(self.skip[a:b], ordinal, "right")) - 1
            ordinal -= int(self.skip[edge])
            out.append(int(self.keys[edge]) & 255)
            state = int(self.target[edge])
        return bytes(out)


def _words(offsets, data):
    """(lower-cased bytes, starts and ends of distinct words, word of each occurrence, document of each occurrence)."""
    data = LOWER[data]
    starts, ends = word_spans(data, offsets, _LETTERS)
    _, first, inverse = number_words(data, starts, ends)
    return data, starts[first], ends[first], inverse, np.repeat(np.arange(len(offsets) - 1), words_per_doc(starts, offsets))


def _strings(data, starts, ends, pick) -> pa.Array:
    flat, size = ragged_take(data, starts, ends - starts, pick)
    offsets = np.concatenate(([0], np.cumsum(size)))
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.string())


def _coded(column) -> tuple[np.ndarray, pa.Array]:
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    return column.indices.to_numpy(zero_copy_only=False).astype(np.int64), column.dictionary


def _frequencies(batches):
    """(lang, term, df) of each chunk."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64())])
    for rows, offsets, data in chunks(batches):
        data, starts, ends, word, doc = _words(offsets, data)
        if not len(word):
            continue
        code, names = _coded(rows.column("lang"))
        once = np.unique(word * len(code) + doc)
        own, df = np.unique(code[once % len(code)] * len(starts) + once // len(code), return_counts=True)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(own // len(starts))), _strings(data, starts, ends, own % len(starts)), pa.array(df)], schema=schema)


_SHARD = "lang string, at long, first binary, n long, size long, keys binary, target binary, skip binary, final binary, root long"


def _build(shard_terms: int, shard_bytes: int):
    """Transducers of the sorted (lang, term) rows of a task."""
    schema = pa.schema([("lang", pa.string()), ("at", pa.int64()), ("first", pa.binary()), ("n", pa.int64()), ("size", pa.int64()), *[(c, pa.binary()) for c in ("keys", "target", "skip", "final")],
                        ("root", pa.int64())])

    def run(batches):
        at, lang, first, builder = TaskContext.get().partitionId() << 32, None, None, None

        def done():
            made = builder.finish()
            size = Transducer.ENTRY * len(made.keys) + len(made.final)
            return pa.RecordBatch.from_pylist([dict(lang=lang, at=at, first=first, n=builder.n, size=size, **made.packed())], schema=schema)
        for batch in batches:
            for name, term in zip(batch.column("lang").to_pylist(), batch.column("term").cast(pa.binary()).to_pylist()):
                if builder is None or name != lang or builder.n >= shard_terms or builder.bytes >= shard_bytes:
                    if builder is not None:
                        yield done()
                        at += 1
                    lang, first, builder = name, term, Builder()
                builder.add(term)
        if builder is not None:
            yield done()
    return run


_BUILT: dict = {}


class Vocabulary:
    """Transducers of some shards by language: [(first term, base ordinal, transducer)] in order."""

    def __init__(self, shards: list[dict]):
        self.by_lang = {}
        for s in sorted(shards, key=lambda s: s["at"]):
            self.by_lang.setdefault(s["lang"], []).append((bytes(s["first"]), s["base"], Transducer.unpacked(s)))

    def ordinals(self, lang: str, data, starts, ends) -> np.ndarray:
        shards = self.by_lang.get(lang, [])
        out = np.full(len(starts), -1)
        if len(shards) == 1:
            part = np.zeros(len(starts), np.int64)
        else:
            firsts = [s[0] for s in shards]
            part = np.asarray([bisect.bisect_right(firsts, w) - 1 for w in slices(data, starts, ends)], np.int64)
        for k, (_, base, transducer) in enumerate(shards):
            own = np.flatnonzero(part == k)
            found = transducer.ordinals(data, starts[own], ends[own])
            out[own] = np.where(found >= 0, found + base, -1)
        return out


def _recount(shared):
    """(lang, source, ordinals, counts) of each chunk and group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("ord", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])

    def run(batches):
        if _BUILT.get("shards") is not shared.value:
            _BUILT.update(shards=shared.value, vocabulary=Vocabulary(shared.value))
        vocabulary = _BUILT["vocabulary"]
        for rows, offsets, data in chunks(batches):
            data, starts, ends, word, doc = _words(offsets, data)
            if not len(word):
                continue
            (lang, langs), (source, sources) = _coded(rows.column("lang")), _coded(rows.column("source"))
            width = len(starts)
            own, n = np.unique((lang * len(sources) + source)[doc] * width + word, return_counts=True)
            group, word = own // width, own % width
            for code, name in enumerate(langs.to_pylist()):
                mine = np.flatnonzero(group // len(sources) == code)
                some = np.unique(word[mine])
                ordinal = np.full(width, -1)
                ordinal[some] = vocabulary.ordinals(name, data, starts[some], ends[some])
                mine = mine[ordinal[word[mine]] >= 0]
                cut = np.flatnonzero(np.diff(group[mine], prepend=-1))
                if not len(cut):
                    continue
                ends_at = pa.array(np.append(cut, len(mine)).astype(np.int32))
                of = pa.array(group[mine[cut]] % len(sources))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cut)), sources.take(of), pa.ListArray.from_arrays(ends_at, pa.array(ordinal[word[mine]])),
                                                  pa.ListArray.from_arrays(ends_at, pa.array(n[mine]))], schema=schema)
    return run


def transducers(docs: DataFrame, stage: Stage, least: int, shard_terms: int = SHARD_TERMS, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, list[dict]]:
    """(table of the shards, what the driver knows of them: lang, at, n, size, base; a row a shard)."""
    df = docs.select("lang", "text").mapInArrow(_frequencies, "lang string, term string, df long").groupBy("lang", "term").agg(F.sum("df").alias("df"))
    kept = stage.keep(df.where(F.col("df") >= least).select("lang", "term"), "kept")
    tasks = -(-kept.count() // shard_terms) or 1
    order = ["lang", "term"]
    made = stage.keep(kept.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(_build(shard_terms, shard_bytes), _SHARD), "transducers")
    known, base = [], {}
    for r in sorted(made.select("lang", "at", "n", "size").collect(), key=lambda r: r.at):
        known.append(r.asDict() | {"base": base.get(r.lang, 0)})
        base[r.lang] = base.get(r.lang, 0) + r.n
    return made, known


def recount(docs: DataFrame, made: DataFrame, known: list[dict], limit: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, source, ord, n) of every kept term that a group has, by passes of up to `limit` bytes of transducers."""
    spark, passes, room = docs.sparkSession, [], 0
    for shard in known:
        if not passes or shard["size"] > room:
            passes.append([])
            room = limit
        passes[-1].append(shard)
        room -= shard["size"]
    parts = []
    for shards in passes or [[]]:
        base = {s["at"]: s["base"] for s in shards}
        rows = [r.asDict() | {"base": base[r.at]} for r in made.where(F.col("at").isin(list(base))).collect()] if base else []
        parts.append(docs.mapInArrow(_recount(spark.sparkContext.broadcast(rows)), "lang string, source string, ord array<long>, n array<long>"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = found.select("lang", "source", F.explode(F.arrays_zip("ord", "n")).alias("x")).select("lang", "source", "x.ord", "x.n")
    return found.groupBy("lang", "source", "ord").agg(F.sum("n").alias("n"))


def share(n: str, total: str, size: str) -> Column:
    """1 + floor(SCALE (n + PRIOR) / (total + PRIOR size)), exactly; null if the language keeps no term."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + {PRIOR} as decimal(20,0))) div nullif({total} + {PRIOR} * {size}, 0)")


def gap(p: str, q: str) -> str:
    """floor((p - q)**2 / (p + q)); the square of shares up to SCALE + 1 has 61 bits."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def _terms(wanted: DataFrame, made: DataFrame, known: list[dict]) -> DataFrame:
    """(lang, ord, term) of the wanted (lang, ord), by walking the transducers; a row a shard, of its wanted ordinals."""
    spark = wanted.sparkSession
    of = spark.createDataFrame([(s["lang"], s["at"], s["base"], s["base"] + s["n"]) for s in known], "lang string, at long, base long, stop long")
    placed = wanted.distinct().join(F.broadcast(of), "lang").where("ord >= base and ord < stop")  # a row a shard: V / SHARD_TERMS
    lists = placed.groupBy("lang", "at", "base").agg(F.collect_list("ord").alias("ords"))

    def run(batches):
        schema = pa.schema([("lang", pa.string()), ("ord", pa.int64()), ("term", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                t = Transducer.unpacked(row)
                yield pa.RecordBatch.from_pylist([dict(lang=row["lang"], ord=o, term=t.term(o - row["base"]).decode()) for o in row["ords"]], schema=schema)
    return made.drop("lang").join(lists, "at").select("lang", "base", "ords", "keys", "target", "skip", "final", "root").mapInArrow(run, "lang string, ord long, term string")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, shard_terms: int = SHARD_TERMS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: of every (lang, source) group its divergence from the lang's other sources
    (`pair`) and the `top` terms that set it apart from the whole lang (`term`)."""
    spark = docs.sparkSession
    stage = Stage(spark, "divergence")
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    made, known = transducers(docs, stage, least, shard_terms)
    counts = stage.keep(recount(docs, made, known, limit), "counts")
    size: dict = {}
    for s in known:
        size[s["lang"]] = size.get(s["lang"], 0) + s["n"]
    sizes = spark.createDataFrame(list(size.items()), "lang string, v long")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "v")])
    groups = stage.keep(groups.withColumn("p0", share("0", "total", "v")), "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("q_total"))
    whole = Window.partitionBy("lang", "ord")  # a row a source
    shares = counts.join(groups, ["lang", "source"]).join(langs, "lang").withColumn("q_n", F.sum("n").over(whole))
    shares = stage.keep(shares.select("lang", "source", "ord", "p0", share("n", "total", "v").alias("p"), share("q_n", "q_total", "v").alias("q")), "shares")
    # terms
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ord")
    apart = shares.where("p > q").select("lang", "source", "ord", F.expr(gap("p", "q")).alias("value"))
    apart = stage.keep(apart.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top), "apart")
    terms = apart.join(_terms(apart.select("lang", "ord"), made, known), ["lang", "ord"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    # pairs: common terms, then what each has of its own, then the rest
    a, b = (shares.select("lang", "ord", *[F.col(c).alias(f"{s}{c}") for c in ("source", "p", "p0")]) for s in "ab")
    common = a.join(b, ["lang", "ord"]).where("asource < bsource").groupBy("lang", "asource", "bsource").agg(
        F.sum(F.expr(f"{gap('ap', 'bp')} - {gap('ap', 'bp0')} - {gap('ap0', 'bp')} + {gap('ap0', 'bp0')}")).alias("value"))
    pairs = common.select("lang", F.col("asource").alias("source"), F.col("bsource").alias("item"), "value").union(common.select("lang", "bsource", "asource", "value"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("terms").alias("q_terms"))
    counted = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")).join(other, "lang").where("source <> item")
    own = counted.groupBy("lang", "source", "item").agg(F.sum(F.expr(f"m * ({gap('p', 'q0')})")).alias("value"))
    rest = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.expr(f"coalesce((v - terms - q_terms) * ({gap('p0', 'q0')}), 0)").alias("value"))
    every = pairs.union(own).union(own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).union(rest)
    every = every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").union(terms)
