"""Operator 8: secret scan with corpus-wide ownership frequency.

Every whole text is scanned for assignments, access keys and hex strings, and
for bare tokens that look generated (digits among letters).  The hashes of all
found values are counted over the corpus by distinct owners and repositories,
in two aggregations that merge before they shuffle.  A value is a copied example
if it occurs with `example_owners` owners or more, or in `example_repositories`
repositories or more, whoever owns them: a credential in use stays with its owner
and in a few of its repositories.  All other values look live.  Live bare tokens
join the spans of their documents; examples do not.  Spans found by the patterns
always stay and are told apart as live or example.

Offsets are code points, ends exclusive.  No secret leaves the scan: only its
64-bit hash is stored.

Results for odd input: null and empty texts have no spans; a null owner or
repository is an owner of its own; rows that repeat a doc_id give a row each; an
empty table gives no rows; other columns than the named ones are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, chunks, span_hashes, word_spans
from .store import Stage

KINDS = ("assign", "access", "hex", "owned")
#: Patterns and least lengths of the base kinds. FIXED VALUES of the contract.
_ASSIGN = re.compile(rb"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_WORDS = (b"passw", b"secret", b"token", b"api")
LEAST = {"assign": 12, "access": 18, "hex": 16, "owned": 20}
#: A value of so many owners, or in so many repositories, is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_DIGIT = "0123456789"
_ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX, _BARE, _DIGITS, _LETTERS = _bytes(_DIGIT + "abcdef"), _bytes(_DIGIT + _ALPHA + "+/_-"), _bytes(_DIGIT), _bytes(_ALPHA)


def _occurrences(raw: bytes, word: bytes):
    k = raw.find(word)
    while k >= 0:
        yield k
        k = raw.find(word, k + 1)


def _long_runs(data, offsets, chars, least: int):
    starts, ends = word_spans(data, offsets, chars)
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def _touched(spans, starts, ends) -> np.ndarray:
    """Whether any of the spans overlaps each run: of those that begin before its end, the farthest end decides."""
    if not spans:
        return np.zeros(len(starts), bool)
    at = np.asarray(sorted((s[2], s[3]) for s in spans), np.int64)
    before = np.searchsorted(at[:, 0], ends) - 1
    return (before >= 0) & (np.maximum.accumulate(at[:, 1])[before] > starts)


def find_spans(offsets, data) -> list[tuple[int, int, int, int, int, int]]:
    """(document, kind, start, end, value start, value end) in bytes of the chunk; bare tokens do not touch a base span."""
    raw, lowered, out = data.tobytes(), LOWER[data].tobytes(), []
    spot = sorted({int(d) for w in _WORDS for k in _occurrences(lowered, w) for d in [np.searchsorted(offsets, k, "right") - 1]})
    for d in spot:
        for m in _ASSIGN.finditer(raw, int(offsets[d]), int(offsets[d + 1])):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                out.append((d, 0, m.start(), m.end(), m.start(2), m.end(2)))
    for d in sorted({int(np.searchsorted(offsets, k, "right")) - 1 for k in _occurrences(raw, b"AKIA")}):
        for m in _ACCESS.finditer(raw, int(offsets[d]), int(offsets[d + 1])):
            if m.end() - m.start() >= LEAST["access"]:
                out.append((d, 1, m.start(), m.end(), m.start(), m.end()))
    starts, ends = _long_runs(data, offsets, _HEX, LEAST["hex"])
    docs = np.searchsorted(offsets, starts, "right") - 1
    out += [(d, 2, a, b, a, b) for d, a, b in zip(docs.tolist(), starts.tolist(), ends.tolist())]
    starts, ends = _long_runs(data, offsets, _BARE, LEAST["owned"])
    if len(starts):
        inside = np.ravel(np.column_stack((starts, ends - 1)))  # the last character is counted on its own

        def count(chars):
            has = chars[data].astype(np.int32)
            return np.add.reduceat(has, inside)[::2] + has[ends - 1]
        keep = (count(_DIGITS) >= 2) & (count(_LETTERS) >= 2) & ~_touched(out, starts, ends)
        docs = np.searchsorted(offsets, starts, "right") - 1
        out += [(d, 3, a, b, a, b) for d, a, b in zip(docs[keep].tolist(), starts[keep].tolist(), ends[keep].tolist())]
    return sorted(out)


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.int64())])
_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("owner", pa.string()), ("repository", pa.string()), ("text_hash", pa.int64()),
                    ("found", pa.list_(_SPAN))])
_FOUND_SQL = "row long, doc_id long, owner string, repository string, text_hash long, found array<struct<kind:int,start:long,end:long,hash:long>>"


def _scan(batches):
    row = TaskContext.get().partitionId() << 40
    for rows, offsets, data in chunks(batches):
        spans = find_spans(offsets, data)
        found = [[] for _ in range(rows.num_rows)]
        if spans:
            at = np.asarray(spans, np.int64)
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            base = points[offsets[at[:, 0]]]
            begin, end, h = points[at[:, 2]] - base, points[at[:, 3]] - base, span_hashes(data, at[:, 4], at[:, 5]).view(np.int64)
            for (d, kind, *_), a, b, x in zip(spans, begin.tolist(), end.tolist(), h.tolist()):
                found[d].append(dict(kind=kind, start=a, end=b, hash=x))
        ids = np.arange(row, row + rows.num_rows)
        row += rows.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(ids), rows.column("doc_id"), rows.column("owner"), rows.column("repository"), rows.column("text_hash"), pa.array(found, _FOUND.types[5])], schema=_FOUND)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories): in how many a value occurs over the whole corpus.

    A widely copied value is merged within tasks, then by owner and repository, before its hash is shuffled alone."""
    each = found.select(F.coalesce("owner", F.lit("\x00")).alias("owner"), F.coalesce("repository", F.lit("\x00")).alias("repository"), F.explode("found").alias("f"))
    by_repository = each.select("owner", "repository", F.col("f.hash").alias("hash")).distinct()
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("r"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("r").alias("repositories"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


_NONE = "cast(array() as array<struct<start:bigint,kind:int,end:bigint,live:boolean>>)"


def told_spans(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, example_owners: int = EXAMPLE_OWNERS,
               example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """doc_id, text_hash and `found`, the spans as (start, kind, end, live), of every document.

    owner, repository: expressions over the documents' columns; default source, and source with lang."""
    stage = Stage(docs.sparkSession, "secrets")
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    rows = docs.select("doc_id", "text", owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.xxhash64("text").alias("text_hash"))
    found = stage.keep(rows.mapInArrow(_scan, _FOUND_SQL), "found")
    owners = stage.keep(ownership(found), "owners")
    each = found.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    told = each.join(owners, "hash").withColumn("live", (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)).where("kind < 3 or live")
    spans = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("spans"))
    some = found.where(F.size("found") > 0).select("row", "doc_id", "text_hash").join(spans, "row", "left")
    return (some.select("doc_id", "text_hash", F.coalesce("spans", F.expr(_NONE)).alias("found"))
            .union(found.where(F.size("found") == 0).select("doc_id", "text_hash", F.expr(_NONE))))


def scan(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_example and `found`."""
    told = told_spans(docs, **options)

    def count(test):
        return F.size(F.filter("found", test)).cast("long")

    def of_kind(kind):
        return count(lambda s: s["kind"] == kind)
    return told.select(
        "doc_id", *[of_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_joined(F.filter("found", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
        of_kind(3).alias("n_owned"), count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_example"), "found")


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """`docs` with `mark` in the place of every live span (overlapping ones as one), and n_chars, where it is a
    column, as the length of the new text; copied examples stay."""
    live = F.transform(F.filter("found", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    spots = told_spans(docs, **options).select("doc_id", "text_hash", live.alias("live")).where(F.size("live") > 0).dropDuplicates(["doc_id", "text_hash"])
    spots = spots.select(F.struct("doc_id", "text_hash").alias("at"), "live")
    whole = docs.select(F.struct(*docs.columns).alias("d"))
    joined = whole.join(spots, (F.xxhash64("d.text") == F.col("at.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("at.doc_id")), "left").select("d", "live")
    # pieces of text between the merged spans: walk them in order, remembering the end of the last one
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("end"))

    def step(a, s):
        gap = F.substring(F.col("d.text"), (a["end"] + 1).cast("int"), (s["start"] - a["end"]).cast("int"))
        return F.when(s["start"] >= a["end"], F.struct(F.concat(a["text"], gap, F.lit(mark)).alias("text"), s["end"].alias("end"))).otherwise(
            F.struct(a["text"].alias("text"), F.greatest(a["end"], s["end"]).alias("end")))
    new = F.aggregate("live", start, step, lambda a: F.concat(a["text"], F.substring(F.col("d.text"), (a["end"] + 1).cast("int"), F.length("d.text"))))
    out = joined.select("d", F.when(F.col("live").isNotNull(), new).alias("new"))

    def column(c):
        if c == "text":
            return F.coalesce("new", "d.text").alias(c)
        if c == "n_chars":
            return F.coalesce(F.length("new").cast(docs.schema[c].dataType), "d.n_chars").alias(c)
        return F.col(f"d.`{c}`").alias(c)
    return out.select(*[column(c) for c in docs.columns])
