"""Operator 7: token counts that follow edits.

A document is cut into pre-tokens by the tokenizer's pattern; runs of pre-tokens
are the leaves of its segment tree, which holds characters and tokens of every
subtree.  An edit re-encodes from the leaf that it touches (one leaf earlier if
it begins at a border, since a pre-token looks one character ahead) up to the
first old leaf border behind the edit that is a pre-token border of the new text
too; from there on old and new text are cut alike, as the pattern never looks
back.  The leaves in between are replaced and their sums updated up to the root;
a replacement of over two leaves' pre-tokens is cut into leaves.

`trees` encodes texts once and gives the leaves of their trees, a table to be kept.
`count_edited` reads such a table with edits and encodes only what the edits touch;
with `keep` it returns the table of the edited texts, which takes the next edits.
Documents come with their edits as an array column, or a table of edits is joined
by doc_id.  Positions count code points of the text that the edits before left.

Results for odd input: null text is empty text; null or empty edits leave it as
it is; positions and lengths beyond the text are cut to it, null ones are 0 and a
null insertion is empty; rows that repeat a doc_id are counted each; an empty
table gives no rows; a missing or null tree, and one whose checksum is not that of
the text, is built from the whole text (``built_chars``); columns other than those
of the tree table and ``edits`` are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
#: Pre-tokens of a new leaf.
LEAF = 64
EDITS = "array<struct<seq:int,at:long,remove:long,insert:string>>"
_CODERS: dict = {}


def ranks_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path(DEFAULT_RANKS)


class Counter(dict):
    """Tokens of a pre-token, encoded once while it is remembered."""

    def __init__(self, path: str, limit: int = 500_000):
        import public_tokenizers
        import regex
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.encoding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.limit = limit

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n


def counter(path: str) -> Counter:
    if path not in _CODERS:
        _CODERS[path] = Counter(path)
    return _CODERS[path]


class SegmentTree:
    """Sums of (characters, tokens) over the leaves of a document; a complete binary tree in one list."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves, self.width = len(chars), 1
        while self.width < max(1, self.leaves):
            self.width *= 2
        self.chars, self.tokens = ([0] * self.width + x + [0] * (self.width - len(x)) for x in (chars, tokens))
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character `at`; the last one with text for the end."""
        k, begin = 1, 0
        at = min(at, self.chars[1] - 1)
        while k < self.width:
            k *= 2
            if at - begin >= self.chars[k]:
                begin += self.chars[k]
                k += 1
        return k - self.width, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.width
        self.chars[k], self.tokens[k] = chars, tokens
        while k > 1:
            k //= 2
            self._sum(k)

    def replace(self, leaf: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """New leaves for those from `leaf` to `last`; only where they are more the tree is laid out anew, from sums."""
        if len(chars) > last + 1 - leaf:
            a, b = self.width + leaf, self.width + last + 1
            old = [x[self.width:a] + new + x[b:self.width + self.leaves] for x, new in ((self.chars, chars), (self.tokens, tokens))]
            self.__init__(*old)
            return
        for k in range(leaf, last + 1):
            new = (chars[k - leaf], tokens[k - leaf]) if k - leaf < len(chars) else (0, 0)
            if (self.chars[self.width + k], self.tokens[self.width + k]) != new:
                self.put(k, *new)

    def grown(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves that hold text."""
        held = [k for k in range(self.width, self.width + self.leaves) if self.chars[k]]
        return [self.chars[k] for k in held], [self.tokens[k] for k in held]


def build(text: str, count: Counter, leaf: int = LEAF) -> SegmentTree:
    pieces = count.pattern.findall(text)
    n, size = [count[p] for p in pieces], list(map(len, pieces))
    cuts = range(0, len(pieces), leaf)
    return SegmentTree([sum(size[a:a + leaf]) for a in cuts] or [0], [sum(n[a:a + leaf]) for a in cuts] or [0])


def apply_edit(text: str, tree: SegmentTree, at: int, remove: int, insert: str, count: Counter, size: int = LEAF) -> tuple[str, int]:
    """(new text, re-encoded characters); the tree is updated in place."""
    at = min(max(at or 0, 0), len(text))
    end = min(at + max(remove or 0, 0), len(text))
    new = text[:at] + (insert or "") + text[end:]
    shift = len(new) - len(text)
    leaf, begin = tree.find(max(at - 1, 0)) if text else (0, 0)  # the leaf that holds the character before the edit
    if begin == max(at - 1, 0) and begin:  # a pre-token that ends at this border looks at a character beside the edit
        leaf, begin = tree.find(begin - 1)
    last, old_border = leaf, begin + tree.chars[tree.width + leaf]
    chars, tokens, position = [], [], begin
    for m in count.pattern.finditer(new, begin):
        while old_border + shift < position and last + 1 < tree.leaves or old_border < end and last + 1 < tree.leaves:
            last += 1
            old_border += tree.chars[tree.width + last]
        if position == old_border + shift and old_border >= end and position > begin:
            break
        chars.append(m.end() - m.start())
        tokens.append(count[m[0]])
        position = m.end()
    else:  # the text's end: every later leaf is replaced too
        last = tree.leaves - 1
    step = size if len(chars) > 2 * size else max(len(chars), 1)
    cuts = range(0, len(chars), step)
    tree.replace(leaf, last, [sum(chars[a:a + step]) for a in cuts] or [0], [sum(tokens[a:a + step]) for a in cuts] or [0])
    return new, position - begin


def follow(text: str, edits: list[dict], count: Counter, leaf: int = LEAF, tree: SegmentTree | None = None) -> tuple[str, SegmentTree, int, int]:
    """(edited text, tree, tokens before, characters that the edits re-encoded); a given tree is that of the text."""
    tree = build(text, count, leaf) if tree is None else tree
    before, again = tree.total, 0
    for e in sorted(edits, key=lambda e: e["seq"] or 0):
        text, n = apply_edit(text, tree, e["at"], e["remove"], e["insert"], count, leaf)
        again += n
    return text, tree, before, again


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
_TREE = "leaf_chars array<long>, leaf_tokens array<long>, text_crc32 long"
_OUT = f"doc_id long, n_tokens long, n_edits int, n_tokens_after long, n_chars_after long, reencoded_chars long, built_chars long, after_sha256 string, {_TREE}"


def _batches(schema: str, work):
    """`work` of each row, 256 rows at a time."""
    fields = [f.strip().split() for f in schema.split(",")]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                out = [work(**row) for row in batch.slice(a, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*out), fields)], names=[name for name, _ in fields])
    return run


def _checksum(text: str) -> int:
    return zlib.crc32(text.encode())


def _tree_row(path: str):
    def work(doc_id, text):
        tree = build(text or "", counter(path))
        return doc_id, text, *tree.grown(), _checksum(text or "")
    return work


def _edited_row(path: str, keep: bool):
    def work(doc_id, text, edits, leaf_chars=None, leaf_tokens=None, text_crc32=None):
        text, edits, count = text or "", edits or [], counter(path)
        stored = leaf_chars is not None and leaf_tokens is not None and text_crc32 == _checksum(text)
        given = SegmentTree(leaf_chars or [0], leaf_tokens or [0]) if stored else None
        new, tree, before, again = follow(text, edits, count, tree=given)
        row = (doc_id, before, len(edits), tree.total, len(new), again, 0 if stored else len(text), hashlib.sha256(new.encode()).hexdigest(), *tree.grown(), _checksum(new))
        return (*row, new) if keep else row
    return work


def trees(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, text, leaf_chars, leaf_tokens, text_crc32): every whole text encoded once, with its tree's leaves."""
    schema = f"doc_id long, text string, {_TREE}"
    return docs.select("doc_id", "text").mapInArrow(_batches(schema, _tree_row(ranks_path(ranks))), schema)


def count_edited(docs: DataFrame, ranks: str | None = None, keep: bool = False) -> DataFrame:
    """Tokens of every whole text of (doc_id, text, edits) before and after its edits, with the leaves of the tree after them.

    With the columns of `trees` only the regions that the edits touch are encoded; `keep` adds the edited text."""
    stored = [c for c in ("leaf_chars", "leaf_tokens", "text_crc32") if c in docs.columns]
    schema = f"{_OUT}, text string" if keep else _OUT
    rows = docs.select("doc_id", "text", F.col("edits").cast(EDITS).alias("edits"), *(stored if len(stored) == 3 else []))
    return rows.mapInArrow(_batches(schema, _edited_row(ranks_path(ranks), keep)), schema)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the edits of (doc_id, seq, at, remove, insert) as an array column; documents without edits stay."""
    each = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "remove", "insert"))).alias("edits"))
    return docs.select(*_kept(docs)).join(each, "doc_id", "left")


def _kept(docs: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "text", "leaf_chars", "leaf_tokens", "text_crc32") if c in docs.columns]


def revisions(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edits): three edits of every text made from itself: a cut, a quotation of its beginning, a passage in capitals."""
    n = F.length(F.coalesce("text", F.lit("")))

    def edit(seq, at, remove, insert):
        return F.struct(F.lit(seq).cast("int").alias("seq"), at.cast("long").alias("at"), F.lit(remove).cast("long").alias("remove"), insert.alias("insert"))
    capitals = F.upper(F.substring("text", (n * 3 / 4).cast("int"), F.lit(16)))
    return docs.select(*_kept(docs), F.array(
        edit(0, n / 4, 24, F.lit("")), edit(1, n / 2, 0, F.substring("text", 1, 40)), edit(2, n * 3 / 4, 16, capitals)).alias("edits"))
