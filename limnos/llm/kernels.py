"""Vectorised text kernels run inside Arrow map tasks.

A task sees its documents as one UTF-8 buffer with offsets; words are found,
hashed and numbered with numpy over the whole buffer, never one Python object a
word.  Chunks hold at most ``limit`` bytes of text (or one longer document), so
the memory of a task does not depend on its input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BYTE2 = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict = {}
CHUNK_BYTES = 4 << 20
#: Chunk of operators that hold more than text and hashes; its power tables are smaller, too.
SMALL_BYTES = 1 << 20

#: ASCII white space of the word definitions: space and U+0009 to U+000D.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; a null is empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """(rows, offsets, bytes) of at most `limit` bytes of text each, or of one longer row."""
    for batch in batches:
        offsets, data = utf8(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]]
            i = j


def word_spans(data, offsets, is_word, breaks=None):
    """Starts and ends of the maximal runs of word bytes inside each document.

    is_word: a flag for each byte value; breaks: positions where a new word begins as well."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if breaks is not None:
        cut[breaks] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words_per_doc(starts, offsets) -> np.ndarray:
    return np.diff(np.searchsorted(starts, offsets))


def _powers(n: int):
    have = _POWERS.get("n", 0)
    if n > have:
        size = max(n, (CHUNK_BYTES if n > SMALL_BYTES + 1 else SMALL_BYTES) + 1)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 4 * CHUNK_BYTES:
            return up, down
        _POWERS.update(n=size, up=up, down=down)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply rounds)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def span_hashes(data, starts, ends, second: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over random byte values, from prefix sums."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((_BYTE2 if second else _BYTE)[data] * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def number_words(data, starts, ends):
    """(hashes, first, inverse) of the distinct spans; two independent hashes must agree on every span."""
    h = span_hashes(data, starts, ends)
    order = np.argsort(h)
    ranked = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    distinct, first = ranked[new], order[new]
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(new) - 1
    again = span_hashes(data, starts, ends, second=True)
    if not np.array_equal(again[first][inverse], again):
        raise ValueError("two words of a chunk share a 64-bit hash")
    return distinct, first, inverse


def slices(data, starts, ends) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def ragged_take(flat, at, size, pick):
    """Concatenated runs flat[at[k]:at[k]+size[k]] for k in pick, and the length of each."""
    n = size[pick]
    out = np.repeat(at[pick] - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else np.zeros(0, np.int64), n)
    return flat[out + np.arange(len(out))], n


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def binaries(offsets, flat) -> pa.Array:
    """Binary column of runs of a byte buffer (64-bit offsets)."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
