"""Encoding of chunks of text through a table of their distinct words.

The word tokenizers of the vocabulary files split text at white space and
between letters and punctuation before merging, so a word's ids do not depend on
its neighbours: each distinct word of a chunk is encoded once by the tokenizers
library and its ids are gathered for every occurrence.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .kernels import LOWER, SPACES, U64, number_words, ragged_take, slices, word_spans, words_per_doc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

DEFAULT_TOKENIZER = "word_bpe_49k.json"
_LOADED: dict = {}
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Letters whose lower case is one letter, in composed form.
_LATIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: ASCII punctuation at which a word may be cut; not the apostrophe (contractions) nor the bar (special tokens).
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'|"]] = True


def tokenizer_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path(DEFAULT_TOKENIZER)


def load(path: str):
    """The tokenizer of a file, once a worker process, without truncation and padding."""
    if path not in _LOADED:
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


def separable(path: str) -> bool:
    """True when the file's rules make words independent: white space dropped, NFC and lower case only."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    steps = {n["type"] for n in (j["normalizer"] or {}).get("normalizers", [j["normalizer"]] if j["normalizer"] else [])}
    split = [p for p in (j["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
    return (steps == {"NFC", "Replace", "Lowercase"} and len(split) == 1 and split[0]["invert"] and split[0]["behavior"] == "Removed"
            and all(not a["lstrip"] and not a["rstrip"] and not a["single_word"] and "<|" in a["content"] and "|>" in a["content"] for a in j["added_tokens"]))


def pieces(path: str) -> list[str]:
    if ("pieces", path) not in _LOADED:
        t = load(path)
        _LOADED["pieces", path] = [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]
    return _LOADED["pieces", path]


def split_words(data, offsets):
    """Word spans for the tokenizer, and the bytes to encode (ASCII letters lower-cased where that cannot
    change a composition).  A chunk with special-token marks is only cut at white space."""
    if b"<|" in data.tobytes():
        starts, ends = word_spans(data, offsets, ~SPACES)
        return data, starts, ends
    letter, punct = _LETTER[data], _PUNCT[data]
    breaks = np.flatnonzero((letter[1:] & punct[:-1]) | (punct[1:] & letter[:-1])) + 1
    ascii_next = np.ones(len(data), bool)
    ascii_next[:-1] = data[1:] < 128
    lowered = np.where(ascii_next, LOWER[data], data)
    starts, ends = word_spans(data, offsets, ~SPACES, breaks)
    return lowered, starts, ends


def encode_words(tokenizer, words: list[bytes], group: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per word) of words, each encoded by the library.

    Words of Latin letters only go in lines of `group` words: such a word is one pre-token, so it ends where an
    id with the vocabulary's word-end mark stands.  All others are encoded one by one."""
    ends = _word_end_flags(tokenizer)
    text = b"\n".join(words).decode("utf-8").split("\n") if words else []
    plain = np.fromiter(map(bool, map(_LATIN.fullmatch, text)), bool, len(text))
    sizes = np.zeros(len(text), np.int64)
    picked = np.flatnonzero(plain).tolist()
    lines = [" ".join([text[k] for k in picked[a:a + group]]) for a in range(0, len(picked), group)]
    flat = [np.asarray(e.ids, np.uint32) for a in range(0, len(lines), 64) for e in tokenizer.encode_batch_fast(lines[a:a + 64], add_special_tokens=False)]
    joined = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
    stops = np.flatnonzero(ends[joined]) + 1
    if len(stops) != len(picked) or (len(stops) and stops[-1] != len(joined)):
        raise ValueError("the vocabulary does not mark word ends")
    sizes[plain] = np.diff(np.concatenate(([0], stops)))
    rest = [text[k] for k in np.flatnonzero(~plain).tolist()]
    flat = [np.asarray(e.ids, np.uint32) for a in range(0, len(rest), 20_000) for e in tokenizer.encode_batch_fast(rest[a:a + 20_000], add_special_tokens=False)]
    sizes[~plain] = np.asarray([len(x) for x in flat], np.int64)
    at = np.zeros(len(text), np.int64)
    for mask in (plain, ~plain):
        at[mask] = np.cumsum(sizes[mask]) - sizes[mask]
    at[~plain] += len(joined)
    ids, _ = ragged_take(np.concatenate([joined, *flat]), at, sizes, np.arange(len(text)))
    return ids, sizes


def _word_end_flags(tokenizer) -> np.ndarray:
    key = ("ends", id(tokenizer))
    if key not in _LOADED:
        _LOADED[key] = np.asarray([(tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(tokenizer.get_vocab_size(with_added_tokens=True))])
    return _LOADED[key]


class WordTable:
    """Word to ids of a worker, kept over chunks; forgotten when it passes `limit` words."""

    def __init__(self, path: str, limit: int = 1_000_000):
        self.tokenizer, self.limit = load(path), limit
        self.clear()

    def clear(self) -> None:
        self.known, self.at, self.size, self.flat = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def rows(self, data, starts, ends):
        """(row in the table of each word); grows the table by the words that are new."""
        distinct, first, inverse = number_words(data, starts, ends)
        if len(self.known) > self.limit:
            self.clear()
        at = np.searchsorted(self.known, distinct)
        found = np.append(self.known, U64(0))[at] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~found | (at == len(self.known)))
        if len(new):
            ids, size = encode_words(self.tokenizer, slices(data, starts[first[new]], ends[first[new]]))
            begin = len(self.flat) + np.cumsum(size) - size
            into = at[new]
            self.known, self.at, self.size = np.insert(self.known, into, distinct[new]), np.insert(self.at, into, begin), np.insert(self.size, into, size)
            self.flat = np.concatenate([self.flat, ids])
        return np.searchsorted(self.known, distinct)[inverse]


def word_table(path: str) -> WordTable:
    """The worker process's table, kept from task to task."""
    if ("table", path) not in _LOADED:
        _LOADED["table", path] = WordTable(path)
    return _LOADED["table", path]


def encode_chunk(table: WordTable, offsets, data):
    """(ids of all documents of the chunk, ids per document)."""
    lowered, starts, ends = split_words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
    rows = table.rows(lowered, starts, ends)
    ids, per_word = ragged_take(table.flat, table.at, table.size, rows)
    total = np.concatenate(([0], np.cumsum(per_word)))
    docs = np.concatenate(([0], np.cumsum(words_per_doc(starts, offsets))))
    return ids, np.diff(total[docs])
