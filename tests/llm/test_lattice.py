import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from limnos.llm import lattice as L

from .helpers import TEXTS, documents, rows


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def brute(word, prob, byte):
    """Sum over all segmentations, by recursion on the bytes."""
    data = (L.MARK + word).encode()
    memo = {len(data): 1.0}

    def after(i):
        if i not in memo:
            total = byte[data[i]] * after(i + 1)
            for j in range(i + 1, len(data) + 1):
                if data[i:j] in prob:
                    total += prob[data[i:j]] * after(j)
            memo[i] = total
        return memo[i]
    return after(0)


def test_equals_brute_force(spark):
    texts = [t for t in TEXTS if t is None or len(t) < 500] + ["a cat", "the moon é"] * 4
    m = L._model(L.vocabulary_path())
    held = [zlib.crc32(str(3 * k).encode()) % 7 == 2 for k in range(len(texts))]
    count, pieces = Counter(), np.ones(m.get_piece_size())
    for t, h in zip(texts, held):
        if not h:
            count.update(words(t) + [None])
            for w in words(t):
                np.add.at(pieces, m.encode(w), 1)
            pieces[m.eos_id()] += 1
    p = pieces / pieces.sum()
    prob = {m.id_to_piece(i).encode(): p[i] for i in range(len(p)) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
    byte = {int(m.id_to_piece(i)[3:5], 16): p[i] for i in range(len(p)) if m.is_byte(i)}
    total, distinct = sum(count.values()), len(count)
    got = rows(L.score_texts(documents(spark, texts)))
    for k, t in enumerate(texts):
        r, tokens = got[3 * k], words(t) + [None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(tokens), sum(count[w] > 0 for w in tokens), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in tokens), abs=1e-9)
        assert r["score"] == pytest.approx(sum(math.log10(brute(w, prob, byte)) for w in tokens[:-1]) + math.log10(p[m.eos_id()]), abs=1e-6)


def test_long_word_by_window():
    logp = np.log(np.full(32_000, 1 / 32_000))
    lattice = L.Lattice(L.vocabulary_path(), logp)
    word = b"thequickbrownfox" * 5
    assert lattice.log_probability([word], long=10)[0] == pytest.approx(lattice.log_probability([word], long=500)[0])


def test_odd_rows(spark):
    df = documents(spark)
    got = rows(L.score_texts(df))
    assert len(got) == len(TEXTS) and all(math.isfinite(r["score"]) for r in got.values())
    assert got[3]["n_tokens"] == 1 and got[12]["score"] == got[15]["score"]
    assert L.score_texts(df.limit(0)).count() == 0
    only = spark.createDataFrame([(d, "a b") for d in range(60) if zlib.crc32(str(d).encode()) % 7 == 2], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens) for r in L.score_texts(only).collect()} == {(0, 0)}
