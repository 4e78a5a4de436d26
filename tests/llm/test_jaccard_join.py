import random
import re

import pytest

from limnos.llm import jaccard_join as J

from .helpers import TEXTS, documents, rows


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    """(set size, component) by comparing all pairs."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), 3 * find(k)) for k, s in enumerate(sets)]


def corpus(seed):
    """Unrelated texts, shared passages, copies, near copies at all distances, and chains of edits."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(60)]
    out = [" ".join(passage + [word() for _ in range(r.randrange(60))]) for _ in range(25)] + list(TEXTS)
    for _ in range(6):
        base = [word() for _ in range(r.randrange(20, 150))]
        for _ in range(14):
            copy = list(base)
            for _ in range(r.randrange(0, 9)):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
        for _ in range(6):  # a chain
            base[r.randrange(len(base))] = word()
            out.append(" ".join(base).upper())
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed,rounds", [(1, 2), (2, 1), (3, 3)])
def test_equals_all_pairs(spark, seed, rounds):
    texts = corpus(seed)
    got = rows(J.jaccard_components(documents(spark, texts), rounds=rounds))
    assert [(got[3 * k]["n_shingles"], got[3 * k]["component_id"]) for k in range(len(texts))] == brute(texts)


def test_odd_tables(spark):
    assert J.jaccard_components(documents(spark).limit(0)).count() == 0
    df = spark.createDataFrame([(7, "a b c"), (None, "a b c"), (7, "a b c"), (None, "z"), (3, None), (3, "a b c")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.jaccard_components(df).collect())
    assert got == [("3", 0, "3"), ("3", 1, "3"), ("7", 1, "3"), ("7", 1, "3"), ("None", 1, "3"), ("None", 1, "None")]


def test_prefix_size_is_exact():
    for n in range(1, 400):
        least = -(-80 * n // 100)  # the fewest shingles that a linked set shares
        assert J.prefix_size(n) + least == n + 1


@pytest.mark.parametrize("rounds,tile", [(2, J.TILE), (1, 16), (2, 48)])
def test_every_link_between_different_texts(spark, rounds, tile):
    r, texts = random.Random(9), corpus(4)
    base = [f"b{k}" for k in range(150)]
    for _ in range(70):  # a large group of near copies, most of them linked to each other
        copy = list(base)
        for _ in range(r.randrange(1, 5)):
            copy[r.randrange(150)] = f"e{r.randrange(9)}"
        texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    first = {}
    for k, x in enumerate(sets):
        first.setdefault(frozenset(x), 3 * k)
    want = {(a, b): len(x & y) for x, a in first.items() for y, b in first.items() if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)}
    found = J.jaccard_links(documents(spark, texts), rounds=rounds, tile=tile).collect()
    assert len(found) == len(want) > 500 and {(l.a, l.b): l.inter for l in found} == want
    assert all((l.an, l.bn) == (len(sets[l.a // 3]), len(sets[l.b // 3])) for l in found)
    if tile == J.TILE:
        got = rows(J.jaccard_components(documents(spark, texts)))
        for k, x in enumerate(sets):
            assert got[3 * k]["n_links"] == sum(first[frozenset(x)] in pair for pair in want)
        less = rows(J.jaccard_components(documents(spark, texts), every=False))
        assert all(less[k]["component_id"] == got[k]["component_id"] and "n_links" not in less[k] for k in got)


def test_pieces_of_a_long_text():
    """A text is hashed in pieces of any size with the same result, in memory that is a small multiple of the text."""
    import tracemalloc

    import numpy as np
    text = ("Some words, é 日本語  and\tmore\n" * 9 + "x" * 300 + " end ").encode()
    data, offsets = np.frombuffer(text, np.uint8), np.asarray([0, len(text)])
    whole, count = J.word_hashes(offsets, data)
    for size in (1, 7, 64, 1000):
        h, n = J.word_hashes(offsets, data, size)
        assert np.array_equal(h, whole) and n.tolist() == count.tolist() == [len(text.split())]
    data = np.frombuffer(b" ".join(b"w%d" % k for k in range(2_900_000)), np.uint8)
    tracemalloc.start()
    sets = J.shingle_sets(np.asarray([0, len(data)]), data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) > 20e6 and len(sets[0]) > 2_000_000 and peak < 10 * len(data)
