import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from limnos.llm import suffix_match as S

from .helpers import TEXTS, documents, rows


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item_id, t in items:
        i = words(t)
        size = min(10, len(i))
        for k in range(len(i) - size + 1 if i else 0):
            for at in range(len(w) - size + 1):
                if w[at:at + size] == i[k:k + size]:
                    hit.update(range(at, at + size))
                    found.add(item_id)
    named = sorted(str(i) for i in found if i is not None)  # items without id are searched, and count as one
    return len(w), len(hit), len(found), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 12))
@settings(max_examples=80, deadline=None)
def test_suffix_order(text, depth):
    order = S.suffix_array(np.asarray(text), depth)
    heads = [text[k:k + depth] for k in order]
    assert heads == sorted(heads) and sorted(order.tolist()) == list(range(len(text)))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda n: f"v{r.randrange(n)}é"
    items = [(k * 7, ". ".join(word(40) for _ in range(r.choice([1, 3, 9, 10, 11, 25])))) for k in range(14)]
    items += [(500, "the the the the"), (501, None), (502, "?!"), (None, "one two"), (503, TEXTS[0]), (504, items[3][1])]
    texts = list(TEXTS)
    for _ in range(60):
        t = [word(60) for _ in range(r.randrange(40))]
        for _ in range(2):
            part = words(r.choice(items)[1])
            a = r.randrange(len(part) + 1)
            t[(x := r.randrange(len(t) + 1)):x] = part[a:a + r.choice([5, 10, 30])]
        texts.append(" ".join(t).upper().replace(" ", ", "))
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts.append(items[3][1] + " and one two")
    want = [brute(t, items) for t in texts]
    assert want[-1][2] >= 3  # two items of one text, and one without id
    for most in (S.PART_WORDS, 40):  # one part; several
        got, kept = rows(S.affected(documents(spark, texts), bench, most=most)), rows(S.clean(documents(spark, texts), bench, most=most))
        for k, w in enumerate(want):
            r_ = got[3 * k]
            assert (r_["n_words"], r_["n_hit"], r_["n_items"], r_["items_sha256"], r_["contaminated"]) == w
            assert (3 * k in kept) != w[-1]


def test_longest_matches_and_empty(spark):
    item = " ".join(f"q{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "x y " + " ".join(item.split()[3:20]) + " z")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [tuple(s) for s in S.search(docs, bench).first().spans] == [(9, 2, 3, 17)]
    assert not S.affected(docs, bench.limit(0)).first().contaminated
    assert S.affected(docs.limit(0), bench).count() == 0
    assert S.affected(docs.limit(0), bench, most=12).count() == 0
    assert not S.affected(docs, bench.limit(0), most=12).first().contaminated


def test_places_within_items_and_pieces(spark):
    word = lambda a, b: " ".join(f"q{k}" for k in range(a, b))
    bench = spark.createDataFrame([(7, "a b c"), (9, word(0, 100)), (None, word(200, 240))], "item_id long, text string").coalesce(1)
    docs = spark.createDataFrame([(1, "x " + word(5, 90)), (2, word(205, 230)), (3, word(95, 100)), (4, None)], "doc_id long, text string")

    def found(most):
        return {r.doc_id: (r.n_hit, [tuple(s) for s in r.spans], [tuple(c) for c in r.covered]) for r in S.search(docs, bench, most=most).collect()}
    want = {1: (85, [(9, 1, 5, 85)], [(1, 86)]), 2: (25, [(None, 0, 5, 25)], [(0, 25)]), 3: (0, [], []), 4: (0, [], [])}
    assert found(S.PART_WORDS) == want
    pieces = found(20)  # 11 windows a piece: the same words, spans cut where a part ends
    assert {d: v[0] for d, v in pieces.items()} == {d: v[0] for d, v in want.items()}
    assert [s[2] - s[1] for s in pieces[1][1]] == [4] * len(pieces[1][1]) and min(s[3] for s in pieces[1][1]) >= 10
    sizes = [len(b.text) for b in S.parts(bench, most=20)]
    assert max(sizes) <= 20 and sum(len(b.at) for b in S.parts(bench, most=20)) == 1 + 91 + 31
