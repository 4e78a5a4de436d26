import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from limnos.llm import divergence as D

from .helpers import TEXTS

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = st.sets(st.text(alphabet="abcé日", min_size=1, max_size=6), max_size=60)


def built(words):
    b = D.Builder()
    for w in sorted(w.encode() for w in words):
        b.add(w)
    return b.finish()


def spans(words):
    raw = [w.encode() for w in words]
    ends = np.cumsum([0] + [len(w) for w in raw])
    return np.frombuffer(b"".join(raw), np.uint8), ends[:-1], ends[1:]


@given(WORDS, WORDS)
@settings(max_examples=150, deadline=None)
def test_ordinals_are_places_among_sorted_terms(words, others):
    t, order = built(words), sorted(w.encode() for w in words)
    asked = sorted(words | others)
    got = t.ordinals(*spans(asked))
    assert got.tolist() == [order.index(w.encode()) if w in words else -1 for w in asked]
    assert [t.term(k) for k in range(len(order))] == order
    same = D.Transducer.unpacked(t.packed())
    assert same.ordinals(*spans(asked)).tolist() == got.tolist()


@given(WORDS)
@settings(max_examples=100, deadline=None)
def test_states_are_the_fewest(words):
    """As many states as there are different sets of endings."""
    raw = {w.encode() for w in words}
    endings = {frozenset(w[len(p):] for w in raw if w.startswith(p)) for p in {w[:k] for w in raw for k in range(len(w) + 1)} | {b""}}
    assert len(built(words).final) == len(endings)


def test_terms_must_ascend():
    b = D.Builder()
    b.add(b"b")
    with pytest.raises(ValueError):
        b.add(b"b")


def brute(data, least, top=10):
    """Every group with every kept term, in Python integers."""
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for text, lang, source in data]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        df[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted((t for t, n in df[lang].items() if n >= least), key=str.encode)
        sources = sorted({s for g, s in counts if g == lang}, key=str.encode)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))

        def f(a, b):
            return (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:most])]
    return sorted(out)


SCHEMA = "text string, lang string, source string"


def data():
    r, out = random.Random(1), []
    vocabulary = [f"{a}{b}{c}" for a in "abé" for b in "xyzZ" for c in ("", "s", "日", "ed")]
    for k in range(200):
        words = [vocabulary[min(int(r.expovariate(0.1)), len(vocabulary) - 1)] for _ in range(r.randrange(0, 30))]
        out.append((" ".join(words) + "1" + r.choice(vocabulary), r.choice(["en", "de", None]), r.choice(["hot", "hot", "s1", "s2", None, "é"])))
    out += [(t, "en", "s1") for t in TEXTS] + [(TEXTS[-2], "xx", f"s{k}") for k in range(2)] + [(None, "en", "empty"), ("", "one", "only"), (None, None, None)]
    return out + out[:5]


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumn("term", F.lit("x")).withColumn("ord", F.lit(1)).withColumn("n", F.lit("y"))


def collected(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def test_equals_all_terms_of_all_groups(spark):
    rows = data()
    assert collected(D.audit(table(spark, rows))) == brute(rows, 10)


def test_shards_and_passes_do_not_matter(spark):
    """Seven terms a transducer, and a pass over the text for every one of them."""
    rows = data()
    assert collected(D.audit(table(spark, rows), least=2, shard_terms=7, limit=1)) == brute(rows, 2)


def test_empty(spark):
    rows = data()
    assert collected(D.audit(table(spark, rows).where("false"))) == []
    few = [(None, "en", "a"), ("", "en", "b")]
    assert collected(D.audit(table(spark, few))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_counts_beyond_64_bits(spark):
    n = 3 * 10**12
    row = spark.range(1).selectExpr(f"{n}L as n", f"{2 * n}L as total", "5L as v").select(D.share("n", "total", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (2 * n + 10)
