import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from limnos.llm import simhash as S
from limnos.llm.store import Stage

from .helpers import LONG, TEXTS, documents, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    """Fingerprint by counting every bit of every shingle."""
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """Root of each fingerprint by comparing all pairs."""
    fps, root = sorted(fps), {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    a = np.asarray(fps, np.uint64)
    for k, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1:] ^ a[k]) <= 2).tolist():
            root[find(fps[k + 1 + j])] = find(f)
    return {f: find(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@given(st.text(alphabet="aB \t\né İ", max_size=40), st.integers(1, 30))
@settings(max_examples=80, deadline=None)
def test_pieces_do_not_matter(text, piece):
    data = text.encode()
    whole = np.concatenate([np.zeros(0, np.uint64), *S.shingle_hashes(data)])
    assert np.array_equal(np.concatenate([np.zeros(0, np.uint64), *S.shingle_hashes(data, piece=piece)]), whole)
    assert S.fingerprint(data) == plain(text)


def test_jvm_hash_is_the_same(spark):
    text = "three plain words"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == signed(xxhash.xxh64_intdigest(text.encode(), 42))


def texts():
    r, out = random.Random(3), list(TEXTS)
    for k in range(25):
        w = [f"w{r.randrange(400)}" for _ in range(150)]
        out.append(" ".join(w))
        for _ in range(4):  # a word less or another one: fingerprints a few bits apart
            v = list(w)
            v[r.randrange(150)] = f"v{r.randrange(9)}"
            out.append(" ".join(v))
        out.append(" ".join(w).upper() if k % 2 else "  ".join(w))
    return out


def test_equals_all_pairs(spark):
    data = texts()
    got = rows(S.near_duplicates(documents(spark, data)))
    fps = {3 * k: plain(t) for k, t in enumerate(data)}
    root, least = components(set(fps.values())), {}
    for d, f in sorted(fps.items()):
        least.setdefault(root[f], d)
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {d: r["component_id"] for d, r in got.items()} == {d: least[root[f]] for d, f in fps.items()}
    assert len(set(least)) < len(set(fps.values()))  # some different fingerprints are linked


def test_long_lists(spark):
    """Fingerprints in dense groups: lists that pass LONG are split, none of their links is lost."""
    r, fps = random.Random(4), set()
    for _ in range(3):
        base = r.getrandbits(64)
        fps |= {base ^ (v << 8 * r.choice((0, 6))) for v in r.sample(range(1 << 16), 900)}  # share bytes 2 to 5
    for _ in range(300):
        base = r.getrandbits(64)
        fps |= {base, base ^ 1 << r.randrange(64) ^ 1 << r.randrange(64), base ^ 7 << r.randrange(60)}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # lists go over several batches
    try:
        found = {(r.src, r.dst) for r in S.edges(df, Stage(spark, "test")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) <= 15 * len(fps)
    parent = {signed(f): signed(f) for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in found:
        parent[find(a)] = find(b)
    want = components(fps)
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(find(signed(f)))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_lists_hold_every_link():
    """Two flipped bits in any two bytes leave four of the first six positions."""
    for a in range(8):
        for b in range(8):
            same = set(range(8)) - {a, b}
            assert any(set(s) <= same for s in S.LISTS)


def test_repeats_and_rows_without_id(spark):
    df = spark.createDataFrame([(5, "a b c d"), (5, "x y z u"), (None, "a b c d"), (None, "only here now"), (9, None), (2, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(df.withColumn("fp", F.lit(1))).collect()), key=str)
    f = {t: f"{plain(t):016x}" for t in ("a b c d", "x y z u", "only here now", "")}
    assert got == sorted([(5, f["a b c d"], 5), (5, f["x y z u"], 5), (None, f["a b c d"], 5), (None, f["only here now"], None), (9, f[""], 2), (2, f[""], 2)], key=str)


@pytest.mark.parametrize("test", ["false", "text is null"])
def test_empty(spark, test):
    got = S.near_duplicates(documents(spark).where(test)).collect()
    assert [r.fingerprint for r in got] == ["0" * 16] * len(got) and len(got) == (test != "false")


def test_long_text_takes_little_memory():
    import tracemalloc
    text = (LONG * 8).encode()
    tracemalloc.start()
    S.fingerprint(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(text) + 60e6  # a lower-cased copy and one piece's words and shingles
