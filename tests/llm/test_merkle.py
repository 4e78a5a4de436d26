import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from limnos.llm import merkle as M

from .helpers import TEXTS, rows


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def climb(digests):
    """(root, siblings of each leaf level by level as (left, right))."""
    path, at = [[] for _ in digests], [[k] for k in range(len(digests))]
    while len(digests) > 1:
        runs = [list(range(k, min(k + 3, len(digests)))) for k in range(0, len(digests), 3)]
        for run in runs:
            for k in run:
                for x in at[k]:
                    path[x].append(("".join(digests[j] for j in run if j < k), "".join(digests[j] for j in run if j > k)))
        at = [[x for k in run for x in at[k]] for run in runs]
        digests = [H(*[digests[k] for k in run]) for run in runs]
    return digests[0], path


def brute(data):
    """Sorted result rows, by direct hashing."""
    groups = {}
    for r in data:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"], leaf(r, r["text"]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:1] + (x[1] or 0, x[2]))]) for s in order}
    root, above = climb([made[s][0] for s in order]) if order else (None, [])
    out = []
    for k, s in enumerate(order):
        for (_, doc_id, own, r), path in zip(sorted(groups[s], key=lambda x: x[:1] + (x[1] or 0, x[2])), made[s][1]):
            path = path + above[k]
            text = r["text"]
            if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf(r, text)
            for a, b in path:
                now = H(a, now, b)
            out.append((doc_id, own, made[s][0], root, H(*[a + b for a, b in path]), now, now == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def table(spark, data):
    return spark.createDataFrame([tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in data], SCHEMA).repartition(3)


def documents(count, sources):
    texts = [t for t in TEXTS if t is None or len(t) < 30_000]
    return [dict(doc_id=k * 7 % 1000 if k % 31 else None, source=sources[k * k % len(sources)], lang=None if k % 5 == 0 else "en", n_chars=None if k % 11 == 0 else k,
                 text=None if k % 13 == 0 else (texts[k % len(texts)] or "") + "\nline" * (k % 3)) for k in range(count)]


def check(spark, data):
    got = M.newline_audit(table(spark, data).withColumn("tree", F.lit(1)).withColumn("path", F.lit("x")).withColumn("digest", F.lit("y")))
    assert got.columns == COLUMNS
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == brute(data)
    return found


@pytest.mark.parametrize("count, sources", [(1, ["a"]), (4, ["a"]), (10, [None, "", "b"])])
def test_small_trees(spark, count, sources):
    check(spark, documents(count, sources))


def test_many_sources_nulls_repeats_and_a_hot_source(spark):
    data = documents(150, [None, "", "hot", "hot", "hot", "hot", "é", "z"] + [f"s{k}" for k in range(9)])
    data += data[40:44] + [data[7] | {"text": "other"}] + [dict(doc_id=2000, source="solo", lang=None, n_chars=None, text=None)]
    found = check(spark, data)
    assert {r[6] for r in found} == {True, False}  # some texts lost their line feeds, others had none


def test_longest_text(spark):
    text = TEXTS[10] + "\n"
    found = check(spark, [dict(doc_id=k, source="s", lang="en", n_chars=len(text), text=text) for k in range(9)])
    assert {r[6] for r in found} == {True, False}


def test_empty(spark):
    assert M.newline_audit(table(spark, documents(3, ["a"])).where("false")).collect() == []
    assert M.manifest(table(spark, documents(3, ["a"])).where("false")).root is None


def test_intervals_nest_and_cover(spark):
    data = documents(100, ["a", "a", "b", "c"])
    made = M.manifest(table(spark, data))
    nodes = [r.asDict() for r in made.nodes().collect()]
    for tree in {n["tree"] for n in nodes if n["part"] == "source"}:
        own = [n for n in nodes if n["part"] == "source" and n["tree"] == tree]
        n = max(x["hi"] for x in own)
        for level in {x["level"] for x in own}:
            spans = sorted((x["lo"], x["hi"]) for x in own if x["level"] == level)
            assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert rows(made.sources, "source")["a"]["n"] == sum(r["source"] == "a" for r in data)
