import random

import numpy as np

from limnos.llm import quality as Q

from .helpers import TEXTS, documents, rows


def corpus(spark, n=600):
    r = random.Random(3)
    word = lambda: r.choice(["stone", "river", "light", "under", "green", "walks", "paper", "quiet"]) + r.choice(["s", "ed", "", "ing"])
    docs = []
    for k in range(n):
        w = [word() for _ in range(r.randrange(8, 60))]
        good = k % 4 != 0
        docs.append((k, " ".join(w) + "." if good else " ".join(x.upper() + "!!" if k % 8 else x + "###" for x in w), int(good)))
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got, want = rows(Q.classify(docs, labels)), rows(labels)
    held = [k for k in got if got[k]["held_out"]]
    assert len(held) > 100 and np.mean([got[k]["predicted"] == want[k]["quality"] for k in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_of_held_out_rows_have_no_effect(spark):
    docs, labels = corpus(spark)
    other = labels.withColumn("quality", Q.F.when(Q.held_out(Q.F.col("doc_id")), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    a, b = rows(Q.classify(docs, labels)), rows(Q.classify(docs, other))
    assert all(abs(a[k]["score"] - b[k]["score"]) < 1e-12 for k in a)


def test_context_sums_by_hand():
    rows_, sizes = np.asarray([5, 9, 5, 7]), np.asarray([3, 1])
    index, got = Q.index_vectors(), Q.context_sums(rows_, sizes)
    assert np.allclose(got[5], 2 * index[9] + 2 * index[5]) and np.allclose(got[9], 2 * index[5]) and not got[7].any()


def test_odd_rows(spark):
    docs, labels = corpus(spark)
    got = rows(Q.score(documents(spark), Q.fit(docs, labels)))
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got.values()) and abs(got[3]["score"] - got[9]["score"]) < 1e-9
    assert Q.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in Q.classify(docs.limit(3), labels.limit(0)).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1), (5, None), (9, 1), (9, 1)], "doc_id long, quality int")
    assert {r.score for r in Q.classify(docs.limit(30), odd).collect()} == {1.0}


def test_word_vectors_come_from_all_texts(spark):
    docs, labels = corpus(spark, 80)
    more = spark.createDataFrame([(1000, "unlabelled zebra crossing"), (1001, None), (None, "zebra crossing")], "doc_id long, text string")
    got = Q.fit(docs.union(more), labels, sample=10)[0].value
    texts = [r.text or "" for r in docs.union(more).collect()]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(b) for b in data])
    want = Q.word_vectors(Q.context_sums(*Q.word_rows(offsets, np.frombuffer(b"".join(data), np.uint8))))
    assert np.allclose(got, want)


def test_repeated_rows_in_any_order(spark):
    r = random.Random(4)
    docs = [(k, " ".join(r.choice(["good", "fine", "well"] if k % 2 else ["spam", "junk", "bad"]) for _ in range(12))) for k in range(120)]
    docs += [(k, "other text " * 3) for k in range(0, 120, 5)] + [(k, None) for k in range(0, 120, 7)]
    labels = [(k, k % 2) for k in range(120)] + [(k, 1 - k % 2) for k in range(0, 120, 3)]

    def tables(step):
        return (spark.createDataFrame(docs[::step], "doc_id long, text string").repartition(3), spark.createDataFrame(labels[::step], "doc_id long, quality int").repartition(5))
    chosen = [sorted(map(tuple, Q.training_rows(*tables(step)).select("doc_id", "text", "quality").collect())) for step in (1, -1)]
    assert chosen[0] == chosen[1] and len({k for k, *_ in chosen[0]}) == len(chosen[0])
    by_id = {k: (t, q) for k, t, q in chosen[0]}
    for k, (t, q) in by_id.items():
        assert q == min(b for a, b in labels if a == k) and t == min(b for a, b in docs if a == k and b is not None)
