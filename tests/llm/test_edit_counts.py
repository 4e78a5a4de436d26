import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from limnos.llm import edit_counts as C

from .helpers import TEXTS, documents, rows

ALPHABET = "ab '\n\t  s1!é tréll"


@given(st.text(alphabet=ALPHABET, max_size=120), st.lists(st.tuples(st.integers(-1, 130), st.integers(0, 30), st.text(alphabet=ALPHABET, max_size=12)), max_size=6), st.integers(1, 5))
@settings(max_examples=400, deadline=None)
def test_equals_encoding_anew(text, edits, leaf):
    count = C.counter(C.ranks_path())
    tree = C.build(text, count, leaf)
    assert tree.total == len(count.encoding.encode_ordinary(text))
    for at, remove, insert in edits:
        begin = min(max(at, 0), len(text))
        want = text[:begin] + insert + text[begin + remove:]
        text, _ = C.apply_edit(text, tree, at, remove, insert, count)
        assert text == want and tree.chars[1] == len(text)
        assert tree.total == len(count.encoding.encode_ordinary(text))


def test_only_touched_regions(spark):
    count = C.counter(C.ranks_path())
    text = " ".join(f"word{k}" for k in range(20_000))
    new, tree, _, again = C.follow(text, [dict(seq=0, at=60_000, remove=5, insert="x y")], count)
    assert tree.total == len(count.encoding.encode_ordinary(new)) and again < 2_000


def test_query_rows(spark):
    count = C.counter(C.ranks_path())
    df = documents(spark)
    got = rows(C.count_edited(C.revisions(df)))
    plain = rows(C.count_edited(df.select("doc_id", "text").withColumn("edits", C.F.lit(None))))
    assert len(got) == len(TEXTS) and C.count_edited(C.revisions(df.limit(0))).count() == 0
    for k, text in enumerate(TEXTS):
        t = text or ""
        assert got[3 * k]["n_tokens"] == plain[3 * k]["n_tokens_after"] == len(count.encoding.encode_ordinary(t))
        edits = C.revisions(df).where(f"doc_id = {3 * k}").first().edits if len(t) < 100 else None
        if edits:
            for e in edits:
                at = min(e.at, len(t))
                t = t[:at] + (e.insert or "") + t[at + e.remove:]
            assert got[3 * k]["after_sha256"] == hashlib.sha256(t.encode()).hexdigest()
            assert got[3 * k]["n_tokens_after"] == len(count.encoding.encode_ordinary(t)) and sum(got[3 * k]["leaf_chars"]) == len(t)


def test_edit_table(spark):
    edits = spark.createDataFrame([(0, 1, 4, 3, None), (0, 0, 0, 0, "Now "), (6, 0, None, None, "abc"), (999, 0, 0, 0, "z")], "doc_id long, seq int, at long, remove long, insert string")
    got = rows(C.count_edited(C.with_edits(documents(spark), edits)))
    assert got[0]["after_sha256"] == hashlib.sha256(("Now " + TEXTS[0][3:]).encode()).hexdigest()
    assert got[6]["n_tokens_after"] == 1 and got[6]["n_chars_after"] == 3 and got[9]["n_edits"] == 0 and len(got) == len(TEXTS)


def test_edits_of_a_stored_tree(spark):
    count = C.counter(C.ranks_path())
    df = documents(spark)
    stored = C.trees(df)
    first = rows(C.count_edited(C.revisions(stored), keep=True))
    anew = rows(C.count_edited(C.revisions(df), keep=True))
    for k, r in first.items():
        assert r["built_chars"] == 0 and anew[k]["built_chars"] == len(TEXTS[k // 3] or "")
        assert {c: v for c, v in r.items() if c != "built_chars"} == {c: v for c, v in anew[k].items() if c != "built_chars"}
    # the table that comes back takes the next edits
    after = C.count_edited(C.revisions(stored), keep=True).select("doc_id", "text", "leaf_chars", "leaf_tokens", "text_crc32")
    for k, r in rows(C.count_edited(C.revisions(after), keep=True)).items():
        assert r["built_chars"] == 0 and r["n_tokens"] == first[k]["n_tokens_after"]
        assert r["n_tokens_after"] == len(count.encoding.encode_ordinary(r["text"])) and sum(r["leaf_chars"]) == len(r["text"])
    assert C.trees(df.limit(0)).count() == 0


def test_tree_of_another_text_is_built_anew(spark):
    stored = C.trees(documents(spark)).withColumn("text", C.F.when(C.F.col("doc_id") == 0, "another text").otherwise(C.F.col("text")))
    stored = stored.withColumn("leaf_tokens", C.F.when(C.F.col("doc_id") != 12, C.F.col("leaf_tokens"))).withColumn("edits", C.F.lit(None))
    got = rows(C.count_edited(stored))
    assert (got[0]["built_chars"], got[0]["n_tokens"]) == (12, 2) and got[12]["built_chars"] == len(TEXTS[4])
    assert all(r["built_chars"] == 0 for k, r in got.items() if k not in (0, 12))


@given(st.text(alphabet=ALPHABET, max_size=80), st.lists(st.tuples(st.integers(-1, 130), st.integers(0, 30), st.text(alphabet=ALPHABET, max_size=60)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_replacements_are_cut_into_leaves(text, edits):
    count = C.counter(C.ranks_path())
    tree = C.build(text, count, 2)
    for at, remove, insert in edits:
        text, _ = C.apply_edit(text, tree, at, remove, insert, count, 2)
        chars, tokens = tree.grown()
        assert tree.total == sum(tokens) == len(count.encoding.encode_ordinary(text)) and sum(chars) == len(text)
        tree = C.SegmentTree(chars or [0], tokens or [0])  # as it is stored and read


def test_a_long_insertion_leaves_short_leaves():
    count = C.counter(C.ranks_path())
    words = " ".join(f"word{k}" for k in range(5_000))
    new, tree, _, again = C.follow("a b c", [dict(seq=0, at=2, remove=0, insert=words + " ")], count)
    assert max(tree.grown()[0]) < 16 * C.LEAF and again <= len(new)
    newest, tree, _, again = C.follow(new, [dict(seq=0, at=20_000, remove=3, insert="x")], count, tree=tree)
    assert again < 2_000 and tree.total == len(count.encoding.encode_ordinary(newest))
