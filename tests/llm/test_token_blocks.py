import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from limnos.llm import token_blocks as B
from limnos.llm import tokens as T

from .helpers import TEXTS, documents


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([1, 8]))
@settings(max_examples=60, deadline=None)
def test_planes_round_trip(ids, bits):
    ids = np.asarray(ids, np.uint32)
    assert np.array_equal(B.join_planes(B.shuffle_planes(ids, bits), len(ids), bits), ids)


def expected(texts):
    t, out, at = T.load(T.tokenizer_path()), [], 0
    for text in texts:
        ids = np.asarray(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        at += len(ids)
    return out


@pytest.mark.parametrize("block,bits,shards", [(1 << 16, 8, 4), (7, 1, 3), (64, 8, 1)])
def test_store_equals_library(spark, tmp_path, block, bits, shards):
    texts = TEXTS if block > 7 else [t for t in TEXTS if t is None or len(t) < 1000]
    path = str(tmp_path / "store")
    B.write_token_blocks(documents(spark, texts), path, block=block, bits=bits, shards=shards)
    got = sorted(B.read_token_blocks(spark, path, keep_ids=True).collect(), key=lambda r: r.doc_id)
    assert [(r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got] == expected(texts)
    assert [r.doc_id for r in got] == [3 * k for k in range(len(texts))]


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "c"), (5, "d"), (1, None)], "doc_id long, text string")
    got = B.token_blocks(df).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 5, 5, 5]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(5)]


def test_empty_table(spark):
    assert B.token_blocks(documents(spark).limit(0)).count() == 0
