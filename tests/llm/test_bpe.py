import hashlib

import numpy as np

from limnos.llm import bpe
from limnos.llm import tokens as T

from .helpers import TEXTS, documents, rows


def test_equals_library(spark):
    t = T.load(T.tokenizer_path())
    got = rows(bpe.encode_decode(documents(spark), keep=("ids", "decoded")))
    assert len(got) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        ids, r = t.encode(text or "", add_special_tokens=False).ids, got[3 * k]
        decoded = t.decode(ids, skip_special_tokens=False)
        assert (r["ids"], r["decoded"], r["n_tokens"]) == (ids, decoded, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    assert bpe.encode_decode(df).count() == 4
    assert bpe.encode_decode(df.limit(0)).count() == 0
    assert bpe.encode_decode(df.where("text is null")).first().n_tokens == 0


def test_decode_join(spark):
    t = T.load(T.tokenizer_path())
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS if not x or len(x) < 200]
    got = rows(bpe.decode(spark.createDataFrame(list(enumerate(ids)), "key long, ids array<long>")), "key")
    assert [got[k]["decoded"] for k in range(len(ids))] == [t.decode(i, skip_special_tokens=False) for i in ids]
