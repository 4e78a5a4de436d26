"""The training-data pipeline: five stages over `documents`, each written as Parquet and read by the next.

1. quality classifier: documents that it rejects go;
2. n-gram Jaccard join: of each component the document with the smallest doc_id stays;
3. benchmark decontamination: documents that hold a window of a benchmark item go;
4. secret scan: live-looking credentials are redacted in the text;
5. BPE: the texts become token ids.

Every stage works on all rows that the stage before kept.  Rows with null or
empty text pass through like others; rows that repeat a doc_id are one document
from stage 2 on; rows without doc_id are never near duplicates; an empty table
stays empty; columns beyond those of `documents` pass through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from limnos.llm import bpe, jaccard_join, quality, secret_scan, suffix_match
from limnos.llm.store import Stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_match.clean(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, keep=("ids",))


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scan", redact_secrets),
    ("BPE encoding", encode),
]

#: Stages 1, 2 and 5 train a model, follow links to their ends and run a tokenizer; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: doc_id, n_tokens, ids and digests of the documents that are left."""
    stage = Stage(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for k, (_, work) in enumerate(STAGES):
        docs = stage.keep(work(spark, docs, sf_dir), f"stage-{k + 1}")
    return docs
