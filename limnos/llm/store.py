"""Hand-over tables in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


class Stage:
    """A folder of one run; `keep` writes a table there and reads it back, which cuts its lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = posixpath.join(ensure_checkpoint_dir(spark).rstrip("/"), "limnos-llm", f"{name}-{uuid.uuid4().hex}")

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = posixpath.join(self.path, name)
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
