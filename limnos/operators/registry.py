"""Stored models: a trained pipeline with its features, their types and where it came from.

A model is saved once under its name, its data's fingerprint and its code's key, as
a published version (`sources/versions.py`), so a reader never loads half of one and
scoring never trains.  What scoring needs of the input is part of the artefact:
before a row is scored the input's columns are checked against the stored types.
"""

from __future__ import annotations

import json
import posixpath
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import VersionedTable
from . import ml as ML

_META = "name string, fingerprint string, estimator string, features array<struct<feature:string,kind:string>>"


def _kind(dtype: str) -> str:
    return "number" if dtype.startswith("decimal") or dtype in ("double", "float", "int", "bigint", "smallint", "tinyint") else dtype


@dataclass
class StoredModel:
    name: str
    fingerprint: str
    estimator: str
    kinds: dict[str, str]
    pipeline: PipelineModel

    @property
    def features(self) -> list[str]:
        return list(self.kinds)

    def problems(self, df: DataFrame) -> list[str]:
        """What keeps the model from reading `df`: features without a column, or of another kind than in training."""
        have = {c: _kind(t) for c, t in df.dtypes}
        return [f"{f}: no column" if f not in have else f"{f}: {have[f]} instead of {kind}" for f, kind in self.kinds.items() if have.get(f) != kind]

    def score(self, df: DataFrame) -> DataFrame:
        """`df` with prediction, score, ml_predicted_compliance_label, ml_prediction_status and ml_prediction_reason.

        A table that the model cannot read, and a row without any feature, is Failed: label Unknown, no prediction.
        Some missing values are filled as in training."""
        wrong = self.problems(df)
        if wrong:
            return _failed(df, F.lit("; ".join(wrong)))
        none = F.lit(True)
        for f in self.features:
            none = none & F.col(f).isNull()
        scored = ML.score(self.pipeline, df.withColumn("_none", none))
        empty = F.col("_none")
        return scored.select(
            *df.columns, F.when(~empty, F.col("prediction")).alias("prediction"), F.when(~empty, F.col("score")).alias("score"),
            F.when(empty, F.lit("Unknown")).otherwise(F.col("ml_predicted_compliance_label")).alias("ml_predicted_compliance_label"),
            F.when(empty, F.lit("Failed")).otherwise(F.lit("Success")).alias("ml_prediction_status"),
            F.when(empty, F.lit("no feature has a value")).alias("ml_prediction_reason"))


def _failed(df: DataFrame, reason: Column) -> DataFrame:
    none = F.lit(None).cast("double")
    return df.select("*", none.alias("prediction"), none.alias("score"), F.lit("Unknown").alias("ml_predicted_compliance_label"),
                     F.lit("Failed").alias("ml_prediction_status"), reason.alias("ml_prediction_reason"))


class ModelStore:
    """Models under one folder, a folder for each name and fingerprint."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str, fingerprint: str) -> VersionedTable:
        return VersionedTable(self.spark, posixpath.join(self.path, f"{name}-{fingerprint}"))

    def save(self, name: str, fingerprint: str, pipeline: PipelineModel, features, train: DataFrame, first_only: bool = True) -> None:
        types = dict(train.dtypes)
        table = self._table(name, fingerprint)

        def write(folder):
            pipeline.write().save(posixpath.join(folder, "pipeline"))
            about = [(name, fingerprint, type(pipeline.stages[-1]).__name__, [(f, _kind(types[f])) for f in features])]
            self.spark.createDataFrame(about, _META).coalesce(1).write.json(posixpath.join(folder, "about"))
        table.publish(table.stage(write), first_only=first_only)

    def load(self, name: str, fingerprint: str) -> StoredModel | None:
        """The newest model of that name and data, None if there is none."""
        folder = self._table(name, fingerprint).current()
        if folder is None:
            return None
        r = self.spark.read.schema(_META).json(posixpath.join(folder, "about")).first()
        return StoredModel(r.name, r.fingerprint, r.estimator, {f.feature: f.kind for f in r.features}, PipelineModel.load(posixpath.join(folder, "pipeline")))

    def trained(self, name: str, fingerprint: str, features, train, estimator: str = "LogisticRegression") -> StoredModel:
        """The stored model, trained on train() where none is stored yet."""
        found = self.load(name, fingerprint)
        if found is None:
            rows = train()
            self.save(name, fingerprint, ML.fit(rows, features, estimator), features, rows)
            found = self.load(name, fingerprint)
        return found

    def registry(self) -> DataFrame:
        """(name, fingerprint, estimator, features) of every stored model."""
        from ..sources.versions import _names
        folders = [VersionedTable(self.spark, posixpath.join(self.path, n)).current() for n in _names(self.spark, self.path)]
        paths = [posixpath.join(f, "about") for f in folders if f]
        return self.spark.read.schema(_META).json(paths) if paths else self.spark.createDataFrame([], _META)
