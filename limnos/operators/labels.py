"""Labelling operators: compliance, risk, predictions (E1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R


def label_samples(df: DataFrame) -> DataFrame:
    """lbl_compliance + rsk_score + rsk_category: DM2 -> DM6.

    Two projections: the structured violations and the risk score are computed
    once per row and then rendered; an expression shared by several CASE
    branches would otherwise be evaluated once per branch.
    """
    staged = df.withColumn("_viol", R.violations()).withColumn("_risk", R.risk_score())
    cols = R.compliance_columns(viol=F.col("_viol")) + R.risk_columns(score=F.col("_risk"))
    return staged.select(*df.columns, *cols)


def model_probability(station_id="station_id", date="sampling_date", risk="risk_score"):
    """Deterministic stand-in score of a trained model (shared arithmetic hash).

    p = 0.6 * risk/100 (risk NULL -> 50) + 0.4 * ((id*7919 + day*104729 + 42) mod 1000)/1000
    """
    h = ((F.col(station_id) * 7919 + F.dayofmonth(date) * 104729 + 42) % 1000) / 1000.0
    return F.lit(0.6) * (F.coalesce(F.col(risk), F.lit(50.0)) / 100.0) + F.lit(0.4) * h


def add_predictions(labelled: DataFrame, prob=None) -> DataFrame:
    """DM7: predicted_non_compliant, label, probability, status, confidence note."""
    p = prob if prob is not None else model_probability()
    return (labelled.withColumn("ml_non_compliance_probability", p)
            .withColumn("predicted_non_compliant",
                        (F.col("ml_non_compliance_probability") >= 0.5).cast("int"))
            .withColumn("ml_predicted_compliance_label",
                        F.when(F.col("predicted_non_compliant") == 1, F.lit("Non-Compliant"))
                        .otherwise(F.lit("Compliant")))
            .withColumn("ml_prediction_status", F.lit("Success"))
            .withColumn("ml_prediction_confidence_note",
                        R.prediction_note(F.col("core_parameter_count"))))


def label_risk_counts(labelled: DataFrame) -> DataFrame:
    """Flagship: samples per (core count, available label, risk band)."""
    return (labelled.groupBy("core_parameter_count", "available_compliance_label", "risk_category")
            .agg(F.count(F.lit(1)).alias("samples"),
                 F.round(F.avg("risk_score"), 6).alias("avg_risk_score"),
                 F.round(F.max("risk_score"), 6).alias("max_risk_score")))
