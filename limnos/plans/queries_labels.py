"""Registered queries: labelling and risk."""

from __future__ import annotations


from ..operators import labels
from . import datasets as D

Q = {}


def q(fn):
    Q[fn.__name__] = fn
    return fn


@q
def flagship(spark, sf):
    return labels.label_risk_counts(D.labelled(spark, sf))


@q
def lbl_compliance(spark, sf):
    return D.labelled(spark, sf).select(
        "station_id", "sampling_date", "available_compliance_label", "strict_compliance_label",
        "core_parameter_count", "available_compliance_parameters", "missing_required_parameters",
        "label_confidence", "violation_reasons", "violation_count")


@q
def rsk_score(spark, sf):
    return D.labelled(spark, sf).select(
        "station_id", "sampling_date", "risk_score", "risk_category", "risk_confidence")


@q
def rsk_category(spark, sf):
    from ..functions import rules as R2
    return D.labelled(spark, sf).select("station_id", "sampling_date", "risk_score",
                                        R2.risk_category("risk_score").alias("risk_band"))
