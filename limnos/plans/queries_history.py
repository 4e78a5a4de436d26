"""Registered queries: historical baseline matching and alert enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explain as X
from ..operators import history as H
from ..operators import monitoring as M
from ..operators import profile as P
from . import datasets as D
from .out import rounded

Q = {}


def q(fn):
    Q[fn.__name__] = fn
    return fn


def _inputs(spark, sf):
    pred = D.predictions(spark, sf)
    base = D.materialized(spark, sf, "baseline", lambda: P.baseline(pred, P.PARAMS, 50))  # medians are ranked once
    return pred, H.first_samples(pred), base


@q
def jn_hist_exact(spark, sf):
    _, cur, base = _inputs(spark, sf)
    return H.hist_exact(cur, base)


@q
def jn_hist_fuzzy(spark, sf):
    _, cur, base = _inputs(spark, sf)
    return rounded(H.hist_fuzzy(cur, base))


@q
def jn_alert_enrich(spark, sf):
    pred, cur, base = _inputs(spark, sf)
    alerts = M.operational_alerts(M.membership(pred, M.hotspot_summary(pred), M.station_trends(pred)))
    rules = pred.groupBy("station_name").agg(
        F.min_by(X.rule_explanation(), "sampling_date").alias("rule_explanation"))
    hist = H.hist_exact(cur, base).select("station_name", "historical_context")
    e = alerts.join(rules, "station_name", "left").join(hist, "station_name", "left")
    return rounded(e.select(
        "alert_id", "station_name", "river_name", F.col("alert_types").alias("alert_type"), "severity",
        "risk_score", "risk_category", "violation_reasons", F.lit("").alias("top_model_drivers"),
        F.coalesce("rule_explanation", F.lit("")).alias("rule_explanation"), F.lit("").alias("shap_explanation"),
        F.coalesce("historical_context", F.lit("None")).alias("historical_context_if_available"),
        F.when(F.col("severity").isin("Severe", "Critical"), F.lit("Dispatch immediate field monitoring team"))
        .otherwise(F.lit("Monitor closely and verify at next sampling cycle")).alias("recommended_action")))
