"""Registered queries: hotspots, trends, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitoring as M
from . import datasets as D
from .out import rounded

Q = {}


def q(fn):
    Q[fn.__name__] = fn
    return fn


def _hot(spark, sf):
    return M.hotspot_summary(D.predictions(spark, sf))


def _alerts(spark, sf):
    pred = D.predictions(spark, sf)
    flagged = M.membership(pred, M.hotspot_summary(pred), M.station_trends(pred))
    return M.operational_alerts(flagged)


@q
def hot_summary(spark, sf):
    return rounded(_hot(spark, sf))


@q
def hot_status(spark, sf):
    return _hot(spark, sf).select("station_name", "months_observed",
                                  "months_predicted_non_compliant", "hotspot_status")


@q
def hot_mode(spark, sf):
    return _hot(spark, sf).select("station_name", "most_common_violation_reason")


@q
def hot_severity_max(spark, sf):
    return _hot(spark, sf).select("station_name", "most_severe_risk_category")


@q
def hot_top20(spark, sf):
    return rounded(M.top_hotspots(_hot(spark, sf), 20))


@q
def hot_dist(spark, sf):
    h = _hot(spark, sf)
    a = h.groupBy(F.lit("hotspot_status").alias("dimension"), F.col("hotspot_status").alias("value")).count()
    b = h.groupBy(F.lit("most_severe_risk_category").alias("dimension"),
                  F.col("most_severe_risk_category").alias("value")).count()
    return a.unionByName(b)


@q
def trd_monthly(spark, sf):
    return rounded(M.monthly_summary(D.predictions(spark, sf)))


@q
def piv_month_risk(spark, sf):
    return rounded(M.month_risk_pivot(D.predictions(spark, sf)))


@q
def trd_station(spark, sf):
    return rounded(M.station_trends(D.predictions(spark, sf)))


@q
def trd_inc_dec(spark, sf):
    return rounded(M.rising_falling(M.station_trends(D.predictions(spark, sf))))


@q
def jn_semi_hotspot(spark, sf):
    pred = D.predictions(spark, sf)
    f = M.membership(pred, M.hotspot_summary(pred), M.station_trends(pred))
    return f.select("station_id", "sampling_date", "is_persistent_hotspot", "is_increasing_risk")


@q
def alr_operational(spark, sf):
    return _alerts(spark, sf)


@q
def alr_severity(spark, sf):
    return _alerts(spark, sf).select("alert_id", "alert_types", "severity")


@q
def alr_action(spark, sf):
    return _alerts(spark, sf).select("alert_id", "severity", "recommended_action")


@q
def alr_id(spark, sf):
    return _alerts(spark, sf).select("alert_id", "station_id", "sampling_date")


@q
def alr_summary(spark, sf):
    a = _alerts(spark, sf)
    by = a.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"))
    hi = a.where(F.col("severity").isin("Severe", "High")).agg(F.count(F.lit(1)).alias("alerts")) \
        .select(F.lit("High+Severe").alias("severity"), "alerts")
    return by.unionByName(hi)


@q
def alr_sort(spark, sf):
    a = _alerts(spark, sf)
    return a.select("alert_id", "severity", M.severity_rank("severity").alias("severity_rank"),
                    "sampling_date").orderBy(F.col("severity_rank").desc(), F.col("sampling_date").desc(),
                                             F.col("alert_id"))


@q
def jn_first_match(spark, sf):
    pred = D.predictions(spark, sf)
    top = M.top_hotspots(M.hotspot_summary(pred), 20).select("station_name", "hotspot_status")
    # first sample per station with min_by (constant memory per station, no per-station sort)
    cols = ["sampling_date", "available_compliance_label", "violation_reasons", "risk_score", "risk_category"]
    first = (pred.join(F.broadcast(top.select("station_name")), "station_name", "left_semi")
             .groupBy("station_name").agg(F.min_by(F.struct(*cols), "sampling_date").alias("_f"))
             .select("station_name", "_f.*"))
    return rounded(top.join(first, "station_name").select("station_name", "hotspot_status", *cols))
