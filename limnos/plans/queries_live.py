"""Registered queries: live feed, latest state, live labels and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import live as LV

Q = {}


def q(fn):
    Q[fn.__name__] = fn
    return fn


def readings(spark, sf):
    from . import datasets as D
    return LV.ingest(D.live_feed(spark, sf))


def as_of(df):
    """Reference time of a live run: the newest reading of the feed (scalar subquery)."""
    return df.select(F.max("timestamp")).scalar()


def predictions(spark, sf):
    return LV.live_predictions(LV.live_state(readings(spark, sf)))


@q
def str_param_canon(spark, sf):
    return readings(spark, sf).select("event_id", "parameter_raw_name", "parameter")


@q
def live_numeric_flag(spark, sf):
    return readings(spark, sf).select("event_id", "value", "value_numeric", "is_numeric_value")


@q
def win_latest(spark, sf):
    return LV.latest_per_parameter(readings(spark, sf)).select(
        "station_id", "parameter", "latest_timestamp", "latest_value", "latest_value_text")


@q
def win_latest_station(spark, sf):
    return LV.latest_station_meta(readings(spark, sf))


@q
def piv_live_wide(spark, sf):
    return LV.live_wide(LV.latest_per_parameter(readings(spark, sf)))


@q
def jn_live_meta(spark, sf):
    st = LV.live_state(readings(spark, sf))
    return st.select("station_id", "station_no", "station_name", "state", "latest_timestamp", "season",
                     "dissolved_oxygen", "bod", "ph", "temperature", "conductivity")


@q
def core_conf(spark, sf):
    st = LV.live_state(readings(spark, sf))
    return st.select("station_id", "available_live_parameters", "missing_model_features", "core_parameter_count",
                     "available_core_parameters", "missing_core_parameters", "live_data_confidence")


@q
def lbl_live(spark, sf):
    return predictions(spark, sf).select(
        "station_id", "live_available_compliance_label", "live_strict_compliance_label", "live_violation_reasons",
        "live_violation_count", "live_rule_confidence", "live_compliance_scope")


@q
def note_conf(spark, sf):
    return predictions(spark, sf).select("station_id", "core_parameter_count", "ml_prediction_confidence_note")


@q
def alr_live(spark, sf):
    r = readings(spark, sf)
    return LV.live_alerts(LV.live_predictions(LV.live_state(r)), as_of(r))


@q
def st_latest_ts(spark, sf):
    r = readings(spark, sf)
    st = LV.live_state(r)
    return r.agg(F.max("timestamp").alias("t1")).select(
        F.greatest("t1", st.select(F.max("latest_timestamp")).scalar()).alias("latest_sensor_timestamp"))


@q
def st_coverage(spark, sf):
    return LV.coverage(readings(spark, sf))


@q
def st_matrix(spark, sf):
    return LV.station_matrix(readings(spark, sf))


@q
def st_stale(spark, sf):
    r = readings(spark, sf)
    meta = LV.latest_station_meta(r)
    return meta.select("station_id", "latest_timestamp",
                       *LV.data_age(F.col("latest_timestamp"), as_of(r))).withColumn(
        "age_hours", R.fmt_short(F.col("age_hours"))).withColumnRenamed("age_hours", "age_hours_text")


@q
def xp_live(spark, sf):
    return LV.live_explanations(predictions(spark, sf))
