"""Operational monitoring (E2): hotspots, trends, alerts.

Scale notes:
* Every per-station statistic is an algebraic aggregate (count, sum, min,
  max, avg, min-of-struct) so Spark combines map-side before the shuffle;
  a station holding a third of all rows is reduced in every map task first.
* The most common violation is a two-level aggregate ((station, reason)
  counts, then the min of struct(-count, reason) per station) instead of a
  per-group value map, so no task holds one station's distinct values.
* Alert membership (persistent / increasing stations) is a left join on
  station name with flag columns; both sides are one row per station and
  AQE picks broadcast or shuffle from their measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import rules as R
from ..sources.bindings import CYCLE_NAMES


def _month_name(m):
    return F.element_at(F.array(*[F.lit(x) for x in CYCLE_NAMES]), m)


def rule_binary():
    lbl = F.col("available_compliance_label")
    return (F.when(lbl == K.LBL_NON_COMPLIANT, F.lit(1))
            .when(lbl.isNotNull() & ~lbl.isin(*K.INVALID_RULE_LABELS), F.lit(0)))


def hotspot_status(months_obs, months_nc):
    mo, mn = F.col(months_obs), F.col(months_nc)
    return (F.when((mo < 2) & (mn >= 1), F.lit("Intermittent Risk"))
            .when(mo < 2, F.lit("Insufficient Monitoring"))
            .when(mn == mo, F.lit("Persistent Hotspot"))
            .when(mn >= 2, F.lit("Recurring Risk"))
            .when(mn == 1, F.lit("Intermittent Risk"))
            .otherwise(F.lit("Stable / Low Risk")))


def most_common(df: DataFrame, key: str, value: str, out: str,
                exclude=("Unknown",), default: str = "None") -> DataFrame:
    """hot_mode: most frequent non-null value per key; ties -> smallest value."""
    valid = df.where(F.col(value).isNotNull() & ~F.col(value).isin(*exclude))
    counts = valid.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_b"))
    return best.select(key, F.col("_b.v").alias(out)), default


def distinct_small(col, when=None):
    """Distinct count of a small integer code (month 1..12) as a bitmask.

    bit_or is algebraic, so unlike several countDistinct in one aggregate it
    needs no Expand (row duplication) and combines map-side.
    """
    c = F.col(col) if when is None else F.when(when, F.col(col))
    return F.coalesce(F.bit_count(F.bit_or(F.pow(F.lit(2), c).cast("long"))), F.lit(0)).cast("long")


def hotspot_summary(pred: DataFrame) -> DataFrame:
    """hot_summary (DM10): one row per station."""
    p = pred.withColumn("_rule", rule_binary())
    stats = p.groupBy("station_name").agg(
        distinct_small("month_no").alias("months_observed"),
        distinct_small("month_no", F.col("predicted_non_compliant") == 1)
        .alias("months_predicted_non_compliant"),
        F.coalesce(F.sum("predicted_non_compliant"), F.lit(0)).cast("long").alias("samples_predicted_non_compliant"),
        distinct_small("month_no", F.col("_rule") == 1).alias("months_rule_non_compliant"),
        F.coalesce(F.sum("_rule"), F.lit(0)).cast("long").alias("samples_rule_non_compliant"),
        F.avg("risk_score").alias("average_risk_score"),
        F.max("risk_score").alias("max_risk_score"),
        F.avg("ml_non_compliance_probability").alias("average_predicted_non_compliance_probability"),
        F.max(R.risk_rank("risk_category")).alias("_sev"),
        F.min("month_no").alias("_m0"), F.max("month_no").alias("_m1"),
    )
    mode, default = most_common(p, "station_name", "violation_reasons", "most_common_violation_reason")
    return (stats.join(mode, "station_name", "left").select(
        "station_name", "months_observed", "months_predicted_non_compliant",
        "samples_predicted_non_compliant", "months_rule_non_compliant", "samples_rule_non_compliant",
        "average_risk_score", "max_risk_score", "average_predicted_non_compliance_probability",
        F.coalesce("most_common_violation_reason", F.lit(default)).alias("most_common_violation_reason"),
        R.risk_from_rank("_sev").alias("most_severe_risk_category"),
        _month_name(F.col("_m0")).alias("first_observed_month"),
        _month_name(F.col("_m1")).alias("last_observed_month"),
        hotspot_status("months_observed", "months_predicted_non_compliant").alias("hotspot_status")))


def status_priority(status):
    s = F.col(status)
    expr = F.lit(None).cast("int")
    for name, pr in K.HOTSPOT_PRIORITY.items():
        expr = F.when(s == name, F.lit(pr)).otherwise(expr)
    return expr


def top_hotspots(hot: DataFrame, n: int = 20) -> DataFrame:
    """hot_top20: status priority, max risk, NC months (desc), station name as tie key."""
    return (hot.orderBy(status_priority("hotspot_status").desc_nulls_last(),
                        F.col("max_risk_score").desc_nulls_last(),
                        F.col("months_predicted_non_compliant").desc_nulls_last(),
                        F.col("station_name").asc())
            .limit(n))


# ---------------------------------------------------------------------------
# Trends
# ---------------------------------------------------------------------------

def monthly_summary(pred: DataFrame) -> DataFrame:
    """trd_monthly (D2 fixed: compares with the real band names)."""
    return pred.groupBy("month").agg(
        F.count("predicted_non_compliant").alias("total_samples"),
        F.count_if(F.col("predicted_non_compliant") == 0).alias("predicted_compliant"),
        F.count_if(F.col("predicted_non_compliant") == 1).alias("predicted_non_compliant"),
        F.avg("risk_score").alias("average_risk_score"),
        F.count_if(F.col("risk_category").isin("Severe Risk", "High Risk")).alias("severe_high_risk_count"))


def month_risk_pivot(pred: DataFrame) -> DataFrame:
    """piv_month_risk: station x month mean risk with a fixed value list (no distinct pass)."""
    return pred.groupBy("station_name").pivot("month", CYCLE_NAMES).agg(F.avg("risk_score"))


def station_trends(pred: DataFrame) -> DataFrame:
    """trd_station: first/last month mean risk, change, repeated high risk (>= 2 months)."""
    monthly = (pred.groupBy("station_name", "month_no").agg(F.avg("risk_score").alias("r"))
               .where(F.col("r").isNotNull()))
    t = monthly.groupBy("station_name").agg(
        F.count(F.lit(1)).alias("_k"),
        F.min("month_no").alias("_m0"), F.max("month_no").alias("_m1"),
        F.min_by("r", "month_no").alias("first_risk_score"),
        F.max_by("r", "month_no").alias("last_risk_score"),
        F.bool_and(F.col("r") >= K.TREND_HIGH_SCORE).alias("repeated_high_risk"))
    return t.where(F.col("_k") >= 2).select(
        "station_name", _month_name(F.col("_m0")).alias("first_month"),
        _month_name(F.col("_m1")).alias("last_month"), "first_risk_score", "last_risk_score",
        (F.col("last_risk_score") - F.col("first_risk_score")).alias("risk_change"),
        "repeated_high_risk")


def rising_falling(trends: DataFrame) -> DataFrame:
    """trd_inc_dec: change >= 15 increasing, <= -15 decreasing."""
    d = (F.when(F.col("risk_change") >= K.TREND_CHANGE, F.lit("increasing"))
         .when(F.col("risk_change") <= -K.TREND_CHANGE, F.lit("decreasing")))
    return trends.withColumn("direction", d).where(F.col("direction").isNotNull())


# ---------------------------------------------------------------------------
# Alerts
# ---------------------------------------------------------------------------

def alert_severity(types):
    t = F.col(types) if isinstance(types, str) else types

    def has(x):
        return F.array_contains(t, x)
    return (F.when(has("Severe Risk Score") | has("Persistent Hotspot"), F.lit("Severe"))
            .when(has("Regulatory Violation") | has("ML Non-Compliance") | has("High Risk Score"), F.lit("High"))
            .when(has("Increasing Risk"), F.lit("Warning"))
            .when(has("Low Confidence Data"), F.lit("Info"))
            .otherwise(F.lit("Safe")))


def alert_action(severity, types):
    t = F.col(types) if isinstance(types, str) else types
    a = K.ALERT_ACTIONS
    return (F.when(F.col(severity) == "Severe", F.lit(a["Severe"]))
            .when(F.array_contains(t, "Regulatory Violation"), F.lit(a["Regulatory Violation"]))
            .when(F.array_contains(t, "ML Non-Compliance"), F.lit(a["ML Non-Compliance"]))
            .when(F.array_contains(t, "Increasing Risk"), F.lit(a["Increasing Risk"]))
            .when(F.array_contains(t, "Low Confidence Data"), F.lit(a["Low Confidence Data"]))
            .otherwise(F.lit(a["None"])))


def membership(pred: DataFrame, hot: DataFrame, trends: DataFrame) -> DataFrame:
    """jn_semi_hotspot: flag persistent-hotspot and increasing-risk stations."""
    persistent = (hot.where(F.col("hotspot_status") == "Persistent Hotspot")
                  .select("station_name", F.lit(True).alias("is_persistent_hotspot")))
    increasing = (trends.where(F.col("risk_change") >= K.TREND_CHANGE)
                  .select("station_name", F.lit(True).alias("is_increasing_risk")))
    return (pred.join(persistent, "station_name", "left").join(increasing, "station_name", "left")
            .fillna(False, subset=["is_persistent_hotspot", "is_increasing_risk"]))


def operational_alerts(flagged: DataFrame) -> DataFrame:
    """alr_operational: one alert per sample with >= 1 trigger (7 triggers)."""
    risk = F.coalesce(F.col("risk_score"), F.lit(0.0))
    trig = F.array_compact(F.array(
        F.when(F.col("available_compliance_label") == K.LBL_NON_COMPLIANT, F.lit("Regulatory Violation")),
        F.when(F.col("predicted_non_compliant") == 1, F.lit("ML Non-Compliance")),
        F.when(risk >= K.ALERT_SEVERE_SCORE, F.lit("Severe Risk Score"))
        .when(risk >= K.ALERT_HIGH_SCORE, F.lit("High Risk Score")),
        F.when(F.col("is_persistent_hotspot"), F.lit("Persistent Hotspot")),
        F.when(F.col("is_increasing_risk"), F.lit("Increasing Risk")),
        F.when(F.col("label_confidence").isin("Low", "Insufficient"), F.lit("Low Confidence Data")),
    ))
    a = flagged.withColumn("_t", trig).where(F.size("_t") > 0)
    types = F.array_join("_t", " | ")
    a = a.withColumn("severity", alert_severity("_t"))
    return a.select(
        F.substring(F.sha2(F.concat_ws("|", F.col("station_id").cast("string"),
                                       F.col("sampling_date").cast("string"), types), 256), 1, 16)
        .alias("alert_id"),
        "station_id", "station_name", "river_name", "state_name", "sampling_date", "month",
        types.alias("alert_types"), "severity",
        F.col("ml_predicted_compliance_label").alias("predicted_compliance_label"),
        F.col("ml_non_compliance_probability").alias("predicted_non_compliance_probability"),
        risk.alias("risk_score"), "risk_category", "violation_reasons", "label_confidence",
        F.concat(F.lit("Triggered by: "), F.array_join("_t", ", ")).alias("explanation"),
        alert_action("severity", "_t").alias("recommended_action"))


def severity_rank(sev):
    s = F.col(sev)
    expr = F.lit(0)
    for name, r in K.SEVERITY_RANK.items():
        expr = F.when(s == name, F.lit(r)).otherwise(expr)
    return expr
