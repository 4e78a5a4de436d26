"""Data behind the dashboard pages: filters, metrics, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R


def apply_filters(df: DataFrame, month=None, station=None, risk=None, severity=None) -> DataFrame:
    """sv_filter: optional equality filters (pushed down by Catalyst when on a scan column)."""
    for col, v in (("month", month), ("station_name", station), ("risk_category", risk), ("severity", severity)):
        if v is not None and v != "All" and col in df.columns:
            df = df.where(F.col(col) == v)
    return df



def overview(p: DataFrame, hot: DataFrame, alerts: DataFrame, baseline: DataFrame, quality: DataFrame) -> DataFrame:
    """sv_overview: one row with the counts of predictions, hotspots, alerts and baseline rows, and of `quality`, the one row
    of metrics of the model in use, its agreement with the rules, recall, F1 and AUC."""
    n = F.count(F.lit(1))
    parts = [p.agg(n.alias("total_rows"), F.countDistinct("station_name").alias("stations_monitored")),
             hot.agg(F.count_if(F.col("hotspot_status") == "Persistent Hotspot").alias("persistent_hotspots")),
             alerts.agg(n.alias("total_alerts"), F.count_if(F.col("severity").isin("High", "Severe")).alias("high_severe_alerts")),
             baseline.agg(n.alias("expanded_baseline_rows")),
             quality.select(F.col("accuracy").alias("operational_agreement"), F.col("recall").alias("non_compliance_recall"),
                            F.col("f1").alias("leakage_safe_f1"), F.col("roc_auc").alias("leakage_safe_auc"))]
    parts = [d.withColumn("_one", F.lit(1)) for d in parts]
    return reduce(lambda a, b: a.join(F.broadcast(b), "_one"), parts).drop("_one")  # a row each


def best_models(metrics: DataFrame, by: str = "f1") -> DataFrame:
    """The metrics of the best model of each variant and split; of equal ones the last name."""
    cols = [c for c in metrics.columns if c not in ("variant", "split_type")]
    best = metrics.groupBy("variant", "split_type").agg(F.max_by(F.struct(*cols), F.struct(by, "model")).alias("b"))
    return best.select("variant", "split_type", *[f"b.{c}" for c in cols])


# FIXED VALUES: names of the metrics that the page checks, names that are no river, columns that must exist
CHECKED_METRICS = {"total_nwmp_rows": "total_rows", "stations_monitored": "stations_monitored",
                   "non_compliance_recall": "non_compliance_recall", "leakage_safe_f1": "leakage_safe_f1",
                   "persistent_hotspots": "persistent_hotspots", "total_alerts": "total_alerts",
                   "high_severe_alerts": "high_severe_alerts", "expanded_baseline_rows": "expanded_baseline_rows"}
GENERIC_NAMES = ["river", "creek", "sea", "nala", "nalla", "dam", "lake", "pond", "well"]
REQUIRED_COLUMNS = ["station_name", "river_name", "water_body_type", "ml_predicted_compliance_label"]
PROBABILITY_COLUMNS = ["predicted_non_compliant_probability", "ml_non_compliance_probability"]


def output_checks(p: DataFrame, metrics: DataFrame, health: DataFrame, attributions: DataFrame, local: DataFrame) -> DataFrame:
    """sv_checks: (category, check, status, details), 20 rows, from one aggregate of each output.

    p: predictions; metrics: the row of `overview`; health: the model's summary; attributions: global ones; local: those of
    stations, with `lime_status`.  A metric that is null, a table without rows and a missing column fail."""
    n = F.count(F.lit(1))
    parts = [p.agg(n.alias("rows"), F.count_if(F.lower(F.trim("river_name")).isin(GENERIC_NAMES)).alias("generic")), metrics,
             health.agg(n.alias("health_rows")), attributions.agg(n.alias("attribution_rows")),
             local.agg(n.alias("local_rows"), F.count_if(F.col("lime_status") == "Success").alias("local_success"))]
    kinds = dict(metrics.dtypes)

    def check(category, name, ok, details=F.lit("")):
        return F.struct(F.lit(category).alias("category"), F.lit(name).alias("check"),
                        F.when(ok, "PASS").otherwise("FAIL").alias("status"), details.alias("details"))

    def shown(c):
        text = R.fmt2(c) if kinds[c] == "double" else F.col(c).cast("string")
        return F.concat(F.lit("Value: "), F.coalesce(text, F.lit("N/A")))
    rate = F.try_divide(F.col("generic") * 100.0, F.col("rows"))
    checks = [check("Overview Metrics", f"{name} is not N/A", F.col(c).isNotNull(), shown(c)) for name, c in CHECKED_METRICS.items()]
    checks += [check("Operational", "File exists", F.col("rows") > 0),
               check("Operational", "At least 600 rows", F.col("rows") >= 600, F.concat(F.lit("Rows: "), F.col("rows").cast("string")))]
    checks += [check("Operational", f"Column {c} exists", F.lit(c in p.columns)) for c in REQUIRED_COLUMNS]
    checks += [check("Operational", "Probability column exists", F.lit(any(c in p.columns for c in PROBABILITY_COLUMNS))),
               check("Operational", "Generic river_name rate <= 6%", rate <= 6.0, F.concat(F.lit("Rate: "), F.coalesce(R.fmt2(rate), F.lit("N/A")), F.lit("%"))),
               check("Healthcheck", "Model healthcheck files exist", F.col("health_rows") > 0),
               check("SHAP", "Success files exist OR failure report", F.col("attribution_rows") > 0,
                     F.when(F.col("attribution_rows") > 0, "Success files found").otherwise("Neither found")),
               check("LIME", "live_lime_explanations.csv exists", F.col("local_rows") > 0),
               check("LIME", "At least one lime_status = success", F.col("local_success") > 0)]
    facts = reduce(lambda a, b: a.join(F.broadcast(b), "_one"), [d.withColumn("_one", F.lit(1)) for d in parts])  # a row each
    return facts.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def station_detail(status: DataFrame, explanations: DataFrame, alerts: DataFrame, station: str | None = None) -> DataFrame:
    """sv_station_detail: latest values, labels and explanation of a station (of all, if none is given) with its alerts, a row
    an alert; a station without alerts has one row.  The filter reaches the scans of all three tables."""
    if station is not None:
        status, alerts = (d.where(F.col("station_name") == station) for d in (status, alerts))
    text = explanations.select("station_id", "live_final_explanation")
    mine = alerts.select("station_id", F.col("timestamp").alias("alert_timestamp"), "severity", "alert_type", "reason")
    return status.select("station_id", "station_name", "latest_timestamp", "ph", "dissolved_oxygen", "bod", "live_strict_compliance_label",
                         "live_ml_predicted_compliance_label", "live_ml_non_compliance_probability", "ml_prediction_confidence_note") \
        .join(text, "station_id", "left").join(mine, "station_id", "left")
