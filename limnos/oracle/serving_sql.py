"""Oracle SQL: overview, output checks, station detail."""

from .extra_sql import LIVE_ALERTS, RULE_EXPL
from .history_sql import HIST
from .live_sql import FINAL_EXPL, _rule_parts, fmt2_sql
from .ml_sql import metrics_sql
from .monitoring_sql import MON

_METRICS = metrics_sql("sc")
OVERVIEW = HIST + """
, sc AS (SELECT CAST(available_compliance_label = 'Non-Compliant' AS INTEGER) AS target, CAST(predicted_non_compliant AS DOUBLE) AS prediction,
  ml_non_compliance_probability AS score FROM predictions WHERE available_compliance_label IN ('Compliant_Based_On_Available_Parameters', 'Compliant', 'Non-Compliant'))
""" + _METRICS[:_METRICS.index("SELECT tp, fp")] + """
, overview AS (SELECT count(*) AS total_rows, count(DISTINCT station_name) AS stations_monitored,
  (SELECT count(*) FROM hot WHERE hotspot_status = 'Persistent Hotspot') AS persistent_hotspots,
  (SELECT count(*) FROM alerts) AS total_alerts,
  (SELECT count(*) FROM alerts WHERE severity IN ('High', 'Severe')) AS high_severe_alerts,
  (SELECT count(*) FROM base) AS expanded_baseline_rows,
  (SELECT (tp + tn) * 1.0e0 / nullif(tp + tn + fp + fn, 0) FROM m) AS operational_agreement,
  (SELECT rec FROM m) AS non_compliance_recall, (SELECT coalesce(2 * prec * rec / nullif(prec + rec, 0), 0.0e0) FROM m) AS leakage_safe_f1,
  (SELECT roc_auc FROM auc) AS leakage_safe_auc
FROM predictions)
"""
_CHECKED = [("total_nwmp_rows", "total_rows", "CAST(total_rows AS VARCHAR)"), ("stations_monitored", "stations_monitored", "CAST(stations_monitored AS VARCHAR)"),
            ("non_compliance_recall", "non_compliance_recall", fmt2_sql("non_compliance_recall")), ("leakage_safe_f1", "leakage_safe_f1", fmt2_sql("leakage_safe_f1")),
            ("persistent_hotspots", "persistent_hotspots", "CAST(persistent_hotspots AS VARCHAR)"), ("total_alerts", "total_alerts", "CAST(total_alerts AS VARCHAR)"),
            ("high_severe_alerts", "high_severe_alerts", "CAST(high_severe_alerts AS VARCHAR)"),
            ("expanded_baseline_rows", "expanded_baseline_rows", "CAST(expanded_baseline_rows AS VARCHAR)")]

SQL = {
    "sv_overview": OVERVIEW + """
SELECT * EXCLUDE (operational_agreement, non_compliance_recall, leakage_safe_f1, leakage_safe_auc), round(operational_agreement, 6) AS operational_agreement,
  round(non_compliance_recall, 6) AS non_compliance_recall, round(leakage_safe_f1, 6) AS leakage_safe_f1, round(leakage_safe_auc, 6) AS leakage_safe_auc
FROM overview""",
    "sv_checks": OVERVIEW + f"""
, a AS (SELECT count(*) AS rows, count_if(lower(trim(river_name)) IN ('river', 'creek', 'sea', 'nala', 'nalla', 'dam',
          'lake', 'pond', 'well')) AS generic,
          count_if(available_compliance_label IN ('Compliant_Based_On_Available_Parameters', 'Compliant', 'Non-Compliant')) AS usable FROM predictions)
, checks AS (""" + " UNION ALL ".join(
    [f"SELECT 'Overview Metrics' AS category, '{name} is not N/A' AS name, {c} IS NOT NULL AS ok, 'Value: ' || coalesce({v}, 'N/A') AS details FROM overview"
     for name, c, v in _CHECKED] +
    [f"SELECT 'Operational', 'Column {c} exists', {str(c != 'water_body_type').lower()}, ''"
     for c in ("station_name", "river_name", "water_body_type", "ml_predicted_compliance_label")]) + f"""
UNION ALL SELECT 'Operational', 'File exists', rows > 0, '' FROM a
UNION ALL SELECT 'Operational', 'At least 600 rows', rows >= 600, 'Rows: ' || CAST(rows AS VARCHAR) FROM a
UNION ALL SELECT 'Operational', 'Probability column exists', true, ''
UNION ALL SELECT 'Operational', 'Generic river_name rate <= 6%', generic * 100.0e0 / rows <= 6.0, 'Rate: ' || {fmt2_sql('(generic * 100.0e0 / rows)')} || '%' FROM a
UNION ALL SELECT 'Healthcheck', 'Model healthcheck files exist', rows > 0, '' FROM a
UNION ALL SELECT 'SHAP', 'Success files exist OR failure report', usable > 0, CASE WHEN usable > 0 THEN 'Success files found' ELSE 'Neither found' END FROM a
UNION ALL SELECT 'LIME', 'live_lime_explanations.csv exists', (SELECT count(*) FROM events) > 0, ''
UNION ALL SELECT 'LIME', 'At least one lime_status = success', (SELECT count(*) FROM events) > 0, '')
SELECT category, name AS "check", CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status, details FROM checks""",
    "sv_station_detail": LIVE_ALERTS + f"""
, rp AS (SELECT *, {_rule_parts()} AS parts FROM lp)
, rx AS (SELECT *, CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' ') ELSE 'No core parameter rules could be evaluated.' END AS rule FROM rp)
SELECT d.*, la.timestamp AS alert_timestamp, la.severity, la.alert_type, la.reason
FROM (SELECT station_id, station_name, latest_timestamp, round(ph, 6) AS ph, round(dissolved_oxygen, 6) AS dissolved_oxygen, round(bod, 6) AS bod,
    live_strict_compliance_label, live_ml_predicted_compliance_label, round(live_ml_non_compliance_probability, 6) AS live_ml_non_compliance_probability,
    ml_prediction_confidence_note, {FINAL_EXPL} AS live_final_explanation FROM rx) d LEFT JOIN la ON la.station_id = d.station_id""",
    "sv_top_station": MON + f"""
, st AS (SELECT station_name FROM top20 LIMIT 1)
SELECT station_name, sampling_date, available_compliance_label, round(risk_score, 6) AS risk_score, risk_category,
  {RULE_EXPL} AS rule_based_explanation,
  (SELECT count(*) FROM alerts WHERE station_name = (SELECT station_name FROM st)) AS alert_count
FROM predictions WHERE station_name = (SELECT station_name FROM st) ORDER BY sampling_date DESC LIMIT 1""",
}
