"""Oracle SQL: hotspots, trends, alerts."""

from .base import WITH_BASE

MONTHS = "['July', 'August', 'September']"

MON = WITH_BASE + f"""
, pred_rb AS (
  SELECT *, CASE WHEN available_compliance_label = 'Non-Compliant' THEN 1
    WHEN available_compliance_label IS NOT NULL AND available_compliance_label NOT IN
      ('Insufficient_Data', 'Unknown', 'Missing', 'NaN', 'nan') THEN 0 END AS rule_b
  FROM predictions
), hot_stats AS (
  SELECT station_name,
    count(DISTINCT month_no) AS months_observed,
    count(DISTINCT CASE WHEN predicted_non_compliant = 1 THEN month_no END) AS months_predicted_non_compliant,
    CAST(coalesce(sum(predicted_non_compliant), 0) AS BIGINT) AS samples_predicted_non_compliant,
    count(DISTINCT CASE WHEN rule_b = 1 THEN month_no END) AS months_rule_non_compliant,
    CAST(coalesce(sum(rule_b), 0) AS BIGINT) AS samples_rule_non_compliant,
    avg(risk_score) AS average_risk_score, max(risk_score) AS max_risk_score,
    avg(ml_non_compliance_probability) AS average_predicted_non_compliance_probability,
    max(CASE trim(risk_category) WHEN 'Severe Risk' THEN 4 WHEN 'High Risk' THEN 3
        WHEN 'Moderate Risk' THEN 2 WHEN 'Low Risk' THEN 1 ELSE -1 END) AS sev,
    min(month_no) AS m0, max(month_no) AS m1
  FROM pred_rb GROUP BY station_name
), hot_mode AS (
  SELECT station_name, violation_reasons AS reason FROM (
    SELECT station_name, violation_reasons,
      row_number() OVER (PARTITION BY station_name ORDER BY count(*) DESC, violation_reasons) AS rn
    FROM predictions WHERE violation_reasons IS NOT NULL AND violation_reasons <> 'Unknown'
    GROUP BY station_name, violation_reasons) WHERE rn = 1
), hot AS (
  SELECT h.station_name, months_observed, months_predicted_non_compliant, samples_predicted_non_compliant,
    months_rule_non_compliant, samples_rule_non_compliant, average_risk_score, max_risk_score,
    average_predicted_non_compliance_probability,
    coalesce(m.reason, 'None') AS most_common_violation_reason,
    CASE sev WHEN 4 THEN 'Severe Risk' WHEN 3 THEN 'High Risk' WHEN 2 THEN 'Moderate Risk'
      WHEN 1 THEN 'Low Risk' ELSE 'Unknown' END AS most_severe_risk_category,
    {MONTHS}[m0] AS first_observed_month, {MONTHS}[m1] AS last_observed_month,
    CASE WHEN months_observed < 2 AND months_predicted_non_compliant >= 1 THEN 'Intermittent Risk'
      WHEN months_observed < 2 THEN 'Insufficient Monitoring'
      WHEN months_predicted_non_compliant = months_observed THEN 'Persistent Hotspot'
      WHEN months_predicted_non_compliant >= 2 THEN 'Recurring Risk'
      WHEN months_predicted_non_compliant = 1 THEN 'Intermittent Risk'
      ELSE 'Stable / Low Risk' END AS hotspot_status
  FROM hot_stats h LEFT JOIN hot_mode m ON m.station_name = h.station_name
), top20 AS (
  SELECT * FROM hot ORDER BY CASE hotspot_status WHEN 'Persistent Hotspot' THEN 4 WHEN 'Recurring Risk' THEN 3
      WHEN 'Intermittent Risk' THEN 2 WHEN 'Insufficient Monitoring' THEN 1 WHEN 'Stable / Low Risk' THEN 0 END DESC NULLS LAST,
    max_risk_score DESC NULLS LAST, months_predicted_non_compliant DESC NULLS LAST, station_name
  LIMIT 20
), monthly_station AS (
  SELECT station_name, month_no, avg(risk_score) AS r FROM predictions
  GROUP BY station_name, month_no HAVING avg(risk_score) IS NOT NULL
), trends AS (
  SELECT station_name, {MONTHS}[min(month_no)] AS first_month, {MONTHS}[max(month_no)] AS last_month,
    arg_min(r, month_no) AS first_risk_score, arg_max(r, month_no) AS last_risk_score,
    arg_max(r, month_no) - arg_min(r, month_no) AS risk_change,
    bool_and(r >= 51) AS repeated_high_risk
  FROM monthly_station GROUP BY station_name HAVING count(*) >= 2
), flagged AS (
  SELECT *,
    station_name IN (SELECT station_name FROM hot WHERE hotspot_status = 'Persistent Hotspot') AS is_persistent_hotspot,
    station_name IN (SELECT station_name FROM trends WHERE risk_change >= 15) AS is_increasing_risk
  FROM predictions
), alert_base AS (
  SELECT *, list_filter([
      CASE WHEN available_compliance_label = 'Non-Compliant' THEN 'Regulatory Violation' END,
      CASE WHEN predicted_non_compliant = 1 THEN 'ML Non-Compliance' END,
      CASE WHEN coalesce(risk_score, 0.0e0) >= 76 THEN 'Severe Risk Score'
           WHEN coalesce(risk_score, 0.0e0) >= 51 THEN 'High Risk Score' END,
      CASE WHEN is_persistent_hotspot THEN 'Persistent Hotspot' END,
      CASE WHEN is_increasing_risk THEN 'Increasing Risk' END,
      CASE WHEN label_confidence IN ('Low', 'Insufficient') THEN 'Low Confidence Data' END
    ], lambda x: x IS NOT NULL) AS trig
  FROM flagged
), alert_sev AS (
  SELECT *,
    CASE WHEN list_contains(trig, 'Severe Risk Score') OR list_contains(trig, 'Persistent Hotspot') THEN 'Severe'
      WHEN list_contains(trig, 'Regulatory Violation') OR list_contains(trig, 'ML Non-Compliance')
        OR list_contains(trig, 'High Risk Score') THEN 'High'
      WHEN list_contains(trig, 'Increasing Risk') THEN 'Warning'
      WHEN list_contains(trig, 'Low Confidence Data') THEN 'Info' ELSE 'Safe' END AS severity
  FROM alert_base WHERE len(trig) > 0
), alerts AS (
  SELECT substr(sha256(CAST(station_id AS VARCHAR) || '|' || CAST(sampling_date AS VARCHAR) || '|'
                       || array_to_string(trig, ' | ')), 1, 16) AS alert_id,
    station_id, station_name, river_name, state_name, sampling_date, month,
    array_to_string(trig, ' | ') AS alert_types, severity,
    ml_predicted_compliance_label AS predicted_compliance_label,
    ml_non_compliance_probability AS predicted_non_compliance_probability,
    coalesce(risk_score, 0.0e0) AS risk_score, risk_category, violation_reasons, label_confidence,
    'Triggered by: ' || array_to_string(trig, ', ') AS explanation,
    CASE WHEN severity = 'Severe' THEN 'Escalate for immediate field inspection and source tracking.'
      WHEN list_contains(trig, 'Regulatory Violation') THEN 'Inspect nearby discharge source and issue warning.'
      WHEN list_contains(trig, 'ML Non-Compliance') THEN 'Schedule prioritized testing to verify ML prediction.'
      WHEN list_contains(trig, 'Increasing Risk') THEN 'Monitor closely in next sampling cycle.'
      WHEN list_contains(trig, 'Low Confidence Data') THEN 'Repeat sampling or repair missing sensor data.'
      ELSE 'No action required.' END AS recommended_action
  FROM alert_sev
)
"""

HOT_COLS = """station_name, months_observed, months_predicted_non_compliant, samples_predicted_non_compliant,
  months_rule_non_compliant, samples_rule_non_compliant, round(average_risk_score, 6) AS average_risk_score,
  round(max_risk_score, 6) AS max_risk_score,
  round(average_predicted_non_compliance_probability, 6) AS average_predicted_non_compliance_probability,
  most_common_violation_reason, most_severe_risk_category, first_observed_month, last_observed_month, hotspot_status"""

TREND_COLS = """station_name, first_month, last_month, round(first_risk_score, 6) AS first_risk_score,
  round(last_risk_score, 6) AS last_risk_score, round(risk_change, 6) AS risk_change, repeated_high_risk"""

SQL = {
    "hot_summary": MON + f"SELECT {HOT_COLS} FROM hot",
    "hot_status": MON + "SELECT station_name, months_observed, months_predicted_non_compliant, hotspot_status FROM hot",
    "hot_mode": MON + "SELECT station_name, most_common_violation_reason FROM hot",
    "hot_severity_max": MON + "SELECT station_name, most_severe_risk_category FROM hot",
    "hot_top20": MON + f"SELECT {HOT_COLS} FROM top20",
    "hot_dist": MON + """
SELECT 'hotspot_status' AS dimension, hotspot_status AS value, count(*) AS count FROM hot GROUP BY ALL
UNION ALL
SELECT 'most_severe_risk_category', most_severe_risk_category, count(*) FROM hot GROUP BY ALL""",
    "trd_monthly": MON + """
SELECT month, count(predicted_non_compliant) AS total_samples,
  count_if(predicted_non_compliant = 0) AS predicted_compliant,
  count_if(predicted_non_compliant = 1) AS predicted_non_compliant,
  round(avg(risk_score), 6) AS average_risk_score,
  count_if(risk_category IN ('Severe Risk', 'High Risk')) AS severe_high_risk_count
FROM predictions GROUP BY month""",
    "piv_month_risk": MON + """
SELECT station_name,
  round(avg(CASE WHEN month = 'July' THEN risk_score END), 6) AS "July",
  round(avg(CASE WHEN month = 'August' THEN risk_score END), 6) AS "August",
  round(avg(CASE WHEN month = 'September' THEN risk_score END), 6) AS "September"
FROM predictions GROUP BY station_name""",
    "trd_station": MON + f"SELECT {TREND_COLS} FROM trends",
    "trd_inc_dec": MON + f"""
SELECT {TREND_COLS}, CASE WHEN risk_change >= 15 THEN 'increasing' ELSE 'decreasing' END AS direction
FROM trends WHERE risk_change >= 15 OR risk_change <= -15""",
    "jn_semi_hotspot": MON + "SELECT station_id, sampling_date, is_persistent_hotspot, is_increasing_risk FROM flagged",
    "alr_operational": MON + "SELECT * FROM alerts",
    "alr_severity": MON + "SELECT alert_id, alert_types, severity FROM alerts",
    "alr_action": MON + "SELECT alert_id, severity, recommended_action FROM alerts",
    "alr_id": MON + "SELECT alert_id, station_id, sampling_date FROM alerts",
    "alr_summary": MON + """
SELECT severity, count(*) AS alerts FROM alerts GROUP BY severity
UNION ALL SELECT 'High+Severe', count(*) FROM alerts WHERE severity IN ('Severe', 'High')""",
    "alr_sort": MON + """
SELECT alert_id, severity, CASE severity WHEN 'Severe' THEN 4 WHEN 'High' THEN 3 WHEN 'Warning' THEN 2
    WHEN 'Info' THEN 1 ELSE 0 END AS severity_rank, sampling_date
FROM alerts ORDER BY severity_rank DESC, sampling_date DESC, alert_id""",
    "jn_first_match": MON + """
SELECT t.station_name, t.hotspot_status, p.sampling_date, p.available_compliance_label, p.violation_reasons,
  round(p.risk_score, 6) AS risk_score, p.risk_category
FROM top20 t JOIN (
  SELECT *, row_number() OVER (PARTITION BY station_name ORDER BY sampling_date) AS rn FROM predictions
) p ON p.station_name = t.station_name AND p.rn = 1""",
}
