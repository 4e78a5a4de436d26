"""Oracle SQL: live feed, latest state, live labels, alerts, explanations."""

from .. import constants as K
from .base import WITH_BASE

LIVE_PARAMS = K.LIVE_PARAMS


def fmt_short_sql(x: str, places: int = 4) -> str:
    s = 10 ** places
    n = f"CAST(floor(abs({x}) * {s}.0e0 + 0.5e0) AS BIGINT)"
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE (CASE WHEN {x} < 0 AND {n} > 0 THEN '-' ELSE '' END) || "
            f"CAST({n} // {s} AS VARCHAR) || '.' || coalesce(nullif(rtrim(lpad(CAST({n} % {s} AS VARCHAR), {places}, '0'), '0'), ''), '0') END")


def fmt2_sql(x: str) -> str:
    n = f"CAST(floor(abs({x}) * 100.0e0 + 0.5e0) AS BIGINT)"
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE (CASE WHEN {x} < 0 AND {n} > 0 THEN '-' ELSE '' END) || "
            f"CAST({n} // 100 AS VARCHAR) || '.' || lpad(CAST({n} % 100 AS VARCHAR), 2, '0') END")


def fmt1_sql(x: str) -> str:
    n = f"CAST(floor(({x}) * 10.0e0 + 0.5e0) AS BIGINT)"
    return f"CAST({n} // 10 AS VARCHAR) || '.' || CAST({n} % 10 AS VARCHAR)"


ALIASES = " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in K.LIVE_PARAM_ALIASES)
KEY = "(CAST(epoch_us(timestamp) AS HUGEINT) * 1000000000 + event_id)"


def _last(c: str) -> str:
    return f"arg_max({c}, {KEY}) FILTER (WHERE {c} IS NOT NULL)"


def _plist(params, present=True):
    op = "IS NOT NULL" if present else "IS NULL"
    lst = "list_filter([" + ", ".join(f"CASE WHEN {p} {op} THEN '{p}' END" for p in params) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({lst}) > 0 THEN array_to_string({lst}, '|') ELSE 'None' END"


LIVE = WITH_BASE + f"""
, feed AS (
  SELECT e.event_id, e.user_id AS station_id, 'ST' || lpad(CAST(e.user_id AS VARCHAR), 4, '0') AS station_no,
    s.station_name, s.state_name AS state,
    8.0e0 + (e.user_id % 29) * 0.5e0 AS latitude, 68.0e0 + ((e.user_id * 7) % 31) * 0.5e0 AS longitude,
    CASE WHEN e.event_id % 13 = 0 THEN 'Chlorophyll' WHEN e.event_id % 17 = 0 THEN NULL
      ELSE CASE e.event_type WHEN 'error' THEN 'Dissolved Oxygen' WHEN 'click' THEN 'BOD' WHEN 'view' THEN 'pH'
        WHEN 'purchase' THEN 'Temp' ELSE 'EC' END END AS parameter_raw_name,
    e.ts AS timestamp,
    CASE WHEN e.event_id % 19 = 0 THEN 'NA' ELSE CAST(CAST(CASE e.event_type WHEN 'error' THEN e.value / 50.0e0
      WHEN 'click' THEN e.value / 20.0e0 WHEN 'view' THEN 6.0e0 + e.value / 100.0e0
      WHEN 'purchase' THEN e.value / 10.0e0 ELSE e.value * 10.0e0 END AS DECIMAL(12, 4)) AS VARCHAR) END AS value,
    CASE e.event_type WHEN 'error' THEN 'mg/L' WHEN 'click' THEN 'mg/L' WHEN 'view' THEN 'pH'
      WHEN 'purchase' THEN 'degC' ELSE 'uS/cm' END AS unit
  FROM events e LEFT JOIN stations s ON s.station_id = e.user_id
), rl AS (
  SELECT *, CASE WHEN parameter_raw_name IS NULL THEN 'unknown'
      ELSE CASE lower(trim(parameter_raw_name)) {ALIASES} ELSE lower(trim(parameter_raw_name)) END END AS parameter,
    TRY_CAST(value AS DOUBLE) AS value_numeric, TRY_CAST(value AS DOUBLE) IS NOT NULL AS is_numeric_value
  FROM feed
), latest AS (
  SELECT station_id, parameter, max(timestamp) AS latest_timestamp, {_last('value_numeric')} AS latest_value,
    {_last('value')} AS latest_value_text, {_last('station_name')} AS station_name
  FROM rl GROUP BY station_id, parameter
), meta AS (
  SELECT station_id, {_last('station_no')} AS station_no, {_last('station_name')} AS station_name,
    {_last('state')} AS state, {_last('latitude')} AS latitude, {_last('longitude')} AS longitude,
    max(timestamp) AS latest_timestamp
  FROM rl GROUP BY station_id
), wide AS (
  SELECT station_id, {", ".join(f"max(CASE WHEN parameter = '{p}' THEN latest_value END) AS {p}" for p in LIVE_PARAMS)}
  FROM latest GROUP BY station_id
), lstate AS (
  SELECT m.*, {", ".join("w." + p for p in LIVE_PARAMS)},
    CASE WHEN month(m.latest_timestamp) IS NULL THEN 'Unknown' WHEN month(m.latest_timestamp) IN (3, 4, 5) THEN 'Summer'
      WHEN month(m.latest_timestamp) IN (6, 7, 8, 9) THEN 'Monsoon' WHEN month(m.latest_timestamp) IN (10, 11) THEN 'Post-Monsoon'
      ELSE 'Winter' END AS season
  FROM meta m LEFT JOIN wide w ON w.station_id = m.station_id
), lstate2 AS (
  SELECT *, {_plist(LIVE_PARAMS)} AS available_live_parameters, {_plist(LIVE_PARAMS, False)} AS missing_model_features,
    (dissolved_oxygen IS NOT NULL)::INT + (bod IS NOT NULL)::INT + (ph IS NOT NULL)::INT AS core_parameter_count,
    {_plist(K.CORE_PARAMS)} AS available_core_parameters, {_plist(K.CORE_PARAMS, False)} AS missing_core_parameters
  FROM lstate
), lpred0 AS (
  SELECT *, CASE core_parameter_count WHEN 3 THEN 'Full' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Partial' ELSE 'Insufficient' END AS live_data_confidence,
    list_filter([
      CASE WHEN dissolved_oxygen < 5 THEN 'DO is ' || CAST(dissolved_oxygen AS VARCHAR) || ' (< 5 mg/L)' END,
      CASE WHEN bod > 3 THEN 'BOD is ' || CAST(bod AS VARCHAR) || ' (> 3 mg/L)' END,
      CASE WHEN ph < 6.5 OR ph > 8.5 THEN 'pH is ' || CAST(ph AS VARCHAR) || ' (out of 6.5-8.5)' END
    ], lambda x: x IS NOT NULL) AS lviol,
    CASE WHEN dissolved_oxygen >= 5 THEN 0.0e0 WHEN dissolved_oxygen IS NOT NULL THEN least(100.0e0, greatest(0.0e0, ((5.0e0 - dissolved_oxygen) / 5.0e0) * 100.0e0)) END AS r_do,
    CASE WHEN bod <= 3 THEN 0.0e0 WHEN bod IS NOT NULL THEN least(100.0e0, greatest(0.0e0, ((bod - 3.0e0) / 47.0e0) * 100.0e0)) END AS r_bod,
    CASE WHEN ph >= 6.5 AND ph <= 8.5 THEN 0.0e0 WHEN ph < 6.5 THEN least(100.0e0, greatest(0.0e0, ((6.5e0 - ph) / 6.5e0) * 100.0e0))
      WHEN ph > 8.5 THEN least(100.0e0, greatest(0.0e0, ((ph - 8.5e0) / 5.5e0) * 100.0e0)) END AS r_ph
  FROM lstate2
), lpred1 AS (
  SELECT *,
    ((CASE WHEN r_do IS NOT NULL THEN 0.4e0 ELSE 0.0e0 END) + (CASE WHEN r_bod IS NOT NULL THEN 0.4e0 ELSE 0.0e0 END))
      + (CASE WHEN r_ph IS NOT NULL THEN 0.2e0 ELSE 0.0e0 END) AS w_total
  FROM lpred0
), lpred AS (
  SELECT *,
    CASE WHEN core_parameter_count < 3 THEN 'Insufficient_Data' WHEN len(lviol) > 0 THEN 'Non-Compliant' ELSE 'Compliant' END AS live_strict_compliance_label,
    CASE WHEN core_parameter_count = 0 THEN 'Insufficient_Data'
      WHEN core_parameter_count = 3 THEN CASE WHEN len(lviol) > 0 THEN 'Non-Compliant' ELSE 'Compliant' END
      WHEN len(lviol) > 0 THEN 'Non-Compliant_Based_On_Available_Parameters'
      ELSE 'Compliant_Based_On_Available_Parameters' END AS live_available_compliance_label,
    CASE WHEN len(lviol) > 0 THEN array_to_string(lviol, ' | ') ELSE 'None' END AS live_violation_reasons,
    CAST(len(lviol) AS INTEGER) AS live_violation_count,
    CASE WHEN core_parameter_count = 3 THEN 'High' WHEN core_parameter_count = 2 THEN 'Medium' ELSE 'Low' END AS live_rule_confidence,
    CASE WHEN core_parameter_count = 3 THEN 'Full DO/BOD/pH compliance'
      WHEN core_parameter_count > 0 THEN 'Partial compliance based on available core parameters'
      ELSE 'Insufficient for compliance' END AS live_compliance_scope,
    0.6e0 * (coalesce(CASE WHEN core_parameter_count > 0 THEN (coalesce(r_do * (0.4e0 / w_total), 0.0e0)
        + coalesce(r_bod * (0.4e0 / w_total), 0.0e0)) + coalesce(r_ph * (0.2e0 / w_total), 0.0e0) END, 50.0e0) / 100.0e0)
      + 0.4e0 * (((station_id * 7919 + day(latest_timestamp) * 104729 + 42) % 1000) / 1000.0e0) AS live_ml_non_compliance_probability,
    CASE core_parameter_count WHEN 3 THEN 'High confidence: DO, BOD, and pH are available.'
      WHEN 2 THEN 'Medium confidence: one core parameter is missing.'
      ELSE 'Low confidence: two or more core parameters are missing.' END AS ml_prediction_confidence_note
  FROM lpred1
), lp AS (
  SELECT *, CAST(live_ml_non_compliance_probability >= 0.5 AS INTEGER) AS live_ml_predicted_non_compliant,
    CASE WHEN live_ml_non_compliance_probability >= 0.5 THEN 'Non-Compliant' ELSE 'Compliant' END AS live_ml_predicted_compliance_label,
    latest_timestamp < (SELECT max(timestamp) FROM rl) - INTERVAL 24 HOUR AS is_stale
  FROM lpred
)
"""

_ALERTS = [
    ("is_stale", "'Live Stale Data Alert'", "'Warning'", "'timestamp'", "strftime(latest_timestamp, '%Y-%m-%d %H:%M:%S')",
     "'Live data is older than 24 hours.'", "'Check station connectivity and API status.'"),
    ("ph < 6.5", "'Live pH Acidic Alert'", "CASE WHEN ph >= 6.0 THEN 'Warning' ELSE 'High' END", "'ph'", fmt_short_sql("ph"),
     "'pH is ' || " + fmt_short_sql("ph") + " || ', below safe minimum of 6.5.'", "'Inspect nearby discharge source.'"),
    ("ph > 8.5", "'Live pH Alkaline Alert'", "CASE WHEN ph <= 9.0 THEN 'Warning' ELSE 'High' END", "'ph'", fmt_short_sql("ph"),
     "'pH is ' || " + fmt_short_sql("ph") + " || ', above safe maximum of 8.5.'", "'Inspect nearby discharge source.'"),
    ("dissolved_oxygen < 5", "'Live DO Alert'", "CASE WHEN dissolved_oxygen >= 3 THEN 'High' ELSE 'Severe' END",
     "'dissolved_oxygen'", fmt_short_sql("dissolved_oxygen"),
     "'DO is ' || " + fmt_short_sql("dissolved_oxygen") + " || ', below required minimum of 5 mg/L.'",
     "'Escalate for field verification.'"),
    ("bod > 3", "'Live BOD Alert'", "CASE WHEN bod <= 6 THEN 'High' ELSE 'Severe' END", "'bod'", fmt_short_sql("bod"),
     "'BOD is ' || " + fmt_short_sql("bod") + " || ', above required maximum of 3 mg/L.'", "'Escalate for field verification.'"),
    ("core_parameter_count > 0 AND core_parameter_count < 3", "'Live Missing Core Parameter Alert'", "'Info'",
     "'core_parameters'", "missing_core_parameters",
     "'Missing critical regulatory parameters: ' || missing_core_parameters || '.'",
     "'Fetch missing DO/BOD live feeds if available.'"),
    ("live_ml_predicted_compliance_label = 'Non-Compliant'", "'Live ML Non-Compliance Alert'",
     "CASE WHEN live_ml_non_compliance_probability > 0.8 THEN 'High' ELSE 'Warning' END", "'ML Model'",
     "coalesce(" + fmt2_sql("live_ml_non_compliance_probability") + ", 'Unknown')",
     "'Machine learning model predicts non-compliance based on available features.'",
     "'Repeat sampling to confirm compliance.'"),
]

_ANY = " OR ".join(f"coalesce({a[0]}, false)" for a in _ALERTS)
_SEL = " UNION ALL ".join(
    f"SELECT station_id, station_name, latest_timestamp AS timestamp, {k} AS alert_type, {sev} AS severity, "
    f"{par} AS parameter, {val} AS value, {rea} AS reason, {act} AS recommended_action FROM lp WHERE {cond}"
    for cond, k, sev, par, val, rea, act in _ALERTS) + f""" UNION ALL
SELECT station_id, station_name, latest_timestamp, 'Normal Status', 'Normal', 'All', 'OK',
  'All parameters within safe limits.', 'Continue monitoring.' FROM lp
WHERE NOT ({_ANY}) AND core_parameter_count = 3 AND live_strict_compliance_label = 'Compliant'"""

ALERTS = LIVE + f""", la AS ({_SEL})
SELECT substr(sha256(CAST(station_id AS VARCHAR) || '|' || alert_type || '|' || strftime(timestamp, '%Y-%m-%d %H:%M:%S')), 1, 16)
  AS live_alert_id, * FROM la"""

_SECS = "((epoch_us((SELECT max(timestamp) FROM rl)) - epoch_us(latest_timestamp)) / 1000000.0e0)"
_HRS = f"({_SECS} / 3600.0e0)"

_DRV = "BOD, dissolved_oxygen, pH, temperature, conductivity"


def _rule_parts():
    ph, do, bod = fmt_short_sql("ph"), fmt_short_sql("dissolved_oxygen"), fmt_short_sql("bod")
    return ("list_filter(["
            f"CASE WHEN ph >= 6.5 AND ph <= 8.5 THEN 'pH is ' || {ph} || ', within the safe range 6.5-8.5.' "
            f"WHEN ph IS NOT NULL THEN 'pH is ' || {ph} || ', outside the safe range 6.5-8.5.' END, "
            f"CASE WHEN dissolved_oxygen >= 5 THEN 'DO is ' || {do} || ' mg/L, meeting the >=5 mg/L requirement.' "
            f"WHEN dissolved_oxygen IS NOT NULL THEN 'DO is ' || {do} || ' mg/L, violating the >=5 mg/L requirement.' END, "
            f"CASE WHEN bod <= 3 THEN 'BOD is ' || {bod} || ' mg/L, meeting the <=3 mg/L requirement.' "
            f"WHEN bod IS NOT NULL THEN 'BOD is ' || {bod} || ' mg/L, violating the <=3 mg/L requirement.' END"
            "], lambda x: x IS NOT NULL)")


FINAL_EXPL = f"""CASE WHEN core_parameter_count = 3 THEN 'Station ' || station_name || ' is classified ' || live_ml_predicted_compliance_label
      || ' by rule and ML. ' || replace(live_violation_reasons, ' | ', ' and ')
      || '. The prediction has high confidence because DO, BOD, and pH are available. Top model drivers are {_DRV}.'
    WHEN core_parameter_count > 0 THEN 'Latest live data indicates ' || rule || ' However, '
      || replace(missing_core_parameters, '|', ', ') || ' are missing, so full regulatory compliance cannot be confirmed. '
      || 'The ML model provides a limited-confidence estimate because key regulatory features are unavailable.'
    ELSE 'No core parameters (DO, BOD, pH) are available in the live feed. Cannot assess compliance.' END"""

SQL = {
    "str_param_canon": LIVE + "SELECT event_id, parameter_raw_name, parameter FROM rl",
    "live_numeric_flag": LIVE + "SELECT event_id, value, value_numeric, is_numeric_value FROM rl",
    "win_latest": LIVE + "SELECT station_id, parameter, latest_timestamp, latest_value, latest_value_text FROM latest",
    "win_latest_station": LIVE + "SELECT * FROM meta",
    "piv_live_wide": LIVE + "SELECT * FROM wide",
    "jn_live_meta": LIVE + """SELECT station_id, station_no, station_name, state, latest_timestamp, season,
  dissolved_oxygen, bod, ph, temperature, conductivity FROM lstate""",
    "core_conf": LIVE + """SELECT station_id, available_live_parameters, missing_model_features, core_parameter_count,
  available_core_parameters, missing_core_parameters, live_data_confidence FROM lp""",
    "lbl_live": LIVE + """SELECT station_id, live_available_compliance_label, live_strict_compliance_label,
  live_violation_reasons, live_violation_count, live_rule_confidence, live_compliance_scope FROM lp""",
    "note_conf": LIVE + "SELECT station_id, core_parameter_count, ml_prediction_confidence_note FROM lp",
    "alr_live": ALERTS,
    "st_latest_ts": LIVE + """SELECT greatest((SELECT max(timestamp) FROM rl), (SELECT max(latest_timestamp) FROM lstate))
  AS latest_sensor_timestamp""",
    "st_coverage": LIVE + """
SELECT parameter, count(*) AS record_count, count(DISTINCT station_name) AS station_count,
  max(timestamp) AS latest_timestamp, count_if(is_numeric_value) AS non_null_value_count,
  min(value_numeric) FILTER (WHERE is_numeric_value) AS min_value,
  max(value_numeric) FILTER (WHERE is_numeric_value) AS max_value,
  CAST(sum(CAST(value_numeric AS DECIMAL(38, 9))) FILTER (WHERE is_numeric_value) AS DOUBLE)
    / count(value_numeric) FILTER (WHERE is_numeric_value) AS mean_value
FROM rl GROUP BY parameter""",
    "st_matrix": LIVE + """
, lm AS (SELECT station_name, parameter, """ + _last("value") + """ AS v FROM rl GROUP BY station_name, parameter)
SELECT station_name, """ + ", ".join(f"max(CASE WHEN parameter = '{p}' THEN v END) AS {p}" for p in LIVE_PARAMS)
    + " FROM lm GROUP BY station_name",
    "st_stale": LIVE + f"""
SELECT station_id, latest_timestamp, {fmt_short_sql(_HRS)} AS age_hours_text,
  CASE WHEN latest_timestamp IS NULL THEN 'Not available'
    WHEN {_HRS} < 1 THEN CAST(CAST(floor({_SECS} / 60) AS BIGINT) AS VARCHAR) || ' minutes old'
    WHEN {_HRS} < 24 THEN {fmt1_sql(_HRS)} || ' hours old'
    ELSE {fmt1_sql(_HRS + ' / 24.0e0')} || ' days old' END AS age_text,
  {_HRS} > 24 AS is_stale_24h, {_HRS} > 6 AS warn_6h
FROM meta""",
    "xp_live": LIVE + f"""
, rp AS (SELECT *, {_rule_parts()} AS parts FROM lp)
, rx AS (SELECT *, CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' ') ELSE 'No core parameter rules could be evaluated.' END AS rule FROM rp)
SELECT station_id, station_name, latest_timestamp, rule AS live_rule_explanation,
  'The ML model predicts this station is ' || live_ml_predicted_compliance_label
    || '. The strongest global drivers for the model are generally: {_DRV}.' AS live_model_explanation,
  '{_DRV}' AS live_xai_top_drivers,
  CASE WHEN missing_core_parameters <> 'None' THEN 'Warning: ' || replace(missing_core_parameters, '|', ', ')
    || ' are missing from the live feed. Full DO/BOD/pH compliance cannot be determined from this live record.'
    ELSE 'No major missing core parameters for this station.' END AS live_missing_data_explanation,
  {FINAL_EXPL} AS live_final_explanation
FROM rx""",
}
