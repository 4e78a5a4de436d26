"""Oracle SQL: remaining rules, explanations, sets, table sources, serving."""

from .base import WITH_BASE
from .live_sql import LIVE, _ANY, _SEL, fmt2_sql
from .profile_sql import EXPANDED, LAB

FEAT = ["dissolved_oxygen", "bod", "ph", "temperature", "conductivity"]
ALLCOLS = ["source_file", "station_id", "station_name", "river_name", "state_name", "basin", "sampling_date", "month_no",
           "month", "year"] + FEAT + ["n_readings", "available_compliance_label", "strict_compliance_label",
           "core_parameter_count", "available_compliance_parameters", "missing_required_parameters", "label_confidence",
           "violation_reasons", "violation_count", "risk_score", "risk_confidence", "risk_category", "target"]


def cat_sql(x):
    return (f"CASE WHEN {x} IS NULL THEN 'Unknown' WHEN {x} <= 25 THEN 'Low Risk' WHEN {x} <= 50 THEN 'Moderate Risk' "
            f"WHEN {x} <= 75 THEN 'High Risk' ELSE 'Severe Risk' END")


RULE_EXPL = f"""CASE WHEN len(list_filter([
      CASE WHEN dissolved_oxygen < 5 THEN 'x' END, CASE WHEN bod > 3 THEN 'x' END,
      CASE WHEN ph < 6.5 OR ph > 8.5 THEN 'x' END], lambda x: x IS NOT NULL)) > 0
    THEN 'Non-compliant because ' || array_to_string(list_filter([
      CASE WHEN dissolved_oxygen < 5 THEN 'DO is ' || {fmt2_sql('dissolved_oxygen')} || ' mg/L (below 5)' END,
      CASE WHEN bod > 3 THEN 'BOD is ' || {fmt2_sql('bod')} || ' mg/L (above 3)' END,
      CASE WHEN ph < 6.5 OR ph > 8.5 THEN 'pH is ' || {fmt2_sql('ph')} || ' (outside 6.5-8.5)' END], lambda x: x IS NOT NULL), '; ')
      || '. Risk category: ' || coalesce(risk_category, 'Unknown') || '.'
  WHEN available_compliance_label = 'Compliant' THEN 'Compliant – all measured core parameters within safe limits. Risk category: '
      || coalesce(risk_category, 'Unknown') || '.'
  WHEN dissolved_oxygen IS NULL AND bod IS NULL AND ph IS NULL THEN 'Insufficient core data (DO, BOD, pH all missing) to evaluate compliance.'
  ELSE 'Label is ''' || coalesce(available_compliance_label, 'Unknown') || '''. Measured core values are within limits but data may be partial.' END"""

DRIVERS = "['bod', 'dissolved_oxygen', 'ph', 'temperature', 'conductivity']"
LOCAL = f"""
, loc AS (
  SELECT *, {RULE_EXPL} AS rule_based_explanation,
    list_slice(list_distinct_ordered, 1, 5) AS drv,
    coalesce(ml_predicted_compliance_label, available_compliance_label, 'Unknown') AS pred
  FROM (SELECT *, list_filter(list_concat(vp, {DRIVERS}), lambda x, i: list_position(list_concat(vp, {DRIVERS}), x) = i)
          AS list_distinct_ordered
        FROM (SELECT *, list_filter([CASE WHEN dissolved_oxygen < 5 THEN 'dissolved_oxygen' END,
                  CASE WHEN bod > 3 THEN 'bod' END, CASE WHEN ph < 6.5 OR ph > 8.5 THEN 'ph' END], lambda x: x IS NOT NULL) AS vp
              FROM predictions))
)
"""
LOCAL_COLS = """station_id, station_name, river_name, state_name, sampling_date, month, pred AS predicted_compliance_label,
  risk_score, risk_category, violation_reasons, label_confidence, array_to_string(drv, ', ') AS top_5_model_drivers,
  rule_based_explanation,
  'Station ' || coalesce(station_name, '?') || ' is predicted ' || pred || '. ' || rule_based_explanation
    || ' Top model drivers: ' || array_to_string(drv, ', ') || '.' AS final_human_readable_explanation"""

MODE = """CASE WHEN core_parameter_count = 3 THEN 'Core Rule + ML Model'
  WHEN temperature IS NOT NULL OR conductivity IS NOT NULL THEN 'Auxiliary-Only ML Model' ELSE 'Insufficient Data' END"""
RULE_LABEL = """CASE WHEN core_parameter_count = 0 THEN 'Insufficient Data' WHEN violation_count > 0 THEN 'Non-Compliant'
  ELSE 'Compliant' END"""

FILES = WITH_BASE + """
, files AS (
  SELECT station_id,
    CASE WHEN station_id % 2 = 0 THEN 'cpcb_' ELSE 'wq_' END
    || CASE WHEN station_id % 2 = 0 THEN ['as', 'ar', 'ka', 'jk', 'ap', 'xx'][station_id % 6 + 1]
            ELSE '_' || ['as', 'ar', 'ka', 'jk', 'ap', 'xx'][station_id % 6 + 1] || '_' END
    || '_' || ['biological', 'chemical', 'physical', 'mixed'][station_id % 4 + 1] || '_' || CAST(station_id AS VARCHAR) || '.csv'
      AS file_name
  FROM stations
), inferred AS (
  SELECT station_id, file_name,
    CASE WHEN contains(lower(file_name), '_as_') OR contains(lower(file_name), 'cpcb_as') THEN 'Assam'
      WHEN contains(lower(file_name), '_ar_') OR contains(lower(file_name), 'cpcb_ar') THEN 'Arunachal Pradesh'
      WHEN contains(lower(file_name), '_ka_') OR contains(lower(file_name), 'cpcb_ka') THEN 'Karnataka'
      WHEN contains(lower(file_name), '_jk_') OR contains(lower(file_name), 'cpcb_jk') THEN 'Jammu and Kashmir'
      WHEN contains(lower(file_name), '_ap_') OR contains(lower(file_name), 'cpcb_ap') THEN 'Andhra Pradesh'
      ELSE 'Unknown' END AS inferred_state,
    CASE WHEN contains(lower(file_name), 'biological') THEN 'biological' WHEN contains(lower(file_name), 'chemical') THEN 'chemical'
      WHEN contains(lower(file_name), 'physical') THEN 'physical' ELSE 'mixed/unknown' END AS parameter_group
  FROM files
)
"""

LIVE_ALERTS = LIVE + f", la AS ({_SEL})\n"

SQL = {
    "lbl_expanded": WITH_BASE + """
SELECT station_id, sampling_date,
  coalesce(dissolved_oxygen >= 5, false) AS do_compliant, coalesce(bod <= 3, false) AS bod_compliant,
  coalesce(ph >= 6.5 AND ph <= 8.5, false) AS ph_compliant,
  CASE WHEN n = 0 THEN 'No Target Data' WHEN ok THEN 'Compliant' ELSE 'Non-Compliant' END AS expanded_compliance_label,
  CASE WHEN n = 0 THEN 'Insufficient Data' WHEN n = 1 THEN 'Low' WHEN n = 2 THEN 'Medium' ELSE 'High' END AS expanded_label_confidence,
  CASE WHEN n = 3 THEN CASE WHEN ok THEN 'Compliant' ELSE 'Non-Compliant' END ELSE 'Unknown' END AS expanded_strict_label
FROM (SELECT *, (dissolved_oxygen IS NOT NULL)::INT + (bod IS NOT NULL)::INT + (ph IS NOT NULL)::INT AS n,
        (dissolved_oxygen IS NULL OR coalesce(dissolved_oxygen >= 5, false)) AND (bod IS NULL OR coalesce(bod <= 3, false))
        AND (ph IS NULL OR coalesce(ph >= 6.5 AND ph <= 8.5, false)) AS ok FROM samples)""",
    "rsk_repair": WITH_BASE + f"""
SELECT station_id, sampling_date, risk_score_in, risk_category_in, coalesce(risk_score_in, risk_score) AS risk_score,
  CASE WHEN risk_score_in IS NULL THEN {cat_sql('risk_score')}
    WHEN risk_category_in IS NULL OR risk_category_in = 'Unknown' THEN {cat_sql('risk_score_in')}
    ELSE risk_category_in END AS risk_category
FROM (SELECT *, CASE WHEN station_id % 4 <> 0 THEN risk_score END AS risk_score_in,
        CASE WHEN station_id % 4 = 1 THEN 'Unknown' ELSE risk_category END AS risk_category_in FROM labelled_risk)""",
    "rsk_prob": WITH_BASE + f"""
SELECT station_id, sampling_date, prob_risk_score, {cat_sql('prob_risk_score')} AS prob_risk_category,
  CASE WHEN p IS NULL THEN 'Medium' WHEN p >= 0.8 OR p <= 0.2 THEN 'High'
    WHEN (p > 0.2 AND p < 0.4) OR (p > 0.6 AND p < 0.8) THEN 'Medium' ELSE 'Low' END AS prob_confidence
FROM (SELECT *, CASE WHEN p IS NOT NULL THEN p * 100.0e0 WHEN predicted_non_compliant = 1 THEN 75.0e0 ELSE 25.0e0 END AS prob_risk_score
      FROM (SELECT *, CASE WHEN station_id % 7 <> 0 THEN ml_non_compliance_probability END AS p FROM predictions))""",
    "rsk_action": WITH_BASE + """
SELECT station_id, sampling_date, risk_category,
  CASE risk_category WHEN 'Severe Risk' THEN 'Immediate field inspection and source tracking.'
    WHEN 'High Risk' THEN 'Inspect nearby discharge source and repeat sampling.'
    WHEN 'Moderate Risk' THEN 'Continue monitoring and verify trend.'
    WHEN 'Low Risk' THEN 'Continue normal monitoring.' ELSE 'Insufficient data for recommendation.' END AS recommended_action
FROM labelled_risk""",
    "mode_route": WITH_BASE + f"SELECT station_id, sampling_date, {MODE} AS prediction_mode, {RULE_LABEL} AS rule_label FROM labelled_risk",
    "xp_rule": WITH_BASE + f"SELECT station_id, sampling_date, {RULE_EXPL} AS rule_based_explanation FROM labelled_risk",
    "xp_local": WITH_BASE + LOCAL + f"SELECT {LOCAL_COLS} FROM loc",
    "xp_sample": WITH_BASE + LOCAL + f"""SELECT {LOCAL_COLS} FROM loc
ORDER BY (station_id * 7919 + day(sampling_date) * 104729 + 42) % 1000, station_id, sampling_date LIMIT 100""",
    "xp_manual": WITH_BASE + f"""
SELECT station_id, sampling_date,
  CASE WHEN mode = 'Auxiliary-Only ML Model' THEN 'This prediction is generated using auxiliary water-quality parameters only. Rule-based compliance was not evaluated because pH, DO, and BOD were not provided.'
    WHEN rl = 'Insufficient Data' THEN 'Insufficient core parameters to determine compliance.'
    WHEN len(parts) = 0 AND rl = 'Compliant' THEN 'All available core parameters are within acceptable limits.'
    ELSE array_to_string(parts, ' ') END AS manual_explanation
FROM (SELECT *, {MODE} AS mode, {RULE_LABEL} AS rl, list_filter([
    CASE WHEN ph < 6.5 THEN 'pH is acidic and below the acceptable 6.5–8.5 range.'
         WHEN ph > 8.5 THEN 'pH is alkaline and above the acceptable 6.5–8.5 range.' END,
    CASE WHEN dissolved_oxygen < 5 THEN 'Dissolved Oxygen is below 5 mg/L, indicating poor oxygen availability for aquatic life.' END,
    CASE WHEN bod > 3 THEN 'BOD is above 3 mg/L, suggesting high organic pollution load.' END], lambda x: x IS NOT NULL) AS parts
  FROM labelled_risk)""",
    "top_contrib": WITH_BASE + """
SELECT station_id, sampling_date, station_name, round(risk_score, 6) AS risk_score, risk_category FROM labelled_risk
ORDER BY risk_score DESC NULLS LAST, station_id, sampling_date LIMIT 10""",
    "set_distinct": WITH_BASE + f"""
, t AS (SELECT *, CAST(available_compliance_label = 'Non-Compliant' AS INTEGER) AS target FROM labelled_risk)
SELECT (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM t GROUP BY ALL_COLUMNS_PLACEHOLDER)) AS full_row_duplicates,
  (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM t GROUP BY {", ".join(FEAT)})) AS feature_duplicates,
  (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM t GROUP BY {", ".join(FEAT)}, target)) AS feature_target_duplicates,
  (SELECT count(*) FROM (SELECT count(DISTINCT target) AS k FROM t GROUP BY {", ".join(FEAT)}) WHERE k > 1) AS label_collisions""",
    "upv_long": EXPANDED + " UNION ALL ".join(
        f"SELECT station_id, sampling_date, '{p}' AS parameter, {p} AS value FROM expanded WHERE {p} IS NOT NULL" for p in FEAT + LAB),
    "jn_state_code": """
SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 'Jammu & Kashmir' WHEN 12 THEN 'Arunachal Pradesh' WHEN 18 THEN 'Assam'
  WHEN 28 THEN 'Andhra Pradesh' WHEN 29 THEN 'Karnataka' ELSE 'Unknown' END AS state_name FROM nation""",
    "src_infer_state": FILES + "SELECT station_id, file_name, inferred_state, parameter_group FROM inferred",
    "std_state_fill": FILES + """
SELECT s.station_id, s.sampling_date, coalesce(CASE WHEN s.station_id % 3 <> 0 THEN s.state_name END,
  CASE WHEN i.inferred_state <> 'Unknown' THEN i.inferred_state END) AS state
FROM samples s LEFT JOIN inferred i ON i.station_id = s.station_id""",
    "src_union": LIVE + """
SELECT station_id, sampling_date, station_name, dissolved_oxygen, bod, ph, temperature, conductivity,
  'nwmp_batch' AS data_origin, 'phase_4' AS integration_phase, NULL::TIMESTAMP AS latest_timestamp,
  NULL::DOUBLE AS nitrate, NULL::DOUBLE AS turbidity FROM samples
UNION ALL
SELECT station_id, NULL::DATE, station_name, dissolved_oxygen, bod, ph, temperature, conductivity, 'live_sensor', NULL,
  latest_timestamp, nitrate, turbidity FROM lstate""",
    "src_split": WITH_BASE + """
SELECT CASE WHEN source_file = 'nwmp_july.csv' THEN 'operational' WHEN regexp_matches(source_file, '(?i)august') THEN 'validation'
  WHEN regexp_matches(source_file, '(?i)sept') THEN 'holdout' END AS dataset, count(*) AS rows FROM samples GROUP BY ALL""",
    "src_hash_dedup": """
SELECT doc_id, content_sha256 FROM (
  SELECT doc_id, sha256(text) AS content_sha256,
    row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r
  FROM documents WHERE source IS NULL OR source <> 'known_upload') WHERE r = 1""",
    "sv_filter": WITH_BASE + """
SELECT station_id, sampling_date, risk_category FROM predictions WHERE month = 'August' AND risk_category = 'High Risk'""",
    "sv_readings": WITH_BASE + """
SELECT station_id, sampling_date, ml_non_compliance_probability, risk_score FROM predictions
ORDER BY ml_non_compliance_probability DESC NULLS LAST, risk_score DESC NULLS LAST, sampling_date DESC""",
    "sv_label_counts": WITH_BASE + "SELECT ml_predicted_compliance_label, count(*) AS count FROM predictions GROUP BY ALL",
    "sv_live_summary": LIVE_ALERTS + """
SELECT count(*) AS live_stations, count_if(live_ml_predicted_compliance_label = 'Non-Compliant') AS non_compliant_ml,
  (SELECT count(*) FROM la WHERE severity = 'Severe') AS severe_alerts,
  (SELECT count(*) FROM la WHERE severity = 'High') AS high_alerts,
  (SELECT count(*) FROM la WHERE severity = 'Normal') AS normal_alerts
FROM lp""",
    "sv_live_validation": LIVE_ALERTS + """
SELECT count(*) AS stations_detected, count(ph) AS ph_records_count, count(dissolved_oxygen) AS do_records_count,
  count(bod) AS bod_records_count, count_if(core_parameter_count = 3) AS rows_with_full_core_parameters,
  count_if(core_parameter_count > 0 AND core_parameter_count < 3) AS rows_with_partial_core_parameters,
  count_if(live_ml_predicted_compliance_label <> 'Unknown') AS model_prediction_success_count,
  count_if(live_ml_predicted_compliance_label = 'Unknown') AS model_prediction_failed_count,
  count_if(live_ml_predicted_compliance_label = 'Compliant') AS predicted_compliant_count,
  count_if(live_ml_predicted_compliance_label = 'Non-Compliant') AS predicted_non_compliant_count,
  (SELECT count(DISTINCT parameter) FROM rl) AS parameters_detected,
  (SELECT count(*) FROM la) AS alerts_generated
FROM lp""",
}
SQL["set_distinct"] = SQL["set_distinct"].replace("ALL_COLUMNS_PLACEHOLDER", ", ".join(ALLCOLS))
assert _ANY
