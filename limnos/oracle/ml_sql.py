"""Oracle SQL: ML slices, splits, metrics on the stand-in score, audits."""

from .cleaning_sql import context_sql, position_sql
from .live_sql import LIVE, fmt_short_sql

FEAT = ["dissolved_oxygen", "bod", "ph", "temperature", "conductivity"]
FEATS = ", ".join(FEAT)

MF = LIVE + f"""
, mf0 AS (
  SELECT *, CAST(available_compliance_label = 'Non-Compliant' AS INTEGER) AS target,
    {position_sql('station_name')} AS station_position_tag, {context_sql('station_name')} AS pollution_context_tag,
    CASE WHEN month(sampling_date) IN (3, 4, 5) THEN 'Summer' WHEN month(sampling_date) IN (6, 7, 8, 9) THEN 'Monsoon'
      WHEN month(sampling_date) IN (10, 11) THEN 'Post-Monsoon' ELSE 'Winter' END AS season,
    (station_id * 7919 + datediff('day', DATE '1970-01-01', CAST(sampling_date AS DATE)) * 104729 + 42) % 1000 AS row_hash
  FROM predictions
  WHERE available_compliance_label IN ('Compliant_Based_On_Available_Parameters', 'Compliant', 'Non-Compliant')
), hashes AS (
  SELECT target, row_hash, sum(n) OVER (PARTITION BY target ORDER BY row_hash) AS upto, sum(n) OVER (PARTITION BY target) AS whole
  FROM (SELECT target, row_hash, count(*) AS n FROM mf0 GROUP BY ALL)
), grp AS (
  SELECT CASE WHEN count(DISTINCT station_name) > 5 THEN 1 WHEN count(DISTINCT river_name) > 5 THEN 2 ELSE 3 END AS level FROM mf0
), mf AS (
  SELECT mf0.* EXCLUDE (row_hash), CASE WHEN upto * 100 <= whole * 80 THEN 'train' ELSE 'test' END AS rsplit,
    CASE WHEN CAST('0x' || substr(md5(coalesce(CASE (SELECT level FROM grp) WHEN 1 THEN station_name WHEN 2 THEN river_name ELSE source_file END, 'Unknown')), 1, 8)
      AS BIGINT) % 100 < 20 THEN 'test' ELSE 'train' END AS gsplit
  FROM mf0 JOIN hashes USING (target, row_hash)
)
"""


def metrics_sql(src: str, with_auc: bool = True) -> str:
    auc = f"""
, rk AS (SELECT target, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0e0 AS r
         FROM {src} WHERE score IS NOT NULL)
, auc AS (SELECT (sum(r * target) - sum(target) * (sum(target) + 1) / 2.0e0) / nullif(sum(target) * (count(*) - sum(target)), 0)
          AS roc_auc FROM rk)""" if with_auc else ""
    return auc + f"""
, cm AS (SELECT count_if(target = 1 AND prediction = 1) AS tp, count_if(target = 0 AND prediction = 1) AS fp,
                count_if(target = 0 AND prediction = 0) AS tn, count_if(target = 1 AND prediction = 0) AS fn FROM {src})
, m AS (SELECT *, coalesce(tp * 1.0e0 / nullif(tp + fp, 0), 0.0e0) AS prec, coalesce(tp * 1.0e0 / nullif(tp + fn, 0), 0.0e0) AS rec,
          coalesce(tn * 1.0e0 / nullif(tn + fp, 0), 0.0e0) AS spec FROM cm)
SELECT tp, fp, tn, fn, round((tp + tn) * 1.0e0 / nullif(tp + tn + fp + fn, 0), 6) AS accuracy,
  round((rec + spec) / 2, 6) AS balanced_accuracy, round(prec, 6) AS precision, round(rec, 6) AS recall,
  round(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0.0e0), 6) AS f1""" + (
        ", round((SELECT roc_auc FROM auc), 6) AS roc_auc" if with_auc else "") + " FROM m"


CORE = ["dissolved_oxygen", "bod", "ph"]
AUX = ["temperature", "conductivity", "nitrate", "fecal_coliform", "total_coliform", "fecal_streptococci", "turbidity", "cod",
       "total_dissolved_solids", "season", "station_position_tag", "pollution_context_tag", "river_name"]
EXTRA = ["risk_score", "violation_count"]
TEXT = {"season", "station_position_tag", "pollution_context_tag", "river_name"}
_PRESENT = set(FEAT) | TEXT | set(EXTRA)
_WORDS = ("compliance label target prediction predicted probability risk_score risk_category violation reason class use_based_class "
          "dissolved_oxygen dissolved_o2 oxygen do_ _do bod b_o_d biochemical ph p_h hydrogen").split()
_OFFERED = {"Core Regulatory Model": CORE + EXTRA, "Extended Clean Model": CORE + AUX + EXTRA, "True Auxiliary-Only Model": AUX + EXTRA}


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


VERDICT = f"""
, offered AS (SELECT * FROM (VALUES {_values([(v, f, int(f in _PRESENT)) for v, fs in _OFFERED.items() for f in fs])}) t(variant, feature, present))
, words AS (SELECT * FROM (VALUES {_values(list(enumerate(_WORDS)))}) t(rank, word))
, first_word AS (SELECT variant, feature, arg_min(word, rank) AS word FROM offered JOIN words ON contains(lower(feature), word) GROUP BY ALL)
, verdict AS (SELECT o.variant, o.feature,
    CASE WHEN present = 0 THEN 'Rejected' WHEN own OR word IS NULL THEN 'Accepted' ELSE 'Rejected (Leakage)' END AS action,
    CASE WHEN present = 0 THEN 'Not in dataframe' WHEN own THEN 'Allowed canonical parameter' WHEN word IS NULL THEN 'Clean'
      ELSE 'Contains leakage keyword: ' || chr(39) || word || chr(39) END AS reason
  FROM (SELECT *, feature IN ('dissolved_oxygen', 'bod', 'ph') AND variant <> 'True Auxiliary-Only Model' AS own FROM offered) o
  LEFT JOIN first_word f ON f.variant = o.variant AND f.feature = o.feature)
"""

_NUMERIC = sorted({f for fs in _OFFERED.values() for f in fs if f in _PRESENT and f not in TEXT})


def _corr(f):
    x = f"CASE WHEN {f} IS NOT NULL THEN CAST({f} AS DOUBLE) END"
    y = f"CASE WHEN {f} IS NOT NULL THEN CAST(target AS DOUBLE) END"
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def _data(features):
    """Non-null rate, correlation and AUC with missing values as the lowest tie group, a row a numeric feature."""
    return f"""
, sf AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, coalesce(CAST({f} AS DOUBLE), '-Infinity'::DOUBLE) AS v, target FROM mf" for f in features)})
, sr AS (SELECT feature, target, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0e0 AS r FROM sf)
, sauc AS (SELECT feature, (sum(r * target) - sum(target) * (sum(target) + 1) / 2.0e0) / nullif(sum(target) * (count(*) - sum(target)), 0) AS auc
           FROM sr GROUP BY feature)
, data AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) * 1.0e0 / count(*) AS non_null_rate, {_corr(f)} AS target_correlation FROM mf" for f in features)}) x
           LEFT JOIN sauc USING (feature))
"""


READY = CORE + AUX

#: Columns of the training table, the numeric ones first.
_FRAME_NUMERIC = ["station_id", "month_no", "year"] + FEAT + [
    "n_readings", "core_parameter_count", "violation_count", "risk_score", "ml_non_compliance_probability", "predicted_non_compliant", "target"]
_FRAME = _FRAME_NUMERIC + [
    "source_file", "station_name", "river_name", "state_name", "basin", "sampling_date", "month", "available_compliance_label",
    "strict_compliance_label", "available_compliance_parameters", "missing_required_parameters", "label_confidence", "violation_reasons",
    "risk_confidence", "risk_category", "ml_predicted_compliance_label", "ml_prediction_status", "ml_prediction_confidence_note",
    "station_position_tag", "pollution_context_tag", "season"]
_KNOWN = """strict_compliance_label available_compliance_label compliance_label is_compliant is_safe violation_reasons violation_count
 risk_score risk_category label_confidence risk_confidence available_compliance_parameters missing_required_parameters class_weight
 binary_class_weight compliance_label_encoded source_file _minmax _zscore _encoded""".split()
_HIDDEN = "do dissolved oxygen bod biochemical ph p_h".split()
_NOT_AUX = _HIDDEN + """minmax zscore scaled normalized encoded label risk score violation confidence available missing class_weight target
 safe prediction predicted category""".split()
_GENERAL = """compliance safe label target violation risk score category confidence class weight encoded minmax zscore scaled normalized
 prediction predicted available missing""".split()


def _has(words):
    return f"len(list_filter({words}, lambda w: contains(feature, w))) > 0"

SQL = {
    "ml_target": MF + "SELECT station_id, sampling_date, target FROM mf",
    "ml_split_random": MF + "SELECT rsplit AS split, target, count(*) AS rows FROM mf GROUP BY ALL",
    "ml_split_group": MF + "SELECT gsplit AS split, target, count(*) AS rows, count(DISTINCT station_id) AS stations FROM mf GROUP BY ALL",
    "ml_dummy": MF + """
, maj AS (SELECT target AS majority_class FROM mf WHERE rsplit = 'train' GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)
, dm AS (SELECT target, CAST((SELECT majority_class FROM maj) AS DOUBLE) AS prediction, 0.5e0 AS score FROM mf WHERE rsplit = 'test')
""" + metrics_sql("dm").replace("SELECT tp, fp", "SELECT (SELECT majority_class FROM maj) AS majority_class, tp, fp", 1),
    "ml_metrics": MF + ", sc AS (SELECT target, CAST(predicted_non_compliant AS DOUBLE) AS prediction, ml_non_compliance_probability AS score FROM mf)"
    + metrics_sql("sc"),
    "ml_confusion": MF.split(", mf AS (")[0] + """
SELECT CASE WHEN available_compliance_label = 'Non-Compliant' THEN 'Non-Compliant' ELSE 'Compliant' END AS rule_label,
  count_if(ml_predicted_compliance_label = 'Compliant') AS "Compliant",
  count_if(ml_predicted_compliance_label = 'Non-Compliant') AS "Non-Compliant"
FROM predictions WHERE available_compliance_label <> 'Insufficient_Data' GROUP BY 1""",
    "ml_agreement": LIVE + """
, ag AS (SELECT *, CAST(available_compliance_label = 'Non-Compliant' AS INTEGER) = predicted_non_compliant AS agree
         FROM predictions WHERE available_compliance_label <> 'Insufficient_Data')
SELECT count(*) AS valid_rows, count_if(agree) AS agreements, round(count_if(agree) / count(*), 6) AS agreement_rate,
  count_if(NOT agree) AS disagreements FROM ag""",
    "ml_disagree": LIVE + """
SELECT station_id, sampling_date, available_compliance_label, ml_predicted_compliance_label,
  'Rule says ' || available_compliance_label || ' but model predicts ' || ml_predicted_compliance_label
    || ' (violations: ' || violation_reasons || ').' AS disagreement_explanation
FROM predictions WHERE available_compliance_label <> 'Insufficient_Data'
  AND CAST(available_compliance_label = 'Non-Compliant' AS INTEGER) <> predicted_non_compliant""",
    "ml_pred_summary": LIVE + """
SELECT ml_predicted_compliance_label, count(*) AS rows, round(min(ml_non_compliance_probability), 6) AS min_probability,
  round(avg(ml_non_compliance_probability), 6) AS mean_probability, round(max(ml_non_compliance_probability), 6) AS max_probability
FROM predictions GROUP BY ALL
UNION ALL SELECT 'Total', count(*), round(min(ml_non_compliance_probability), 6), round(avg(ml_non_compliance_probability), 6),
  round(max(ml_non_compliance_probability), 6) FROM predictions""",
    "ml_conf_note_dist": LIVE + "SELECT ml_prediction_confidence_note, count(*) AS count FROM predictions GROUP BY ALL",
    "ml_readiness": MF + " UNION ALL ".join(
        (f"SELECT '{f}' AS expected_feature, true AS present_in_raw, count({f}) AS non_null_count, "
         f"round(count({f}) * 100.0e0 / count(*), 6) AS coverage_pct, "
         f"{fmt_short_sql(f'min({f})', 9) if f in FEAT else f'min({f})'} AS sample_value_raw FROM mf")
        if f in _PRESENT else
        (f"SELECT '{f}', false, CAST(0 AS BIGINT), 0.0e0, CAST(NULL AS VARCHAR)") for f in READY),
    "ml_variant_table": "WITH one AS (SELECT 1)" + VERDICT + "SELECT feature, " + ", ".join(
        f"max(CASE WHEN variant = '{v}' AND action = 'Accepted' THEN 'Yes' ELSE 'No' END) AS \"{v}\"" for v in _OFFERED) + " FROM verdict GROUP BY feature",
    "ml_leak_guard": MF + VERDICT + f"""
, names AS (SELECT variant, feature, action, reason FROM verdict)
{_data(_NUMERIC)}
SELECT n.feature, n.variant, n.action, n.reason, round(d.non_null_rate, 6) AS non_null_rate,
  round(d.target_correlation, 6) AS target_correlation, round(d.auc, 6) AS single_feature_auc
FROM names n LEFT JOIN data d ON d.feature = n.feature""",
    "ml_feature_audit": MF + _data(_FRAME_NUMERIC) + f"""
, cols AS (SELECT unnest({_FRAME}) AS feature)
, lists AS (SELECT 'Full Model' AS experiment, feature FROM cols WHERE NOT ({_has(_KNOWN)})
  UNION ALL SELECT 'Ablation Model', feature FROM cols WHERE NOT ({_has(_KNOWN)}) AND feature NOT IN ('dissolved_oxygen', 'bod', 'ph')
  UNION ALL SELECT 'True Auxiliary Model', feature FROM cols WHERE NOT ({_has(_NOT_AUX)}) AND ({_has(AUX)}))
, warned AS (SELECT experiment, feature, CASE WHEN {_has(_GENERAL)} THEN 'General Leakage'
    WHEN experiment <> 'Full Model' AND ({_has(_HIDDEN)}) THEN 'Hidden Core Leakage' END AS leakage_warning FROM lists)
SELECT w.feature, experiment, leakage_warning, round(d.non_null_rate, 6) AS non_null_rate,
  round(d.target_correlation, 6) AS target_correlation, round(d.auc, 6) AS single_feature_auc
FROM warned w LEFT JOIN data d ON d.feature = w.feature WHERE leakage_warning IS NOT NULL""",
    "ml_dup_audit": MF + f"""
, d AS (SELECT rsplit, target, {FEATS} FROM mf)
SELECT (SELECT count(*) FROM d) AS total_rows,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM d GROUP BY target, {FEATS})) AS full_row_duplicates,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM d GROUP BY {FEATS})) AS feature_duplicates,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM d GROUP BY {FEATS}, target)) AS feature_target_duplicates,
  (SELECT count(*) FROM (SELECT count(DISTINCT target) AS k FROM d GROUP BY {FEATS}) WHERE k > 1) AS label_collisions,
  (SELECT count(*) FROM (SELECT {FEATS} FROM d WHERE rsplit = 'train' INTERSECT SELECT {FEATS} FROM d WHERE rsplit = 'test'))
    AS train_test_contamination""",
    "jn_train_test_overlap": MF + f"SELECT {FEATS} FROM mf WHERE rsplit = 'train' INTERSECT SELECT {FEATS} FROM mf WHERE rsplit = 'test'",
    "ml_score_live": LIVE + """
SELECT station_id, core_parameter_count,
  CAST(""" + " + ".join(f"({f} IS NULL)::INT" for f in FEAT) + """ AS INTEGER) AS missing_feature_count,
  concat_ws('|', """ + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in FEAT) + """) AS missing_features,
  CASE WHEN core_parameter_count = 3 THEN live_strict_compliance_label ELSE 'Unknown' END AS live_ml_predicted_compliance_label,
  CASE WHEN core_parameter_count = 3 THEN CAST(live_strict_compliance_label = 'Non-Compliant' AS DOUBLE) END AS live_ml_predicted_non_compliant,
  'Failed' AS live_ml_prediction_status, core_parameter_count = 3 AS live_ml_fallback_used,
  CASE WHEN core_parameter_count = 3 THEN 'Fallback rule-based estimate used because ML inference failed.' END AS live_ml_fallback_reason
FROM lp""",
}
