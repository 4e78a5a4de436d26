"""Oracle SQL: profiles, coverage, EDA, pair flag, use class."""

from .base import WITH_BASE
from .cleaning_sql import station_base_sql, primary_sql
from .standardize_sql import CANON, CANON_NUM

PARAMS = ["dissolved_oxygen", "bod", "ph", "temperature", "conductivity"]
COLS = ["source_file", "station_id", "station_name", "river_name", "state_name", "basin",
        "sampling_date", "month_no", "month", "year"] + PARAMS + ["n_readings"]
LAB = ["nitrate", "fecal_coliform", "total_coliform", "turbidity", "cod", "total_dissolved_solids"]
AUXN = "(" + " + ".join(f"({p} IS NOT NULL)::INT" for p in ["temperature", "conductivity"] + LAB) + ")"
EXPANDED = WITH_BASE + """
, lab AS (SELECT user_id AS station_id, CAST(ts AS DATE) AS sampling_date, """ + ", ".join(
    f"round(avg(CASE WHEN event_id % 13 = {k} THEN value END), 9) AS {p}" for k, p in enumerate(LAB)) + """,
  min(CASE event_id % 17 WHEN 3 THEN 'Clear' WHEN 5 THEN 'Rainy' END) AS weather, min(CASE WHEN event_id % 19 = 7 THEN 'Odour Free' END) AS odour
FROM events GROUP BY ALL)
, expanded AS (SELECT l.*, """ + ", ".join(f"lab.{p}" for p in LAB + ["weather", "odour"]) + """ FROM labelled_risk l
  LEFT JOIN lab ON lab.station_id = l.station_id AND lab.sampling_date = l.sampling_date)
"""

SAFE = WITH_BASE + """
, safe AS (
  SELECT *, CAST(coalesce(ph >= 6.5 AND ph <= 8.5 AND dissolved_oxygen >= 5 AND bod <= 3, false) AS INTEGER) AS is_safe,
    CASE WHEN dissolved_oxygen >= 6 AND bod <= 2 AND temperature * 10.0e0 <= 50 THEN 'Class_A'
      WHEN dissolved_oxygen >= 5 AND bod <= 3 AND temperature * 10.0e0 <= 500 THEN 'Class_B'
      WHEN dissolved_oxygen >= 4 AND bod <= 3 AND temperature * 10.0e0 <= 5000 THEN 'Class_C'
      WHEN dissolved_oxygen >= 4 AND bod <= 3 THEN 'Class_D'
      WHEN ph >= 6 AND ph <= 8.5 AND bod <= 3 AND conductivity <= 2250 THEN 'Class_E'
      ELSE 'Non_Compliant' END AS use_class
  FROM labelled_risk
), paired AS (
  SELECT *, trim(upper(basin)) || '|' || """ + station_base_sql("station_name") + """ AS station_group,
    """ + primary_sql("station_name") + """ AS primary_position
  FROM safe
), pair_flags AS (
  SELECT p.*, g.has_us_ds_pair FROM paired p LEFT JOIN (
    SELECT station_group, year, bool_or(primary_position = 'UPSTREAM') AND bool_or(primary_position = 'DOWNSTREAM') AS has_us_ds_pair
    FROM paired GROUP BY station_group, year) g
  ON g.station_group = p.station_group AND g.year = p.year
)
"""


def _nonnull_long(keys: str = "", params=PARAMS + LAB) -> str:
    k = keys + ", " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return " UNION ALL ".join(
        f"SELECT {k}'{p}' AS parameter, count({p}) AS non_null_count, count(*) AS rows_ FROM expanded{g}"
        for p in params)


def corr_sql(a: str, b: str, t: str) -> str:
    x = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END"
    y = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END"
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


PEARSON_COLS = PARAMS + ["is_safe"]

SQL = {
    "agg_source_summary": WITH_BASE + """
SELECT source_file, count(*) AS row_count, """ + " + ".join(f"(count({c}) > 0)::INT" for c in COLS) + """ AS column_count,
  CAST(min(sampling_date) AS VARCHAR) || ' to ' || CAST(max(sampling_date) AS VARCHAR) AS date_range,
  count(DISTINCT station_name) AS station_count, count(DISTINCT river_name) AS river_count
FROM labelled_risk GROUP BY source_file""",
    "agg_core_coverage": WITH_BASE + """
SELECT source_file,
  round(count(dissolved_oxygen) * 100.0e0 / count(*), 6) AS dissolved_oxygen_available_pct,
  round(count(bod) * 100.0e0 / count(*), 6) AS bod_available_pct,
  round(count(ph) * 100.0e0 / count(*), 6) AS ph_available_pct,
  round(count_if(core_parameter_count = 3) * 100.0e0 / count(*), 6) AS all_three_core_available_pct,
  round(count_if(core_parameter_count >= 2) * 100.0e0 / count(*), 6) AS at_least_two_core_available_pct
FROM labelled_risk GROUP BY source_file""",
    "agg_conf_counts": WITH_BASE + """
SELECT source_file, count_if(label_confidence = 'High') AS high_confidence_count,
  count_if(label_confidence = 'Medium') AS medium_confidence_count,
  count_if(label_confidence = 'Low') AS low_confidence_count,
  count_if(label_confidence = 'Insufficient') AS insufficient_count
FROM labelled_risk GROUP BY source_file""",
    "agg_label_dist": WITH_BASE + """
SELECT source_file, available_compliance_label, count(*) AS count FROM labelled_risk GROUP BY ALL""",
    "agg_risk_dist": WITH_BASE + """
SELECT source_file, risk_category, count(*) AS count FROM labelled_risk GROUP BY ALL""",
    "agg_class_balance": WITH_BASE + """
SELECT available_compliance_label, count(*) AS count, round(count(*) * 100.0e0 / sum(count(*)) OVER (), 6) AS pct
FROM labelled_risk GROUP BY ALL""",
    "agg_missing": WITH_BASE + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
        f"round((count(*) - count({c})) * 100.0e0 / count(*), 6) AS missing_pct FROM labelled_risk" for c in COLS),
    "agg_param_combo": WITH_BASE + """
SELECT available_compliance_parameters, count(*) AS count, round(count(*) * 100.0e0 / sum(count(*)) OVER (), 6) AS pct
FROM labelled_risk GROUP BY ALL""",
    "agg_xcoverage": EXPANDED + """
SELECT source_file, state_name, basin, count(*) AS rows, """ + ", ".join(
        f"round(count({p}) * 100.0e0 / count(*), 6) AS {p}_pct" for p in PARAMS + LAB) + f""",
  round(count_if(core_parameter_count = 3) * 100.0e0 / count(*), 6) AS all_three_core_pct,
  round(count_if(core_parameter_count >= 2) * 100.0e0 / count(*), 6) AS at_least_two_core_pct,
  round(count_if({AUXN} >= 3) * 100.0e0 / count(*), 6) AS at_least_three_aux_pct
FROM expanded GROUP BY ALL""",
    "agg_cov_by": WITH_BASE + """
SELECT 'state' AS dimension, state_name AS value, count(*) AS rows FROM labelled_risk GROUP BY ALL
UNION ALL SELECT 'basin', basin, count(*) FROM labelled_risk GROUP BY ALL""",
    "agg_best_params": EXPANDED + "SELECT parameter, non_null_count FROM (" + _nonnull_long() + ") ORDER BY non_null_count DESC, parameter",
    "agg_baseline": EXPANDED + """
, top_rivers AS (SELECT river_name FROM labelled_risk GROUP BY river_name ORDER BY count(*) DESC, river_name LIMIT 50)
, long AS (""" + " UNION ALL ".join(
        f"SELECT state_name, river_name, '{p}' AS parameter, {p} AS value FROM expanded "
        f"WHERE river_name IN (SELECT river_name FROM top_rivers) AND {p} IS NOT NULL" for p in PARAMS + LAB) + """)
SELECT state_name, river_name, parameter, count(*) AS count,
  round(CAST(sum(CAST(value AS DECIMAL(38, 9))) AS DOUBLE) / count(value), 6) AS mean,
  round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
  round(max(value), 6) AS max
FROM long GROUP BY ALL""",
    "agg_aux_ready": EXPANDED + f"""
SELECT count(*) AS total_rows, count_if(label_confidence IN ('High', 'Medium')) AS rows_with_valid_target,
  count_if({AUXN} >= 3) AS rows_with_3_aux,
  count_if(NOT (label_confidence IN ('High', 'Medium')) AND {AUXN} >= 3) AS rows_no_core_but_aux,
  count(DISTINCT state_name) AS states_represented, count(DISTINCT river_name) AS rivers_represented,
  count(DISTINCT station_name) AS station_count,
  CASE WHEN count_if(label_confidence IN ('High', 'Medium')) < 1000 THEN 'baseline only'
    ELSE 'auxiliary-only model extension' END AS recommended_use
FROM expanded""",
    "agg_shape": WITH_BASE + """
SELECT count(*) AS rows, count(DISTINCT source_file) AS files, count(DISTINCT state_name) AS states,
  count(DISTINCT basin) AS groups, count(DISTINCT station_name) AS stations, count(DISTINCT river_name) AS rivers
FROM labelled_risk""",
    "agg_src_contrib": EXPANDED + """
, nn AS (""" + _nonnull_long("source_file") + """)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY non_null_count DESC, parameter) AS r FROM nn)
SELECT source_file, max(rows_) AS row_count, CAST(sum(non_null_count) AS BIGINT) AS non_null_parameter_count,
  round(max(rows_) * 100.0e0 / sum(max(rows_)) OVER (), 6) AS percentage_of_rows,
  string_agg(CASE WHEN r <= 5 THEN parameter END, ', ' ORDER BY r) AS top_5_available_parameters
FROM ranked GROUP BY source_file""",
    "agg_param_nonnull": EXPANDED + """
SELECT parameter, non_null_count, round(non_null_count * 100.0e0 / rows_, 6) AS non_null_pct,
  CASE WHEN parameter IN ('dissolved_oxygen', 'bod', 'ph') THEN 'core' WHEN parameter IN ('weather', 'odour') THEN 'field-observation/categorical'
    ELSE 'auxiliary' END AS parameter_group,
  parameter IN ('dissolved_oxygen', 'bod', 'ph') AS is_core_parameter,
  parameter NOT IN ('dissolved_oxygen', 'bod', 'ph', 'weather', 'odour') AS is_auxiliary_parameter,
  non_null_count > 0 AND parameter NOT IN ('weather', 'odour') AS include_in_future_ml_flag
FROM (""" + _nonnull_long(params=PARAMS + LAB + ["weather", "odour"]) + ")",
    "agg_numeric_valid": CANON + ", dirty AS (" + " UNION ALL ".join(
        f"SELECT '{p}' AS parameter, {p} AS raw_value FROM canon WHERE {p} IS NOT NULL" for p in CANON_NUM) + r""")
, parsed AS (
  SELECT parameter,
    CASE WHEN raw_value IS NULL OR miss THEN NULL WHEN starts_with(s, '<') AND num IS NOT NULL THEN num / 2.0e0 ELSE num END AS v,
    CASE WHEN raw_value IS NULL THEN '' WHEN miss THEN 'Below detection/Missing'
      WHEN starts_with(s, '<') AND num IS NOT NULL THEN 'Converted <' WHEN num IS NOT NULL THEN '' ELSE 'Parse Error' END AS flag
  FROM (SELECT *, lower(trim(raw_value)) IN ('bdl', 'below detection limit', 'na', '-', 'nil', 'nd',
             'not detectable', '', 'null') AS miss,
        replace(lower(trim(raw_value)), ',', '') AS s,
        TRY_CAST(nullif(regexp_extract(replace(lower(trim(raw_value)), ',', ''), '([-+]?\d*\.?\d+)', 1), '') AS DOUBLE) AS num
      FROM dirty)
)
SELECT parameter, count(v) AS parsed_numeric_count, count_if(flag = 'Parse Error') AS parse_failure_count,
  count_if(starts_with(flag, 'Converted <')) AS less_than_value_count,
  count_if(starts_with(flag, 'Below detection')) AS bdl_value_count, count_if(v < 0) AS negative_value_count,
  count_if((parameter = 'ph' AND (v < 0 OR v > 14)) OR (parameter = 'conductivity' AND v > 500000)) AS extreme_value_count
FROM parsed GROUP BY parameter""",
    "agg_conf_cov": EXPANDED + f"""
SELECT 'rows with all DO+BOD+pH' AS metric, count_if(core_parameter_count = 3) AS count FROM expanded
UNION ALL SELECT 'rows with >=2 core parameters', count_if(core_parameter_count >= 2) FROM expanded
UNION ALL SELECT 'rows with >=1 core parameter', count_if(core_parameter_count >= 1) FROM expanded
UNION ALL SELECT 'rows with >=3 auxiliary parameters', count_if({AUXN} >= 3) FROM expanded""",
    "agg_long_valid": EXPANDED + """
, long AS (""" + " UNION ALL ".join(
        f"SELECT source_file, '{p}' AS parameter, {p} AS value FROM expanded" for p in PARAMS + LAB) + """)
SELECT count(*) AS long_format_row_count, count(DISTINCT parameter) AS unique_parameters,
  count(DISTINCT source_file) AS unique_source_files, count_if(value IS NULL) AS missing_value_count,
  bool_and(parameter IN ('dissolved_oxygen', 'bod', 'ph', 'temperature', 'conductivity', 'nitrate', 'fecal_coliform', 'total_coliform',
    'turbidity', 'cod', 'total_dissolved_solids')) AS all_params_are_real
FROM long""",
    "agg_file_rank": EXPANDED + """
, tot AS (SELECT source_file, CAST(sum(non_null_count) AS BIGINT) AS total_non_null FROM (""" + _nonnull_long("source_file") + """) GROUP BY source_file)
, r AS (SELECT *, row_number() OVER (ORDER BY total_non_null DESC, source_file) AS d,
               row_number() OVER (ORDER BY total_non_null ASC, source_file) AS a FROM tot)
SELECT 'strongest' AS rank_kind, CAST(d AS INTEGER) AS rank, source_file, total_non_null FROM r WHERE d <= 3
UNION ALL SELECT 'weakest', CAST(a AS INTEGER), source_file, total_non_null FROM r WHERE a <= 3""",
    "agg_safe_means": SAFE + "SELECT is_safe, " + ", ".join(
        f"round(CAST(sum(CAST({p} AS DECIMAL(38, 9))) AS DOUBLE) / count({p}), 6) AS {p}" for p in PARAMS)
    + " FROM safe GROUP BY is_safe",
    "agg_spatial_rate": SAFE + """
SELECT primary_position, count(*) AS rows, round(avg(is_safe), 6) AS safe_rate FROM paired GROUP BY ALL""",
    "jn_pair_flag": SAFE + "SELECT station_id, sampling_date, station_group, primary_position, has_us_ds_pair FROM pair_flags",
    "agg_pair_rate": SAFE + """
SELECT primary_position, count(*) AS rows, round(avg(is_safe), 6) AS safe_rate FROM pair_flags
WHERE has_us_ds_pair AND primary_position IN ('UPSTREAM', 'DOWNSTREAM') GROUP BY ALL""",
    "agg_year_rate": SAFE + "SELECT year, round(avg(is_safe), 6) AS safe_rate, count(*) AS rows FROM safe GROUP BY year",
    "agg_threshold_check": SAFE + """
SELECT count_if(use_class IN ('Class_A', 'Class_B', 'Class_C') AND violation_count > 0) AS safe_but_violating,
  count_if(use_class NOT IN ('Class_A', 'Class_B', 'Class_C') AND violation_count = 0 AND core_parameter_count = 3) AS unsafe_but_clean
FROM safe""",
    "lbl_use_class": SAFE + """
SELECT station_id, sampling_date, use_class,
  CASE use_class WHEN 'Class_A' THEN 0 WHEN 'Class_B' THEN 1 WHEN 'Class_C' THEN 2 WHEN 'Class_D' THEN 3
    WHEN 'Class_E' THEN 4 ELSE 5 END AS use_class_code,
  CAST(use_class IN ('Class_A', 'Class_B', 'Class_C') AS INTEGER) AS is_safe_class
FROM safe""",
    "lbl_strict_rule_v2": WITH_BASE + """
SELECT station_id, sampling_date,
  CAST(coalesce(ph >= 6.5 AND ph <= 8.5 AND dissolved_oxygen >= 5 AND bod <= 3, false) AS INTEGER) AS safe_inclusive,
  CAST(coalesce(ph >= 6.5 AND ph <= 8.5 AND dissolved_oxygen > 5 AND bod < 3, false) AS INTEGER) AS safe_strict
FROM labelled_risk""",
    "lbl_class_weight": SAFE + """
, c AS (SELECT use_class, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS class_weight FROM safe GROUP BY use_class)
, b AS (SELECT is_safe, sum(count(*)) OVER () / (2 * count(*)) AS binary_class_weight FROM safe GROUP BY is_safe)
SELECT station_id, sampling_date, s.use_class, round(class_weight, 6) AS class_weight,
  round(binary_class_weight, 6) AS binary_class_weight
FROM safe s JOIN c ON c.use_class = s.use_class JOIN b ON b.is_safe = s.is_safe""",
    "lbl_rule_match": SAFE + """
SELECT is_safe, CAST(violation_count = 0 AS INTEGER) AS rule_is_safe, count(*) AS count FROM safe GROUP BY ALL""",
    "lbl_rule_match_rate": SAFE + """
SELECT count(*) AS rows, round(avg(CAST(is_safe = CAST(violation_count = 0 AS INTEGER) AS INTEGER)), 6) AS match_rate FROM safe""",
    "agg_spatial_rates": SAFE + """
, long AS (SELECT 'primary_position' AS dimension, CAST(primary_position AS VARCHAR) AS value, is_safe FROM pair_flags
  UNION ALL SELECT 'station_group', CAST(station_group AS VARCHAR), is_safe FROM pair_flags
  UNION ALL SELECT 'has_us_ds_pair', CAST(has_us_ds_pair AS VARCHAR), is_safe FROM pair_flags)
SELECT dimension, value, count(*) AS rows, round(avg(is_safe), 6) AS safe_rate FROM long WHERE value IS NOT NULL
  AND dimension IN (SELECT dimension FROM long GROUP BY dimension HAVING count(DISTINCT value) < 25) GROUP BY ALL""",
    "agg_five_number_log": WITH_BASE + """
, long AS (""" + " UNION ALL ".join(
        f"SELECT available_compliance_label, '{p}' AS parameter, ln(1 + {p}) AS v FROM labelled_risk WHERE {p} > -1"
        for p in PARAMS) + """)
SELECT available_compliance_label, parameter, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q1,
  round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS max
FROM long GROUP BY ALL""",
    "agg_describe": WITH_BASE + " UNION ALL ".join(
        f"SELECT '{p}' AS parameter, count({p}) AS count, "
        f"round(CAST(sum(CAST({p} AS DECIMAL(38, 9))) AS DOUBLE) / count({p}), 6) AS mean, round(median({p}), 6) AS median, "
        f"round(stddev_samp({p}), 6) AS std, round(min({p}), 6) AS min, round(max({p}), 6) AS max, "
        f"round(CASE WHEN count({p}) > 2 THEN skewness({p}) END, 6) AS skew FROM labelled_risk" for p in PARAMS),
    "agg_iqr_outliers": WITH_BASE + """
, long AS (""" + " UNION ALL ".join(
        f"SELECT '{p}' AS parameter, {p} AS v FROM labelled_risk WHERE {p} IS NOT NULL" for p in PARAMS) + """)
, b AS (SELECT parameter, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM long GROUP BY parameter)
SELECT b.parameter, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 1.5e0 * (q3 - q1), 6) AS lower_bound,
  round(q3 + 1.5e0 * (q3 - q1), 6) AS upper_bound,
  count_if(v < q1 - 1.5e0 * (q3 - q1) OR v > q3 + 1.5e0 * (q3 - q1)) AS outliers,
  round(count_if(v < q1 - 1.5e0 * (q3 - q1) OR v > q3 + 1.5e0 * (q3 - q1)) * 100.0e0 / count(*), 6) AS outlier_pct
FROM long JOIN b ON b.parameter = long.parameter GROUP BY b.parameter, q1, q3""",
    "agg_five_number": WITH_BASE + """
, long AS (""" + " UNION ALL ".join(
        f"SELECT available_compliance_label, '{p}' AS parameter, {p} AS v FROM labelled_risk WHERE {p} IS NOT NULL"
        for p in PARAMS) + """)
SELECT available_compliance_label, parameter, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q1,
  round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS max
FROM long GROUP BY ALL""",
    "agg_histogram": WITH_BASE + """
, mm AS (SELECT min(ph) AS lo, max(ph) AS hi FROM labelled_risk)
SELECT CAST(least(floor((ph - lo) / nullif(hi - lo, 0) * 20) + 1, 20) AS INTEGER) AS bin,
  round(lo + (least(floor((ph - lo) / (hi - lo) * 20) + 1, 20) - 1) * (hi - lo) / 20, 6) AS bin_start,
  count(*) AS count
FROM labelled_risk, mm WHERE ph IS NOT NULL GROUP BY ALL""",
    "agg_pearson": SAFE + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round({corr_sql(a, b, 'safe')}, 6) AS corr FROM safe" for a, b in _pairs(PEARSON_COLS)),
    "agg_spearman": WITH_BASE + """
, base AS (SELECT * FROM labelled_risk WHERE dissolved_oxygen IS NOT NULL AND bod IS NOT NULL AND ph IS NOT NULL)
, rk AS (SELECT """ + ", ".join(
        f"rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0e0 AS {p}"
        for p in ["dissolved_oxygen", "bod", "ph"]) + """ FROM base)
""" + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round({corr_sql(a, b, 'rk')}, 6) AS corr FROM rk"
                         for a, b in _pairs(["dissolved_oxygen", "bod", "ph"])),
    "agg_violation_counts": WITH_BASE + """
SELECT count_if(dissolved_oxygen < 5) AS do_violations, count_if(bod > 3) AS bod_violations,
  count_if(ph < 6.5 OR ph > 8.5) AS ph_violations, count_if(violation_count = 0) AS no_violation
FROM labelled_risk""",
}
