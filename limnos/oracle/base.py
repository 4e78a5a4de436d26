"""DuckDB oracle: the bindings and rules written once more, independently, in SQL.

``WITH_BASE`` is a chain of CTEs over the pre-registered test tables; an oracle
query is ``WITH_BASE + "SELECT ..."``.  Literals are written as ``1.0e0`` so both
engines compute in binary double (DuckDB reads ``0.4`` as DECIMAL).
"""

INITCAP = ("array_to_string(list_transform(string_split(lower({x}), ' '), "
           "lambda w: upper(w[1]) || w[2:]), ' ')")

WITH_BASE = """
WITH readings AS (
  SELECT event_id, user_id AS station_id, ts,
    CASE event_type WHEN 'error' THEN 'dissolved_oxygen' WHEN 'click' THEN 'bod'
      WHEN 'view' THEN 'ph' WHEN 'purchase' THEN 'temperature' ELSE 'conductivity' END AS parameter,
    CASE event_type WHEN 'error' THEN least(value / 5.0e0, 14.0e0)
      WHEN 'click' THEN value / 20.0e0
      WHEN 'view' THEN 6.0e0 + least(value, 200.0e0) / 40.0e0
      WHEN 'purchase' THEN least(value / 3.0e0, 40.0e0)
      ELSE value * 10.0e0 END AS value
  FROM events
),
daily AS (
  SELECT station_id, CAST(ts AS DATE) AS sampling_date,
    round(avg(CASE WHEN parameter = 'dissolved_oxygen' THEN value END), 9) AS dissolved_oxygen,
    round(avg(CASE WHEN parameter = 'bod' THEN value END), 9) AS bod,
    round(avg(CASE WHEN parameter = 'ph' THEN value END), 9) AS ph,
    round(avg(CASE WHEN parameter = 'temperature' THEN value END), 9) AS temperature,
    round(avg(CASE WHEN parameter = 'conductivity' THEN value END), 9) AS conductivity,
    count(*) AS n_readings
  FROM readings GROUP BY station_id, CAST(ts AS DATE)
),
station_geo AS (
  SELECT d.station_id, n.n_name AS state_name, r.r_name AS basin,
    coalesce(""" + INITCAP.format(x="p.p_name") + """, 'Unnamed') AS river_name,
    'Town ' || CAST(d.station_id // 6 AS VARCHAR) AS town
  FROM (SELECT DISTINCT station_id FROM daily) d
  LEFT JOIN supplier s ON s.s_suppkey = d.station_id % (SELECT count(*) FROM supplier)
  LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN part p ON p.p_partkey = d.station_id // 2
),
stations AS (
  SELECT station_id, state_name, basin, river_name,
    CASE station_id % 6
      WHEN 0 THEN river_name || ' river U/S of ' || town
      WHEN 1 THEN river_name || ' river D/S of ' || town
      WHEN 2 THEN river_name || ' creek near drain at ' || town
      WHEN 3 THEN river_name || ' lake at ' || town
      WHEN 4 THEN river_name || ' well at ' || town
      ELSE river_name || ' at ' || town END AS station_name
  FROM station_geo
),
samples AS (
  SELECT 'nwmp_' || lower(['July', 'August', 'September'][m.month_no]) || '.csv' AS source_file,
    d.station_id, s.station_name, s.river_name, s.state_name, s.basin,
    d.sampling_date, m.month_no, ['July', 'August', 'September'][m.month_no] AS month,
    CAST(year(d.sampling_date) AS INTEGER) AS year,
    d.dissolved_oxygen, d.bod, d.ph, d.temperature, d.conductivity, d.n_readings
  FROM daily d
  CROSS JOIN LATERAL (SELECT CAST(least(floor((day(d.sampling_date) - 1) / 10), 2) + 1 AS INT) AS month_no) m
  LEFT JOIN stations s ON s.station_id = d.station_id
),
rule_parts AS (
  SELECT *,
    (CASE WHEN dissolved_oxygen IS NOT NULL THEN 1 ELSE 0 END
     + CASE WHEN bod IS NOT NULL THEN 1 ELSE 0 END
     + CASE WHEN ph IS NOT NULL THEN 1 ELSE 0 END) AS n_core,
    list_filter([
      CASE WHEN dissolved_oxygen < 5 THEN 'DO (' || CAST(dissolved_oxygen AS VARCHAR) || ' < 5)' END,
      CASE WHEN bod > 3 THEN 'BOD (' || CAST(bod AS VARCHAR) || ' > 3)' END,
      CASE WHEN ph < 6.5 OR ph > 8.5 THEN 'pH (' || CAST(ph AS VARCHAR) || ' not in 6.5-8.5)' END
    ], lambda x: x IS NOT NULL) AS viol,
    list_filter([CASE WHEN dissolved_oxygen IS NOT NULL THEN 'DO' END,
                 CASE WHEN bod IS NOT NULL THEN 'BOD' END,
                 CASE WHEN ph IS NOT NULL THEN 'pH' END], lambda x: x IS NOT NULL) AS avail,
    list_filter([CASE WHEN dissolved_oxygen IS NULL THEN 'DO' END,
                 CASE WHEN bod IS NULL THEN 'BOD' END,
                 CASE WHEN ph IS NULL THEN 'pH' END], lambda x: x IS NOT NULL) AS miss,
    CASE WHEN dissolved_oxygen >= 5 THEN 0.0e0
         WHEN dissolved_oxygen IS NOT NULL THEN least(100.0e0, greatest(0.0e0, ((5.0e0 - dissolved_oxygen) / 5.0e0) * 100.0e0)) END AS r_do,
    CASE WHEN bod <= 3 THEN 0.0e0
         WHEN bod IS NOT NULL THEN least(100.0e0, greatest(0.0e0, ((bod - 3.0e0) / 47.0e0) * 100.0e0)) END AS r_bod,
    CASE WHEN ph >= 6.5 AND ph <= 8.5 THEN 0.0e0
         WHEN ph < 6.5 THEN least(100.0e0, greatest(0.0e0, ((6.5e0 - ph) / 6.5e0) * 100.0e0))
         WHEN ph > 8.5 THEN least(100.0e0, greatest(0.0e0, ((ph - 8.5e0) / 5.5e0) * 100.0e0)) END AS r_ph
  FROM samples
),
risk_parts AS (
  SELECT *,
    ((CASE WHEN r_do IS NOT NULL THEN 0.4e0 ELSE 0.0e0 END)
     + (CASE WHEN r_bod IS NOT NULL THEN 0.4e0 ELSE 0.0e0 END))
     + (CASE WHEN r_ph IS NOT NULL THEN 0.2e0 ELSE 0.0e0 END) AS w_total
  FROM rule_parts
),
labelled AS (
  SELECT source_file, station_id, station_name, river_name, state_name, basin, sampling_date,
    month_no, month, year, dissolved_oxygen, bod, ph, temperature, conductivity, n_readings,
    CASE WHEN n_core = 0 THEN 'Insufficient_Data' WHEN len(viol) > 0 THEN 'Non-Compliant'
         ELSE 'Compliant_Based_On_Available_Parameters' END AS available_compliance_label,
    CASE WHEN n_core < 3 THEN 'Insufficient_Data' WHEN len(viol) > 0 THEN 'Non-Compliant'
         ELSE 'Compliant' END AS strict_compliance_label,
    n_core AS core_parameter_count,
    CASE WHEN len(avail) > 0 THEN array_to_string(avail, ', ') ELSE 'None' END AS available_compliance_parameters,
    CASE WHEN len(miss) > 0 THEN array_to_string(miss, ', ') ELSE 'None' END AS missing_required_parameters,
    CASE n_core WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'Insufficient' END AS label_confidence,
    CASE WHEN len(viol) > 0 THEN array_to_string(viol, '; ') ELSE 'None' END AS violation_reasons,
    CAST(len(viol) AS INTEGER) AS violation_count,
    CASE WHEN n_core > 0 THEN (coalesce(r_do * (0.4e0 / w_total), 0.0e0) + coalesce(r_bod * (0.4e0 / w_total), 0.0e0))
                              + coalesce(r_ph * (0.2e0 / w_total), 0.0e0) END AS risk_score,
    CASE n_core WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'Unknown' END AS risk_confidence
  FROM risk_parts
),
labelled_risk AS (
  SELECT *,
    CASE WHEN risk_score IS NULL THEN 'Unknown' WHEN risk_score <= 25 THEN 'Low Risk'
         WHEN risk_score <= 50 THEN 'Moderate Risk' WHEN risk_score <= 75 THEN 'High Risk'
         ELSE 'Severe Risk' END AS risk_category
  FROM labelled
),
predictions AS (
  SELECT *,
    CAST(ml_non_compliance_probability >= 0.5 AS INTEGER) AS predicted_non_compliant,
    CASE WHEN ml_non_compliance_probability >= 0.5 THEN 'Non-Compliant' ELSE 'Compliant' END AS ml_predicted_compliance_label,
    'Success' AS ml_prediction_status,
    CASE core_parameter_count WHEN 3 THEN 'High confidence: DO, BOD, and pH are available.'
      WHEN 2 THEN 'Medium confidence: one core parameter is missing.'
      ELSE 'Low confidence: two or more core parameters are missing.' END AS ml_prediction_confidence_note
  FROM (SELECT *,
      0.6e0 * (coalesce(risk_score, 50.0e0) / 100.0e0)
      + 0.4e0 * (((station_id * 7919 + day(sampling_date) * 104729 + 42) % 1000) / 1000.0e0)
        AS ml_non_compliance_probability
    FROM labelled_risk)
)
"""
