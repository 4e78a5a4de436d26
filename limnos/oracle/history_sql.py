"""Oracle SQL: historical baseline matching (brute force comparisons) and alert enrichment."""

from .cleaning_sql import tokens_sql
from .extra_sql import RULE_EXPL
from .live_sql import fmt2_sql
from .monitoring_sql import MON

PARAMS = ["dissolved_oxygen", "bod", "ph", "temperature", "conductivity"]
HPARAMS = ["dissolved_oxygen", "bod", "ph", "temperature", "conductivity", "total_dissolved_solids"]


def _mean(c):
    return f"CAST(sum(CAST({c} AS DECIMAL(38, 9))) AS DOUBLE) / nullif(count({c}), 0)"


def _jac(a, b):
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0e0 "
            f"ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END")


HIST = MON + """
, top_rivers AS (SELECT river_name FROM predictions GROUP BY river_name ORDER BY count(*) DESC, river_name LIMIT 50)
, long AS (""" + " UNION ALL ".join(
    f"SELECT state_name, river_name, '{p}' AS parameter, {p} AS value FROM predictions "
    f"WHERE river_name IN (SELECT river_name FROM top_rivers) AND {p} IS NOT NULL" for p in PARAMS) + """)
, base AS (SELECT state_name, river_name, parameter, median(value) AS median, min(value) AS min, max(value) AS max
           FROM long GROUP BY ALL)
, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_name ORDER BY sampling_date) AS rn
                         FROM predictions) WHERE rn = 1)
, cur_long AS (""" + " UNION ALL ".join(
    f"SELECT station_name, '{p}' AS parameter, {i} AS p_idx, {p} AS cur FROM cur WHERE {p} IS NOT NULL"
    for i, p in enumerate(HPARAMS) if p in PARAMS) + """)
"""

EXACT = HIST + """
, lev AS (
  SELECT station_name, river_name, state_name,
    CASE WHEN river_name <> '' AND EXISTS (SELECT 1 FROM base b WHERE b.river_name = c.river_name AND b.state_name = c.state_name) THEN 1
         WHEN river_name <> '' AND EXISTS (SELECT 1 FROM base b WHERE b.river_name = c.river_name) THEN 2
         WHEN state_name <> '' AND EXISTS (SELECT 1 FROM base b WHERE b.state_name = c.state_name) THEN 3 END AS level
  FROM cur c
), matched AS (
  SELECT l.station_name, b.parameter, b.median, b.max FROM lev l JOIN base b
    ON (l.level = 1 AND b.river_name = l.river_name AND b.state_name = l.state_name)
    OR (l.level = 2 AND b.river_name = l.river_name) OR (l.level = 3 AND b.state_name = l.state_name)
), agg AS (
  SELECT station_name, parameter, """ + _mean("median") + " AS med, " + _mean("max") + """ AS mx FROM matched GROUP BY ALL
), parts AS (
  SELECT c.station_name, c.p_idx, list_filter([
      CASE WHEN med IS NOT NULL THEN c.parameter || ' current=' || """ + fmt2_sql("cur") + """ || ' vs historical median='
        || """ + fmt2_sql("med") + """ || ' (' || CASE WHEN cur > med THEN 'above' ELSE 'at/below' END || ')' END,
      CASE WHEN mx IS NOT NULL AND cur > mx THEN 'WARNING: ' || c.parameter || ' current=' || """ + fmt2_sql("cur") + """
        || ' exceeds historical max=' || """ + fmt2_sql("mx") + """ END], lambda x: x IS NOT NULL) AS t
  FROM cur_long c JOIN agg a ON a.station_name = c.station_name AND a.parameter = c.parameter
), ctx AS (
  SELECT station_name, flatten(list(t ORDER BY p_idx)) AS c FROM parts GROUP BY station_name
)
"""

FUZZY = HIST + f"""
, st AS (
  SELECT station_name, river_name, state_name, lower(trim(coalesce(state_name, ''))) AS sl,
    list_distinct({tokens_sql('river_name')}) AS rt, list_distinct({tokens_sql('station_name')}) AS nt
  FROM cur
), brt AS (SELECT b_river, list_distinct({tokens_sql('b_river')}) AS bt FROM (SELECT DISTINCT river_name AS b_river FROM base))
, jac AS (SELECT st.station_name, brt.b_river, {_jac('rt', 'bt')} AS jr, {_jac('nt', 'bt')} AS jn FROM st CROSS JOIN brt)
, cand AS (
  SELECT j.station_name, 1 AS level, b.* FROM jac j JOIN st ON st.station_name = j.station_name
    JOIN base b ON b.river_name = j.b_river WHERE j.jr > 0.4 AND st.sl <> '' AND contains(lower(b.state_name), st.sl)
  UNION ALL SELECT j.station_name, 2, b.* FROM jac j JOIN base b ON b.river_name = j.b_river WHERE j.jr > 0.4
  UNION ALL SELECT j.station_name, 3, b.* FROM jac j JOIN base b ON b.river_name = j.b_river WHERE j.jn > 0.25
  UNION ALL SELECT st.station_name, 4, b.* FROM st JOIN base b ON st.sl <> '' AND contains(lower(b.state_name), st.sl)
), best AS (SELECT station_name, min(level) AS level FROM cand GROUP BY station_name)
, agg AS (
  SELECT c.station_name, c.level, c.parameter, {_mean('median')} AS med, {_mean('min')} AS mn, {_mean('max')} AS mx
  FROM cand c JOIN best USING (station_name, level) GROUP BY ALL
)
"""

SQL = {
    "jn_hist_exact": EXACT + """
SELECT l.station_name, l.river_name, l.state_name AS state, ['river_state', 'river_only', 'state_only'][l.level] AS match_level,
  array_to_string(c, '; ') AS historical_context
FROM lev l JOIN ctx ON ctx.station_name = l.station_name WHERE len(c) > 0""",
    "jn_hist_fuzzy": FUZZY + f"""
SELECT st.station_name, st.river_name, st.state_name AS state,
  ['river_state', 'river_only', 'station_to_river_fuzzy', 'state_only'][a.level] AS attempted_match_level,
  CASE a.level WHEN 1 THEN 'river=''' || coalesce(st.river_name, '') || ''' + state=''' || coalesce(st.state_name, '') || ''''
    WHEN 2 THEN 'river=''' || coalesce(st.river_name, '') || ''''
    WHEN 3 THEN 'station=''' || st.station_name || ''' fuzzy-matched'
    ELSE 'state=''' || coalesce(st.state_name, '') || '''' END AS matched_baseline_source,
  c.parameter AS matched_parameter, round(c.cur, 6) AS current_value, round(a.med, 6) AS baseline_median,
  round(a.mx - a.mn, 6) AS baseline_range,
  CASE WHEN a.med IS NOT NULL THEN 'Current ' || c.parameter || '=' || {fmt2_sql('c.cur')} || ' is '
      || CASE WHEN c.cur > a.med THEN 'above' ELSE 'at/below' END || ' historical median=' || {fmt2_sql('a.med')}
      || CASE WHEN a.mx IS NOT NULL AND c.cur > a.mx THEN ' (EXCEEDS historical max=' || {fmt2_sql('a.mx')} || ')' ELSE '' END
    ELSE 'Current ' || c.parameter || '=' || {fmt2_sql('c.cur')} || ', insufficient baseline data' END AS context_note,
  ['Medium', 'Low', 'Low', 'Very Low'][a.level] AS match_confidence
FROM cur_long c JOIN agg a ON a.station_name = c.station_name AND a.parameter = c.parameter
  JOIN st ON st.station_name = c.station_name
UNION ALL
SELECT station_name, river_name, state_name, 'no_reliable_match', '', '', NULL, NULL, NULL,
  'No historical baseline match found for this station.', 'None'
FROM st WHERE station_name NOT IN (SELECT station_name FROM best)""",
    "jn_alert_enrich": EXACT + f"""
, rules AS (SELECT station_name, {RULE_EXPL} AS rule_explanation FROM cur)
, hist AS (SELECT l.station_name, array_to_string(c, '; ') AS historical_context
           FROM lev l JOIN ctx ON ctx.station_name = l.station_name WHERE len(c) > 0)
SELECT a.alert_id, a.station_name, a.river_name, a.alert_types AS alert_type, a.severity, round(a.risk_score, 6) AS risk_score,
  a.risk_category, a.violation_reasons, '' AS top_model_drivers, coalesce(r.rule_explanation, '') AS rule_explanation,
  '' AS shap_explanation, coalesce(h.historical_context, 'None') AS historical_context_if_available,
  CASE WHEN a.severity IN ('Severe', 'Critical') THEN 'Dispatch immediate field monitoring team'
    ELSE 'Monitor closely and verify at next sampling cycle' END AS recommended_action
FROM alerts a LEFT JOIN rules r ON r.station_name = a.station_name LEFT JOIN hist h ON h.station_name = a.station_name""",
}
