"""Oracle SQL: file sources / sink read-back and the streaming latest state (= batch result)."""

from .live_sql import LIVE
from .live_sql import SQL as LSQL
from .standardize_sql import RAW

SQL = {
    "src_live_json": LIVE + """SELECT event_id, station_id, station_no, station_name, state, latitude, longitude,
  parameter_raw_name, timestamp, value, unit FROM feed""",
    "src_csv_dir": RAW + """
SELECT CAST(station_id AS VARCHAR) AS station_id, station_name AS "Station Name", monitoring_location AS "Monitoring Location",
  name_of_water_body AS "Name of Water Body", date AS "Date", do_mg_l AS "DO (mg/L)",
  dissolved_oxygen_min AS "Dissolved Oxygen Min", dissolved_oxygen_normalized AS "Dissolved Oxygen Normalized",
  bod_mg_l AS "BOD (mg/L)", ph_value AS "pH Value", CASE WHEN source_file <> 'upload_september.csv' THEN ph_value_1 END AS "PH-Value", temperature_c AS "Temperature (C)",
  electric_conductivity_umho_cm AS "Electric Conductivity (umho/cm)", CASE WHEN source_file <> 'upload_august.csv' THEN class END AS "Class",
  CASE WHEN source_file = 'upload_september.csv' THEN 'lab ' || station_id END AS "Laboratory", NULL AS _corrupt_record, source_file FROM raw""",
    "src_manifest": RAW + """
SELECT source_file, count(*) AS row_count, 14 AS column_count, 'utf-8' AS detected_encoding, 'Success' AS load_status,
  false AS duplicate_file_flag, 'Unknown' AS inferred_state_from_filename, 'mixed/unknown' AS likely_parameter_group
FROM raw GROUP BY source_file""",
    "snk_tables": LIVE.split(", feed AS (")[0] + """
SELECT station_id, sampling_date, available_compliance_label, risk_score, predicted_non_compliant, month
FROM predictions""",
    "st_ingest": LIVE + "SELECT event_id, station_id, parameter, value_numeric, is_numeric_value FROM rl",
    "st_latest": LSQL["win_latest"],
    "st_alerts": LSQL["alr_live"],
    "st_stale_stream": LIVE + """
, t AS (SELECT DISTINCT station_id, timestamp FROM rl),
n AS (SELECT station_id, timestamp, lead(timestamp) OVER (PARTITION BY station_id ORDER BY timestamp) AS next_timestamp FROM t)
SELECT station_id, timestamp AS latest_timestamp, next_timestamp, 'Live Stale Data Alert' AS alert_type, 'Warning' AS severity,
  'Live data is older than 24 hours.' AS reason
FROM n WHERE coalesce(next_timestamp, (SELECT max(timestamp) FROM t)) > timestamp + INTERVAL 24 HOURS""",
}
