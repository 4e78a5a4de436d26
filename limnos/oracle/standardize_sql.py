"""Oracle SQL: raw uploads standardisation, mapping audit, quality flags, inventory, annual records."""

from .base import WITH_BASE
from .cleaning_sql import infer_river_sql

MONTHS = "['July', 'August', 'September']"

RAW = WITH_BASE + """
, dirty2 AS (
  SELECT event_id, user_id AS station_id, ts,
    CASE event_type WHEN 'error' THEN 'dissolved_oxygen' WHEN 'click' THEN 'bod'
      WHEN 'view' THEN 'ph' WHEN 'purchase' THEN 'temperature' ELSE 'conductivity' END AS parameter,
    CASE event_id % 11 WHEN 0 THEN 'BDL' WHEN 1 THEN '<' || p WHEN 2 THEN p || '(BDL)'
      WHEN 3 THEN p || ' mg/l' WHEN 4 THEN 'nd' WHEN 5 THEN '-' WHEN 6 THEN ''
      WHEN 7 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ',' || right(p, 2) || '0'
      WHEN 8 THEN regexp_replace(p, '^0\\.', '.') ELSE p END AS raw_value
  FROM (SELECT *, CAST(CAST(value AS DECIMAL(10, 2)) AS VARCHAR) AS p FROM events)
), g AS (
  SELECT station_id, CAST(ts AS DATE) AS sampling_date,
    min(CASE WHEN parameter = 'dissolved_oxygen' THEN raw_value END) AS do_mg_l,
    max(CASE WHEN parameter = 'dissolved_oxygen' THEN raw_value END) AS do_max,
    min(CASE WHEN parameter = 'bod' THEN raw_value END) AS bod_mg_l,
    min(CASE WHEN parameter = 'ph' THEN raw_value END) AS ph_value,
    max(CASE WHEN parameter = 'ph' THEN raw_value END) AS ph_value_1,
    min(CASE WHEN parameter = 'temperature' THEN raw_value END) AS temperature_c,
    min(CASE WHEN parameter = 'conductivity' THEN raw_value END) AS ec
  FROM dirty2 GROUP BY ALL
), raw AS (
  SELECT 'upload_' || lower(""" + MONTHS + """[CAST(least(floor((day(g.sampling_date) - 1) / 10), 2) + 1 AS INT)]) || '.csv' AS source_file,
    g.station_id,
    CASE WHEN g.station_id % 5 <> 0 THEN s.station_name END AS station_name,
    CASE WHEN g.station_id % 3 = 0 THEN s.station_name END AS monitoring_location,
    CASE WHEN g.station_id % 7 <> 0 THEN s.river_name END AS name_of_water_body,
    strftime(g.sampling_date, '%d-%m-%Y') AS date,
    do_mg_l, CASE WHEN do_mg_l IS NULL THEN do_max END AS dissolved_oxygen_min, do_max AS dissolved_oxygen_normalized,
    bod_mg_l, ph_value, ph_value_1, temperature_c, ec AS electric_conductivity_umho_cm,
    ['A', 'B', 'C', 'D', 'E'][g.station_id % 5 + 1] AS class
  FROM g LEFT JOIN stations s ON s.station_id = g.station_id
), coal AS (
  SELECT source_file, station_id,
    coalesce(do_mg_l, dissolved_oxygen_min) AS dissolved_oxygen, bod_mg_l AS bod, ph_value AS ph,
    temperature_c AS temperature, electric_conductivity_umho_cm AS conductivity,
    CAST(NULL AS VARCHAR) AS nitrate, CAST(NULL AS VARCHAR) AS fecal_coliform, CAST(NULL AS VARCHAR) AS total_coliform,
    CAST(NULL AS VARCHAR) AS fecal_streptococci, CAST(NULL AS VARCHAR) AS turbidity, CAST(NULL AS VARCHAR) AS cod,
    CAST(NULL AS VARCHAR) AS total_dissolved_solids,
    coalesce(station_name, monitoring_location) AS station_name, name_of_water_body AS river_name,
    CAST(NULL AS VARCHAR) AS water_body_type, date AS sampling_date, CAST(NULL AS VARCHAR) AS month,
    CAST(NULL AS VARCHAR) AS year, CAST(NULL AS VARCHAR) AS season, CAST(NULL AS VARCHAR) AS latitude,
    CAST(NULL AS VARCHAR) AS longitude
  FROM raw
)
"""


LAB_SHEET = ["nitrate", "fecal_coliform", "total_coliform", "turbidity", "cod", "total_dissolved_solids", "conductivity", "e_coli", "chloride",
             "arsenic"]
FIELD_SHEET = {"dissolved_oxygen": "do_mg_l", "bod": "bod_mg_l", "ph": "coalesce(ph_value, ph_value_1)", "temperature": "temperature_c"}
CANON_NUM = list(FIELD_SHEET) + LAB_SHEET
CANON = RAW + """
, l AS (
  SELECT station_id, CAST(ts AS DATE) AS day, """ + ", ".join(
    f"min(CASE WHEN event_id % 13 = {k} THEN raw_value END) AS {p}" for k, p in enumerate(LAB_SHEET)) + """
  FROM dirty2 WHERE event_id % 13 < 10 GROUP BY ALL
), canon AS (
  SELECT source_file, station_id, coalesce(station_name, monitoring_location) AS station_name, name_of_water_body AS river_name,
    date AS sampling_date, """ + ", ".join(f"{x} AS {p}" for p, x in FIELD_SHEET.items()) + ", " + ", ".join(
    f"CAST(NULL AS VARCHAR) AS {p}" for p in LAB_SHEET) + """
  FROM raw
  UNION ALL SELECT 'lab_' || lower(""" + MONTHS + """[CAST(least(floor((day(l.day) - 1) / 10), 2) + 1 AS INT)]) || '.csv', l.station_id,
    CASE WHEN l.station_id % 5 <> 0 THEN s.station_name END, NULL, strftime(l.day, '%d-%m-%Y'), NULL, NULL, NULL, NULL, """ + ", ".join(
    f"l.{p}" for p in LAB_SHEET) + """
  FROM l LEFT JOIN stations s ON s.station_id = l.station_id
)
"""


def basic_sql(x):
    t2 = f"regexp_replace(trim({x}), '\\(BDL\\)', '', 'gi')"
    return (f"CASE WHEN lower(trim({x})) IN ('nd', 'na', 'none', 'null', '') THEN NULL "
            f"WHEN regexp_matches({t2}, '^(bdl|below detection limit)$', 'i') THEN NULL "
            f"ELSE TRY_CAST(nullif(regexp_extract({t2}, '([-+]?\\d*\\.?\\d+)', 1), '') AS DOUBLE) END")


def censored_sql(x):
    s = f"replace(lower(trim({x})), ',', '')"
    num = f"TRY_CAST(nullif(regexp_extract({s}, '([-+]?\\d*\\.?\\d+)', 1), '') AS DOUBLE)"
    miss = (f"lower(trim({x})) IN ('bdl', 'below detection limit', 'na', '-', 'nil', 'nd', "
            f"'not detectable', '', 'null')")
    value = f"CASE WHEN {x} IS NULL OR {miss} THEN NULL WHEN starts_with({s}, '<') AND {num} IS NOT NULL THEN {num} / 2.0e0 ELSE {num} END"
    flag = (f"CASE WHEN {x} IS NULL THEN '' WHEN {miss} THEN 'Below detection/Missing' "
            f"WHEN starts_with({s}, '<') AND {num} IS NOT NULL THEN 'Converted <' || CAST({num} AS VARCHAR) || ' to ' "
            f"|| CAST({num} / 2.0e0 AS VARCHAR) WHEN {num} IS NOT NULL THEN '' ELSE 'Parse Error' END")
    return value, flag


NUM = ["dissolved_oxygen", "bod", "ph", "temperature", "conductivity", "nitrate", "fecal_coliform",
       "total_coliform", "fecal_streptococci", "turbidity", "cod", "total_dissolved_solids"]
OTHER = ["station_name", "river_name", "water_body_type", "sampling_date", "month", "year", "season",
         "latitude", "longitude"]

STD = RAW + ", std AS (SELECT source_file, station_id, " + ", ".join(f"{basic_sql(c)} AS {c}" for c in NUM) + ", " \
    + ", ".join(OTHER) + " FROM coal)\n"

_fix_inf = infer_river_sql("station_name")


def _flags():
    parts = []
    for c in CANON_NUM:
        v, f = censored_sql(c)
        parts.append(f"SELECT source_file, station_id, sampling_date, '{c}' AS \"column\", {c} AS value, {f} AS flag_type, "
                     f"'Kept and coerced' AS action FROM canon WHERE starts_with({f}, 'Converted <')")
        if c == "ph":
            parts.append(f"SELECT source_file, station_id, sampling_date, 'ph', CAST({v} AS VARCHAR), 'Extreme pH', "
                         f"'Kept but flagged' FROM canon WHERE {v} < 0 OR {v} > 14")
        if c in ("bod", "dissolved_oxygen", "temperature"):
            parts.append(f"SELECT source_file, station_id, sampling_date, '{c}', CAST({v} AS VARCHAR), 'Negative {c}', "
                         f"'Kept but flagged' FROM canon WHERE {v} < 0")
        if c == "conductivity":
            parts.append(f"SELECT source_file, station_id, sampling_date, 'conductivity', CAST({v} AS VARCHAR), "
                         f"'Extreme conductivity', 'Kept but flagged' FROM coal WHERE {v} > 500000")
    parts.append("SELECT source_file, station_id, sampling_date, 'location', 'NA', 'Missing station and river', "
                 "'Kept but flagged' FROM canon WHERE station_name IS NULL AND river_name IS NULL")
    return " UNION ALL ".join(parts)


# (original header, snake name in `raw`, canonical, method, confidence, group) for mapped columns
MAPPED = [
    ("Station Name", "station_name", "station_name", "Alias Match", "High", "metadata"),
    ("Monitoring Location", "monitoring_location", "station_name", "Alias Match", "High", "metadata"),
    ("Name of Water Body", "name_of_water_body", "river_name", "Alias Match", "High", "metadata"),
    ("Date", "date", "sampling_date", "Alias Match", "High", "metadata"),
    ("DO (mg/L)", "do_mg_l", "dissolved_oxygen", "Alias Match", "High", "core"),
    ("BOD (mg/L)", "bod_mg_l", "bod", "Alias Match", "High", "core"),
    ("pH Value", "ph_value", "ph", "Alias Match", "High", "core"),
    ("PH-Value", "ph_value_1", "ph", "Alias Match", "High", "core"),
    ("Temperature (C)", "temperature_c", "temperature", "Prefix Match", "Medium", "physical"),
]
INVENTORY = [("Station Name", "station_name"), ("Monitoring Location", "monitoring_location"),
             ("Name of Water Body", "name_of_water_body"), ("Date", "date"), ("DO (mg/L)", "do_mg_l"),
             ("Dissolved Oxygen Min", "dissolved_oxygen_min"), ("Dissolved Oxygen Normalized", "dissolved_oxygen_normalized"),
             ("BOD (mg/L)", "bod_mg_l"), ("pH Value", "ph_value"), ("PH-Value", "ph_value_1"),
             ("Temperature (C)", "temperature_c"), ("Electric Conductivity (umho/cm)", "electric_conductivity_umho_cm"),
             ("Class", "class")]


def _examples(col, k=3):
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {col}) FILTER (WHERE {col} IS NOT NULL))[1:{k}], ' | '), '')"


UNMAPPED = [("Dissolved Oxygen Min", "dissolved_oxygen_min", "No match found"),
            ("Dissolved Oxygen Normalized", "dissolved_oxygen_normalized", "No match found"),
            ("Electric Conductivity (umho/cm)", "electric_conductivity_umho_cm", "No match found"),
            ("Class", "class", "Ignored class variable")]


ANNUAL = """
WITH li AS (
  SELECT l_suppkey AS station_code, CAST(year(l_shipdate) AS INTEGER) AS year,
    min(l_quantity) AS quantity_min, max(l_quantity) AS quantity_max, min(l_extendedprice) AS price_min,
    max(l_extendedprice) AS price_max, min(l_discount) AS discount_min, max(l_discount) AS discount_max,
    min(l_tax) AS tax_min, max(l_tax) AS tax_max
  FROM lineitem GROUP BY ALL
), geo AS (
  SELECT s_suppkey AS station_code, r_name AS river_basin
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), ann AS (
  SELECT li.station_code, li.year, geo.river_basin, quantity_min, quantity_max,
    CASE WHEN li.station_code % 7 <> 0 THEN price_min END AS price_min,
    CASE WHEN li.station_code % 7 <> 0 THEN price_max END AS price_max, discount_min, discount_max,
    CASE WHEN (li.station_code + li.year) % 5 <> 0 THEN tax_min END AS tax_min,
    CASE WHEN (li.station_code + li.year) % 5 <> 0 THEN tax_max END AS tax_max
  FROM li LEFT JOIN geo ON geo.station_code = li.station_code
), grp AS (
  SELECT river_basin, year, median(price_min) AS g_price_min, median(price_max) AS g_price_max,
    median(tax_min) AS g_tax_min, median(tax_max) AS g_tax_max FROM ann GROUP BY ALL
), imp AS (
  SELECT a.station_code, a.year, a.river_basin, quantity_min, quantity_max, discount_min, discount_max,
    coalesce(a.price_min, g.g_price_min, (SELECT median(price_min) FROM ann)) AS price_min,
    coalesce(a.price_max, g.g_price_max, (SELECT median(price_max) FROM ann)) AS price_max,
    coalesce(a.tax_min, g.g_tax_min, (SELECT median(tax_min) FROM ann)) AS tax_min,
    coalesce(a.tax_max, g.g_tax_max, (SELECT median(tax_max) FROM ann)) AS tax_max
  FROM ann a LEFT JOIN grp g ON g.river_basin = a.river_basin AND g.year = a.year
), means AS (
  SELECT station_code, year, (quantity_min + quantity_max) / 2 AS quantity_mean, (price_min + price_max) / 2 AS price_mean,
    (discount_min + discount_max) / 2 AS discount_mean, (tax_min + tax_max) / 2 AS tax_mean FROM imp
)
"""
MCOLS = ["quantity_mean", "price_mean", "discount_mean", "tax_mean"]

SQL = {
    "std_coalesce": STD + f"""
SELECT *, CASE WHEN use_inf THEN inferred ELSE river_name END AS river_name_fixed,
  CASE WHEN use_inf THEN 'inferred_from_station_name' WHEN river_name IS NULL OR trim(river_name) = '' THEN 'unknown'
    ELSE 'existing_valid_value' END AS river_name_source
FROM (SELECT *, coalesce((lower(trim(river_name)) IN ('river', 'creek', 'sea', 'nala', 'nalla', 'dam', 'lake', 'pond', 'well')
        OR river_name IS NULL OR trim(river_name) = '') AND inferred IS NOT NULL AND trim(inferred) <> '', false) AS use_inf
      FROM (SELECT *, {_fix_inf} AS inferred FROM std)) x""".replace("SELECT *, CASE WHEN use_inf", "SELECT * EXCLUDE (inferred, use_inf), CASE WHEN use_inf"),
    "std_alias_map": RAW + " UNION ALL ".join(
        f"SELECT source_file, '{o}' AS original_column, '{s}' AS normalized_column, '{c}' AS canonical_column, "
        f"'{m}' AS mapping_method, '{cf}' AS mapping_confidence, '{g}' AS parameter_group, count({s}) AS non_null_count, "
        f"{_examples(s)} AS example_values, '' AS notes FROM raw GROUP BY source_file"
        for o, s, c, m, cf, g in MAPPED),
    "std_unmapped": RAW + " UNION ALL ".join(
        f"SELECT DISTINCT source_file, '{o}' AS original_column, '{n}' AS normalized_column, '{r}' AS reason FROM raw" for o, n, r in UNMAPPED),
    "std_alias_table": RAW + """SELECT source_file, coalesce(station_name, monitoring_location) AS station_name, name_of_water_body AS river_name,
  date AS sampling_date, do_mg_l AS dissolved_oxygen, bod_mg_l AS bod, coalesce(ph_value, ph_value_1) AS ph, temperature_c AS temperature FROM raw""",
    "src_raw_inventory": RAW + " UNION ALL ".join(
        f"SELECT source_file, '{o}' AS \"column\", count({s}) AS non_null_count, "
        f"round(count({s}) * 100.0e0 / count(*), 6) AS non_null_pct, {_examples(s, 5)} AS sample_values FROM raw GROUP BY source_file"
        for o, s in INVENTORY),
    "dq_flags": CANON + _flags(),
    "dq_flag_summary": CANON + f"""
SELECT CASE WHEN starts_with(flag_type, 'Converted <') THEN 'Converted <' ELSE flag_type END AS flag_type, count(*) AS count
FROM ({_flags()}) GROUP BY 1""",
    "imp_group_median": ANNUAL + """
SELECT station_code, year, river_basin, round(quantity_min, 6) AS quantity_min, round(quantity_max, 6) AS quantity_max,
  round(discount_min, 6) AS discount_min, round(discount_max, 6) AS discount_max, round(price_min, 6) AS price_min,
  round(price_max, 6) AS price_max, round(tax_min, 6) AS tax_min, round(tax_max, 6) AS tax_max FROM imp""",
    "mean_of_minmax": ANNUAL + "SELECT station_code, year, " + ", ".join(f"round({c}, 6) AS {c}" for c in MCOLS) + " FROM means",
    "scl_minmax": ANNUAL + "SELECT station_code, year, " + ", ".join(
        f"round(({c} - (SELECT min({c}) FROM means)) / nullif((SELECT max({c}) FROM means) - (SELECT min({c}) FROM means), 0), 6) AS {c}_minmax"
        for c in MCOLS) + " FROM means",
    "scl_zscore": ANNUAL + "SELECT station_code, year, " + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM means)) / nullif((SELECT stddev_pop({c}) FROM means), 0), 6) AS {c}_zscore"
        for c in MCOLS) + " FROM means",
}

SQL["std_mapping_checks"] = """
SELECT 'sulphate_not_ph' AS test_name, 'Pass' AS pass_fail, 'No false positives detected' AS evidence, 'None' AS affected_columns_if_any
UNION ALL SELECT 'phosphate_not_ph', 'Pass', 'No false positives detected', 'None'
UNION ALL SELECT 'odour_not_do', 'Pass', 'No false positives detected', 'None'
UNION ALL SELECT 'water_body_not_bod', 'Pass', 'No false positives detected', 'None'
UNION ALL SELECT 'use_based_class_not_target', 'Pass', 'class not found or use_based_class not treated as ML target', 'None'"""
