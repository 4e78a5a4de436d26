"""Oracle SQL: cleaning, text and date functions."""

from .. import constants as K
from .base import INITCAP, WITH_BASE

DIRTY = """
WITH dirty AS (
  SELECT event_id, user_id AS station_id, ts,
    CASE event_type WHEN 'error' THEN 'dissolved_oxygen' WHEN 'click' THEN 'bod'
      WHEN 'view' THEN 'ph' WHEN 'purchase' THEN 'temperature' ELSE 'conductivity' END AS parameter,
    CASE event_id % 11 WHEN 0 THEN 'BDL' WHEN 1 THEN '<' || p WHEN 2 THEN p || '(BDL)'
      WHEN 3 THEN p || ' mg/l' WHEN 4 THEN 'nd' WHEN 5 THEN '-' WHEN 6 THEN ''
      WHEN 7 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ',' || right(p, 2) || '0'
      WHEN 8 THEN regexp_replace(p, '^0\\.', '.') ELSE p END AS raw_value
  FROM (SELECT *, CAST(CAST(value AS DECIMAL(10, 2)) AS VARCHAR) AS p FROM events)
)
"""

NUM = r"([-+]?\d*\.?\d+)"
STOP = "[" + ", ".join(f"'{w}'" for w in K.MATCH_STOPWORDS) + "]"


def tokens_sql(x: str) -> str:
    return (f"list_filter(string_split_regex(trim(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g')), '\\s+'), "
            f"lambda w: w <> '' AND NOT list_contains({STOP}, w))")


RIVER_PREFIX = r"^([\w\s\.]+?)\s+(river|creek|sea|nala|nalla|dam|lake)\b"
RIVER_ONLY = r"^([\w\s]+?)\s+river"


def infer_river_sql(x: str) -> str:
    m1 = f"nullif(regexp_extract(trim({x}), '{RIVER_PREFIX}', 1, 'i'), '')"
    m2 = f"nullif(regexp_extract(trim({x}), '{RIVER_ONLY}', 1, 'i'), '')"
    parts = f"string_split(trim({x}), ',')"
    return (f"CASE WHEN {m1} IS NOT NULL THEN {INITCAP.format(x='trim(' + m1 + ')')} "
            f"WHEN contains(lower(trim({x})), 'bpt') AND len({parts}) >= 2 "
            f"THEN trim({parts}[1]) || '/' || trim({parts}[2]) "
            f"WHEN {m2} IS NOT NULL THEN {INITCAP.format(x='trim(' + m2 + ')')} END")


BASE_WORDS = (r"\bU/S\b|\bD/S\b|\bUPSTREAM\b|\bDOWNSTREAM\b|\bBEFORE\b|\bAFTER\b|"
              r"\bCONF\.?\b|\bCONFLUENCE\b|\bDISCHARGE\b|\bOF\b|\bAT\b|\bNEAR\b")


def station_base_sql(x: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace(upper({x}), '{BASE_WORDS}', ' ', 'g'), "
            f"'\\s+', ' ', 'g'), '^[ ,.\\-]+|[ ,.\\-]+$', '', 'g')")


def position_sql(x: str) -> str:
    return (f"CASE WHEN regexp_matches(lower({x}), '{K.POSITION_UP}') THEN 'Upstream' "
            f"WHEN regexp_matches(lower({x}), '{K.POSITION_DOWN}') THEN 'Downstream' ELSE 'Unknown' END")


def context_sql(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({x}), '{p}') THEN '{t}'" for p, t in K.CONTEXT_RULES)
    return f"CASE {whens} ELSE '{K.CONTEXT_DEFAULT}' END"


SPATIAL = [("UPSTREAM", r"\bU/S\b|\bUPSTREAM\b"), ("DOWNSTREAM", r"\bD/S\b|\bDOWNSTREAM\b"),
           ("BEFORE", r"\bBEFORE\b"), ("AFTER", r"\bAFTER\b"),
           ("CONFLUENCE", r"\bCONF\.?\b|\bCONFLUENCE\b"), ("DISCHARGE", r"\bDISCHARGE\b")]


def spatial_tags_sql(x: str) -> str:
    items = ", ".join(f"CASE WHEN regexp_matches(upper({x}), '{p}') THEN '{t}' END" for t, p in SPATIAL)
    lst = f"list_filter([{items}], lambda t: t IS NOT NULL)"
    return f"CASE WHEN len({lst}) > 0 THEN array_to_string({lst}, '|') ELSE 'NONE' END"


def primary_sql(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(upper({x}), '{p}') THEN '{t}'" for t, p in SPATIAL[:4])
    return f"CASE {whens} ELSE 'UNSPECIFIED' END"


MONTHS3 = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"

SQL = {
    "num_clean_basic": DIRTY + r"""
SELECT event_id, raw_value,
  CASE WHEN lower(trim(raw_value)) IN ('nd', 'na', 'none', 'null', '') THEN NULL
       WHEN regexp_matches(t2, '^(bdl|below detection limit)$', 'i') THEN NULL
       ELSE TRY_CAST(nullif(regexp_extract(t2, '([-+]?\d*\.?\d+)', 1), '') AS DOUBLE) END AS value
FROM (SELECT *, regexp_replace(trim(raw_value), '\(BDL\)', '', 'gi') AS t2 FROM dirty)""",
    "num_clean_censored": DIRTY + r"""
SELECT event_id, raw_value,
  CASE WHEN raw_value IS NULL OR miss THEN NULL
       WHEN starts_with(s, '<') AND num IS NOT NULL THEN num / 2.0e0 ELSE num END AS value,
  CASE WHEN raw_value IS NULL THEN '' WHEN miss THEN 'Below detection/Missing'
       WHEN starts_with(s, '<') AND num IS NOT NULL
         THEN 'Converted <' || CAST(num AS VARCHAR) || ' to ' || CAST(num / 2.0e0 AS VARCHAR)
       WHEN num IS NOT NULL THEN '' ELSE 'Parse Error' END AS flag
FROM (SELECT *, lower(trim(raw_value)) IN ('bdl', 'below detection limit', 'na', '-', 'nil', 'nd',
             'not detectable', '', 'null') AS miss,
        replace(lower(trim(raw_value)), ',', '') AS s,
        TRY_CAST(nullif(regexp_extract(replace(lower(trim(raw_value)), ',', ''), '([-+]?\d*\.?\d+)', 1), '') AS DOUBLE) AS num
      FROM dirty)""",
    "num_clean_core": DIRTY + r"""
SELECT event_id, raw_value,
  coalesce(TRY_CAST(raw_value AS DOUBLE),
           TRY_CAST(nullif(regexp_extract(raw_value, '(-?\d+\.?\d*)', 1), '') AS DOUBLE)) AS value
FROM dirty""",
    "num_bdl_zero": DIRTY + """
SELECT event_id, raw_value,
  CASE WHEN upper(trim(raw_value)) = 'BDL' THEN 0.0e0
       WHEN upper(trim(raw_value)) IN ('NAN', 'NA', '', 'NONE') THEN NULL
       ELSE TRY_CAST(upper(trim(raw_value)) AS DOUBLE) END AS value
FROM dirty""",
    "num_model_input": DIRTY + r"""
SELECT event_id, raw_value,
  TRY_CAST(regexp_replace(regexp_replace(raw_value, '\(BDL\)', '', 'gi'), 'bdl', '0', 'gi') AS DOUBLE) AS value
FROM dirty""",
    "date_parse": """
SELECT event_id, date_text,
  CAST(coalesce(try_strptime(trim(date_text), '%Y-%m-%d'), try_strptime(trim(date_text), '%d-%m-%Y'),
                try_strptime(trim(date_text), '%d/%m/%Y'), try_strptime(trim(date_text), '%d %b %Y')) AS DATE) AS parsed_date
FROM (SELECT event_id,
        CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%d-%m-%Y')
          WHEN 2 THEN strftime(ts, '%d/%m/%Y') WHEN 3 THEN strftime(ts, '%d %b %Y')
          ELSE 'not recorded' END AS date_text
      FROM events)""",
    "date_season4": f"""
SELECT o_orderkey, month_no,
  CASE WHEN month_no IN (12, 1, 2) THEN 'Winter' WHEN month_no IN (3, 4, 5) THEN 'Pre-Monsoon'
       WHEN month_no IN (6, 7, 8, 9) THEN 'Monsoon' WHEN month_no IN (10, 11) THEN 'Post-Monsoon' END AS season
FROM (SELECT o_orderkey,
        CAST(coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN month(o_orderdate) END,
                 TRY_CAST(t AS INTEGER),
                 nullif(list_position({MONTHS3}, lower(trim(t))), 0)) AS INTEGER) AS month_no
      FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%b') END AS t FROM orders))""",
    "date_season_live": """
SELECT o_orderkey,
  CASE WHEN month(o_orderdate) IS NULL THEN 'Unknown' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Summer'
       WHEN month(o_orderdate) IN (6, 7, 8, 9) THEN 'Monsoon' WHEN month(o_orderdate) IN (10, 11) THEN 'Post-Monsoon'
       ELSE 'Winter' END AS season
FROM orders""",
    "date_month_name": """
SELECT o_orderkey, coalesce(monthname(o_orderdate), 'Unknown') AS month_name FROM orders""",
    "str_river_infer": WITH_BASE + f"""
SELECT station_id, station_name, {infer_river_sql('station_name')} AS inferred_river FROM stations""",
    "str_river_fix": WITH_BASE + f"""
, raw AS (
  SELECT station_id, station_name,
    CASE station_id % 5 WHEN 0 THEN 'river' WHEN 1 THEN NULL WHEN 2 THEN ' ' WHEN 3 THEN 'Lake'
      ELSE river_name END AS river_name_raw
  FROM stations
), inf AS (
  SELECT *, {infer_river_sql('station_name')} AS inferred,
    (lower(trim(river_name_raw)) IN ('river', 'creek', 'sea', 'nala', 'nalla', 'dam', 'lake', 'pond', 'well')
     OR river_name_raw IS NULL OR trim(river_name_raw) = '') AS needs_fix
  FROM raw
), fx AS (
  SELECT *, coalesce(needs_fix AND inferred IS NOT NULL AND trim(inferred) <> '', false) AS use_inf FROM inf
)
SELECT station_id, river_name_raw,
  CASE WHEN use_inf THEN inferred ELSE river_name_raw END AS river_name_fixed,
  CASE WHEN use_inf THEN 'inferred_from_station_name'
       WHEN river_name_raw IS NULL OR trim(river_name_raw) = '' THEN 'unknown'
       ELSE 'existing_valid_value' END AS river_name_source
FROM fx""",
    "str_pos_tag": WITH_BASE + f"""
SELECT station_id, {position_sql('station_name')} AS station_position_tag FROM stations""",
    "str_context_tag": WITH_BASE + f"""
SELECT station_id, {context_sql('station_name')} AS pollution_context_tag FROM stations""",
    "str_spatial_tags": WITH_BASE + f"""
SELECT station_id, {spatial_tags_sql('station_name')} AS spatial_tags FROM stations""",
    "str_primary_pos": WITH_BASE + f"""
SELECT station_id, {primary_sql('station_name')} AS primary_position FROM stations""",
    "str_station_base": WITH_BASE + f"""
SELECT station_id, {station_base_sql('station_name')} AS station_base_name,
  trim(upper(basin)) || '|' || {station_base_sql('station_name')} AS station_group FROM stations""",
    "str_normalise": WITH_BASE + f"""
SELECT station_id, CASE WHEN station_name IS NULL THEN '' ELSE array_to_string({tokens_sql('station_name')}, ' ') END AS station_norm
FROM stations""",
    "str_jaccard": WITH_BASE + f"""
SELECT station_id,
  round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0e0
        ELSE len(list_distinct(list_intersect(a, b))) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard
FROM (SELECT station_id, list_distinct({tokens_sql('station_name')}) AS a,
        list_distinct({tokens_sql('river_name')}) AS b FROM stations)""",
}
