"""Station-name text functions: water body, spatial tags, token matching.

Regexes are kept ASCII and RE2/Java compatible (no look-around) so the same
pattern text runs in Spark and in the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


RIVER_PREFIX = r"(?i)^([\w\s\.]+?)\s+(river|creek|sea|nala|nalla|dam|lake)\b"
RIVER_ONLY = r"(?i)^([\w\s]+?)\s+river"


def infer_river(station) -> Column:
    """str_river_infer: lazy prefix before a water word, title-cased; BPT `a/b`; else NULL."""
    s = F.trim(_c(station))
    m1 = F.nullif(F.regexp_extract(s, RIVER_PREFIX, 1), F.lit(""))
    parts = F.split(s, ",")
    bpt = F.when(F.lower(s).contains("bpt") & (F.size(parts) >= 2),
                 F.concat(F.trim(parts[0]), F.lit("/"), F.trim(parts[1])))
    m2 = F.nullif(F.regexp_extract(s, RIVER_ONLY, 1), F.lit(""))
    return (F.when(m1.isNotNull(), F.initcap(F.trim(m1)))
            .when(bpt.isNotNull(), bpt)
            .when(m2.isNotNull(), F.initcap(F.trim(m2))))


def fix_river(river, station) -> list[Column]:
    """str_river_fix: replace missing / generic river names with the inferred one."""
    r = _c(river)
    inferred = infer_river(station)
    generic = F.lower(F.trim(r)).isin(*K.GENERIC_WATER_WORDS)
    missing = r.isNull() | (F.trim(r) == "")
    use = (generic | missing) & inferred.isNotNull() & (F.trim(inferred) != "")
    fixed = F.when(use, inferred).otherwise(r)
    source = (F.when(use, F.lit("inferred_from_station_name"))
              .when(fixed.isNull() | (F.trim(fixed) == ""), F.lit("unknown"))
              .otherwise(F.lit("existing_valid_value")))
    return [fixed.alias("river_name_fixed"), source.alias("river_name_source")]


def position_tag(station) -> Column:
    """str_pos_tag: Upstream / Downstream / Unknown."""
    s = F.lower(_c(station))
    return (F.when(s.rlike(K.POSITION_UP), F.lit("Upstream"))
            .when(s.rlike(K.POSITION_DOWN), F.lit("Downstream"))
            .otherwise(F.lit("Unknown")))


def context_tag(station) -> Column:
    """str_context_tag: first matching pollution context, else Riverine / General."""
    s = F.lower(_c(station))
    expr = F.lit(K.CONTEXT_DEFAULT)
    for pattern, tag in reversed(K.CONTEXT_RULES):
        expr = F.when(s.rlike(pattern), F.lit(tag)).otherwise(expr)
    return expr


# FIXED VALUES: spatial tag patterns on the upper-cased location, in tag order
SPATIAL_PATTERNS = [
    ("UPSTREAM", r"\bU/S\b|\bUPSTREAM\b"),
    ("DOWNSTREAM", r"\bD/S\b|\bDOWNSTREAM\b"),
    ("BEFORE", r"\bBEFORE\b"),
    ("AFTER", r"\bAFTER\b"),
    ("CONFLUENCE", r"\bCONF\.?\b|\bCONFLUENCE\b"),
    ("DISCHARGE", r"\bDISCHARGE\b"),
]
BASE_NAME_WORDS = (r"\bU/S\b|\bD/S\b|\bUPSTREAM\b|\bDOWNSTREAM\b|\bBEFORE\b|\bAFTER\b|"
                   r"\bCONF\.?\b|\bCONFLUENCE\b|\bDISCHARGE\b|\bOF\b|\bAT\b|\bNEAR\b")


def spatial_tags(loc) -> Column:
    """str_spatial_tags: `|`-joined tags or NONE."""
    u = F.upper(_c(loc))
    tags = F.array_compact(F.array(*[F.when(u.rlike(p), F.lit(t)) for t, p in SPATIAL_PATTERNS]))
    return F.when(F.size(tags) > 0, F.array_join(tags, "|")).otherwise(F.lit("NONE"))


def primary_position(loc) -> Column:
    """str_primary_pos: first of UPSTREAM / DOWNSTREAM / BEFORE / AFTER, else UNSPECIFIED."""
    u = F.upper(_c(loc))
    expr = F.lit("UNSPECIFIED")
    for t, p in reversed(SPATIAL_PATTERNS[:4]):
        expr = F.when(u.rlike(p), F.lit(t)).otherwise(expr)
    return expr


def station_base(loc) -> Column:
    """str_station_base: drop spatial words, collapse spaces, trim ` ,.-`."""
    u = F.regexp_replace(F.upper(_c(loc)), BASE_NAME_WORDS, " ")
    u = F.regexp_replace(u, r"\s+", " ")
    return F.regexp_replace(u, r"^[ ,.\-]+|[ ,.\-]+$", "")


def station_group(basin, loc) -> Column:
    return F.concat(F.trim(F.upper(_c(basin))), F.lit("|"), station_base(loc))


def tokens(s) -> Column:
    """str_normalise as tokens: lower, non-alnum -> space, drop stopwords."""
    t = F.regexp_replace(F.lower(_c(s)), r"[^a-z0-9\s]", " ")
    stop = F.array(*[F.lit(w) for w in K.MATCH_STOPWORDS])
    return F.filter(F.split(F.trim(t), r"\s+"),
                    lambda w: (w != "") & ~F.array_contains(stop, w))


def normalise(s) -> Column:
    return F.when(_c(s).isNull(), F.lit("")).otherwise(F.array_join(tokens(s), " "))


def jaccard(a: Column, b: Column) -> Column:
    """str_jaccard on token arrays: |A n B| / |A u B|, 0 when either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def canonical_parameter(raw) -> Column:
    """str_param_canon: alias lookup on the trimmed lower name; NULL -> unknown."""
    r = F.lower(F.trim(_c(raw)))
    lookup = F.create_map(*[F.lit(x) for pair in K.LIVE_PARAM_ALIASES for x in pair])
    return F.when(_c(raw).isNull(), F.lit("unknown")).otherwise(
        F.coalesce(F.element_at(lookup, r), r))


def state_from_code(code) -> Column:
    """jn_state_code: LGD state code -> name, else Unknown."""
    lookup = F.create_map(*[F.lit(x) for k, v in K.STATE_CODES.items() for x in (k, v)])
    return F.coalesce(F.element_at(lookup, _c(code).cast("int")), F.lit("Unknown"))


# FIXED VALUES: state / parameter group inferred from a file name (substring rules)
FILE_STATE_RULES = [(("_as_", "cpcb_as"), "Assam"), (("_ar_", "cpcb_ar"), "Arunachal Pradesh"),
                    (("_ka_", "cpcb_ka"), "Karnataka"), (("_jk_", "cpcb_jk"), "Jammu and Kashmir"),
                    (("_ap_", "cpcb_ap"), "Andhra Pradesh")]
FILE_GROUP_RULES = ["biological", "chemical", "physical"]


def state_from_filename(name) -> Column:
    fn = F.lower(_c(name))
    expr = F.lit("Unknown")
    for keys, state in reversed(FILE_STATE_RULES):
        expr = F.when(fn.contains(keys[0]) | fn.contains(keys[1]), F.lit(state)).otherwise(expr)
    return expr


def group_from_filename(name) -> Column:
    fn = F.lower(_c(name))
    expr = F.lit("mixed/unknown")
    for g in reversed(FILE_GROUP_RULES):
        expr = F.when(fn.contains(g), F.lit(g)).otherwise(expr)
    return expr
