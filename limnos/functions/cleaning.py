"""Dirty text -> typed values, as native Column expressions.

One parser family with a policy argument instead of several ad-hoc cleaners.
All of them are regexp / try_cast expressions, so they stay inside codegen;
``try_cast`` keeps ANSI mode from failing on junk, and ``nullif(.., '')``
turns a failed ``regexp_extract`` (which returns '') into NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

NUMBER = r"[-+]?\d*\.?\d+"
LOOSE_NUMBER = r"-?\d+\.?\d*"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_number(s: Column, pattern: str = NUMBER) -> Column:
    return F.nullif(F.regexp_extract(s, f"({pattern})", 1), F.lit("")).try_cast("double")


def clean_basic(raw) -> Column:
    """num_clean_basic: nd/na/none/null/empty -> NULL; strip (BDL); bare BDL -> NULL; first number."""
    t = F.trim(_c(raw))
    t2 = F.regexp_replace(t, r"(?i)\(BDL\)", "")
    return (F.when(F.lower(t).isin(*K.BASIC_MISSING), F.lit(None).cast("double"))
            .when(t2.rlike(r"(?i)^(bdl|below detection limit)$"), F.lit(None).cast("double"))
            .otherwise(first_number(t2)))


def clean_censored(raw) -> Column:
    """num_clean_censored: struct(value, flag); `<x` -> x/2 with a flag text."""
    s0 = _c(raw)
    s = F.lower(F.trim(s0))
    s = F.regexp_replace(s, ",", "")
    num = first_number(s)
    is_missing = F.lower(F.trim(s0)).isin(*K.CENSORED_MISSING)
    value = (F.when(s0.isNull() | is_missing, F.lit(None).cast("double"))
             .when(s.startswith("<") & num.isNotNull(), num / 2.0)
             .otherwise(num))
    flag = (F.when(s0.isNull(), F.lit(""))
            .when(is_missing, F.lit("Below detection/Missing"))
            .when(s.startswith("<") & num.isNotNull(),
                  F.concat(F.lit("Converted <"), num.cast("string"), F.lit(" to "),
                           (num / 2.0).cast("string")))
            .when(num.isNotNull(), F.lit(""))
            .otherwise(F.lit("Parse Error")))
    return F.struct(value.alias("value"), flag.alias("flag"))


def clean_core(raw) -> Column:
    """num_clean_core: numeric passthrough else first `-?\\d+\\.?\\d*` (so `.5` -> 5)."""
    s = _c(raw)
    return F.coalesce(s.try_cast("double"), first_number(s, LOOSE_NUMBER))


def bdl_zero(raw) -> Column:
    """num_bdl_zero: BDL -> 0; NAN/NA/empty/NONE -> NULL; else numeric or NULL."""
    u = F.upper(F.trim(_c(raw)))
    return (F.when(u == "BDL", F.lit(0.0))
            .when(u.isin("NAN", "NA", "", "NONE"), F.lit(None).cast("double"))
            .otherwise(u.try_cast("double")))


def model_input(raw) -> Column:
    """num_model_input: strip (BDL), any bdl -> 0, then numeric or NULL."""
    s = F.regexp_replace(_c(raw), r"(?i)\(BDL\)", "")
    s = F.regexp_replace(s, r"(?i)bdl", "0")
    return s.try_cast("double")


# Declared date formats of the permissive parser (day first), in priority order
DATE_FORMATS = ["yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd MMM yyyy"]


def parse_date(raw, formats=DATE_FORMATS) -> Column:
    """date_parse: first declared format that parses; errors -> NULL."""
    s = F.trim(_c(raw))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats]).cast("date")


def add_censored(df, col: str, value: str = "value", flag: str = "flag", keep_parts: bool = False):
    """clean_censored as two projections: the normalised text and its first number are computed
    once per row (a regex inside several CASE branches would be re-evaluated per branch)."""
    s_name, n_name = f"_s_{col}", f"_n_{col}"
    s = F.regexp_replace(F.lower(F.trim(F.col(col))), ",", "")
    d = df.withColumn(s_name, s).withColumn(n_name, first_number(F.col(s_name)))
    raw, s_c, num = F.col(col), F.col(s_name), F.col(n_name)
    is_missing = F.lower(F.trim(raw)).isin(*K.CENSORED_MISSING)
    lt = s_c.startswith("<") & num.isNotNull()
    d = d.withColumn(value, F.when(raw.isNull() | is_missing, F.lit(None).cast("double"))
                     .when(lt, num / 2.0).otherwise(num))
    d = d.withColumn(flag, F.when(raw.isNull(), F.lit(""))
                     .when(is_missing, F.lit("Below detection/Missing"))
                     .when(lt, F.concat(F.lit("Converted <"), num.cast("string"), F.lit(" to "),
                                        (num / 2.0).cast("string")))
                     .when(num.isNotNull(), F.lit("")).otherwise(F.lit("Parse Error")))
    return d if keep_parts else d.drop(s_name, n_name)
