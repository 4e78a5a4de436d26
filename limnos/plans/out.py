"""Output shaping shared by registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def round_half_away(x: Column, places: int = 6) -> Column:
    """sign(x) * floor(|x| * 10^p + 0.5) / 10^p on the binary value.

    Spark's ``round`` rounds the exact binary expansion (3.2281875 stored as
    3.22818749.. -> 3.228187) while SQL engines commonly scale first and
    round half away from zero; this form gives the same digits in both.
    """
    s = float(10 ** places)
    return F.signum(x) * F.floor(F.abs(x) * s + 0.5) / s


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round double columns of an aggregate result (floating sums are order-dependent)."""
    return df.select(*[round_half_away(F.col(f.name), places).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])
