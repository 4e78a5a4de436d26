"""Date helpers: seasons, month names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: English month names and abbreviations -> month number
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july",
               "august", "september", "october", "november", "december"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_of(date=None, month_text=None) -> Column:
    """Month number from a date, else from a number / full name / 3-letter abbreviation."""
    parts = []
    if date is not None:
        parts.append(F.month(_c(date)))
    if month_text is not None:
        t = F.lower(F.trim(_c(month_text)))
        names = F.create_map(*[F.lit(x) for i, n in enumerate(MONTH_NAMES)
                               for x in (n, i + 1)])
        abbr = F.create_map(*[F.lit(x) for i, n in enumerate(MONTH_NAMES)
                              for x in (n[:3], i + 1)])
        parts += [t.try_cast("int"), F.element_at(names, t), F.element_at(abbr, t)]
    return F.coalesce(*parts)


def season4(month) -> Column:
    """date_season4: Winter / Pre-Monsoon / Monsoon / Post-Monsoon (NULL when unknown)."""
    m = _c(month)
    return (F.when(m.isin(12, 1, 2), F.lit("Winter")).when(m.isin(3, 4, 5), F.lit("Pre-Monsoon"))
            .when(m.isin(6, 7, 8, 9), F.lit("Monsoon")).when(m.isin(10, 11), F.lit("Post-Monsoon")))


def season_live(ts) -> Column:
    """date_season_live: Summer / Monsoon / Post-Monsoon / Winter; NULL -> Unknown."""
    m = F.month(_c(ts))
    return (F.when(m.isNull(), F.lit("Unknown")).when(m.isin(3, 4, 5), F.lit("Summer"))
            .when(m.isin(6, 7, 8, 9), F.lit("Monsoon")).when(m.isin(10, 11), F.lit("Post-Monsoon"))
            .otherwise(F.lit("Winter")))


def month_name(ts) -> Column:
    """date_month_name: full month name, NULL -> Unknown."""
    return F.coalesce(F.date_format(_c(ts), "MMMM"), F.lit("Unknown"))

