"""Spatial tagging and upstream / downstream pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def pair_flags(df: DataFrame, loc: str = "station_name", basin: str = "basin",
               year: str = "year") -> DataFrame:
    """jn_pair_flag: (station_group, year) has both an UPSTREAM and a DOWNSTREAM station.

    A group aggregate (bool_or of each position) joined back on the group key;
    both sides hash-partition on the same key, so the join adds no extra shuffle
    of the aggregate side beyond the one the aggregate already did.
    """
    d = df.select("*", T.station_group(basin, loc).alias("station_group"),
                  T.primary_position(loc).alias("primary_position"))
    g = d.groupBy("station_group", year).agg(
        (F.bool_or(F.col("primary_position") == "UPSTREAM")
         & F.bool_or(F.col("primary_position") == "DOWNSTREAM")).alias("has_us_ds_pair"))
    return d.join(g, ["station_group", year], "left")
