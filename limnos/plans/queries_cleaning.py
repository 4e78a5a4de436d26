"""Registered queries: cleaning, standardisation, text and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import dates as DT
from ..functions import text as T
from ..sources import bindings as B
from ..sources.tables import table
from . import datasets as D

Q = {}


def q(fn):
    Q[fn.__name__] = fn
    return fn


def _dirty(spark, sf):
    return B.dirty_readings(spark, sf)


@q
def num_clean_basic(spark, sf):
    return _dirty(spark, sf).select("event_id", "raw_value", C.clean_basic("raw_value").alias("value"))


@q
def num_clean_censored(spark, sf):
    return C.add_censored(_dirty(spark, sf).select("event_id", "raw_value"), "raw_value")


@q
def num_clean_core(spark, sf):
    return _dirty(spark, sf).select("event_id", "raw_value", C.clean_core("raw_value").alias("value"))


@q
def num_bdl_zero(spark, sf):
    return _dirty(spark, sf).select("event_id", "raw_value", C.bdl_zero("raw_value").alias("value"))


@q
def num_model_input(spark, sf):
    return _dirty(spark, sf).select("event_id", "raw_value", C.model_input("raw_value").alias("value"))


def date_text(ts, event_id):
    k = F.pmod(event_id, F.lit(5))
    return (F.when(k == 0, F.date_format(ts, "yyyy-MM-dd"))
            .when(k == 1, F.date_format(ts, "dd-MM-yyyy"))
            .when(k == 2, F.date_format(ts, "dd/MM/yyyy"))
            .when(k == 3, F.date_format(ts, "dd MMM yyyy"))
            .otherwise(F.lit("not recorded")))


@q
def date_parse(spark, sf):
    ev = table(spark, sf, "events").select("event_id", date_text(F.col("ts"), F.col("event_id")).alias("date_text"))
    return ev.select("event_id", "date_text", C.parse_date("date_text").alias("parsed_date"))


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate")


@q
def date_season4(spark, sf):
    o = _orders(spark, sf)
    # every third order carries only a month abbreviation, the rest a date
    date = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MMM"))
    m = DT.month_of(date, text)
    return o.select("o_orderkey", m.alias("month_no"), DT.season4(m).alias("season"))


@q
def date_season_live(spark, sf):
    return _orders(spark, sf).select("o_orderkey", DT.season_live("o_orderdate").alias("season"))


@q
def date_month_name(spark, sf):
    return _orders(spark, sf).select("o_orderkey", DT.month_name("o_orderdate").alias("month_name"))


def _st(spark, sf):
    return D.stations(spark, sf)


@q
def str_river_infer(spark, sf):
    return _st(spark, sf).select("station_id", "station_name",
                                 T.infer_river("station_name").alias("inferred_river"))


def raw_river(station_id, river):
    k = F.pmod(station_id, F.lit(5))
    return (F.when(k == 0, F.lit("river")).when(k == 1, F.lit(None).cast("string"))
            .when(k == 2, F.lit(" ")).when(k == 3, F.lit("Lake")).otherwise(river))


@q
def str_river_fix(spark, sf):
    s = _st(spark, sf).select("station_id", "station_name",
                              raw_river(F.col("station_id"), F.col("river_name")).alias("river_name_raw"))
    return s.select("station_id", "river_name_raw", *T.fix_river("river_name_raw", "station_name"))


@q
def str_pos_tag(spark, sf):
    return _st(spark, sf).select("station_id", T.position_tag("station_name").alias("station_position_tag"))


@q
def str_context_tag(spark, sf):
    return _st(spark, sf).select("station_id", T.context_tag("station_name").alias("pollution_context_tag"))


@q
def str_spatial_tags(spark, sf):
    return _st(spark, sf).select("station_id", T.spatial_tags("station_name").alias("spatial_tags"))


@q
def str_primary_pos(spark, sf):
    return _st(spark, sf).select("station_id", T.primary_position("station_name").alias("primary_position"))


@q
def str_station_base(spark, sf):
    return _st(spark, sf).select("station_id", T.station_base("station_name").alias("station_base_name"),
                                 T.station_group("basin", "station_name").alias("station_group"))


@q
def str_normalise(spark, sf):
    return _st(spark, sf).select("station_id", T.normalise("station_name").alias("station_norm"))


@q
def str_jaccard(spark, sf):
    s = _st(spark, sf)
    return s.select("station_id", F.round(T.jaccard(T.tokens("station_name"),
                                                    T.tokens("river_name")), 6).alias("jaccard"))
