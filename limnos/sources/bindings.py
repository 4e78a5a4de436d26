"""Bindings: the driver's test tables re-read as monitoring data.

``events`` is a sensor feed (user_id = station, event_type = parameter,
ts = reading time); ``supplier -> nation -> region`` gives each station a
state and a basin; ``part.p_name`` names its water body.  Everything is lazy
DataFrame algebra over the given tables, so the work grows with them.

Partitioning notes (100 TB scale):
* readings -> samples is one hash aggregate on (station_id, day) with a
  map-side partial aggregate, so only one row per station/day/partition
  crosses the shuffle.
* the station dimension is built from the *distinct stations* (small) and
  joined to the dimension tables; it is joined back to the samples by
  station_id.  AQE broadcasts it when its measured size is under the
  broadcast bound and otherwise keeps a shuffle join; nothing is forced.
* the supplier count used to spread stations over suppliers is a scalar
  subquery (one tiny aggregate), not a driver round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# FIXED VALUES: event_type -> parameter of the sensor binding
EVENT_PARAMETER = [("error", "dissolved_oxygen"), ("click", "bod"), ("view", "ph"),
                   ("purchase", "temperature"), ("signup", "conductivity")]
#: The given tables that the bindings read.
TABLES = ["events", "supplier", "nation", "region", "part", "lineitem"]
SAMPLE_PARAMS = ["dissolved_oxygen", "bod", "ph", "temperature", "conductivity"]


def _parameter(event_type: Column) -> Column:
    expr = F.lit("conductivity")
    for ev, param in reversed(EVENT_PARAMETER[:-1]):
        expr = F.when(event_type == ev, F.lit(param)).otherwise(expr)
    return expr


def _reading_value(event_type: Column, v: Column) -> Column:
    return (F.when(event_type == "error", F.least(v / 5.0, F.lit(14.0)))
            .when(event_type == "click", v / 20.0)
            .when(event_type == "view", F.lit(6.0) + F.least(v, F.lit(200.0)) / 40.0)
            .when(event_type == "purchase", F.least(v / 3.0, F.lit(40.0)))
            .otherwise(v * 10.0))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM8 long readings: event_id, station_id, ts, parameter, value."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.col("user_id").alias("station_id"),
        "ts",
        _parameter(F.col("event_type")).alias("parameter"),
        _reading_value(F.col("event_type"), F.col("value")).alias("value"),
    )


def month_no(d: Column) -> Column:
    """Monitoring cycle of a date: ten-day periods 1, 2, 3 of the month."""
    return (F.least(F.floor((F.dayofmonth(d) - 1) / 10), F.lit(2)) + 1).cast("int")


# FIXED VALUES: the three monitoring cycles are reported like monthly files
CYCLE_NAMES = ["July", "August", "September"]


def cycle_name(m: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in CYCLE_NAMES]), m)


def daily_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM2 core: one row per station and day with the mean of each parameter.

    Means are rounded to 9 decimals so that the result does not depend on
    the order rows arrive in (floating sums are not associative).
    """
    r = readings(spark, sf_dir)
    aggs = [F.round(F.avg(F.when(F.col("parameter") == p, F.col("value"))), 9).alias(p)
            for p in SAMPLE_PARAMS]
    return (r.groupBy("station_id", F.to_date("ts").alias("sampling_date"))
            .agg(*aggs, F.count(F.lit(1)).alias("n_readings")))


#: Laboratory parameters of the expanded samples: events by event_id mod 13.
LAB_PARAMS = ["nitrate", "fecal_coliform", "total_coliform", "turbidity", "cod", "total_dissolved_solids"]


def lab_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per station and day: the mean of each laboratory parameter that was measured, and what was noted of
    weather and odour."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    aggs = [F.round(F.avg(F.when(F.col("event_id") % 13 == k, F.col("value"))), 9).alias(p) for k, p in enumerate(LAB_PARAMS)]
    k = F.col("event_id")
    aggs += [F.min(F.when(k % 17 == 3, F.lit("Clear")).when(k % 17 == 5, F.lit("Rainy"))).alias("weather"),
             F.min(F.when(k % 19 == 7, F.lit("Odour Free"))).alias("odour")]
    return ev.groupBy(F.col("user_id").alias("station_id"), F.to_date("ts").alias("sampling_date")).agg(*aggs)


def station_names(station_id: Column, river: Column) -> Column:
    """Station name template by station_id mod 6; pairs 6k / 6k+1 share a base."""
    town = F.concat(F.lit("Town "), (station_id / 6).cast("bigint").cast("string"))
    k = F.pmod(station_id, F.lit(6))
    return (F.when(k == 0, F.concat_ws(" ", river, F.lit("river U/S of"), town))
            .when(k == 1, F.concat_ws(" ", river, F.lit("river D/S of"), town))
            .when(k == 2, F.concat_ws(" ", river, F.lit("creek near drain at"), town))
            .when(k == 3, F.concat_ws(" ", river, F.lit("lake at"), town))
            .when(k == 4, F.concat_ws(" ", river, F.lit("well at"), town))
            .otherwise(F.concat_ws(" ", river, F.lit("at"), town)))


def station_dim(spark: SparkSession, sf_dir: str, station_ids: DataFrame) -> DataFrame:
    """Station attributes for a (small) frame of distinct station ids."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n_supp = supplier.select(F.count(F.lit(1))).scalar()
    s = station_ids.select(
        "station_id",
        F.pmod(F.col("station_id"), n_supp).alias("_supp"),
        (F.col("station_id") / 2).cast("bigint").alias("_part"))
    geo = (s.join(supplier, s["_supp"] == supplier["s_suppkey"], "left")
           .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
           .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
           .join(part, F.col("_part") == F.col("p_partkey"), "left"))
    river = F.coalesce(F.initcap(F.col("p_name")), F.lit("Unnamed"))
    return geo.select(
        "station_id",
        station_names(F.col("station_id"), river).alias("station_name"),
        river.alias("river_name"),
        F.col("n_name").alias("state_name"),
        F.col("r_name").alias("basin"),
    )


SAMPLE_COLUMNS = ["source_file", "station_id", "station_name", "river_name", "state_name", "basin",
                  "sampling_date", "month_no", "month", "year", *SAMPLE_PARAMS, "n_readings"]
LIVE_COLUMNS = ["event_id", "station_id", "station_no", "station_name", "state", "latitude", "longitude",
                "parameter_raw_name", "timestamp", "value", "unit"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM2 canonical samples with station metadata and the monitoring cycle."""
    core = daily_samples(spark, sf_dir)
    dim = station_dim(spark, sf_dir, core.select("station_id").distinct())
    m = month_no(F.col("sampling_date"))
    return core.join(dim, "station_id", "left").select(
        F.concat(F.lit("nwmp_"), F.lower(cycle_name(m)), F.lit(".csv")).alias("source_file"),
        "station_id", "station_name", "river_name", "state_name", "basin",
        "sampling_date", m.alias("month_no"), cycle_name(m).alias("month"),
        F.year("sampling_date").alias("year"),
        *SAMPLE_PARAMS, "n_readings")


# ---------------------------------------------------------------------------
# Dirty text binding: each reading printed the way field sheets write it.
# ---------------------------------------------------------------------------

def printed(v: Column) -> Column:
    return v.cast("decimal(10,2)").cast("string")


def dirty_text(v: Column, event_id: Column) -> Column:
    """By event_id mod 11: BDL, <v, v(BDL), v mg/l, nd, -, empty, 1,234-style, .5-style, else v.

    ``v`` has two decimals (the event value), so printing never rounds.
    """
    k = F.pmod(event_id, F.lit(11))
    p = printed(v)
    return (F.when(k == 0, F.lit("BDL"))
            .when(k == 1, F.concat(F.lit("<"), p))
            .when(k == 2, F.concat(p, F.lit("(BDL)")))
            .when(k == 3, F.concat(p, F.lit(" mg/l")))
            .when(k == 4, F.lit("nd"))
            .when(k == 5, F.lit("-"))
            .when(k == 6, F.lit(""))
            .when(k == 7, F.concat(F.floor(v).cast("string"), F.lit(","),
                                   F.substring(p, -2, 2), F.lit("0")))
            .when(k == 8, F.regexp_replace(p, r"^0\.", "."))
            .otherwise(p))


def dirty_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with the event value as dirty field text (DM1 raw source)."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.col("user_id").alias("station_id"), "ts",
                     _parameter(F.col("event_type")).alias("parameter"),
                     dirty_text(F.col("value"), F.col("event_id")).alias("raw_value"))


# ---------------------------------------------------------------------------
# Annual min/max record binding (DM5): per supplier and ship year.
# ---------------------------------------------------------------------------

def annual_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return (li.groupBy(F.col("l_suppkey").alias("station_code"),
                       F.year("l_shipdate").alias("year"))
            .agg(F.min("l_quantity").alias("quantity_min"),
                 F.max("l_quantity").alias("quantity_max"),
                 F.min("l_extendedprice").alias("price_min"),
                 F.max("l_extendedprice").alias("price_max"),
                 F.min("l_discount").alias("discount_min"),
                 F.max("l_discount").alias("discount_max"),
                 F.min("l_tax").alias("tax_min"),
                 F.max("l_tax").alias("tax_max")))


# ---------------------------------------------------------------------------
# Live sensor feed binding (DM8): one JSON-like reading object per event.
# ---------------------------------------------------------------------------

# FIXED VALUES: raw sensor parameter names of the live binding
LIVE_RAW_NAMES = [("error", "Dissolved Oxygen"), ("click", "BOD"), ("view", "pH"),
                  ("purchase", "Temp"), ("signup", "EC")]
LIVE_UNITS = [("error", "mg/L"), ("click", "mg/L"), ("view", "pH"), ("purchase", "degC"),
              ("signup", "uS/cm")]


def _by_type(event_type: Column, pairs) -> Column:
    expr = F.lit(pairs[-1][1])
    for ev, v in reversed(pairs[:-1]):
        expr = F.when(event_type == ev, F.lit(v)).otherwise(expr)
    return expr


def live_reading_value(event_type: Column, v: Column) -> Column:
    """Calibrated live reading; every branch has at most 4 decimals (exact printing)."""
    return (F.when(event_type == "error", v / 50.0)
            .when(event_type == "click", v / 20.0)
            .when(event_type == "view", F.lit(6.0) + v / 100.0)
            .when(event_type == "purchase", v / 10.0)
            .otherwise(v * 10.0))


def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw live feed: station metadata + raw parameter name + value text per reading."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    dim = station_dim(spark, sf_dir, ev.select(F.col("user_id").alias("station_id")).distinct())
    et, eid = F.col("event_type"), F.col("event_id")
    raw_name = (F.when(eid % 13 == 0, F.lit("Chlorophyll"))
                .when(eid % 17 == 0, F.lit(None).cast("string"))
                .otherwise(_by_type(et, LIVE_RAW_NAMES)))
    text = (F.when(eid % 19 == 0, F.lit("NA"))
            .otherwise(live_reading_value(et, F.col("value")).cast("decimal(12,4)").cast("string")))
    sid = F.col("user_id")
    return ev.join(dim, ev["user_id"] == dim["station_id"], "left").select(
        "event_id", "station_id",
        F.concat(F.lit("ST"), F.lpad(sid.cast("string"), 4, "0")).alias("station_no"),
        "station_name", F.col("state_name").alias("state"),
        (F.lit(8.0) + F.pmod(sid, F.lit(29)) * 0.5).alias("latitude"),
        (F.lit(68.0) + F.pmod(sid * 7, F.lit(31)) * 0.5).alias("longitude"),
        raw_name.alias("parameter_raw_name"), F.col("ts").alias("timestamp"),
        text.alias("value"), _by_type(et, LIVE_UNITS).alias("unit"))


# ---------------------------------------------------------------------------
# Raw upload binding (DM1): a wide, all-string sheet with field-sheet headers.
# ---------------------------------------------------------------------------

RAW_COLUMNS = ["source_file", "Station Name", "Monitoring Location", "Name of Water Body", "Date",
               "DO (mg/L)", "Dissolved Oxygen Min", "Dissolved Oxygen Normalized", "BOD (mg/L)",
               "pH Value", "PH-Value", "Temperature (C)", "Electric Conductivity (umho/cm)", "Class"]


def raw_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw sheet row per station and day; every value is text as typed in the field."""
    d = dirty_readings(spark, sf_dir)
    p, v = F.col("parameter"), F.col("raw_value")

    def pick(param, agg=F.min):
        return agg(F.when(p == param, v))
    g = d.groupBy("station_id", F.to_date("ts").alias("sampling_date")).agg(
        pick("dissolved_oxygen").alias("DO (mg/L)"),
        pick("dissolved_oxygen", F.max).alias("_do_max"),
        pick("bod").alias("BOD (mg/L)"),
        pick("ph").alias("pH Value"),
        pick("ph", F.max).alias("PH-Value"),
        pick("temperature").alias("Temperature (C)"),
        pick("conductivity").alias("Electric Conductivity (umho/cm)"))
    dim = station_dim(spark, sf_dir, g.select("station_id").distinct())
    sid = F.col("station_id")
    m = month_no(F.col("sampling_date"))
    return g.join(dim, "station_id", "left").select(
        F.concat(F.lit("upload_"), F.lower(cycle_name(m)), F.lit(".csv")).alias("source_file"),
        "station_id",
        F.when(sid % 5 != 0, F.col("station_name")).alias("Station Name"),
        F.when(sid % 3 == 0, F.col("station_name")).alias("Monitoring Location"),
        F.when(sid % 7 != 0, F.col("river_name")).alias("Name of Water Body"),
        F.date_format("sampling_date", "dd-MM-yyyy").alias("Date"),
        "DO (mg/L)",
        F.when(F.col("DO (mg/L)").isNull(), F.col("_do_max")).alias("Dissolved Oxygen Min"),
        F.col("_do_max").alias("Dissolved Oxygen Normalized"),
        "BOD (mg/L)", "pH Value", "PH-Value", "Temperature (C)", "Electric Conductivity (umho/cm)",
        F.element_at(F.array(*[F.lit(x) for x in ["A", "B", "C", "D", "E"]]),
                     (F.pmod(sid, F.lit(5)) + 1).cast("int")).alias("Class"))


#: Headers of the laboratory sheet; a reading with event_id mod 13 = k is of the k-th, and others are of none.
LAB_SHEET = ["Nitrate (mg/L)", "Fecal Coliform (MPN/100ml)", "Total Coliform (MPN/100ml)", "Turbidity (NTU)", "COD", "TDS", "EC",
             "E. coli", "Chloride (mg/L)", "Arsenic (mg/L)"]


def lab_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw laboratory sheet row per station and day, as typed, with headers unlike the field sheet's."""
    d = dirty_readings(spark, sf_dir)
    g = d.where(F.col("event_id") % 13 < len(LAB_SHEET)).groupBy("station_id", F.to_date("ts").alias("day")).agg(
        *[F.min(F.when(F.col("event_id") % 13 == k, F.col("raw_value"))).alias(h) for k, h in enumerate(LAB_SHEET)])
    dim = station_dim(spark, sf_dir, g.select("station_id").distinct())
    return g.join(dim, "station_id", "left").select(
        F.concat(F.lit("lab_"), F.lower(cycle_name(month_no(F.col("day")))), F.lit(".csv")).alias("source_file"), "station_id",
        F.when(F.col("station_id") % 5 != 0, F.col("station_name")).alias("Stn Name"),
        F.date_format("day", "dd-MM-yyyy").alias("Sampling Date"), *[F.col(f"`{h}`") for h in LAB_SHEET])


def annual_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual min/max records with the supplier's basin (region) for group imputation."""
    a = annual_records(spark, sf_dir)
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = (supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
           .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
           .select(F.col("s_suppkey").alias("station_code"), F.col("r_name").alias("river_basin")))
    # gaps to impute: every 7th supplier lost its price range, every 5th year-row its tax range
    out = a.join(geo, "station_code", "left")
    return out.select(
        "station_code", "year", "river_basin", "quantity_min", "quantity_max",
        F.when(F.col("station_code") % 7 != 0, F.col("price_min")).alias("price_min"),
        F.when(F.col("station_code") % 7 != 0, F.col("price_max")).alias("price_max"),
        "discount_min", "discount_max",
        F.when((F.col("station_code") + F.col("year")) % 5 != 0, F.col("tax_min")).alias("tax_min"),
        F.when((F.col("station_code") + F.col("year")) % 5 != 0, F.col("tax_max")).alias("tax_max"))
