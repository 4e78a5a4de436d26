"""Live sensor operators (E3): ingest projection, latest state, labels, alerts.

The same functions run on a batch DataFrame and inside a streaming
``foreachBatch``; only the source differs (see ``limnos.streaming``).

Scale notes:
* latest-per-key uses ``max_by(value, struct(ts, event_id))`` - an algebraic
  aggregate (constant buffer per key) that combines map-side, so a hot
  station never has its readings gathered in one task.  NULL ordering keys
  are ignored by ``max_by``, which reproduces "last non-null per column".
* the long -> wide pivot uses a fixed parameter list (no distinct pass).
* alerts are one ``explode`` of an array of structs per station: no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import dates as DT
from ..functions import rules as R
from ..functions import text as T


def ingest(feed: DataFrame) -> DataFrame:
    """st_ingest projection: canonical parameter, numeric value, numeric flag."""
    vn = F.col("value").try_cast("double")
    return feed.select("*", T.canonical_parameter("parameter_raw_name").alias("parameter"),
                       vn.alias("value_numeric"), vn.isNotNull().alias("is_numeric_value"))


def _key():
    return F.struct(F.col("timestamp"), F.col("event_id"))


def _last_non_null(c: str) -> Column:
    col = F.col(c)
    return F.max_by(col, F.when(col.isNotNull(), _key()))


def latest_per_parameter(readings: DataFrame) -> DataFrame:
    """win_latest: latest reading per station x parameter (last non-null per column)."""
    return readings.groupBy("station_id", "parameter").agg(
        F.max("timestamp").alias("latest_timestamp"),
        _last_non_null("value_numeric").alias("latest_value"),
        _last_non_null("value").alias("latest_value_text"),
        _last_non_null("station_name").alias("station_name"))


META = ["station_no", "station_name", "state", "latitude", "longitude"]


def latest_station_meta(readings: DataFrame) -> DataFrame:
    """win_latest_station: latest metadata per station."""
    return readings.groupBy("station_id").agg(
        *[_last_non_null(c).alias(c) for c in META], F.max("timestamp").alias("latest_timestamp"))


def live_wide(latest: DataFrame, params=K.LIVE_PARAMS) -> DataFrame:
    """piv_live_wide: station x parameter matrix of latest numeric values."""
    return latest.groupBy("station_id").pivot("parameter", list(params)).agg(F.max("latest_value"))


def live_state(readings: DataFrame) -> DataFrame:
    """jn_live_meta + core_conf: latest metadata LEFT JOIN latest values, season, availability.

    Readings are shuffled ONCE: the per-(station, parameter) aggregate also keeps each
    metadata column's latest value with its ordering key, and the per-station metadata
    is re-aggregated from that small table (max_by over the keys is associative).
    """
    latest = readings.groupBy("station_id", "parameter").agg(
        F.max("timestamp").alias("latest_timestamp"),
        _last_non_null("value_numeric").alias("latest_value"),
        _last_non_null("value").alias("latest_value_text"),
        *[_last_non_null(c).alias(f"_m_{c}") for c in META],
        *[F.max(F.when(F.col(c).isNotNull(), _key())).alias(f"_k_{c}") for c in META])
    meta = latest.groupBy("station_id").agg(
        *[F.max_by(f"_m_{c}", f"_k_{c}").alias(c) for c in META], F.max("latest_timestamp").alias("latest_timestamp"))
    return assemble_state(latest.select("station_id", "parameter", "latest_timestamp", "latest_value",
                                        "latest_value_text"), meta)


def assemble_state(latest: DataFrame, meta: DataFrame) -> DataFrame:
    """Live station state from per-parameter latest values and per-station metadata."""
    return completed(meta.join(live_wide(latest), "station_id", "left"))


def completed(state: DataFrame) -> DataFrame:
    """Season and availability of stations with their latest values."""
    return state.select("*", DT.season_live("latest_timestamp").alias("season"), *core_conf_columns())


def _join_present(params, present: bool) -> Column:
    arr = F.array_compact(F.array(*[
        F.when(F.col(p).isNotNull() if present else F.col(p).isNull(), F.lit(p)) for p in params]))
    return R.none_if_empty(arr, "|")


def core_conf_columns() -> list[Column]:
    """core_conf: available / missing lists for 12 parameters and the 3 core ones."""
    n = R.present_count(*K.CORE_PARAMS)
    return [_join_present(K.LIVE_PARAMS, True).alias("available_live_parameters"),
            _join_present(K.LIVE_PARAMS, False).alias("missing_model_features"),
            n.alias("core_parameter_count"),
            _join_present(K.CORE_PARAMS, True).alias("available_core_parameters"),
            _join_present(K.CORE_PARAMS, False).alias("missing_core_parameters"),
            R.live_confidence(n).alias("live_data_confidence")]


def live_predictions(state: DataFrame) -> DataFrame:
    """Live scoring with the deterministic stand-in model + live labels + note."""
    risk = R.risk_score()
    h = ((F.col("station_id") * 7919 + F.dayofmonth("latest_timestamp") * 104729 + 42) % 1000) / 1000.0
    p = F.lit(0.6) * (F.coalesce(risk, F.lit(50.0)) / 100.0) + F.lit(0.4) * h
    s = state.select("*", *R.live_label_columns(), p.alias("live_ml_non_compliance_probability"))
    return s.select("*", (F.col("live_ml_non_compliance_probability") >= 0.5).cast("int")
                    .alias("live_ml_predicted_non_compliant"),
                    F.when(F.col("live_ml_non_compliance_probability") >= 0.5, F.lit("Non-Compliant"))
                    .otherwise(F.lit("Compliant")).alias("live_ml_predicted_compliance_label"),
                    R.prediction_note("core_parameter_count").alias("ml_prediction_confidence_note"))


def _alert(kind, severity, parameter, value, reason, action) -> Column:
    return F.struct(F.lit(kind).alias("alert_type"), severity.alias("severity"),
                    F.lit(parameter).alias("parameter"), value.alias("value"),
                    reason.alias("reason"), F.lit(action).alias("recommended_action"))


def live_alerts(pred: DataFrame, as_of: Column) -> DataFrame:
    """alr_live: per-station live alerts; Normal only when a station has none (D14)."""
    ph, do, bod = F.col("ph"), F.col("dissolved_oxygen"), F.col("bod")
    n = F.col("core_parameter_count")
    ts = F.col("latest_timestamp")
    prob = F.col("live_ml_non_compliance_probability")
    ts_text = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    ph_t, do_t, bod_t = R.fmt_short("ph"), R.fmt_short("dissolved_oxygen"), R.fmt_short("bod")
    alerts = F.array_compact(F.array(
        F.when(ts < as_of - F.expr("INTERVAL 24 HOURS"), _alert(
            "Live Stale Data Alert", F.lit("Warning"), "timestamp", ts_text,
            F.lit("Live data is older than 24 hours."), "Check station connectivity and API status.")),
        F.when(ph < K.PH_MIN, _alert(
            "Live pH Acidic Alert", F.when(ph >= 6.0, F.lit("Warning")).otherwise(F.lit("High")), "ph",
            ph_t, F.concat(F.lit("pH is "), ph_t, F.lit(", below safe minimum of 6.5.")),
            "Inspect nearby discharge source.")),
        F.when(ph > K.PH_MAX, _alert(
            "Live pH Alkaline Alert", F.when(ph <= 9.0, F.lit("Warning")).otherwise(F.lit("High")), "ph",
            ph_t, F.concat(F.lit("pH is "), ph_t, F.lit(", above safe maximum of 8.5.")),
            "Inspect nearby discharge source.")),
        F.when(do < K.DO_MIN, _alert(
            "Live DO Alert", F.when(do >= 3, F.lit("High")).otherwise(F.lit("Severe")), "dissolved_oxygen",
            do_t, F.concat(F.lit("DO is "), do_t, F.lit(", below required minimum of 5 mg/L.")),
            "Escalate for field verification.")),
        F.when(bod > K.BOD_MAX, _alert(
            "Live BOD Alert", F.when(bod <= 6, F.lit("High")).otherwise(F.lit("Severe")), "bod",
            bod_t, F.concat(F.lit("BOD is "), bod_t, F.lit(", above required maximum of 3 mg/L.")),
            "Escalate for field verification.")),
        F.when((n > 0) & (n < 3), _alert(
            "Live Missing Core Parameter Alert", F.lit("Info"), "core_parameters", F.col("missing_core_parameters"),
            F.concat(F.lit("Missing critical regulatory parameters: "), F.col("missing_core_parameters"), F.lit(".")),
            "Fetch missing DO/BOD live feeds if available.")),
        F.when(F.col("live_ml_predicted_compliance_label") == "Non-Compliant", _alert(
            "Live ML Non-Compliance Alert", F.when(prob > 0.8, F.lit("High")).otherwise(F.lit("Warning")),
            "ML Model", F.coalesce(R.fmt2("live_ml_non_compliance_probability"), F.lit("Unknown")),
            F.lit("Machine learning model predicts non-compliance based on available features."),
            "Repeat sampling to confirm compliance.")),
    ))
    normal = F.when((F.size(alerts) == 0) & (n == 3) & (F.col("live_strict_compliance_label") == "Compliant"),
                    F.array(_alert("Normal Status", F.lit("Normal"), "All", F.lit("OK"),
                                   F.lit("All parameters within safe limits."), "Continue monitoring.")))
    out = pred.select("station_id", "station_name", ts.alias("timestamp"),
                      F.explode(F.coalesce(normal, alerts)).alias("a")).select(
        "station_id", "station_name", "timestamp", "a.*")
    return out.select(F.substring(F.sha2(F.concat_ws("|", F.col("station_id").cast("string"), F.col("alert_type"),
                                                     F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")), 256), 1, 16)
                      .alias("live_alert_id"), "*")


def coverage(readings: DataFrame) -> DataFrame:
    """st_coverage: per parameter records, stations, latest ts, numeric count, min / max / mean."""
    num = F.when(F.col("is_numeric_value"), F.col("value_numeric"))
    return readings.groupBy("parameter").agg(
        F.count(F.lit(1)).alias("record_count"), F.countDistinct("station_name").alias("station_count"),
        F.max("timestamp").alias("latest_timestamp"), F.count_if(F.col("is_numeric_value")).alias("non_null_value_count"),
        F.min(num).alias("min_value"), F.max(num).alias("max_value"),
        (F.sum(num.cast("decimal(38,9)")).cast("double") / F.count(num)).alias("mean_value"))


def station_matrix(readings: DataFrame, params=K.LIVE_PARAMS) -> DataFrame:
    """st_matrix: station_name x parameter latest raw value text."""
    latest = readings.groupBy("station_name", "parameter").agg(
        F.max_by(F.col("value"), F.when(F.col("value").isNotNull(), _key())).alias("v"))
    return latest.groupBy("station_name").pivot("parameter", list(params)).agg(F.max("v"))


def data_age(ts: Column, as_of: Column) -> list[Column]:
    """st_stale (batch): age in hours, display text, 24 h stale flag, 6 h warning flag."""
    secs = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1e6
    hours = secs / 3600.0
    text = (F.when(ts.isNull(), F.lit("Not available"))
            .when(hours < 1, F.concat(F.floor(secs / 60).cast("string"), F.lit(" minutes old")))
            .when(hours < 24, F.concat(R.fmt1(hours), F.lit(" hours old")))
            .otherwise(F.concat(R.fmt1(hours / 24.0), F.lit(" days old"))))
    return [hours.alias("age_hours"), text.alias("age_text"), (hours > 24).alias("is_stale_24h"),
            (hours > 6).alias("warn_6h")]


def live_explanations(pred: DataFrame, drivers: str = "BOD, dissolved_oxygen, pH, temperature, conductivity") -> DataFrame:
    """xp_live: rule, model, missing-data and final explanation text per station."""
    ph, do, bod = F.col("ph"), F.col("dissolved_oxygen"), F.col("bod")
    ph_t, do_t, bod_t = R.fmt_short("ph"), R.fmt_short("dissolved_oxygen"), R.fmt_short("bod")
    parts = F.array_compact(F.array(
        F.when((ph >= 6.5) & (ph <= 8.5), F.concat(F.lit("pH is "), ph_t, F.lit(", within the safe range 6.5-8.5.")))
        .when(ph.isNotNull(), F.concat(F.lit("pH is "), ph_t, F.lit(", outside the safe range 6.5-8.5."))),
        F.when(do >= 5, F.concat(F.lit("DO is "), do_t, F.lit(" mg/L, meeting the >=5 mg/L requirement.")))
        .when(do.isNotNull(), F.concat(F.lit("DO is "), do_t, F.lit(" mg/L, violating the >=5 mg/L requirement."))),
        F.when(bod <= 3, F.concat(F.lit("BOD is "), bod_t, F.lit(" mg/L, meeting the <=3 mg/L requirement.")))
        .when(bod.isNotNull(), F.concat(F.lit("BOD is "), bod_t, F.lit(" mg/L, violating the <=3 mg/L requirement."))),
    ))
    rule = F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(F.lit("No core parameter rules could be evaluated."))
    label = F.col("live_ml_predicted_compliance_label")
    model = F.concat(F.lit("The ML model predicts this station is "), label,
                     F.lit(f". The strongest global drivers for the model are generally: {drivers}."))
    miss = F.col("missing_core_parameters")
    missing_txt = F.when(miss != "None", F.concat(
        F.lit("Warning: "), F.regexp_replace(miss, r"\|", ", "),
        F.lit(" are missing from the live feed. Full DO/BOD/pH compliance cannot be determined from this live record.")
    )).otherwise(F.lit("No major missing core parameters for this station."))
    n = F.col("core_parameter_count")
    final = (F.when(n == 3, F.concat(
        F.lit("Station "), F.col("station_name"), F.lit(" is classified "), label, F.lit(" by rule and ML. "),
        F.regexp_replace(F.col("live_violation_reasons"), r" \| ", " and "),
        F.lit(f". The prediction has high confidence because DO, BOD, and pH are available. Top model drivers are {drivers}.")))
        .when(n > 0, F.concat(
            F.lit("Latest live data indicates "), rule, F.lit(" However, "), F.regexp_replace(miss, r"\|", ", "),
            F.lit(" are missing, so full regulatory compliance cannot be confirmed. The ML model provides a "
                  "limited-confidence estimate because key regulatory features are unavailable.")))
        .otherwise(F.lit("No core parameters (DO, BOD, pH) are available in the live feed. Cannot assess compliance.")))
    return pred.select("station_id", "station_name", "latest_timestamp", rule.alias("live_rule_explanation"),
                       model.alias("live_model_explanation"), F.lit(drivers).alias("live_xai_top_drivers"),
                       missing_txt.alias("live_missing_data_explanation"), final.alias("live_final_explanation"))
