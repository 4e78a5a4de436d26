"""Text explanations as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R

# FIXED VALUES: default global drivers when no importance table is supplied
DEFAULT_DRIVERS = ["bod", "dissolved_oxygen", "ph", "temperature", "conductivity"]


def rule_explanation() -> Column:
    """xp_rule: `Non-compliant because ...` / compliant / insufficient / partial text."""
    do, bod, ph = F.col("dissolved_oxygen"), F.col("bod"), F.col("ph")
    lbl, risk = F.col("available_compliance_label"), F.coalesce(F.col("risk_category"), F.lit("Unknown"))
    reasons = F.array_compact(F.array(
        F.when(do < 5, F.concat(F.lit("DO is "), R.fmt2("dissolved_oxygen"), F.lit(" mg/L (below 5)"))),
        F.when(bod > 3, F.concat(F.lit("BOD is "), R.fmt2("bod"), F.lit(" mg/L (above 3)"))),
        F.when((ph < 6.5) | (ph > 8.5), F.concat(F.lit("pH is "), R.fmt2("ph"), F.lit(" (outside 6.5-8.5)")))))
    return (F.when(F.size(reasons) > 0, F.concat(F.lit("Non-compliant because "), F.array_join(reasons, "; "),
                                                  F.lit(". Risk category: "), risk, F.lit(".")))
            .when(lbl == "Compliant", F.concat(
                F.lit("Compliant – all measured core parameters within safe limits. Risk category: "), risk, F.lit(".")))
            .when(do.isNull() & bod.isNull() & ph.isNull(),
                  F.lit("Insufficient core data (DO, BOD, pH all missing) to evaluate compliance."))
            .otherwise(F.concat(F.lit("Label is '"), F.coalesce(lbl, F.lit("Unknown")),
                                F.lit("'. Measured core values are within limits but data may be partial."))))


def violated_parameters() -> Column:
    """Structured violations as parameter names (D8: no substring search in free text)."""
    return F.array_compact(F.array(
        F.when(F.col("dissolved_oxygen") < 5, F.lit("dissolved_oxygen")),
        F.when(F.col("bod") > 3, F.lit("bod")),
        F.when((F.col("ph") < 6.5) | (F.col("ph") > 8.5), F.lit("ph"))))


def local_explanations(df: DataFrame, drivers=DEFAULT_DRIVERS) -> DataFrame:
    """xp_local: violated core parameters first, then global drivers, at most 5; final sentence."""
    glob = F.array(*[F.lit(d) for d in drivers])
    local = F.slice(F.array_distinct(F.concat(violated_parameters(), glob)), 1, 5)
    pred = F.coalesce(F.col("ml_predicted_compliance_label"), F.col("available_compliance_label"), F.lit("Unknown"))
    d = df.select("*", rule_explanation().alias("rule_based_explanation"), local.alias("_drivers"), pred.alias("_pred"))
    return d.select(
        "station_id", "station_name", "river_name", "state_name", "sampling_date", "month",
        F.col("_pred").alias("predicted_compliance_label"), "risk_score", "risk_category", "violation_reasons",
        "label_confidence", F.array_join("_drivers", ", ").alias("top_5_model_drivers"), "rule_based_explanation",
        F.concat(F.lit("Station "), F.coalesce(F.col("station_name"), F.lit("?")), F.lit(" is predicted "), F.col("_pred"),
                 F.lit(". "), F.col("rule_based_explanation"), F.lit(" Top model drivers: "),
                 F.array_join("_drivers", ", "), F.lit(".")).alias("final_human_readable_explanation"))


def sample_key() -> Column:
    """Shared arithmetic hash used for reproducible sampling in every engine."""
    return (F.col("station_id") * 7919 + F.dayofmonth("sampling_date") * 104729 + 42) % 1000


def hash_sample(df: DataFrame, n: int = 100) -> DataFrame:
    """xp_sample: n rows by a shared hash order (station, date break ties); a bounded top-k."""
    return df.orderBy(sample_key(), "station_id", "sampling_date").limit(n)


def manual_explanation(rule_label: Column, mode: Column) -> Column:
    """xp_manual: parameter text by row (acidic / alkaline / low oxygen / organic load)."""
    do, bod, ph = F.col("dissolved_oxygen"), F.col("bod"), F.col("ph")
    parts = F.array_compact(F.array(
        F.when(ph < 6.5, F.lit("pH is acidic and below the acceptable 6.5–8.5 range."))
        .when(ph > 8.5, F.lit("pH is alkaline and above the acceptable 6.5–8.5 range.")),
        F.when(do < 5, F.lit("Dissolved Oxygen is below 5 mg/L, indicating poor oxygen availability for aquatic life.")),
        F.when(bod > 3, F.lit("BOD is above 3 mg/L, suggesting high organic pollution load."))))
    return (F.when(mode == "Auxiliary-Only ML Model", F.lit(
        "This prediction is generated using auxiliary water-quality parameters only. Rule-based compliance was not "
        "evaluated because pH, DO, and BOD were not provided."))
        .when(rule_label == "Insufficient Data", F.lit("Insufficient core parameters to determine compliance."))
        .when((F.size(parts) == 0) & (rule_label == "Compliant"),
              F.lit("All available core parameters are within acceptable limits."))
        .otherwise(F.array_join(parts, " ")))


def prediction_mode(aux_cols=("temperature", "conductivity")) -> Column:
    """mode_route: 3 core -> core model; else any auxiliary value -> auxiliary-only; else insufficient."""
    any_aux = F.lit(False)
    for c in aux_cols:
        any_aux = any_aux | F.col(c).isNotNull()
    return (F.when(F.col("core_parameter_count") == 3, F.lit("Core Rule + ML Model"))
            .when(any_aux, F.lit("Auxiliary-Only ML Model")).otherwise(F.lit("Insufficient Data")))


def manual_rule_label() -> Column:
    return (F.when(F.col("core_parameter_count") == 0, F.lit("Insufficient Data"))
            .when(F.col("violation_count") > 0, F.lit("Non-Compliant")).otherwise(F.lit("Compliant")))
