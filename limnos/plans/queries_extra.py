"""Registered queries: remaining rules, explanations, sets, sources on tables, serving (2.1/2.3/2.6/2.9/2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import explain as X
from ..operators import live as LV
from ..operators import ml as ML
from ..operators import monitoring as M
from ..operators import profile as P
from ..operators import serving as SV
from ..sources.tables import table
from . import datasets as D
from . import queries_history as QH
from . import queries_live as QL
from . import queries_ml as QM
from .out import rounded

Q = {}


def q(fn):
    Q[fn.__name__] = fn
    return fn


@q
def lbl_expanded(spark, sf):
    return D.samples(spark, sf).select("station_id", "sampling_date", *R.expanded_label_columns())


@q
def rsk_repair(spark, sf):
    l = D.labelled(spark, sf)
    # inputs with gaps: every 4th station lost its score, the next one its category
    score_in = F.when(F.col("station_id") % 4 != 0, F.col("risk_score"))
    cat_in = F.when(F.col("station_id") % 4 == 1, F.lit("Unknown")).otherwise(F.col("risk_category"))
    d = l.select("station_id", "sampling_date", "dissolved_oxygen", "bod", "ph",
                 score_in.alias("risk_score_in"), cat_in.alias("risk_category_in"))
    computed = R.risk_score()
    score = F.coalesce(F.col("risk_score_in"), computed)
    cat = (F.when(F.col("risk_score_in").isNull(), R.risk_category(computed))
           .when((F.col("risk_category_in").isNull() | (F.col("risk_category_in") == "Unknown")),
                 R.risk_category("risk_score_in"))
           .otherwise(F.col("risk_category_in")))
    return d.select("station_id", "sampling_date", "risk_score_in", "risk_category_in",
                    score.alias("risk_score"), cat.alias("risk_category"))


@q
def rsk_prob(spark, sf):
    p = D.predictions(spark, sf)
    prob = F.when(F.col("station_id") % 7 != 0, F.col("ml_non_compliance_probability"))
    return p.select("station_id", "sampling_date", prob.alias("p"), "predicted_non_compliant") \
        .select("station_id", "sampling_date", *R.risk_from_probability("p", "predicted_non_compliant"))


@q
def rsk_action(spark, sf):
    return D.labelled(spark, sf).select("station_id", "sampling_date", "risk_category",
                                        R.risk_action("risk_category").alias("recommended_action"))


@q
def mode_route(spark, sf):
    l = D.labelled(spark, sf)
    mode = X.prediction_mode()
    return l.select("station_id", "sampling_date", mode.alias("prediction_mode"),
                    X.manual_rule_label().alias("rule_label"))


@q
def xp_rule(spark, sf):
    return D.labelled(spark, sf).select("station_id", "sampling_date",
                                        X.rule_explanation().alias("rule_based_explanation"))


@q
def xp_local(spark, sf):
    return X.local_explanations(D.predictions(spark, sf))


@q
def xp_sample(spark, sf):
    return X.local_explanations(X.hash_sample(D.predictions(spark, sf), 100))


@q
def xp_manual(spark, sf):
    l = D.labelled(spark, sf)
    mode, rl = X.prediction_mode(), X.manual_rule_label()
    return l.select("station_id", "sampling_date", X.manual_explanation(rl, mode).alias("manual_explanation"))


@q
def top_contrib(spark, sf):
    return rounded(D.labelled(spark, sf).orderBy(F.col("risk_score").desc_nulls_last(), "station_id", "sampling_date")
                   .limit(10).select("station_id", "sampling_date", "station_name", "risk_score", "risk_category"))


FEATURES = ["dissolved_oxygen", "bod", "ph", "temperature", "conductivity"]


@q
def set_distinct(spark, sf):
    l = D.labelled(spark, sf).withColumn(
        "target", (F.col("available_compliance_label") == "Non-Compliant").cast("int"))
    full = l.groupBy(*l.columns).count()
    feat = l.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target").alias("k"))
    ft = l.groupBy(*FEATURES, "target").count()
    return full.agg(F.sum(F.col("count") - 1).alias("full_row_duplicates")).select(
        "full_row_duplicates",
        feat.agg(F.sum(F.col("n") - 1)).scalar().alias("feature_duplicates"),
        ft.agg(F.sum(F.col("count") - 1)).scalar().alias("feature_target_duplicates"),
        feat.where(F.col("k") > 1).select(F.count(F.lit(1))).scalar().alias("label_collisions"))


@q
def upv_long(spark, sf):
    return (D.expanded(spark, sf).unpivot(["station_id", "sampling_date"], P.EXPANDED, "parameter", "value")
            .where(F.col("value").isNotNull()))


@q
def jn_state_code(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey")
    return n.select("n_nationkey", T.state_from_code("n_nationkey").alias("state_name"))


def source_files(spark, sf):
    """File-name binding: one raw upload per station (state code and parameter group in the name)."""
    st = D.stations(spark, sf)
    code = F.element_at(F.array(*[F.lit(x) for x in ["as", "ar", "ka", "jk", "ap", "xx"]]),
                        (F.pmod("station_id", F.lit(6)) + 1).cast("int"))
    grp = F.element_at(F.array(*[F.lit(x) for x in ["biological", "chemical", "physical", "mixed"]]),
                       (F.pmod("station_id", F.lit(4)) + 1).cast("int"))
    prefix = F.when(F.col("station_id") % 2 == 0, F.lit("cpcb_")).otherwise(F.lit("wq_"))
    mid = F.when(F.col("station_id") % 2 == 0, code).otherwise(F.concat(F.lit("_"), code, F.lit("_")))
    return st.select("station_id", F.concat(prefix, mid, F.lit("_"), grp, F.lit("_"),
                                            F.col("station_id").cast("string"), F.lit(".csv")).alias("file_name"))


@q
def src_infer_state(spark, sf):
    f = source_files(spark, sf)
    return f.select("station_id", "file_name", T.state_from_filename("file_name").alias("inferred_state"),
                    T.group_from_filename("file_name").alias("parameter_group"))


@q
def std_state_fill(spark, sf):
    """The state that a row has; where it has none, the one of its file name."""
    f = src_infer_state(spark, sf)
    s = D.samples(spark, sf).join(f.select("station_id", "inferred_state"), "station_id", "left")
    existing = F.when(F.col("station_id") % 3 != 0, F.col("state_name"))  # a third of the uploads came without a state
    return s.select("station_id", "sampling_date",
                    F.coalesce(existing, F.when(F.col("inferred_state") != "Unknown", F.col("inferred_state"))).alias("state"))


@q
def src_union(spark, sf):
    batch = D.samples(spark, sf).select("station_id", "sampling_date", "station_name", *FEATURES) \
        .withColumn("data_origin", F.lit("nwmp_batch")).withColumn("integration_phase", F.lit("phase_4"))
    live = LV.live_state(QL.readings(spark, sf)).select(
        "station_id", "station_name", "latest_timestamp", *FEATURES, "nitrate", "turbidity") \
        .withColumn("data_origin", F.lit("live_sensor"))
    return batch.unionByName(live, allowMissingColumns=True)


@q
def src_split(spark, sf):
    s = D.samples(spark, sf)
    target = (F.when(F.col("source_file") == "nwmp_july.csv", F.lit("operational"))
              .when(F.col("source_file").rlike("(?i)august"), F.lit("validation"))
              .when(F.col("source_file").rlike("(?i)sept"), F.lit("holdout")))
    return s.groupBy(target.alias("dataset")).agg(F.count(F.lit(1)).alias("rows"))


@q
def src_hash_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    h = docs.select("doc_id", "source", F.sha2("text", 256).alias("content_sha256"))
    # known-file exclusion first (anti join on a bounded literal list), then first copy per hash
    known = spark.createDataFrame([("known_upload",)], "source string")
    h = h.join(F.broadcast(known), "source", "left_anti")
    # first copy per content hash: min(doc_id) is algebraic (map-side combine), so a hash shared by
    # a third of all documents is reduced in every map task instead of sorted in one window task
    return h.groupBy("content_sha256").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "content_sha256")


@q
def sv_filter(spark, sf):
    p = D.predictions(spark, sf)
    return SV.apply_filters(p, month="August", risk="High Risk").select("station_id", "sampling_date", "risk_category")


def _overview(spark, sf):
    p = D.predictions(spark, sf)
    hot = M.hotspot_summary(p)
    alerts = M.operational_alerts(M.membership(p, hot, M.station_trends(p)))
    _, _, baseline = QH._inputs(spark, sf)
    return SV.overview(p, hot, alerts, baseline, ML.metrics(QM.stand_in_scored(spark, sf)))


@q
def sv_overview(spark, sf):
    return rounded(_overview(spark, sf))


@q
def sv_model_metrics(spark, sf):
    """Metrics of the best trained model of each variant and split."""
    return rounded(SV.best_models(QM.report_metrics(spark, sf)))


@q
def sv_readings(spark, sf):
    p = D.predictions(spark, sf)
    return p.orderBy(F.col("ml_non_compliance_probability").desc_nulls_last(), F.col("risk_score").desc_nulls_last(),
                     F.col("sampling_date").desc()).select("station_id", "sampling_date", "ml_non_compliance_probability",
                                                           "risk_score")


@q
def sv_label_counts(spark, sf):
    return D.predictions(spark, sf).groupBy("ml_predicted_compliance_label").agg(F.count(F.lit(1)).alias("count"))


@q
def sv_live_summary(spark, sf):
    pred = D.live_predictions(spark, sf)
    al = LV.live_alerts(pred, pred.select(F.max("latest_timestamp")).scalar())
    levels = ("Severe", "High", "Normal")
    counts = al.agg(*[F.count_if(F.col("severity") == x).alias(f"{x.lower()}_alerts") for x in levels]).withColumn("_one", F.lit(1))
    stations = pred.agg(F.count(F.lit(1)).alias("live_stations"),
                        F.count_if(F.col("live_ml_predicted_compliance_label") == "Non-Compliant").alias("non_compliant_ml")).withColumn("_one", F.lit(1))
    return stations.join(F.broadcast(counts), "_one").drop("_one")  # a row each


@q
def sv_live_validation(spark, sf):
    r = QL.readings(spark, sf)
    pred = LV.live_predictions(LV.live_state(r))
    al = LV.live_alerts(pred, QL.as_of(r))
    lbl = F.col("live_ml_predicted_compliance_label")
    n = F.col("core_parameter_count")
    return pred.agg(
        F.count(F.lit(1)).alias("stations_detected"), F.count("ph").alias("ph_records_count"),
        F.count("dissolved_oxygen").alias("do_records_count"), F.count("bod").alias("bod_records_count"),
        F.count_if(n == 3).alias("rows_with_full_core_parameters"),
        F.count_if((n > 0) & (n < 3)).alias("rows_with_partial_core_parameters"),
        F.count_if(lbl != "Unknown").alias("model_prediction_success_count"),
        F.count_if(lbl == "Unknown").alias("model_prediction_failed_count"),
        F.count_if(lbl == "Compliant").alias("predicted_compliant_count"),
        F.count_if(lbl == "Non-Compliant").alias("predicted_non_compliant_count")).select(
        "*", r.select(F.countDistinct("parameter")).scalar().alias("parameters_detected"),
        al.select(F.count(F.lit(1))).scalar().alias("alerts_generated"))


@q
def sv_checks(spark, sf):
    """The outputs of the jobs, attributions and local explanations of the stored model included."""
    shap = D.materialized(spark, sf, "shap_importance", lambda: QM.xp_shap(spark, sf))
    lime = D.materialized(spark, sf, "live_lime_explanations", lambda: QM.xp_lime(spark, sf))
    return SV.output_checks(D.predictions(spark, sf), _overview(spark, sf), QM.ml_pred_summary(spark, sf), shap, lime)


@q
def sv_station_detail(spark, sf):
    pred = D.live_predictions(spark, sf)
    al = LV.live_alerts(pred, pred.select(F.max("latest_timestamp")).scalar())
    return rounded(SV.station_detail(pred, LV.live_explanations(pred), al))


@q
def sv_top_station(spark, sf):
    p = D.predictions(spark, sf)
    hot = M.hotspot_summary(p)
    station = M.top_hotspots(hot, 1).select("station_name").scalar()
    alerts = M.operational_alerts(M.membership(p, hot, M.station_trends(p)))
    # top-1 by date: TakeOrderedAndProject (per-partition top-1, then merge), no global sort
    latest = p.where(F.col("station_name") == station).orderBy(F.col("sampling_date").desc()).limit(1)
    n_alerts = alerts.where(F.col("station_name") == station).select(F.count(F.lit(1))).scalar()
    return rounded(latest.select("station_name", "sampling_date", "available_compliance_label", "risk_score",
                                 "risk_category", X.rule_explanation().alias("rule_based_explanation"),
                                 n_alerts.alias("alert_count")))
