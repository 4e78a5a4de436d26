"""Registered queries: modelling, evaluation, audits, attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as DT
from ..functions import rules as R
from ..functions import text as T
from ..operators import explain as X
from ..operators import live as LV
from ..operators import ml as ML
from ..operators import profile as P
from . import datasets as D
from . import queries_live as QL
from .out import rounded

Q = {}


def q(fn):
    Q[fn.__name__] = fn
    return fn


def model_frame(spark, sf):
    """Training frame: labelled samples + spatial tags + live-style season, target 1 = Non-Compliant (written once)."""
    def build():
        p = D.predictions(spark, sf)
        return ML.with_target(p.withColumn("station_position_tag", T.position_tag("station_name"))
                              .withColumn("pollution_context_tag", T.context_tag("station_name"))
                              .withColumn("season", DT.season_live("sampling_date")))
    return D.materialized(spark, sf, "model_frame", build)


def stand_in_scored(spark, sf):
    return model_frame(spark, sf).withColumn("score", F.col("ml_non_compliance_probability")) \
        .withColumn("prediction", F.col("predicted_non_compliant").cast("double"))


FEATURES = ["dissolved_oxygen", "bod", "ph", "temperature", "conductivity"]


@q
def ml_target(spark, sf):
    return model_frame(spark, sf).select("station_id", "sampling_date", "target")


@q
def ml_split_random(spark, sf):
    d = ML.split_random(model_frame(spark, sf))
    return d.groupBy("split", "target").agg(F.count(F.lit(1)).alias("rows"))


@q
def ml_split_group(spark, sf):
    d = ML.split_group(model_frame(spark, sf))
    return d.groupBy("split", "target").agg(F.count(F.lit(1)).alias("rows"),
                                            F.countDistinct("station_id").alias("stations"))


@q
def ml_dummy(spark, sf):
    d = ML.split_random(model_frame(spark, sf))
    train, test = d.where("split = 'train'"), d.where("split = 'test'")
    majority = train.groupBy("target").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.col("n").desc(), "target").limit(1).select("target").scalar()
    scored = test.withColumn("prediction", majority.cast("double")).withColumn("score", F.lit(0.5))
    return rounded(ML.metrics(scored).select(majority.alias("majority_class"), "*"))


@q
def ml_metrics(spark, sf):
    return rounded(ML.metrics(stand_in_scored(spark, sf)))


@q
def ml_confusion(spark, sf):
    p = D.predictions(spark, sf).where(F.col("available_compliance_label") != "Insufficient_Data")
    rule = F.when(F.col("available_compliance_label") == "Non-Compliant", F.lit("Non-Compliant")) \
        .otherwise(F.lit("Compliant"))
    return p.groupBy(rule.alias("rule_label")).pivot("ml_predicted_compliance_label", ["Compliant", "Non-Compliant"]) \
        .agg(F.count(F.lit(1))).fillna(0)


def _agreement_frame(spark, sf):
    p = D.predictions(spark, sf).where(F.col("available_compliance_label") != "Insufficient_Data")
    rule_nc = (F.col("available_compliance_label") == "Non-Compliant").cast("int")
    return p.withColumn("rule_non_compliant", rule_nc) \
        .withColumn("agree", F.col("rule_non_compliant") == F.col("predicted_non_compliant"))


@q
def ml_agreement(spark, sf):
    a = _agreement_frame(spark, sf)
    return rounded(a.agg(F.count(F.lit(1)).alias("valid_rows"), F.count_if("agree").alias("agreements"),
                         (F.count_if("agree") / F.count(F.lit(1))).alias("agreement_rate"),
                         F.count_if(~F.col("agree")).alias("disagreements")))


@q
def ml_disagree(spark, sf):
    a = _agreement_frame(spark, sf).where(~F.col("agree"))
    text = F.concat(F.lit("Rule says "), F.col("available_compliance_label"), F.lit(" but model predicts "),
                    F.col("ml_predicted_compliance_label"), F.lit(" (violations: "), F.col("violation_reasons"),
                    F.lit(")."))
    return a.select("station_id", "sampling_date", "available_compliance_label", "ml_predicted_compliance_label",
                    text.alias("disagreement_explanation"))


@q
def ml_pred_summary(spark, sf):
    p = D.predictions(spark, sf)
    prob = F.col("ml_non_compliance_probability")
    by = p.groupBy("ml_predicted_compliance_label").agg(
        F.count(F.lit(1)).alias("rows"), F.min(prob).alias("min_probability"),
        F.avg(prob).alias("mean_probability"), F.max(prob).alias("max_probability"))
    tot = p.agg(F.lit("Total").alias("ml_predicted_compliance_label"), F.count(F.lit(1)).alias("rows"),
                F.min(prob).alias("min_probability"), F.avg(prob).alias("mean_probability"),
                F.max(prob).alias("max_probability"))
    return rounded(by.unionByName(tot))


@q
def ml_conf_note_dist(spark, sf):
    return D.predictions(spark, sf).groupBy("ml_prediction_confidence_note").agg(F.count(F.lit(1)).alias("count"))


@q
def ml_readiness(spark, sf):
    return rounded(ML.readiness(model_frame(spark, sf), ML.CORE + ML.AUX_ALL))


@q
def ml_leak_guard(spark, sf):
    return rounded(ML.leak_audit(model_frame(spark, sf), extra_candidates=("risk_score", "violation_count")))


@q
def ml_feature_audit(spark, sf):
    return rounded(ML.feature_audit(model_frame(spark, sf)))


def _dup_counts(df, features):
    feat = df.groupBy(*features).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target").alias("k"))
    ft = df.groupBy(*features, "target").agg(F.count(F.lit(1)).alias("n"))
    full = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return full, feat, ft


@q
def ml_dup_audit(spark, sf):
    d = ML.split_random(model_frame(spark, sf)).select("split", "target", *FEATURES)
    full, feat, ft = _dup_counts(d.drop("split"), FEATURES)
    return d.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows",
        full.select(F.sum(F.col("n") - 1)).scalar().alias("full_row_duplicates"),
        feat.select(F.sum(F.col("n") - 1)).scalar().alias("feature_duplicates"),
        ft.select(F.sum(F.col("n") - 1)).scalar().alias("feature_target_duplicates"),
        feat.where("k > 1").select(F.count(F.lit(1))).scalar().alias("label_collisions"),
        ML.on_both_sides(d, FEATURES).select(F.count(F.lit(1))).scalar().alias("train_test_contamination"))


@q
def jn_train_test_overlap(spark, sf):
    return ML.on_both_sides(ML.split_random(model_frame(spark, sf)), FEATURES)


@q
def ml_variant_table(spark, sf):
    return ML.variant_table(model_frame(spark, sf), extra=("risk_score", "violation_count"))


@q
def ml_score_live(spark, sf):
    """The branch without a model: the rule fallback."""
    state = LV.live_predictions(LV.live_state(QL.readings(spark, sf)))
    return ML.score_live(state, model=None, features=FEATURES)


@q
def ml_score_live_model(spark, sf):
    state = LV.live_state(QL.readings(spark, sf))
    return rounded(ML.score_live(state.select("*", *R.live_label_columns()), stored(spark, sf, "all"), FEATURES))


@q
def mode_route_model(spark, sf):
    """Rows with all core values through the core model, others with an auxiliary value through the auxiliary-only
    model; the rule is that of `mode_route`, and the rest stay unscored."""
    rows = D.labelled(spark, sf)
    models = {"Core Rule + ML Model": stored(spark, sf, "core"), "Auxiliary-Only ML Model": stored(spark, sf, "auxiliary")}
    return rounded(ML.route(rows, X.prediction_mode(), models).select("station_id", "sampling_date", "prediction_mode", "prediction", "score"))


# ---------------------------- training (rows-only checks) -----------------------------

def _variants():
    return {"Core Regulatory Model": ML.CORE,
            "Extended Clean Model": ML.CORE + ["temperature", "conductivity", "station_position_tag",
                                               "pollution_context_tag", "river_name"],
            "True Auxiliary-Only Model": ["temperature", "conductivity", "station_position_tag",
                                          "pollution_context_tag", "river_name"]}


def _evaluate_model(spark, sf, model):
    return rounded(ML.evaluate_all(model_frame(spark, sf), [((v, feats, split, [model]), {}) for v, feats in _variants().items()
                                                            for split in ("Random", "Group")]))


@q
def ml_logreg(spark, sf):
    return _evaluate_model(spark, sf, "LogisticRegression")


@q
def ml_tree(spark, sf):
    return _evaluate_model(spark, sf, "DecisionTree")


@q
def ml_forest(spark, sf):
    return _evaluate_model(spark, sf, "RandomForest")


@q
def ml_gbt(spark, sf):
    return _evaluate_model(spark, sf, "GBT")


@q
def ml_preprocess(spark, sf):
    df = ML.split_random(model_frame(spark, sf))
    feats = _variants()["Extended Clean Model"]
    stages, fcol = ML.preprocess(feats, df.columns, scale=True)
    from pyspark.ml import Pipeline
    model = Pipeline(stages=stages).fit(df.where("split = 'train'"))
    out = model.transform(df.where("split = 'test'"))
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(fcol)
    return out.select("station_id", "sampling_date", F.size(arr).alias("feature_count"),
                      F.round(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared_norm"))


@q
def ml_tune(spark, sf):
    """Tuning of the auxiliary model on the group split's train side: the grids of three models, folds by group."""
    train = ML.split_group(model_frame(spark, sf)).where("split = 'train'")
    feats = ML.guarded(train, "True Auxiliary-Only Model", _variants()["True Auxiliary-Only Model"])
    return rounded(ML.tune(train, feats, ["LogisticRegression", "RandomForest", "GBT"]))


@q
def ml_shuffle_check(spark, sf):
    df = model_frame(spark, sf)
    shuffled = ML.permute_within_buckets(df, "target", seed=7)
    feats = _variants()["Extended Clean Model"]
    m = ML.evaluate(shuffled, "Shuffled labels", feats, "Random", ["RandomForest"], guard="Extended Clean Model")
    return rounded(m.withColumn("pass", (F.col("balanced_accuracy") < 0.6) & (F.col("roc_auc") < 0.6)))


def _confident(spark, sf):
    return ML.with_target(model_frame(spark, sf).drop("target"), confident_only=True)


@q
def ml_group_audit(spark, sf):
    df, guard = _confident(spark, sf), "Extended Clean Model"
    feats = _variants()[guard]
    return rounded(ML.evaluate_all(df, [
        (("DT free", feats, "Group", ["DecisionTree"]), dict(guard=guard, max_depth=ML.FREE_DEPTH)),
        (("DT restricted", feats, "Group", ["DecisionTree"]), dict(restricted=True, guard=guard)),
        (("RF restricted", feats, "Group", ["RandomForest"]), dict(restricted=True, guard=guard))]))


@q
def ml_ablation(spark, sf):
    df, guard = _confident(spark, sf), "True Auxiliary-Only Model"
    return rounded(ML.evaluate_all(df, [(("Auxiliary ablation", _variants()[guard], s, ["DecisionTree"]), dict(restricted=True, guard=guard))
                                        for s in ("Random", "Group")]))


def report_metrics(spark, sf):
    """Metrics of the report's models by variant and split (written once)."""
    df = model_frame(spark, sf)
    return D.materialized(spark, sf, "report_metrics", lambda: ML.evaluate_all(df, [
        ((v, feats, split, ["Dummy", "DecisionTree"]), {}) for v, feats in _variants().items() for split in ("Random", "Group")]))


@q
def ml_report(spark, sf):
    """Best model per variant and split, with the verdict of the five audits over all of them."""
    df = model_frame(spark, sf)
    m = report_metrics(spark, sf)
    best = m.groupBy("variant", "split_type").agg(
        F.max_by("model", F.struct("f1", "model")).alias("best_model"), F.max("f1").alias("best_f1"),
        F.max_by("balanced_accuracy", F.struct("f1", "model")).alias("best_balanced_accuracy"))
    piv = best.groupBy("variant").pivot("split_type", ["Random", "Group"]).agg(
        F.first("best_model").alias("model"), F.first("best_f1").alias("f1"),
        F.first("best_balanced_accuracy").alias("balanced_accuracy"))
    shuffled = D.materialized(spark, sf, "shuffled_metrics", lambda: ml_shuffle_check(spark, sf))
    trained = [(v, f) for v, feats in _variants().items() for f in ML.guarded(df, v, feats)]
    leaks = ML.leakage_verdicts(spark.createDataFrame(trained, "variant string, feature string"), df.columns).where("action <> 'Accepted'")
    tree = m.where("model = 'DecisionTree'")
    gates = ML.report_gates(
        leaks.select(F.count(F.lit(1))).scalar(), jn_train_test_overlap(spark, sf).select(F.count(F.lit(1))).scalar(),
        shuffled.select(F.max("balanced_accuracy")).scalar(), shuffled.select(F.max("roc_auc")).scalar(),
        tree.where("split_type = 'Group'").select(F.avg("balanced_accuracy")).scalar(),
        tree.where("split_type = 'Random' and variant = 'True Auxiliary-Only Model'").select(F.max("balanced_accuracy")).scalar())
    return rounded(piv.select("*", (F.col("Random_f1") - F.col("Group_f1")).alias("random_group_gap"), *gates))


AUXILIARY = ["temperature", "conductivity"]
MODELS = {"all": FEATURES, "core": ML.CORE, "auxiliary": AUXILIARY}


def stored(spark, sf, name):
    """The saved model of these features; it is trained once for a data set and this code."""
    features = MODELS[name]
    return D.models(spark, sf).trained(name, D.fingerprint(spark, sf), features, lambda: ML.split_random(model_frame(spark, sf)).where("split = 'train'"))


def _trained(spark, sf):
    df = ML.split_random(model_frame(spark, sf))
    return stored(spark, sf, "all").pipeline, df.where("split = 'train'"), df.where("split = 'test'")


@q
def ml_score(spark, sf):
    s = stored(spark, sf, "all").score(D.predictions(spark, sf).drop("prediction", "score", "ml_predicted_compliance_label", "ml_prediction_status"))
    return rounded(s.select("station_id", "sampling_date", "prediction", "score", "ml_predicted_compliance_label", "ml_prediction_status"))


@q
def xp_perm_imp(spark, sf):
    model, _, test = _trained(spark, sf)
    return rounded(ML.permutation_importance(model, test, FEATURES))


def _background(train):
    """Training median of each feature: a row a feature."""
    m = P.exact_percentiles(P.values_of(train, FEATURES), "parameter", "v", {"median": 0.5}).select("parameter", "median")
    return {f: 0.0 for f in FEATURES} | {r["parameter"]: float(r["median"]) for r in m.collect()}


def _spread(train):
    row = train.agg(*[F.coalesce(F.stddev_samp(f), F.lit(0.0)).alias(f) for f in FEATURES]).first()
    return row.asDict()


@q
def xp_shap(spark, sf):
    model, train, test = _trained(spark, sf)
    attr = ML.shapley_sampled(model, test, _background(train), FEATURES, perms=8)
    return rounded(ML.shap_summary(attr))


@q
def xp_shap_rows(spark, sf):
    model, train, test = _trained(spark, sf)
    attr = ML.shapley_sampled(model, test, _background(train), FEATURES, perms=8)
    return ML.shap_rows(attr, k=2)


@q
def xp_lime(spark, sf):
    model, train, _ = _trained(spark, sf)
    state = LV.live_state(QL.readings(spark, sf)).select("station_id", *FEATURES)
    return rounded(ML.lime_surrogate(model, state, FEATURES, _background(train), _spread(train), key="station_id"))
