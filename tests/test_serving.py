"""Serving, feature audit, name matching, column profiles: small tables with results known by hand or by brute force."""

import random
from collections import Counter

import pytest

from limnos.operators import history as H
from limnos.operators import ml as ML
from limnos.operators import serving as SV
from limnos.operators import standardize as S
from limnos.plans import datasets as D
from limnos.plans import queries_extra as QE
from tests.conftest import SMOKE


@pytest.mark.parametrize("threshold", [0.25, 0.4])
def test_similar_names_equal_brute_force(spark, threshold):
    r = random.Random(5)
    name = lambda: " ".join(["river"] * r.randrange(2) + [f"w{min(r.randrange(40), r.randrange(40))}" for _ in range(r.randrange(1, 6))])
    left, right = [name() for _ in range(150)] + [None, "", "the"], [name() for _ in range(80)] + [None]
    a, b = (spark.createDataFrame([(x,) for x in side], "text string") for side in (left, right))
    tokens = {row.text: set(row.toks) for row in a.union(b).where("text is not null").distinct().select("text", H.T.tokens("text").alias("toks")).collect()}
    want, meet = set(), 0
    for x in {t for t in left if t is not None}:
        for y in {t for t in right if t is not None}:
            both = len(tokens[x] & tokens[y])
            meet += both > 0
            if both and both / len(tokens[x] | tokens[y]) > threshold:
                want.add((x, y))
    assert {tuple(p) for p in H.similar_texts(a, b, threshold).collect()} == want and len(want) > 20
    assert len(want) <= H.similar_candidates(a, b, threshold).count() < meet  # fewer pairs than share a token


def test_no_job_while_the_match_is_planned(spark):
    cur = spark.createDataFrame([("S1 Kaveri", "Kaveri", "Goa", 7.0)], "station_name string, river_name string, state_name string, ph double")
    base = spark.createDataFrame([("Goa", "Kaveri", "ph", 7.0, 6.0, 8.0)], "state_name string, river_name string, parameter string, median double, min double, max double")
    spark.sparkContext.setJobGroup("planning", "planning")
    H.hist_fuzzy(cur, base)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == []


def _auc(scores, labels):
    pos, neg = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_single_feature_auc(spark):
    r = random.Random(3)
    rows = [(r.choice([None, 0.0, 1.0, 2.0, -5.5]), None if k % 3 else float(k), 4.0, int(r.random() < 0.4)) for k in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, c double, target int")
    got = {x.feature: x for x in ML.data_check(df, ["a", "b", "c"]).collect()}
    low = lambda v: float("-inf") if v is None else v
    for k, f in enumerate("abc"):
        assert got[f].single_feature_auc == pytest.approx(_auc([low(x[k]) for x in rows], [x[3] for x in rows]))
        assert got[f].non_null_rate == pytest.approx(sum(x[k] is not None for x in rows) / len(rows))
    assert got["c"].single_feature_auc == 0.5 and got["c"].target_correlation is None
    one_class = ML.data_check(df.where("target = 1"), ["a"]).first()
    assert one_class.single_feature_auc is None
    assert ML.data_check(df, []).count() == 0


def test_feature_audit_of_three_lists(spark):
    cols = ["ph", "temperature", "do_sat", "cod_minmax", "risk_score", "target", "season", "turbidity"]
    lists = ML.feature_lists(cols)
    assert lists["Full Model"] == ["ph", "temperature", "do_sat", "target", "season", "turbidity"]
    assert lists["Ablation Model"] == ["temperature", "do_sat", "target", "season", "turbidity"]
    assert lists["True Auxiliary Model"] == ["temperature", "season", "turbidity"]
    df = spark.createDataFrame([(7.0, 1.0, 2.0, 3.0, 4.0, 1, "Summer", 5.0), (8.0, 1.0, 9.0, 3.0, 4.0, 0, None, 5.0)],
                               ", ".join(f"{c} {'string' if c == 'season' else 'int' if c == 'target' else 'double'}" for c in cols))
    got = {(x.experiment, x.feature): (x.leakage_warning, x.single_feature_auc) for x in ML.feature_audit(df).collect()}
    assert got == {("Full Model", "target"): ("General Leakage", 1.0), ("Ablation Model", "target"): ("General Leakage", 1.0),
                   ("Ablation Model", "do_sat"): ("Hidden Core Leakage", 0.0)}


def test_column_profile_sends_few_values(spark):
    r = random.Random(1)
    rows = [(r.choice(["a.csv", "b.csv", None]), r.choice([None, "", *(f"v{k}" for k in range(500))]), "x" if k % 2 else None) for k in range(3000)]
    raw = spark.createDataFrame(rows, "source_file string, `Odd (name)` string, flat string").repartition(6)
    got = {(x.source_file, x.column): x for x in S._column_profile(raw, ["Odd (name)", "flat"], 5).collect()}
    for source in ("a.csv", "b.csv", None):
        for k, c in enumerate(["Odd (name)", "flat"]):
            values = [x[k + 1] for x in rows if x[0] == source]
            some = [v for v in values if v is not None]
            assert (got[source, c]["rows"], got[source, c].non_null_count, got[source, c].example_values) == (len(values), len(some), " | ".join(sorted(set(some))[:5]))
    flat = raw.selectExpr("source_file", "`Odd (name)` as _0", "flat as _1")
    parts = flat.mapInArrow(S._partial_profile(["Odd (name)", "flat"], 5), "source_file string, column string, value string, rows long, non_null_count long")
    per = Counter((x.source_file, x.column) for x in parts.collect())
    assert max(per.values()) <= 6 * (5 + 1)  # tasks x (values and a row of counts)
    assert S._column_profile(raw.limit(0), ["flat"], 5).count() == 0


def test_best_models(spark):
    m = spark.createDataFrame([("A", "Random", "Dummy", 0.5, 0.2), ("A", "Random", "Tree", 0.9, 0.8), ("A", "Group", "Dummy", 0.5, 0.4),
                               ("A", "Group", "Tree", 0.6, 0.4), ("B", "Random", "Dummy", 0.1, None)], "variant string, split_type string, model string, accuracy double, f1 double")
    got = {(x.variant, x.split_type): (x.model, x.accuracy) for x in SV.best_models(m).collect()}
    assert got == {("A", "Random"): ("Tree", 0.9), ("A", "Group"): ("Tree", 0.6), ("B", "Random"): ("Dummy", 0.1)}


def test_checks_can_fail(spark):
    p = D.predictions(spark, SMOKE)
    metrics = QE._overview(spark, SMOKE)
    none = spark.createDataFrame([], "lime_status string")
    failed = spark.createDataFrame([("Failed",)], "lime_status string")

    def status(*args):
        return {(x.category, x.check): (x.status, x.details) for x in SV.output_checks(*args).collect()}
    good = status(p, metrics, none.unionByName(failed), failed, failed)
    assert len(good) == 20 and good["LIME", "live_lime_explanations.csv exists"][0] == "PASS"
    assert good["LIME", "At least one lime_status = success"][0] == "FAIL"
    assert good["Operational", "Column water_body_type exists"][0] == "FAIL" and good["Operational", "Column river_name exists"][0] == "PASS"
    bad = status(p.limit(0).drop("ml_predicted_compliance_label"), metrics.selectExpr("* except (leakage_safe_f1)", "cast(null as double) as leakage_safe_f1"), none, none, none)
    assert len(bad) == 20 and bad["Overview Metrics", "leakage_safe_f1 is not N/A"] == ("FAIL", "Value: N/A")
    assert {k: bad[k][0] for k in bad if k[0] in ("Healthcheck", "SHAP", "LIME")} == dict.fromkeys([k for k in bad if k[0] in ("Healthcheck", "SHAP", "LIME")], "FAIL")
    assert bad["Operational", "File exists"][0] == bad["Operational", "Column ml_predicted_compliance_label exists"][0] == "FAIL"


def test_detail_of_any_station(spark):
    pred = D.live_predictions(spark, SMOKE)
    alerts = QE.LV.live_alerts(pred, pred.select(QE.F.max("latest_timestamp")).scalar())
    name = alerts.groupBy("station_name").count().orderBy(QE.F.desc("count"), "station_name").first()
    one = SV.station_detail(pred, QE.LV.live_explanations(pred), alerts, name.station_name).collect()
    assert len(one) == name["count"] and {x.station_name for x in one} == {name.station_name}
    assert all(x.alert_type and x.reason and x.live_final_explanation for x in one)
    assert SV.station_detail(pred, QE.LV.live_explanations(pred), alerts, "no such station").count() == 0
    quiet = SV.station_detail(pred, QE.LV.live_explanations(pred), alerts.limit(0)).collect()
    assert len(quiet) == pred.count() and all(x.alert_type is None for x in quiet)
