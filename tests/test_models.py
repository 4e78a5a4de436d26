"""Properties of models, attributions and gates; guard, splits and sources on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from limnos.operators import ml as ML
from limnos.operators import profile as P
from limnos.operators import standardize as S
from limnos.sources import files as FS

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def trained(spark):
    """Target rises with a, falls with b."""
    r = random.Random(4)
    rows = []
    for k in range(400):
        a, b = r.gauss(0, 1), r.gauss(0, 2)
        rows.append((k, f"2024-01-{k % 28 + 1:02d}", a if k % 17 else None, b, int(2 * a - b + r.gauss(0, 0.3) > 0)))
    df = spark.createDataFrame(rows, "station_id long, sampling_date string, a double, b double, target int").withColumn(
        "sampling_date", F.to_date("sampling_date"))
    df = df.withColumn("station_name", F.concat(F.lit("s"), F.col("station_id") % 40)).withColumn("river_name", F.lit("r")).withColumn("source_file", F.lit("f"))
    return df, ML.fit(df, FEATURES, "LogisticRegression")


def test_shapley_values_sum_to_the_score(trained):
    df, model = trained
    some = df.where("a is not null").limit(20)
    base = {"a": 0.1, "b": -0.2}
    attr = ML.shapley_sampled(model, some, base, FEATURES, perms=6)
    total = {(r.station_id, r.sampling_date): r.s for r in attr.groupBy("station_id", "sampling_date").agg(F.sum("shap_value").alias("s")).collect()}
    empty = some.sparkSession.createDataFrame([(0.1, -0.2)], "a double, b double")
    start = ML.score(model, empty).first()["score"]
    for r in ML.score(model, some).collect():
        assert total[r.station_id, r.sampling_date] == pytest.approx(r["score"] - start, abs=1e-9)


def test_stored_models(trained, tmp_path, monkeypatch):
    """What is loaded scores like what was saved, without training; a changed schema fails row by row, with the rule as fallback."""
    from limnos.operators.registry import ModelStore
    df, model = trained
    spark, store = df.sparkSession, ModelStore(df.sparkSession, str(tmp_path / "models"))
    assert store.load("ab", "f1") is None and store.registry().count() == 0
    first = store.trained("ab", "f1", FEATURES, lambda: df)
    monkeypatch.setattr(ML, "fit", lambda *a, **k: pytest.fail("scoring trains"))
    again = store.trained("ab", "f1", FEATURES, lambda: df)
    assert again.features == FEATURES and again.problems(df) == [] and first.estimator == "LogisticRegressionModel"
    want = {r.station_id: r.score for r in ML.score(model, df).collect()}
    got = {r.station_id: r for r in again.score(df).collect()}
    assert all(got[k].score == pytest.approx(v) and got[k].ml_prediction_status == "Success" for k, v in want.items())
    assert {r.name: r.fingerprint for r in store.registry().collect()} == {"ab": "f1"}
    assert again.problems(df.drop("b").withColumn("a", F.col("a").cast("string"))) == ["a: string instead of number", "b: no column"]
    state = spark.createDataFrame([(1, 3, "Non-Compliant", 1.0, 0.0), (2, 2, "Unknown", 1.0, None), (3, 3, "Compliant", None, None)],
                                  "station_id long, core_parameter_count int, live_strict_compliance_label string, a double, b double")
    live = {r.station_id: r for r in ML.score_live(state, again).collect()}
    assert [live[k].live_ml_prediction_status for k in (1, 2, 3)] == ["Success", "Success", "Failed"] and live[2].missing_features == "b"
    assert live[3].live_ml_fallback_used and live[3].live_ml_predicted_compliance_label == "Compliant" and not live[1].live_ml_fallback_used
    broken = {r.station_id: r for r in ML.score_live(state.drop("b"), again).collect()}
    assert {r.live_ml_prediction_status for r in broken.values()} == {"Failed"}
    assert [broken[k].live_ml_predicted_compliance_label for k in (1, 2, 3)] == ["Non-Compliant", "Unknown", "Compliant"]
    assert [broken[k].live_ml_fallback_used for k in (1, 2, 3)] == [True, False, True]


def test_every_row_is_routed_once(spark):
    import __spark_entry__ as E
    from tests.conftest import SMOKE
    q = E.queries()
    modes = {(r.station_id, r.sampling_date): r.prediction_mode for r in q["mode_route"](spark, SMOKE).collect()}
    routed = q["mode_route_model"](spark, SMOKE).collect()
    assert len(routed) == len(modes) and all(modes[r.station_id, r.sampling_date] == r.prediction_mode for r in routed)
    assert all((r.score is None) == (r.prediction_mode == "Insufficient Data") for r in routed)
    assert {r.prediction_mode for r in routed} >= {"Core Rule + ML Model", "Auxiliary-Only ML Model"}


def test_surrogate_has_the_signs_of_the_model(trained):
    df, model = trained
    rows = ML.lime_surrogate(model, df.limit(12), FEATURES, {"a": 0.0, "b": 0.0}, {"a": 1.0, "b": 2.0}, samples=200).collect()
    assert {(r.feature, r.direction) for r in rows} == {("a", "+"), ("b", "-")}


def test_permutation_keeps_values_and_importance_is_positive(trained):
    df, model = trained
    mixed = ML.permute_within_buckets(df, "b", seed=3)
    assert sorted(r.b for r in mixed.collect()) == sorted(r.b for r in df.collect())
    rows = ML.permutation_importance(model, df.where("a is not null"), FEATURES, repeats=3).collect()
    assert all(r.importance_mean > 0.05 for r in rows)


def test_permutation_is_never_broadcast(trained):
    """Neither side is collected by the driver, however small the planner takes it to be."""
    df, _ = trained
    mixed = ML.permute_within_buckets(df, "b", seed=3)
    mixed.collect()
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_evaluation_is_finished_and_keeps_nothing(trained, monkeypatch):
    """The metrics come as rows: reading them again neither reads the input nor scores a row; they are those of the model."""
    df, _ = trained
    monkeypatch.setattr(ML, "guarded", lambda df, variant, features: list(features))
    m = ML.evaluate_all(df, [(("v", FEATURES, s, ["Dummy", "DecisionTree"]), {}) for s in ("Random", "Group")])
    assert [(r.split_type, r.model) for r in m.collect()] == [(s, x) for s in ("Random", "Group") for x in ("Dummy", "DecisionTree")]
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Aggregate", "Join", "InMemory"))
    assert df.sparkSession.sparkContext._jsc.sc().getPersistentRDDs().size() == 0
    split = ML.split_random(df)
    want = ML.metrics(ML.score(ML.fit(split.where("split = 'train'"), FEATURES, "DecisionTree"), split.where("split = 'test'"))).first()
    got = m.where("model = 'DecisionTree' and split_type = 'Random'").first()
    assert all(got[c] == pytest.approx(want[c]) for c in want.asDict())


def test_variants_share_a_split(trained, monkeypatch):
    """A split is made once for all calls that ask for it, holds the features of all and is given up afterwards."""
    df, _ = trained
    got, made, split = [], [], ML.split_random

    def watched(df, variant, features, split, models, rows=None):
        got.append((variant, split, rows.is_cached, set(rows.columns) >= {"target", "split", *features}, rows.count()))
        return df.limit(0)
    monkeypatch.setattr(ML, "evaluate", watched)
    monkeypatch.setattr(ML, "split_random", lambda df: made.append(1) or split(df))
    ML.evaluate_all(df, [((v, feats, s, ["DecisionTree"]), {}) for v, feats in (("one", ["a"]), ("both", FEATURES)) for s in ("Random", "Group")])
    assert sorted(got) == [(v, s, True, True, 400) for v in ("both", "one") for s in ("Group", "Random")] and len(made) == 1
    assert df.sparkSession.sparkContext._jsc.sc().getPersistentRDDs().size() == 0


def test_training_reads_kept_vectors(trained, monkeypatch):
    """A model trains on finished vectors that are kept for it and given up afterwards."""
    df, _ = trained
    kept, plain = [], ML.estimator

    def watched(*args):
        est = plain(*args)
        fit = est.fit
        est.fit = lambda rows: kept.append((rows.is_cached, sorted(rows.columns))) or fit(rows)
        return est
    monkeypatch.setattr(ML, "estimator", watched)
    model = ML.fit(df, FEATURES, "DecisionTree")
    assert kept == [(True, ["raw_features", "target", "w"])] and len(model.stages) == 3
    assert df.sparkSession.sparkContext._jsc.sc().getPersistentRDDs().size() == 0


def test_splits(trained):
    df, _ = trained
    s = ML.split_random(df)
    share = {r.target: r.p for r in s.groupBy("target").agg(F.avg((F.col("split") == "train").cast("int")).alias("p")).collect()}
    assert all(0.75 <= p <= 0.8 for p in share.values())
    g = ML.split_group(df)
    assert g.groupBy("station_name").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert ML.group_column(df) == "station_name"
    assert ML.group_column(df.withColumn("station_name", F.lit("x"))) == "source_file"


def test_overlap_of_the_sides_is_never_broadcast(spark):
    """Equal to an intersect with nulls and repeats; no side is collected by the driver, however small it is."""
    rows = [("train", 1.0, None), ("train", 1.0, None), ("test", 1.0, None), ("train", 0.0, 2.0), ("test", -0.0, 2.0), ("test", 3.0, 3.0),
            ("test", 3.0, 3.0), ("train", None, 4.0), ("train", None, None), ("test", None, None)]
    d = spark.createDataFrame(rows, "split string, a double, b double")
    both = ML.on_both_sides(d, FEATURES)
    want = d.where("split = 'train'").select(*FEATURES).intersect(d.where("split = 'test'").select(*FEATURES))
    assert sorted(map(str, both.collect())) == sorted(map(str, want.collect())) and both.count() == 3
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()


def test_registered_overlap_is_never_broadcast(spark):
    """What the driver collects for the registered query are the hashes that train, not rows of a side."""
    import __spark_entry__ as E
    from tests.conftest import SMOKE
    df = E.queries()["jn_train_test_overlap"](spark, SMOKE)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in plan


def test_guard_is_obeyed(trained):
    df, _ = trained
    d = df.withColumn("risk_score", F.col("target") * 1.0).withColumn("ph", F.col("a"))
    assert ML.guarded(d, "Core Regulatory Model", ["ph", "risk_score", "a", "nothing"]) == ["ph", "a"]
    assert ML.guarded(d, "True Auxiliary-Only Model", ["ph", "a"]) == ["a"]
    m = ML.evaluate(d, "True Auxiliary-Only Model", ["risk_score", "station_id"], "Random", ["DecisionTree"]).first()
    assert m["balanced_accuracy"] < 0.75


@pytest.mark.parametrize("values,reasons", [((0, 0, 0.5, 0.5, 0.9, 0.9), ""), ((1, 2, 0.7, 0.5, 0.5, 0.99), (
    "leakage columns in training features; train/test contamination; shuffled labels predicted above 0.6; "
    "group balanced accuracy < 0.55; auxiliary balanced accuracy > 0.98")), ((0, 0, 0.6, 0.6, 0.55, 0.98), "")])
def test_report_gates(spark, values, reasons):
    r = spark.range(1).select(*ML.report_gates(*[F.lit(v) for v in values])).first()
    assert (r.verdict, r.fail_reasons) == ("FAIL" if reasons else "PASS", reasons)


@pytest.mark.parametrize("few,accuracy", [(100_000, 10_000), (0, 200), (300, 1000)])
def test_exact_percentiles(spark, few, accuracy):
    """Small groups whole, large ones through brackets; ties, one value, two values, heavy repeats."""
    import numpy as np
    r = random.Random(1)
    sizes = {"a": 1, "b": 2, "c": 333, "d": 20_000, "e": 5000}
    rows = [(g, round(r.gauss(0, 5), 1 if g == "e" else 6)) for g, n in sizes.items() for _ in range(n) if not (few == 0 and n < 3000)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    points = {"q1": 0.25, "median": 0.5, "q3": 0.75, "top": 1.0, "low": 0.0}
    got = P.exact_percentiles(df, "g", "v", points, few=few, accuracy=accuracy).collect()
    assert {x.g for x in got} == {g for g, v in rows if v is not None}
    for row in got:
        v = [x for g, x in rows if g == row.g and x is not None]
        assert row._n == len(v) and [row[p] for p in points] == pytest.approx([np.quantile(v, q) for q in points.values()])


def test_percentiles_order_few_values(spark):
    """No window over all values of a large group: brackets leave a small part of them."""
    n = 200_000
    df = spark.range(n).select(F.lit("x").alias("g"), (F.xxhash64("id") / 1e10).alias("v"))
    found = P.percentile_candidates(df, "g", "v", {"median": 0.5}, few=1000)
    assert found.count() < n / 500 and found.agg(F.sum("_c")).first()[0] == n


def test_column_rules():
    names = ["DO (mg/L)", "Class", "Lead, total mg/l", "Temperature (C)", "pH Value", "odd", "E. coli", "Lead"]
    got = {c: (r.canonical, r.method, r.confidence) if r else None for c, r in S.resolve_columns(names).items()}
    assert got["DO (mg/L)"] == ("dissolved_oxygen", "Alias Match", "High") and got["Class"][0] is None and got["odd"] is None
    assert got["Lead, total mg/l"] == ("lead", "Suffix Match", "Medium") and got["Temperature (C)"] == ("temperature", "Prefix Match", "Medium")
    assert got["E. coli"][0] == "e_coli" and got["Lead"] == ("lead", "Alias Match", "High")
    assert S.snake_names(["A b", "a-b", "c", "A_B "]) == ["a_b", "a_b_1", "c", "a_b_2"]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_bytes("x,y\n1,é\n2,b,c\n".encode())
    (tmp_path / "a" / "two.csv").write_bytes("x,y\n3,é\n".encode("latin1"))
    (tmp_path / "a" / "cpcb_as_chemical.csv").write_bytes("x,y\n3,é\n".encode("latin1"))
    got = sorted((r.x, r.y, r._corrupt_record) for r in FS.read_csv_dir(spark, str(tmp_path / "a")).collect())
    assert got == [("1", "é", None), ("2", "b", "2,b,c"), ("3", "é", None), ("3", "é", None)]
    assert FS.read_csv_dir(spark, str(tmp_path / "none"), fallback=str(tmp_path / "a")).count() == 4
    m = {r.file_name: r for r in FS.manifest(spark, str(tmp_path / "a")).collect()}
    assert [m[n].row_count for n in ("one.csv", "two.csv")] == [2, 1] and m["one.csv"].column_count == 2
    assert m["two.csv"].detected_encoding == "latin1" and m["two.csv"].duplicate_file_flag and not m["cpcb_as_chemical.csv"].duplicate_file_flag
    assert m["cpcb_as_chemical.csv"].inferred_state_from_filename == "Assam" and m["cpcb_as_chemical.csv"].likely_parameter_group == "chemical"
    s = FS.manifest_summary(FS.manifest(spark, str(tmp_path / "a"))).first()
    assert (s.total_discovered, s.failed_files, s.excluded_hash, s.new_files) == (3, 0, 1, 2)


def test_csv_files_with_headers_of_their_own(spark, tmp_path):
    """Swapped, missing, additional, quoted and repeated columns; an empty file and one with a header alone."""
    (tmp_path / "in").mkdir()
    for name, text in {"a.csv": "station,ph,do\nA,7.1,6.0\n", "b.csv": "station,do,ph\nB,5.5,8.2\n", "c.csv": 'do,"note, long",station\n1.5,"x, y",C\n',
                       "d.csv": "station,ph,ph\nD,1,2\n", "e.csv": "", "f.csv": "only,header\n", "g.csv": "station,ph,do\nG,1,2,3\n", "h.csv": "\ufeffSTATION,ph\nH,9\n"}.items():
        (tmp_path / "in" / name).write_text(text, encoding="utf-8")
    (tmp_path / "in" / "i.csv").write_bytes("station,é\nI,ü\n".encode("latin1"))
    d = FS.read_csv_dir(spark, str(tmp_path / "in"))
    got = {r.station: (r.ph, r["do"], r["note, long"], r["ph.1"], r["é"], r._corrupt_record, r.file_path[-5:]) for r in d.collect()}
    assert got == {"A": ("7.1", "6.0", None, None, None, None, "a.csv"), "B": ("8.2", "5.5", None, None, None, None, "b.csv"),
                   "C": (None, "1.5", "x, y", None, None, None, "c.csv"), "D": ("1", None, None, "2", None, None, "d.csv"),
                   "G": ("1", "2", None, None, None, "G,1,2,3", "g.csv"), "H": ("9", None, None, None, None, None, "h.csv"),
                   "I": (None, None, None, None, "ü", None, "i.csv")}
    assert FS.csv_headers(spark, str(tmp_path / "in")).count() == 7  # one scan a header, not a file
    (tmp_path / "none").mkdir()
    assert FS.read_csv_dir(spark, str(tmp_path / "none")).count() == 0


def test_content_hash_of_a_split_file(spark, tmp_path):
    """Equal files agree however they are cut, files with permuted lines differ, unreadable ones are Failed."""
    (tmp_path / "in").mkdir()
    lines = [f"{k},{k * k}" for k in range(5000)]
    for name, rows in {"a.csv": lines, "b.csv": lines, "c.csv": lines[:7] + lines[8:9] + lines[7:8] + lines[9:]}.items():
        (tmp_path / "in" / name).write_text("\n".join(["x,y", *rows]) + "\n")
    (tmp_path / "in" / "bad.csv.gz").write_bytes(b"\x1f\x8b\x08 no archive")
    (tmp_path / "in" / "empty.csv").write_text("")
    seen = []
    for size in ("128m", "4k", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            seen.append({r.file_name: r for r in FS.manifest(spark, str(tmp_path / "in"), "*.csv*").collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for m in seen:
        assert m["a.csv"].content_hash == m["b.csv"].content_hash == seen[0]["a.csv"].content_hash != m["c.csv"].content_hash == seen[0]["c.csv"].content_hash
        assert [m[n].row_count for n in ("a.csv", "c.csv")] == [5000, 5000] and m["b.csv"].duplicate_file_flag and not m["c.csv"].duplicate_file_flag
        assert {n: m[n].load_status for n in m} == {"a.csv": "Success", "b.csv": "Success", "c.csv": "Success", "bad.csv.gz": "Failed", "empty.csv": "Failed"}


def test_answers_follow_a_grown_input(spark, tmp_path):
    import __spark_entry__ as E
    from limnos.sources.bindings import TABLES
    from tests.conftest import SMOKE
    for t in TABLES:
        df = spark.read.parquet(f"{SMOKE}/{t}.parquet")
        (df.where("event_id % 2 = 0") if t == "events" else df).write.parquet(f"{tmp_path}/{t}.parquet")
    count = lambda: E.queries()["win_latest"](spark, str(tmp_path)).count(), lambda: E.queries()["ml_target"](spark, str(tmp_path)).count()
    before = [c() for c in count]
    spark.read.parquet(f"{SMOKE}/events.parquet").where("event_id % 2 = 1").write.mode("append").parquet(f"{tmp_path}/events.parquet")
    whole = [E.queries()[q](spark, SMOKE).count() for q in ("win_latest", "ml_target")]
    after = [c() for c in count]
    assert after == whole and before != whole


def _tuning_rows(spark, rows=600, groups=30):
    return spark.createDataFrame(
        [(f"s{i % groups}", f"r{i % 7}", "f", float((i * 37) % 100), float((i * 53) % 90) if i % 11 else None, int((i * 37) % 100 > 60)) for i in range(rows)],
        "station_name string, river_name string, source_file string, temperature double, conductivity double, target int")


def test_folds_and_stops_go_by_group(spark):
    d = ML.fold_group(_tuning_rows(spark), 3)
    per = d.groupBy("station_name").agg({"fold": "min", "stops": "min"}).count()
    assert per == d.select("station_name", "fold", "stops").distinct().count() == 30
    assert {r.fold for r in d.select("fold").distinct().collect()} == {0, 1, 2}


def test_tuning_learns_and_stops_early(spark, monkeypatch):
    from pyspark.ml.tuning import ParamGridBuilder

    def small(name, est):
        g = ParamGridBuilder().addGrid(est.stepSize, [0.1, 0.5]) if name == "GBT" else ParamGridBuilder().addGrid(est.regParam, [0.01, 100.0])
        return (g.addGrid(est.maxIter, [12]) if name == "GBT" else g).build()
    monkeypatch.setattr(ML, "grid", small)
    rows = {(r.model, r.parameters): r for r in ML.tune(_tuning_rows(spark), ["temperature", "conductivity"], ["LogisticRegression", "GBT"]).collect()}
    assert len(rows) == 4 and all(r.folds == 3 for r in rows.values())
    assert rows["LogisticRegression", "regParam=0.01"].mean_cv_f1 > 0.9
    boosted = [r for (m, _), r in rows.items() if m == "GBT"]
    assert all(r.mean_cv_f1 > 0.95 and 1 <= r.mean_trees <= 12 for r in boosted)
    assert all(r.mean_trees is None for (m, _), r in rows.items() if m != "GBT")


def test_tuning_without_two_classes_uses_no_fold(spark, monkeypatch):
    monkeypatch.setattr(ML, "grid", lambda name, est: [{est.regParam: 1.0}])
    one = _tuning_rows(spark).withColumn("target", F.lit(0))
    for df in (one, one.limit(0)):
        assert [(r.folds, r.mean_cv_f1) for r in ML.tune(df, ["temperature"], ["LogisticRegression"]).collect()] == [(0, None)]


def test_deep_forests_keep_the_nodes_of_rows(spark, monkeypatch):
    """They start first, keep each row's node between levels, and are the trees that a fit without it grows."""
    from pyspark.ml.tuning import ParamGridBuilder

    monkeypatch.setattr(ML, "grid", lambda name, est: ParamGridBuilder().addGrid(est.numTrees, [3]).addGrid(est.maxDepth, [2, ML.FREE_DEPTH]).build())
    seen, fit = [], ML.RandomForestClassifier.fit

    def kept(est, rows, point):
        model = fit(est, rows, point)
        seen.append((point[est.maxDepth], model.getCacheNodeIds()))
        if point[est.maxDepth] == ML.FREE_DEPTH:
            plain = fit(est, rows, {**point, est.cacheNodeIds: False})
            assert plain.toDebugString.split("\n")[1:] == model.toDebugString.split("\n")[1:] and model.totalNumNodes > 20
        return model
    monkeypatch.setattr(ML.RandomForestClassifier, "fit", kept)
    noisy = _tuning_rows(spark).withColumn("target", F.pmod(F.hash("temperature", "conductivity"), F.lit(2)))
    found = ML.tune(noisy, ["temperature", "conductivity"], ["RandomForest"], parallelism=1).collect()
    assert seen == [(ML.FREE_DEPTH, True), (2, False)] * 3
    assert [(r.parameters, r.folds, r.mean_trees) for r in found] == [("maxDepth=2, numTrees=3", 3, 3.0), ("maxDepth=30, numTrees=3", 3, 3.0)]


def _cell_rows(spark, rows=2400):
    """Few numbers many times over, both classes equally often, so that all weights are one; noisy enough for deep trees."""
    r = random.Random(3)
    numbers = [[float((i * 5) % 7), None if i % 13 == 0 else float((i * 11) % 9) / 4, r.choice("abc")] for i in range(rows)]
    return spark.createDataFrame(
        [(f"s{i % 30}", f"r{i % 7}", "f", *x, int((3 * x[0] + (i * 31) % 17 > 18) ^ (i % 5 == 0))) for i, x in enumerate(numbers)],
        "station_name string, river_name string, source_file string, temperature double, conductivity double, season string, target int")


def test_forests_over_cells_are_those_over_rows(spark):
    """The trees of a fit over the rows, with what each tree drew of them, at any depth and least size of a node."""
    from pyspark.ml import Pipeline

    from limnos.operators import cells as C
    df = _cell_rows(spark).withColumn("w", F.lit(1.0)).repartition(3)
    rows = Pipeline(stages=ML.preprocess(["temperature", "conductivity", "season"], df.columns, scale=False)[0]).fit(df).transform(df).select("target", "raw_features", "w").persist()
    est = ML.RandomForestClassifier(featuresCol="raw_features", labelCol="target", weightCol="w", seed=42, numTrees=4)
    bagged = C.BaggedCells(rows, est)
    assert bagged.fewer and bagged.count < 0.5 * rows.count()
    assert sum(sum(r.subsampleCounts) for r in bagged.frame.collect()) > 3 * rows.count()
    over = C.CellForest.like(est).over(bagged)
    for depth, least in ((3, 1), (ML.FREE_DEPTH, 1), (ML.FREE_DEPTH, 10)):
        point = {est.maxDepth: depth, est.minInstancesPerNode: least}
        plain, cells = est.fit(rows, point), over.fit(rows, {getattr(over, p.name): v for p, v in point.items()})
        assert cells.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:] and cells.totalNumNodes > 20
        assert cells.getNumTrees == 4 and cells.getMaxDepth() == depth
        assert cells.transform(rows).select("prediction", "probability").collect() == plain.transform(rows).select("prediction", "probability").collect()
    bagged.unpersist()
    rows.unpersist()


def test_boosted_trees_over_cells_score_like_those_over_rows(spark, monkeypatch):
    """They train on counted cells, and score rows as the plain fit does, those on a bound included."""
    from limnos.operators import cells as C
    df, features = _cell_rows(spark), ["temperature", "conductivity", "season"]
    plain = ML.estimator
    monkeypatch.setattr(ML, "estimator", lambda name, *a: plain(name, *a).setMaxIter(5))
    model = ML.fit(df, features, "GBT")
    assert model.stages[-1].getFeaturesCol() == "cells" and model.stages[-1].getWeightCol() == "n"
    monkeypatch.setattr(C, "FEWER", 0.0)
    want = ML.fit(df, features, "GBT")
    assert want.stages[-1].getFeaturesCol() == "raw_features" and len(want.stages) < len(model.stages)
    new = df.unionByName(df.withColumns({"temperature": F.col("temperature") - 0.5, "conductivity": F.col("conductivity") * 40}))
    got = [ML.score(m, new).select("score", "prediction").collect() for m in (model, want)]
    assert [r.prediction for r in got[0]] == [r.prediction for r in got[1]]
    assert [r.score for r in got[0]] == pytest.approx([r.score for r in got[1]], abs=1e-9)


def test_tuning_over_cells_finds_what_it_finds_over_rows(spark, monkeypatch):
    """Trees are grown on cells and measured on cells; the rows of the result are the same, and nothing is kept."""
    from pyspark.ml.tuning import ParamGridBuilder

    from limnos.operators import cells as C

    def small(name, est):
        g = ParamGridBuilder()
        return (g.addGrid(est.maxIter, [4]).addGrid(est.maxDepth, [2]) if name == "GBT" else g.addGrid(est.numTrees, [2, 3]).addGrid(est.maxDepth, [3])).build()
    monkeypatch.setattr(ML, "grid", small)
    df, features, trained = _cell_rows(spark), ["temperature", "conductivity", "season"], []
    fit = ML.GBTClassifier.fit
    monkeypatch.setattr(ML.GBTClassifier, "fit", lambda est, rows, point: trained.append(rows.columns) or fit(est, rows, point))
    tuned = []
    kept = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    for fewer in (0.5, 0.0):
        monkeypatch.setattr(C, "FEWER", fewer)
        tuned.append(sorted(ML.tune(df, features, ["RandomForest", "GBT"]).collect()))
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() <= kept
    assert ["cells" in c for c in trained] == [True] * 3 + [False] * 3
    assert [r[:3] for r in tuned[0]] == [r[:3] for r in tuned[1]] and [r.mean_trees for r in tuned[0]] == [r.mean_trees for r in tuned[1]]
    assert [r.mean_cv_f1 for r in tuned[0]] == pytest.approx([r.mean_cv_f1 for r in tuned[1]], abs=0.01)
