"""Modelling, evaluation and audits on Spark ML.

Training uses ``pyspark.ml`` estimators (distributed); every metric is one
aggregate over a scored DataFrame; splits and permutations use arithmetic
hashes so they are reproducible in any engine and never need a global sort.
The AUC is the rank-sum statistic with tied scores averaged, where ranks are
computed over DISTINCT scores (value -> count, running sum), not over rows.
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cells as C

# FIXED VALUES: feature variants and the leakage keywords of the guard
CORE = ["dissolved_oxygen", "bod", "ph"]
AUX_ALL = ["temperature", "conductivity", "nitrate", "fecal_coliform", "total_coliform", "fecal_streptococci",
           "turbidity", "cod", "total_dissolved_solids", "season", "station_position_tag", "pollution_context_tag",
           "river_name"]
VARIANTS = {"Core Regulatory Model": CORE, "Extended Clean Model": CORE + AUX_ALL,
            "True Auxiliary-Only Model": AUX_ALL}
LEAKAGE_KEYWORDS = ["compliance", "label", "target", "prediction", "predicted", "probability", "risk_score",
                    "risk_category", "violation", "reason", "class", "use_based_class", "dissolved_oxygen",
                    "dissolved_o2", "oxygen", "do_", "_do", "bod", "b_o_d", "biochemical", "ph", "p_h", "hydrogen"]
CATEGORICAL = {"season", "station_position_tag", "pollution_context_tag", "river_name"}
# FIXED VALUES: names left out of the full feature list, and the patterns of the audit over the three lists
LIST_KEYWORDS = ["strict_compliance_label", "available_compliance_label", "compliance_label", "is_compliant", "is_safe",
                 "violation_reasons", "violation_count", "risk_score", "risk_category", "label_confidence", "risk_confidence",
                 "available_compliance_parameters", "missing_required_parameters", "class_weight", "binary_class_weight",
                 "compliance_label_encoded", "source_file", "_minmax", "_zscore", "_encoded"]
CORE_PATTERNS = ["do", "dissolved", "oxygen", "bod", "biochemical", "ph", "p_h"]
AUXILIARY_PATTERNS = ["minmax", "zscore", "scaled", "normalized", "encoded", "label", "risk", "score", "violation", "confidence",
                      "available", "missing", "class_weight", "target", "safe", "prediction", "predicted", "category"]
GENERAL_PATTERNS = ["compliance", "safe", "label", "target", "violation", "risk", "score", "category", "confidence", "class",
                    "weight", "encoded", "minmax", "zscore", "scaled", "normalized", "prediction", "predicted", "available", "missing"]
VALID_TARGET_LABELS = ["Compliant_Based_On_Available_Parameters", "Compliant", "Non-Compliant"]


# ---------------------------------------------------------------------------
# Target, leakage guard, readiness
# ---------------------------------------------------------------------------

def with_target(df: DataFrame, confident_only: bool = False) -> DataFrame:
    """ml_target: valid labels only (optionally High/Medium confidence); target 1 = Non-Compliant."""
    d = df.where(F.col("available_compliance_label").isin(*VALID_TARGET_LABELS))
    if confident_only:
        d = d.where(F.col("label_confidence").isin("High", "Medium"))
    return d.withColumn("target", (F.col("available_compliance_label") == "Non-Compliant").cast("int"))


# canonical parameters that two variants may use although their names are keywords
EXEMPT = [(v, f) for v in ("Core Regulatory Model", "Extended Clean Model") for f in CORE]


def leakage_verdicts(names: DataFrame, present, keywords=LEAKAGE_KEYWORDS, exempt=EXEMPT) -> DataFrame:
    """(variant, feature) with action and reason.

    The keyword table is ranked; a feature's verdict is its lowest-ranked keyword.  Exempt pairs are rows,
    joined to the candidates; features without a column are rejected."""
    spark = names.sparkSession
    allowed = spark.createDataFrame(exempt, "variant string, feature string").withColumn("_exempt", F.lit(True))
    table = F.array(*[F.lit(k) for k in keywords])
    hit = F.get(F.filter(table, lambda k: F.contains(F.lower("feature"), k)), 0)
    d = names.join(F.broadcast(allowed), ["variant", "feature"], "left").withColumn("_hit", hit)  # rows of a schema
    there, ok = F.col("feature").isin(*present), F.coalesce("_exempt", F.lit(False))
    return d.select(
        "variant", "feature",
        F.when(~there, "Rejected").when(ok | F.col("_hit").isNull(), "Accepted").otherwise("Rejected (Leakage)").alias("action"),
        F.when(~there, "Not in dataframe").when(ok, "Allowed canonical parameter").when(F.col("_hit").isNull(), "Clean")
        .otherwise(F.concat(F.lit("Contains leakage keyword: '"), "_hit", F.lit("'"))).alias("reason"))


def candidates(spark, extra=(), variants=None) -> DataFrame:
    rows = [(v, f) for v, feats in (variants or VARIANTS).items() for f in list(feats) + list(extra)]
    return spark.createDataFrame(rows, "variant string, feature string")


def guarded(df: DataFrame, variant: str, features) -> list[str]:
    """The features that the guard accepts for a variant: what is trained on."""
    names = candidates(df.sparkSession, variants={variant: features})
    ok = {r.feature for r in leakage_verdicts(names, df.columns).where("action = 'Accepted'").collect()}  # a schema's rows
    return [f for f in features if f in ok]


def variant_table(df: DataFrame, extra=()) -> DataFrame:
    """Yes / No per feature and variant: which variants train on it."""
    v = leakage_verdicts(candidates(df.sparkSession, extra), df.columns)
    return (v.groupBy("feature").pivot("variant", list(VARIANTS)).agg(F.max(F.when(F.col("action") == "Accepted", "Yes").otherwise("No")))
            .fillna("No"))


def single_feature_auc(df: DataFrame, features, label: str = "target") -> DataFrame:
    """(feature, single_feature_auc): the AUC of each feature as the only score, over all rows.

    The rank sums of all features come from one rank table, grouped by feature, with ties averaged; rows without a value
    are one tie group below all values."""
    from .profile import rank_long
    if not features:
        return df.sparkSession.createDataFrame([], "feature string, single_feature_auc double")
    long = df.select(label, F.explode(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))).alias("v")) for f in features])).alias("x")).select(label, "x.*")
    per = rank_long(long, "feature", "v", sums=(label,)).groupBy("feature").agg(
        F.sum(F.col("_rank") * F.col(f"_s_{label}")).alias("r"), F.sum(f"_s_{label}").alias("p"), F.sum("_c").alias("n"))
    p = F.col("p").cast("double")
    return per.select("feature", F.try_divide(F.col("r") - p * (p + 1) / 2.0, p * (F.col("n") - p)).alias("single_feature_auc"))


def data_check(df: DataFrame, features, label: str = "target") -> DataFrame:
    """(feature, non_null_rate, target_correlation, single_feature_auc) of numeric features: a row a feature."""
    n, aggs = F.count(F.lit(1)), []
    for f in features:
        x = F.col(f).cast("double")
        xx, yy = F.when(x.isNotNull(), x), F.when(x.isNotNull(), F.col(label).cast("double"))
        aggs += [(F.count(f) / n).alias(f"nn::{f}"),
                 F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy)).alias(f"r::{f}")]
    if not aggs:
        return df.sparkSession.createDataFrame([], "feature string, non_null_rate double, target_correlation double, single_feature_auc double")
    data = df.agg(*aggs).select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"`nn::{f}`").alias("non_null_rate"),
                 F.col(f"`r::{f}`").alias("target_correlation")) for f in features])).alias("x")).select("x.*")
    return data.join(F.broadcast(single_feature_auc(df, features, label)), "feature", "left")  # a row a feature


def leak_audit(df: DataFrame, extra_candidates=()) -> DataFrame:
    """ml_leak_guard: name verdict per (variant, feature) joined with the data check of the numeric ones."""
    names = leakage_verdicts(candidates(df.sparkSession, extra_candidates), df.columns)
    offered = {f for feats in VARIANTS.values() for f in feats} | set(extra_candidates)
    numeric = sorted(f for f in offered if f not in CATEGORICAL and f in df.columns)
    # both sides are bounded by the candidate list -> broadcast
    return names.join(F.broadcast(data_check(df, numeric)), "feature", "left")


def feature_lists(columns) -> dict[str, list[str]]:
    """The three feature lists that a table with these columns offers: all but known leaks, the same without the core
    parameters, and what is named like an auxiliary parameter and like nothing else."""
    def named(c, patterns):
        return any(p in c.lower() for p in patterns)
    full = [c for c in columns if not named(c, LIST_KEYWORDS)]
    return {"Full Model": full, "Ablation Model": [c for c in full if c not in CORE],
            "True Auxiliary Model": [c for c in columns if not named(c, CORE_PATTERNS + AUXILIARY_PATTERNS) and named(c, AUX_ALL)]}


def feature_audit(df: DataFrame, label: str = "target") -> DataFrame:
    """Features of the three lists that are named like a leak (General Leakage), or like a core parameter in a list that
    must have none (Hidden Core Leakage), each with the data check where it is numeric."""
    rows = []
    for experiment, features in feature_lists(df.columns).items():
        for f in features:
            general = any(p in f.lower() for p in GENERAL_PATTERNS)
            if general or experiment != "Full Model" and any(p in f.lower() for p in CORE_PATTERNS):
                rows.append((experiment, f, "General Leakage" if general else "Hidden Core Leakage"))
    names = df.sparkSession.createDataFrame(rows, "experiment string, feature string, leakage_warning string")
    kinds = dict(df.dtypes)
    numeric = sorted({f for _, f, _ in rows if kinds[f] in ("tinyint", "smallint", "int", "bigint", "float", "double")})
    return names.join(F.broadcast(data_check(df, numeric, label)), "feature", "left")  # rows of a schema


def readiness(df: DataFrame, expected) -> DataFrame:
    """ml_readiness: per expected feature present / non-null count / coverage % / sample value (min)."""
    present = [f for f in expected if f in df.columns]
    n = F.count(F.lit(1))
    from ..functions.rules import fmt_short
    types = dict(df.dtypes)

    def sample(f):
        # numbers rendered through integer arithmetic (engine-neutral text), text as is
        if types[f] in ("double", "float", "int", "bigint"):
            return fmt_short(F.min(F.col(f)), 9)
        return F.min(F.col(f))
    wide = df.agg(n.alias("_n"), *[F.count(f).alias(f"n::{f}") for f in present],
                  *[sample(f).alias(f"s::{f}") for f in present])
    items = []
    for f in expected:
        if f in present:
            items.append(F.struct(F.lit(f).alias("expected_feature"), F.lit(True).alias("present_in_raw"),
                                  F.col(f"`n::{f}`").alias("non_null_count"),
                                  (F.col(f"`n::{f}`") * 100.0 / F.col("_n")).alias("coverage_pct"),
                                  F.col(f"`s::{f}`").alias("sample_value_raw")))
        else:
            items.append(F.struct(F.lit(f).alias("expected_feature"), F.lit(False).alias("present_in_raw"),
                                  F.lit(0).cast("long").alias("non_null_count"), F.lit(0.0).alias("coverage_pct"),
                                  F.lit(None).cast("string").alias("sample_value_raw")))
    return wide.select(F.explode(F.array(*items)).alias("x")).select("x.*")


# ---------------------------------------------------------------------------
# Splits (arithmetic hashes shared by every engine)
# ---------------------------------------------------------------------------

HASHES = 1000


def row_hash() -> Column:
    day = F.datediff("sampling_date", F.lit("1970-01-01").cast("date"))
    return (F.col("station_id") * 7919 + day * 104729 + 42) % HASHES


def split_random(df: DataFrame, test_pct: int = 20) -> DataFrame:
    """ml_split_random: stratified; of each class the rows with the smallest hashes train, as many hash values
    as hold at most the train share of the class (at most HASHES rows a class are joined back)."""
    d = df.withColumn("_h", row_hash())
    w = Window.partitionBy("target").orderBy("_h")
    count = d.groupBy("target", "_h").agg(F.count(F.lit(1)).alias("_n"))
    train = count.select("target", "_h", F.sum("_n").over(w).alias("_cum"), F.sum("_n").over(Window.partitionBy("target")).alias("_all")) \
        .where(F.col("_cum") * 100 <= F.col("_all") * (100 - test_pct)).select("target", "_h", F.lit("train").alias("_s"))
    return d.join(F.broadcast(train), ["target", "_h"], "left").select(*df.columns, F.coalesce("_s", F.lit("test")).alias("split"))


def group_column(df: DataFrame, most: int = 5) -> str:
    """What splits by group: the station, else the river, else the source, the first with more than `most` values."""
    n = df.agg(F.countDistinct("station_name").alias("s"), F.countDistinct("river_name").alias("r")).first()
    return "station_name" if n.s > most else "river_name" if n.r > most else "source_file"


def group_hash(column: str, piece: int = 0) -> Column:
    """A number below 2^32 of each row's group; pieces 0 to 3 are independent of each other."""
    g = F.coalesce(F.col(column), F.lit("Unknown"))
    return F.conv(F.substring(F.md5(g), 8 * piece + 1, 8), 16, 10).cast("long")


def split_group(df: DataFrame, test_pct: int = 20) -> DataFrame:
    """ml_split_group: the group decides, so no group is on both sides."""
    return df.withColumn("split", F.when(group_hash(group_column(df)) % 100 < test_pct, F.lit("test")).otherwise(F.lit("train")))


def on_both_sides(split_df: DataFrame, features) -> DataFrame:
    """jn_train_test_overlap: the distinct feature rows of the train side that the test side has as well (nulls are equal).

    One aggregate over both sides: an INTERSECT plans a join, whose test rows the driver would collect for a broadcast."""
    sides = split_df.groupBy(*features).agg(*[F.bool_or(F.col("split") == s).alias(f"_{s}") for s in ("train", "test")])
    return sides.where("_train and _test").select(*features)


def fold_group(df: DataFrame, folds: int, stop_share: int = 5) -> DataFrame:
    """fold: the group's fold; stops: whether the group watches the growth of boosted trees (one group in `stop_share`)."""
    g = group_column(df)
    return df.withColumns({"fold": (group_hash(g, 1) % folds).cast("int"), "stops": group_hash(g, 2) % stop_share == 0})


# ---------------------------------------------------------------------------
# Metrics
# ---------------------------------------------------------------------------

def auc(scored: DataFrame, label: str = "target", score: str = "score") -> Column:
    """Rank-sum AUC (ties averaged) as a scalar-subquery Column over DISTINCT scores."""
    from .profile import rank_table
    s = scored.where(F.col(score).isNotNull())
    ranks = rank_table(s, score, sums=(label,))
    rank_pos = ranks.select(F.sum(F.col("_rank") * F.col(f"_s_{label}"))).scalar()
    npos = s.select(F.sum(label)).scalar()
    nneg = s.select(F.count(F.lit(1)) - F.sum(label)).scalar()
    return F.try_divide(rank_pos - npos * (npos + 1) / 2.0, npos * nneg)


def metrics(scored: DataFrame, label: str = "target", pred: str = "prediction", score: str = "score") -> DataFrame:
    """ml_metrics: accuracy, balanced accuracy, precision, recall, F1 (zero_division 0), ROC AUC."""
    y, p = F.col(label), F.col(pred)
    c = scored.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                   F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    spec = F.coalesce(F.try_divide(tn, tn + fp), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return c.select("tp", "fp", "tn", "fn",
                    F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                    ((rec + spec) / 2).alias("balanced_accuracy"), prec.alias("precision"), rec.alias("recall"),
                    f1.alias("f1"), auc(scored, label, score).alias("roc_auc"))


# ---------------------------------------------------------------------------
# Pipelines and training
# ---------------------------------------------------------------------------

def preprocess(features, df_columns, scale: bool) -> tuple[list, str]:
    """ml_preprocess: median impute (+ scale for linear); index + one-hot categoricals (unknown kept)."""
    num = [f for f in features if f in df_columns and f not in CATEGORICAL]
    cat = [f for f in features if f in df_columns and f in CATEGORICAL]
    stages = []
    num_out = [f"{f}__imp" for f in num]
    if num:
        stages.append(Imputer(inputCols=num, outputCols=num_out, strategy="median"))
    cat_out = []
    if cat:
        stages.append(StringIndexer(inputCols=cat, outputCols=[f"{c}__idx" for c in cat], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in cat], outputCols=[f"{c}__ohe" for c in cat],
                                    handleInvalid="keep"))
        cat_out = [f"{c}__ohe" for c in cat]
    stages.append(VectorAssembler(inputCols=num_out + cat_out, outputCol="raw_features", handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
        return stages, "features"
    return stages, "raw_features"


def balanced_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """class_weight='balanced': total / (2 * class count), from a 2-row aggregate (broadcast)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = df.select(F.count(F.lit(1))).scalar()
    w = counts.select(label, (total / (2.0 * F.col("_n"))).alias("w"))
    return df.join(F.broadcast(w), label)


FREE_DEPTH = 30  # the deepest that Spark's trees grow


def estimator(name: str, features_col: str, restricted: bool = False, max_depth: int = 7):
    tree = dict(featuresCol=features_col, labelCol="target", weightCol="w", seed=42,
                maxDepth=5 if restricted else max_depth, minInstancesPerNode=10 if restricted else 1)
    if name == "LogisticRegression":
        return LogisticRegression(featuresCol=features_col, labelCol="target", weightCol="w", maxIter=2000)
    if name == "DecisionTree":
        return DecisionTreeClassifier(**tree)
    if name == "RandomForest":
        return RandomForestClassifier(numTrees=100, **tree)
    if name == "GBT":
        return GBTClassifier(featuresCol=features_col, labelCol="target", maxIter=100, maxDepth=5, seed=42)
    raise ValueError(name)


def fit(train: DataFrame, features, model: str, restricted: bool = False, max_depth: int = 7) -> PipelineModel:
    """The finished vectors are kept while the model trains: a tree reads them three times before it has bins of its own.

    Boosted trees are grown over the counted cells of the rows (`cells`), where these are fewer than half the rows."""
    stages, fcol = preprocess(features, train.columns, scale=(model == "LogisticRegression"))
    prepared = Pipeline(stages=stages).fit(train.where("target is not null"))
    if model == "GBT":
        found = _boosted_on_cells(prepared.stages, train.where("target is not null"), estimator(model, fcol))
        if found is not None:
            return found
    rows = prepared.transform(balanced_weights(train)).select("target", "w", fcol).persist()
    try:
        return PipelineModel([*prepared.stages, estimator(model, fcol, restricted, max_depth).fit(rows)])
    finally:
        rows.unpersist()


def _boosted_on_cells(stages, train: DataFrame, est) -> PipelineModel | None:
    """Boosted trees over counted cells, with the preparation up to them; None where cells save too little."""
    cells = C.Cells(stages)
    kept = cells.kept(train).persist()
    try:
        rows = cells.bin(kept, est).counted(kept).persist()
        try:
            n = rows.count()
            return PipelineModel([*cells.stages(), est.fit(rows, C.on_cells(est, n))]) if n < C.FEWER * kept.count() else None
        finally:
            rows.unpersist()
    finally:
        kept.unpersist()


def grid(name: str, est):
    """The parameter grid of a model. FIXED VALUES."""
    g = ParamGridBuilder()
    if name == "LogisticRegression":  # inverse strengths 0.1, 1, 10
        g = g.addGrid(est.regParam, [10.0, 1.0, 0.1])
    if name == "RandomForest":
        g = g.addGrid(est.numTrees, [50, 100]).addGrid(est.maxDepth, [5, 10, FREE_DEPTH]).addGrid(est.minInstancesPerNode, [1, 5, 10])
    if name == "GBT":
        g = g.addGrid(est.maxDepth, [3, 5, 7]).addGrid(est.stepSize, [0.01, 0.1])
    return g.build()


def _forest_work(point: dict) -> int:
    """Tree levels that a grid point grows: deep forests take most of a tuning's time."""
    v = {p.name: x for p, x in point.items()}
    return v.get("numTrees", 1) * v.get("maxDepth", 0)


def _f1(scored: DataFrame) -> float:
    """F1 of the positive class; 0 without a true positive.  A row counts as the n rows of its cell, where it has an n."""
    y, p, n = F.col("target"), F.col("prediction"), F.col("n") if "n" in scored.columns else F.lit(1)
    c = scored.agg(F.sum(F.when((y == 1) & (p == 1), n)).alias("hit"), F.sum(F.when((y == 1) | (p == 1), n)).alias("either")).first()
    return 2.0 * c.hit / (c.hit + c.either) if c.hit else 0.0


def tune(train: DataFrame, features, names, folds: int = 3, parallelism: int = 4) -> DataFrame:
    """ml_tune: mean F1 of the positive class over folds, for every point of the grids of the models `names`.

    Folds are by group, so no group is on both sides of one.  A fold's imputation, indexing and scaling are
    fitted on its own training rows, once for all points, which then read the finished vectors.  Boosted trees stop at the
    first tree that brings the groups set aside for it (`fold_group`) no gain; where a fold has no such row they grow to the
    end.  Folds that lack rows or one of the two classes to train on are left out; `folds` counts those used.
    Forests without a bound on depth keep the node that each row has reached in each tree, instead of walking it down all
    levels again for the next one; the trees are the same.  A fold's longest fits start first, so that none runs on alone.
    Trees are grown and measured over the cells of a fold's rows (`cells`), where these are fewer than half the rows."""
    df = fold_group(train.where("target is not null"), folds)
    size = {r.fold: r for r in df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("hits"), F.count_if("stops").alias("stops"),
                                                      F.sum(F.col("stops").cast("int") * F.col("target")).alias("stop_hits")).collect()}
    jobs = []
    for name in names:
        est = estimator(name, "features" if name == "LogisticRegression" else "raw_features")
        est = C.CellForest.like(est) if name == "RandomForest" else est
        jobs += [(name, est, point) for point in grid(name, est)]
    found = {k: [] for k in range(len(jobs))}
    order = sorted(found, key=lambda k: -_forest_work(jobs[k][2]))
    for fold in sorted(size):
        rest = [r for f, r in size.items() if f != fold]
        n, hits, stops = (int(sum(r[c] for r in rest)) for c in ("n", "hits", "stops"))
        kept, kept_hits = n - stops, hits - int(sum(r.stop_hits for r in rest))
        if not 0 < hits < n:
            continue
        early = stops > 0 and 0 < kept_hits < kept
        inside = balanced_weights(df.where(F.col("fold") != fold))
        stages, _ = preprocess(features, df.columns, scale=True)
        prepared = Pipeline(stages=stages).fit(inside)
        outside = df.where(F.col("fold") == fold)
        fit_rows, held = (prepared.transform(d).select("target", "stops", "raw_features", "features", *extra).persist()
                          for d, extra in ((inside, ["w"]), (outside, [])))
        bagged, on_cells = {}, []

        def run(job):
            name, est, point = job
            rows, known = fit_rows, held
            if name == "GBT" and early:
                point = {**point, est.validationIndicatorCol: "stops", est.validationTol: 0.0}
            if name == "GBT" and on_cells:
                rows, known = on_cells
                point = {**point, **C.on_cells(est, rows.count())}
            if name == "RandomForest" and point.get(est.maxDepth) == FREE_DEPTH:
                point = {**point, est.cacheNodeIds: True}
            if name == "RandomForest" and bagged:
                est, known = est.over(bagged[point.get(est.numTrees, est.getNumTrees())]), bagged["held"]
            model = est.fit(rows, point)
            return _f1(model.transform(known)), float(model.getNumTrees) if name in ("RandomForest", "GBT") else None
        try:
            _tree_cells(prepared.stages, jobs, inside, outside, fit_rows, early, bagged, on_cells)
            with ThreadPool(parallelism) as pool:
                for k, result in zip(order, pool.imap(run, [jobs[k] for k in order]), strict=True):
                    found[k].append(result)
        finally:
            for x in (fit_rows, held, *bagged.values(), *on_cells):
                x.unpersist()
    rows = []
    for k, (name, _, point) in enumerate(jobs):
        f1, trees = [f for f, _ in found[k]], [t for _, t in found[k] if t is not None]
        rows.append((name, ", ".join(sorted(f"{p.name}={v}" for p, v in point.items())), len(f1), sum(f1) / len(f1) if f1 else None,
                     sum(trees) / len(trees) if trees else None))
    return train.sparkSession.createDataFrame(rows, "model string, parameters string, folds int, mean_cv_f1 double, mean_trees double")


def _tree_cells(stages, jobs, inside: DataFrame, outside: DataFrame, fit_rows: DataFrame, early: bool, bagged: dict, on_cells: list) -> None:
    """Fill in what the trees of a fold are grown and measured on, where cells are fewer than half of its rows: `bagged` with the bagged
    cells by number of trees and the cells held out, `on_cells` with the counted cells of both sides for boosted trees."""
    most = C.FEWER * fit_rows.count()
    for n in sorted({point.get(est.numTrees, est.getNumTrees()) for name, est, point in jobs if name == "RandomForest"}):
        forest = next(est for name, est, _ in jobs if name == "RandomForest")
        bagged[n] = C.BaggedCells(fit_rows, forest.copy({forest.numTrees: n}))
        if not bagged[n].fewer:
            bagged.clear()
            break
    cells = C.Cells(stages)
    if bagged:
        bagged["held"] = cells.bin_like(bagged[n].training).examples(cells.kept(outside)).persist()
    boosted = next((est for name, est, _ in jobs if name == "GBT"), None)
    if boosted is not None:
        kept = cells.kept(inside, "stops").persist()
        try:
            rows = cells.bin(kept.where("not stops") if early else kept, boosted).counted(kept, "stops").persist()
            if rows.count() < most:
                on_cells += [rows, cells.counted(cells.kept(outside)).persist()]
            else:
                rows.unpersist()
        finally:
            kept.unpersist()


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """ml_score: prediction + P(non-compliant) + label + status."""
    out = model.transform(df)
    return (out.withColumn("score", vector_to_array("probability")[1])
            .withColumn("ml_predicted_compliance_label",
                        F.when(F.col("prediction") == 1, F.lit("Non-Compliant")).otherwise(F.lit("Compliant")))
            .withColumn("ml_prediction_status", F.lit("Success")))


def split_rows(df: DataFrame, split: str, features) -> DataFrame:
    return (split_random(df) if split == "Random" else split_group(df)).select("target", "split", *features)


def evaluate(df: DataFrame, variant: str, features, split: str, models, restricted: bool = False, guard: str | None = None,
             max_depth: int = 7, rows: DataFrame | None = None) -> DataFrame:
    """Train each model on the split's train side, with the features that the leakage guard accepts, and evaluate on its test side.

    guard: the variant whose rules hold; default `variant`.  rows: the split rows of `df`, where the caller keeps them.
    What training and scoring read many times, the split rows with the accepted features and the scored test rows, is
    kept while it is in use."""
    feats = guarded(df, guard or variant, features)
    split_df = split_rows(df, split, feats).persist() if rows is None else rows.select("target", "split", *feats)
    train, test = split_df.where("split = 'train'"), split_df.where("split = 'test'")
    out = []
    try:
        for m in models:
            if m == "Dummy":
                majority = (train.groupBy("target").count().orderBy(F.col("count").desc(), "target").limit(1)
                            .select("target").scalar())
                scored = test.withColumn("prediction", majority.cast("double")).withColumn(
                    "score", train.select(F.avg("target")).scalar())
            else:
                scored = score(fit(train, feats, m, restricted, max_depth), test)
            scored = scored.select("target", "prediction", "score").persist()
            try:
                found = metrics(scored).select(F.lit(variant).alias("variant"), F.lit(split).alias("split_type"),
                                               F.lit(m).alias("model"), "*")
                out.append(df.sparkSession.createDataFrame(found.collect(), found.schema))  # a row a model
            finally:
                scored.unpersist()
    finally:
        if rows is None:
            split_df.unpersist()
    return reduce(DataFrame.unionByName, out) if out else df.sparkSession.createDataFrame([], "variant string")


TOGETHER = 3  # models in training at a time: one alone leaves cores idle between its many short jobs


def evaluate_all(df: DataFrame, calls, together: int = TOGETHER) -> DataFrame:
    """The rows of several `evaluate(df, ...)`, each call given by its (positional, named) arguments.

    Each split is made once, with the features of all calls that ask for it, and kept until they are done."""
    wanted = {}
    for (_, features, split, *_), _ in calls:
        wanted.setdefault(split, {}).update(dict.fromkeys(f for f in features if f in df.columns))
    kept = {split: split_rows(df, split, features).persist() for split, features in wanted.items()}
    try:
        with ThreadPool(together) as pool:
            return reduce(DataFrame.unionByName, pool.map(lambda c: evaluate(df, *c[0], **c[1], rows=kept[c[0][2]]), calls))
    finally:
        for rows in kept.values():
            rows.unpersist()


def report_gates(leaks: Column, contaminated: Column, shuffled_accuracy: Column, shuffled_auc: Column, group_accuracy: Column, aux_accuracy: Column) -> list[Column]:
    """ml_report: (verdict, reasons) of the five audits."""
    reasons = F.array_compact(F.array(
        F.when(leaks > 0, F.lit("leakage columns in training features")),
        F.when(contaminated > 0, F.lit("train/test contamination")),
        F.when((shuffled_accuracy > 0.6) | (shuffled_auc > 0.6), F.lit("shuffled labels predicted above 0.6")),
        F.when(group_accuracy < 0.55, F.lit("group balanced accuracy < 0.55")),
        F.when(aux_accuracy > 0.98, F.lit("auxiliary balanced accuracy > 0.98"))))
    return [F.when(F.size(reasons) == 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("verdict"), F.array_join(reasons, "; ").alias("fail_reasons")]


# ---------------------------------------------------------------------------
# Permutation-based audits and explanations
# ---------------------------------------------------------------------------

BUCKET_ROWS = 50_000


def permute_within_buckets(df: DataFrame, col: str, seed: int, keys=()) -> DataFrame:
    """Shuffle one column: inside each hash bucket (of each combination of `keys`), row k receives the value of
    the row ranked k by a second hash.  Buckets hold about BUCKET_ROWS rows whatever the input.

    The ranks meet in a merge join: both sides have all rows, while the planner's estimate of them, made from the
    size of a compressed file before any explode, is small enough for a broadcast."""
    buckets = max(1, df.count() // BUCKET_ROWS)
    row = [*keys, "station_id", "sampling_date"]
    b = F.pmod(F.xxhash64(F.lit(seed), *row), F.lit(buckets))
    d = df.withColumn("_b", b).withColumn("_h1", F.xxhash64(F.lit(seed + 1), *row)).withColumn("_h2", F.xxhash64(F.lit(seed + 2), *row))
    w1 = Window.partitionBy(*keys, "_b").orderBy("_h1", "station_id", "sampling_date")
    w2 = Window.partitionBy(*keys, "_b").orderBy("_h2", "station_id", "sampling_date")
    left = d.withColumn("_k", F.row_number().over(w1)).drop(col)
    right = d.select(*keys, "_b", F.row_number().over(w2).alias("_k"), F.col(col))
    return left.hint("merge").join(right, [*keys, "_b", "_k"]).drop("_b", "_k", "_h1", "_h2")


def permutation_importance(model: PipelineModel, test: DataFrame, features, repeats: int = 10) -> DataFrame:
    """xp_perm_imp: F1 drop per feature over repeats: rows explode into (feature, repeat) copies, whose feature
    values are shuffled in one pass and scored in one transform."""
    base = metrics(score(model, test)).select("f1").scalar()
    copies = test.select("station_id", "sampling_date", "target", *features, F.explode(F.array(*[
        F.struct(F.lit(f).alias("f"), F.lit(i).alias("r"), F.col(f).cast("double").alias("v"))
        for f in features for i in range(repeats)])).alias("_x")).select("*", "_x.*").drop("_x")
    mixed = permute_within_buckets(copies, "v", seed=17, keys=("f", "r"))
    mixed = mixed.select("f", "r", "target", "station_id", "sampling_date",
                         *[F.when(F.col("f") == x, F.col("v")).otherwise(F.col(x)).alias(x) for x in features])
    s = score(model, mixed)
    y, p = F.col("target"), F.col("prediction")
    per = s.groupBy(F.col("f").alias("_feature"), F.col("r").alias("_rep")).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    drops = per.select("_feature", (base - f1).alias("drop"))
    r = drops.groupBy(F.col("_feature").alias("feature")).agg(F.avg("drop").alias("importance_mean"),
                                                              F.stddev_pop("drop").alias("importance_std"))
    return r.withColumn("rank", F.rank().over(Window.orderBy(F.col("importance_mean").desc(), "feature")))  # a row a feature


def shapley_sampled(model: PipelineModel, rows: DataFrame, background: dict, features, perms: int = 8) -> DataFrame:
    """xp_shap: sampled Shapley values.  For each row and permutation the coalition grows one feature
    at a time (others from a background point); every coalition instance is scored in ONE transform and the
    attribution of a feature is the mean score difference it causes."""
    n = len(features)
    base_rows = rows.select("station_id", "sampling_date", *features)
    perm_ids = F.explode(F.sequence(F.lit(0), F.lit(perms - 1))).alias("_perm")
    steps = F.explode(F.sequence(F.lit(0), F.lit(n))).alias("_step")
    x = base_rows.select("*", perm_ids).select("*", steps)
    # position of each feature inside permutation `_perm`: order features by a hash of (perm, feature)
    pos = {f: F.xxhash64(F.col("_perm"), F.lit(f)) for f in features}
    rank = {f: sum((pos[g] < pos[f]).cast("int") for g in features) for f in features}
    cols = [F.when(rank[f] < F.col("_step"), F.col(f)).otherwise(F.lit(background[f])).alias(f) for f in features]
    inst = x.select("station_id", "sampling_date", "_perm", "_step", *cols,
                    *[rank[f].alias(f"_rank_{f}") for f in features])
    s = score(model, inst).select("station_id", "sampling_date", "_perm", "_step", "score",
                                  *[f"_rank_{f}" for f in features])
    w = Window.partitionBy("station_id", "sampling_date", "_perm").orderBy("_step")
    d = s.withColumn("_delta", F.col("score") - F.lag("score").over(w)).where(F.col("_step") > 0)
    # the feature added at step k is the one whose rank is k-1
    added = reduce(lambda acc, f: F.when(F.col(f"_rank_{f}") == F.col("_step") - 1, F.lit(f)).otherwise(acc),
                   features, F.lit(None).cast("string"))
    return (d.withColumn("feature", added).groupBy("station_id", "sampling_date", "feature")
            .agg(F.avg("_delta").alias("shap_value")))


def shap_summary(attr: DataFrame) -> DataFrame:
    """Global attribution table: mean |value|, mean value, rank, interpretation."""
    s = attr.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"),
                                    F.avg("shap_value").alias("mean_shap"))
    interp = (F.when(F.col("mean_abs_shap") < 1e-4, F.lit("Negligible influence"))
              .when(F.col("mean_shap") > 0, F.lit("Pushes toward non-compliance on average"))
              .otherwise(F.lit("Pushes toward compliance on average")))
    return s.select("*", F.rank().over(Window.orderBy(F.col("mean_abs_shap").desc())).alias("rank"),
                    interp.alias("interpretation"))


def shap_rows(attr: DataFrame, k: int = 2) -> DataFrame:
    """xp_shap_rows: top-k positive and negative drivers per row (array_sort + filter + slice)."""
    per = attr.groupBy("station_id", "sampling_date").agg(
        F.collect_list(F.struct(F.col("shap_value").alias("v"), F.col("feature").alias("f"))).alias("a"))
    pos = F.slice(F.sort_array(F.filter("a", lambda s: s["v"] > 0), asc=False), 1, k)
    neg = F.slice(F.sort_array(F.filter("a", lambda s: s["v"] < 0), asc=True), 1, k)
    return per.select("station_id", "sampling_date",
                      F.array_join(F.transform(pos, lambda s: s["f"]), ", ").alias("top_positive_drivers"),
                      F.array_join(F.transform(neg, lambda s: s["f"]), ", ").alias("top_negative_drivers"))


def lime_surrogate(model: PipelineModel, rows: DataFrame, features, center: dict, spread: dict, key: str = "station_id",
                   samples: int = 500, top: int = 5) -> DataFrame:
    """xp_lime: local surrogate per row: explode x samples perturbations (a missing value is the training median;
    deterministic hash noise of the training deviation is added), score them in one transform, then a small
    weighted least squares per key in applyInPandas (<= len(features) + 1 unknowns, so each solve is tiny)."""
    import numpy as np
    import pandas as pd

    base = rows.select(key, *features)
    x = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("_s"))
    pert = []
    for i, f in enumerate(features):
        # the sum of three uniform hashes, of deviation one
        u = sum(F.pmod(F.xxhash64(F.col(key), F.col("_s"), F.lit(3 * i + k)), F.lit(10007)) / 10007.0 - 0.5 for k in range(3)) * 2.0
        v = F.coalesce(F.col(f), F.lit(float(center[f])))
        pert.append(F.when(F.col("_s") == 0, v).otherwise(v + u * float(spread[f])).alias(f))
    width = np.asarray([float(spread[f]) or 1.0 for f in features])
    inst = x.select(key, "_s", *pert)
    s = score(model, inst).select(key, "_s", "score", *features)

    feats = list(features)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        X = pdf[feats].to_numpy(dtype=float)
        y = pdf["score"].to_numpy(dtype=float)
        x0 = X[pdf["_s"].to_numpy() == 0][0] if (pdf["_s"] == 0).any() else X.mean(axis=0)
        z = (X - x0) / width
        w = np.exp(-(z ** 2).sum(axis=1) / (0.75 ** 2 * len(feats)))
        A = np.hstack([np.ones((len(X), 1)), z])
        sw = np.sqrt(w)[:, None]
        coef, *_ = np.linalg.lstsq(A * sw, y * sw[:, 0], rcond=None)
        order = np.argsort(-np.abs(coef[1:]))[:top]
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(order),
                             "feature": [feats[j] for j in order],
                             "weight": [float(coef[1 + j]) for j in order],
                             "direction": ["+" if coef[1 + j] > 0 else "-" for j in order],
                             "lime_rank": list(range(1, len(order) + 1)),
                             "lime_status": ["Success"] * len(order)})

    key_type = dict(rows.dtypes)[key]
    return s.groupBy(key).applyInPandas(
        solve, schema=f"{key} {key_type}, feature string, weight double, direction string, lime_rank int, lime_status string")


def score_live(state: DataFrame, model=None, features=()) -> DataFrame:
    """ml_score_live: model label, status and missing features per station.

    model: a stored model (`registry.StoredModel`).  Where it failed, or without one, stations with all three core
    parameters get the strict rule label, marked as fallback; the others stay Unknown."""
    features = list(features) or (model.features if model is not None else [])
    have = [f for f in features if f in state.columns]
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) if f in have else F.lit(f) for f in features])) if features else F.array().cast("array<string>")
    d = state.select("*", F.size(missing).alias("missing_feature_count"), F.array_join(missing, "|").alias("missing_features"))
    if model is None:
        d = d.withColumns({"prediction": F.lit(None).cast("double"), "score": F.lit(None).cast("double"), "ml_predicted_compliance_label": F.lit("Unknown"), "ml_prediction_status": F.lit("Failed")})
    else:
        d = model.score(d)
    strict, failed = F.col("live_strict_compliance_label"), F.col("ml_prediction_status") == "Failed"
    fallback = failed & (F.col("core_parameter_count") == 3)
    return d.select(
        "station_id", "core_parameter_count", "missing_feature_count", "missing_features",
        F.when(fallback, strict).otherwise(F.col("ml_predicted_compliance_label")).alias("live_ml_predicted_compliance_label"),
        F.when(fallback, (strict == "Non-Compliant").cast("double")).otherwise(F.col("prediction")).alias("live_ml_predicted_non_compliant"),
        *([] if model is None else [F.col("score").alias("live_ml_non_compliance_probability")]),
        F.col("ml_prediction_status").alias("live_ml_prediction_status"), fallback.alias("live_ml_fallback_used"),
        F.when(fallback, F.lit("Fallback rule-based estimate used because ML inference failed.")).alias("live_ml_fallback_reason"))


def route(df: DataFrame, mode: Column, models: dict) -> DataFrame:
    """mode_route: each mode's rows go through its stored model (one transform a model), all other rows stay unscored."""
    d = df.withColumn("prediction_mode", mode)
    parts = [m.score(d.where(F.col("prediction_mode") == name)).select(*d.columns, "prediction", "score") for name, m in models.items()]
    rest = d.where(~F.coalesce(F.col("prediction_mode").isin(*models), F.lit(False)))
    return reduce(DataFrame.unionByName, parts + [rest.withColumn("prediction", F.lit(None).cast("double")).withColumn("score", F.lit(None).cast("double"))])
