"""Registered queries: profiles, coverage, EDA and the pair flag (2.5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as K
from .. import vocabulary as V
from ..functions import rules as R
from ..functions import text as T
from ..operators import profile as P
from ..operators import spatial as SP
from . import datasets as D
from .out import rounded

Q = {}


def q(fn):
    Q[fn.__name__] = fn
    return fn


def _l(spark, sf):
    return D.labelled(spark, sf)


def _safe(df):
    """EDA frame: rule-derived safe flag and a designated-use class."""
    cls = R.use_class("dissolved_oxygen", "bod", F.col("temperature") * 10.0, "ph", "conductivity")
    return df.select("*", R.strict_target().alias("is_safe"), cls.alias("use_class"))


@q
def agg_source_summary(spark, sf):
    return P.source_summary(_l(spark, sf))


@q
def agg_core_coverage(spark, sf):
    return rounded(P.core_coverage(_l(spark, sf)))


@q
def agg_conf_counts(spark, sf):
    return P.confidence_counts(_l(spark, sf))


@q
def agg_label_dist(spark, sf):
    return _l(spark, sf).groupBy("source_file", "available_compliance_label").agg(F.count(F.lit(1)).alias("count"))


@q
def agg_risk_dist(spark, sf):
    return _l(spark, sf).groupBy("source_file", "risk_category").agg(F.count(F.lit(1)).alias("count"))


@q
def agg_class_balance(spark, sf):
    return rounded(P.class_balance(_l(spark, sf), "available_compliance_label"))


@q
def agg_missing(spark, sf):
    return rounded(P.missing_values(_l(spark, sf), P.SAMPLE_COLUMNS))


@q
def agg_param_combo(spark, sf):
    return rounded(P.class_balance(_l(spark, sf), "available_compliance_parameters"))


def _aux_ready():
    return R.present_count(*K.AUX8) >= P.LEAST_AUX


@q
def agg_xcoverage(spark, sf):
    l = D.expanded(spark, sf)
    n = F.count(F.lit(1))
    return rounded(l.groupBy("source_file", "state_name", "basin").agg(
        n.alias("rows"),
        *[P.pct(F.count(p), n).alias(f"{p}_pct") for p in P.EXPANDED],
        P.pct(F.count_if(F.col("core_parameter_count") == 3), n).alias("all_three_core_pct"),
        P.pct(F.count_if(F.col("core_parameter_count") >= 2), n).alias("at_least_two_core_pct"),
        P.pct(F.count_if(_aux_ready()), n).alias("at_least_three_aux_pct")))


@q
def agg_cov_by(spark, sf):
    l = _l(spark, sf)
    a = l.groupBy(F.lit("state").alias("dimension"), F.col("state_name").alias("value")).agg(
        F.count(F.lit(1)).alias("rows"))
    b = l.groupBy(F.lit("basin").alias("dimension"), F.col("basin").alias("value")).agg(
        F.count(F.lit(1)).alias("rows"))
    return a.unionByName(b)


@q
def agg_best_params(spark, sf):
    return P.nonnull_counts(D.expanded(spark, sf), P.EXPANDED).select("parameter", "non_null_count") \
        .orderBy(F.col("non_null_count").desc(), "parameter")


@q
def agg_baseline(spark, sf):
    return rounded(P.baseline(D.expanded(spark, sf), P.EXPANDED, 50))


@q
def agg_aux_ready(spark, sf):
    l = D.expanded(spark, sf)
    target = F.col("label_confidence").isin("High", "Medium")
    aux = _aux_ready()
    r = l.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(target).alias("rows_with_valid_target"),
              F.count_if(aux).alias("rows_with_3_aux"), F.count_if(~target & aux).alias("rows_no_core_but_aux"),
              F.countDistinct("state_name").alias("states_represented"),
              F.countDistinct("river_name").alias("rivers_represented"),
              F.countDistinct("station_name").alias("station_count"))
    return r.withColumn("recommended_use", F.when(F.col("rows_with_valid_target") < 1000, F.lit("baseline only"))
                        .otherwise(F.lit("auxiliary-only model extension")))


@q
def agg_shape(spark, sf):
    return _l(spark, sf).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("source_file").alias("files"),
        F.countDistinct("state_name").alias("states"), F.countDistinct("basin").alias("groups"),
        F.countDistinct("station_name").alias("stations"), F.countDistinct("river_name").alias("rivers"))


@q
def agg_src_contrib(spark, sf):
    nn = P.nonnull_counts(D.expanded(spark, sf), P.EXPANDED, keys=("source_file",))
    w = Window.partitionBy("source_file").orderBy(F.col("non_null_count").desc(), "parameter")
    top5 = (nn.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 5)
            .groupBy("source_file").agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("_r", "parameter"))), lambda s: s["parameter"]), ", ")
                .alias("top_5_available_parameters")))
    per = nn.groupBy("source_file").agg(F.first("_rows").alias("row_count"),
                                        F.sum("non_null_count").alias("non_null_parameter_count"))
    per = per.withColumn("percentage_of_rows",
                         F.col("row_count") * 100.0 / F.sum("row_count").over(Window.partitionBy()))
    return rounded(per.join(top5, "source_file"))


@q
def agg_param_nonnull(spark, sf):
    # the core flag is materialised once: repeating the same IN-list after the unpivot's
    # Expand triggers a whole-stage-codegen compile failure (interpreted fallback)
    l = D.expanded(spark, sf)
    nn = P.nonnull_counts(l, P.EXPANDED + [c for c in K.FIELD_OBSERVATIONS if c in l.columns]).withColumns({
        "is_core_parameter": F.col("parameter").isin(*K.CORE_PARAMS), "_noted": F.col("parameter").isin(*K.FIELD_OBSERVATIONS)})
    core, noted = F.col("is_core_parameter"), F.col("_noted")
    return rounded(nn.select(
        "parameter", "non_null_count", (F.col("non_null_count") * 100.0 / F.col("_rows")).alias("non_null_pct"),
        F.when(noted, F.lit("field-observation/categorical")).when(core, F.lit("core")).otherwise(F.lit("auxiliary")).alias("parameter_group"),
        "is_core_parameter", (~core & ~noted).alias("is_auxiliary_parameter"),
        ((F.col("non_null_count") > 0) & ~noted).alias("include_in_future_ml_flag")))


@q
def agg_numeric_valid(spark, sf):
    from ..functions import cleaning as C
    u = D.canonical_uploads(spark, sf)
    typed = u.unpivot([], [c for c in V.NUMERIC if c in u.columns], "parameter", "raw_value").where("raw_value is not null")
    d = C.add_censored(typed, "raw_value", "v", "flag")
    return d.groupBy("parameter").agg(
        F.count("v").alias("parsed_numeric_count"),
        F.count_if(F.col("flag") == "Parse Error").alias("parse_failure_count"),
        F.count_if(F.col("flag").startswith("Converted <")).alias("less_than_value_count"),
        F.count_if(F.col("flag").startswith("Below detection")).alias("bdl_value_count"),
        F.count_if(F.col("v") < 0).alias("negative_value_count"),
        F.count_if((F.col("parameter") == "ph") & ((F.col("v") < 0) | (F.col("v") > 14))
                   | (F.col("parameter") == "conductivity") & (F.col("v") > 500000)).alias("extreme_value_count"))


@q
def agg_conf_cov(spark, sf):
    l = D.expanded(spark, sf)
    n = F.col("core_parameter_count")
    wide = l.agg(F.count_if(n == 3).alias("rows with all DO+BOD+pH"),
                 F.count_if(n >= 2).alias("rows with >=2 core parameters"),
                 F.count_if(n >= 1).alias("rows with >=1 core parameter"),
                 F.count_if(_aux_ready()).alias("rows with >=3 auxiliary parameters"))
    return wide.unpivot([], wide.columns, "metric", "count")


@q
def agg_long_valid(spark, sf):
    long = D.expanded(spark, sf).unpivot(["source_file", "station_id", "sampling_date"], P.EXPANDED, "parameter", "value")
    return long.agg(F.count(F.lit(1)).alias("long_format_row_count"),
                    F.countDistinct("parameter").alias("unique_parameters"),
                    F.countDistinct("source_file").alias("unique_source_files"),
                    F.count_if(F.col("value").isNull()).alias("missing_value_count"),
                    F.bool_and(F.col("parameter").isin(*V.NUMERIC)).alias("all_params_are_real"))


@q
def agg_file_rank(spark, sf):
    nn = P.nonnull_counts(D.expanded(spark, sf), P.EXPANDED, keys=("source_file",))
    tot = nn.groupBy("source_file").agg(F.sum("non_null_count").alias("total_non_null"))

    def ranked(kind, *order):  # the three rows of a distributed top-k, then their places
        return tot.orderBy(*order).limit(3).select(
            F.lit(kind).alias("rank_kind"), F.row_number().over(Window.orderBy(*order)).alias("rank"), "source_file", "total_non_null")
    strong = ranked("strongest", F.col("total_non_null").desc(), F.col("source_file"))
    weak = ranked("weakest", F.col("total_non_null").asc(), F.col("source_file"))
    return strong.unionByName(weak)


@q
def agg_safe_means(spark, sf):
    s = _safe(_l(spark, sf))
    return rounded(s.groupBy("is_safe").agg(*[P.exact_mean(p).alias(p) for p in P.PARAMS]))


@q
def agg_spatial_rate(spark, sf):
    s = _safe(_l(spark, sf)).withColumn("primary_position", T.primary_position("station_name"))
    return rounded(s.groupBy("primary_position").agg(F.count(F.lit(1)).alias("rows"),
                                                     F.avg("is_safe").alias("safe_rate")))


@q
def jn_pair_flag(spark, sf):
    return SP.pair_flags(_l(spark, sf)).select("station_id", "sampling_date", "station_group",
                                               "primary_position", "has_us_ds_pair")


@q
def agg_pair_rate(spark, sf):
    s = SP.pair_flags(_safe(_l(spark, sf)))
    return rounded(s.where(F.col("has_us_ds_pair") & F.col("primary_position").isin("UPSTREAM", "DOWNSTREAM"))
                   .groupBy("primary_position").agg(F.count(F.lit(1)).alias("rows"),
                                                    F.avg("is_safe").alias("safe_rate")))


@q
def agg_year_rate(spark, sf):
    s = _safe(_l(spark, sf))
    return rounded(s.groupBy("year").agg(F.avg("is_safe").alias("safe_rate"), F.count(F.lit(1)).alias("rows")))


@q
def agg_threshold_check(spark, sf):
    s = _safe(_l(spark, sf))
    use_safe = F.col("use_class").isin("Class_A", "Class_B", "Class_C")
    return s.agg(
        F.count_if(use_safe & (F.col("violation_count") > 0)).alias("safe_but_violating"),
        F.count_if(~use_safe & (F.col("violation_count") == 0) & (F.col("core_parameter_count") == 3))
        .alias("unsafe_but_clean"))


@q
def lbl_use_class(spark, sf):
    s = _safe(_l(spark, sf))
    return s.select("station_id", "sampling_date", "use_class", R.use_class_code("use_class").alias("use_class_code"),
                    F.col("use_class").isin("Class_A", "Class_B", "Class_C").cast("int").alias("is_safe_class"))


@q
def lbl_strict_rule_v2(spark, sf):
    l = _l(spark, sf)
    return l.select("station_id", "sampling_date", R.strict_target().alias("safe_inclusive"),
                    R.strict_target(inclusive=False).alias("safe_strict"))


@q
def lbl_class_weight(spark, sf):
    s = _safe(_l(spark, sf))
    w_all = Window.partitionBy()
    c = s.groupBy("use_class").agg(F.count(F.lit(1)).alias("n"))
    c = c.select("use_class", (F.sum("n").over(w_all) / (F.count(F.lit(1)).over(w_all) * F.col("n"))).alias("class_weight"))
    b = s.groupBy("is_safe").agg(F.count(F.lit(1)).alias("n"))
    b = b.select("is_safe", (F.sum("n").over(w_all) / (2 * F.col("n"))).alias("binary_class_weight"))
    # both lookups are one row per class (bounded): broadcast joins
    return rounded(s.join(F.broadcast(c), "use_class").join(F.broadcast(b), "is_safe")
                   .select("station_id", "sampling_date", "use_class", "class_weight", "binary_class_weight"))


@q
def lbl_rule_match(spark, sf):
    s = _safe(_l(spark, sf))
    s = s.withColumn("rule_is_safe", (F.col("violation_count") == 0).cast("int"))
    return s.groupBy("is_safe", "rule_is_safe").agg(F.count(F.lit(1)).alias("count"))


@q
def lbl_rule_match_rate(spark, sf):
    s = _safe(_l(spark, sf))
    same = F.col("is_safe") == (F.col("violation_count") == 0).cast("int")
    return rounded(s.agg(F.count(F.lit(1)).alias("rows"), F.avg(same.cast("int")).alias("match_rate")))


@q
def agg_spatial_rates(spark, sf):
    """Safe rate by position, station group and pair flag; dimensions of 25 values or more are left out."""
    s = SP.pair_flags(_safe(_l(spark, sf)))
    dims = ["primary_position", "station_group", "has_us_ds_pair"]
    long = s.select("is_safe", F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("x")).select("is_safe", "x.*")
    by = long.where("value is not null").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("rows"), F.avg("is_safe").alias("safe_rate"))
    few = by.groupBy("dimension").agg(F.count(F.lit(1)).alias("n")).where("n < 25").select("dimension")  # a row a dimension
    return rounded(by.join(F.broadcast(few), "dimension"))


@q
def agg_five_number_log(spark, sf):
    return rounded(P.five_number(_l(spark, sf), P.PARAMS, "available_compliance_label", log1p=True))


@q
def agg_describe(spark, sf):
    return rounded(P.describe(_l(spark, sf), P.PARAMS))


@q
def agg_iqr_outliers(spark, sf):
    return rounded(P.iqr_outliers(_l(spark, sf), P.PARAMS))


@q
def agg_five_number(spark, sf):
    return rounded(P.five_number(_l(spark, sf), P.PARAMS, "available_compliance_label"))


@q
def agg_histogram(spark, sf):
    return rounded(P.histogram(_l(spark, sf), "ph", 20))


@q
def agg_pearson(spark, sf):
    s = _safe(_l(spark, sf))
    return rounded(P.pearson(s, P.PARAMS + ["is_safe"]))


@q
def agg_spearman(spark, sf):
    l = _l(spark, sf).withColumn("_key", F.concat_ws("|", "station_id", "sampling_date"))
    return rounded(P.spearman(l, ["dissolved_oxygen", "bod", "ph"], "_key"))


@q
def agg_violation_counts(spark, sf):
    l = _l(spark, sf)
    return l.agg(F.count_if(F.col("dissolved_oxygen") < 5).alias("do_violations"),
                 F.count_if(F.col("bod") > 3).alias("bod_violations"),
                 F.count_if((F.col("ph") < 6.5) | (F.col("ph") > 8.5)).alias("ph_violations"),
                 F.count_if(F.col("violation_count") == 0).alias("no_violation"))
