"""Profiles, coverage and EDA aggregates.

Design: every profile is ONE aggregate pass with many expressions (no
per-column groupBy loop), followed by ``unpivot`` when a long table is
wanted.  Group keys are low-cardinality (source, state, basin, label), so
map-side partial aggregation shrinks each task to a handful of rows before
the shuffle.  Exact percentiles are read off exact ranks of the distinct values
(``exact_percentiles``): values are range-bucketed and ranked inside buckets, so
no group's values ever sit in one buffer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K

PARAMS = ["dissolved_oxygen", "bod", "ph", "temperature", "conductivity"]
EXPANDED = K.CORE_PARAMS + K.AUX8
LEAST_AUX = 3   # auxiliary parameters that make a row ready
SAMPLE_COLUMNS = ["source_file", "station_id", "station_name", "river_name", "state_name", "basin",
                  "sampling_date", "month_no", "month", "year"] + PARAMS + ["n_readings"]


def exact_mean(c):
    """Mean of a measured value via an exact DECIMAL(38,9) sum, then one division.

    Measurements carry a few decimals; a double running sum depends on the
    row order and lands on either side of a rounding tie.  The decimal sum is
    exact, so every engine and every partitioning gives the same double.
    """
    return F.try_divide(F.sum(F.col(c).cast("decimal(38,9)")).cast("double"), F.count(c))


def pct(num, den):
    return F.when(den > 0, num * 100.0 / den)


def _n():
    return F.count(F.lit(1))


def source_summary(df: DataFrame) -> DataFrame:
    """agg_source_summary: rows, non-all-null columns, date range, distinct stations / rivers."""
    nonnull = reduce(lambda a, b: a + b,
                     [(F.count(c) > 0).cast("int") for c in SAMPLE_COLUMNS])
    return df.groupBy("source_file").agg(
        _n().alias("row_count"), nonnull.alias("column_count"),
        F.concat(F.min("sampling_date").cast("string"), F.lit(" to "),
                 F.max("sampling_date").cast("string")).alias("date_range"),
        F.countDistinct("station_name").alias("station_count"),
        F.countDistinct("river_name").alias("river_count"))


def core_coverage(df: DataFrame, keys=("source_file",)) -> DataFrame:
    """agg_core_coverage: per key DO/BOD/pH availability %, all three %, >= 2 %."""
    n = _n()
    return df.groupBy(*keys).agg(
        pct(F.count("dissolved_oxygen"), n).alias("dissolved_oxygen_available_pct"),
        pct(F.count("bod"), n).alias("bod_available_pct"),
        pct(F.count("ph"), n).alias("ph_available_pct"),
        pct(F.count_if(F.col("core_parameter_count") == 3), n).alias("all_three_core_available_pct"),
        pct(F.count_if(F.col("core_parameter_count") >= 2), n).alias("at_least_two_core_available_pct"))


def confidence_counts(df: DataFrame) -> DataFrame:
    """agg_conf_counts: per source counts by the four confidence levels."""
    c = F.col("label_confidence")
    return df.groupBy("source_file").agg(
        F.count_if(c == "High").alias("high_confidence_count"),
        F.count_if(c == "Medium").alias("medium_confidence_count"),
        F.count_if(c == "Low").alias("low_confidence_count"),
        F.count_if(c == "Insufficient").alias("insufficient_count"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """agg_class_balance: count and share per label (share from a global window over the counts)."""
    c = df.groupBy(label).agg(_n().alias("count"))
    return c.withColumn("pct", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy()))


def missing_values(df: DataFrame, cols) -> DataFrame:
    """agg_missing: missing count and % per column (one aggregate, then unpivot)."""
    wide = df.agg(_n().alias("_rows"), *[(_n() - F.count(c)).alias(c) for c in cols])
    long = wide.unpivot(["_rows"], list(cols), "column", "missing_count")
    return long.select("column", "missing_count",
                       (F.col("missing_count") * 100.0 / F.col("_rows")).alias("missing_pct"))


def nonnull_counts(df: DataFrame, cols, keys=()) -> DataFrame:
    """Non-null count per column (and key), long format."""
    wide = df.groupBy(*keys).agg(_n().alias("_rows"), *[F.count(c).alias(c) for c in cols])
    return wide.unpivot(list(keys) + ["_rows"], list(cols), "parameter", "non_null_count")


def values_of(df: DataFrame, cols, keys=()) -> DataFrame:
    """(keys, parameter, v) of the non-null values of the columns."""
    return df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("parameter"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")
    ).select(*keys, "x.*").where(F.col("v").isNotNull())


def describe(df: DataFrame, cols) -> DataFrame:
    """agg_describe: mean, median, std, min, max, bias-corrected skewness per column."""
    parts = []
    for c in cols:
        n = F.count(c)
        parts.append(F.struct(
            F.lit(c).alias("parameter"), n.alias("count"), exact_mean(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"), F.max(c).alias("max"),
            F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew")).alias(c))
    long = df.agg(*parts).select(F.explode(F.array(*[F.col(c) for c in cols])).alias("s")).select("s.*")
    medians = exact_percentiles(values_of(df, cols), "parameter", "v", {"median": 0.5}).select("parameter", "median")
    # one row per column on both sides
    return long.join(F.broadcast(medians), "parameter", "left").select("parameter", "count", "mean", "median", "std", "min", "max", "skew")


def iqr_outliers(df: DataFrame, cols) -> DataFrame:
    """agg_iqr_outliers: 1.5 IQR bounds per column, outlier count and %."""
    long = values_of(df, cols)
    bounds = exact_percentiles(long, "parameter", "v", {"q1": 0.25, "q3": 0.75}).select(
        "parameter", "q1", "q3", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower_bound"),
        (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper_bound"))
    # bounds: one row per column -> a proven-size broadcast
    j = long.join(F.broadcast(bounds), "parameter")
    return j.groupBy("parameter", "q1", "q3", "lower_bound", "upper_bound").agg(
        F.count_if((F.col("v") < F.col("lower_bound")) | (F.col("v") > F.col("upper_bound"))).alias("outliers"),
        _n().alias("_n")).select("parameter", "q1", "q3", "lower_bound", "upper_bound", "outliers",
                                 (F.col("outliers") * 100.0 / F.col("_n")).alias("outlier_pct"))


def five_number(df: DataFrame, cols, by: str, log1p: bool = False) -> DataFrame:
    """agg_five_number: min, q1, median, q3, max per column and group; log1p: of log(1 + value), values above -1 only."""
    long = values_of(df, cols, (by,))
    if log1p:
        long = long.where("v > -1").withColumn("v", F.log1p("v"))
    long = long.withColumn("k", F.struct(by, "parameter"))
    ends = long.groupBy("k").agg(F.min("v").alias("min"), F.max("v").alias("max"))
    p = exact_percentiles(long, "k", "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("_n")
    return ends.join(p, "k").select("k.*", "min", "q1", "median", "q3", "max")


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """agg_histogram: equal-width bins between min and max (max falls in the last bin)."""
    lo = df.select(F.min(col)).scalar()      # scalar subqueries, evaluated once
    hi = df.select(F.max(col)).scalar()
    v = F.col(col)
    b = F.least(F.floor(F.try_divide(v - lo, hi - lo) * bins) + 1, F.lit(bins))
    return (df.where(v.isNotNull()).groupBy(b.cast("int").alias("bin")).agg(_n().alias("count"))
            .select("bin", (lo + (F.col("bin") - 1) * (hi - lo) / bins).alias("bin_start"), "count"))


def safe_corr(a: str, b: str):
    """Pearson r over pairwise-complete rows; NULL (not an ANSI error) on zero variance."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(df: DataFrame, cols) -> DataFrame:
    """agg_pearson: every pair's correlation in one aggregate, long format."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[safe_corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}__{b}").alias("corr"))
        for a, b in pairs])).alias("p")).select("p.*")


def _cumulative(df: DataFrame, group: str, col: str, buckets: int, sums=()) -> DataFrame:
    """Distinct values with their count `_c`, the count `_cum` of values up to and with them, and `_n` of all, per group.

    Values are range-bucketed by approximate quantile splits (``percentile_approx``: a bounded sketch per
    group, joined as a small table); a value always lands in one bucket, so ties never straddle buckets and
    the counts stay exact.  They are summed by a window inside (group, bucket), and over at most ``buckets``
    rows per group.
    """
    v = F.col(col)
    counts = df.where(v.isNotNull()).groupBy(group, col).agg(
        _n().alias("_c"), *[F.sum(x).alias(f"_s_{x}") for x in sums])
    qs = [i / buckets for i in range(1, buckets)]
    bounds = counts.groupBy(group).agg(F.percentile_approx(col, qs, 10000).alias("_bounds"))
    # groups are parameters, basins, rivers of a top list: few rows of at most `buckets` numbers each
    c2 = counts.join(F.broadcast(bounds), group).withColumn("_bk", F.lit(0))
    for step in [1 << k for k in range(buckets.bit_length() - 1, -1, -1)]:  # how many bounds are below, by halving
        below = F.get("_bounds", F.col("_bk") + (step - 1)) < v
        c2 = c2.withColumn("_bk", F.col("_bk") + F.when(below, step).otherwise(0))
    c2 = c2.drop("_bounds")
    off = (c2.groupBy(group, "_bk").agg(F.sum("_c").alias("_bt"))
           .select(group, "_bk", F.coalesce(F.sum("_bt").over(
               Window.partitionBy(group).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)),
               F.lit(0)).alias("_off"), F.sum("_bt").over(Window.partitionBy(group)).alias("_n")))
    w = Window.partitionBy(group, "_bk").orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    return c2.join(F.broadcast(off), [group, "_bk"]).withColumn("_cum", F.col("_off") + F.sum("_c").over(w)).drop("_bk", "_off")


def rank_long(df: DataFrame, group: str, col: str, buckets: int = 256, sums=()) -> DataFrame:
    """Exact average (tie-corrected) rank of every DISTINCT value of ``col`` within each ``group``,
    without a global window."""
    return (_cumulative(df, group, col, buckets, sums)
            .withColumn("_rank", F.col("_cum") - (F.col("_c") - 1) / 2.0).drop("_cum", "_n"))


#: Up to so many values of a group are counted one by one; more are first narrowed down.  ACCURACY is that of the sketch.
FEW_VALUES, ACCURACY = 100_000, 10_000


def percentile_candidates(df: DataFrame, group: str, col: str, points: dict, few: int = FEW_VALUES, accuracy: int = ACCURACY) -> DataFrame:
    """(group, _n, _place, _v, _c): counts of the values that can be a wanted percentile, and of each gap between them.

    The first read finds, for each group, its count and a bracket around every wanted place by a bounded sketch (rank
    error 1/accuracy, bracket five times as wide).  The second counts the values inside the brackets one by one and
    those of each gap as one (_v is null), both merged before the shuffle."""
    v, names = F.col(col), list(points)
    margin = 5.0 / accuracy
    ends = [min(max(float(points[p]) + side, 0.0), 1.0) for p in names for side in (-margin, margin)]
    rows = df.where(v.isNotNull()).select(group, col)
    about = rows.groupBy(group).agg(_n().alias("_n"), F.min(col).alias("_min"), F.max(col).alias("_max"), F.percentile_approx(col, ends, accuracy).alias("_ends"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(len(ends) - 1)), lambda k: F.when(k % 2 == 0, F.col("_min")).otherwise(F.col("_max")))
    about = about.select(group, "_n", F.when(F.col("_n") <= few, whole).otherwise(F.col("_ends")).alias("_ends"))
    lows, highs = [F.get("_ends", F.lit(2 * k)) for k in range(len(names))], [F.get("_ends", F.lit(2 * k + 1)) for k in range(len(names))]
    # bounds below a value number the brackets and gaps in their order
    place = reduce(lambda a, b: a + b, [(x <= v).cast("int") for x in lows] + [(x < v).cast("int") for x in highs])
    inside = reduce(lambda a, b: a | b, [(lo <= v) & (v <= hi) for lo, hi in zip(lows, highs)])
    return rows.join(about, group).groupBy(group, "_n", place.alias("_place"), F.when(inside, v).alias("_v")).agg(_n().alias("_c"))


def exact_percentiles(df: DataFrame, group: str, col: str, points: dict, few: int = FEW_VALUES, accuracy: int = ACCURACY) -> DataFrame:
    """Exact percentiles (linear between neighbours) of ``col`` per ``group``: (group, _n, a column per point).

    Selection in two reads: what is put in order are the candidates, a thousandth of a large group or a small one
    (`few` values).  A place outside its bracket is an error, never a wrong value.  The value at place k of the sorted
    rows is the one whose counts reach over k."""
    counts = percentile_candidates(df, group, col, points, few, accuracy)
    w = Window.partitionBy(group).orderBy("_place", "_v").rowsBetween(Window.unboundedPreceding, 0)
    j = counts.withColumn("_cum", F.sum("_c").over(w))
    first, last = F.col("_cum") - F.col("_c"), F.col("_cum") - 1
    at = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in points.items()}

    def value(k):
        return F.max(F.when((first <= k) & (k <= last), F.col("_v")))
    out = j.groupBy(group, "_n").agg(*[a for name, p in at.items() for a in (value(F.floor(p)).alias(f"_lo_{name}"), value(F.ceil(p)).alias(f"_hi_{name}"))])

    def found(c):
        return F.coalesce(F.col(c), F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double"))
    return out.select(group, "_n", *[
        (found(f"_lo_{name}") + (found(f"_hi_{name}") - found(f"_lo_{name}")) * (p - F.floor(p))).alias(name) for name, p in at.items()])


def rank_table(df: DataFrame, col: str, buckets: int = 256, sums=()) -> DataFrame:
    """Exact average rank of every distinct value of one column (see ``rank_long``)."""
    g = df.withColumn("_g", F.lit(0))
    return rank_long(g, "_g", col, buckets, sums).drop("_g")


def spearman(df: DataFrame, cols, key: str) -> DataFrame:
    """agg_spearman: Pearson correlation of average ranks over rows with all values present.

    One long-format pass: unpivot -> one rank table per parameter (grouped) ->
    join back on (parameter, value) -> pivot to one row per key -> one corr aggregate.
    """
    base = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    long = base.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("parameter"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")
    ).select(key, "x.*")
    ranks = rank_long(long, "parameter", "v").select("parameter", "v", "_rank")
    ranked = long.join(ranks, ["parameter", "v"]).groupBy(key).pivot("parameter", list(cols)).agg(F.first("_rank"))
    return pearson(ranked, list(cols))


def baseline(df: DataFrame, params=PARAMS, top_k: int = 50) -> DataFrame:
    """agg_baseline: top-k rivers by rows, long values, count/mean/median/std/min/max per (state, river, parameter).

    The top-k river list is bounded (k rows) and broadcast for the semi join.
    """
    top = (df.groupBy("river_name").agg(_n().alias("_n"))
           .orderBy(F.col("_n").desc(), "river_name").limit(top_k).select("river_name"))
    kept = df.join(F.broadcast(top), "river_name", "left_semi")
    long = kept.unpivot(["state_name", "river_name"], list(params), "parameter", "value") \
        .where(F.col("value").isNotNull())
    keyed = long.withColumn("k", F.struct("state_name", "river_name", "parameter"))
    stats = keyed.groupBy("k").agg(
        _n().alias("count"), exact_mean("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    medians = exact_percentiles(keyed, "k", "value", {"median": 0.5})
    return stats.join(medians, "k").select("k.*", "count", "mean", "median", "std", "min", "max")
