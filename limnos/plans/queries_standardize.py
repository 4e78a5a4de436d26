"""Registered queries: raw uploads -> canonical columns, mapping audit, quality flags, inventory,
annual min/max records (SURVEY 2.1 / 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import standardize as S
from ..sources import bindings as B
from . import datasets as D
from .out import rounded

Q = {}


def q(fn):
    Q[fn.__name__] = fn
    return fn


DATA_COLS = [c for c in B.RAW_COLUMNS if c != "source_file"]


@q
def std_coalesce(spark, sf):
    return S.standardize(D.raw_uploads(spark, sf))


@q
def std_alias_map(spark, sf):
    return S.alias_audit(D.raw_uploads(spark, sf), DATA_COLS)


@q
def std_unmapped(spark, sf):
    return S.unmapped_columns(D.raw_uploads(spark, sf), DATA_COLS)


@q
def std_alias_table(spark, sf):
    return S.map_canonical(D.raw_uploads(spark, sf).drop("station_id"))


@q
def src_raw_inventory(spark, sf):
    return rounded(S.raw_inventory(D.raw_uploads(spark, sf), DATA_COLS))


@q
def dq_flags(spark, sf):
    return S.quality_flags(D.canonical_uploads(spark, sf), key=("source_file", "station_id", "sampling_date"))


@q
def dq_flag_summary(spark, sf):
    f = S.quality_flags(D.canonical_uploads(spark, sf), key=("source_file", "station_id", "sampling_date"))
    kind = F.when(F.col("flag_type").startswith("Converted <"), F.lit("Converted <")).otherwise(F.col("flag_type"))
    return f.groupBy(kind.alias("flag_type")).agg(F.count(F.lit(1)).alias("count"))


PAIRS = ["quantity", "price", "discount", "tax"]
IMPUTE = ["price_min", "price_max", "tax_min", "tax_max"]


def imputed(spark, sf):
    """imp_group_median: median per (basin, year), then the global median (two-level fill).

    Medians are read off exact ranks of distinct values, so no group is one buffer."""
    a = B.annual_geo(spark, sf)
    each = a.select("river_basin", "year", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in IMPUTE])).alias("x")).select("river_basin", "year", "x.*").where("v is not null")
    key = each.select(F.struct("river_basin", "year", "column").alias("k"), "v").union(
        each.select(F.struct(F.lit(None).cast("string"), F.lit(None).cast("int"), "column").alias("k"), "v"))
    m = P.exact_percentiles(key, "k", "v", {"median": 0.5}).select("k.*", "median")
    wide = m.groupBy("river_basin", "year").pivot("column", IMPUTE).agg(F.first("median"))
    group = wide.where("year is not null").select("river_basin", "year", *[F.col(c).alias(f"_g_{c}") for c in IMPUTE])
    whole = wide.where("year is null").agg(F.first(F.struct(*IMPUTE))).scalar()
    j = a.join(group, ["river_basin", "year"], "left")
    return j.select("station_code", "year", "river_basin", "quantity_min", "quantity_max", "discount_min",
                    "discount_max", *[F.coalesce(F.col(c), F.col(f"_g_{c}"), whole[c]).alias(c) for c in IMPUTE])


def means(spark, sf):
    """mean_of_minmax, written once for the scalers."""
    def build():
        return imputed(spark, sf).select("station_code", "year", *[
            ((F.col(f"{p}_min") + F.col(f"{p}_max")) / 2).alias(f"{p}_mean") for p in PAIRS])
    return D.materialized(spark, sf, "annual_means", build)


@q
def imp_group_median(spark, sf):
    return rounded(imputed(spark, sf))


@q
def mean_of_minmax(spark, sf):
    return rounded(means(spark, sf))


def _scaled(spark, sf, suffix, statistics, scale):
    """One aggregate has the statistics of all columns; its single row is joined to every row by a constant key."""
    m, cols = means(spark, sf), [f"{p}_mean" for p in PAIRS]
    row = m.agg(*[f(c).alias(f"_{c}_{k}") for c in cols for k, f in enumerate(statistics)]).withColumn("_one", F.lit(1))
    j = m.withColumn("_one", F.lit(1)).join(F.broadcast(row), "_one")
    return rounded(j.select("station_code", "year", *[
        scale(F.col(c), *[F.col(f"_{c}_{k}") for k in range(len(statistics))]).alias(f"{c}_{suffix}") for c in cols]))


@q
def scl_minmax(spark, sf):
    return _scaled(spark, sf, "minmax", (F.min, F.max), lambda v, lo, hi: F.try_divide(v - lo, hi - lo))


@q
def scl_zscore(spark, sf):
    return _scaled(spark, sf, "zscore", (F.avg, F.stddev_pop), lambda v, mu, sd: F.try_divide(v - mu, sd))


@q
def std_mapping_checks(spark, sf):
    raw = D.raw_uploads(spark, sf)
    audit = S.alias_audit(raw, DATA_COLS)
    return S.false_positive_audit(audit, S.standardize(raw).columns)
