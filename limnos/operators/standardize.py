"""Column standardisation of raw uploads: name normalisation, regex coalesce,
alias mapping audit, quality flags, raw inventory.

Column-name logic runs on the schema (metadata, a few dozen names) in the
driver; all data work is one ``select`` of ``coalesce`` expressions or one
aggregate + ``unpivot``, so the planner sees a single projection per table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import cleaning as C
from ..functions import text as T

# FIXED VALUES: canonical name -> column-name pattern (on snake-cased names)
CANONICAL_PATTERNS = [
    ("dissolved_oxygen", r"(^do$|dissolved_o2|^do_mg_l$|dissolved_oxygen)"),
    ("bod", r"(^bod$|biochemical_oxygen_demand|^bod_mg_l$|bod_mean_mgl)"),
    ("ph", r"(^ph$|^p_h$|^ph_value$)"),
    ("temperature", r"(^temp$|temperature)"),
    ("conductivity", r"(^conductivity$|conductance|electric_conductivity)"),
    ("nitrate", r"(^nitrate$|^nitrate_n$|^nitrate_mg_l$|nitrite_n_nitrate_n|^no3$)"),
    ("fecal_coliform", r"(^fecal_coliform|faecal_coliform)"),
    ("total_coliform", r"(^total_coliform)"),
    ("fecal_streptococci", r"(strepto|fecal_streptococci|faecal_streptococci)"),
    ("turbidity", r"(turbidity)"),
    ("cod", r"(^cod$|chemical_oxygen_demand)"),
    ("total_dissolved_solids", r"(^tds$|total_dissolved_solids)"),
    ("station_name", r"(station.*name|stn.*name|station.*code|monitoring.*location|^location$)"),
    ("river_name", r"(name_of_water_body|water_body_name|river.*name)"),
    ("water_body_type", r"(type_water_body|water_body_type)"),
    ("sampling_date", r"(^date$|sample_date|monitoring_date|sampling_date|^timestamp$)"),
    ("month", r"(^month$)"),
    ("year", r"(^year$)"),
    ("season", r"(^season$)"),
    ("latitude", r"(^lat$|^latitude$)"),
    ("longitude", r"(^lon$|^longitude$)"),
]
EXCLUSIONS = ["normalized", "scaled", "encoded", "minmax", "zscore", "class_weight",
              "binary_class_weight", "is_safe", "compliance_label_encoded"]
NUMERIC = ["dissolved_oxygen", "bod", "ph", "temperature", "conductivity", "nitrate", "fecal_coliform",
           "total_coliform", "fecal_streptococci", "turbidity", "cod", "total_dissolved_solids"]


def snake_names(columns) -> list[str]:
    """std_coalesce names: the runs of letters and digits joined by `_`; the k-th repeat of a name ends with `_k`."""
    names = ["_".join(re.findall("[a-z0-9]+", str(c).lower())) for c in columns]
    repeats = [names[:k].count(n) for k, n in enumerate(names)]
    return [f"{n}_{r}" if r else n for n, r in zip(names, repeats)]


def coalesce_plan(columns) -> dict[str, list[str]]:
    """canonical -> snake-cased candidate columns in column order (existing canonical first)."""
    names = snake_names(columns)
    plan = {}
    for canon, pattern in CANONICAL_PATTERNS:
        cands = [c for c in names if re.search(pattern, c) and not any(e in c for e in EXCLUSIONS) and c != canon]
        plan[canon] = ([canon] if canon in names else []) + cands
    return plan


def standardize_columns(raw: DataFrame, keep=("source_file",)) -> DataFrame:
    """std_coalesce: one projection of coalesce(candidates) per canonical column (NULL when none)."""
    snake = raw.toDF(*snake_names(raw.columns))
    plan = coalesce_plan(raw.columns)
    cols = [F.col(k) for k in keep if k in snake.columns]
    for canon, cands in plan.items():
        if cands:
            cols.append(F.coalesce(*[F.col(c) for c in cands]).alias(canon))
        else:
            cols.append(F.lit(None).cast("string").alias(canon))
    return snake.select(*cols)


def clean_numeric(df: DataFrame, cols=NUMERIC) -> DataFrame:
    return df.select(*[C.clean_basic(c).alias(c) if c in cols else F.col(c) for c in df.columns])


@dataclass(frozen=True)
class Rule:
    """Column names whose letters and digits match `pattern` are `canonical`; of several, the one of least rank holds."""

    rank: int
    pattern: str
    canonical: str | None
    method: str
    confidence: str
    group: str


def mapping_rules(vocabulary=V.VOCABULARY) -> list[Rule]:
    """The rule table of a vocabulary: ignored names, aliases, metals with their unit, beginnings."""
    group_of = {c: g for g, names in vocabulary.items() for c in names}
    table = [(name, None, "Ignored class variable", "None") for name in V.IGNORED]
    table += [("|".join(map(re.escape, aliases)), c, "Alias Match", "High") for names in vocabulary.values() for c, aliases in names.items()]
    table += [(f"{m}.*{V.METAL_UNIT}", m, "Suffix Match", "Medium") for m in V.METALS]
    table += [(f"{begin}.*", c, "Prefix Match", "Medium") for begin, c in V.BEGINNINGS.items()]
    return [Rule(rank, pattern, c, method, confidence, group_of.get(c, "")) for rank, (pattern, c, method, confidence) in enumerate(table)]


def resolve_columns(columns, vocabulary=V.VOCABULARY) -> dict[str, Rule | None]:
    """std_alias_map: the rule of each raw column name, or None; the whole schema against the whole table."""
    rules = mapping_rules(vocabulary)
    key = {c: "".join(re.findall("[a-z0-9]", str(c).lower())) for c in columns}
    return {c: min((r for r in rules if re.fullmatch(r.pattern, key[c])), key=lambda r: r.rank, default=None) for c in columns}


#: (source, column) pairs that a task profiles before it gives out what it has.
_PROFILED = 50_000


def _partial_profile(columns, k: int):
    """Of each source and column of a task: a row with the counts and up to k rows with the smallest distinct values."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def out(found):
        rows = [(s, c, v, r, n) for (s, c), (rows_, n_, least) in found.items() for v, r, n in [(None, rows_, n_)] + [(x, 0, 0) for x in least]]
        cols = list(zip(*rows)) or [()] * 5
        kinds = [pa.string()] * 3 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, kinds)], ["source_file", "column", "value", "rows", "non_null_count"])

    def run(batches):
        found = {}
        for batch in batches:
            for source in pc.unique(batch.column("source_file")).to_pylist():
                part = batch.filter(pc.is_null(batch.column("source_file")) if source is None else pc.fill_null(pc.equal(batch.column("source_file"), source), False))
                for place, c in enumerate(columns):
                    values = part.column(place + 1)
                    rows, n, least = found.get((source, c), (0, 0, []))
                    new = pc.drop_null(pc.unique(values))
                    new = new.take(pc.array_sort_indices(new)[:k]).to_pylist()
                    found[source, c] = (rows + len(values), n + len(values) - values.null_count, sorted({*least, *new})[:k])
            if len(found) > _PROFILED:
                yield out(found)
                found = {}
        yield out(found)
    return run


def _column_profile(raw: DataFrame, columns, k: int) -> DataFrame:
    """source_file, column, rows, non-null count, and the k smallest distinct values.

    A task gives out k values a source and column at the most, so the shuffle does not grow with the distinct values."""
    flat = raw.select("source_file", *[F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(columns)])
    parts = flat.mapInArrow(_partial_profile(list(columns), k), "source_file string, column string, value string, rows long, non_null_count long")
    each = parts.groupBy("source_file", "column", "value").agg(F.sum("rows").alias("rows"), F.sum("non_null_count").alias("non_null_count"))
    r = F.row_number().over(Window.partitionBy("source_file", "column").orderBy(F.col("value").asc_nulls_last()))
    return each.withColumn("r", r).groupBy("source_file", "column").agg(
        F.sum("rows").alias("rows"), F.sum("non_null_count").alias("non_null_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= k, F.col("value")))), " | ").alias("example_values"))


def alias_audit(raw: DataFrame, data_cols, vocabulary=V.VOCABULARY) -> DataFrame:
    """Mapping audit: per source x mapped column non-null count and example values."""
    spark, snake = raw.sparkSession, dict(zip(raw.columns, snake_names(raw.columns)))
    found = {c: r for c, r in resolve_columns(data_cols, vocabulary).items() if r is not None and r.canonical}
    meta = [(c, snake[c], r.canonical, r.method, r.confidence, r.group) for c, r in found.items()]
    # one row per raw column (bounded by the schema) -> broadcast
    m = spark.createDataFrame(meta, "original_column string, normalized_column string, canonical_column string, "
                                    "mapping_method string, mapping_confidence string, parameter_group string")
    profile = _column_profile(raw, list(found), 3).withColumnRenamed("column", "original_column")
    return profile.join(F.broadcast(m), "original_column").select(
        "source_file", "original_column", "normalized_column", "canonical_column", "mapping_method",
        "mapping_confidence", "parameter_group", "non_null_count", "example_values", F.lit("").alias("notes"))


def unmapped_columns(raw: DataFrame, data_cols, vocabulary=V.VOCABULARY) -> DataFrame:
    """Per source the columns that no rule reads, and why."""
    snake = dict(zip(raw.columns, snake_names(raw.columns)))
    rest = [(c, r) for c, r in resolve_columns(data_cols, vocabulary).items() if r is None or not r.canonical]
    rows = F.array(*[F.struct(F.lit(c).alias("original_column"), F.lit(snake[c]).alias("normalized_column"),
                              F.lit(r.method if r else "No match found").alias("reason")) for c, r in rest])
    return raw.select("source_file").distinct().select("source_file", F.explode(rows).alias("x")).select("source_file", "x.*")


def map_canonical(raw: DataFrame, keep=("source_file",), vocabulary=V.VOCABULARY) -> DataFrame:
    """The expanded canonical table: one column per mapped name, the first non-null of its raw columns."""
    sources: dict[str, list[str]] = {}
    for c, r in resolve_columns([c for c in raw.columns if c not in keep], vocabulary).items():
        if r is not None and r.canonical:
            sources.setdefault(r.canonical, []).append(c)
    return raw.select(*keep, *[F.coalesce(*[F.col(f"`{c}`") for c in cols]).alias(canon) for canon, cols in sources.items()])


DQ_NUMERIC = V.NUMERIC


def quality_flags(std: DataFrame, key=("source_file", "station_id", "sampling_date")) -> DataFrame:
    """dq_flags: one row per issue; a value can raise several, a missing value raises none.

    Values are made long first, so the cleaning expression stands in the plan once however many columns are numeric."""
    c, v, f = F.col("column"), F.col("_v"), F.col("_f")
    nowhere = F.col("station_name").isNull() & F.col("river_name").isNull()
    typed = [F.when(F.col(x).isNotNull(), F.struct(F.lit(x).alias("column"), F.col(x).alias("value"))) for x in DQ_NUMERIC if x in std.columns]
    typed.append(F.when(nowhere, F.struct(F.lit("location").alias("column"), F.lit("NA").alias("value"))))
    long = std.select(*key, F.explode(F.array_compact(F.array(*typed))).alias("x")).select(*key, "x.*")

    def flag(when, value, kind, action="Kept but flagged"):
        return F.when(when, F.struct(value.alias("value"), kind.alias("flag_type"), F.lit(action).alias("action")))
    flags = F.array_compact(F.array(
        flag((c != "location") & f.startswith("Converted <"), F.col("value"), f, "Kept and coerced"),
        flag((c == "ph") & ((v < 0) | (v > 14)), v.cast("string"), F.lit("Extreme pH")),
        flag(c.isin("bod", "dissolved_oxygen", "temperature") & (v < 0), v.cast("string"), F.concat(F.lit("Negative "), c)),
        flag((c == "conductivity") & (v > 500000), v.cast("string"), F.lit("Extreme conductivity")),
        flag(c == "location", F.col("value"), F.lit("Missing station and river"))))
    return C.add_censored(long, "value", "_v", "_f").select(*key, "column", F.explode(flags).alias("f")).select(*key, "column", "f.*")


def raw_inventory(raw: DataFrame, data_cols) -> DataFrame:
    """src_raw_inventory: per source x column non-null count, %, and the five smallest distinct values."""
    return _column_profile(raw, list(data_cols), 5).select(
        "source_file", "column", "non_null_count", (F.col("non_null_count") * 100.0 / F.col("rows")).alias("non_null_pct"),
        F.col("example_values").alias("sample_values"))


def standardize(raw: DataFrame) -> DataFrame:
    """Full standardisation: coalesce, numeric cleaning, river repair."""
    std = clean_numeric(standardize_columns(raw, keep=("source_file", "station_id")))
    return std.select("*", *T.fix_river("river_name", "station_name"))


# FIXED VALUES: false-positive mapping checks (canonical evidence column vs forbidden originals)
FALSE_POSITIVE_CHECKS = [
    ("sulphate_not_ph", "ph", ["sulphate", "sulfate"]),
    ("phosphate_not_ph", "ph", ["phosphate", "total_phosphorus"]),
    ("odour_not_do", "dissolved_oxygen", ["odour", "odor"]),
    ("water_body_not_bod", "bod", ["water_body", "name_of_water_body", "body"]),
]


def false_positive_audit(audit: DataFrame, standardized_columns) -> DataFrame:
    """Pass / Fail per mapping rule: every rule's hits in one aggregate over the audit table."""
    def hits(evidence, bad):
        return F.when((F.col("canonical_column") == evidence) & F.lower("original_column").isin(*bad), F.col("original_column"))
    found = audit.agg(*[F.array_sort(F.collect_set(hits(evidence, bad))).alias(name) for name, evidence, bad in FALSE_POSITIVE_CHECKS])
    rows = []
    for name, _, _ in FALSE_POSITIVE_CHECKS:
        n = F.size(name)
        rows.append(F.struct(F.lit(name).alias("test_name"), F.when(n == 0, "Pass").otherwise("Fail").alias("pass_fail"),
                             F.when(n == 0, F.lit("No false positives detected"))
                             .otherwise(F.concat(F.lit("Found false positives: "), n.cast("string"))).alias("evidence"),
                             F.when(n == 0, F.lit("None")).otherwise(F.array_join(name, ", ")).alias("affected_columns_if_any")))
    used = "class" in standardized_columns
    rows.append(F.struct(F.lit("use_based_class_not_target").alias("test_name"), F.lit("Fail" if used else "Pass").alias("pass_fail"),
                         F.lit("class not found or use_based_class not treated as ML target").alias("evidence"),
                         F.lit("use_based_class" if used else "None").alias("affected_columns_if_any")))
    return found.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
