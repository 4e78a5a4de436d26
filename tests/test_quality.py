"""Quality flags and parameter profiles over tables with any of the numeric columns."""

from limnos.operators import standardize as S
from limnos import vocabulary as V


def _flags(df):
    return sorted((r["station_id"], r["column"], r["value"], r["flag_type"], r["action"]) for r in S.quality_flags(df, key=("station_id",)).collect())


def test_every_rule_and_its_boundary(spark):
    rows = [(1, "s", None, "-0.1", "14.1", "<4", "500000.5", "<0.2", "-3"), (2, None, None, "0", "14", "4", "500000", "BDL", "nd"),
            (3, None, "r", None, "-1", None, None, None, None)]
    df = spark.createDataFrame(rows, "station_id int, station_name string, river_name string, bod string, ph string, dissolved_oxygen string, "
                                     "conductivity string, arsenic string, temperature string")
    assert _flags(df) == sorted([
        (1, "bod", "-0.1", "Negative bod", "Kept but flagged"), (1, "ph", "14.1", "Extreme pH", "Kept but flagged"),
        (1, "dissolved_oxygen", "<4", "Converted <4.0 to 2.0", "Kept and coerced"), (1, "conductivity", "500000.5", "Extreme conductivity", "Kept but flagged"),
        (1, "arsenic", "<0.2", "Converted <0.2 to 0.1", "Kept and coerced"), (1, "temperature", "-3.0", "Negative temperature", "Kept but flagged"),
        (2, "location", "NA", "Missing station and river", "Kept but flagged"), (3, "ph", "-1.0", "Extreme pH", "Kept but flagged")])


def test_all_numeric_names_are_cleaned_by_one_expression(spark):
    names = ", ".join(f"{c} string" for c in V.NUMERIC)
    df = spark.createDataFrame([(1, "s", "r", *["<2"] * len(V.NUMERIC))], f"station_id int, station_name string, river_name string, {names}")
    found = S.quality_flags(df, key=("station_id",))
    assert sorted(r["column"] for r in found.collect()) == sorted(V.NUMERIC)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("not detectable") <= 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "station_id int, station_name string, river_name string, ph string")
    assert _flags(df) == []
