"""Dirty-text parsers on the boundary strings of the field sheets."""

from limnos.functions import cleaning as C
from limnos.functions import text as T

RAW = ["BDL", "0.5(BDL)", "<0.3", "1.8 mg/l", "1,234", ".5", "-", "", None, "nd", "abc"]


def _run(spark, col):
    df = spark.createDataFrame([(x,) for x in RAW], "raw string")
    return [r[0] for r in df.select(col).collect()]


def test_basic(spark):
    assert _run(spark, C.clean_basic("raw")) == [None, 0.5, 0.3, 1.8, 1.0, 0.5, None, None, None, None, None]


def test_censored(spark):
    c = C.clean_censored("raw")
    vals = _run(spark, c["value"])
    flags = _run(spark, c["flag"])
    assert vals == [None, 0.5, 0.15, 1.8, 1234.0, 0.5, None, None, None, None, None]
    assert flags[2] == "Converted <0.3 to 0.15"
    assert flags[0] == "Below detection/Missing" and flags[6] == "Below detection/Missing"
    assert flags[10] == "Parse Error" and flags[8] == ""


def test_core_bdl_model(spark):
    assert _run(spark, C.clean_core("raw"))[5] == 0.5          # numeric text passes through (D7)
    assert _run(spark, C.clean_core("raw"))[2] == 0.3
    assert _run(spark, C.bdl_zero("raw"))[:3] == [0.0, None, None]
    assert _run(spark, C.model_input("raw"))[:2] == [0.0, 0.5]


def test_date_parse(spark):
    df = spark.createDataFrame([("2024-01-05",), ("05-01-2024",), ("05/01/2024",), ("05 Jan 2024",), ("junk",)], "d string")
    got = [str(r[0]) for r in df.select(C.parse_date("d")).collect()]
    assert got == ["2024-01-05"] * 4 + ["None"]


def test_station_text(spark):
    names = [("Godavari river at Jaikwadi Dam",), ("Mithi river U/S of Road bridge",),
             ("Drain near STP D/S",), ("BPT, Navapur",), ("Village well",), (None,)]
    df = spark.createDataFrame(names, "s string")
    out = df.select(T.infer_river("s").alias("r"), T.position_tag("s").alias("p"),
                    T.context_tag("s").alias("c"), T.spatial_tags("s").alias("t"),
                    T.normalise("s").alias("n"), T.station_base("s").alias("b")).collect()
    assert [r["r"] for r in out][:4] == ["Godavari", "Mithi", None, "BPT/Navapur"]
    assert [r["p"] for r in out][:3] == ["Unknown", "Upstream", "Downstream"]
    assert out[2]["c"] == "Point Source / Drain" and out[4]["c"] == "Groundwater"
    assert out[1]["t"] == "UPSTREAM" and out[0]["t"] == "NONE"
    assert out[0]["n"] == "godavari jaikwadi"
    assert out[1]["b"] == "MITHI RIVER ROAD BRIDGE"


def test_jaccard(spark):
    df = spark.createDataFrame([("a b c", "b c d"), ("", "x")], "a string, b string")
    got = [r[0] for r in df.select(T.jaccard(T.tokens("a"), T.tokens("b"))).collect()]
    assert got == [0.5, 0.0]
